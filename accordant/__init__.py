"""A Spark-native engine for data contracts: profiling, checking, drift, schema evolution and reporting."""
