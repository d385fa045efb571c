"""What a dashboard shows of contracts, reports and violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RISKY_NAME = r"(?i)confidence|sequence|run_type|source_hash|schema_version"


def is_risky(clauses: DataFrame) -> Column:
    return F.col("column_name").rlike(RISKY_NAME) | F.col("minimum").isNotNull() | F.col("maximum").isNotNull() | (F.coalesce(F.size("enum"), F.lit(-1)) > 0)


def contract_overview(clauses: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(contract_id, clause_count, risky_fields, subscriber_count), by id; ids of subscriptions have to be equal to the letter."""
    counted = clauses.groupBy("contract_id").agg(F.count("*").alias("clause_count"), F.array_sort(F.collect_list(F.when(is_risky(clauses), F.col("column_name")))).alias("risky_fields"))
    subscribers = subscriptions.groupBy("contract_id").agg(F.count("*").alias("subscriber_count"))
    return counted.join(subscribers, "contract_id", "left").withColumn("subscriber_count", F.coalesce("subscriber_count", F.lit(0))).orderBy("contract_id")


def violations_with_source(violations: DataFrame, reports: DataFrame) -> DataFrame:
    """violations with source_kind, by the file of their report: an injected test, a real finding, or unknown."""
    named = violations.join(reports.select("report_id", "file_name").distinct(), "report_id", "left")
    kind = F.when(F.lower("file_name").contains("injected"), "Injected test").when(F.col("file_name").isNotNull(), "Real finding").otherwise("Unknown")
    return named.withColumn("source_kind", kind)


def filtered_violations(violations: DataFrame, severity: str = "ALL", contract_id: str = "ALL", source_kind: str = "ALL") -> DataFrame:
    for column, wanted in (("severity", severity), ("contract_id", contract_id), ("source_kind", source_kind)):
        if wanted != "ALL":
            violations = violations.where(F.col(column) == wanted)
    return violations


def with_top_file(violations: DataFrame, ranked: DataFrame) -> DataFrame:
    """violations with the first file of their check."""
    return violations.join(ranked.where("rank = 1").select("check_id", "file_path"), "check_id", "left")


def severity_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy(F.upper(F.coalesce("severity", F.lit("UNKNOWN"))).alias("severity")).agg(F.count("*").alias("n"))


def report_totals(reports: DataFrame) -> DataFrame:
    """One row of reports(failed, blocking): failures in all, reports that block, reports without a failure."""
    return reports.agg(F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.count_if("blocking").alias("blocking"), F.count_if(F.col("failed") == 0).alias("clean"))


def failing_checks(results: DataFrame) -> DataFrame:
    return results.where(F.col("status").isNotNull() & (F.col("status") != "PASS"))


def by_time(reports: DataFrame) -> DataFrame:
    """Latest first; reports without a time last."""
    return reports.orderBy(F.col("run_timestamp").cast("string").try_cast("timestamp").desc_nulls_last())


def one(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(key) == value).limit(1)


def snapshot_inventory(files: DataFrame) -> DataFrame:
    """(contract_id, versions, paths, latest) of snapshot files(contract_id, name, path); the latest copy counts here too."""
    return files.groupBy("contract_id").agg(
        F.count("*").alias("versions"), F.array_sort(F.collect_list("path")).alias("paths"), F.coalesce(F.max(F.when(F.col("name") == "latest.yaml", F.col("path"))), F.max("path")).alias("latest")
    )
