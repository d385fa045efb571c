"""Tables that a job of several steps writes to the shared folder and reads back, so that a lost executor costs a task and plans don't grow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a session in one process gets a folder of its own; a cluster has to name one."""
    context = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.getCheckpointDir().isEmpty():
        named = context.getCheckpointDir().get()
    if not named:
        if not context.isLocal():
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Tables:
    """Tables by name; a name that is written again is another table. ``drop`` removes those that nothing lazy reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, *names: str) -> DataFrame:
        """Tables of one schema as one."""
        paths = [self.paths[n] for n in names]
        return self.spark.read.schema(self.spark.read.parquet(paths[0]).schema).parquet(*paths)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
