"""What a written table costs: row groups and batches of long rows, and the shuffle files of the write."""

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from accordant.llm import ngram_join
from accordant.llm.shared import BATCH_ROWS, ROW_GROUP, Tables, written

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p for folder in folders for p in Path(folder.toString()).rglob("shuffle_*.data")}


def test_shuffle_files_go_with_the_write(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(CLEANUP, None)
    made = spark.range(50_000).groupBy((F.col("id") % 97).alias("k")).count()
    assert written(made, "counts").count() == 97
    left = {p for p in _shuffle_files(spark) - before if p.stat().st_size > 20_000}
    written(spark.range(50_000).repartition(5, "id").groupBy("id").count(), "many-counts")
    assert not {p for p in _shuffle_files(spark) - before - left if p.stat().st_size > 20_000}
    assert spark.conf.get(CLEANUP, None) == setting
    # what is made again from the same table is whole
    assert made.count() == 97 and made.agg(F.sum("count")).first()[0] == 50_000


def test_sets_are_read_in_small_pieces(spark):
    texts = spark.range(1200).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda k: F.concat(F.lit("w"), (F.col("id") * 2000 + k).cast("string"))), " ").alias("text"))
    tables = Tables(spark)
    members, named, _ = ngram_join._members_and_edges(tables, texts.coalesce(1), 4, 85, every=False)
    assert named.count() == 1200 and members.agg(F.min("n"), F.max("n")).first() == (1997, 1997)
    groups = [pq.ParquetFile(p.removeprefix("file:")).metadata for p in members.inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)]
    assert sum(sizes) > 4 * ROW_GROUP and max(sizes) < 2 * ROW_GROUP
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == BATCH_ROWS
    tables.drop()
