"""From raw documents to packed training sequences, a stage at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from accordant.llm.bwt_dedup import without_repeats
from accordant.llm.ngram_join import one_of_each_group
from accordant.llm.pattern_packing import pack_documents
from accordant.llm.quality_rules import without_rejected
from accordant.llm.queries import tokenizer_file
from accordant.llm.shared import table, table_path, written
from accordant.llm.spaced_seed import without_contaminated

#: Passages of over 50 words that repeat are cut.
PASSAGE_WORDS = 51


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return without_rejected(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles are linked at a similarity of 0.8, one stays."""
    return one_of_each_group(docs, n=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes, and passages of 51 words, that stand anywhere else too are cut from the texts."""
    return without_repeats(docs, words=PASSAGE_WORDS)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids; a row for each piece of a document."""
    return pack_documents(docs, tokenizer_file(), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", keep_uncontaminated),
    ("best-fit packing", pack),
]

#: The stages use learned weights, byte-level matching and a tokenizer, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each one's rows are written as Parquet and read again."""
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
