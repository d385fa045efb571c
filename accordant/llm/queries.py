"""One thin query for each corpus operator, over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.llm import chat_format, code_compression, merkle_manifest
from accordant.llm.bwt_dedup import PASSAGE_WORDS, removal_digests
from accordant.llm.license_scan import license_scan
from accordant.llm import ngram_join
from accordant.llm.ngram_join import ngram_components
from accordant.llm.page_extract import extract_pages
from accordant.llm.pattern_packing import pack_documents
from accordant.llm.quality_rules import quality_rules
from accordant.llm.recurrent_lm import score_documents
from accordant.llm import spaced_seed
from accordant.llm.shared import id_fold, table
from accordant.llm.subword_classifier import subword_scores
from accordant.llm.token_frames import token_digests


def tokenizer_file() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path. 256 make up a directory with 15 others below it, 16 in each and 16 in itself; a document that speaks of a licence is a
    licence file, from which the others of its directory, and of those below without one, inherit. Many a directory has none."""
    documents = table(spark, sf_dir, "documents")
    doc_id = F.coalesce(F.col("doc_id"), F.lit(0))
    upper, lower = F.floor(doc_id / 256).cast("string"), (F.floor(doc_id / 16) % 16).cast("string")
    speaks = F.coalesce(F.lower("text").contains("licen"), F.lit(False))
    directory = F.concat_ws("/", F.lit("files"), upper, F.when(lower != "0", lower))
    name = F.concat(F.when(speaks, F.lit("LICENSE.")).otherwise(F.lit("text.")), doc_id.cast("string"))
    return license_scan(documents.withColumn("path", F.concat_ws("/", directory, name)))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=0)


def op4_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), held_out=id_fold(F.col("doc_id")) == 1)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scores = subword_scores(documents, documents.where(id_fold(F.col("doc_id")) != 0), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", (id_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=2)


def op7_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seed.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the removed bytes, the passages of over 50 words that stand elsewhere too are counted, for many of them have fewer than 400 bytes."""
    return removal_digests(table(spark, sf_dir, "documents"), words=PASSAGE_WORDS)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document, by the crc32 of its id, is claimed to have its text in lower case."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle_manifest.merkle_manifest(table(spark, sf_dir, "documents"), "doc_id", "source", ("doc_id", "source", "lang", "n_chars", "text"), claimed={"text": lowered}, where=id_fold(F.col("doc_id")) == 0)


def op12_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_compression.code_digests(table(spark, sf_dir, "embeddings"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_digests(chat_format.format_conversations(chat_format.with_probe(table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_ngram_join": op2_ngram_join,
    "op3_token_frames": op3_token_frames,
    "op4_recurrent_lm": op4_recurrent_lm,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_spaced_seed_decontamination": op7_spaced_seed_decontamination,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_code_compression": op12_code_compression,
    "op13_chat_format": op13_chat_format,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": ngram_join.oracle_sql(n=4, percent=85),
    "op7_spaced_seed_decontamination": spaced_seed.oracle_sql(),
    "op11_merkle_manifest": merkle_manifest.oracle_sql(),
    "op12_code_compression": code_compression.oracle_sql(),
    "op13_chat_format": chat_format.oracle_sql(),
}
