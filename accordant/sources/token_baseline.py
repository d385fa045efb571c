"""The baseline of text drift: a centroid and a table of token counts, as a version in a folder; a pointer names the one that holds.

Writers make a new version and then move the pointer, so readers see one version or the other, whole. Counts never pass through the driver.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.sources import files, readers

POINTER = "current.json"


def load(spark: SparkSession, folder: str) -> dict[str, Any] | None:
    """{version, text_count, centroid, token_table, ...} of the version that holds; None if there is none."""
    return readers.read_json(spark, f"{folder.rstrip('/')}/{POINTER}", missing=None)


def save(folder: str, counts: DataFrame, centroid: list[float], text_count: int, **more: Any) -> dict[str, Any]:
    """Writes counts(token, n) as a new version and points to it."""
    version = uuid.uuid4().hex
    place = f"{folder.rstrip('/')}/tokens-{version}"
    counts.select("token", "n").write.parquet(place)
    kept = {"version": version, "text_count": text_count, "centroid": centroid, "token_table": place} | more
    files.write_text(f"{folder.rstrip('/')}/{POINTER}", json.dumps(kept))
    return kept


def counts_of(spark: SparkSession, baseline: dict[str, Any]) -> DataFrame:
    """(token, n) of a baseline; one of an older kind holds its counts itself."""
    if baseline.get("token_table"):
        return spark.read.schema("token string, n long").parquet(baseline["token_table"])
    return spark.createDataFrame(list((baseline.get("token_counts") or {}).items()), "token string, n long")


def merge(spark: SparkSession, folder: str, counts: DataFrame, centroid: list[float], text_count: int) -> dict[str, Any]:
    """A version that holds what the present one does and more texts too: counts add up in a join, the centroid is the mean over all texts."""
    old = load(spark, folder)
    if old is None:
        return save(folder, counts, centroid, text_count)
    had = counts_of(spark, old).withColumnRenamed("n", "had")
    both = had.join(counts.select("token", "n"), "token", "full").select("token", (F.coalesce("had", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"))
    texts = old["text_count"] + text_count
    mean = [(a * old["text_count"] + b * text_count) / max(texts, 1) for a, b in zip(old["centroid"], centroid, strict=True)]
    return save(folder, both, mean, texts)
