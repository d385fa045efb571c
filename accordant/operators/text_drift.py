"""Drift of texts and vectors: token histograms, hashed vectors, centroids and their distance to a baseline."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.functions import values as V
from accordant.operators import ordering, policy
from accordant.sources import embeddings, scratch, token_baseline

DIMENSIONS = 128
WARN_ABOVE, FAIL_ABOVE = 0.18, 0.35
#: Tokens whose buckets a task remembers, and rows whose vectors it holds.
REMEMBERED, ROWS_AT_ONCE = 500_000, 2_000
_TOKEN = re.compile("[a-z0-9]+")


def token_counts(df: DataFrame, column: str = "text") -> DataFrame:
    """(token, n)."""
    return df.select(F.explode(V.tokens(F.col(column))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def top_shifted(left: DataFrame, right: DataFrame, limit: int = 8) -> DataFrame:
    """(token, before, after, shift) of the tokens whose counts differ most; on ties the later token first."""
    joined = left.select("token", F.col("n").alias("before")).join(right.select("token", F.col("n").alias("after")), "token", "full")
    filled = joined.select("token", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    shifted = filled.withColumn("shift", F.abs(F.col("after") - F.col("before"))).where("shift > 0")
    return shifted.orderBy(F.desc("shift"), F.desc("token")).limit(limit)


def _vectors(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with column ``text`` in lower case, and a matrix of their rows' vectors; each different token is hashed once, as far as a task remembers it."""
    known: dict[str, int] = {}
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for at in range(0, len(texts), ROWS_AT_ONCE):
            part = texts[at : at + ROWS_AT_ONCE]
            out = np.zeros((len(part), dimensions))
            for i, text in enumerate(part):
                for token, n in Counter(_TOKEN.findall(text or "")).items():
                    bucket = known.get(token)
                    if bucket is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[token] = bucket = hashlib.sha256(token.encode()).digest()[-1] % dimensions
                    out[i, bucket] += n
            yield batch.slice(at, len(part)), out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)


def _checked_dimensions(dimensions: int) -> int:
    if 256 % dimensions:
        raise ValueError("dimensions have to divide 256")
    return dimensions


def hashed_vectors(df: DataFrame, key: str, column: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, bucket, weight): token counts by bucket, scaled to length 1; buckets without tokens have no row. Every row has its own vector,
    rows that share a key or have a null one too. No shuffle."""
    _checked_dimensions(dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, vectors in _vectors(batches, dimensions):
            row, bucket = np.nonzero(vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(bucket.astype(np.int32)), pa.array(vectors[row, bucket])], names=[key, "bucket", "weight"])

    schema = T.StructType([df.schema[key], T.StructField("bucket", T.IntegerType()), T.StructField("weight", T.DoubleType())])
    return df.select(key, F.lower(column).alias("_lower")).mapInArrow(run, schema)


def text_centroid(df: DataFrame, key: str, column: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(bucket, weight): mean of the hashed vectors of all rows, empty texts included; all buckets. What is shuffled are sums of vectors."""
    _checked_dimensions(dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(dimensions), 0
        for batch, vectors in _vectors(batches, dimensions):
            total += vectors.sum(axis=0)
            texts += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(total), pa.array([texts] * dimensions, pa.int64())], names=["bucket", "s", "texts"])

    buckets = df.sparkSession.range(dimensions).select(F.col("id").cast("int").alias("bucket"))
    sums = df.select(F.lower(column).alias("_lower")).mapInArrow(run, "bucket int, s double, texts long").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("texts").alias("texts"))
    return buckets.join(sums, "bucket", "left").select("bucket", (F.coalesce("s", F.lit(0.0)) / F.greatest(F.coalesce("texts", F.lit(0)), F.lit(1))).alias("weight"))


def vector_centroid(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """(by..., pos, value): element-wise mean of vectors."""
    exploded = df.select(*by, F.posexplode(vector).alias("pos", "x"))
    return exploded.groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def as_array(centroid: DataFrame, *by: str, pos: str = "pos", value: str = "value", name: str = "centroid") -> DataFrame:
    """Rows of a vector as one array, in order; as long as the vector."""
    ordered = F.array_sort(F.collect_list(F.struct(pos, value)))
    return centroid.groupBy(*by).agg(F.transform(ordered, lambda x: x[value]).alias(name))


def drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row (distance, status, severity) of centroids(bucket, weight)."""
    b = as_array(baseline, pos="bucket", value="weight", name="b")
    c = as_array(current, pos="bucket", value="weight", name="c")
    distance = V.round_half_even(V.cosine_distance(F.col("b"), F.col("c")), 6)
    out = b.join(F.broadcast(c)).select(distance.alias("distance"))
    status = policy.status_from_rate(F.col("distance"), WARN_ABOVE, FAIL_ABOVE)
    return out.withColumns({"status": status, "severity": policy.severity_for_status(status)})


def baseline_action(exists: bool, refresh: bool, same_shape: bool) -> str:
    """What becomes of a stored baseline: distance is 0 unless it is used as it is."""
    if not exists:
        return "created"
    if refresh:
        return "refreshed"
    return "used_existing" if same_shape else "recreated_due_to_shape_mismatch"


def drift_metric(
    spark, texts: DataFrame, key: str, baseline: dict | None, refresh: bool = False, store: str | None = None, provider: embeddings.Provider | None = None, cache: str | None = None
) -> tuple[dict, dict]:
    """(metric, baseline to keep) of texts(key, text) against a stored baseline, by default the one in ``store``.

    Vectors come from the provider, or are hashed ones if there is none or it fails. Token counts stay in a table, in ``store`` or the shared folder; only
    the centroid and the few most shifted tokens come to the driver.
    """
    found = embeddings.centroid(texts.select(key, "text"), provider, cache) if provider is not None else None
    if found is None or found.vector is None:
        vector = [r["weight"] for r in text_centroid(texts, key).orderBy("bucket").collect()]  # as many as dimensions
        source = {"metric_source": "hashed_tokens", "fallback_reason": found.problem if found else "There is no provider."}
    else:
        vector, source = found.vector, {"metric_source": "provider", "fallback_reason": None}
    baseline = token_baseline.load(spark, store) if baseline is None and store else baseline
    counts = token_counts(texts)
    what = baseline_action(baseline is not None, refresh, bool(baseline) and len(baseline.get("centroid") or []) == len(vector))
    shifted, distance = [], 0.0
    if what == "used_existing":
        rows = lambda v: spark.createDataFrame(list(enumerate(v)), "bucket int, weight double")
        distance = drift(rows(baseline["centroid"]), rows(vector)).first()["distance"]
        shifted = [r.asDict() for r in top_shifted(token_baseline.counts_of(spark, baseline), counts).collect()]
        kept = baseline
    else:
        kept = token_baseline.save(store or f"{scratch.folder(spark)}/token-baseline-{uuid.uuid4().hex}", counts, vector, texts.count())
    status = "FAIL" if distance > FAIL_ABOVE else "WARN" if distance > WARN_ABOVE else "PASS"
    return {"metric": "embedding_drift", "value": distance, "status": status, "baseline_action": what, "top_shifted_tokens": shifted} | source, kept


def midpoint_windows(df: DataFrame, order_by: str) -> tuple[DataFrame, DataFrame]:
    """First and second half of time-ordered rows; a single row is both. Rows of one time are ordered by a hash of all their columns.

    Both halves are filters on rows that were numbered by range and written, so either is read in parallel.
    """
    tie = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if isinstance(t, T.MapType) else F.col(f"`{c}`") for c, t in ((f.name, f.dataType) for f in df.schema.fields)])
    placed = ordering.numbered(df.withColumn("_tie", tie), [order_by, "_tie"], scratch.Tables(df.sparkSession), "midpoint").drop("_tie")
    cut = F.greatest(F.floor(F.col("rows") / 2), F.lit(1))
    first = placed.where(F.col("number") < cut)
    second = placed.where((F.col("number") >= cut) | (F.col("rows") == 1))
    return first.select(*df.columns), second.select(*df.columns)


def fact_texts(records: DataFrame, time_column: str, facts: str = "extracted_facts") -> DataFrame:
    """(ord, text): texts of facts by the time of their record; records without a time come last; empty texts go."""
    exploded = records.select(F.coalesce(F.col(time_column).cast("string").try_cast("timestamp"), F.current_timestamp()).alias("at"), F.posexplode(facts).alias("ord", "fact"))
    return exploded.select("at", "ord", F.col("fact.text").alias("text")).where("text is not null and text <> ''").orderBy("at", "ord")
