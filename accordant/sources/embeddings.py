"""Vectors of texts from a provider, which is a function of a list of texts: a connector for any service or model."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.sources import files, scratch

#: Takes texts, gives a vector for each; called on the executors.
Provider = Callable[[list[str]], list[list[float]]]


def embed(df: DataFrame, key: str, provider: Provider, column: str = "text", batch: int = 64) -> DataFrame:
    """(key, vector) of every row whose text isn't null or empty, with at most ``batch`` texts a call. A provider that gives another number of vectors is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = provider(part.column(1).to_pylist())
                if len(vectors) != part.num_rows:
                    raise ValueError(f"{len(vectors)} vectors for {part.num_rows} texts")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=[key, "vector"])

    schema = T.StructType([df.schema[key], T.StructField("vector", T.ArrayType(T.DoubleType()))])
    return df.select(key, column).where(f"`{column}` is not null and `{column}` <> ''").mapInArrow(run, schema)


#: Variables that name a service, keys of a trace's metadata that do, and marks of models that make vectors.
SERVICE_VARIABLES = ("OLLAMA_BASE_URL", "OLLAMA_HOST", "OPENAI_BASE_URL")
MODEL_VARIABLES = ("OLLAMA_EMBED_MODEL", "OLLAMA_EMBEDDING_MODEL")
SERVICE_KEYS = ("ollama_base_url", "base_url")
MODEL_MARKS = ("embed", "nomic", "bge", "e5", "mxbai")


@dataclass(frozen=True)
class HttpProvider:
    """Vectors from a service that takes {model, input} at /api/embed and gives {embeddings}."""

    base_url: str
    model: str
    timeout: float = 60

    def __call__(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode("utf-8")
        request = urllib.request.Request(f"{self.base_url}/api/embed", data=body, headers={"Content-Type": "application/json"}, method="POST")
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            vectors = json.loads(answer.read().decode("utf-8")).get("embeddings")
        if not isinstance(vectors, list):
            raise ValueError("the answer has no embeddings")
        return vectors


def discover(traces: DataFrame | None = None, environment: dict[str, str] | None = None, timeout: float = 10) -> tuple[HttpProvider | None, str | None]:
    """(provider, None), or (None, why there is none): the service that the environment or else a trace's metadata names, and a model of it that makes vectors."""
    known = os.environ if environment is None else environment
    bases = [known.get(k) for k in SERVICE_VARIABLES]
    if not any(bases) and traces is not None and "metadata" in traces.columns:
        named = traces.select(F.coalesce(*[F.nullif(F.col("metadata")[k], F.lit("")) for k in SERVICE_KEYS]).alias("base")).where("base is not null").limit(1)
        bases = [r.base for r in named.collect()]
    base = next((b for b in bases if b), None)
    if base is None:
        return None, "Neither the environment nor a trace names a service."
    base = base.strip().rstrip("/").removesuffix("/v1").rstrip("/")
    model = next((known[k] for k in MODEL_VARIABLES if known.get(k)), None)
    if model is None:
        try:
            with urllib.request.urlopen(f"{base}/api/tags", timeout=timeout) as answer:
                names = [str(m.get("name") or "") for m in json.loads(answer.read().decode("utf-8")).get("models", []) if isinstance(m, dict)]
        except Exception as problem:  # noqa: BLE001 - a service that can't be asked is none
            return None, f"The service at {base} can't be asked: {problem}"
        model = next((n for n in names if any(mark in n.lower() for mark in MODEL_MARKS)), None)
        if model is None:
            return None, f"The service at {base} has no model that makes vectors, of {len(names)}."
    return HttpProvider(base, model), None


class Centroid(NamedTuple):
    """Mean vector of the texts, or None and what went wrong."""

    vector: list[float] | None
    problem: str | None


VECTORS = "k1 long, k2 long, vector array<double>"


def cached_vectors(df: DataFrame, provider: Provider, cache: str | None = None, column: str = "text", batch: int = 24, attempts: int = 3, wait: float = 0.5, per_second: float | None = None, tasks: int = 4) -> tuple[DataFrame, DataFrame]:
    """(vectors, failures): (k1, k2, vector) of the different texts that aren't empty, k1 and k2 being hashes of a text, and (k1, k2, problem) of those without.

    The provider is asked for texts that ``cache``, a table by these hashes, doesn't have, each once, in ``tasks`` tasks with ``batch`` texts a call; a call
    that fails is tried again, after twice the time, ``attempts`` times in all. ``per_second`` calls are made at most, by all tasks together. New vectors go to
    the cache before anything is made of them.
    """
    spark = df.sparkSession
    tables = scratch.Tables(spark)
    keyed = df.where(f"`{column}` is not null and `{column}` <> ''").select(F.xxhash64(column).alias("k1"), F.xxhash64(F.lit(41), column).alias("k2"), F.col(column).alias("text"))
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    known = spark.read.schema(VECTORS).parquet(cache).dropDuplicates(["k1", "k2"]) if cache and files.exists(cache) else None
    missing = texts.join(known, ["k1", "k2"], "left_anti") if known is not None else texts
    pause = tasks / per_second if per_second else 0.0

    def ask(part: list[str]) -> tuple[list[list[float] | None], str | None]:
        problem = None
        for k in range(attempts):
            if k:
                time.sleep(wait * 2 ** (k - 1))
            began = time.monotonic()
            try:
                vectors = provider(part)
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                return vectors, None
            except Exception as error:  # noqa: BLE001 - whatever it is, it is tried again and told
                problem = f"{type(error).__name__}: {error}"[:500]
            finally:
                time.sleep(max(0.0, pause - (time.monotonic() - began)))
        return [None] * len(part), problem

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors, problem = ask(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(vectors, pa.list_(pa.float64())), pa.array([problem] * part.num_rows, pa.string())], names=["k1", "k2", "vector", "problem"])

    asked = tables.write(missing.repartition(tasks, "k1", "k2").mapInArrow(run, f"{VECTORS}, problem string"), "vectors")
    new = asked.where("vector is not null").select("k1", "k2", "vector")
    if cache:
        new.write.mode("append").parquet(cache)
    have = new.union(known.join(texts.select("k1", "k2"), ["k1", "k2"], "left_semi")) if known is not None else new
    return have, asked.where("vector is null").select("k1", "k2", "problem")


def centroid(df: DataFrame, provider: Provider, cache: str | None = None, column: str = "text", **options) -> Centroid:
    """Mean of the provider's vectors over all rows that have a text, repeated ones each time. If it fails for any text there is no mean, for it would be that of others."""
    vectors, failures = cached_vectors(df, provider, cache, column, **options)
    failed = failures.limit(1).collect()
    if failed:
        return Centroid(None, failed[0].problem)
    counts = df.where(f"`{column}` is not null and `{column}` <> ''").groupBy(F.xxhash64(column).alias("k1"), F.xxhash64(F.lit(41), column).alias("k2")).agg(F.count("*").alias("n"))
    weighted = vectors.join(counts, ["k1", "k2"]).select("n", F.posexplode("vector").alias("pos", "x"))
    rows = weighted.groupBy("pos").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("value"), F.sum("n").alias("texts")).orderBy("pos").collect()  # as many as dimensions
    if not rows:
        return Centroid(None, "There are no texts.")
    if len({r.texts for r in rows}) > 1:
        return Centroid(None, "The vectors are of different lengths.")
    return Centroid([r.value for r in rows], None)
