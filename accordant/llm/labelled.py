"""A bounded sample of labelled documents as hashed n-gram features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.ngram_features import sparse_rows
from accordant.llm.shared import small_batches, text_chunks

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("bucket", pa.binary()), ("weight", pa.binary())])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids, labels = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "doc_id", "label"))
        for at, to, data, offsets in text_chunks(texts):
            rows = sparse_rows(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, to - at), labels.slice(at, to - at), pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([w.tobytes() for _, w in rows], pa.binary())],
                schema=_SCHEMA,
            )


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, bound: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """At most ``bound`` labelled documents: (doc_id, label 0/1, buckets, weights), in doc_id order.

    The labelled ids are taken in the order of a hash of the id, so the sample is the same for the same rows.
    An id labelled more than once counts once, with its largest label; of documents that share an id, one
    text counts. Rows with a null id or label are left out; a null text is an empty one.
    """
    small_batches(documents.sparkSession)
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = (
        texts.join(F.broadcast(chosen), "doc_id")  # at most `bound` rows of two numbers
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
        .mapInArrow(_featurise, "doc_id long, label int, bucket binary, weight binary")
        .collect()
    )
    found = [(r.doc_id, int(r.label > 0), np.frombuffer(r.bucket, np.int32), np.frombuffer(r.weight, np.float32)) for r in rows]
    return sorted(found, key=lambda row: row[0])
