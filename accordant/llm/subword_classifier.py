"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

Every hashed word, word pair and character n-gram has a learned vector; a document is the weighted mean of
its features' vectors, and a softmax over two classes reads it. Both are trained together by plain
stochastic gradient descent in numpy, on a bounded sample (``SAMPLE``) of labelled rows.

Averaging and the output layer are linear up to the softmax, so for scoring each vector is multiplied with the
output layer once, and a document's logit is the mean of its features' numbers: the same score for
one lookup a feature. Whole texts are scored in Arrow batches on the executors, without a shuffle.

Defined results: a null or empty text has the score of the bias alone; every input row gives one row, repeated
rows and ids included; other columns are ignored; without labels, or with labels of one kind only, the
score is the share of good labels (one half without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.labelled import labelled_sample
from accordant.llm.ngram_features import BITS, weighted_sums
from accordant.llm.shared import text_chunks

#: Labelled documents that are learned from, at most.
SAMPLE = 4000
WIDTH = 16
EPOCHS = 12
RATE = 40.0


@dataclass
class SubwordModel:
    """Vectors of the buckets, output layer, bias; ``logits`` has the vectors times the output layer."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def logits(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the logit of class 1 against class 0, and the bias."""
        direction = self.output[:, 1] - self.output[:, 0]
        return (self.vectors @ direction).astype(np.float32), float(self.bias[1] - self.bias[0])


def fit_subwords(rows: list[tuple[int, int, np.ndarray, np.ndarray]], width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> SubwordModel:
    """Stochastic gradient descent over single documents, with a rate that falls to zero."""
    rng = np.random.default_rng(seed)
    vectors = np.zeros((1 << BITS, width), np.float32)
    output = np.zeros((width, 2), np.float32)
    bias = np.zeros(2, np.float32)
    labels = np.array([r[1] for r in rows])
    if len(rows) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(rows) + 1)
        bias[1] = np.log(share / (1 - share))
        return SubwordModel(vectors, output, bias)
    vectors = rng.normal(0, 0.1, vectors.shape).astype(np.float32)
    output = rng.normal(0, 0.3, output.shape).astype(np.float32)
    class_weight = 0.5 / np.maximum(np.bincount(labels, minlength=2) / len(labels), 1e-9)
    class_weight = np.sqrt(class_weight)
    total, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            _, label, index, weight = rows[i]
            step = 1 - done / total
            done += 1
            hidden = weight @ vectors[index]
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            p *= class_weight[label]
            back = output @ p
            output -= (0.5 * step) * np.outer(hidden, p)
            bias -= (0.05 * step) * p
            vectors[index] -= np.outer((rate * step) * weight, back).astype(np.float32)
    return SubwordModel(vectors, output, bias)


def subword_scores(documents: DataFrame, training: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) of every document; learned from the labelled rows of ``training``. documents, training: doc_id, text; labels: doc_id, quality."""
    table, bias = fit_subwords(labelled_sample(training, labels, "quality", sample)).logits()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "doc_id"))
            for at, to, data, offsets in text_chunks(texts):
                z = np.clip(weighted_sums(table, data, offsets) + bias, -40, 40)
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(at, to - at), "score": pa.array(1 / (1 + np.exp(-z)))})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")
