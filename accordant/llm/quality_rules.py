"""Quality rules: counted base rules and a calibrated logistic regression over hashed word and character n-grams.

``quality_rules`` gives every document its counts, the verdict of the base rules and the probability that
it is of good quality. The regression is fitted on a bounded sample of labelled rows (``SAMPLE``), its
probability calibrated on a fifth of them that the fit has not seen, and compared with a fixed threshold.
All documents are counted and scored whole, in Arrow batches on the executors, without a shuffle.

Defined results: a null text is an empty one and fails the base rules; every input row gives one row,
repeated rows and ids included; other columns are ignored; without labels, or with labels of one kind
only, every probability is the share of good labels (one half without labels).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.labelled import labelled_sample
from accordant.llm.ngram_features import BITS, weighted_sums
from accordant.llm.shared import IS_BREAK, find_words, mix, rolling_sums, stretch_hash, text_chunks, word_windows

#: Labelled documents that the regression is fitted on, at most.
SAMPLE = 4000
#: A document is kept if its calibrated probability of good quality is at least this.
THRESHOLD = 0.5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True


@dataclass
class QualityModel:
    """A weight per bucket, and slope and offset that turn a sum of weights into the logit of a probability."""

    table: np.ndarray
    slope: float
    offset: float

    def probability(self, sums: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * sums + self.offset, -40, 40)))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with targets drawn a little from 0 and 1 so that they stay finite."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(x.std(), 1e-9)
    z = (x - x.mean()) / scale
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - target) * z).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return a / scale, b - a * x.mean() / scale


def fit_logistic(rows: list[tuple[int, int, np.ndarray, np.ndarray]], epochs: int = 20, rate: float = 400.0, seed: int = 5) -> QualityModel:
    """Stochastic gradient descent over single documents of four fifths of the rows; the rest calibrates."""
    labels = np.array([r[1] for r in rows], dtype=np.float64)
    if len(rows) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(rows) + 1)
        return QualityModel(np.zeros(1 << BITS, np.float32), 0.0, float(np.log(share / (1 - share))))
    held = np.array([zlib.crc32(str(r[0]).encode()) % 5 == 2 for r in rows])
    if len(set(labels[held])) < 2 or len(set(labels[~held])) < 2:
        held[:] = False
    fit = [r for r, h in zip(rows, held, strict=True) if not h]
    share = np.mean([r[1] for r in fit])
    weight_of = np.sqrt(0.5 / np.array([1 - share, share]))
    table, bias = np.zeros(1 << BITS, np.float32), 0.0
    rng, total, done = np.random.default_rng(seed), epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            _, label, index, weight = fit[i]
            z = float(table[index] @ weight) + bias
            step = (1 - done / total) * weight_of[label] * (1 / (1 + np.exp(-min(max(z, -40), 40))) - label)
            done += 1
            table[index] -= np.float32(rate * step) * weight
            bias -= 0.05 * step
    rest = [r for r, h in zip(rows, held, strict=True) if h or not held.any()]
    sums = np.array([float(table[r[2]] @ r[3]) for r in rest])
    return QualityModel(table, *_calibrate(sums, np.array([r[1] for r in rest], dtype=np.float64)))


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text."""
    n = len(offsets) - 1
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])
    if not len(data):
        return {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    sums = rolling_sums(data)
    words = find_words(data, offsets, sums=sums)
    inside = ~IS_BREAK[data]
    out = {"n_words": np.bincount(words.doc, minlength=n), "word_chars": count(inside & ((data & 0xC0) != 0x80)), "n_symbols": count(_IS_SYMBOL[data])}

    cut = data == 10
    starts = np.unique(np.concatenate([np.flatnonzero(cut) + 1, offsets[:-1]]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = np.where((ends > starts) & cut[np.maximum(ends - 1, 0)], ends - 1, ends)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    filled = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends, doc = starts[filled], ends[filled], doc[filled]
    key = mix(stretch_hash(sums, starts, ends) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.zeros(len(key), dtype=bool)
    first[np.unique(key, return_index=True)[1]] = True
    out["n_dup_lines"] = np.bincount(doc[~first], minlength=n)

    at, code = word_windows(words, WINDOW)
    code = mix(code + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(code)
    same = code[order][1:] == code[order][:-1]
    again = np.zeros(len(code), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(words.doc) + 1, dtype=np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    out["n_repeat_words"] = np.bincount(words.doc[covered], minlength=n)
    return out


def _scorer(model: QualityModel, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "doc_id"))
            for at, to, data, offsets in text_chunks(texts):
                counts = base_counts(data, offsets)
                good = model.probability(weighted_sums(model.table, data, offsets))
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
                columns = {"doc_id": ids.slice(at, to - at)} | {k: pa.array(v, pa.int64()) for k, v in counts.items()}
                columns |= {"base_failed": pa.array(failed), "quality_score": pa.array(good), "kept": pa.array(~failed & (good >= threshold))}
                yield pa.RecordBatch.from_pydict(columns)

    return score


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_score double, kept boolean"


def quality_rules(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, ``quality_score`` and ``kept``. documents: doc_id, text; labels: doc_id, quality."""
    model = fit_logistic(labelled_sample(documents, labels, "quality", sample))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(model, threshold), SCHEMA)


def without_rejected(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the rules keep, with all their columns, in one pass over the texts."""
    model = fit_logistic(labelled_sample(documents, labels, "quality", sample))
    text_at = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for _, _, data, offsets in text_chunks(batch.column(text_at)):
                counts = base_counts(data, offsets)
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
                kept.append(~failed & (model.probability(weighted_sums(model.table, data, offsets)) >= threshold))
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return documents.mapInArrow(keep, documents.schema)
