"""Best-fit packing by patterns: repeat counts by non-negative least squares, residuals packed best-fit.

Documents become token ids with an end id; longer ones are cut into full pieces, the first of which may be
shorter. Full pieces fill a sequence each. For the others only the histogram of lengths (``capacity - 1`` numbers)
goes to the driver. There all patterns of two or three present lengths that fill a sequence exactly are
listed, repeat counts are fitted to the histogram by projected accelerated gradient steps, rounded within what the
histogram has, and what is left is packed best-fit in descending order, pattern by pattern, each repeated as
often as its lengths allow; so the plan is bounded by the number of lengths, not of documents.

On the executors a piece of a length gets its rank among those of that length (counted per bucket of a hash first,
so that no task holds a whole length), and the plan says which sequence and offset the rank has.

Defined results: a null or empty text is the end id alone; every input row gives its own pieces; rows that share a doc_id are
packed each by itself; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.llm.shared import written
from accordant.llm.tokens import encode_slices, encoder

CAPACITY = 1024
#: Pieces of one length that a task ranks, about.
RANKED_AT_ONCE = 200_000
#: Sequences of one full piece are numbered from here.
FULL_FROM = 1 << 62


def exact_patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths, the last 0 for pairs, that add up to the capacity and are all present."""
    has = np.zeros(capacity + 1, dtype=bool)
    has[present] = True
    a, b = np.meshgrid(present, present, indexing="ij")
    a, b = a[a >= b], b[a >= b]
    c = capacity - a - b
    triple = (c >= 0) & (c <= b)
    a, b, c = a[triple], b[triple], c[triple]
    fits = (c == 0) | has[c]
    return np.stack([a[fits], b[fits], c[fits]], axis=1)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative repeat counts with which the patterns give the histogram in the least-squares sense."""
    n, lengths = len(histogram), patterns.T
    used = patterns > 0

    def apply(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(lengths[k], x * used[:, k], n) for k in range(3))

    def back(y: np.ndarray) -> np.ndarray:
        return sum(y[lengths[k]] * used[:, k] for k in range(3))

    v = np.ones(len(patterns))
    for _ in range(12):
        v = back(apply(v))
        norm = np.linalg.norm(v)
        v /= norm
    rate = 1.0 / (1.05 * norm)
    x = z = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, z - rate * back(apply(z) - histogram))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_packing(histogram: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[([(length, how many of it), ...], repeats), ...] that uses up the histogram; histogram[i] counts pieces of length i."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[list[tuple[int, int]], int]] = []

    def take(pattern: list[tuple[int, int]], repeats: int) -> None:
        for length, many in pattern:
            left[length] -= many * repeats
        plan.append((pattern, repeats))

    patterns = exact_patterns(np.flatnonzero(left[1:capacity]) + 1, capacity)
    if len(patterns):
        repeats = fit_repeats(patterns, left[: capacity + 1].astype(np.float64))
        for i in np.argsort(-repeats, kind="stable"):
            if repeats[i] < 0.5:
                break
            lengths, many = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
            fits = min(int(round(repeats[i])), int((left[lengths] // many).min()))
            if fits > 0:
                take([(int(x), int(m)) for x, m in zip(lengths, many, strict=True)], fits)
    while left.any():
        pattern, room = [], capacity
        while room:
            fitting = np.flatnonzero(left[: room + 1])
            fitting = fitting[~np.isin(fitting, [x for x, _ in pattern])]
            if not len(fitting):
                break
            length = int(fitting[-1])
            many = int(min(left[length], room // length))
            pattern.append((length, many))
            room -= length * many
        take(pattern, int(min(left[x] // m for x, m in pattern)))
    return plan


def plan_rows(plan: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, lowest rank, rank after the highest, sequence of the lowest rank, offset) for every slot of every pattern."""
    rows, sequence, ranks = [], 0, {}
    for pattern, repeats in plan:
        offset = 0
        for length, many in pattern:
            for _ in range(many):
                low = ranks.get(length, 0)
                rows.append((length, low, low + repeats, sequence, offset))
                ranks[length] = low + repeats
                offset += length
        sequence += repeats
    return rows


def slot_blocks(slots: list[tuple[int, int, int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int, int, int]]]:
    """(widths, rows): ranks of a length are cut into blocks of its width, about as many as it has slots; a slot has a row for each block that it reaches into, so that
    a rank finds its slot among about two."""
    ranks: dict[int, int] = {}
    many: dict[int, int] = {}
    for length, _, high, _, _ in slots:
        ranks[length] = max(ranks.get(length, 0), high)
        many[length] = many.get(length, 0) + 1
    width = {length: max(1, ranks[length] // many[length]) for length in ranks}
    return list(width.items()), [(s[0], block, *s[1:]) for s in slots for block in range(s[1] // width[s[0]], (s[2] - 1) // width[s[0]] + 1)]


def _pieces(tokenizer: str, end_id: int, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for at, to in encode_slices(batch.column("text")):
                rows = batch.slice(at, to - at)
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), encoder(tokenizer).encode(rows.column("text")), strict=True):
                    ids = np.concatenate([ids, end]).astype("<u4")
                    edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
                        for column, value in zip(out, (doc_id, k, low, high - low, zlib.crc32(ids[low:high].tobytes())), strict=True):
                            column.append(value)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder(tokenizer).forget()

    return run


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece. documents: doc_id, text."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = written(
        texts.mapInArrow(_pieces(tokenizer, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long").withColumn("row", F.monotonically_increasing_id()),
        "pieces",
    )
    counted = pieces.where(F.col("length") < capacity).groupBy("length").count().collect()  # at most capacity - 1 rows
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in counted:
        histogram[r["length"]] = r["count"]
    widths, rows = slot_blocks(plan_rows(plan_packing(histogram, capacity)))
    width_of = spark.createDataFrame(widths, "length long, width long")  # at most capacity - 1 rows
    slots = spark.createDataFrame(rows, "length long, block long, low long, high long, first_sequence long, offset long")

    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.lit(FULL_FROM) + F.col("row"), "offset": F.lit(0).cast("long")})
    buckets = 1 + int(histogram.max()) // RANKED_AT_ONCE
    partial = pieces.where(F.col("length") < capacity).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    before = partial.groupBy("length", "bucket").count()
    running = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("before", F.coalesce(F.sum("count").over(running), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    ranked = partial.withColumn("own", rank).join(before, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before"))
    ranked = ranked.join(F.broadcast(width_of), "length").withColumn("block", F.floor(F.col("rank") / F.col("width")))
    placed = ranked.join(F.broadcast(slots), ["length", "block"]).where("rank >= low and rank < high")  # slots: bounded by capacity squared
    placed = placed.withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("low"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.select(columns).union(placed.select(columns))
