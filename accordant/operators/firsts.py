"""The first values of columns, and exact order statistics, by states of a fixed size for each task.

``first_values`` keeps the k first entries of every field in one pass: a value that is among the k first of all is among the k first of its task, so
nothing else has to leave it. ``quantiles`` counts in two rounds or a few more: first in bins of the leading 16 bits of all numbers, then in those of the next 16
bits of the numbers that share a bin with a wanted rank, until a bin holds a single number. Neither sorts, shuffles or gathers the values themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows looked at between two checks of what can still be among the first.
STRIDE = 512
#: Bits that a round of counting tells apart, and columns that it counts at once.
BITS, COLUMNS = 16, 24


class _First:
    """The k least (place, value) of a field; with ``distinct`` each value once, at its least place. Rows without a place come before all others."""

    def __init__(self, k: int, distinct: bool):
        self.k, self.distinct = k, distinct
        self.kept: list[tuple[bool, object, str]] = []

    def add(self, places: pa.Array, values: pa.Array) -> None:
        wanted = pc.is_valid(values)
        if len(self.kept) == self.k:
            known, last = self.kept[-1][:2]
            early = pc.less_equal(places, pa.scalar(last, places.type)) if known else pa.array([False] * len(places))
            wanted = pc.and_(wanted, pc.or_(pc.is_null(places), pc.fill_null(early, False)))
        if not pc.any(wanted).as_py():
            return
        entries = [(p is not None, p, v) for p, v in zip(places.filter(wanted).to_pylist(), values.filter(wanted).to_pylist(), strict=True)]
        if self.distinct:
            least: dict[str, tuple] = {}
            for entry in [*self.kept, *entries]:
                if entry[2] not in least or _order(entry) < _order(least[entry[2]]):
                    least[entry[2]] = entry
            entries = list(least.values())
        else:
            entries = self.kept + entries
        self.kept = sorted(entries, key=_order)[: self.k]


def _order(entry: tuple[bool, object, str]) -> tuple:
    known, place, value = entry
    return (known, place, value.encode()) if known else (known, 0, value.encode())


def first_values(df: DataFrame, fields: Mapping[str, Column], k: int, place: Column | None = None, distinct: bool = True) -> DataFrame:
    """(field, rank, value): the k first values of each field, in the order of ``place`` and then of the value; null values are none.

    Without a place, rows stand in the order in which they are read. A task sends k rows a field at most.
    """
    names = list(fields)
    ordinal = F.monotonically_increasing_id() if place is None else place
    rows = df.select(ordinal.alias("place"), *[c.alias(f"v{i}") for i, c in enumerate(fields.values())])
    kind = rows.schema["place"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, places = [_First(k, distinct) for _ in names], pa.null()
        for batch in batches:
            places = batch.column(0).type
            for at in range(0, batch.num_rows, STRIDE):
                part = batch.slice(at, STRIDE)
                for i, first in enumerate(firsts):
                    first.add(part.column(0), part.column(i + 1))
        found = [(i, place, value) for i, first in enumerate(firsts) for _, place, value in first.kept]
        if found:
            columns = [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], places), pa.array([f[2] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "place", "value"])

    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("place", kind), T.StructField("value", T.StringType())])
    found = rows.where(F.greatest(*[F.col(f"v{i}").isNotNull() for i in range(len(names))], F.lit(False))).mapInArrow(run, schema)
    if distinct:
        found = found.groupBy("i", "value").agg(F.when(F.bool_or(F.col("place").isNull()), F.lit(None).cast(kind)).otherwise(F.min("place")).alias("place"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.asc_nulls_first("place"), "value"))
    field = F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(field.alias("field"), "rank", "value")


def _keys(values: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the numbers."""
    bits = (values + 0.0).view(np.int64)  # a negative zero is a zero
    return np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))


def _number(key: int) -> float:
    bits = np.int64(key)
    return float((bits if bits >= 0 else bits ^ np.int64(0x7FFFFFFFFFFFFFFF)).view(np.float64))


class _Bins:
    """Counts, least and largest key of the numbers with one prefix, by their next bits."""

    def __init__(self):
        size = 1 << BITS
        self.n, self.least, self.most = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)

    def add(self, keys: np.ndarray, shift: int) -> None:
        """keys: in order."""
        bins = (keys >> np.int64(shift)) & np.int64((1 << BITS) - 1) if shift + BITS < 64 else (keys >> np.int64(shift)) + np.int64(1 << (BITS - 1))
        starts = np.flatnonzero(np.concatenate([[True], np.diff(bins) != 0]))
        ends = np.append(starts[1:], len(keys))
        at = bins[starts]
        self.n[at] += ends - starts
        self.least[at] = np.minimum(self.least[at], keys[starts])
        self.most[at] = np.maximum(self.most[at], keys[ends - 1])


def _counted(numbers: DataFrame, prefixes: list[tuple[int, int]], level: int) -> DataFrame:
    """(i, prefix, bin, n, least, most) of the numbers of column i whose key begins with the prefix."""
    shift = 64 - BITS * (level + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = {p: _Bins() for p in prefixes}
        for batch in batches:
            sorted_keys: dict[int, np.ndarray] = {}
            for i, prefix in prefixes:
                if i not in sorted_keys:
                    sorted_keys[i] = np.sort(_keys(batch.column(i).drop_null().to_numpy(zero_copy_only=False).astype(np.float64)))
                keys = sorted_keys[i]
                if level:
                    keys = keys[np.searchsorted(keys >> np.int64(shift + BITS), prefix, "left") : np.searchsorted(keys >> np.int64(shift + BITS), prefix, "right")]
                if len(keys):
                    bins[i, prefix].add(keys, shift)
        for (i, prefix), b in bins.items():
            at = np.flatnonzero(b.n)
            columns = [pa.array(np.full(len(at), i, np.int32)), pa.array(np.full(len(at), prefix, np.int64)), pa.array(at.astype(np.int32)), pa.array(b.n[at]), pa.array(b.least[at]), pa.array(b.most[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "prefix", "bin", "n", "least", "most"])

    counted = numbers.mapInArrow(run, "i int, prefix long, bin int, n long, least long, most long")
    return counted.groupBy("i", "prefix", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def _ranked(numbers: DataFrame, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The number of column i that stands at a rank, for each (i, rank), ranks from 0."""
    spark = numbers.sparkSession
    found: dict[tuple[int, int], float] = {}
    open_: dict[tuple[int, int], tuple[int, int]] = {w: (0, w[1]) for w in wanted}  # prefix, and rank among the numbers that have it
    for level in range(64 // BITS):
        if not open_:
            break
        prefixes = sorted({(i, prefix) for (i, _), (prefix, _) in open_.items()})
        ranks = spark.createDataFrame([(i, rank, prefix, inner) for (i, rank), (prefix, inner) in open_.items()], "i int, rank long, prefix long, inner long")
        upto = F.sum("n").over(Window.partitionBy("i", "prefix").orderBy("bin"))  # 2**BITS rows at most
        bins = _counted(numbers, prefixes, level).withColumn("upto", upto)
        hit = bins.join(F.broadcast(ranks), ["i", "prefix"]).where((F.col("inner") < F.col("upto")) & (F.col("inner") >= F.col("upto") - F.col("n")))  # a few rows a column
        for r in hit.collect():
            own = (r.i, r["rank"])
            if r.least == r.most:
                found[own] = _number(r.least)
                del open_[own]
            else:
                prefix = r.bin - (1 << (BITS - 1)) if level == 0 else (r.prefix << BITS) | r.bin
                open_[own] = (prefix, r.inner - (r.upto - r.n))
    return found


def quantiles(df: DataFrame, columns: Mapping[str, Column], counts: Mapping[str, int], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of columns of doubles, with linear interpolation between neighbouring ranks; None where a column has no number.

    columns: by name; counts: how many numbers each has. Nulls are left aside.
    """
    names, out = list(columns), {}
    for at in range(0, len(names), COLUMNS):
        chosen = names[at : at + COLUMNS]
        numbers = df.select(*[columns[c].alias(f"x{i}") for i, c in enumerate(chosen)])
        wanted = {(i, r) for i, c in enumerate(chosen) if counts[c] for q in shares for r in (math.floor(q * (counts[c] - 1)), math.ceil(q * (counts[c] - 1)))}
        value = _ranked(numbers, sorted(wanted)) if wanted else {}
        for i, c in enumerate(chosen):
            out[c] = []
            for q in shares:
                place = q * (counts[c] - 1)
                low, high = math.floor(place), math.ceil(place)
                if not counts[c]:
                    out[c].append(None)
                elif low == high or value[i, low] == value[i, high]:
                    out[c].append(value[i, low])
                else:
                    out[c].append((high - place) * value[i, low] + (place - low) * value[i, high])
    return out
