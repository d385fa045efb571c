"""Helpers shared by the corpus operators: vectorised text scanning and shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space and 0x09 to 0x0D.
WORD_BREAKS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Bytes of text handled at once; a single longer text is handled alone.
CHUNK_BYTES = 1 << 18

#: Rows that go to Python, or are read from a file, at once.
BATCH_ROWS = 1000
#: Bytes of a row group where rows are long: a task that writes or reads such a table holds a whole one, in pieces of the heap and in buffers outside it.
ROW_GROUP = 4 << 20

IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[list(WORD_BREAKS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
_BYTE_CODE = _rng.integers(1, 2**64, size=256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 & ~0x7 | 0x5  # odd, so that it has an inverse
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.empty(size, dtype=np.uint64)
        have[0], k = 1, 1
        while k < size:
            np.multiply(have[:k], np.uint64(pow(base, k, 2**64)), out=have[k : 2 * k])
            k *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a uint64 over all of them."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Words(NamedTuple):
    """The words of some texts: text number, first byte, byte after the last, 64-bit hash."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, row after the last, bytes, offsets) of slices of about ``limit`` bytes; null counts as empty."""
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def rolling_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte codes times powers, from which the hash of any stretch of ``data`` follows."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end]; equal bytes give equal hashes wherever they stand."""
    n = len(sums)
    value = (sums[end] - sums[start]) * powers(_BASE_INVERSE, n)[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, sums: np.ndarray | None = None) -> Words:
    """Words of every text in ``data``; a word never crosses into the next text. sums: rolling_sums of the same bytes, if at hand."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, none.astype(np.uint64))
    blank = IS_BREAK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= blank[:-1]
    after = edge[1:].copy()
    after[:-1] |= blank[1:]
    start = np.flatnonzero(before & ~blank)
    end = np.flatnonzero(after & ~blank) + 1
    if sums is None:
        sums = rolling_sums(LOWER[data] if lower else data)
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(doc, start, end, stretch_hash(sums, start, end))


def word_windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of n words that lies in one text."""
    if len(words.doc) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(words.doc[: len(words.doc) - n + 1] == words.doc[n - 1 :])
    code = np.zeros(len(first), dtype=np.uint64)
    for k in range(n):
        code = mix(code * np.uint64(0x9FB21C651E98DF25) + words.code[first + k])
    return first, code


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session in one process gets a folder of its own, a cluster an error."""
    context = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.getCheckpointDir().isEmpty():
        folder = context.getCheckpointDir().get()
    if not folder:
        if not context.isLocal():
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    small_batches(spark)
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Lets Python have, and readers of files hold, at most ``BATCH_ROWS`` rows at once in this session, as texts may be long, unless the user has set
    another number than Spark's own."""
    for setting, usual in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"), ("spark.sql.parquet.columnarReaderBatchSize", "4096")):
        if spark.conf.get(setting) == usual:
            spark.conf.set(setting, str(BATCH_ROWS))


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile drops its shuffle files at its end, and doesn't leave them until the driver collects its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def _write(df: DataFrame, path: str, row_group: int | None = None) -> DataFrame:
    with _shuffles_dropped(df.sparkSession):
        (df.write if row_group is None else df.write.option("parquet.block.size", row_group)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a result once to the shared folder and reads it back, so that later steps don't make it again."""
    return _write(df, new_folder(df.sparkSession, name))


class Tables:
    """Tables that steps write to the shared folder and that go as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
        """row_group: bytes of a row group, Spark's own number if it isn't told."""
        path = new_folder(self.spark, name)
        self.paths.setdefault(name, []).append(path)
        return _write(df, path, row_group)

    def drop(self, *names: str) -> None:
        """Drops the tables of these names, or all of them."""
        for name in names or list(self.paths):
            for path in self.paths.pop(name, ()):
                drop_folder(self.spark, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def text_keys(text: str) -> tuple[Column, Column]:
    """k1 and k2, 128 bits that name a text; a null text is an empty one."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(41), whole).alias("k2")


def id_fold(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] for every i."""
    sums = np.zeros(len(values) + 1, dtype=np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
