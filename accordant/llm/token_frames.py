"""Token ids in files of independent zstandard frames with a trailing seek table and a checksum for each frame.

A file holds documents in ascending doc_id order. Each frame is a zstandard frame of its own with some whole documents:
``n`` (uint32), their ids (int64 x n), their token counts (uint32 x n), then all token ids, two bytes each if
the header byte before says 2, else four; all little-endian. After the data come two skippable frames, which
zstandard readers pass over: an index with first and last doc_id and document count of every frame, and the seek table
of the public seekable format (compressed size, size, low 32 bits of the content's XXH64 for every frame, then
frame count, flags and magic number). A reader fetches the tail of a file, then only the frames it needs.

Documents are dealt to files by ranges of doc_id before they are encoded, so token ids are never shuffled, and a task
holds one frame at a time. A task writes under a name of its own and renames at the end, and only files that
a finished task reported are read, so a lost executor leaves nothing behind that counts.

Defined results: a null text is an empty one, a document of the end id alone; rows with the same doc_id are all
kept, in any order; a null doc_id comes first and is stored as the least int64; other columns are ignored; an empty table
makes no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.llm.shared import new_folder, written
from accordant.llm.tokens import encode_slices, encoder

#: Fixed values of the public seekable format: skippable frame magic numbers, seek table magic, checksum flag.
INDEX_MAGIC = 0x184D2A50
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

#: A frame is closed when its documents reach this many tokens.
FRAME_TOKENS = 1 << 16
NULL_ID = -(2**63)


class Frame(NamedTuple):
    at: int
    packed: int
    size: int
    checksum: int
    first_id: int
    last_id: int
    documents: int


def pack_documents(ids: list[int], tokens: list[np.ndarray]) -> bytes:
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)
    narrow = not len(flat) or int(flat.max()) < 1 << 16
    return b"".join(
        [
            struct.pack("<BI", 2 if narrow else 4, len(ids)),
            np.array(ids, "<i8").tobytes(),
            np.array([len(t) for t in tokens], "<u4").tobytes(),
            flat.astype("<u2" if narrow else "<u4").tobytes(),
        ]
    )


def unpack_documents(content: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    width, n = struct.unpack_from("<BI", content)
    ids = np.frombuffer(content, "<i8", n, 5)
    counts = np.frombuffer(content, "<u4", n, 5 + 8 * n)
    flat = np.frombuffer(content, f"<u{width}", -1, 5 + 12 * n).astype(np.uint32)
    edges = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    return ids, [flat[edges[i] : edges[i + 1]] for i in range(n)]


class FrameWriter:
    """Writes documents, added in order, to an open binary file."""

    def __init__(self, out, level: int = 3):
        self.out, self.packer = out, zstandard.ZstdCompressor(level=level)
        self.frames: list[Frame] = []
        self.ids: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.waiting = self.at = 0

    def add(self, doc_id: int, tokens: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.tokens.append(tokens)
        self.waiting += len(tokens)
        if self.waiting >= FRAME_TOKENS:
            self._flush()

    def _flush(self) -> None:
        if self.ids:
            content = pack_documents(self.ids, self.tokens)
            packed = self.packer.compress(content)
            self.out.write(packed)
            self.frames.append(Frame(self.at, len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF, self.ids[0], self.ids[-1], len(self.ids)))
            self.at += len(packed)
            self.ids, self.tokens, self.waiting = [], [], 0

    def finish(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<qqI", f.first_id, f.last_id, f.documents) for f in self.frames)
        seek = b"".join(struct.pack("<III", f.packed, f.size, f.checksum) for f in self.frames) + struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index + struct.pack("<II", SEEK_TABLE_MAGIC, len(seek)) + seek)


class FrameReader:
    """Reads frames of a file through its seek table."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        count, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        tail = self._read(size - 9 - 12 * count - 8 - 20 * count, 32 * count + 8)
        at, self.frames = 0, []
        for i in range(count):
            first, last, documents = struct.unpack_from("<qqI", tail, 20 * i)
            packed, full, checksum = struct.unpack_from("<III", tail, 20 * count + 8 + 12 * i)
            self.frames.append(Frame(at, packed, full, checksum, first, last, documents))
            at += packed

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, i: int) -> tuple[np.ndarray, list[np.ndarray]]:
        f = self.frames[i]
        content = zstandard.ZstdDecompressor().decompress(self._read(f.at, f.packed), max_output_size=f.size)
        if len(content) != f.size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != f.checksum:
            raise ValueError(f"frame {i} does not have the content that was written")
        return unpack_documents(content)

    def documents(self, wanted: set[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The wanted documents; only frames whose range holds one of them are decompressed."""
        order = np.array(sorted(wanted), dtype=np.int64)
        for i, f in enumerate(self.frames):
            if np.searchsorted(order, f.first_id) < np.searchsorted(order, f.last_id, side="right"):
                for doc_id, tokens in zip(*self.frame(i), strict=True):
                    if int(doc_id) in wanted:
                        yield int(doc_id), tokens


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _file_writer(folder: str, tokenizer: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        system, root = _open(folder)
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.zst"
        documents = tokens = 0
        writer = None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for at, to in encode_slices(batch.column("text")):
                rows = batch.slice(at, to - at)
                if writer is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(name + ".open")
                    writer = FrameWriter(out)
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), encoder(tokenizer).encode(rows.column("text")), strict=True):
                    writer.add(NULL_ID if doc_id is None else doc_id, np.concatenate([ids, end]))
                    documents += 1
                    tokens += len(ids) + 1
        encoder(tokenizer).forget()
        if writer is not None:
            writer.finish()
            out.close()
            system.move(name + ".open", name)
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{name.rpartition('/')[2]}"], "documents": [documents], "tokens": [tokens]})

    return write


def write_token_files(documents: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the files into ``folder`` and returns (part, path, documents, tokens), a row for each; parts ascend with doc_id."""
    spark = documents.sparkSession
    folder = folder or new_folder(spark, "token-files")
    dealt = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(dealt.mapInArrow(_file_writer(folder, tokenizer, end_id), "part long, path string, documents long, tokens long"), "token-files-made")


def _read_files(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            system, name = _open(path)
            with system.open_input_file(name) as file:
                reader = FrameReader(file)
                for i in range(len(reader.frames)):
                    doc_ids, tokens = reader.frame(i)
                    counts = np.array([len(t) for t in tokens], dtype=np.int64)
                    starts = start + np.cumsum(counts) - counts
                    start += int(counts.sum())
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(doc_ids, mask=doc_ids == NULL_ID),
                            "start": pa.array(starts),
                            "n_tokens": pa.array(counts),
                        }
                        | (
                            {"ids_crc32": pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in tokens], pa.int64())}
                            if digest
                            else {"tokens": pa.array([t.astype("<u4").tobytes() for t in tokens], pa.binary())}
                        )
                    )


def read_token_files(spark: SparkSession, files: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of every document in the files; start counts the ids of all documents before it,
    tokens has little-endian uint32 ids; with ``digest`` their crc32 stands in their place, as ids_crc32.
    files: what write_token_files returned, a row a file, of which there are as many as tasks."""
    rows, start = [], 0
    for r in files.orderBy("part").collect():
        rows.append((r.path, start))
        start += r.tokens
    listed = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return listed.mapInArrow(lambda batches: _read_files(batches, digest), "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "tokens binary"))


def token_digests(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes and reads the files; (doc_id, start, n_tokens, ids_crc32) of every document as read."""
    return read_token_files(documents.sparkSession, write_token_files(documents, tokenizer, end_id), digest=True)
