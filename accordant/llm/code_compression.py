"""Vector code compression: product codes whose codebooks Lloyd's rounds refine from running sums.

Vectors become integers once and are written as packed parts with their codes. A round reads that table, assigns every part and writes it with the new
codes, map-only; of the parts whose code is another than before, each task adds up what leaves the old entry and what comes to the new one, and lets its last
batch carry these sums. Only they are shuffled: 128 rows of a part's width at most from each task. The running sums and counts that they change give the next
codebooks, which are of a fixed size (8 x 16 x width), so the driver holds and sends no more than that.

Defined results: vectors that are null, hold a null, NaN or infinity, or are not as long as most of the table's are dropped; lengths that 8 doesn't divide are
filled up with zeros; a null vec_id comes after all others when the first entries are picked, and of rows that share an id the vector decides; with
fewer than 16 vectors a codebook has an entry for each. Null labels are a label of their own. Integers are held within +-2**26, which vectors of components
under 16384 never reach, so that sums fit 64 bits. An empty table gives no rows. Repeated rows each count. Other columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.shared import Tables, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 1 << 26

DELTA = "array<struct<part: int, entry: int, rows: long, sums: array<long>>>"
DELTA_TYPE = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("rows", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows of a column of equally long binaries."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def _binaries(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    size = rows.dtype.itemsize * rows.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def nearest(parts: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry, the lower one of ties, and the squared distance, for parts (rows, PARTS, width) and codebooks (PARTS, entries, width)."""
    codes, errors = np.empty(parts.shape[:2], dtype=np.uint8), np.empty(parts.shape[:2], dtype=np.int64)
    for p in range(PARTS):
        far = np.stack([((parts[:, p] - entry) ** 2).sum(axis=1) for entry in codebooks[p]], axis=1)
        codes[:, p] = far.argmin(axis=1)
        errors[:, p] = far[np.arange(len(far)), codes[:, p]]
    return codes, errors


class _Deltas:
    """What parts that change their code take from the old entry's sum and count and add to the new one's."""

    def __init__(self, entries: int, width: int):
        self.sums, self.rows = np.zeros((PARTS, entries, width), dtype=np.int64), np.zeros((PARTS, entries), dtype=np.int64)

    def add(self, parts: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> None:
        for p in range(PARTS):
            changed = slice(None) if before is None else before[:, p] != after[:, p]
            moved = parts[changed, p]
            for codes, sign in ((after, 1), (before, -1)):
                if codes is not None:
                    np.add.at(self.sums[p], codes[changed, p], sign * moved)
                    self.rows[p] += sign * np.bincount(codes[changed, p], minlength=self.rows.shape[1])

    def packed(self) -> list[dict]:
        told = (self.rows != 0) | (self.sums != 0).any(axis=2)
        return [{"part": p, "entry": e, "rows": int(self.rows[p, e]), "sums": self.sums[p, e].tolist()} for p, e in np.argwhere(told).tolist()]


def _integers(vectors: DataFrame, id_column: str, vector: str, label: str, tables: Tables) -> tuple[DataFrame, int]:
    """(vec_id, label, parts) of the vectors that are kept, and the width of a part."""
    finite = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size(vector) > 0)
    kept = vectors.where(finite).select(F.col(id_column).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    most = kept.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = most.length if most else PARTS
    width = -(-length // PARTS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
            whole = np.zeros((len(values), PARTS * width), dtype=np.int32)
            whole[:, :length] = np.clip(np.floor(values * SCALE), -LARGEST, LARGEST)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binaries(whole)], names=["vec_id", "label", "parts"])

    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    packed = kept.where(F.size("vector") == length).mapInArrow(pack, f"vec_id {types['vec_id']}, label {types['label']}, parts binary")
    return tables.write(packed, "code-vectors"), width


def _assigned(state: DataFrame, codebooks: np.ndarray, width: int) -> DataFrame:
    """The rows with their new codes and errors; the last batch of a task has the task's deltas in its first row."""
    first, entries = "code" not in state.columns, codebooks.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deltas, held = _Deltas(entries, width), None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = _matrix(batch.column(2), np.int32, PARTS * width).reshape(-1, PARTS, width).astype(np.int64)
            codes, errors = nearest(parts, codebooks)
            deltas.add(parts, None if first else _matrix(batch.column(3), np.uint8, PARTS), codes)
            if held is not None:
                yield told(held, [])
            held = [batch.column(0), batch.column(1), batch.column(2), _binaries(codes), pa.array(errors.sum(axis=1))]
        if held is not None:
            yield told(held, deltas.packed())

    def told(columns: list, delta: list) -> pa.RecordBatch:
        carried = pa.array([delta or None] + [None] * (len(columns[0]) - 1), DELTA_TYPE)
        return pa.RecordBatch.from_arrays([*columns, carried], names=["vec_id", "label", "parts", "code", "error", "delta"])

    types = {f.name: f.dataType.simpleString() for f in state.schema}
    before = state.select("vec_id", "label", "parts", *([] if first else ["code"]))
    return before.mapInArrow(assign, f"vec_id {types['vec_id']}, label {types['label']}, parts binary, code binary, error long, delta {DELTA}")


def codebook_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code: 8 bytes, error) of every kept vector, and the codebooks (parts, entries, width)."""
    spark = vectors.sparkSession
    tables = Tables(spark)
    state, width = _integers(vectors, id_column, vector, label, tables)
    seeds = state.orderBy(F.asc_nulls_last("vec_id"), "parts").limit(ENTRIES).collect()
    codebooks = np.stack([np.frombuffer(r.parts, dtype=np.int32).reshape(PARTS, width) for r in seeds], axis=1).astype(np.int64) if seeds else np.zeros((PARTS, 0, width), dtype=np.int64)
    if not seeds:
        return state.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), codebooks
    sums, rows = np.zeros_like(codebooks), np.zeros(codebooks.shape[:2], dtype=np.int64)
    for k in range(rounds):
        state = tables.write(_assigned(state, codebooks, width), f"code-round-{k}")
        tables.drop(f"code-round-{k - 1}" if k else "code-vectors")
        delta = state.where("delta is not null").select(F.explode("delta").alias("d")).groupBy("d.part", "d.entry")
        for r in delta.agg(F.sum("d.rows").alias("rows"), F.array(*(F.sum(F.col("d.sums")[i]) for i in range(width))).alias("sums")).collect():  # parts x entries at most
            sums[r.part, r.entry] += np.array(r.sums, dtype=np.int64)
            rows[r.part, r.entry] += r.rows
        used = rows > 0
        codebooks = codebooks.copy()
        codebooks[used] = sums[used] // rows[used][:, None]
    out = written(_assigned(state, codebooks, width).select("vec_id", "label", "code", "error"), "codes")
    tables.drop()
    return out, codebooks


def code_digests(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): codes as hex digits, and the errors of each label added up."""
    codes, codebooks = compress(vectors)
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    joined = codes.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebook_digest(codebooks)).alias("codebooks_sha256"))


def oracle_sql(rounds: int = ROUNDS) -> str:
    """The rounds on whole tables, a relation of parts and one of entries each."""
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT vec_id, label, p.part, list_slice(v, p.part * (len(v) // 8) + 1, (p.part + 1) * (len(v) // 8)) AS v FROM kept, (SELECT unnest(range(8)) AS part) p)",
        "seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 16)",
        "book0 AS MATERIALIZED (SELECT part, entry, v FROM parts JOIN seeds USING (vec_id))",
    ]
    far = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))::BIGINT"
    for k in range(rounds + 1):
        steps.append(f"met{k} AS MATERIALIZED (SELECT a.vec_id, a.label, a.part, a.v, b.entry, {far} AS far FROM parts a JOIN book{k} b ON a.part = b.part)")
        steps.append(f"near{k} AS MATERIALIZED (SELECT vec_id, label, part, v, entry, far FROM met{k} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY far, entry) = 1)")
        if k < rounds:
            steps.append(f"means{k} AS (SELECT part, entry, list(mean ORDER BY i) AS v FROM (SELECT part, entry, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS mean FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM near{k}) GROUP BY part, entry, i) GROUP BY part, entry)")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m ON b.part = m.part AND b.entry = m.entry)")
    steps.append(f"codes AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM near{rounds} GROUP BY vec_id, label)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM codes, digest"
