"""Merkle manifest of a data set: a leaf for each row, a tree for each source, a tree over the sources, and proofs that are folded and compared.

A source's leaves are laid out by range and numbered by counts of the parts before, so no task holds a source. Runs of 4096 leaves, which start at a
multiple of 4096, are whole subtrees: executors fold them with ordered string_agg and sha256 in DuckDB, over Arrow blocks that hold some of these
buckets each. Spark folds the roots of the buckets, sixteen to one, up to the root of all, and takes the siblings down again, from a node to its
children, a join of unique keys a level. The siblings above a bucket go to its second DuckDB query as one row, not one for each leaf.

Defined results: a null of any column is ``-`` in the leaf, a null source is the first source, a null id is the first id of its source; rows that share an
id are ordered by their leaf, equal rows stand side by side and each has its own proof; a row with a null claimed leaf is checked as it is;
an empty table gives no rows. Other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.llm.shared import Tables, written

FANOUT = 16
#: Levels that DuckDB folds within a bucket, and the leaves of a bucket.
BUCKET_LEVELS = 3
BUCKET = FANOUT**BUCKET_LEVELS
#: Rows that one DuckDB query takes unless a bucket and its header have more, and its memory.
BLOCK_ROWS = BUCKET
MEMORY = "256MB"
HEX = 64
#: Bits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = (1 << 33) - 1

ROOTS = "sid long, bucket long, n long, node string"
STEP = "struct<before: string, after: string>"
FOLDED = f"id {{id}}, leaf string, subroot string, proof_sha256 string, folded_root string, proof array<{STEP}>"


def leaf_of(columns: Sequence[Column]) -> Column:
    """sha256 of every column: ``-`` for a null, else the number of its bytes in UTF-8, a colon and the value as text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _lay_out(df: DataFrame, keys: Sequence[str], tables: Tables, name: str) -> DataFrame:
    """Writes the rows in the order of ``keys``, with the number of their part and their place in it."""
    order = [F.col(k).asc_nulls_first() for k in keys]
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return tables.write(laid.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)).alias("row")), name)


def _offsets(laid: DataFrame, group: Sequence[str]) -> DataFrame:
    """For each part and group: shift, which added to a row's place gives its number in the group, and n, the group's rows. A group has a row for each part at most."""
    parts = laid.groupBy("part", *group).agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select("part", *group, (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Some whole buckets at a time, from rows in the order of their buckets."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < BLOCK_ROWS:
            continue
        rows = pa.Table.from_batches(held)
        keys = [rows.column(c).to_numpy() for c in ("sid", "bucket")]
        ends = (np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1).tolist()  # the last bucket may go on
        at = 0
        while ends and ends[-1] > at:
            to = max([e for e in ends if at < e <= at + BLOCK_ROWS], default=next((e for e in ends if e > at), at))
            yield rows.slice(at, to - at)
            at = to
        held = rows.slice(at).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _levels() -> str:
    """SQL of the runs of each level within buckets: run1 holds the leaves sixteen by sixteen, run2 the digests of run1, and so on. A source with one node left keeps it."""
    out = []
    for k in range(BUCKET_LEVELS):
        out.append(f"run{k + 1} AS (SELECT sid, bucket, n, pos // {FANOUT} AS place, string_agg(node, '' ORDER BY pos) AS run FROM node{k} GROUP BY sid, bucket, n, pos // {FANOUT})")
        out.append(f"node{k + 1} AS (SELECT sid, bucket, n, place AS pos, CASE WHEN n > {FANOUT**k} THEN sha256(run) ELSE run END AS node FROM run{k + 1})")
    return ", ".join(out)


def _engine() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY})


def _bucket_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sql = f"WITH node0 AS (SELECT sid, bucket, n, pos, leaf AS node FROM block), {_levels()} SELECT sid, bucket, n, node FROM node{BUCKET_LEVELS}"
    with _engine() as engine:
        for block in _blocks(batches):
            engine.register("block", block)
            yield from engine.sql(sql).to_arrow_table().to_batches()


def _proof_sql(depth: int, kept: bool) -> str:
    """Proof and folded root of every leaf of a block, whose headers hold the siblings above the buckets, at most ``depth`` levels."""
    joins, befores, afters = [], [], []
    for k in range(BUCKET_LEVELS):
        own = f"{HEX} * (l.pos // {FANOUT**k} % {FANOUT})"
        joins.append(f"JOIN run{k + 1} r{k} ON r{k}.sid = l.sid AND r{k}.place = l.pos // {FANOUT ** (k + 1)}")
        befores.append(f"substring(r{k}.run, 1, {own})")
        afters.append(f"substring(r{k}.run, {own} + {HEX + 1})")
    columns = ", ".join(f"{b} AS b{k}, {a} AS a{k}" for k, (b, a) in enumerate(zip(befores, afters, strict=True)))
    text, steps = " || ".join(f"b{k} || a{k}" for k in range(BUCKET_LEVELS)), ", ".join(f"{{'before': b{k}, 'after': a{k}}}" for k in range(BUCKET_LEVELS))
    folds = []
    for k in range(BUCKET_LEVELS):
        folds.append(f"f{k + 1} AS (SELECT * REPLACE (CASE WHEN n > {FANOUT**k} THEN sha256(b{k} || x || a{k}) ELSE x END AS x) FROM f{k})")
    for k in range(depth):
        at = BUCKET_LEVELS + k
        folds.append(f"f{at + 1} AS (SELECT * REPLACE (CASE WHEN len(path) > {k} THEN sha256(path[{k + 1}].before || x || path[{k + 1}].after) ELSE x END AS x) FROM f{at})")
    proof = f"list_concat([{steps}], path)" if kept else "NULL"
    return (
        f"WITH node0 AS (SELECT sid, bucket, n, pos, leaf AS node FROM block WHERE pos >= 0), {_levels()}, "
        "head AS (SELECT sid, bucket, subroot, path, array_to_string(list_transform(path, lambda s: s.before || s.after), '') AS above FROM block WHERE pos < 0), "
        f"f0 AS (SELECT l.id, l.leaf, l.n, coalesce(l.claimed, l.leaf) AS x, h.subroot, h.path, h.above, {columns} FROM block l {' '.join(joins)} JOIN head h ON h.sid = l.sid AND h.bucket = l.bucket WHERE l.pos >= 0), "
        f"{', '.join(folds)} SELECT id, leaf, subroot, sha256({text} || above) AS proof_sha256, x AS folded_root, {proof} AS proof FROM f{BUCKET_LEVELS + depth}"
    )


def _climb(nodes: DataFrame, most: int, tables: Tables, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """From nodes (g, pos, node, m), m the group's nodes and ``most`` the largest m: tops[k], the last nodes of groups that have k levels, and runs[k], sixteen nodes each."""
    tops, runs = [nodes.where("m = 1").select("g", "node")], []
    while most > 1:
        run = F.expr(f"pos div {FANOUT}")
        together = nodes.where("m > 1").groupBy("g", "m", run.alias("at")).agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("members"))
        runs.append(tables.write(together.select("g", "at", F.col("members.node").alias("members"), F.ceil(F.col("m") / FANOUT).cast("long").alias("m")), f"{name}-{len(runs)}"))
        nodes = runs[-1].select("g", F.col("at").alias("pos"), F.sha2(F.array_join("members", ""), 256).alias("node"), "m")
        tops.append(nodes.where("m = 1").select("g", "node"))
        most = -(-most // FANOUT)
    return tops, runs


def _descend(tops: list[DataFrame], runs: list[DataFrame]) -> DataFrame:
    """From tops (g, subroot, path), path being what stands above a group, to (g, pos, subroot, path) of the nodes that ``runs[0]`` groups."""
    lone = [t.select("g", F.lit(0).cast("long").alias("pos"), "subroot", "path") for t in tops]
    here = lone[-1]
    for k in reversed(range(len(runs))):
        parents = here.withColumnRenamed("pos", "at")
        children = runs[k].join(parents, ["g", "at"]).select("g", "at", "subroot", "path", "members", F.posexplode("members").alias("i", "node"))
        step = F.struct(F.array_join(F.slice("members", F.lit(1), F.col("i")), "").alias("before"), F.array_join(F.slice("members", F.col("i") + 2, F.lit(FANOUT)), "").alias("after"))
        here = children.select("g", (F.col("at") * FANOUT + F.col("i")).alias("pos"), "subroot", F.concat(F.array(step), "path").alias("path")).union(lone[k])
    return here


def merkle_manifest(rows: DataFrame, id_column: str, group: str, columns: Sequence[str], claimed: dict[str, Column] | None = None, where: Column | None = None, proofs: bool = False) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; with ``proofs`` the siblings before and after it at each level too.

    claimed: what is said to stand in some columns; where ``where`` holds, the leaf of these values is folded with the row's true siblings.
    """
    spark = rows.sparkSession
    tables = Tables(spark)
    told = claimed or {}
    other = F.when(F.lit(False) if where is None and not told else F.lit(True) if where is None else where, leaf_of([told.get(c, F.col(c)) for c in columns]))
    leaves = tables.write(rows.select(F.col(id_column).alias("id"), F.col(group).alias("grp"), leaf_of([F.col(c) for c in columns]).alias("leaf"), other.alias("claimed")), "merkle-leaves")
    laid = _lay_out(leaves, ("grp", "id", "leaf"), tables, "merkle-laid")
    tables.drop("merkle-leaves")

    parts = tables.write(_offsets(laid, ["grp"]), "merkle-parts")
    sources = _lay_out(parts.groupBy("grp").agg(F.max("n").alias("n")), ("grp",), tables, "merkle-sources")
    numbers = tables.write(sources.join(_offsets(sources, []).withColumnRenamed("n", "all"), "part").select("grp", F.col("n").alias("leaves"), (F.col("row") + F.col("shift")).alias("sid")), "merkle-numbers")
    n_sources, most = numbers.agg(F.count("*"), F.max("leaves")).first()
    places = parts.join(numbers, parts.grp.eqNullSafe(numbers.grp)).select(F.col("part").alias("in_part"), parts.grp.alias("in_grp"), "shift", "n", "sid")
    places = tables.write(places, "merkle-places")
    pos = F.col("row") + F.col("shift")
    placed = laid.join(places, (F.col("part") == F.col("in_part")) & F.col("grp").eqNullSafe(F.col("in_grp"))).select("sid", F.expr(f"(row + shift) div {BUCKET}").alias("bucket"), "n", pos.alias("pos"), "id", "leaf", "claimed")

    roots = placed.select("sid", "bucket", "n", "pos", "leaf").repartition("sid", "bucket").sortWithinPartitions("sid", "bucket", "pos").mapInArrow(_bucket_roots, ROOTS)
    roots = tables.write(roots, "merkle-roots")
    buckets = roots.select(F.col("sid").alias("g"), F.col("bucket").alias("pos"), "node", F.ceil(F.col("n") / BUCKET).cast("long").alias("m"))
    tops, runs = _climb(buckets, -(-(most or 0) // BUCKET), tables, "merkle-runs")
    subroots = tables.write(_union(tops), "merkle-subroots")
    all_tops, all_runs = _climb(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), "node", F.lit(n_sources).cast("long").alias("m")), n_sources, tables, "merkle-top")
    root = all_tops[-1].first() if n_sources else None

    nothing = F.array().cast(f"array<{STEP}>")
    above = tables.write(_descend([t.select("g", F.lit("").alias("subroot"), nothing.alias("path")) for t in all_tops], all_runs).select(F.col("pos").alias("g"), "path"), "merkle-above")
    starts = [t.join(above, "g").select("g", F.col("node").alias("subroot"), "path") for t in tops]
    heads = _descend(starts, runs).select(F.col("g").alias("sid"), F.col("pos").alias("bucket"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast(placed.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("leaf"), F.lit(None).cast("string").alias("claimed"), "subroot", "path")
    heads = tables.write(heads, "merkle-heads")
    depth = heads.agg(F.max(F.size("path"))).first()[0] or 0

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _engine() as engine:
            for block in _blocks(batches):
                engine.register("block", block)
                yield from engine.sql(_proof_sql(depth, proofs)).to_arrow_table().to_batches()

    whole = placed.select("*", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast(f"array<{STEP}>").alias("path")).union(heads)
    folded = whole.repartition("sid", "bucket").sortWithinPartitions("sid", "bucket", "pos").mapInArrow(prove, FOLDED.format(id=placed.schema["id"].dataType.simpleString()))
    whole_root = F.lit(root.node if root else None).cast("string")
    out = folded.select(F.col("id").alias(id_column), "leaf", "subroot", whole_root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole_root).alias("verified"), *(["proof"] if proofs else []))
    out = written(out, "merkle-proofs")
    tables.drop()
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def oracle_sql(levels: int = 6) -> str:
    """DuckDB SQL for the documents: trees of up to 16**levels nodes, folded over whole tables."""

    def leaf(texts: Sequence[str]) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    byte = "list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT)"
    crc = f"xor(list_reduce({byte}, lambda c, b: list_reduce(range(8), lambda a, k: xor(a >> 1, (a & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295)"
    steps = [
        "named AS (SELECT *, coalesce(doc_id::VARCHAR, '') AS name, doc_id::VARCHAR AS t_doc_id, n_chars::VARCHAR AS t_n_chars FROM documents)",
        f"leaves AS (SELECT doc_id, source, {leaf(['t_doc_id', 'source', 'lang', 't_n_chars', 'text'])} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(['t_doc_id', 'source', 'lang', 't_n_chars', lowered])} END AS claimed FROM named)",
        "a0 AS (SELECT *, source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves)",
        "na0 AS (SELECT g, pos, n, leaf AS node FROM a0)",
    ]
    for kind in ("a", "b"):
        for k in range(levels):
            steps.append(f"r{kind}{k} AS MATERIALIZED (SELECT g, pos // 16 AS pos, n, string_agg(node, '' ORDER BY pos) AS run FROM n{kind}{k} GROUP BY g, pos // 16, n)")
            steps.append(f"n{kind}{k + 1} AS MATERIALIZED (SELECT g, pos, n, CASE WHEN n > {16**k} THEN sha256(run) ELSE run END AS node FROM r{kind}{k})")
        if kind == "a":
            steps.append(f"b0 AS (SELECT g AS source, node AS subroot, 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM na{levels})")
            steps.append("nb0 AS (SELECT g, pos, n, subroot AS node FROM b0)")
    steps.append("start AS (SELECT a.doc_id, a.leaf, coalesce(a.claimed, a.leaf) AS x, '' AS proof, a.g AS ga, a.pos AS pa, a.n AS na, b.subroot, b.g AS gb, b.pos AS pb, b.n AS nb FROM a0 a JOIN b0 b ON a.source IS NOT DISTINCT FROM b.source)")
    last = "start"
    for kind in ("a", "b"):
        for k in range(levels):
            at = f"64 * (p{kind} // {16**k} % 16)"
            before, after = f"substring(run, 1, {at})", f"substring(run, {at} + 65)"
            steps.append(f"f{kind}{k} AS (SELECT s.* REPLACE (CASE WHEN n{kind} > {16**k} THEN sha256({before} || x || {after}) ELSE x END AS x, proof || CASE WHEN n{kind} > {16**k} THEN {before} || {after} ELSE '' END AS proof) FROM {last} s JOIN r{kind}{k} r ON s.g{kind} IS NOT DISTINCT FROM r.g AND s.p{kind} // {16 ** (k + 1)} = r.pos)")
            last = f"f{kind}{k}"
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, (SELECT node FROM nb{levels}) AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = (SELECT node FROM nb{levels}) AS verified FROM {last}"
