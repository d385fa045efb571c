"""Lineage graphs: both known shapes as nodes and edges, selection of a snapshot, seeds, and walks in both directions."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.sources import scratch

NODES = "node_id string, node_type string, label string, metadata map<string,string>"
EDGES = "source string, target string, relationship string"
SEEDS = 8
#: Edges of a node from which on it is a hub, and of each of its parts.
HUB_EDGES = 100_000
#: A walk takes so many steps in one job at most, and only while a job reaches few nodes; what it has reached lies in so many tables at most.
STEPS, FEW_NODES, TABLES = 8, 1_000_000, 8


def normalize_snapshot(spark: SparkSession, snapshot: dict[str, Any]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a snapshot with nodes and edges, or with datasets and edges; of any other, empty ones. A node id that comes again replaces the one before."""
    as_text = lambda m: {k: v if isinstance(v, str) else json.dumps(v) for k, v in (m or {}).items() if v is not None}
    nodes: dict[str, tuple] = {}
    if "nodes" in snapshot and "edges" in snapshot:
        for n in snapshot["nodes"] or []:
            if node_id := n.get("node_id") or n.get("id"):
                nodes[str(node_id)] = (str(node_id), n.get("type") or n.get("node_type") or "UNKNOWN", n.get("label") or n.get("name") or str(node_id), as_text(n.get("metadata")))
    elif "datasets" in snapshot and "edges" in snapshot:
        for node_id, n in (snapshot["datasets"] or {}).items():
            nodes[node_id] = (node_id, n.get("dataset_type", "dataset"), n.get("name", node_id), as_text({"path": n.get("source_file"), "description": n.get("description")}))
        for node_id, n in (snapshot.get("transformations") or {}).items():
            nodes[node_id] = (node_id, n.get("transformation_type", "transformation"), node_id, as_text({"path": n.get("source_file")}))
    else:
        return spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    edges = [(e.get("source"), e.get("target"), e.get("relationship") or e.get("edge_type") or e.get("type") or "RELATED") for e in snapshot["edges"] or []]
    return spark.createDataFrame(list(nodes.values()), NODES), spark.createDataFrame(edges, EDGES)


def snapshot_tables(snapshots: DataFrame, otherwise: str = "RELATED") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of snapshots(ord, doc: variant) of both shapes, each with its ord; a node id that comes again in a snapshot replaces the one before.

    Nodes have ``own_file`` and ``repo`` too, by which a snapshot is found. The rules are those of ``normalize_snapshot``.
    """
    spark = snapshots.sparkSession
    text = lambda path: f"nullif(try_variant_get(e.value, '$.{path}', 'string'), '')"
    part = lambda name, other="": spark.sql(
        f"select s.ord, s.doc, e.pos, e.key, e.value from {{s}} s, lateral variant_explode(try_variant_get(s.doc, '$.{name}', 'variant')) e where try_variant_get(s.doc, '$.edges', 'variant') is not null {other}", s=snapshots
    )
    dataset_shape = "and try_variant_get(s.doc, '$.nodes', 'variant') is null and try_variant_get(s.doc, '$.datasets', 'variant') is not null"
    listed, sets, steps = part("nodes"), part("datasets", dataset_shape), part("transformations", dataset_shape)
    get = lambda path: F.expr(text(path).replace("e.value", "value"))
    kept = lambda m: F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    own_id = F.coalesce(get("node_id"), get("id"))
    metadata = F.expr("try_variant_get(value, '$.metadata', 'map<string,string>')")
    repo = F.concat_ws(" ", get("metadata.codebase_root"), get("metadata.repo_name"))
    nodes = listed.select("ord", F.lit(0).alias("kind"), "pos", own_id.alias("node_id"), F.coalesce(get("type"), get("node_type"), F.lit("UNKNOWN")).alias("node_type"), F.coalesce(get("label"), get("name"), own_id).alias("label"), kept(metadata).alias("metadata"), get("source_file").alias("own_file"), repo.alias("repo"))
    of_set = F.create_map(F.lit("path"), get("source_file"), F.lit("description"), get("description"))
    nodes = nodes.union(sets.select("ord", F.lit(0), "pos", F.col("key"), F.coalesce(get("dataset_type"), F.lit("dataset")), F.coalesce(get("name"), F.col("key")), kept(of_set), get("source_file"), F.lit("")))
    nodes = nodes.union(steps.select("ord", F.lit(1), "pos", F.col("key"), F.coalesce(get("transformation_type"), F.lit("transformation")), F.col("key"), kept(F.create_map(F.lit("path"), get("source_file"))), get("source_file"), F.lit("")))
    fields = ("node_type", "label", "metadata", "own_file", "repo")
    last = nodes.where("node_id is not null").groupBy("ord", "node_id").agg(F.max_by(F.struct(*fields), F.struct("kind", "pos")).alias("n")).select("ord", "node_id", "n.*")
    known = "and (try_variant_get(s.doc, '$.nodes', 'variant') is not null or try_variant_get(s.doc, '$.datasets', 'variant') is not null)"
    edges = part("edges", known).select("ord", get("source").alias("source"), get("target").alias("target"), F.coalesce(get("relationship"), get("edge_type"), get("type"), F.lit(otherwise)).alias("relationship"))
    return last, edges


def chosen_snapshot(spark: SparkSession, snapshots: DataFrame, roots: list[tuple[str, str]], otherwise: str = "RELATED") -> tuple[DataFrame, DataFrame, str]:
    """(nodes, edges, label) of the snapshot that fits roots(path, name) best, or of the last one; otherwise: what an edge without a kind is. A snapshot is judged by its root and by each of its nodes, in a join."""
    nodes, edges = snapshot_tables(snapshots, otherwise)
    root = snapshots.select("ord", F.expr("try_variant_get(doc, '$.codebase_root', 'string')").alias("codebase_root"))
    meta = lambda k: F.col("metadata")[k]
    told = nodes.select("ord", F.concat_ws(" ", "node_id", "label", "own_file", meta("source_file"), meta("source_file_abs"), "repo").alias("haystack"))
    judged = root.join(told, "ord", "left").select("ord", "codebase_root", F.coalesce("haystack", F.lit("")).alias("haystack"))
    if roots:
        best = select_snapshot(judged, spark.createDataFrame(roots, "root string, name string"))
    else:
        best = snapshots.agg(F.max("ord").alias("ord")).select("ord", F.lit("fallback-last").alias("label"))
    ord_, label = best.select("ord", F.col("label")).first()
    return nodes.where(F.col("ord") == ord_).select("node_id", "node_type", "label", "metadata"), edges.where(F.col("ord") == ord_).select("source", "target", "relationship"), label


def _dealt(edges: DataFrame, direction: str, tables: scratch.Tables) -> tuple[DataFrame, DataFrame | None]:
    """(at, salt, to, relation) of every usable edge, dealt by at and salt, and (hub, salts) of nodes with many edges, None if there are none."""
    start, end = ("source", "target") if direction == "downstream" else ("target", "source")
    usable = edges.where("source is not null and target is not null and source <> '' and target <> ''")
    steps = usable.select(F.col(start).alias("at"), F.col(end).alias("to"), F.coalesce("relationship", F.lit("RELATED")).alias("relation"))
    hubs = tables.write(steps.groupBy("at").count().where(F.col("count") > HUB_EDGES).select(F.col("at").alias("hub"), F.ceil(F.col("count") / HUB_EDGES).cast("int").alias("salts")), "walk-hubs")
    if hubs.isEmpty():
        return steps.withColumn("salt", F.lit(0)).repartition("at", "salt"), None
    salted = steps.join(hubs, F.col("at") == F.col("hub"), "left").withColumn("salt", F.pmod(F.xxhash64("to"), F.coalesce("salts", F.lit(1))).cast("int"))
    return salted.select("at", "salt", "to", "relation").repartition("at", "salt"), hubs


def _one_step(here: DataFrame, steps: DataFrame, hubs: DataFrame | None, distance: int) -> DataFrame:
    """What is one edge away from here(node_id); a hub stands once for each part of its edges."""
    if hubs is None:
        from_ = here.select("node_id", F.lit(0).alias("own"))
    else:
        from_ = here.select("node_id").join(hubs, F.col("node_id") == F.col("hub"), "left").select("node_id", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("own"))
    met = from_.join(steps, (F.col("node_id") == F.col("at")) & (F.col("own") == F.col("salt")))
    return met.groupBy(F.col("to").alias("node_id")).agg(F.min("relation").alias("relationship")).select("node_id", F.lit(distance).alias("distance"), "relationship")


def walk(edges: DataFrame, seeds: DataFrame, direction: str = "downstream", max_depth: int | None = None) -> DataFrame:
    """(node_id, distance, relationship) of all nodes reached from seeds(node_id), in max_depth steps if given; the seeds are left out.

    Edges are dealt by their start once, those of a hub in parts. A job takes one step, later up to ``STEPS`` at once, and writes what it
    reaches anew to the shared folder; from time to time these tables become one. So plans and a step's time don't grow with the depth.
    """
    spark = edges.sparkSession
    tables = scratch.Tables(spark)
    steps, hubs = _dealt(edges, direction, tables)
    steps = steps.persist()
    tables.write(seeds.select("node_id", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("relationship")).distinct(), "walk-0")
    names, depth, at_once = ["walk-0"], 0, 1
    try:
        while at_once := min(at_once, max_depth - depth) if max_depth is not None else at_once:
            here, found = tables.read(names[-1]).where(F.col("distance") == depth), []
            for k in range(1, at_once + 1):
                here = _one_step(here, steps, hubs, depth + k)
                found.append(here)
            every = found[0]
            for f in found[1:]:
                every = every.union(f)
            nearest = every.groupBy("node_id").agg(F.min(F.struct("distance", "relationship")).alias("n")).select("node_id", "n.distance", "n.relationship")
            new = nearest.join(tables.read(*names).select("node_id"), "node_id", "left_anti")
            depth += at_once
            seen = Observation()
            tables.write(new.observe(seen, F.count("*").alias("new"), F.count_if(F.col("distance") == depth).alias("last")), f"walk-{depth}")
            names.append(f"walk-{depth}")
            if not seen.get["last"]:
                break
            if len(names) > TABLES:
                tables.write(tables.read(*names[:-1]), f"walk-to-{depth}")
                tables.drop(*names[:-1])
                names = [f"walk-to-{depth}", names[-1]]
            at_once = min(2 * at_once, STEPS) if seen.get["new"] <= FEW_NODES else 1
        return tables.read(*names).where("distance > 0")
    finally:
        steps.unpersist()
        tables.drop("walk-hubs")


def walk_query(edges_view: str, seeds_view: str, direction: str = "downstream", max_depth: int = 10) -> str:
    """The same as one recursive statement, for graphs of small depth."""
    start, end = ("source", "target") if direction == "downstream" else ("target", "source")
    return f"""
    with recursive r(node_id, distance) as (
      select node_id, 0 from {seeds_view}
      union all select e.{end}, r.distance + 1 from r join {edges_view} e on e.{start} = r.node_id where r.distance < {max_depth}
    )
    select node_id, min(distance) as distance from r group by node_id having min(distance) > 0
    """


def score_seeds(nodes: DataFrame, field_tokens: list[str], context_tokens: list[str], limit: int = SEEDS) -> DataFrame:
    """(node_id, score) of the nodes that name the field or its system: 5 a field word, 2 a context word; the best few, by id on ties."""
    meta = lambda k: F.coalesce(F.col("metadata")[k], F.lit(""))
    hay = F.lower(F.concat_ws(" ", "node_id", F.coalesce("label", F.lit("")), meta("path"), meta("source_file"), meta("source_file_abs"), meta("source_datasets"), meta("target_datasets")))
    hits = lambda words: sum((F.when(hay.contains(w), 1).otherwise(0) for w in sorted(set(words))), F.lit(0))
    scored = nodes.select("node_id", (hits(field_tokens) * 5 + hits(context_tokens) * 2).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "node_id").limit(limit)


def field_tokens(field: str) -> list[str]:
    return [t for t in field.lower().split("_") if t]


def context_tokens(system_id: str, ignored: frozenset[str] = frozenset()) -> list[str]:
    return sorted({t for t in re.split(r"[^a-z0-9]+", system_id.lower()) if t} - ignored)


def downstream_consumers(nodes: DataFrame, edges: DataFrame, terms: list[str], fields: list[str]) -> DataFrame:
    """(id, label, relationship, fields_consumed) of what stands at the end of an edge whose source has one of the terms in its name."""
    named = F.lower(F.coalesce("source", F.lit("")))
    hit = F.lit(False)
    for t in terms:
        hit = hit | named.contains(t)
    found = edges.where(hit)
    labels = nodes.groupBy("node_id").agg(F.first("label", True).alias("label"))
    out = found.join(labels, found.target == labels.node_id, "left")
    return out.select(F.col("target").alias("id"), F.coalesce("label", "target").alias("label"), F.coalesce("relationship", F.lit("CONSUMES")).alias("relationship"), F.array(*map(F.lit, fields)).alias("fields_consumed"))


def snapshot_scores(snapshots: DataFrame, roots: DataFrame) -> DataFrame:
    """(ord, score) of snapshots(ord, codebase_root, haystack) for roots(root, name): 100 equal root, 90 below it, 80 root in the text, 70 name in the text."""
    root, own, hay = F.lower("root"), F.lower(F.coalesce("codebase_root", F.lit(""))), F.lower(F.concat_ws(" ", F.coalesce("codebase_root", F.lit("")), "haystack"))
    name = F.lower("name")
    score = F.when(own == root, 100).when(own.startswith(root), 90).when((root != "") & hay.contains(root), 80).when((name != "") & hay.contains(name), 70).otherwise(0)
    return snapshots.join(F.broadcast(roots), how="left").groupBy("ord").agg(F.coalesce(F.max(score), F.lit(0)).alias("score"))  # the roots of one data set


def select_snapshot(snapshots: DataFrame, roots: DataFrame) -> DataFrame:
    """One row (ord, label): the first of the best if any scores, else the last."""
    scored = snapshot_scores(snapshots, roots)
    best = scored.agg(F.max(F.struct("score", (-F.col("ord")).alias("back"))).alias("best"), F.max("ord").alias("last"))
    hit = F.col("best.score") > 0
    return best.select(F.when(hit, -F.col("best.back")).otherwise(F.col("last")).alias("ord"), F.when(hit, "matched-root").otherwise("fallback-last").alias("label"))


def aligned_consumers(nodes: DataFrame, patterns: DataFrame, limit: int = 5) -> DataFrame:
    """(subscriber_id, snapshot_root, nodes): nodes of snapshots of a subscriber's kind, at most five, a row for each subscriber and root.

    nodes: snapshot_root, node_id, haystack; patterns: subscriber_id, repo_patterns, file_patterns (few rows). A subscriber without patterns has no row.
    """
    has = lambda text, words: F.exists(words, lambda w: text.contains(w))
    joined = nodes.join(F.broadcast(patterns), has(F.lower("snapshot_root"), F.col("repo_patterns")) & has(F.lower("haystack"), F.col("file_patterns")))
    place = F.row_number().over(_by("subscriber_id", "snapshot_root").orderBy("node_id"))
    return joined.withColumn("place", place).where(F.col("place") <= limit).groupBy("subscriber_id", "snapshot_root").agg(F.array_sort(F.collect_list("node_id")).alias("nodes"))


def _by(*names: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(*names)


def enrichment_confidence(direct: Column, aligned: Column) -> Column:
    return F.when(direct > 0, "high").when(aligned > 0, "medium").otherwise("low")


def nodes_schema() -> T.StructType:
    return T.StructType.fromDDL(NODES)
