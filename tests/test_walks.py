"""Walks over long chains, hubs and random graphs against a plain search."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from accordant.operators import lineage


def _plain(edges, seeds, back=False, depth=None):
    out = collections.defaultdict(list)
    for a, b, r in edges:
        if a and b:
            (x, y) = (b, a) if back else (a, b)
            out[x].append((y, r or "RELATED"))
    reached, here, d = dict.fromkeys(seeds, (0, None)), set(seeds), 0
    while here and (depth is None or d < depth):
        d += 1
        new = {}
        for x in here:
            for y, r in out[x]:
                if y not in reached:
                    new[y] = min(new.get(y, (d, r)), (d, r))
        reached |= new
        here = set(new)
    return {k: v for k, v in reached.items() if v[0]}


@pytest.mark.parametrize(("back", "depth"), [(False, None), (True, None), (False, 2), (False, 0)])
def test_walk_against_a_plain_search(spark, back, depth):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}", rng.choice([None, "A", "B"])) for _ in range(330)] + [(None, "n1", "A"), ("", "n2", "A"), ("n3", None, "A"), ("n1", "n1", "A")]
    df = spark.createDataFrame(edges, lineage.EDGES).repartition(3)
    seeds = spark.createDataFrame([("n1",), ("n7",), ("n1",)], "node_id string")
    got = {r.node_id: (r.distance, r.relationship) for r in lineage.walk(df, seeds, "upstream" if back else "downstream", depth).collect()}
    assert got == _plain(edges, ["n1", "n7"], back, depth)


def test_a_chain_of_150_steps_leaves_nothing_in_memory(spark):
    edges = spark.range(150).select(F.concat(F.lit("n"), "id").alias("source"), F.concat(F.lit("n"), F.col("id") + 1).alias("target"), F.lit("R").alias("relationship"))
    seeds = spark.createDataFrame([("n0",)], "node_id string")
    out = lineage.walk(edges, seeds)
    assert {r.node_id: r.distance for r in out.collect()} == {f"n{i}": i for i in range(1, 151)}
    assert not spark.sparkContext._jsc.getPersistentRDDs().size()


def test_a_hub_of_a_million_edges_is_dealt_in_parts(spark):
    hub = spark.range(1_000_000).select(F.lit("hub").alias("source"), F.concat(F.lit("t"), "id").alias("target"), F.lit("R").alias("relationship"))
    more = spark.createDataFrame([("a", "hub", "R"), ("t5", "z", "R"), ("z", "a", "R")], lineage.EDGES)
    out = lineage.walk(hub.union(more), spark.createDataFrame([("a",)], "node_id string"))
    assert {r.distance: r["count"] for r in out.groupBy("distance").count().collect()} == {1: 1, 2: 1_000_000, 3: 1}
    from accordant.sources import scratch

    dealt, hubs = lineage._dealt(hub.union(more), "downstream", scratch.Tables(spark))
    assert [tuple(r) for r in hubs.collect()] == [("hub", 10)]
    sizes = [r["count"] for r in dealt.where("at = 'hub'").groupBy("salt").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 110_000
