"""Connected components of a links table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.shared import drop_folder, new_folder

#: Rounds grow with the logarithm of the number of nodes; this many are never reached.
MAX_ROUNDS = 200


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every node's larger (large star) or smaller (small star) neighbours with the node's smallest one.

    The smallest neighbour comes from an aggregate and is joined back, so no task gathers the neighbours of a node.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b); the component is its smallest node. Nodes without links are not listed.

    Every round's edges are written to the shared folder, so a lost executor costs no more than a round.
    """
    spark = links.sparkSession
    made = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(new_folder(spark, "components"))
        df.write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    edges = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("b")).first()
        if row == before:
            break
        before = row
        edges = keep(_star(keep(_star(edges, large=True)), large=False))
        for path in made[:-1]:
            drop_folder(spark, path)
        del made[:-1]
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
