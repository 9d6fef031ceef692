"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import written

#: Rounds at most; the number needed grows with the logarithm of a component's diameter.
ROUNDS = 60


def _pointed(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step on ``edges`` (a, b), a > b: neighbours of a node are tied to the least of them and it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    tied = both.join(least, F.col("a") == F.col("n"))
    if larger:
        out = tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node reachable) of each node that has a link in ``links`` (a, b).

    Self-links and nulls are left out; repeated links count once.  No group is
    collected: each step is a minimum by node and a join.
    """
    known = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, mark = written(known, "links"), None
    for _ in range(ROUNDS):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        edges = written(_pointed(_pointed(edges, True), False), "stars")
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
