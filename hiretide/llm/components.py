"""Connected components of an edge table, all of it in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiretide.operators.scratch import drop, materialise_at


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the node's smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a long, b long)`` edges to ``(node, component)``, component the smallest node reachable.

    Alternates the large-star and small-star contractions until the edges are
    stars.  Loops and repeated edges are allowed, null ends are dropped, no
    edge gives no row.  A hub's edges are joined with one row per node, which
    adaptive execution splits.  Each round is a written table; the driver sees
    one row per round.
    """
    state = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, at = materialise_at(state, "edges")
    mark = None
    while True:
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if tuple(now) == mark or now["n"] == 0:
            break
        mark = tuple(now)
        state, to = materialise_at(_small_star(_large_star(state)), "edges")
        drop(at)
        at = to
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
