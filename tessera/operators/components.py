"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large star) or smaller (small star) neighbours to the smallest node it sees."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = both.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list; the component is its smallest node.

    Nulls in either end and self links are ignored, repeated edges count once, an empty list gives an empty table.
    Each round is two shuffles by node and ends as a written table, so a lost executor costs one round at most.
    """
    e = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
    e = materialise(e.where(f"{src} is not null and {dst} is not null and a <> b").distinct(), "links")
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == before or now.n == 0:
            break
        before = (now.n, now.h)
        e = materialise(_star(_star(e, large=True), large=False), "links")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
