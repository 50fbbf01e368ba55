"""Graph reads: neighbours, bounded search, simple paths, catalog and signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.storage import materialise


def undirected(edges: DataFrame) -> DataFrame:
    """``(a, b)`` both ways, each once."""
    pairs = edges.select(F.col("source_chain").alias("a"), F.col("target_chain").alias("b"))
    return pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def neighbours(edges: DataFrame, anchors: DataFrame, direction: str = "both", names: list[str] | None = None) -> DataFrame:
    """``(anchor, neighbour, direction, name)`` of anchors ``(chain_id)``: one join for each direction asked."""
    e = edges if names is None else edges.where(F.col("name").isin(*names))
    a = anchors.select(F.col("chain_id").alias("anchor")).distinct()
    parts = []
    if direction in ("out", "both"):
        parts.append(e.join(a, e.source_chain == a.anchor).select("anchor", F.col("target_chain").alias("neighbour"), F.lit("out").alias("direction"), "name"))
    if direction in ("in", "both"):
        parts.append(e.join(a, e.target_chain == a.anchor).select("anchor", F.col("source_chain").alias("neighbour"), F.lit("in").alias("direction"), "name"))
    return reduce(DataFrame.union, parts).distinct()


def bounded_search(edges: DataFrame, roots: DataFrame, depth: int, budget: int | None = None) -> DataFrame:
    """``(root, chain_id, distance, score)`` within ``depth`` undirected steps of each root; score is 1 / (1 + distance).

    A hop joins the frontier alone with the edges, from either end, and drops what was reached before; edges are stored
    once, not both ways.  ``budget`` bounds the chains of a
    root (nearest first, then by id); types restrict results, not the way, so filter afterwards.
    """
    pairs = materialise(edges.select(F.col("source_chain").alias("a"), F.col("target_chain").alias("b")).distinct(), "pairs")
    seen = materialise(roots.select(F.col("chain_id").alias("root"), "chain_id", F.lit(0).alias("distance")).distinct(), "reached")
    front = seen
    for d in range(1, depth + 1):
        forth = front.join(pairs, front.chain_id == pairs.a).select("root", F.col("b").alias("chain_id"))
        back = front.join(pairs, front.chain_id == pairs.b).select("root", F.col("a").alias("chain_id"))
        step = forth.union(back).distinct()
        front = materialise(step.join(seen, ["root", "chain_id"], "left_anti").withColumn("distance", F.lit(d)), "frontier")
        if front.isEmpty():
            break
        seen = seen.union(front)
    out = seen.withColumn("score", 1 / (1 + F.col("distance")))
    if budget is None:
        return out
    w = W.partitionBy("root").orderBy("distance", "chain_id")
    return out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= budget).drop("r")


def subgraph(edges: DataFrame, roots: DataFrame, depth: int, hop_limit: int, edge_limit: int) -> tuple[DataFrame, DataFrame]:
    """Chains ``(chain_id, distance)`` within ``depth`` undirected steps of any root, and up to ``edge_limit`` edges among them.

    A hop takes at most ``hop_limit`` new chains (by id) and goes on from these alone; roots are never left out.  Edges
    whose farther end is nearest come first, then by their ends.
    """
    pairs = materialise(undirected(edges), "pairs")
    seen = materialise(roots.select("chain_id", F.lit(0).alias("distance")).distinct(), "reached")
    front = seen
    for d in range(1, depth + 1):
        step = front.join(pairs, front.chain_id == pairs.a).select(F.col("b").alias("chain_id")).distinct().join(seen, "chain_id", "left_anti")
        front = materialise(step.orderBy("chain_id").limit(hop_limit).withColumn("distance", F.lit(d)), "frontier")
        if front.isEmpty():
            break
        seen = seen.union(front)
    a, b = (seen.select(F.col("chain_id").alias(c), F.col("distance").alias(f"d_{c}")) for c in ("source_chain", "target_chain"))
    inside = edges.join(a, "source_chain").join(b, "target_chain").withColumn("distance", F.greatest("d_source_chain", "d_target_chain"))
    return seen, inside.orderBy("distance", "source_chain", "target_chain").limit(edge_limit).select("source_chain", "target_chain", "distance")


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, hops: int = 3, most: int = 10, direction: str = "out") -> DataFrame:
    """``(start, end, length, path)``: up to ``most`` paths without a repeated node, shortest first, then by path.

    ``direction`` says which way edges are walked: ``out``, ``in`` or ``both``.  The last step of a path meets only edges
    to an end.  A walk reaches an end by one edge at most, so a start with up to ``most`` walks has no more paths to any
    end: its paths are returned as they are found, and only those of other starts are ranked.
    """
    forth = edges.select(F.col("source_chain").alias("a"), F.col("target_chain").alias("b"))
    back = edges.select(F.col("target_chain").alias("a"), F.col("source_chain").alias("b"))
    e = {"out": forth, "in": back, "both": forth.union(back)}[direction].distinct()
    goal = ends.select(F.col("chain_id").alias("b")).distinct()
    last = materialise(e.join(goal, "b", "left_semi").select("a", "b"), "last")
    step = lambda walk, e: walk.join(e, walk.tip == e.a).where(~F.array_contains("path", F.col("b")))
    walks = [starts.select(F.array("chain_id").alias("path"), F.col("chain_id").alias("tip")).distinct()]
    for _ in range(1, hops):
        walks.append(materialise(step(walks[-1], e).select(F.array_append("path", F.col("b")).alias("path"), F.col("b").alias("tip")), "walks"))
    begun = reduce(DataFrame.union, [w.select(F.col("path")[0].alias("start")) for w in walks])
    many = materialise(begun.groupBy("start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("start"), "many")

    def found(how: str) -> DataFrame:
        parts = []
        for length, walk in enumerate(walks, 1):
            own = walk.join(many, walk.path[0] == many.start, how).select(*(walk[c] for c in walk.columns))
            parts.append(step(own, last).select(F.col("path")[0].alias("start"), F.col("b").alias("end"), F.lit(length).alias("length"), F.array_append("path", F.col("b")).alias("path")))
        return reduce(DataFrame.union, parts)

    few = found("left_anti")
    if many.isEmpty():
        return few
    w = W.partitionBy("start", "end").orderBy("length", "path")
    return few.union(found("left_semi").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r"))


def overview(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the visible ``entities (chain_id)``."""
    seen = entities.select("chain_id").distinct()
    return edges.join(seen.withColumnRenamed("chain_id", "source_chain"), "source_chain", "left_semi").join(seen.withColumnRenamed("chain_id", "target_chain"), "target_chain", "left_semi")


def catalog(entities: DataFrame) -> DataFrame:
    """Entities by namespace and type."""
    return entities.groupBy("namespace", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def filter_options(rows: DataFrame, column: str, contains: str = "") -> DataFrame:
    """Values of a column with their counts, those whose lower-cased text contains ``contains``."""
    return rows.where(F.lower(column).contains(contains.lower())).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def observation_signal(mentions: DataFrame) -> DataFrame:
    """Distinct snapshots that mention each chain."""
    return mentions.groupBy("chain_id").agg(F.count_distinct("snapshot").alias("observations"))


def dependents_signal(edges: DataFrame) -> DataFrame:
    """Distinct chains that point at each chain."""
    return edges.groupBy(F.col("target_chain").alias("chain_id")).agg(F.count_distinct("source_chain").alias("dependents"))
