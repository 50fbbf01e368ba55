"""Approximate nearest neighbours: a graph grown by NN-descent, searched greedily.

Equal vectors are one node (named by its smallest id, carrying the first ids of its members), so thousands of copies are
neither compared with each other nor crowd out other neighbours.  The graph starts from the small leaves of TREES random
projection trees (median cuts, sampled pivots of fixed number), which hold about a tenth of the nearest neighbours; each
NN-descent round joins every node with the vectors of its neighbours and reverse neighbours, compares the neighbours with one
another in numpy, and keeps each node's DEGREE nearest, until the lists settle.  A query walks the graph: it starts from its
own node, if it has one, and from the nearest of PIVOTS fixed nodes, opens the nearest unopened nodes of its beam, and stops
when the whole beam is opened; beams only improve, so every walk ends.  Distances of the answer are exact, in double
precision on the vectors given; on the way components beyond 1e18 count as 1e18.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id, take no part.  The most
frequent dimension is the table's; vectors of another take no part.  A repeated id keeps its first row by vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.storage import materialise

#: Neighbours kept for a node; reverse neighbours compared with them in a round; share of new neighbours that ends the rounds.
DEGREE, REVERSE, SETTLED = 40, 10, 0.01
#: Trees of the start and nodes of a leaf.
TREES, LEAF = 4, 64
#: Fixed start nodes, nodes kept in a query's beam, nodes opened for a query in a step.
PIVOTS, BEAM, OPENED = 256, 64, 24
#: Rows that a tree's cuts are fitted on, and the seed of its directions.
FIT_ROWS, SEED = 4096, 2011


def nodes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", members: int = 11) -> DataFrame:
    """``(node, v, members)``: distinct usable vectors with their smallest id and their first ``members`` ids.

    The first 11 members decide any 10 nearest: later members of the same vector are as far and have larger ids.
    """
    v = F.col("v")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (size.n if size else 0))
    ranked = rows.withColumn("salt", F.pmod("id", F.lit(64)))
    # the first ids of each vector: within a salt first, so that a very frequent vector is cut down before it meets
    for keys in (["v", "salt"], ["v"]):
        ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).where(F.col("r") <= members)
    return ranked.groupBy("v").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("members")).select("node", "v", "members")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two matrices."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _matrix(s) -> np.ndarray:
    return np.stack([np.asarray(x, np.float32) for x in s]) if len(s) else np.zeros((0, 1), np.float32)


def _walkable(v: Column) -> Column:
    """A vector in single precision, with components whose squares that can hold."""
    most = F.lit(1e18)
    return F.transform(v, lambda x: F.greatest(-most, F.least(most, x))).cast("array<float>")


def _leaf_codes(vectors: DataFrame, count: int) -> DataFrame:
    """``(node, x, tree, leaf)``: the leaf of every node in each tree; cuts are medians on at most FIT_ROWS nodes."""
    fit = _matrix([r.x for r in vectors.orderBy(F.xxhash64("node"), "node").select("x").limit(FIT_ROWS).collect()])
    rng = np.random.default_rng(SEED)
    trees = []
    depth = max(0, int(np.ceil(np.log2(max(count, 1) / LEAF))))
    for _ in range(TREES):
        at, levels = np.zeros(len(fit), np.int64), []
        for _ in range(depth):
            way = rng.normal(0, 1, (min(2 ** len(levels), 512), fit.shape[1])).astype(np.float32)
            side = (fit * way[at % len(way)]).sum(1)
            # cuts are kept for the first levels, where the sample is dense; below them zero-centred by the parent's median
            cuts = {int(c): float(np.median(side[at == c])) for c in np.unique(at)} if len(levels) < 10 else {}
            levels.append((way, cuts))
            at = at * 2 + (side > np.array([cuts.get(int(c), 0.0) for c in at]))
        trees.append(levels)
    shared = vectors.sparkSession.sparkContext.broadcast(trees)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            x = _matrix(pdf["x"])
            for n, levels in enumerate(shared.value):
                at = np.zeros(len(pdf), np.int64)
                for way, cuts in levels:
                    side = (x * way[at % len(way)]).sum(1)
                    at = at * 2 + (side > np.array([cuts.get(int(c), 0.0) for c in at]))
                yield pd.DataFrame({"node": pdf["node"], "x": pdf["x"], "tree": n, "leaf": at})

    return vectors.mapInPandas(run, "node long, x array<float>, tree int, leaf long")


def _merge(pairs: DataFrame, degree: int) -> DataFrame:
    """Each node's ``degree`` nearest of ``(node, other, d)``, as ``(node, near array<struct<d, other>>)``."""
    best = pairs.groupBy("node", "other").agg(F.min("d").alias("d"))
    ranked = best.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy("d", "other"))).where(F.col("r") <= degree)
    return ranked.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("d", "other"))).alias("near"))


def _nearest(ids: np.ndarray, x: np.ndarray, within: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(node, other, d)``: the ``degree`` nearest of every row among the rows, those nearer than ``within``."""
    n = len(ids)
    k = min(degree, n - 1)
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    d = _distance(x, x)
    np.fill_diagonal(d, np.inf)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    node, other, found = np.repeat(ids, k), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel()
    keep = found < np.repeat(within, k)
    return node[keep], other[keep], found[keep]


def _introduce(rows: DataFrame, keys: list[str], degree: int) -> DataFrame:
    """``(node, other, d)`` from ``(keys, id, x, within)``: nearest neighbours inside each group of ``keys``, nearer than the
    node's ``within``.

    Groups are bounded (a leaf's piece, a node's neighbours); they pass one by one through sorted partitions.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def groups(last: bool) -> pd.DataFrame:
            key, ids, x, within = (np.concatenate(c) for c in zip(*held, strict=True))
            edge = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(ids)]])
            done = len(edge) - 1 if last else len(edge) - 2
            found = [_nearest(ids[edge[i] : edge[i + 1]], x[edge[i] : edge[i + 1]], within[edge[i] : edge[i + 1]], degree) for i in range(done)]
            held[:] = [] if last else [(key[edge[-2] :], ids[edge[-2] :], x[edge[-2] :], within[edge[-2] :])]
            node, other, d = (np.concatenate(c) for c in zip(*found, strict=True)) if found else ([], [], [])
            return pd.DataFrame({"node": np.asarray(node, np.int64), "other": np.asarray(other, np.int64), "d": np.asarray(d, np.float32)})

        for pdf in parts:
            if len(pdf):
                held.append((pdf[keys].to_numpy(np.int64), pdf["id"].to_numpy(np.int64), _matrix(pdf["x"]), pdf["within"].to_numpy(np.float32)))
                yield groups(False)
        if held:
            yield groups(True)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "node long, other long, d float")


def _start(vectors: DataFrame, count: int, degree: int) -> DataFrame:
    """First neighbours: the nearest inside a leaf; a leaf of more than 4 * LEAF rows passes in pieces."""
    coded = _leaf_codes(vectors, count)
    large = coded.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * LEAF)
    pieces = F.coalesce(F.ceil(F.col("n") / F.lit(2 * LEAF)), F.lit(1))
    coded = coded.join(materialise(large, "large"), ["tree", "leaf"], "left").withColumn("piece", F.pmod(F.xxhash64("node", "tree"), pieces)).drop("n")
    return _introduce(coded.withColumnRenamed("node", "id").withColumn("within", F.lit(float("inf")).cast("float")), ["tree", "leaf", "piece"], degree)


def _round(graph: DataFrame, vectors: DataFrame, degree: int, reverse: int) -> DataFrame:
    """Pairs of neighbours' neighbours: each node introduces its (reverse) neighbours to one another."""
    links = graph.select("node", F.explode("near").alias("e")).select("node", "e.other", "e.d")
    back = links.select(F.col("other").alias("node"), F.col("node").alias("other"), "d")
    back = back.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy("d", "other"))).where(F.col("r") <= reverse).drop("r")
    met = links.union(back).select("node", "other").union(vectors.select("node", F.col("node").alias("other"))).distinct()
    farthest = graph.select("node", F.when(F.size("near") >= degree, F.element_at("near", -1)["d"]).alias("within"))
    known = vectors.join(farthest, "node", "left").select(F.col("node").alias("other"), "x", F.coalesce("within", F.lit(float("inf"))).cast("float").alias("within"))
    met = met.join(known, "other").select("node", F.col("other").alias("id"), "x", "within")
    return _introduce(met, ["node"], degree // 2)


def build(vectors: DataFrame, degree: int = DEGREE, reverse: int = REVERSE) -> DataFrame:
    """The neighbour graph ``(node, near)`` of ``(node, x array<float>)``; every round is a written table.

    Rounds go on until at most SETTLED of the neighbours are new; lists only improve, so that comes.
    """
    count = vectors.count()
    graph = materialise(_merge(_start(vectors, count, degree), degree), "graph")
    while True:
        old = graph.select("node", F.explode("near").alias("e")).select("node", "e.other", "e.d")
        grown = materialise(_merge(old.union(_round(graph, vectors, degree, reverse)), degree), "graph")
        fresh = grown.withColumnRenamed("near", "now").join(graph, "node", "left").agg(
            F.sum(F.size(F.array_except(F.transform("now", lambda e: e.other), F.coalesce(F.transform("near", lambda e: e.other), F.array().cast("array<bigint>"))))).alias("new"),
            F.sum(F.size("now")).alias("all"),
        ).first()
        graph = grown
        if not fresh["all"] or fresh["new"] <= SETTLED * fresh["all"]:
            return graph


def search(queries: DataFrame, graph: DataFrame, vectors: DataFrame, starts: DataFrame | None = None, beam: int = BEAM, opened: int = OPENED) -> DataFrame:
    """``(query, node, d)``: the beams of a greedy search for ``queries`` ``(query, q array<float>)``, squared distances.

    ``starts`` ``(query, node)`` are nodes equal to a query, if known.
    The graph is made undirected for the walk, each node with its DEGREE neighbours and its nearest reverse ones.
    """
    links = graph.select("node", F.explode("near").alias("e")).select("node", "e.other", "e.d")
    back = links.select(F.col("other").alias("node"), F.col("node").alias("other"), "d")
    back = back.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy("d", "other"))).where(F.col("r") <= DEGREE).drop("r")
    walk = materialise(links.union(back).groupBy("node").agg(F.collect_set("other").alias("to")), "walk")
    pivots = vectors.orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(PIVOTS).collect()
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([p.node for p in pivots]), _matrix([p.x for p in pivots])))

    def begin(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = shared.value
        for pdf in parts:
            if len(pdf) and len(ids):
                d = _distance(_matrix(pdf["q"]), x)
                near = np.argsort(d, axis=1, kind="stable")[:, :OPENED]
                yield pd.DataFrame({"query": np.repeat(pdf["query"].to_numpy(), near.shape[1]), "node": ids[near].ravel(), "d": np.take_along_axis(d, near, 1).ravel(), "open": False})

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            d = ((_matrix(pdf["q"]) - _matrix(pdf["x"])) ** 2).sum(1) if len(pdf) else np.zeros(0, np.float32)
            yield pd.DataFrame({"query": pdf["query"], "node": pdf["node"], "d": d, "open": False})

    shape = "query long, node long, d float, open boolean"
    beams = queries.mapInPandas(begin, shape)
    if starts is not None:
        beams = beams.unionByName(starts.select("query", "node", F.lit(0).cast("float").alias("d"), F.lit(False).alias("open")))
    beams = materialise(beams.groupBy("query", "node").agg(F.min("d").alias("d"), F.first("open").alias("open")), "beams")
    while not beams.where("not open").isEmpty():
        turn = W.partitionBy("query", "open").orderBy("d", "node")
        front = beams.withColumn("r", F.row_number().over(turn)).where(~F.col("open") & (F.col("r") <= opened)).select("query", "node")
        seen = beams.select("query", "node", "d", F.col("open"))
        reached = front.join(walk, "node").select("query", F.explode("to").alias("node")).distinct().join(seen.select("query", "node"), ["query", "node"], "left_anti")
        reached = reached.join(vectors, "node").join(queries, "query").select("query", "node", "x", "q").mapInPandas(measure, shape)
        now = seen.join(front.withColumn("f", F.lit(True)), ["query", "node"], "left").select("query", "node", "d", (F.col("open") | F.coalesce("f", F.lit(False))).alias("open"))
        best = W.partitionBy("query").orderBy("d", "node")
        beams = materialise(now.union(reached).withColumn("r", F.row_number().over(best)).where(F.col("r") <= beam).drop("r"), "beams")
    return beams.select("query", "node", "d")


def nearest(df: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for rows whose id is divisible by ``every``."""
    found = materialise(nodes(df, key, vector, k + 1), "nodes")
    vectors = materialise(found.select("node", _walkable(F.col("v")).alias("x")), "vectors")
    asking = materialise(
        df.select(F.col(key).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("v")).where(F.col("query") % every == 0).groupBy("query").agg(F.min("v").alias("v")).join(found.select("v", "node"), "v"),
        "queries",
    )
    graph = build(vectors)
    beams = search(asking.select("query", _walkable(F.col("v")).alias("q")), graph, vectors, asking.select("query", "node"))
    exact = F.sqrt(F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    scored = beams.select("query", "node").join(found, "node").join(asking.select("query", F.col("v").alias("q")), "query")
    scored = scored.select("query", F.explode("members").alias("vec_id"), exact.alias("score")).where("vec_id <> query")
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
