"""Search and ranking: keyword and vector recall, fusion, diversity, evidence, excerpts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Vectors and query vectors that meet in one task.
ROWS, AT_ONCE = 10_000, 2_000
#: Slack of scores by matrix product, far above their error: what is within it is measured.
NEAR = 1e-9
#: Hits of a list that are ranked at most: the depth of recall, cut by a distributed top-k before any window over everything.
DEPTH = 10_000
#: Excerpts: characters before the hit, and at most.
BEFORE, EXCERPT = 256, 4096


@dataclass(frozen=True)
class Recipe:
    """A named search configuration."""

    keyword: bool = True
    vector: bool = False
    expand: bool = False
    rerank: str = "rrf"
    rrf_k: float = 1.0
    min_cosine: float = 0.35
    mmr_lambda: float = 0.7
    limit: int = 10


#: The shipped recipes.
RECIPES = {"keyword": Recipe(), "hybrid": Recipe(vector=True), "semantic": Recipe(keyword=False, vector=True), "diverse": Recipe(vector=True, rerank="mmr")}


def terms(query: str) -> list[str]:
    """Lower-cased literal terms of a query; those without a letter or digit are ignored."""
    return sorted({t.lower() for t in query.split() if any(c.isalnum() for c in t)})


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def relevance(text: Column, wanted: list[str]) -> Column:
    """Term frequency of the wanted terms, r, as r / (1 + r): below 1 for every text."""
    r = F.size(F.filter(words(text), lambda w: w.isin(*wanted))) if wanted else F.lit(0)
    return r / (1 + r)


def keyword(rows: DataFrame, key: str, name: str, texts: list[str], query: str, limit: int) -> DataFrame:
    """``(key, score, method)``: a whole-name equality scores 1, other hits by :func:`relevance` over all texts."""
    exact = F.lower(name) == query.strip().lower()
    text = relevance(F.concat_ws(" ", *texts), terms(query))
    scored = rows.select(key, F.when(exact, 1.0).otherwise(text).alias("score"), F.when(exact, "exact").otherwise("text").alias("method"))
    return scored.where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def strongest(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The largest score of each version, then of each chain."""
    return hits.groupBy(*keys).agg(F.max("score").alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null for a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of the rows of ``x`` and ``y``, summed from the first component on as :func:`cosine` does."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += x[:, i] * y[:, i]
    return total


def _block(keys: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(query, row, score)`` of the ``k`` best rows ``x`` for each of the queries ``q``, by place.

    A matrix product finds what comes near the k-th best; only that is measured.  Of equal vectors the k + 1 smallest keys
    can be among the best.  A NaN is larger than any number, as to SQL.
    """
    lengths = [_dot(v, v) for v in (x, q)]
    order = np.argsort(keys, kind="stable")
    copies = pd.Series([x[i].tobytes() for i in order], dtype=object)
    order = order[(copies.groupby(copies).cumcount() <= k).to_numpy()]
    none, finite = ([n == 0 for n in lengths], [np.isfinite(n) for n in lengths])
    units = [v / np.sqrt(n)[:, None] for v, n in ((x[order], lengths[0][order]), (q, lengths[1]))]
    for start in range(0, len(q), 256):
        some = np.arange(start, min(start + 256, len(q)))
        near = units[1][some] @ units[0].T
        near[np.isnan(near)] = np.inf
        near[own[some][:, None] == keys[order][None, :]] = -np.inf
        near[np.ix_(finite[1][some], none[0][order])] = near[np.ix_(none[1][some], finite[0][order])] = -np.inf  # a division by zero
        bound = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
        i, j = np.nonzero((near >= np.maximum(bound, least)[:, None] - NEAR) & (near > -np.inf))
        i, j = some[i], order[j]
        score = np.concatenate([np.zeros(0), *(_dot(x[j[n : n + 65536]], q[i[n : n + 65536]]) for n in range(0, len(i), 65536))])
        score /= np.sqrt(lengths[0][j]) * np.sqrt(lengths[1][i])
        good = np.isnan(score) | (score >= least)
        found = pd.DataFrame({"i": i[good], "j": j[good], "score": score[good]})
        found = found.sort_values(["i", "score"], ascending=[True, False], kind="stable", na_position="first")
        found = found[found.groupby("i").cumcount() < k]
        yield found["i"].to_numpy(), found["j"].to_numpy(), found["score"].to_numpy()


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, least: float = -1.0, scope: str | None = None) -> DataFrame:
    """``(query, key, score, rank)``: exact cosine top-k of each query over all vectors, optionally within a scope.

    Rows and queries are dealt into blocks of about ROWS and AT_ONCE, and every block of rows meets every block of queries
    in one task that keeps the ``k`` best of each query, so memory is bounded by the blocks and each pair costs one
    product of a matrix.  Vectors that are null, hold a null, or have another size or a norm of zero are near to nothing.
    """
    whole = F.col(vector).isNotNull() & F.col(key).isNotNull() & ~F.exists(vector, lambda v: v.isNull()) & (F.size(vector) > 0)
    rows, asked = (d.select(key, vector, *([scope] if scope else [])).where(whole) for d in (vectors, queries))
    if scope:
        rows, asked = (d.where(F.col(scope).isNotNull()) for d in (rows, asked))
    n_rows, n_asked = max(1, -(-rows.count() // ROWS)), max(1, -(-asked.count() // AT_ONCE))
    own = lambda d, n, at: d.withColumn(at, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = own(rows, n_rows, "_r").withColumn("_q", every(n_asked))
    asked = own(asked, n_asked, "_q").withColumn("_r", every(n_rows))
    asked = asked.select("_r", "_q", F.col(key).alias("query"), F.col(vector).alias("q"), *([F.col(scope).alias("within")] if scope else []))
    kinds = dict(vectors.dtypes)

    def alike(own: pd.Series, within: Iterable) -> dict[tuple, list[int]]:
        """Places of the vectors of each size and scope."""
        found: dict[tuple, list[int]] = {}
        for at, kind in enumerate(zip(own.map(len), within)):
            found.setdefault(kind, []).append(at)
        return found

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, places = [], alike(right[vector], right[scope] if scope else repeat(0))
        for kind, asking in alike(left["q"], left["within"] if scope else repeat(0)).items():
            if kind in places:
                sides = (right[[key, vector]].iloc[places[kind]], left[["query", "q"]].iloc[asking])
                (keys, x), (own, q) = ((d.iloc[:, 0].to_numpy(), np.stack(d.iloc[:, 1].to_numpy()).astype(float)) for d in sides)
                with np.errstate(all="ignore"):
                    out += [pd.DataFrame({"query": own[i], key: keys[j], "score": score}) for i, j, score in _block(keys, x, own, q, k, least)]
        return pd.concat(out) if out else pd.DataFrame({"query": left["query"].iloc[:0], key: right[key].iloc[:0], "score": np.zeros(0)})

    met = asked.groupBy("_r", "_q").cogroup(rows.groupBy("_r", "_q"))
    scored = met.applyInPandas(run, f"query {kinds[key]}, {key} {kinds[key]}, score double")
    scored = scored.withColumn("score", F.coalesce("score", F.lit(float("nan"))))  # pandas has one word for both
    w = W.partitionBy("query").orderBy(F.desc("score"), key)
    return scored.select(key, "query", "score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def relationship_similarity(edges: DataFrame, query: list[float], limit: int, least: float = -1.0, anchors: DataFrame | None = None) -> DataFrame:
    """``(uuid, source_chain, target_chain, score, rank)``: the edges whose ``embedding`` is closest to one query vector.

    Anchored requests keep edges at either end of ``anchors (chain_id)`` before any cosine is taken.  The order is cut by
    a distributed top-k, so the window ranks ``limit`` rows.
    """
    if anchors is not None:
        a = anchors.select("chain_id").distinct()
        ends = [edges.join(a.withColumnRenamed("chain_id", c), c, "left_semi").select("uuid") for c in ("source_chain", "target_chain")]
        edges = edges.join(ends[0].union(ends[1]).distinct(), "uuid", "left_semi")
    same = edges.where(F.size("embedding") == len(query))
    scored = same.select("uuid", "source_chain", "target_chain", cosine(F.col("embedding"), F.array(*map(F.lit, query))).alias("score"))
    top = scored.where(F.col("score") >= least).orderBy(F.desc("score"), "uuid").limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "uuid")))


def summaries(entities: DataFrame, t: Column, query: str, limit: int) -> DataFrame:
    """Keyword recall over derived summaries in effect at ``t``: made by then, not past their ``summary_valid_until``."""
    seen = entities.where(F.col("derived_summary").isNotNull() & (F.col("summary_as_of") <= t) & (F.col("summary_valid_until").isNull() | (t < F.col("summary_valid_until"))))
    scored = seen.select("chain_id", relevance(F.col("derived_summary"), terms(query)).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "chain_id").limit(limit)


def recall(recipe: Recipe, rows: DataFrame, key: str, name: str, texts: list[str], query: str, vector: str, embedded: list[float] | None = None) -> DataFrame:
    """What a recipe finds: keyword and vector lists of four times its limit, fused by rank or chosen for diversity."""
    wide = 4 * recipe.limit
    lists = [keyword(rows, key, name, texts, query, wide)] if recipe.keyword else []
    if recipe.vector and embedded is not None:
        near = rows.where(F.size(vector) == len(embedded)).select(key, cosine(F.col(vector), F.array(*map(F.lit, embedded))).alias("score"), F.lit("vector").alias("method"))
        lists.append(near.where(F.col("score") >= recipe.min_cosine).orderBy(F.desc("score"), key).limit(wide))
    fused = fuse(lists, key, recipe.rrf_k)
    if recipe.rerank == "mmr":
        chosen = diversify(fused.join(rows.where(F.col(vector).isNotNull()).select(key, vector), key).withColumn("all", F.lit(0)), key, vector, recipe.mmr_lambda, recipe.limit, "all")
        return chosen.select(key, F.col("mmr").alias("score"), "rank")
    return fused.where(F.col("rank") <= recipe.limit).select(key, "score", "rank")


def fuse(lists: list[DataFrame], key: str, k: float = 60.0, visible: DataFrame | None = None, pin: bool = True) -> DataFrame:
    """Reciprocal rank fusion of ``(key, score, method)`` lists: one vote a list, (k + 1) / (k + rank) / lists.

    A list is its DEPTH best hits.
    Ranks are given before invisible hits go, so those promote nobody.  Exact hits come first, then score, then key.
    """
    votes = []
    for hits in lists:
        one = hits.groupBy(key).agg(F.max("score").alias("score"), F.bool_or((F.col("method") == "exact") & (F.col("score") >= 1)).alias("exact"))
        one = one.orderBy(F.desc("score"), key).limit(DEPTH)
        rank = F.row_number().over(W.orderBy(F.desc("score"), key))
        votes.append(one.withColumn("vote", (k + 1) / (k + rank) / len(lists)))
    rows = reduce(DataFrame.unionByName, votes)
    if visible is not None:
        rows = rows.join(visible.select(key).distinct(), key, "left_semi")
    fused = rows.groupBy(key).agg(F.sum("vote").alias("score"), F.bool_or("exact").alias("exact"))
    order = ([F.desc("exact")] if pin else []) + [F.desc("score"), F.col(key)]
    return fused.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def diversify(candidates: DataFrame, key: str, vector: str, weight: float, limit: int, group: str) -> DataFrame:
    """Maximal marginal relevance inside each ``group``: greedily weight * score - (1 - weight) * largest similarity chosen.

    Candidate lists are bounded by the recall limit; each group is one small pandas frame.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        x = np.stack([np.asarray(v, float) for v in pdf[vector]])
        norm = np.linalg.norm(x, axis=1)
        given, left, penalty, out = weight * pdf["score"].to_numpy(), np.ones(len(pdf), bool), np.zeros(len(pdf)), []
        while left.any() and len(out) < limit:
            scores = np.where(left, given - (1 - weight) * penalty, -np.inf)
            best = int(np.argmax(scores))
            left[best] = False
            out.append((pdf[group].iloc[0], pdf[key][best], scores[best], len(out) + 1))
            with np.errstate(divide="ignore", invalid="ignore"):
                near = np.nan_to_num(x @ x[best] / (norm * norm[best]))
            penalty = np.maximum(penalty, np.clip(near, 0, 1))
        return pd.DataFrame(out, columns=[group, key, "mmr", "rank"])

    kinds = dict(candidates.dtypes)
    return candidates.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, mmr double, rank int")


def diversify_names(candidates: DataFrame, key: str, name: str, weight: float, limit: int, group: str) -> DataFrame:
    """The same with the overlap of name words where no comparable vectors exist."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        bags = [set(str(n).lower().split()) for n in pdf[name]]
        left, penalty, out = list(range(len(pdf))), [0.0] * len(pdf), []
        while left and len(out) < limit:
            best = max(left, key=lambda i: (weight * pdf["score"][i] - (1 - weight) * penalty[i], -i))
            out.append((pdf[group].iloc[0], pdf[key][best], weight * pdf["score"][best] - (1 - weight) * penalty[best], len(out) + 1))
            left.remove(best)
            for i in left:
                both = bags[i] | bags[best]
                penalty[i] = max(penalty[i], len(bags[i] & bags[best]) / len(both) if bags[i] and bags[best] else 0.0)
        return pd.DataFrame(out, columns=[group, key, "mmr", "rank"])

    kinds = dict(candidates.dtypes)
    return candidates.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, mmr double, rank int")


def by_signal(hits: DataFrame, signal: DataFrame, key: str, column: str, ascending: bool = False) -> DataFrame:
    """The DEPTH first hits by a signal (observations, distance); chains without one come last."""
    s = F.col(column)
    order = [(s.asc_nulls_last() if ascending else s.desc_nulls_last()), F.desc("score"), F.col(key)]
    return hits.join(signal, key, "left").orderBy(*order).limit(DEPTH).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def budget_split(ranked: DataFrame, budget: int) -> DataFrame:
    """An even split of ``budget`` over ranked chains; the remainder goes to the first ones, chains beyond it get none."""
    n = F.lit(min(budget, max(1, ranked.limit(budget).count())))
    share = F.floor(F.lit(budget) / n) + F.when(F.col("rank") <= F.lit(budget) % n, 1).otherwise(0)
    return ranked.withColumn("share", F.when(F.col("rank") <= n, share).otherwise(0))


def fair_selection(items: DataFrame, request: str, limit: int) -> DataFrame:
    """Round-robin choice of shared evidence: ``(request, grp, item, position)`` to ``(request, item)``.

    In round r every group in turn takes its first unchosen item unless it already holds r chosen ones.  The order
    matters, so each request (at most a few hundred rows) is one small frame.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = [g.sort_values("position")["item"].drop_duplicates().tolist() for _, g in pdf.groupby("grp", sort=True)]
        chosen: list = []
        for turn in range(1, limit + 1):
            for g in groups:
                if len(chosen) < limit and sum(i in chosen for i in g) < turn:
                    chosen += [i for i in g if i not in chosen][:1]
        return pd.DataFrame({request: pdf[request].iloc[0], "item": chosen})

    kinds = dict(items.dtypes)
    return items.groupBy(request).applyInPandas(run, f"{request} {kinds[request]}, item {kinds['item']}")


def excerpt(text: Column, wanted: list[str]) -> Column:
    """``struct<start, end, content, matched>``: the earliest literal hit with BEFORE characters before it, EXCERPT at most."""
    folded = F.lower(text)
    at = F.array_min(F.filter(F.array(*(F.when(F.instr(folded, t) > 0, F.struct((F.instr(folded, t) - 1).alias("s"), (F.instr(folded, t) - 1 + len(t)).alias("e"))) for t in wanted)), lambda x: x.isNotNull())) if wanted else F.lit(None).cast("struct<s:int,e:int>")
    start = F.when(at.isNull(), 0).otherwise(F.greatest(F.lit(0), at["s"] - BEFORE, at["e"] - EXCERPT))
    end = F.least(start + EXCERPT, F.length(text))
    return F.struct(start.alias("start"), end.alias("end"), F.substr(text, start + 1, end - start).alias("content"), at.isNotNull().alias("matched"))


def text_search(rows: DataFrame, key: str, text: str, query: str, limit: int) -> DataFrame:
    """Snapshot keyword search: hits with their excerpts."""
    wanted = terms(query)
    scored = rows.withColumn("score", relevance(F.col(text), wanted)).where("score > 0").orderBy(F.desc("score"), key).limit(limit)
    return scored.select(key, "score", excerpt(F.col(text), wanted).alias("excerpt"))


def readiness(entities: DataFrame, vector: str, size: int) -> DataFrame:
    """Eligible, compatible and missing vectors."""
    v = F.col(vector)
    return entities.agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.size(v) == size).alias("compatible"), F.count_if(v.isNull() | (F.size(v) != size)).alias("missing"))
