"""Substring dedup: fuzzy passages found by collinear chaining of shared k-mer seeds.

Seeds are 5-word k-mers (A-Z lower-cased), thinned to the minimum of every WINDOW consecutive ones, so any two texts with
WINDOW + 4 words in a row in common share a seed.  Every seed is joined with the first document that has it; the work is
linear in the seeds, however many documents share them.  For each pair of documents, matched seeds are chained in the order
of both (maximal score of matched words less gap costs, a Fenwick tree over places in the earlier document), and each chain
is aligned word by word and extended at both ends.  A passage is a stretch of an alignment of at least MIN_WORDS words in
which at least SIMILARITY of the words agree; the later document is its copy.

The first documents of a passage's seeds need not have the passage: they may hold fragments of it.  So every stretch of
MIN_WORDS words that another document may have (all its seeds are shared) is joined with the first document that has the
whole of it, and aligned there, too, unless it lies in a passage already found.  Every exact repeat of MIN_WORDS words is
found; the work is linear in the words.  A fuzzy repeat is found if two collinear seeds, or one whole stretch outside other
passages, lead to an earlier document with the passage.

Seeds and stretches that very many documents have are found on a sample first.  That only decides their route: their first
documents are aggregated map-side and broadcast (HOT_MOST at most), so no task gathers them; all others are sorted by hash.
Both routes are exact.

Null, empty and short texts have no passages.  Rows without an id are kept by :func:`clean` and otherwise ignored.  Rows of
one id count as one document, and each of its texts can be the source of a passage; repeats inside one document are no
matches.  ``clean`` carries all columns through, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.words import Words, as_bytes, blocks, mix, run_hashes, spare
from tessera.storage import materialise

KMER, WINDOW = 5, 8
MIN_WORDS, SIMILARITY = 50, 0.8
#: Chaining: words a matched seed is worth, cost of a skipped word, words that end a chain.
GAIN, GAP, BREAK = 5.0, 0.2, 40
#: Seeds of a chain at least; words looked at beyond its ends; words skipped at once in an alignment.
MIN_SEEDS, MARGIN, SKIP = 2, 32, 12
#: Sampled share of documents (one in) and share of them that makes a seed frequent; frequent seeds broadcast at most.
HOT_SAMPLE, HOT_SHARE, HOT_MOST = 64, 0.02, 50_000


def thinned(h: np.ndarray, part: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places that are the minimum of some window of ``window`` consecutive values of one ``part`` (sorted)."""
    if not len(h):
        return np.zeros(0, np.int64)
    pad = window - 1
    at = np.arange(len(h)) + (part - part[0] + 1) * pad
    line = np.full(at[-1] + pad + 1, np.uint64(2**64 - 1))
    line[at] = h
    low = np.lib.stride_tricks.sliding_window_view(line, window).min(axis=1)
    high = np.lib.stride_tricks.sliding_window_view(low, window).max(axis=1)  # over the windows that hold a place
    return np.flatnonzero(high[at - pad] == h)


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))


def seeds(rows: DataFrame, only=None, firsts=None) -> DataFrame:
    """``(g, hot, k, pos, rk, rpos)``: hash, document and first word of every thinned k-mer of ``(k, t)``.

    ``only`` (a broadcast sorted array) keeps the hashes in it.  ``firsts`` (broadcast sorted hashes with their first
    documents and places) resolves frequent seeds on the spot: they have ``rk``, and ``g`` deals them out evenly.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            ids = pdf["k"].to_numpy(np.int64)
            for first, block in blocks(as_bytes(pdf["t"])):
                w = Words(block, lower=True)
                at, h = w.ngrams(KMER)
                own = thinned(h, w.doc[at])
                at, h = at[own], h[own].view(np.int64)
                doc = w.doc[at]
                out = pd.DataFrame({"g": h, "hot": False, "k": ids[first + doc], "pos": (at - w.first[doc]).astype(np.int32), "rk": np.int64(0), "rpos": np.int32(0)})
                table = only.value if only is not None else firsts.value[0] if firsts is not None else np.zeros(0, np.int64)
                if len(table):
                    i = np.minimum(np.searchsorted(table, h), len(table) - 1)
                    hit = table[i] == h
                    if only is not None:
                        out = out[hit]
                    else:
                        i = i[hit]
                        spread = mix(ids[first + doc[hit]].view(np.uint64) + at[hit].astype(np.uint64)).view(np.int64)
                        out.loc[hit, ["g", "hot", "rk", "rpos"]] = pd.DataFrame({"g": spread, "hot": True, "rk": firsts.value[1][i], "rpos": firsts.value[2][i]}).set_index(out.index[hit])
                yield out

    return rows.where("k is not null and t is not null").mapInPandas(run, "g long, hot boolean, k long, pos int, rk long, rpos int")


def matches(rows: DataFrame) -> DataFrame:
    """``(k, pos, rk, rpos)``: every seed with its first occurrence (smallest id, then place) in an earlier document."""
    return _shared(rows).where("rk <> k")


def _shared(rows: DataFrame) -> DataFrame:
    """``(k, pos, rk, rpos)``: every seed that several documents have with its first occurrence, which may be itself."""
    spark = rows.sparkSession
    few = rows.where(F.pmod(F.xxhash64("k"), F.lit(HOT_SAMPLE)) == 0)
    n = few.count()
    hot = seeds(few).groupBy("g").agg(F.count_distinct("k").alias("n")).where(F.col("n") >= max(8, HOT_SHARE * n))
    frequent = np.array(sorted(r.g for r in hot.orderBy(F.desc("n"), "g").limit(HOT_MOST).collect()), np.int64)  # at most HOT_MOST
    firsts = None
    if len(frequent):
        found = seeds(rows, only=spark.sparkContext.broadcast(frequent)).groupBy("g").agg(F.min(F.struct("k", "pos")).alias("f"))
        found = found.orderBy("g").collect()  # one row for each frequent seed
        firsts = spark.sparkContext.broadcast((np.array([r.g for r in found], np.int64), np.array([r.f.k for r in found], np.int64), np.array([r.f.pos for r in found], np.int32)))
    w = W.partitionBy("g", "hot").orderBy("k", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    known = F.struct(F.col("rk").alias("k"), F.col("rpos").alias("pos"))
    found = seeds(rows, firsts=firsts).withColumn("f", F.when(F.col("hot"), known).otherwise(F.first(F.struct("k", "pos")).over(w)))
    last = F.last("k").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    found = found.withColumn("last", last).where("hot or f.k <> last")
    return found.select("k", "pos", F.col("f.k").alias("rk"), F.col("f.pos").alias("rpos"))


def stretches(pos: np.ndarray, words: int) -> list[tuple[int, int]]:
    """Ranges of first words of the stretches of MIN_WORDS words whose seeds may all be in ``pos``.

    Two documents with such a stretch in common share the minimum of each of its windows, so none of the windows is
    without a shared seed.
    """
    pos = np.unique(pos)
    cut = np.flatnonzero(np.diff(pos) > WINDOW) + 1
    inner = MIN_WORDS - KMER - WINDOW + 1  # first k-mer of the last window
    ranges = zip(pos[np.concatenate([[0], cut])] - WINDOW + 1, pos[np.concatenate([cut, [len(pos)]]) - 1] - inner, strict=True)
    found = [(max(0, int(a)), min(int(b), words - MIN_WORDS) + 1) for a, b in ranges]
    return [(a, b) for a, b in found if a < b]


def whole_matches(runs: DataFrame) -> DataFrame:
    """``(k, pos, rk, rpos)``: every stretch of ``(k, start, words)`` (hashes of consecutive stretches) with its first
    occurrence, where that is in an earlier document."""
    units = runs.select("k", "start", F.posexplode("words").alias("i", "g")).select("g", "k", (F.col("start") + F.col("i")).alias("pos"))
    sampled = F.pmod(F.xxhash64("k"), F.lit(HOT_SAMPLE)) == 0
    n = runs.where(sampled).select("k").distinct().count()
    hot = units.where(sampled).groupBy("g").agg(F.count_distinct("k").alias("n")).where(F.col("n") >= max(8, HOT_SHARE * n))
    hot = F.broadcast(materialise(hot.orderBy(F.desc("n"), "g").limit(HOT_MOST).select("g"), "hot"))  # at most HOT_MOST
    first = units.join(hot, "g", "left_semi").groupBy("g").agg(F.min(F.struct("k", "pos")).alias("f"))
    w = W.partitionBy("g").orderBy("k", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rest = units.join(hot, "g", "left_anti").withColumn("f", F.first(F.struct("k", "pos")).over(w))
    found = units.join(F.broadcast(first), "g").unionByName(rest)
    return found.where("f.k <> k").select("k", "pos", F.col("f.k").alias("rk"), F.col("f.pos").alias("rpos"))


class Fenwick:
    """Prefix maxima."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def get(self, i: int) -> tuple[float, int]:
        """The largest of the first ``i`` values."""
        out = (float("-inf"), -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chains(points: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Disjoint collinear chains of matched places, best first; each has at least MIN_SEEDS points.

    score(p) = GAIN + max(0, score(q) - GAP * words skipped from q to p) over q before p in both documents.  The cost
    is a difference of coordinate sums, so the best q is a prefix maximum of score(q) + GAP * sum(q).
    """
    points = sorted(set(points))
    ranks = sorted({r for _, r in points})
    tree = Fenwick(len(ranks))
    score, back = [0.0] * len(points), [-1] * len(points)
    waiting: list[tuple[int, tuple[float, int]]] = []
    for n, (d, r) in enumerate(points):
        if n and d != points[n - 1][0]:
            for i, value in waiting:
                tree.put(i, value)
            waiting = []
        i = bisect_right(ranks, r - 1)
        value, q = tree.get(i)
        gain = value - GAP * (d + r)
        if q >= 0 and gain > 0:
            score[n], back[n] = GAIN + gain, q
        else:
            score[n] = GAIN
        waiting.append((i, (score[n] + GAP * (d + r), n)))
    used, out = [False] * len(points), []
    for n in sorted(range(len(points)), key=lambda n: (-score[n], n)):
        chain = []
        while n >= 0 and not used[n]:
            used[n] = True
            chain.append(points[n])
            n = back[n]
        chain.reverse()
        start = 0
        for i in range(1, len(chain) + 1):
            if i == len(chain) or max(chain[i][0] - chain[i - 1][0], chain[i][1] - chain[i - 1][1]) > BREAK:
                if i - start >= MIN_SEEDS:
                    out.append(chain[start:i])
                start = i
    return out


def _run_length(a: np.ndarray, b: np.ndarray) -> int:
    """Equal values at the front of both arrays."""
    n, size = min(len(a), len(b)), 64
    done = 0
    while done < n:
        part = a[done : min(done + size, n)] != b[done : min(done + size, n)]
        i = int(part.argmax())
        if part[i]:
            return done + i
        done, size = done + len(part), size * 4
    return n


def align(a: np.ndarray, b: np.ndarray, skip: int = SKIP) -> list[tuple[int, int, int, int]]:
    """Greedy alignment from the front: ``(start in a, start in b, equal words, words skipped before)`` runs.

    After a mismatch the nearest place is taken, by words skipped, from which 3 words (or the rest) agree.
    """
    out, i, j, missed = [], 0, 0, 0
    while True:
        n = _run_length(a[i:], b[j:])
        if n:
            out.append((i, j, n, missed))
        i, j = i + n, j + n
        for total in range(1, 2 * skip + 1):
            step = next(
                ((x, total - x) for x in sorted(range(max(0, total - skip), min(skip, total) + 1), key=lambda x: abs(2 * x - total))
                 if i + x < len(a) and j + total - x < len(b) and a[i + x] == b[j + total - x] and _run_length(a[i + x : i + x + 3], b[j + total - x : j + total - x + 3]) == min(3, len(a) - i - x, len(b) - j - total + x)),
                None,
            )
            if step:
                break
        else:
            return out
        missed = max(step)
        i, j = i + step[0], j + step[1]


def longest(runs: list[tuple[int, int, int, int]], lo: int, hi: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """``(s, e)`` of the stretch ``runs[s:e]`` inside ``lo`` to ``hi`` with the most words whose sum of (1 - similarity) *
    equal - similarity * skipped words is not negative; ``(lo, lo)`` if there are no runs.

    A stretch's sum is ``after[its last run] - before[its first run]``.  Only starts whose ``before`` is below all earlier
    ones can be best, and going back from the last end, a start met once is met by no earlier end with more words.
    """
    before, after, total = [], [], 0.0
    for n in range(lo, hi):
        if n > lo:
            total -= similarity * max(runs[n][0] - runs[n - 1][0] - runs[n - 1][2], runs[n][1] - runs[n - 1][1] - runs[n - 1][2])
        before.append(total)
        total += (1 - similarity) * runs[n][2]
        after.append(total)
    starts: list[int] = []
    for i, x in enumerate(before):
        if not starts or x < before[starts[-1]]:
            starts.append(i)
    best, found = 0, (lo, lo)
    for i in range(len(after) - 1, -1, -1):
        while starts and after[i] - before[starts[-1]] >= -1e-9:
            n = starts.pop()
            size = runs[lo + i][0] + runs[lo + i][2] - runs[lo + n][0]
            if n <= i and size > best:
                best, found = size, (lo + n, lo + i + 1)
    return found


def passages(a: np.ndarray, b: np.ndarray, at: tuple[int, int], least: int = MIN_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """``(start, end, start in b, end in b, similarity)`` of passages around the matched place ``at``.

    Runs to both sides of ``at`` are aligned; the longest stretch whose sum of (1 - similarity) * equal - similarity *
    skipped words is not negative agrees in at least that share, and the rest on both sides is searched in turn.
    """
    i, j = at
    right = [(i + x, j + y, n, m) for x, y, n, m in align(a[i:], b[j:])]
    left = [(i - x - n, j - y - n, n, m) for x, y, n, m in align(a[:i][::-1], b[:j][::-1])][::-1]
    runs = left + right
    out, todo = [], [(0, len(runs))]
    while todo:
        lo, hi = todo.pop()
        s, e = longest(runs, lo, hi, similarity)
        if s < e:
            first, last = runs[s], runs[e - 1]
            size = max(last[0] + last[2] - first[0], last[1] + last[2] - first[1])
            if last[0] + last[2] - first[0] >= least:
                out.append((first[0], last[0] + last[2], first[1], last[1] + last[2], sum(r[2] for r in runs[s:e]) / size))
                todo += [(lo, s), (e, hi)]
    return out


def _request(k: int, rk: int, at: tuple[int, int], first: int, last: int, size: int = 0) -> tuple[int, int, int, int, int, int, int]:
    """``size`` is that of a whole stretch with ``at`` in its middle, and 0 for a chain."""
    return k, at[0], rk, at[1], max(0, (first - MARGIN) // 16 * 16), (last + MARGIN + 15) // 16 * 16, size


REQUEST = "k long, d0 int, rk long, r0 int, lo int, hi int, size int"


def _chained(rows: DataFrame) -> DataFrame:
    """``(k, d0, rk, r0, lo, hi, size, start, words)``: a matched place of each chain and the stretch of the earlier document to
    align with (``words`` is null), or hashes of stretches from word ``start`` on that other documents may have."""
    linked = _shared(rows).groupBy("k").agg(F.collect_list(F.struct("pos", "rk", "rpos")).alias("m")).where(F.size("m") >= MIN_SEEDS)
    linked = rows.where("t is not null").join(linked, "k").select("k", "t", *[F.col(f"m.{c}").alias(c) for c in ("pos", "rk", "rpos")])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for k, t, pos, rk, rpos in zip(pdf["k"], as_bytes(pdf["t"]), pdf["pos"], pdf["rk"], pdf["rpos"], strict=True):
                order = np.argsort(rk, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(rk[order])) + 1):
                    if len(own) >= MIN_SEEDS and rk[own[0]] != k:
                        for chain in chains(list(zip(pos[own].tolist(), rpos[own].tolist(), strict=True))):
                            out.append((*_request(k, int(rk[own[0]]), chain[len(chain) // 2], chain[0][1], chain[-1][1] + KMER), -1, None))
                if len(pos) >= MIN_WORDS // WINDOW - 1:
                    w = Words([t], lower=True)
                    for a, b in stretches(pos, len(w.hash)):
                        out.append((k, 0, 0, 0, 0, 0, 0, a, run_hashes(w.hash[a : b + MIN_WORDS - 1], MIN_WORDS).view(np.int64)))
            yield pd.DataFrame(out, columns=["k", "d0", "rk", "r0", "lo", "hi", "size", "start", "words"])

    return linked.mapInPandas(run, REQUEST + ", start int, words array<long>")


def cover(start: np.ndarray, end: np.ndarray) -> list[int]:
    """The fewest of the ranges that together hold all that they all hold, from left to right."""
    by, out = np.lexsort((-end, start)).tolist(), []
    reach, best = -1, -1
    for n in [*by, -1]:
        if best >= 0 and (n < 0 or start[n] > reach):  # no other range starts inside what is held: take the farthest
            out.append(best)
            reach, best = int(end[best]), -1
        if n >= 0:
            if start[n] > reach:
                reach = int(start[n])
            if end[n] > reach and (best < 0 or end[n] > end[best]):
                best = n
    return out


def _wholes(chained: DataFrame, runs: DataFrame) -> DataFrame:
    """``(k, d0, rk, r0, lo, hi, size)`` of whole stretches in an earlier document that no chain is aligned in.

    Neighbouring stretches that lie alike in one earlier document are one run.  As few runs are taken as hold all words of
    all runs: texts that repeat a line have a run for every word, and nearly all of them say the same.
    """
    have = chained.select("k", F.col("d0").alias("pos"), "rk", F.col("r0").alias("rpos"), F.lit(True).alias("chain"))
    links = whole_matches(runs).withColumn("chain", F.lit(False)).unionByName(have)
    links = links.groupBy("k").agg(F.collect_list(F.struct("rk", "pos", "rpos", "chain")).alias("m")).where(F.exists("m", lambda x: ~x["chain"]))
    links = links.select("k", *[F.col(f"m.{c}").alias(c) for c in ("rk", "pos", "rpos", "chain")])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for k, rk, pos, rpos, chain in zip(pdf["k"], pdf["rk"], pdf["pos"], pdf["rpos"], pdf["chain"], strict=True):
                chain, side = chain.astype(bool), pos - rpos
                aligned: dict[tuple[int, int], list[int]] = {}
                for r, d, p in zip(rk[chain].tolist(), side[chain].tolist(), pos[chain].tolist(), strict=True):
                    aligned.setdefault((r, d), []).append(p)
                rk, pos, side = rk[~chain], pos[~chain], side[~chain]
                by = np.lexsort((pos, side, rk))
                rk, pos, side = rk[by], pos[by], side[by]
                cut = np.flatnonzero((np.diff(rk) != 0) | (np.diff(side) != 0) | (np.diff(pos) > 1)) + 1
                first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(pos)]]) - 1
                start, end = pos[first], pos[last] + MIN_WORDS
                for n in cover(start, end):
                    a, b, r, d = int(start[n]), int(end[n]), int(rk[first[n]]), int(side[first[n]])
                    if not any(a <= p < b for p in aligned.get((r, d), ())):
                        out.append(_request(k, r, ((a + b) // 2, (a + b) // 2 - d), a - d, b - d, b - a))
            yield pd.DataFrame(out, columns=["k", "d0", "rk", "r0", "lo", "hi", "size"])

    return links.mapInPandas(run, REQUEST)


def _requests(rows: DataFrame) -> DataFrame:
    """``(k, chains)``: each document's chains with the word hashes of the earlier stretches."""
    linked = materialise(_chained(rows), "links")
    chained = linked.where("words is null").drop("start", "words")
    found = materialise(chained.unionByName(_wholes(chained, linked.where("words is not null").select("k", "start", "words"))).distinct(), "chains")
    wanted = found.select("rk", "lo", "hi").distinct().groupBy("rk").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    earlier = rows.withColumnRenamed("k", "rk").join(wanted, "rk")
    earlier = earlier.withColumn("x", F.xxhash64("t")).dropDuplicates(["rk", "x"]).drop("x")  # each text of an id once

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for rk, t, wanted in zip(pdf["rk"], as_bytes(pdf["t"]), pdf["parts"], strict=True):
                h = (Words([t], lower=True).hash >> np.uint64(32)).astype(np.uint32).view(np.int32)
                out += [(rk, x["lo"], x["hi"], h[x["lo"] : x["hi"]]) for x in wanted]
            yield pd.DataFrame(out, columns=["rk", "lo", "hi", "words"])

    asked = earlier.mapInPandas(cut, "rk long, lo int, hi int, words array<int>")
    return found.join(asked, ["rk", "lo", "hi"]).groupBy("k").agg(F.collect_list(F.struct("d0", "rk", "r0", "lo", "size", "words")).alias("chains"))


def _resolve(text: bytes, asked) -> tuple[Words, list[tuple[int, int, int, int, int, float]]]:
    """Passages of one document, without those inside a longer one; whole stretches that chains left out, longest first."""
    w = Words([text], lower=True)
    own = (w.hash >> np.uint64(32)).astype(np.uint32).view(np.int32)
    found: set[tuple[int, int, int, int, int, float]] = set()
    for x in sorted(asked, key=lambda x: (x["size"] > 0, -x["size"], x["d0"], x["rk"], x["r0"])):
        a = x["d0"] - x["size"] // 2
        if x["size"] and any(p[0] <= a and a + x["size"] <= p[1] for p in found):
            continue
        for s, e, rs, re, sim in passages(own, np.asarray(x["words"], np.int32), (x["d0"], x["r0"] - x["lo"])):
            found.add((s, e, x["rk"], rs + x["lo"], re + x["lo"], sim))
    out: list[tuple[int, int, int, int, int, float]] = []
    reach = -1
    for p in sorted(found, key=lambda p: (p[0], -p[1], p[2:])):
        if p[1] > reach:
            out.append(p)
            reach = p[1]
    return w, out


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, start_word, end_word, source_id, source_start, source_end, similarity)`` of every later copy."""
    rows = _rows(df, key, text)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [(k, *p) for k, t, c in zip(pdf["k"], as_bytes(pdf["t"]), pdf["chains"], strict=True) for p in _resolve(t, c)[1]]
            yield pd.DataFrame(out, columns=["doc_id", "start_word", "end_word", "source_id", "source_start", "source_end", "similarity"])

    schema = f"{key} long, start_word int, end_word int, source_id long, source_start int, source_end int, similarity double"
    named = lambda it: (p.rename(columns={"doc_id": key}) for p in run(it))
    return rows.join(_requests(rows), "k").mapInPandas(named, schema)


def clean(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns, with the later copies of passages cut out of ``text``.

    Words of a copy go with the white space after them; a row whose words all go has an empty text.  Texts are cut once,
    by one Python worker a task, whatever is asked of the result.
    """
    rows = _rows(df, key, text)
    own, chains = spare(df.columns, "k"), spare(df.columns, "chains")
    asked = _requests(rows).select(F.col("k").alias(own), F.col("chains").alias(chains))
    joined = df.join(asked, df[key].cast("long") == asked[own], "left").drop(own)

    @F.pandas_udf("string")
    def run(rows: pd.Series, chains: pd.Series) -> pd.Series:
        texts = list(rows)
        for n, c in enumerate(chains):
            if c is not None and len(c) and isinstance(texts[n], str):
                raw = texts[n].encode("utf-8", "surrogatepass")
                w, found = _resolve(raw, c)
                gone, kept, at = np.zeros(len(w.start) + 2, np.int8), [], 0
                for p in found:
                    gone[p[0] + 1 : p[1] + 1] = 1
                edge = np.flatnonzero(np.diff(gone))
                for a, b in zip(edge[0::2], edge[1::2], strict=True):
                    kept.append(raw[at : w.start[a]])
                    at = w.start[b] if b < len(w.start) else len(raw)
                if len(edge):
                    texts[n] = b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")
        return pd.Series(texts, dtype=object)

    # a filter on the cleaned text would be pushed below a deterministic function and have every text cut twice
    return joined.withColumn(text, run.asNondeterministic()(F.col(text), F.col(chains))).drop(chains)
