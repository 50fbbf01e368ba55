"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of white-space words (A-Z lower-cased), and a document matches an item if some part of it is within an
edit distance of MAX_EDIT of the item's words.  The CGK embedding walks a sequence of symbols, one for each two neighbouring
words, with random bits: at step j it writes the symbol under its pointer and advances if the j-th random function of
that symbol says so.  Edit distance between two sequences becomes Hamming distance between their embeddings.  A repetition
samples up to WIDTH places of the embedding, fewer for short items; a window of a document is a candidate for an item if all
sampled symbols are equal.

Every repetition starts its walk at its own relative offset of the item and window, so that a window is any word position
minus that offset and all windows of all sizes are met in one pass: the first sampled symbol is looked up for every
position of every document, and a walk goes on only where the partial key is still that of some item.  Nothing that shares
a bucket is left out by this.  The number of repetitions follows from the target recall and the distance allowed.

Candidates are verified: the best fitting part of the widened window is found exactly.  Items of one word (also those of a
script without spaces) are looked up as they are.  Items are taken in blocks of ITEMS_AT_ONCE, each broadcast.

Null or blank documents and items match nothing.  Repeated items are looked up once and reported under each id; documents
with equal ids are reported apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import Words, as_bytes, blocks, mix

#: Edit distance allowed, as a share of the item's words.
MAX_EDIT = 0.2
#: Sampled places at most, an item's words for each of them after the first, and the recall that the search is made for.
WIDTH, WORDS_A_PLACE, RECALL = 3, 12, 0.999
ITEMS_AT_ONCE = 5000
_TABLE_BITS = 22


def repetitions(width: int = WIDTH, damage: float = MAX_EDIT, recall: float = RECALL) -> int:
    """Walks needed: one survives if both words of its sampled symbols and one more are undamaged."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - damage) ** (2 * width + 1)))


def symbols(w: Words) -> np.ndarray:
    """A hash for each word and the word after it in the same text; the last word of a text has none of meaning."""
    after = np.zeros(len(w.hash), np.uint64)
    after[:-1] = w.hash[1:]
    return mix(w.hash * np.uint64(0x9FB21C651E98DF25) + after)


def _start(offset: float, pairs: int, width: int) -> int:
    """Where a walk begins in an item: anywhere if one place is sampled, else so that the walk has room."""
    room = pairs if width == 1 or pairs < WORDS_A_PLACE else max(1, pairs - 3 * width)
    return int(offset * room)


class _Walk:
    """One repetition: relative offset, random functions, sampled steps (the first is 0)."""

    def __init__(self, number: int, total: int, width: int):
        r = np.random.default_rng([2016, number])
        self.offset = (number + 0.5) / total
        self.steps = 4 * np.arange(width) + np.concatenate([[0], r.integers(0, 4, width - 1)])
        self.seeds = r.integers(1, 1 << 63, int(self.steps[-1]) + 1, dtype=np.uint64) | np.uint64(1)

    def advance(self, at: np.ndarray, hashes: np.ndarray, step: int) -> np.ndarray:
        word = hashes[np.minimum(at, len(hashes) - 1)]
        return at + (mix(word ^ self.seeds[step]) >> np.uint64(63)).astype(np.int64)


class Items:
    """Buckets of the benchmark items: for each walk and sampled place the keys up to there."""

    def __init__(self, ids: list[int], texts: list[str], width: int, total: int):
        by_text: dict[str, list[int]] = {}
        for i, t in zip(ids, texts, strict=True):
            if clean := " ".join(normal(t).split()):
                by_text.setdefault(clean, []).append(i)
        self.texts, self.ids = list(by_text), list(by_text.values())
        words = [Words([t.encode("utf-8", "surrogatepass")]) for t in self.texts]
        self.words = [w.hash.tolist() for w in words]
        alone = sorted((h[0], n) for n, h in enumerate(self.words) if len(h) == 1)
        self.alone = np.array([h for h, _ in alone], np.uint64), np.array([n for _, n in alone], np.int64)
        pairs = [symbols(w)[:-1] for w in words]
        self.walks = [_Walk(n, total, width) for n in range(total)]
        self.keys: list[list[np.ndarray]] = []
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.first = np.zeros(1 << _TABLE_BITS, bool)  # first sampled symbols of any walk
        for walk in self.walks:
            grown, full = [[] for _ in walk.steps], []
            for n, h in enumerate(pairs):
                if not len(h):
                    continue
                start = _start(walk.offset, len(h), width)
                most = min(width, 1 + len(h) // WORDS_A_PLACE)
                at, key, k = np.array([start]), np.zeros(1, np.uint64), 0
                for step in range(int(walk.steps[most - 1]) + 1):
                    if at[0] >= len(h):
                        break
                    if step == walk.steps[k]:
                        key = mix(key * np.uint64(3) + h[at])
                        grown[k].append(key[0])
                        k += 1
                    at = walk.advance(at, h, step)
                full.append((key[0], n, start, k))  # short items end early: their key has fewer places
            self.keys.append([np.unique(np.array(g, np.uint64)) for g in grown])
            full.sort()
            self.rows.append(tuple(np.array(c, t) for c, t in zip(zip(*full, strict=True), (np.uint64, np.int64, np.int64, np.int64), strict=True)) if full else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3))
            self.first[np.array(grown[0], np.uint64) >> np.uint64(64 - _TABLE_BITS)] = True

    def candidates(self, w: Words) -> Iterator[tuple[int, int, int]]:
        """Distinct ``(text, item, first word of the window)`` of a block of texts; the window may begin before the text."""
        found: list[np.ndarray] = []
        own = symbols(w)
        hit = np.flatnonzero(np.isin(w.hash, self.alone[0]))
        for n in range(int(np.unique(self.alone[0], return_counts=True)[1].max(initial=0))):
            row = np.searchsorted(self.alone[0], w.hash[hit]) + n
            same = (row < len(self.alone[0])) & (self.alone[0][np.minimum(row, len(self.alone[0]) - 1)] == w.hash[hit])
            found.append(np.stack([w.doc[hit[same]], self.alone[1][row[same]], hit[same]], 1))
        opening = np.flatnonzero(self.first[mix(own) >> np.uint64(64 - _TABLE_BITS)])
        last = w.first[w.doc + 1] - 1 if len(w.doc) else np.zeros(0, np.int64)  # the last word has no pair
        for walk, keys, rows in zip(self.walks, self.keys, self.rows, strict=True):
            begin, at, key, k = opening, opening, np.zeros(len(opening), np.uint64), 0
            for step in range(int(walk.steps[-1]) + 1):
                live = at < last[begin]
                begin, at, key = begin[live], at[live], key[live]
                if step == walk.steps[k]:
                    key = mix(key * np.uint64(3) + own[at])
                    known = keys[k]
                    i = np.searchsorted(known, key)
                    live = np.zeros(len(key), bool)
                    inside = i < len(known)
                    live[inside] = known[i[inside]] == key[inside]
                    begin, at, key = begin[live], at[live], key[live]
                    k += 1
                    a, b = np.searchsorted(rows[0], key, "left"), np.searchsorted(rows[0], key, "right")
                    for n in range(int((b - a).max(initial=0))):
                        hit = a + n < b
                        row = (a + n)[hit]
                        ends = rows[3][row] == k
                        first = begin[hit][ends]
                        found.append(np.stack([w.doc[first], rows[1][row][ends], first - rows[2][row][ends]], 1))
                if not len(begin):
                    break
                at = walk.advance(at, own, step)
        if found:
            yield from map(tuple, np.unique(np.concatenate(found), axis=0).tolist())


    def windows(self, w: Words, max_edit: float) -> Iterator[tuple[int, int, int, int]]:
        """``(text, item, first word, end)``: candidates widened by the edits allowed; overlapping ones are one window."""
        held: list[int] | None = None
        for d, n, at in self.candidates(w):
            size = len(self.words[n])
            slack = 2 + int(size * max_edit) + size // 4
            lo, hi = max(at - slack, int(w.first[d])), min(at + size + slack, int(w.first[d + 1]))
            if lo >= hi:
                continue
            if held is not None and held[:2] == [d, n] and lo <= held[3]:
                held[3] = hi
                continue
            if held is not None:
                yield tuple(held)
            held = [d, n, lo, hi]
        if held is not None:
            yield tuple(held)


def normal(text: str) -> str:
    """A-Z lower-cased."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def best_fit(pattern: Sequence, text: Sequence, most: int) -> tuple[int, int] | None:
    """``(edit distance, end)`` of the part of ``text`` closest to ``pattern``, if at most ``most``; the first such end.

    Exact: columns of the dynamic program are bit vectors (Myers, 1999) with free ends in ``text``.
    """
    m = len(pattern)
    where: dict = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (m + 1, 0)
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        right_down, right_up = down | (full & ~(d0 | up)), up & d0
        score += bool(right_down & top) - bool(right_up & top)
        right_down = (right_down << 1) & full
        right_up = (right_up << 1) & full
        up, down = right_up | (full & ~(d0 | right_down)), right_down & d0
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", max_edit: float = MAX_EDIT, width: int = WIDTH, recall: float = RECALL) -> DataFrame:
    """``(doc_id, item_id, edit, start, end)``: for each document and item the best passage within the allowed distance.

    ``edit`` counts words.  ``start`` and ``end`` are offsets in the document's words joined by single spaces.  ``items`` has item_id and text;
    its size is counted, and beyond ITEMS_AT_ONCE it is dealt into blocks by a hash of the text.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long"), F.col("text")).where("text is not null and item_id is not null")
    parts = max(1, -(-items.count() // ITEMS_AT_ONCE))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(docs.dtypes)[key]
    found = None
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).orderBy("item_id").collect()
        shared = spark.sparkContext.broadcast(Items([r.item_id for r in own], [r.text for r in own], width, repetitions(width, max_edit, recall)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            bench = shared.value
            for pdf in batches:
                out = []
                texts = as_bytes(pdf["t"])
                for first, block in blocks(texts):
                    w = Words(block, lower=True)
                    best: dict[tuple[int, int], tuple[int, int, int]] = {}
                    for d, n, lo, hi in bench.windows(w, max_edit):
                        item, window = bench.words[n], w.hash[lo:hi].tolist()
                        if fit := best_fit(item, window, int(max_edit * len(item) + 1e-9)):
                            back = best_fit(item[::-1], window[: fit[1]][::-1], fit[0])
                            now = (fit[0], lo + fit[1] - back[1], lo + fit[1])
                            if (d, n) not in best or now < best[d, n]:
                                best[d, n] = now
                    for (d, n), (edit, a, b) in best.items():
                        start = len(b" ".join(_words(w, int(w.first[d]), a)).decode("utf-8", "surrogatepass"))
                        start += start > 0
                        end = start + len(b" ".join(_words(w, a, b)).decode("utf-8", "surrogatepass"))
                        out += [(pdf["k"].iloc[first + d], i, edit, start, end) for i in bench.ids[n]]
                yield pd.DataFrame(out, columns=["k", "item_id", "edit", "start", "end"])

        one = rows.mapInPandas(run, f"k {kind}, item_id long, edit int, start long, end long")
        found = one if found is None else found.union(one)
    return found.withColumnRenamed("k", key)


def _words(w: Words, a: int, b: int) -> list[bytes]:
    return [w.buffer[s:e].tobytes() for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)]
