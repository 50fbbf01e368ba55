"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier.

Inside a task the suffixes of many strings are sorted column by column (Bauer, Cox and Rosone): every round inserts one
more symbol of every string, from the right, into the collection's Burrows-Wheeler transform; a symbol's new row follows
from the counts of symbols in rows above it.  Common prefixes are then measured column by column from the left, each from
the column before it less one.  Runs of neighbouring suffixes with common prefixes of LENGTH bytes are the repeated strings.

One transform over whole documents would need as many passes over all data as the longest document has bytes.  So a
document is cut into segments first, and the same string always falls into segments that meet in one task: every
100-byte window is assigned to the leftmost smallest of its 32-byte grams, its anchor, by hash, and windows that follow one
another with the same anchor are one segment (at most 168 bytes).  Equal windows have equal anchors at equal offsets, so
they meet under the anchor's hash and nothing is lost.  Equal segments are one string for the transform: all but the first
in document order are copies, which already follows.  Any 100-byte window holds its anchor with 34 more bytes on at least
one side, so only segments that share those 66 bytes with another one are compared at all.  A transform works on a batch of
at most BATCH strings in memory, so its columns need no external files.

Equal segments of one batch of texts are found before anything is shuffled.  Anchors that a share of the documents has (found
on a sample, which only decides their route) and those with more than GROUP different segments are handled window by window
instead, aggregated map-side, so no anchor gathers in a task.

Texts are UTF-8 bytes; null is empty.  Documents shorter than LENGTH lose nothing.  Rows that share an id are ordered by the
hash of their text, as if their ids followed one another; rows with equal id and equal text are one document, and each of them
is returned with its bytes removed.  Rows with a null id come first in the order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import as_bytes, mix
from tessera.storage import materialise

LENGTH, GRAM = 100, 32
#: Strings of a transform; different segments of an anchor beyond which its windows are aggregated.
BATCH, GROUP = 8192, 4096
#: Sampled share of documents (one in) and share of them that makes an anchor frequent; frequent anchors broadcast at most.
HOT_SAMPLE, HOT_SHARE, HOT_MOST = 64, 0.05, 50_000
#: Bytes beside an anchor that a window has on its fuller side.
_BESIDE = (LENGTH - GRAM) // 2
_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_NULL = -(1 << 63)  # stands for a null id in the order


def _windows_min(v: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` consecutive values, by doubling."""
    size = 1
    while size * 2 <= n:
        v = np.minimum(v[: len(v) - size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (n - size)], v[n - size :]) if size < n else v


def segments(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For blocks of texts, rows of (text, start, length, anchor offset, anchor hash, content hash, left, right).

    ``left`` and ``right`` are hashes of the anchor with _BESIDE bytes on that side, or of the content where they lack.
    """
    pieces: list[tuple[int, int, bytes]] = []
    size = 0
    for n, t in enumerate(texts):
        for base in range(0, max(1, len(t) - LENGTH + 1), _BLOCK):
            part = t[base : base + _BLOCK + LENGTH - 1]
            if len(part) >= LENGTH:
                pieces.append((n, base, part))
                size += len(part)
            if size >= _BLOCK:
                yield _segments(pieces)
                pieces, size = [], 0
    if pieces:
        yield _segments(pieces)


def _segments(pieces: list[tuple[int, int, bytes]]) -> np.ndarray:
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    sizes = np.array([len(p[2]) for p in pieces])
    end = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(pieces)), sizes)
    symbol = mix(data.astype(np.uint64) + np.uint64(0x51ED27))
    h, base, k = symbol, _BASE, 1
    while k < GRAM:  # hashes of 2, 4, ... bytes
        h = h[: len(h) - k] * np.uint64(base) + h[k:]
        base, k = base * base % (1 << 64), k * 2
    h = mix(h)
    bits = int(len(data)).bit_length()
    packed = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
    low = _windows_min(packed, LENGTH - GRAM + 1)
    anchor = (low & np.uint64((1 << bits) - 1)).astype(np.int64)
    inside = piece[: len(anchor)] == piece[LENGTH - 1 : LENGTH - 1 + len(anchor)]
    first = inside & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~inside[:-1]])
    last = inside & np.concatenate([(anchor[1:] != anchor[:-1]) | ~inside[1:], [True]])
    s, e = np.flatnonzero(first), np.flatnonzero(last) + LENGTH
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), np.uint64(_BASE))]))
    down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), np.uint64(pow(_BASE, -1, 1 << 64)))]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(symbol * up[:-1])])
    content = mix((total[e] - total[s]) * down[s])
    a = anchor[s]
    has_left, has_right = a - s >= _BESIDE, e - a >= GRAM + _BESIDE
    x, y = np.where(has_left, a - _BESIDE, s), np.where(has_right, a + GRAM + _BESIDE, e)
    left = np.where(has_left, mix((total[a + GRAM] - total[x]) * down[x]), content)
    right = np.where(has_right, mix((total[y] - total[a]) * down[a]), content)
    at = piece[s]
    start = s - (end - sizes)[at] + np.array([p[1] for p in pieces])[at]
    text = np.array([p[0] for p in pieces])[at]
    short = [v.astype(np.uint32).view(np.int32).astype(np.int64) for v in (left, right)]
    return np.stack([text, start, e - s, a - s, h[a].view(np.int64), content.view(np.int64), *short], 1)


def _ranks(bwt: np.ndarray) -> np.ndarray:
    """For each row the number of rows with a smaller symbol, or an equal one further up."""
    rank = np.empty(len(bwt), np.int64)
    rank[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    return rank


def suffix_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(string, suffix length)`` of all suffixes in sorted order, by rounds of insertion into the collection's BWT.

    Row r of the transform holds the symbol before row r's suffix, or 256 while it is not known (the string's front).
    A filled symbol stands for the suffix it starts, so the row of a new suffix is the number of filled symbols that are
    smaller, or equal and above it, after the empty suffixes.  Only the symbols move; at the end each string is read off
    the transform from its empty suffix on.
    """
    m = len(strings)
    size = np.fromiter(map(len, strings), np.int64, m)
    longest = int(size.max(initial=0))
    right = np.zeros((longest, m), np.uint8)  # row j: the symbol j places from the end
    for n, s in enumerate(strings):
        right[: len(s), n] = np.frombuffer(s, np.uint8)[::-1]
    bwt = np.full(m, 256, np.int16)
    row = np.arange(m)
    for j in range(longest):
        live = np.flatnonzero(size > j)
        bwt[row[live]] = right[j, live]
        row[live] = m + _ranks(bwt)[row[live]]
        grown = np.full(len(bwt) + len(live), 256, np.int16)
        old = np.ones(len(grown), bool)
        old[row[live]] = False
        grown[old] = bwt
        bwt = grown
    rank = m + _ranks(bwt)
    owner, length = np.empty(len(bwt), np.int32), np.empty(len(bwt), np.int16)
    at, live = np.arange(m), np.arange(m)
    for j in range(longest + 1):
        owner[at], length[at] = live, j
        more = size[live] > j
        live = live[more]
        at = rank[at[more]]
    return owner, length


def common_prefixes(strings: list[bytes], owner: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
    """For each row the common prefix with the row above, up to ``most``; measured column by column from the left."""
    m = len(strings)
    size = np.fromiter(map(len, strings), np.int64, m)
    longest = int(size.max(initial=0))
    flat = np.frombuffer(b"".join(strings) + b"\0", np.uint8)
    end = np.cumsum(size)
    place = np.zeros((longest + 1, m), np.int64)
    place[length, owner] = np.arange(len(owner))
    out = np.zeros(len(owner), np.int64)
    have = np.zeros(m, np.int64)
    for col in range(longest):
        live = np.flatnonzero(size > col)
        rows = place[size[live] - col, live]
        above = np.maximum(rows - 1, 0)
        n = np.maximum(have[live] - 1, 0)
        left, other = length[rows].astype(np.int64), length[above].astype(np.int64)
        room = np.minimum(np.minimum(left, other), most)
        n = np.minimum(n, room)
        a, b = end[live] - left, end[owner[above]] - other
        going = np.flatnonzero(n < room)
        while len(going):
            same = flat[a[going] + n[going]] == flat[b[going] + n[going]]
            going = going[same]
            n[going] += 1
            going = going[n[going] < room[going]]
        n[rows == 0] = 0
        out[rows] = n
        have[live] = n
    return out


def repeats(strings: list[bytes], order: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(strings, offsets)`` of every LENGTH-byte window that also starts earlier, by ``(order, start + offset)``."""
    owner, length = suffix_order(strings)
    prefix = common_prefixes(strings, owner, length, LENGTH)
    long = length >= LENGTH
    group = np.cumsum(~((prefix >= LENGTH) & long))
    rows = np.flatnonzero(long)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    own = owner[rows]
    offset = size[own] - length[rows]
    key = np.lexsort((start[own] + offset, order[own], group[rows]))
    g = group[rows][key]
    later = np.concatenate([[False], g[1:] == g[:-1]])
    return own[key][later], offset[key][later].astype(np.int64)


def _merged(k: np.ndarray, v: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same bytes as few runs: rows of one document that touch or overlap are one."""
    by = np.lexsort((s, v, k))
    k, v, s, e = k[by], v[by], s[by], e[by]
    doc = np.cumsum(np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])) if len(k) else np.zeros(0, np.int64)
    span = int(e.max(initial=0)) + 1
    reach = np.maximum.accumulate(e + doc * span)  # documents do not reach into one another
    opens = np.flatnonzero(np.concatenate([[True], s[1:] + doc[1:] * span > reach[:-1]])) if len(k) else doc
    closes = np.concatenate([opens[1:], [len(k)]])[: len(opens)] - 1
    return k[opens], v[opens], s[opens], reach[closes] - doc[closes] * span


#: A segment: anchor, content, left and right hash, document (id and hash of the text), start, length, and its route:
#: 0 the first of its content so far, 1 bytes to remove, 2 of a frequent anchor.
_COLUMNS = ["h", "c", "l", "r", "k", "v", "s", "n", "route"]
_SEGMENT = "h long, c long, l int, r int, k long, v long, s int, n int, route byte"


def _frame(columns: list[np.ndarray]) -> pd.DataFrame:
    types = {"l": np.int32, "r": np.int32, "s": np.int32, "n": np.int32, "route": np.int8}
    return pd.DataFrame({c: x.astype(types.get(c, np.int64)) for c, x in zip(_COLUMNS, columns, strict=True)})


def _as_removed(k: np.ndarray, v: np.ndarray, s: np.ndarray, e: np.ndarray) -> pd.DataFrame:
    k, v, s, e = _merged(k, v, s, e)
    none = np.zeros(len(k), np.int64)
    return _frame([none, none, none, none, k, v, s, e - s, none + 1])


def _cut(rows: DataFrame, hot=None) -> DataFrame:
    """Segments of ``(k, v, t)``; those equal to an earlier one of the same batch are bytes to remove.

    ``hot`` is a broadcast sorted array of frequent anchors.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = hot.value if hot is not None else np.zeros(0, np.int64)
        for pdf in parts:
            ids, hashes = pdf["k"].to_numpy(np.int64), pdf["v"].to_numpy(np.int64)
            got = list(segments(as_bytes(pdf["t"])))
            if not got:
                continue
            r = np.concatenate(got)
            k, v, s, n, o, h, c = ids[r[:, 0]], hashes[r[:, 0]], *(r[:, i] for i in range(1, 6))
            by = np.lexsort((s, v, k, c, h))
            key = np.stack([h, c, n, o, k, v, s], 1)[by]
            same = np.concatenate([np.zeros((1, 7), bool), key[1:] == key[:-1]])
            copy, again = same[:, :4].all(axis=1), same.all(axis=1)
            gone = by[copy & ~again]
            if len(gone):
                yield _as_removed(k[gone], v[gone], s[gone], s[gone] + n[gone])
            own = by[~copy]
            at = np.minimum(np.searchsorted(frequent, h[own]), max(0, len(frequent) - 1))
            often = frequent[at] == h[own] if len(frequent) else np.zeros(len(own), bool)
            yield _frame([h[own], c[own], r[own, 6], r[own, 7], k[own], v[own], s[own], n[own], 2 * often])

    return rows.mapInPandas(run, _SEGMENT)


def _shares(h: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Rows whose anchor and side hash another row has too."""
    key = mix(h.view(np.uint64) + np.uint64(_BASE) * side.view(np.uint64))
    by = np.argsort(key)
    same = key[by][1:] == key[by][:-1]
    out = np.zeros(len(h), bool)
    out[by[1:][same]] = out[by[:-1][same]] = True
    return out


def _sift(cut: DataFrame) -> DataFrame:
    """Bytes to remove, and the first of each segment that may share a window with another; others go.

    One streaming pass over sorted rows.  Rows are held until their anchor is complete, GROUP of them at most: a larger
    anchor's are all passed on.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((0, 8), np.int64)  # first segments of the anchor that the last row has
        passing = False  # whether that anchor was found too large to hold
        tail: np.ndarray | None = None  # the last row

        def sifted(rows: np.ndarray) -> pd.DataFrame:
            met = np.concatenate([[False], rows[1:, 0] == rows[:-1, 0]]) if len(rows) else np.zeros(0, bool)
            rows = rows[met | np.concatenate([met[1:], [False]])] if len(rows) else rows
            rows = rows[_shares(rows[:, 0].copy(), rows[:, 2].copy()) | _shares(rows[:, 0].copy(), rows[:, 3].copy())]
            return _frame([*rows.T, np.zeros(len(rows), np.int64)])

        for pdf in parts:
            dealt = pdf["route"].to_numpy() != 0
            if dealt.any():
                yield pdf[dealt]
                pdf = pdf[~dealt]
            if not len(pdf):
                continue
            rows = pdf[_COLUMNS[:8]].to_numpy(np.int64)
            before = np.concatenate([rows[:1] if tail is None else tail[None], rows[:-1]])
            same = rows == before
            if tail is None:
                same[0] = False
            copy = same[:, :2].all(axis=1) & same[:, 7]
            again = copy & same[:, 4:7].all(axis=1)  # the same place of a repeated row
            tail = rows[-1]
            gone = rows[copy & ~again]
            if len(gone):
                yield _as_removed(gone[:, 4], gone[:, 5], gone[:, 6], gone[:, 6] + gone[:, 7])
            own = rows[~copy]
            if passing:
                more = own[:, 0] == before[0, 0]
                yield _frame([*own[more].T, np.zeros(int(more.sum()), np.int64)])
                own = own[~more]
                passing = bool(tail[0] == before[0, 0])
            own = np.concatenate([held, own])
            whole = own[:, 0] != tail[0]
            held = own[~whole]
            yield sifted(own[whole])
            if len(held) > GROUP:
                yield _frame([*held.T, np.zeros(len(held), np.int64)])
                held, passing = held[:0], True
        yield sifted(held)

    dealt_by = F.when(F.col("route") == 0, F.col("h")).otherwise(F.xxhash64("k", "s"))
    return cut.repartition(dealt_by).sortWithinPartitions("h", "c", "k", "v", "s").mapInPandas(run, _SEGMENT)


def _bytes_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(h, k, v, s, n, many, b)``: the bytes of wanted segments, fetched by one join by document."""
    asked = wanted.groupBy("k", "v").agg(F.collect_list(F.struct("h", "s", "n", "many")).alias("asked"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [
                (x["h"], k, v, x["s"], x["n"], x["many"], b)
                for k, v, t, asked in zip(pdf["k"], pdf["v"], as_bytes(pdf["t"]), pdf["asked"], strict=True)
                for x in asked
                if len(b := t[x["s"] : x["s"] + x["n"]]) == x["n"]
            ]
            yield pd.DataFrame(out, columns=["h", "k", "v", "s", "n", "many", "b"])

    return rows.join(asked, ["k", "v"]).mapInPandas(run, "h long, k long, v long, s int, n int, many boolean, b binary")


def _by_transform(found: DataFrame) -> DataFrame:
    """``(k, v, s, e)``: repeated runs of segments whose anchors meet in a task, batch by batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0

        def solve(last: bool) -> pd.DataFrame:
            nonlocal count
            rows = pd.concat(held)
            h = rows["h"].to_numpy(np.int64)
            upto = len(h) if last else int(np.flatnonzero(h != h[-1])[-1] + 1) if (h != h[-1]).any() else 0
            held[:] = [rows.iloc[upto:]]
            count = len(h) - upto
            rows = rows.iloc[:upto].drop_duplicates(["h", "k", "v", "s"])
            k, v, s = (rows[c].to_numpy(np.int64) for c in ("k", "v", "s"))
            doc = np.empty(len(k), np.int64)  # place of the document in the order
            by = np.lexsort((v, k))
            doc[by] = np.cumsum(np.concatenate([[0], (k[by][1:] != k[by][:-1]) | (v[by][1:] != v[by][:-1])])[: len(k)])
            n, o = repeats(list(rows["b"]), doc, s)
            k, v, s, e = _merged(k[n], v[n], s[n] + o, s[n] + o + LENGTH)
            return pd.DataFrame({"k": k, "v": v, "s": s.astype(np.int32), "e": e.astype(np.int32)})

        for pdf in parts:
            for at in range(0, len(pdf), BATCH):
                held.append(pdf.iloc[at : at + BATCH])
                count += len(held[-1])
                if count >= BATCH:
                    yield solve(False)
        if count:
            yield solve(True)

    return found.repartition("h").sortWithinPartitions("h").mapInPandas(run, "k long, v long, s int, e int")


def _by_windows(found: DataFrame) -> DataFrame:
    """``(k, v, s, e)`` of the windows that are not the first with their bytes; a batch's own first ones meet by hash."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            first: dict[bytes, tuple[int, int, int]] = {}
            gone: list[tuple[int, int, int]] = []
            for k, v, s, b in pdf.sort_values(["k", "v", "s"])[["k", "v", "s", "b"]].itertuples(index=False):
                for i in range(len(b) - LENGTH + 1):
                    place = (k, v, s + i)
                    if first.setdefault(hashlib.sha256(b[i : i + LENGTH]).digest(), place) != place:
                        gone.append(place)
            if gone:
                k, v, s = np.array(gone, np.int64).T
                k, v, s, e = _merged(k, v, s, s + LENGTH)
                yield pd.DataFrame({"k": k, "v": v, "s": s.astype(np.int32), "e": e.astype(np.int32), "w": None})
            k, v, s = np.array(list(first.values()), np.int64).reshape(-1, 3).T
            yield pd.DataFrame({"k": k, "v": v, "s": s.astype(np.int32), "e": (s + LENGTH).astype(np.int32), "w": list(first)})

    one = materialise(found.mapInPandas(run, "k long, v long, s int, e int, w binary"), "windows")
    met = one.where("w is not null")
    first = met.groupBy("w").agg(F.min(F.struct("k", "v", "s")).alias("f"))
    later = met.join(first, "w").where(F.col("f") != F.struct("k", "v", "s"))
    return one.where("w is null").union(later.select(one.columns)).select("k", "v", "s", "e")


def _frequent(rows: DataFrame) -> np.ndarray:
    """Sorted anchors that at least HOT_SHARE of the sampled documents have; HOT_MOST at most."""
    few = rows.where(F.pmod(F.xxhash64("k", "v"), F.lit(HOT_SAMPLE)) == 0)
    seen = _cut(few).where("route = 0").groupBy("h").agg(F.count_distinct("k", "v").alias("n"))
    found = seen.where(F.col("n") >= max(8.0, HOT_SHARE * few.count())).orderBy(F.desc("n"), "h").limit(HOT_MOST)
    return np.array(sorted(r.h for r in found.collect()), np.int64)  # at most HOT_MOST


def spans(rows: DataFrame) -> DataFrame:
    """``(k, v, s, e)``: byte runs (possibly overlapping) that together are all bytes to remove, from ``(k, v, t)``."""
    hot = _frequent(rows)
    sifted = materialise(_sift(_cut(rows, rows.sparkSession.sparkContext.broadcast(hot) if len(hot) else None)), "segments")
    gone = sifted.where("route = 1").select("k", "v", "s", (F.col("s") + F.col("n")).alias("e"))
    firsts = sifted.where("route = 0")
    many = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > GROUP).select("h", F.lit(True).alias("many"))
    wanted = firsts.join(many, "h", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    wanted = wanted.unionByName(sifted.where("route = 2").withColumn("many", F.lit(True)))
    found = materialise(_bytes_of(rows, wanted), "strings")
    out = gone.union(_by_transform(found.where("not many").select("h", "k", "v", "s", "b")))
    big = found.where("many")
    return out if big.isEmpty() else out.union(_by_windows(big))


def removed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row."""
    rows = df.select(
        F.col(key).cast("long").alias("id"),
        F.coalesce(F.col(key).cast("long"), F.lit(_NULL)).alias("k"),
        F.xxhash64(F.col(key).isNull(), text).alias("v"),
        F.col(text).alias("t"),
    )
    cuts = spans(rows.drop("id")).groupBy("k", "v").agg(F.collect_list(F.struct("s", "e")).alias("cuts"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for t, cuts in zip(as_bytes(pdf["t"]), pdf["cuts"], strict=True):
                if cuts is None or not len(cuts):
                    out.append((len(t), 0, 0, hashlib.sha256(t).hexdigest()))
                    continue
                s, e = (np.fromiter((x[c] for x in cuts), np.int64, len(cuts)) for c in ("s", "e"))
                one = np.zeros(len(s), np.int64)
                _, _, s, e = _merged(one, one, s, e)
                kept = hashlib.sha256()
                for a, b in zip([0, *e.tolist()], [*s.tolist(), len(t)], strict=True):
                    kept.update(t[a:b])
                out.append((len(t), int((e - s).sum()), len(s), kept.hexdigest()))
            done = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            yield done.assign(id=pdf["id"].array)

    joined = rows.join(cuts, ["k", "v"], "left").select("id", "t", "cuts")
    return joined.mapInPandas(run, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, id long").select(
        F.col("id").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )
