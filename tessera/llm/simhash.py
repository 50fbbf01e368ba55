"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is 64 majority votes over the hashes of a text's word shingles.  Fingerprints are cut into BLOCKS blocks; two
that differ in at most DISTANCE bits agree on at least BLOCKS - DISTANCE of them, so they meet in one of the tables keyed
by that many blocks.  Only distinct fingerprints are joined: copies are folded into one row first.

Groups of a key are kept small exactly: a key that more than GROUP fingerprints share is cut again, on the bits outside
it, by the same argument, and a group then has at most 2^16 members because only 16 bits of it are free.  Inside a group
every distance is measured, and of the links found only a spanning forest leaves it, so a group of n sends fewer than n
rows.  Components are built from these links.

Null, empty and blank texts have fingerprint zero and link like any other.  A null id is kept; it never names a component
unless its component has no other id.  Repeated rows are returned as often as they came.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.storage import materialise

DISTANCE = 3
#: Blocks of the first cut (keys of half the bits) and fingerprints of a key beyond which it is cut again.
BLOCKS, GROUP = 6, 256
_VOTES = 1 << 14  # hashes whose bits are counted at once


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Fingerprint of one text: A-Z lower-cased, words split at ASCII white space, shingles hashed with XXH64."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        spans = [(0, len(joined))]
    else:
        size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        end = np.cumsum(size) - 1
        spans = zip((end - size + 1)[: len(parts) - words + 1].tolist(), end[words - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], seed) for a, b in spans], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _VOTES):
        part = hashes[at : at + _VOTES]
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(votes * 2 > len(hashes)))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``key`` and ``fp`` (the fingerprint as a signed long) of every row."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        found = [fingerprint(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"", words) for t in texts]
        return pd.Series(np.array(found, np.uint64).astype(np.int64))

    return df.select(F.col(key), run(F.col(text)).alias("fp"))


def _masks(bits: list[int], blocks: int, distance: int) -> list[int]:
    """Signed masks of all choices of ``blocks - distance`` blocks of the given bit positions."""
    parts = [p.tolist() for p in np.array_split(np.array(bits), blocks)]
    unsigned = (sum(1 << b for part in chosen for b in part) for chosen in combinations(parts, blocks - distance))
    return [m - (1 << 64) if m >> 63 else m for m in unsigned]


def _cut(masks: list[int], more: list[Column]) -> Column:
    """An array of keys ``(id of the mask, masked fingerprint)`` for column ``fp``."""
    return F.array(*(F.struct(*more, F.lit(i).cast("short").alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)))


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the distinct ``fps`` that differ in at most ``distance`` bits."""
    left, out = fps.view(np.uint64), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(left ^ front[0]) <= distance
            out += [(int(front[0].astype(np.int64)), int(x)) for x in left[near].astype(np.int64)]
            front, left = np.concatenate([front[1:], left[near]]), left[~near]
    return out


def _group_links(rows: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """Spanning links inside each group of ``keys``; groups pass one by one through sorted partitions."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, []

        def close():
            return _forest(np.unique(np.concatenate(held)), distance) if held else []

        for pdf in parts:
            fp, key = pdf["fp"].to_numpy(np.int64), pdf[keys].to_numpy(np.int64)
            out: list[tuple[int, int]] = []
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            for a, b in zip(edge, [*edge[1:], len(fp)], strict=True):
                if last is None or (key[a] != last).any():
                    out += close()
                    held, last = [], key[a]
                held.append(fp[a:b])
            yield pd.DataFrame(out, columns=["src", "dst"], dtype=np.int64)
        yield pd.DataFrame(close(), columns=["src", "dst"], dtype=np.int64)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "src long, dst long")


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """``(src, dst)`` links whose components are those of all pairs of ``fp`` within ``distance`` bits.

    ``fps`` has distinct non-null values.  Keys are counted first (map-side combined); fingerprints of keys with one
    member drop out, those of large keys are cut again.
    """
    first = _masks(list(range(64)), blocks, distance)
    keyed = fps.select("fp", F.explode(_cut(first, [])).alias("c")).select("fp", "c.*")
    sizes = keyed.groupBy("table", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialise(keyed.join(sizes, ["table", "part"]).select("fp", "table", "part", (F.col("n") > group).alias("big")), "blocks")
    found = _group_links(met.where("not big").select("fp", "table", "part"), ["table", "part"], distance)
    big = met.where("big")
    if big.isEmpty():
        return found
    again = None
    for i, mask in enumerate(first):
        free = [b for b in range(64) if not (mask >> b) & 1]
        again = F.when(F.col("table") == i, _cut(_masks(free, blocks, distance), [F.col("table").alias("t0"), F.col("part").alias("p0")])) if again is None else again.when(F.col("table") == i, _cut(_masks(free, blocks, distance), [F.col("table").alias("t0"), F.col("part").alias("p0")]))
    deep = big.select("fp", F.explode(again).alias("c")).select("fp", "c.*")
    return found.union(_group_links(deep, ["t0", "p0", "table", "part"], distance))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = DISTANCE) -> DataFrame:
    """``key, fp, component_id`` of every row: the smallest id that links of at most ``distance`` bits reach."""
    prints = materialise(fingerprints(df, key, text, words), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    joined = connected_components(links(distinct.select("fp"), distance))
    joined = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    joined = materialise(joined, "components")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    names = joined.join(least, "component").select("fp", "component_id")
    return prints.join(names, "fp").select(key, "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
