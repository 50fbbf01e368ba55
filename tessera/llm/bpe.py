"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1, so an Aho-Corasick automaton over strings finds all vocabulary entries in one pass.  The
encoder walks from left to right with the longest entry at each place; it steps back to a shorter one whenever two
neighbours could not stand side by side in a merged sequence.  Whether two tokens may is decided once a pair and
remembered: both are merged side by side along the seam, and they fit if nothing ever joins across it.  A sequence whose
neighbours all fit is the merged sequence, and no place is left twice for the same reason, so the work is linear in the bytes.

Nulls encode like empty texts (no ids).  Rows keep their order, repeats and all their columns; a column that already has
the output's name is refused.
"""

from __future__ import annotations

import base64
import gc
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise, takewhile

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.words import spare

#: Bytes of pieces of text remembered by a worker with their ids, in each of two generations: a full one replaces the
#: older.  Longer pieces than LONG_PIECE characters are not remembered; an entry counts _ENTRY bytes besides its text.
KEPT_BYTES, LONG_PIECE, _ENTRY = 1 << 26, 256, 300
#: Pairs of tokens remembered.
PAIRS_KEPT = 200_000
_NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(4)
def vocabulary(path: str) -> dict[int, bytes]:
    """The bytes of every id: all that a decoder needs."""
    return {i: b for b, i in read_ranks(path).items()}


def _in_ascii(pattern: str) -> str:
    """``pattern`` for texts of ASCII characters alone, in the standard library's syntax."""
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]")
    return inside.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\s", r"[\t-\r ]").replace(r"\S", r"[^\t-\r ]")


class _Remembered(dict):
    """A dictionary that asks ``find`` for what it lacks; ``find`` decides what is kept."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, key):
        return self.find(key)


class Codec:
    """Encoder of one rank file (lines of base64 token and rank).

    Ids are ranks.  A token's edges are the tokens that stand at its end (or start) while it is merged from single bytes,
    shortest first; their ids rise, since no token is merged before its parts.
    """

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.size = {i: len(b) for i, b in self.bytes.items()}
        if any(bytes([x]) not in self.ranks for x in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.any_split = regex.compile(pattern).findall
        self.ascii_split = re.compile(_in_ascii(pattern), re.ASCII).findall
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.edges: dict[int, tuple[tuple[int, ...], tuple[int, ...]] | None] = {}
        self.prefix: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = _Remembered(self._compatible)
        self.pieces: dict[str, tuple[int, ...]] = _Remembered(self._piece)
        self.older: dict[str, tuple[int, ...]] = {}
        self.kept = 0

    def _edges(self, token: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """``(at the start, at the end)`` of a token; None if merging its bytes never gives it."""
        if token in self.edges:
            return self.edges[token]
        data = self.bytes[token]
        found = ((token,), (token,)) if len(data) == 1 else None
        for cut in range(1, len(data)):
            left, right = self.ranks.get(data[:cut]), self.ranks.get(data[cut:])
            if left is not None and right is not None and max(left, right) < token:
                a, b = self._edges(left), self._edges(right)
                if a and b and self._seam(a[1], b[0]) == token:
                    found = ((*a[0], token), (*b[1], token))
                    break
        self.edges[token] = found
        return found

    def _seam(self, ends: tuple[int, ...], starts: tuple[int, ...]) -> int | None:
        """What joins two neighbours while both are merged side by side: the first token across the seam, if any.

        At equal ranks the merge further left comes first.
        """
        i = j = 0
        name, joined = self.bytes, self.ranks.get
        last_i, last_j = len(ends) - 1, len(starts) - 1
        while True:
            across = joined(name[ends[i]] + name[starts[j]])
            after = ends[i + 1] if i < last_i else _NEVER
            before = starts[j + 1] if j < last_j else _NEVER
            if across is not None and across < after and across <= before:
                return across
            if after <= before:
                if after == _NEVER:
                    return None
                i += 1
            else:
                j += 1

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens can be neighbours in a merged sequence."""
        if len(self.fits) > PAIRS_KEPT:
            self.fits.clear()
        a, b = self._edges(pair[0]), self._edges(pair[1])
        self.fits[pair] = known = bool(a and b) and self._seam(a[1], b[0]) is None
        return known

    def _shorter(self, token: int) -> int | None:
        """The next shorter token that a token starts with."""
        if token not in self.prefix:
            data, found = self.bytes[token], None
            for n in range(len(data) - 1, 0, -1):
                if (found := self.ranks.get(data[:n])) is not None:
                    break
            self.prefix[token] = found
        return self.prefix[token]

    def _backtrack(self, data: bytes) -> list[int]:
        """Ids of one piece: longest matches from left to right, stepping back where neighbours do not fit."""
        text = data.decode("latin-1")
        greedy = [i for _, i in self.automaton.iter_long(text)]
        fits, size = self.fits, self.size
        good = len(list(takewhile(fits.__getitem__, pairwise(greedy))))  # pairs that fit
        if good == len(greedy) - 1:
            return greedy
        dead: set[int] = set()  # places from which no sequence of fitting neighbours goes on
        out, ahead = greedy[: good + 1], iter(greedy[good + 1 :])
        at = sum(map(size.__getitem__, out))
        token: int | None = next(ahead)
        moved = False
        while True:
            while token is not None and (at + size[token] in dead or (out and not fits[out[-1], token])):
                token, moved = self._shorter(token), True
            if token is None:  # nothing fits here: what stands before must be shorter
                dead.add(at)
                last = out.pop()
                at -= size[last]
                token, moved = self._shorter(last), True
                continue
            out.append(token)
            at += size[token]
            if at == len(data):
                return out
            if moved:
                ahead, moved = (i for _, i in self.automaton.iter_long(text, at)), False
            token = next(ahead)

    def _piece(self, text: str) -> tuple[int, ...]:
        """Ids of a piece that is not among the newer remembered ones."""
        if (ids := self.older.get(text)) is None:
            data = text.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            ids = (whole,) if whole is not None else tuple(self._backtrack(data))
        if len(text) < LONG_PIECE:
            self.kept += len(text) + _ENTRY
            if self.kept > KEPT_BYTES:
                self.pieces, self.older, self.kept = _Remembered(self._piece), self.pieces, 0
            self.pieces[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        pieces = (self.ascii_split if text.isascii() else self.any_split)(text)
        return list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    return Codec(path, pattern)


def encoded(c: Codec, texts: Iterable) -> list[list[int]]:
    """Ids of a batch of texts; what is no text has none.

    Encoding makes no reference cycles, and the collector would walk all remembered pieces again and again: it rests.
    """
    active = gc.isenabled()
    gc.disable()
    try:
        return [c.encode(t if isinstance(t, str) else "") for t in texts]
    finally:
        if active:
            gc.enable()


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the token ids of the whole text, each match of ``pattern`` encoded by itself."""
    if ids in df.columns:
        raise ValueError(f"column {ids} exists")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for s in parts:
            yield pd.Series([np.array(own, np.int32) for own in encoded(c, s)], dtype=object)

    return df.withColumn(ids, run(df[text]))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that ``ids`` stand for (binary; null or no ids: empty).  An unknown id is an error."""
    if out in df.columns:
        raise ValueError(f"column {out} exists")

    @F.pandas_udf(T.BinaryType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bytes_of = vocabulary(path).__getitem__
        for s in parts:
            yield pd.Series([b"".join(map(bytes_of, x.tolist() if hasattr(x, "tolist") else x or [])) for x in s], dtype=object)

    return df.withColumn(out, run(df[ids]))


def round_trip(df: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``ids`` and ``decoded``: :func:`encode` and :func:`decode` in one pass through Python."""

    @F.pandas_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c, bytes_of = codec(path, pattern), vocabulary(path).__getitem__
        for s in parts:
            ids, decoded = [], []
            for own in encoded(c, s):
                ids.append(np.array(own, np.int32))
                decoded.append(b"".join(map(bytes_of, own)))
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(decoded, dtype=object)})

    both, named = spare(keep, "bpe"), [F.col(f"`{c}`") for c in keep]
    return df.select(*named, run(df[text]).alias(both)).select(*named, f"{both}.ids", f"{both}.decoded")


def digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, from :func:`round_trip`."""
    return round_trip(df, path, pattern, ["doc_id"], text).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
