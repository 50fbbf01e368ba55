"""White-space words of many texts at once, as numpy arrays.

A block of texts is one byte buffer in which a line feed ends every text, so no word crosses two texts.  Word hashes come
from a polynomial prefix sum modulo 2^64, mixed afterwards; hashing is linear in the bytes and independent of the split
into blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Bytes of text handled together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def blocks(texts: Iterable[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """``(index of the first text, texts)`` of about ``limit`` bytes each."""
    first, part, size = 0, [], 0
    for i, t in enumerate(texts):
        if part and size + len(t) > limit:
            yield first, part
            first, part, size = i, [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield first, part


class Words:
    """Words of a list of texts: ``start`` and ``end`` in the buffer, ``doc`` (index of the text), ``hash``."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.buffer = _LOWER[self.buffer]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        gap = _SPACE[self.buffer]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.offset, self.start, "right") - 1
        n = 1 << max(19, int(len(self.buffer) + 1).bit_length())
        up, down = _powers(n)
        total = np.zeros(len(self.buffer) + 1, np.uint64)
        np.cumsum((self.buffer.astype(np.uint64) + np.uint64(1)) * up[: len(self.buffer)], out=total[1:])
        raw = (total[self.end] - total[self.start]) * down[self.start]
        self.hash = mix(raw + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        #: First word of each text, and one past the last.
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``(index of the first word, hash)`` of every run of ``n`` words inside one text."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(self.doc) - n + 1])
        h = self.hash[at]
        for k in range(1, n):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + self.hash[at + k])
        return at, h


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` of the word hashes ``h``, linear in the words; independent of where ``h`` starts."""
    up, down = _powers(1 << max(19, (len(h) + 1).bit_length()))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(h) - n + 1])


def bounded_batches(spark, size: int = 1 << 22, rows: int = 10_000) -> None:
    """Have Arrow hand rows to Python in batches of about ``size`` bytes and at most ``rows`` rows, so that a worker's
    memory stays small.  Both are settings of the session, read when a query runs, so they are left as they are set here."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def as_bytes(texts) -> list[bytes]:
    """UTF-8 of a column of texts; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def spare(names: list[str], base: str) -> str:
    """A column name that is not in ``names`` (Spark compares them without case)."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base += "_"
    return base
