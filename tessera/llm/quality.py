"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader updates.

Features of a text are its words, pairs of words, word shapes, runs of shapes (word n-grams over shapes instead of
letters) and a word for its length; each is hashed to one of 2^DIM_BITS weights with the value sqrt(count / all), so a
text is a unit vector and its score one sparse dot product.  All words of the whole text count.

The model is fitted on a bounded sample: the SAMPLE labelled rows with the smallest hash of their id.  Scores cover all
rows.  Null and empty texts have only the length feature and are scored like any other; a row repeats as often as it
came; labels that disagree count as their mean, at least one half being 1, and null labels or ids are not learnt from.
Without a label of either class every score is the base rate (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import Words, as_bytes, blocks, mix

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 6000
DIM_BITS = 18
#: FTRL-Proximal: learning rate, its offset, L1 and L2 strength, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.1, 4
THRESHOLD = 0.7


def _shapes(w: Words) -> np.ndarray:
    """A number for each word: cases and kinds of its first and last bytes, whether it repeats the word before it."""
    kind = np.full(256, 4, np.uint64)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 1, 2, 3, 5
    for i, c in enumerate(b".,;:!?|#$%&*"):
        kind[c] = 6 + i
    k = kind[w.buffer]
    size = w.end - w.start
    second = np.where(size > 1, w.start + 1, w.start)
    before_last = np.maximum(w.end - 2, w.start)
    same = np.zeros(len(size), np.uint64)
    if len(size) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    out = k[w.start]
    for part in (k[second], k[before_last], k[w.end - 1], np.minimum(size, 24).astype(np.uint64) // np.uint64(4), same):
        out = out * np.uint64(32) + part
    return mix(out + np.uint64(77))


def features(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: ``(first text, text of each feature, bucket, value)``, sorted by text and bucket."""
    for first, part in blocks(texts):
        w = Words(part)
        shape = _shapes(w)
        pair = np.flatnonzero(w.doc[1:] == w.doc[:-1]) if len(w.doc) else np.zeros(0, np.int64)
        length = np.bincount(w.doc, minlength=len(part))
        docs = [w.doc, w.doc[pair], w.doc, w.doc[pair], np.arange(len(part))]
        hashes = [
            w.hash,
            mix(w.hash[pair] * np.uint64(3) + w.hash[pair + 1]),
            shape,
            mix(shape[pair] * np.uint64(5) + shape[pair + 1]),
            mix(np.frexp(length + 1.0)[1].astype(np.uint64) + np.uint64(991)),
        ]
        key = (np.concatenate(docs).astype(np.uint64) << np.uint64(DIM_BITS)) | (np.concatenate(hashes) >> np.uint64(64 - DIM_BITS))
        key.sort()
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.concatenate([at, [len(key)]]))
        doc = (key[at] >> np.uint64(DIM_BITS)).astype(np.int64)
        total = np.bincount(doc, count, minlength=len(part))
        yield first, doc, (key[at] & np.uint64((1 << DIM_BITS) - 1)).astype(np.int64), np.sqrt(count / total[doc])


def _sparse(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns with ``bucket`` and ``value`` arrays."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            buckets, values = [None] * len(pdf), [None] * len(pdf)
            for first, doc, bucket, value in features(as_bytes(pdf[text])):
                edge = np.searchsorted(doc, np.arange(doc[-1] + 2))
                for i in range(len(edge) - 1):
                    buckets[first + i] = bucket[edge[i] : edge[i + 1]].astype(np.int32)
                    values[first + i] = value[edge[i] : edge[i + 1]].astype(np.float32)
            yield pdf[keep].assign(bucket=buckets, value=values)

    kinds = dict(df.dtypes)
    return df.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", bucket array<int>, value array<float>")


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias after PASSES over ``(bucket, value, label)``, one row at a time."""
    n = (1 << DIM_BITS) + 1  # the last is the bias, without regularisation
    z, g2, w = np.zeros(n), np.zeros(n), np.zeros(n)
    for _ in range(PASSES):
        for bucket, value, y in rows:
            i, x = np.append(bucket, n - 1), np.append(value, 1.0)
            zi, gi = z[i], g2[i]
            l1, l2 = np.full(len(i), L1), np.full(len(i), L2)
            l1[-1] = l2[-1] = 0
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(gi)) / ALPHA + l2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(gi + g * g) - np.sqrt(gi)) / ALPHA * wi
            g2[i] += g * g
    l1, l2 = np.full(n, L1), np.full(n, L2)
    l1[-1] = l2[-1] = 0
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(g2)) / ALPHA + l2))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality"):
    """Weights and bias from at most ``sample`` labelled documents; only ids, texts and labels are read.

    The ids of the sample (bounded by ``sample``) are broadcast, and one task learns from the features of its rows.  Of rows
    that repeat an id the smallest text is taken; an id's label is the majority of its labels, 1 if they are even.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    ids = docs.select(F.col(key).alias("k")).where("k is not null").distinct().join(known, "k")
    chosen = ids.orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    rows = _sparse(rows.groupBy("k", "y").agg(F.min("t").alias("t")), ["k", "y"], "t")

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [p for p in parts if len(p)]
        weights, bias = np.zeros(1 << DIM_BITS), 0.0
        if held:
            all_rows = pd.concat(held, ignore_index=True)
            order = np.argsort(mix(all_rows["k"].to_numpy(np.int64).astype(np.uint64)), kind="stable")
            rate = float(all_rows["y"].mean())
            if 0 < rate < 1:
                b, v, y = (all_rows[c].to_numpy() for c in ("bucket", "value", "y"))
                weights, bias = ftrl([(b[i], v[i], y[i]) for i in order])
            else:
                bias = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
        yield pd.DataFrame({"weights": [weights.astype("<f4").tobytes()], "bias": [bias]})

    # the sample is bounded, so one task may learn from it; only the weights reach the driver
    found = rows.coalesce(1).mapInPandas(learn, "weights binary, bias double").first()
    return (np.frombuffer(found.weights, "<f4"), found.bias) if found else (np.zeros(1 << DIM_BITS, np.float32), 0.0)


def score(df: DataFrame, model: tuple[np.ndarray, float], keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """``keep`` columns and ``out``, the probability of label 1, of every row's whole text."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((np.asarray(model[0], np.float32), model[1]))  # 2^DIM_BITS weights

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        for texts in parts:
            got = np.zeros(len(texts))
            for first, doc, bucket, value in features(as_bytes(texts)):
                dot = np.bincount(doc, weights[bucket] * value)
                got[first : first + len(dot)] = 1 / (1 + np.exp(-np.clip(dot + bias, -35, 35)))
            yield pd.Series(got)

    return df.select(*(F.col(f"`{c}`") for c in keep), run(F.col(text)).alias(out))
