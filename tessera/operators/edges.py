"""Relationship timelines: reads by endpoint, interval planning, integrity."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.visibility import entity_at
from tessera.operators.folding import in_order


def touching(edges: DataFrame, chains: DataFrame) -> DataFrame:
    """Edges with either end in ``chains (chain_id)``, each once: two joins, one for each end."""
    c = chains.select("chain_id").distinct()
    out = edges.join(c.withColumnRenamed("chain_id", "source_chain"), "source_chain", "left_semi").select(edges.columns)
    into = edges.join(c.withColumnRenamed("chain_id", "target_chain"), "target_chain", "left_semi").select(edges.columns)
    return out.union(into).distinct()


def of_slot(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges of the reference slots ``(source_chain, slot)``."""
    return edges.join(owners.select("source_chain", "slot").distinct(), ["source_chain", "slot"], "left_semi")


def of_scope(edges: DataFrame, entities: DataFrame, namespaces: list[str]) -> DataFrame:
    """Edges whose source is an entity of one of ``namespaces``."""
    inside = entities.where(F.col("namespace").isin(*namespaces)).select(F.col("chain_id").alias("source_chain"))
    return edges.join(inside, "source_chain", "left_semi")


def evidence_of_time(edges: DataFrame) -> DataFrame:
    """Adds ``time_evidence``: declared and reference edges without an end are ongoing; others say their end."""
    return edges.withColumn("time_evidence", F.when(F.col("valid_to").isNull(), "ongoing").otherwise("declared"))


def between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges of the directed ``(source_chain, target_chain)`` pairs."""
    return edges.join(pairs.select("source_chain", "target_chain").distinct(), ["source_chain", "target_chain"], "left_semi")


def hydrate(edges: DataFrame, entities: DataFrame, t: Column) -> DataFrame:
    """Edges with the versions of both ends visible at ``t``: joined by chain, never by a stored version."""
    seen = entities.where(entity_at(t)).select("chain_id", "version", "name")
    a = seen.select(F.col("chain_id").alias("source_chain"), F.col("version").alias("source_version"), F.col("name").alias("source_name"))
    b = seen.select(F.col("chain_id").alias("target_chain"), F.col("version").alias("target_version"), F.col("name").alias("target_name"))
    return edges.join(a, "source_chain").join(b, "target_chain")


def supersede(observed: DataFrame, owner: list[str], target: str, at: str, tie: list[str]) -> DataFrame:
    """Intervals of owners that point at one target at a time, from ordered observations.

    A repeated target extends the interval; another one closes it where the new one starts.
    """
    w = W.partitionBy(*owner).orderBy(at, *tie)
    moved = observed.withColumn("__new", F.when(F.col(target).eqNullSafe(F.lag(target).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    numbered = moved.withColumn("interval", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    rows = numbered.groupBy(*owner, "interval", target).agg(F.min(at).alias("valid_from"), F.max(at).alias("last_seen_at"))
    return rows.withColumn("valid_to", F.lead("valid_from").over(W.partitionBy(*owner).orderBy("interval")))


class _Slot:
    """Intervals of one owner slot that are not cancelled, by start; they never overlap."""

    def __init__(self):
        self.starts: list = []
        self.rows: list[dict] = []

    def step(self, r) -> Iterator[dict]:
        now = r.captured_at
        start = r.effective_from if pd.notna(r.effective_from) else now
        end = r.effective_to if pd.notna(r.effective_to) else None
        if r.kind in ("cancel", "replace"):
            i = bisect_right(self.starts, now)
            yield from (x | {"cancelled_at": now} for x in self.rows[i:])  # pending ones
            del self.rows[i:], self.starts[i:]
            if r.kind == "cancel":
                x = self.rows[-1] if self.rows else None
                if x and x["target"] == r.target and (x["valid_to"] is None or x["valid_to"] > now) and now > x["last_seen_at"]:
                    x["valid_to"] = now
                return
        i = bisect_right(self.starts, start)
        x = self.rows[i - 1] if i else None
        if x and x["target"] == r.target and (x["valid_to"] is None or start < x["valid_to"]):
            x["last_seen_at"] = max(x["last_seen_at"], now)
            if end is not None and (x["valid_to"] is None or end < x["valid_to"]):
                x["valid_to"] = end
            return
        row = {"target": r.target, "valid_from": start, "valid_to": end, "cancelled_at": None, "last_seen_at": now, "outcome": "interval"}
        if x and x["valid_from"] == start:
            yield row | {"outcome": "two targets at one time"}
            return
        if i < len(self.starts) and (end is None or end > self.starts[i]):
            row["valid_to"] = self.starts[i]
        if x and (x["valid_to"] is None or x["valid_to"] > start):
            x["valid_to"] = start
        self.starts.insert(i, start)
        self.rows.insert(i, row)

    def close(self) -> Iterator[dict]:
        yield from self.rows


def plan(changes: DataFrame, schema: str, owner: list[str]) -> DataFrame:
    """The full interval rules, an owner slot at a time, for declared intervals, amendments and cancellations.

    Input ``owner.., target, kind (observe|replace|cancel), effective_from, effective_to, captured_at, idx``; output
    ``owner.., target, valid_from, valid_to, cancelled_at, outcome``.  An older observation never extends or inverts an
    interval; a later start shortens the one before; a pending interval can be replaced or cancelled, a running one closed.
    A slot's intervals (not its observations) are held while it passes.
    """
    return in_order(changes, owner, ["captured_at", "idx"], _Slot, ["target", "valid_from", "valid_to", "cancelled_at", "outcome"], schema)


def broken_timelines(edges: DataFrame, owner: list[str]) -> DataFrame:
    """Owners with overlapping intervals, inverted ones, repeated revisions or more than one head."""
    w = W.partitionBy(*owner).orderBy("valid_from", "version")
    rows = edges.withColumn("__next", F.lead("valid_from").over(w))
    return rows.groupBy(*owner).agg(
        F.count_if(F.col("__next").isNotNull() & (F.col("valid_to").isNull() | (F.col("__next") < F.col("valid_to")))).alias("overlaps"),
        F.count_if(F.col("valid_to") < F.col("valid_from")).alias("inverted"),
        (F.count(F.lit(1)) - F.count_distinct("version")).alias("repeated"),
        F.count_if(F.col("is_latest")).alias("heads"),
    ).where("overlaps > 0 or inverted > 0 or repeated > 0 or heads > 1")
