"""Version history of chains: folds of ordered observations, change feeds, point-in-time reads."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.folding import in_order


def linearize(observations: DataFrame, chain: str, order: list[str], content: list[str], at: str) -> DataFrame:
    """Versions of full observations: a new one wherever ``content`` differs from the observation before.

    Adds ``version``, ``valid_from``, ``valid_to`` (the next version's start), ``last_seen_at``, ``n_observations`` and
    ``is_latest``; one shuffle by chain serves all windows.
    """
    w = W.partitionBy(chain).orderBy(*order)
    same = F.lit(True)
    for c in content:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    opened = observations.withColumn("__new", F.when(F.row_number().over(w) == 1, 1).when(same, 0).otherwise(1))
    numbered = opened.withColumn("version", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    rows = numbered.groupBy(chain, "version", *content).agg(F.min(at).alias("valid_from"), F.max(at).alias("last_seen_at"), F.count(F.lit(1)).alias("n_observations"))
    v = W.partitionBy(chain).orderBy("version")
    return rows.withColumn("valid_to", F.lead("valid_from").over(v)).withColumn("is_latest", F.col("valid_to").isNull())


def in_place(observations: DataFrame, chain: str, order: list[str], content: list[str], loose: list[str]) -> DataFrame:
    """Observations by kind: ``created``, ``version`` (content differs), ``in_place`` (only loose keys), ``unchanged``."""
    w = W.partitionBy(chain).orderBy(*order)
    def differs(cols: list[str]) -> Column:
        out = F.lit(False)
        for c in cols:
            out = out | ~F.col(c).eqNullSafe(F.lag(c).over(w))
        return out
    return observations.withColumn("kind", F.when(F.row_number().over(w) == 1, "created").when(differs(content), "version").when(differs(loose), "in_place").otherwise("unchanged"))


def tombstones(observations: DataFrame, chain: str, order: list[str], at: str, deleted: Column) -> DataFrame:
    """Lifecycle events of ordered observations: created, deleted, recreated (strictly later), ignored (deleting nothing),
    observed, stale (alive, but not after the deletion)."""
    w = W.partitionBy(chain).orderBy(*order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    marked = observations.withColumn("__del", deleted)
    prior = F.coalesce(F.last("__del", ignorenulls=True).over(before), F.lit(None).cast("boolean"))
    alive_before = F.coalesce(F.max(F.when(~F.col("__del"), 1)).over(before), F.lit(0)) == 1
    last_death = F.max(F.when(F.col("__del"), F.col(at))).over(before)
    kind = (
        F.when(F.col("__del") & ~alive_before, "ignored")
        .when(F.col("__del") & prior, "still_deleted")
        .when(F.col("__del"), "deleted")
        .when(~alive_before, "created")
        .when(prior & (F.col(at) > last_death), "recreated")
        .when(prior, "stale")
        .otherwise("observed")
    )
    return marked.withColumn("lifecycle", kind).drop("__del")


def stale_observations(observations: DataFrame, chain: str, arrival: list[str], at: str) -> DataFrame:
    """Observations that arrive after one with a later capture time: kept as provenance only."""
    before = W.partitionBy(chain).orderBy(*arrival).rowsBetween(W.unboundedPreceding, -1)
    return observations.withColumn("is_stale", F.coalesce(F.col(at) < F.max(at).over(before), F.lit(False)))


def conflicts(observations: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys`` at which observations of one instant disagree, with the number of values."""
    return observations.groupBy(*keys).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def _clash(p: str, q: str) -> bool:
    return p == q or p.startswith(q + ".") or q.startswith(p + ".")


class _Chain:
    """The version state of one chain.  ``clock`` is the time of the last living observation, ``changed`` of the last death."""

    def __init__(self):
        self.head: dict | None = None
        self.clock = self.changed = None

    def _problem(self, t, props: dict, outcome: str) -> dict:
        return {"version": self.head["version"], "valid_from": t, "valid_to": None, "deleted_at": None, "props": props, "outcome": outcome}

    def _open(self, version: int, t, props: dict) -> None:
        self.head = {"version": version, "valid_from": t, "valid_to": None, "deleted_at": None, "props": props, "outcome": "version"}
        self.clock = t

    def step(self, r) -> Iterator[dict]:
        new, loose, t = dict(r.props if r.props is not None else []), set(r.loose if r.loose is not None else []), r.captured_at
        head = self.head
        if head is None:
            if not r.deleted:
                self._open(1, t, new)
        elif r.deleted:
            if head["deleted_at"] is not None:
                self.changed = t  # the first deletion stays, its clock goes on
            elif t == self.clock:
                yield self._problem(t, {}, "deleted while alive")
            else:
                head["deleted_at"] = self.changed = t
        elif head["deleted_at"] is not None:
            if t <= self.changed:
                yield self._problem(t, new, "alive at its deletion")
            else:
                yield head
                self._open(head["version"] + 1, t, new)
        else:
            if not r.full:
                new = {k: v for k, v in head["props"].items() if not any(_clash(k, p) for p in new)} | new
            changed = {k for k in head["props"].keys() | new.keys() if head["props"].get(k) != new.get(k)}
            if changed <= loose:
                head["props"], self.clock = new, t
            elif t == self.clock:
                yield self._problem(t, new, "two contents at one time")
            else:
                yield head | {"valid_to": t}
                self._open(head["version"] + 1, t, new)

    def close(self) -> Iterator[dict]:
        if self.head is not None:
            yield self.head


def united(observations: DataFrame, chain: str = "chain_id") -> DataFrame:
    """Partial observations of a chain at one instant as one, if they agree; the rest as they are.

    They disagree if a path has two values or one names a part of another; then all of them stay, for the fold to reject.
    """
    partial = F.col("full") | F.col("deleted")
    at = [chain, "captured_at"]
    merged = observations.where(~partial).groupBy(*at).agg(F.min("idx").alias("idx"), F.collect_list("props").alias("all"), F.flatten(F.collect_list("loose")).alias("loose"))
    entries = F.array_distinct(F.flatten(F.transform("all", lambda m: F.map_entries(m))))
    names = F.transform("e", lambda x: x["key"])
    parts = F.exists(names, lambda x: F.exists(names, lambda y: y.startswith(F.concat(x, F.lit(".")))))
    merged = merged.withColumn("e", entries).withColumn("agree", (F.size(F.array_distinct(names)) == F.size("e")) & ~parts)
    one = merged.where("agree").select(*at, "idx", F.lit(False).alias("full"), F.lit(False).alias("deleted"), F.map_from_entries("e").alias("props"), F.array_distinct("loose").alias("loose"))
    kept = observations.where(~partial).join(merged.where("not agree").select(*at), at, "left_semi")
    return observations.where(partial).select(one.columns).unionByName(one).unionByName(kept.select(one.columns))


def fold(observations: DataFrame, schema: str, chain: str = "chain_id") -> DataFrame:
    """The full state machine for chains whose observations are partial, equal-timed or deleting.

    Input ``(chain_id, captured_at, idx, full, deleted, props map<string,string>, loose array<string>)``; output
    ``(chain_id, version, valid_from, valid_to, deleted_at, props, outcome)`` rows of versions and rejected observations.
    A chain passes through one task in order, which holds its head only; full chains are better served by
    :func:`linearize`, a window.
    """
    return in_order(united(observations, chain), [chain], ["captured_at", "idx"], _Chain, ["version", "valid_from", "valid_to", "deleted_at", "props", "outcome"], schema)


def change_feed(versions: DataFrame, chain: str, content: list[str], after: Column, until: Column) -> DataFrame:
    """Events in ``(after, until]``: each version's opening with the keys changed since the one before, each deletion."""
    w = W.partitionBy(chain).orderBy("version")
    before = [F.lag(c).over(w).alias(f"__{c}") for c in content]
    rows = versions.select("*", *before)
    changed = F.array_compact(F.array(*(F.when((F.col("version") > 1) & ~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in content)))
    events = F.array(
        F.struct(F.lit("entity_version").alias("event"), F.col("valid_from").alias("at"), F.array_join(changed, ",").alias("changed")),
        F.struct(F.lit("entity_deleted").alias("event"), F.col("deleted_at").alias("at"), F.lit("").alias("changed")),
    )
    return rows.select(chain, "version", F.explode(events).alias("e")).select(chain, "version", "e.*").where((F.col("at") > after) & (F.col("at") <= until))


def edge_feed(edges: DataFrame, after: Column, until: Column) -> DataFrame:
    """Relationship events in ``(after, until]``: opened, version, closed, deleted, cancelled."""
    start = F.when(F.col("version") == 1, "relationship_opened").otherwise("relationship_version")
    kinds = [(start, "valid_from"), (F.lit("relationship_closed"), "valid_to"), (F.lit("relationship_deleted"), "deleted_at"), (F.lit("relationship_cancelled"), "cancelled_at")]
    events = F.array(*(F.struct(k.alias("event"), F.col(c).alias("at")) for k, c in kinds))
    return edges.select("chain_id", "version", F.explode(events).alias("e")).select("chain_id", "version", "e.*").where((F.col("at") > after) & (F.col("at") <= until))


def at_or_near(versions: DataFrame, requests: DataFrame, chain: str = "chain_id") -> DataFrame:
    """For ``(chain_id, t)``: the version in effect at t, else the latest past one, else the earliest future one."""
    joined = requests.join(versions, chain)
    rank = F.when((F.col("valid_from") <= F.col("t")) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to"))), 3).when(F.col("valid_from") <= F.col("t"), 2).otherwise(1)
    past = F.when(rank >= 2, F.col("version")).otherwise(-F.col("version"))
    return joined.groupBy(chain, "t").agg(F.max_by("version", F.struct(rank, past)).alias("version"))
