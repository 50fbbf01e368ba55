"""Deletion, reconciliation of complete scans, merges and splits of chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialise


def incident(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """What a deletion ``(chain_id, deleted_at)`` does to edges at either end: ``close`` what started, ``cancel`` what has not."""
    ends = [edges.join(deleted.withColumnRenamed("chain_id", c), c) for c in ("source_chain", "target_chain")]
    both = ends[0].select(*edges.columns, "deleted_at").union(ends[1].select(*edges.columns, "deleted_at"))
    first = both.groupBy(*edges.columns).agg(F.min("deleted_at").alias("at"))
    return first.withColumn("action", F.when(F.col("valid_from") > F.col("at"), "cancel").otherwise("close"))


def cascade(deleted: DataFrame, owned: DataFrame) -> DataFrame:
    """Chains that die: the deleted ones and, to a fixpoint, children ``(parent, child)`` none of whose parents lives.

    A round joins the newest deaths' children with their parents still alive; every round is a written table.
    """
    dead = materialise(deleted.select("chain_id").distinct(), "dead")
    while True:
        living = owned.join(dead.withColumnRenamed("chain_id", "parent"), "parent", "left_anti").select("child").distinct()
        gone = owned.join(dead.withColumnRenamed("chain_id", "parent"), "parent", "left_semi").select("child").distinct()
        fresh = gone.join(living, "child", "left_anti").select(F.col("child").alias("chain_id")).join(dead, "chain_id", "left_anti")
        fresh = materialise(fresh, "dying")
        if fresh.isEmpty():
            return dead
        dead = materialise(dead.union(fresh), "dead")


def sweep(members: DataFrame, observed: DataFrame, captured: Column) -> DataFrame:
    """The fate of stored members ``(chain_id, n_collections, last_seen_at)`` that a complete scan did not observe.

    Seen later than the scan: protect.  Member of other collections: release.  Else: delete.
    """
    missing = members.join(observed.select("chain_id").distinct(), "chain_id", "left_anti")
    return missing.withColumn("action", F.when(F.col("last_seen_at") > captured, "protect").when(F.col("n_collections") > 1, "release").otherwise("delete"))


def sweep_relationships(edges: DataFrame, key: str, generation: int, captured: Column) -> DataFrame:
    """The fate of open edges whose membership ``collections array<struct<key, generation>>`` a complete scan of ``key`` left behind.

    Seen later than the scan: protect.  Also member of another collection: release.  Not yet started: cancel.  Else: close.
    """
    behind = edges.where(F.exists("collections", lambda c: (c["key"] == key) & (c["generation"] < generation)))
    shared = F.exists("collections", lambda c: c["key"] != key)
    return behind.withColumn("action", F.when(F.col("last_seen_at") > captured, "protect").when(shared, "release").when(F.col("valid_from") > captured, "cancel").otherwise("close"))


def sweepable(snapshots: DataFrame) -> DataFrame:
    """Collections ``(key)`` whose scan may sweep: every snapshot ``(key, complete, failed, partial)`` of it complete, none
    failed or partly extracted."""
    return snapshots.groupBy("key").agg(F.bool_and(F.col("complete") & ~F.col("failed") & ~F.col("partial")).alias("whole")).where("whole").select("key")


def stale_members(members: DataFrame, generation: int) -> DataFrame:
    """Members ``(chain_id, collections array<struct<key, generation>>)`` that an older generation of their collection saw."""
    return members.where(F.exists("collections", lambda c: c["generation"] < generation))


def merge(merges: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge periods that may be applied (no chain both wins and loses), and the losers' open facts closed at the merge."""
    losers = merges.select(F.col("loser").alias("winner")).distinct()
    valid = merges.join(losers, "winner", "left_anti")
    closed = facts.join(valid.select(F.col("loser").alias("source_chain"), F.col("valid_from").alias("merged_at")), "source_chain")
    return valid, closed.where("valid_to is null and valid_from < merged_at").withColumn("valid_to", F.col("merged_at")).drop("merged_at")


def split(grants: DataFrame, native: DataFrame, ended: DataFrame) -> DataFrame:
    """Alias hashes that end with merges ``ended (merge_id)``: not granted by another merge, not native to the winner."""
    going = grants.join(ended, "merge_id", "left_semi")
    kept = grants.join(ended, "merge_id", "left_anti").select("winner", "hash").union(native.select("winner", "hash")).distinct()
    return going.join(kept, ["winner", "hash"], "left_anti").select("winner", "hash").distinct()
