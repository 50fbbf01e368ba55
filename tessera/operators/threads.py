"""Threads: ordered sequences of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def members(snapshots: DataFrame, thread: str, order: list[str], snapshot: str) -> DataFrame:
    """Adds each snapshot's ``ordinal`` in its thread and the ``previous_snapshot`` and ``next_snapshot``."""
    w = W.partitionBy(thread).orderBy(*order)
    return snapshots.withColumn("ordinal", F.row_number().over(w)).withColumn("previous_snapshot", F.lag(snapshot).over(w)).withColumn("next_snapshot", F.lead(snapshot).over(w))


def state(snapshots: DataFrame, thread: str, order: list[str], snapshot: str, captured: str) -> DataFrame:
    """First and last snapshot, number of members and first capture of each thread."""
    key = F.struct(*order)
    return snapshots.groupBy(thread).agg(F.min_by(snapshot, key).alias("first_snapshot"), F.max_by(snapshot, key).alias("last_snapshot"), F.count(F.lit(1)).alias("n_members"), F.min(captured).alias("first_captured_at"))


def in_thread(snapshots: DataFrame, members: DataFrame, thread: DataFrame) -> DataFrame:
    """Snapshots that belong to one of the threads ``thread (thread)``; ``members`` is ``(thread, snapshot)``."""
    return snapshots.join(members.join(thread.select("thread").distinct(), "thread", "left_semi").select("snapshot"), "snapshot", "left_semi")


def visible(states: DataFrame, t: Column) -> DataFrame:
    """Threads whose first capture is not after ``t``."""
    return states.where(F.col("first_captured_at") <= t)


def context(numbered: DataFrame, thread: str, cutoff: Column, size: int) -> DataFrame:
    """The ``size`` members before an ordinal, in order."""
    return numbered.where((F.col("ordinal") < cutoff) & (F.col("ordinal") >= cutoff - size))
