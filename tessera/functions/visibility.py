"""Predicates of the time model, as column expressions.

Validity is half-open: a version is visible at t from ``valid_from`` up to, not including, its first end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _open_at(t: Column, *ends: Column) -> Column:
    out = F.lit(True)
    for e in ends:
        out = out & (e.isNull() | (t < e))
    return out


def in_scope(org: str, namespaces: list[str] | None = None) -> Column:
    """Rows of one tenant and, if given, of some namespaces."""
    own = F.col("org_id") == org
    return own if namespaces is None else own & F.col("namespace").isin(*namespaces)


def current_entity() -> Column:
    """The head version without an end."""
    return F.col("is_latest") & F.col("valid_to").isNull() & F.col("deleted_at").isNull()


def entity_at(t: Column) -> Column:
    """Entity versions visible at ``t``."""
    return (F.col("valid_from") <= t) & _open_at(t, F.col("valid_to"), F.col("deleted_at"))


def edge_at(t: Column) -> Column:
    """Edges in effect at ``t``, whether or not they are heads: scheduled ones appear by the clock alone."""
    return (F.col("valid_from") <= t) & _open_at(t, F.col("valid_to"), F.col("deleted_at"), F.col("invalid_at")) & F.col("cancelled_at").isNull()


def without_merged(entities: DataFrame, merges: DataFrame, t: Column) -> DataFrame:
    """Entities whose chain is not the loser of a merge period that covers ``t``."""
    m = merges.select(F.col("loser").alias("chain_id"), F.col("valid_from").alias("m_from"), F.col("valid_to").alias("m_to"))
    hidden = m.where((F.col("m_from") <= t) & (F.col("m_to").isNull() | (t < F.col("m_to")))).select("chain_id").distinct()
    return entities.join(hidden, "chain_id", "left_anti")


def endpoint_versions(entities: DataFrame, t: Column) -> DataFrame:
    """The version that classifies each chain at ``t``: the visible one, else, before its history, the earliest.

    ``hydrates`` tells a visible version from one that only classifies.
    """
    first = F.row_number().over(W.partitionBy("chain_id").orderBy("valid_from", "uuid")) == 1
    both = entities.withColumn("first", first).withColumn("hydrates", entity_at(t))
    return both.where(F.col("hydrates") | (F.col("first") & (F.col("valid_from") > t))).drop("first")


def namespace_pairs(namespaces: DataFrame, grants: DataFrame | None = None, shared: str = "shared", open_policy: bool = False) -> DataFrame:
    """``(source_ns, target_ns)`` that may link, from ``(namespace, tier)``: the same, into the shared tier, or by a grant
    ``(from_tier, to_tier)``.  The namespaces are a tenant's list, joined by tier."""
    a = namespaces.select(F.col("namespace").alias("source_ns"), F.col("tier").alias("source_tier"))
    b = namespaces.select(F.col("namespace").alias("target_ns"), F.col("tier").alias("target_tier"))
    tiers = a.select("source_tier").distinct()
    allowed = tiers.select("source_tier", F.lit(shared).alias("target_tier"))
    if grants is not None:
        allowed = allowed.union(grants.select("from_tier", "to_tier"))
    if open_policy:
        allowed = tiers.join(b.select("target_tier").distinct(), F.lit(True))
    pairs = a.join(allowed.distinct(), "source_tier").join(b, "target_tier").select("source_ns", "target_ns")
    return pairs.union(a.select("source_ns", F.col("source_ns").alias("target_ns"))).distinct()


def stale(captured: Column) -> Column:
    """Observations older than anything known of the live version, or not newer than its deletion."""
    live = captured < F.greatest("valid_from", "last_seen_at", "last_transition_at")
    dead = (captured <= F.col("deleted_at")) | (captured <= F.col("last_transition_at"))
    return F.coalesce(F.when(F.col("deleted_at").isNull(), live).otherwise(dead), F.lit(False))


def swept(collections: Column, key: Column, generation: Column) -> Column:
    """Sole member of the observed collection, last seen by an older generation."""
    return F.exists(collections, lambda c: (c["key"] == key) & (c["generation"] < generation)) & ~F.exists(collections, lambda c: c["key"] != key)
