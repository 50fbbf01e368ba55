"""The given tables as a temporal knowledge graph.

Star-schema rows are entities with typed keys (``customer:17``), so that a value names one entity; foreign keys are the
references.  Events are observations of a chain per user: the type is versioned, the value is loose.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import versions
from tessera.storage import table

#: Entity types with table, key, name column and references (column, target type).
TYPES = {
    "region": ("region", "r_regionkey", "r_name", ()),
    "nation": ("nation", "n_nationkey", "n_name", (("n_regionkey", "region"),)),
    "customer": ("customer", "c_custkey", "c_name", (("c_nationkey", "nation"),)),
    "supplier": ("supplier", "s_suppkey", "s_name", (("s_nationkey", "nation"),)),
    "part": ("part", "p_partkey", "p_name", ()),
    "orders": ("orders", "o_orderkey", "o_orderpriority", (("o_custkey", "customer"),)),
}


def chain(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def entities(spark: SparkSession, sf: str, kinds=tuple(TYPES)) -> DataFrame:
    """``(entity_type, chain_id, name, namespace)``; customers' and suppliers' namespace is their nation's key."""
    parts = []
    for kind in kinds:
        name, key, label, _ = TYPES[kind]
        space = {"customer": "c_nationkey", "supplier": "s_nationkey", "nation": "n_regionkey"}.get(kind)
        parts.append(table(spark, sf, name).select(F.lit(kind).alias("entity_type"), chain(kind, key).alias("chain_id"), F.col(label).alias("name"), (F.col(space).cast("string") if space else F.lit("shared")).alias("namespace")))
    return reduce(DataFrame.union, parts)


def reference_values(spark: SparkSession, sf: str, kinds=tuple(TYPES)) -> DataFrame:
    """Observed reference fields ``(source, source_type, location, token, from_list)`` with typed tokens."""
    parts = []
    for kind in kinds:
        name, key, _, references = TYPES[kind]
        for column, target in references:
            parts.append(table(spark, sf, name).select(chain(kind, key).alias("source"), F.lit(kind).alias("source_type"), F.lit(column).alias("location"), chain(target, column).alias("token"), F.lit(False).alias("from_list")))
    return reduce(DataFrame.union, parts)


def key_index(spark: SparkSession, sf: str, kinds=tuple(TYPES)) -> DataFrame:
    """Complete single-field keys ``(token, chain_id, target_type, key_group, group_size)``; a key's name has no prefix."""
    parts = []
    for kind in kinds:
        name, key, _, _ = TYPES[kind]
        parts.append(table(spark, sf, name).select(chain(kind, key).alias("token"), chain(kind, key).alias("chain_id"), F.lit(kind).alias("target_type"), F.array(F.lit(key.split("_", 1)[1])).alias("key_group"), F.lit(1).alias("group_size")))
    return reduce(DataFrame.union, parts)


def direct_edges(spark: SparkSession, sf: str, kinds=tuple(TYPES)) -> DataFrame:
    """``(source_chain, target_chain, name)`` of the declared foreign keys."""
    return reference_values(spark, sf, kinds).select(F.col("source").alias("source_chain"), F.col("token").alias("target_chain"), F.lit("RELATES_TO").alias("name"))


def event_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of each user's event type."""
    return versions.linearize(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_type"], "ts")


def event_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their lifecycle kind; an ``error`` event deletes its user."""
    return versions.tombstones(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "ts", F.col("event_type") == "error")


#: SQL of the same relations, to build oracles from.
SQL_EVENT_VERSIONS = """
  select user_id, version, event_type, min(ts) as valid_from, max(ts) as last_seen_at, count(*) as n_observations,
         lead(min(ts)) over (partition by user_id order by version) as valid_to
  from (select *, cast(sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as integer) as version
        from (select *, case when event_type is not distinct from lag(event_type) over (partition by user_id order by ts, event_id)
                             and row_number() over (partition by user_id order by ts, event_id) > 1 then 0 else 1 end as new from events))
  group by user_id, version, event_type
"""
SQL_ENTITIES = """
  select 'region' as entity_type, 'region:' || r_regionkey as chain_id, r_name as name, 'shared' as namespace from region
  union all select 'nation', 'nation:' || n_nationkey, n_name, cast(n_regionkey as varchar) from nation
  union all select 'customer', 'customer:' || c_custkey, c_name, cast(c_nationkey as varchar) from customer
  union all select 'supplier', 'supplier:' || s_suppkey, s_name, cast(s_nationkey as varchar) from supplier
  union all select 'part', 'part:' || p_partkey, p_name, 'shared' from part
  union all select 'orders', 'orders:' || o_orderkey, o_orderpriority, 'shared' from orders
"""
SQL_EDGES = """
  select 'nation:' || n_nationkey as source_chain, 'region:' || n_regionkey as target_chain, 'n_regionkey' as location, 'nation' as source_type from nation
  union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'c_nationkey', 'customer' from customer
  union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 's_nationkey', 'supplier' from supplier
  union all select 'orders:' || o_orderkey, 'customer:' || o_custkey, 'o_custkey', 'orders' from orders
"""
