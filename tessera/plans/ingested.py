"""Queries over the result of ingestion: nations and customers of the given tables in two runs, through every step."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import engine
from tessera.plans.registry import query
from tessera.sources.snapshots import usable_keys
from tessera.sources.store import Store
from tessera.storage import shared_folder, table


def _drafts(rows: DataFrame, kind: str, name: str, key: str, alternate: str | None, properties: dict, lifecycle, at: str) -> DataFrame:
    groups = F.array(F.array(F.lit(alternate))) if alternate else F.array().cast("array<array<string>>")
    props = F.create_map(*(x for k, v in properties.items() for x in (F.lit(k), v)))
    return rows.select(
        F.lit("star").alias("namespace"), F.lit("tables").alias("source"), F.lit(kind).alias("entity_type"), F.col(name).alias("name"), F.array(F.lit(key)).alias("primary_key"), groups.alias("additional_keys"),
        F.map_filter(props, lambda k, v: v.isNotNull()).alias("properties"), lifecycle.alias("lifecycle"), F.lit(at).cast("timestamp").alias("captured_at"),
    )


@lru_cache(4)
def _ingested(spark, sf) -> Store:
    """Two runs: all nations and customers; then customers again.

    In the second run every third customer has another segment, every seventh is deleted, every eleventh goes by its
    label alone (an alternate key), and every thirteenth is older than the first run.
    """
    store = Store(spark, f"{shared_folder(spark)}/tessera/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/store")
    active = F.lit("active")
    nations = _drafts(table(spark, sf, "nation"), "nation", "n_name", "nationkey", None, {"nationkey": F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))}, active, "2024-01-01")
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    own = {"custkey": F.concat(F.lit("c"), k.cast("string")), "label": F.concat_ws("#", "c_name", "c_mktsegment"), "nationkey": F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "segment": F.col("c_mktsegment")}
    engine.ingest(store, usable_keys(nations.unionByName(_drafts(c, "customer", "c_name", "custkey", "label", own, active, "2024-01-01"))), "first")
    again = own | {"segment": F.when(k % 3 == 0, F.lit("moved")).otherwise(F.col("c_mktsegment"))}
    gone = F.when(k % 7 == 0, "deleted").otherwise("active")
    named = _drafts(c.where("c_custkey % 11 <> 0"), "customer", "c_name", "custkey", "label", again, gone, "2024-02-01")
    named = named.withColumn("captured_at", F.when(F.substring(F.col("properties")["custkey"], 2, 20).cast("long") % 13 == 0, F.lit("2023-06-01").cast("timestamp")).otherwise(F.col("captured_at")))
    by_label = _drafts(c.where("c_custkey % 11 = 0"), "customer", "c_name", "label", None, {x: v for x, v in again.items() if x != "custkey"}, gone, "2024-02-01")
    engine.ingest(store, usable_keys(named.unionByName(by_label)), "second")
    return store


_FATE = "select c_name as name, c_nationkey, c_custkey % 11 <> 0 and c_custkey % 13 = 0 as stale, c_custkey % 7 = 0 as dead, c_custkey % 3 = 0 or c_custkey % 11 = 0 as changed from customer"


@query(f"""with f as ({_FATE}) select name, 1 as version, not stale and dead as is_deleted, stale or dead or not changed as is_latest from f
  union all select name, 2, false, true from f where not stale and not dead and changed union all select n_name, 1, false, true from nation""")
def ingested_versions(spark, sf):
    v = _ingested(spark, sf).table("entity_version")
    return v.select("name", "version", F.col("deleted_at").isNotNull().alias("is_deleted"), "is_latest")


@query(f"with f as ({_FATE}) select name as source_name, n_name as target_name from f join nation on n_nationkey = c_nationkey where stale or not dead")
def ingested_edges(spark, sf):
    """The references that are open in the end, by the names of both ends."""
    store = _ingested(spark, sf)
    heads = store.table("entity_version").where("is_latest").select("chain_id", "name")
    named = lambda c, n: heads.select(F.col("chain_id").alias(c), F.col("name").alias(n))
    return store.table("edge").join(named("source_chain", "source_name"), "source_chain").join(named("target_chain", "target_name"), "target_chain").select("source_name", "target_name")


@query(f"with f as ({_FATE}) select name, case when stale then 'stale' end as outcome from f union all select name, null from f union all select n_name, null from nation")
def ingested_outcomes(spark, sf):
    return _ingested(spark, sf).table("observation").select("name", "outcome")
