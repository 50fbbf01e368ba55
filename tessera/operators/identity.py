"""Identity resolution: observations meet stored chains and one another through their keys' digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.components import connected_components


def lookup(observed: DataFrame, index: DataFrame) -> DataFrame:
    """Observations ``(obs, hash)`` with every stored version under the hash, live ones before tombstones.

    ``index`` is ``(hash, chain_id, uuid, version, deleted_at)``; ``preference`` 1 is the version to adopt.
    """
    found = observed.join(index, "hash")
    order = W.partitionBy("obs").orderBy(F.col("deleted_at").isNotNull(), F.desc("version"), "uuid")
    return found.withColumn("preference", F.row_number().over(order))


def preferred(versions: DataFrame, key: str = "chain_id") -> DataFrame:
    """One version a chain: live before deleted, then the higher version, then the larger uuid."""
    return versions.groupBy(key).agg(F.max_by(F.struct("uuid", "version", "deleted_at"), F.struct(F.col("deleted_at").isNull(), "version", "uuid")).alias("best")).select(key, "best.*")


def resolve(observed: DataFrame, index: DataFrame) -> DataFrame:
    """``(obs, component, chain_id, conflict)``: observations that share a key are one component.

    Its chain is the stored one (a conflict if there are two), else null: a new chain named by ``component``.
    """
    first = observed.groupBy("hash").agg(F.min("obs").alias("first"))
    links = observed.join(first, "hash").select(F.col("obs").alias("src"), F.col("first").alias("dst"))
    parts = connected_components(links)
    every = observed.select("obs").distinct().join(parts.withColumnRenamed("node", "obs"), "obs", "left").withColumn("component", F.coalesce("component", "obs"))
    stored = observed.join(index.select("hash", "chain_id").distinct(), "hash").join(every, "obs")
    chains = stored.groupBy("component").agg(F.min("chain_id").alias("chain_id"), (F.count_distinct("chain_id") > 1).alias("conflict"))
    return every.join(chains, "component", "left").select("obs", "component", "chain_id", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def reject(conflicts: DataFrame, members: DataFrame) -> DataFrame:
    """``snapshot`` rows that fall: those with a conflicting component, and all that share a component with one.

    ``conflicts`` is ``(component)``, ``members`` ``(component, snapshot)``.  Rejection spreads over snapshots that have a
    component in common, so it is a component of the snapshot graph.
    """
    first = members.groupBy("component").agg(F.min("snapshot").alias("first"))
    links = members.join(first, "component").select(F.col("snapshot").alias("src"), F.col("first").alias("dst"))
    parts = connected_components(links)
    groups = members.join(parts.withColumnRenamed("node", "snapshot").withColumnRenamed("component", "part"), "snapshot", "left").withColumn("part", F.coalesce("part", "snapshot"))
    bad = groups.join(conflicts.select("component").distinct(), "component", "left_semi").select("part").distinct()
    return groups.join(bad, "part", "left_semi").select("snapshot").distinct()


def without_revived(found: DataFrame) -> DataFrame:
    """Drops matches of an alternate key of a deleted chain whose primary key differs from the observation's."""
    return found.where(~(F.col("deleted_at").isNotNull() & ~F.col("is_primary") & (F.col("stored_primary") != F.col("observed_primary"))))


def usable(asked: DataFrame, index: DataFrame, heads: DataFrame) -> DataFrame:
    """``(hash, chain_id)`` that lead observations ``asked (hash, is_primary, observed_primary)`` to stored chains.

    The same pairs as by :func:`without_revived`, but an observation's primary key is looked up among those of deleted
    chains: a chain with many keys that many observations share is never paired with each of them.
    """
    stored = index.select("hash", "chain_id").distinct().join(heads.select("chain_id", F.col("deleted_at").isNotNull().alias("dead")), "chain_id")
    by_kind = asked.groupBy("hash").agg(F.coalesce(F.max("is_primary"), F.lit(False)).alias("primary"))
    found = stored.join(by_kind, "hash")
    own = index.where("is_primary").select("chain_id", F.col("hash").alias("observed_primary")).join(stored.where("dead").select("chain_id").distinct(), "chain_id", "left_semi")
    same = asked.where("not is_primary").select("hash", "observed_primary").join(own, "observed_primary").select("hash", "chain_id").distinct()
    return found.where("not dead or primary").select("hash", "chain_id").union(found.where("dead and not primary").join(same, ["hash", "chain_id"], "left_semi").select("hash", "chain_id"))


def endpoints(requests: DataFrame, live: DataFrame) -> DataFrame:
    """Declared endpoints ``(request, hash, captured_at)`` that one live match answers, not captured before its last change."""
    found = requests.join(live, "hash")
    one = found.groupBy("request").agg(F.count_distinct("chain_id").alias("n"), F.first("captured_at").alias("captured_at"), F.min("chain_id").alias("chain_id"), F.max("last_transition_at").alias("changed"))
    return one.select("request", F.when((F.col("n") == 1) & (F.col("captured_at") >= F.coalesce("changed", "captured_at")), F.col("chain_id")).alias("chain_id"))


def by_name(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Live entities whose name, or single-property key value, equals one of ``names (name)``, in any case."""
    wanted = names.select(F.lower("name").alias("folded")).distinct()
    either = entities.withColumn("folded", F.explode(F.array_distinct(F.array_compact(F.array(F.lower("name"), F.lower("key_value"))))))
    return either.join(wanted, "folded", "left_semi").drop("folded").distinct()


def property_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(left_id, right_id, overlap)`` from exploded ``(id, key, value)``: agreed keys over the left side's keys."""
    size = a.groupBy("id").agg(F.count_distinct("key").alias("n"))
    agreed = a.join(b.select(F.col("id").alias("right_id"), "key", "value"), ["key", "value"]).groupBy("id", "right_id").agg(F.count_distinct("key").alias("agreed"))
    return agreed.join(size, "id").select(F.col("id").alias("left_id"), "right_id", (F.col("agreed") / F.col("n")).alias("overlap"))
