"""End to end: observations of entities become versions and discovered relationships, committed as one step.

A run works on what it touches.  Its drafts meet the stored key index and one another, drafts that share a key are one
chain, and a component with two stored chains is rejected.  Observations fold onto the stored heads of their chains;
older ones are kept as provenance only.  References are discovered for changed chains, and again for sources that carry a
key value which came, went or moved.  A complete scan of a collection deletes the members that it did not see.  All
results are published with one manifest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import values
from tessera.functions.values import framed
from tessera.operators import identity, lifecycle, references
from tessera.sources.folder import SCOPE
from tessera.sources.store import GONE, Store
from tessera.storage import materialise

_ENTITY = ["namespace", "entity_type", "name", "keys", "additional_keys", "properties"]
#: The columns that name a row of each stored table; a later row replaces an earlier one.  Observations all stay.
KEYS = {"entity_version": ["chain_id", "version"], "edge": ["identity"], "key": ["hash", "chain_id"], "member": ["collection", "chain_id"], "observation": []}


@dataclass(frozen=True)
class Scan:
    """A complete scan of a collection: what it does not see is deleted, if ``whole`` (no snapshot failed or was partial)."""

    collection: str
    generation: int
    whole: bool = True


def observe(drafts: DataFrame, run_id: str) -> DataFrame:
    """Observations: drafts without a key problem, each once, with ``obs`` (a digest of all it says) and ``content``."""
    ok = drafts.where("key_problem is null")
    dead = F.col("lifecycle") == "deleted"
    content = F.when(dead, F.lit("deleted")).otherwise(F.sha2(framed(F.col("name"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("properties"))))), 256))
    rows = ok.withColumn("additional_keys", F.coalesce("additional_keys", F.array().cast("array<array<string>>"))).withColumn("content", content)
    own = framed(F.col("namespace"), F.col("entity_type"), F.to_json("keys"), F.to_json("additional_keys"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("properties")))), F.col("lifecycle"), F.col("captured_at").cast("string"))
    return rows.withColumn("obs", F.sha2(own, 256)).withColumn("run_id", F.lit(run_id)).dropDuplicates(["obs"])


def key_hashes(rows: DataFrame, row: str) -> DataFrame:
    """``(row, hash, is_primary)`` of every complete key group; a hash says namespace, type, names and values."""
    groups = F.array_union(F.array("keys"), F.coalesce("additional_keys", F.array().cast("array<array<string>>")))
    value = lambda k: F.when(k == "name", F.col("name")).otherwise(F.try_element_at("properties", k))
    whole = lambda g: F.forall(g, lambda k: value(k).isNotNull() & (F.trim(value(k)) != "")) & (F.size(g) > 0)
    digest = lambda g: F.sha2(framed(F.col("namespace"), F.col("entity_type"), F.array_join(F.transform(F.array_sort(g), lambda k: framed(k, value(k))), "")), 256)
    hashed = F.transform(F.filter(groups, whole), lambda g: F.struct(digest(g).alias("hash"), (g == F.col("keys")).alias("is_primary")))
    return rows.select(row, F.explode(F.array_distinct(hashed)).alias("h")).select(row, "h.*").groupBy(row, "hash").agg(F.max("is_primary").alias("is_primary"))


def resolve(observations: DataFrame, heads: DataFrame, index: DataFrame) -> DataFrame:
    """Observations with ``chain_id`` and ``outcome`` (null, or ``identity conflict``).

    An alternate key of a deleted chain with another primary key leads nowhere.  A conflict takes all observations of
    its snapshot, and of snapshots that share a component with one, where drafts name their snapshot.
    """
    hashes = materialise(key_hashes(observations, "obs"), "hashes")
    primary = hashes.where("is_primary").select("obs", F.col("hash").alias("observed_primary"))
    asked = hashes.join(primary, "obs").select("hash", "is_primary", "observed_primary").distinct()
    usable = materialise(identity.usable(asked, index, heads), "usable")
    parts = materialise(identity.resolve(hashes.select("obs", "hash"), usable), "parts")
    fresh = parts.join(primary, "obs").groupBy("component").agg(F.min("observed_primary").alias("fresh"))
    named = parts.join(fresh, "component").withColumn("chain_id", F.coalesce("chain_id", "fresh")).drop("fresh")
    rows = observations.join(named, "obs")
    conflict = F.col("conflict")
    if "snapshot" in observations.columns:
        members = rows.select("component", "snapshot").distinct()
        fallen = identity.reject(rows.where("conflict").select("component").distinct(), members).withColumn("fallen", F.lit(True))
        rows = rows.join(fallen, "snapshot", "left")
        conflict = conflict | F.coalesce("fallen", F.lit(False))
        rows = rows.withColumn("outcome", F.when(conflict, "identity conflict")).drop("fallen")
    else:
        rows = rows.withColumn("outcome", F.when(conflict, "identity conflict"))
    return rows.drop("component", "conflict")


def judge(observations: DataFrame, heads: DataFrame) -> DataFrame:
    """Adds outcomes against the stored heads and one another: ``stale``, ``ignored`` (deletes nothing), ``two contents at one time``."""
    h = heads.select("chain_id", F.greatest("valid_from", "last_seen_at").alias("clock"), F.col("deleted_at").alias("died"), F.col("content").alias("was"))
    rows = observations.join(h, "chain_id", "left")
    at, dead = F.col("captured_at"), F.col("lifecycle") == "deleted"
    good = F.col("outcome").isNull()
    alive = F.col("clock").isNotNull() & F.col("died").isNull()
    old = F.when(alive, at < F.col("clock")).when(F.col("died").isNotNull(), at <= F.col("died")).otherwise(False)
    rows = rows.withColumn("outcome", F.when(good & old, "stale").when(good & alive & (at == F.col("clock")) & (F.col("content") != F.col("was")), "two contents at one time").otherwise(F.col("outcome")))
    good = F.col("outcome").isNull()
    instant = W.partitionBy("chain_id", "captured_at")
    most, least = (f(F.when(good, F.col("content"))).over(instant) for f in (F.max, F.min))
    rows = rows.withColumn("outcome", F.when(good & (most != least), "two contents at one time").otherwise(F.col("outcome")))
    good = F.col("outcome").isNull()
    first_alive = F.min(F.when(good & ~dead, at)).over(W.partitionBy("chain_id"))
    known = F.col("clock").isNotNull() | (F.coalesce(first_alive <= at, F.lit(False)))
    return rows.withColumn("outcome", F.when(good & dead & ~known, "ignored").otherwise(F.col("outcome"))).drop("clock", "died", "was")


def fold_onto(heads: DataFrame, observations: DataFrame) -> DataFrame:
    """New and changed versions of touched chains: good ``observations`` folded onto the stored ``heads``.

    Equal content continues a version, other content opens the next, a deletion ends it, a later return opens the next.
    """
    head = heads.join(observations.select("chain_id").distinct(), "chain_id", "left_semi")
    shape = ["chain_id", "captured_at", "seen_at", "content", "base", *_ENTITY]
    living = head.withColumn("captured_at", F.col("valid_from")).withColumn("seen_at", F.col("last_seen_at")).withColumn("base", F.col("version"))
    gone = head.where("deleted_at is not null").withColumn("captured_at", F.col("deleted_at")).withColumn("seen_at", F.col("deleted_at")).withColumn("base", F.lit(None).cast("int")).withColumn("content", F.lit("deleted"))
    new = observations.withColumn("seen_at", F.col("captured_at")).withColumn("base", F.lit(None).cast("int"))
    rows = living.select(shape).unionByName(gone.select(shape)).unionByName(new.select(shape))
    w = W.partitionBy("chain_id").orderBy("captured_at", F.col("base").asc_nulls_last(), "content")
    rows = rows.withColumn("new", F.when(F.col("content") == F.lag("content").over(w), 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    first = F.min_by(F.struct("content", *_ENTITY), F.struct("captured_at", F.col("base").isNull()))
    islands = rows.groupBy("chain_id", "island").agg(F.min("captured_at").alias("valid_from"), F.max("seen_at").alias("last_seen_at"), F.max("base").alias("base"), first.alias("o")).select("chain_id", "island", "valid_from", "last_seen_at", "base", "o.*")
    v = W.partitionBy("chain_id").orderBy("island")
    dead = F.col("content") == "deleted"
    islands = islands.withColumn("next_from", F.lead("valid_from").over(v)).withColumn("next_dead", F.lead(dead).over(v)).withColumn("base", F.max("base").over(W.partitionBy("chain_id")))
    alive = islands.where(~dead).withColumn("version", (F.coalesce("base", F.lit(1)) + F.row_number().over(v) - 1).cast("int"))
    alive = alive.withColumn("deleted_at", F.when(F.col("next_dead"), F.col("next_from"))).withColumn("valid_to", F.when(~F.col("next_dead"), F.col("next_from")))
    latest = F.col("version") == F.max("version").over(W.partitionBy("chain_id"))
    return alive.select("chain_id", "version", "valid_from", "last_seen_at", "content", *_ENTITY, "valid_to", "deleted_at", latest.alias("is_latest"))


def key_tokens(heads: DataFrame) -> DataFrame:
    """``(token, chain_id, target_type, key_group, group_size)`` of live heads: single properties, or one under scope properties."""
    groups = F.array_union(F.array("keys"), "additional_keys")
    each = heads.select("chain_id", "entity_type", "properties", F.explode(groups).alias("g"))
    each = each.withColumn("own", F.filter("g", lambda k: ~k.startswith(f"{SCOPE}."))).where(F.size("own") == 1)
    value = F.try_element_at("properties", F.col("own")[0])
    under = F.array_join(F.array_append(_scope(F.col("properties"), lambda x: F.array_contains(F.col("g"), x["key"]) & x["key"].startswith(f"{SCOPE}.")), value), "|")
    return each.select(F.when(F.size("g") == 1, value).otherwise(under).alias("token"), "chain_id", F.col("entity_type").alias("target_type"), F.col("own").alias("key_group"), F.lit(1).alias("group_size")).where("token is not null")


def _scope(props, kept):
    return F.array_sort(F.transform(F.filter(F.map_entries(props), kept), lambda x: framed(x["key"], x["value"])))


def reference_tokens(heads: DataFrame) -> DataFrame:
    """``(source, source_type, location, token, from_list)``: every property, list element and nested value of live heads, plain
    and under the entity's own scope.  Scope and identity properties themselves are no references."""
    own_scope = _scope(F.col("properties"), lambda x: x["key"].startswith(f"{SCOPE}."))
    flat = heads.select(F.col("chain_id").alias("source"), F.col("entity_type").alias("source_type"), own_scope.alias("scope"), F.explode("properties").alias("path", "value")).where(~F.col("path").startswith("_"))
    keep = ["source", "source_type", "scope"]
    scalars = flat.where(~F.col("value").rlike(r"^\s*[\[{]")).select(*keep, F.col("path").alias("location"), F.col("value").alias("token"), F.lit(False).alias("from_list"))
    items = flat.where(F.col("value").rlike(r"^\s*\[")).select(*keep, "path", F.posexplode(F.from_json("value", "array<string>")).alias("i", "item"))
    at = F.concat("path", F.lit("["), F.col("i").cast("string"), F.lit("]"))
    plain = items.where(~F.col("item").rlike(r"^\s*[\[{]")).select(*keep, at.alias("location"), F.col("item").alias("token"), F.lit(True).alias("from_list"))
    nested = items.where(F.col("item").rlike(r"^\s*\{")).select(*keep, at.alias("at"), F.explode(values.flatten_json(F.col("item"))).alias("m"))
    nested = nested.select(*keep, F.concat_ws(".", "at", "m.key").alias("location"), F.col("m.value").alias("token"), F.lit(True).alias("from_list"))
    seen = scalars.union(plain).union(nested).where("trim(token) <> ''").distinct()
    forms = F.array_distinct(F.array(F.col("token"), F.when(F.size("scope") > 0, F.array_join(F.array_append("scope", F.col("token")), "|")).otherwise(F.col("token"))))
    return seen.withColumn("token", F.explode(forms)).drop("scope")


def discover(sources: DataFrame, heads: DataFrame) -> DataFrame:
    """Reference edges from ``sources`` to live ``heads`` whose complete keys their values name."""
    observed = materialise(reference_tokens(sources), "observed")
    found = references.structural(references.carriers(observed, key_tokens(heads))).withColumn("match_class", F.lit(2))
    return references.edges(references.decide(found, observed), observed)


def _live(heads: DataFrame) -> DataFrame:
    return heads.where("deleted_at is null and valid_to is null")


def ingest(store: Store, drafts: DataFrame, run_id: str, scan: Scan | None = None, owned: DataFrame | None = None) -> dict:
    """One run: resolve, judge, fold, discover, commit; counts are of this run.  A committed run writes nothing again.

    ``owned`` ``(parent, child)`` are chains of which a child dies when no parent lives.
    """
    if (done := store.receipt(run_id)) is not None:
        return done | {"counts": dict.fromkeys(done["counts"], 0)}
    parent = store.revision()
    new = store.journal(run_id, observe(drafts, run_id))
    spark = store.spark
    stored = store.table("entity_version", parent)
    if stored is None:
        stored = spark.createDataFrame([], f"chain_id string, version int, valid_from timestamp, last_seen_at timestamp, content string, {', '.join(f'{c} {k}' for c, k in new.dtypes if c in _ENTITY)}, valid_to timestamp, deleted_at timestamp, is_latest boolean")
        stored = stored.select("chain_id", "version", "valid_from", "last_seen_at", "content", *_ENTITY, "valid_to", "deleted_at", "is_latest")
    index = store.table("key", parent)
    if index is None:
        index = spark.createDataFrame([], "hash string, chain_id string, is_primary boolean")
    heads = stored.where("is_latest")
    seen = materialise(judge(resolve(new, heads, index), heads), "judged")
    good = seen.where("outcome is null")
    members = none = spark.createDataFrame([], "collection string, chain_id string, generation long")
    if scan is not None:
        members = store.table("member", parent)
        members = none if members is None else members
        good = good.unionByName(_swept(scan, members, good, seen, heads, owned, run_id), allowMissingColumns=True)
    good = materialise(good.unionByName(_orphans(good, heads, owned, run_id), allowMissingColumns=True) if owned is not None else good, "good")
    folded = materialise(fold_onto(heads, good), "versions")
    touched = folded.where("is_latest")
    now = materialise(heads.join(touched.select("chain_id"), "chain_id", "left_anti").unionByName(touched), "heads")

    was, became = _live(heads.join(touched.select("chain_id"), "chain_id", "left_semi")), _live(touched)
    before, after = key_tokens(was).select("token", "chain_id"), key_tokens(became).select("token", "chain_id")
    moved = materialise(before.exceptAll(after).union(after.exceptAll(before)).select("token").distinct(), "moved")
    live = _live(now)
    changed = became.join(was.select("chain_id", "version"), ["chain_id", "version"], "left_anti").select("chain_id")
    woken = references_woken(live, moved)
    again = materialise(changed.union(woken).distinct(), "again")
    edges = materialise(discover(live.join(again, "chain_id", "left_semi"), live), "edges")
    had = store.table("edge", parent)
    old = edges.limit(0) if had is None else had
    gone_sources = was.select("chain_id").join(became.select("chain_id"), "chain_id", "left_anti")
    looked = again.union(gone_sources).select(F.col("chain_id").alias("source_chain")).distinct()
    opened = edges.join(old.select("identity"), "identity", "left_anti")
    closed = old.join(looked, "source_chain", "left_semi").join(edges.select("identity"), "identity", "left_anti")
    edge = opened.withColumn(GONE, F.lit(False)).unionByName(closed.withColumn(GONE, F.lit(True)))

    keys = key_hashes(good.where("lifecycle <> 'deleted'"), "chain_id").select("hash", "chain_id", "is_primary")
    tables = {"entity_version": folded, "edge": edge, "key": keys, "observation": seen}
    if scan is not None:
        held = good.where("lifecycle <> 'deleted'").select(F.lit(scan.collection).alias("collection"), "chain_id", F.lit(scan.generation).cast("long").alias("generation")).distinct()
        left = members.where(F.col("collection") == scan.collection).join(held, "chain_id", "left_anti") if scan.whole else none
        tables["member"] = held.withColumn(GONE, F.lit(False)).unionByName(left.withColumn(GONE, F.lit(True)))
    fresh = folded.join(stored.select("chain_id").distinct(), "chain_id", "left_anti")
    counts = {
        "entities_created": fresh.select("chain_id").distinct().count(),
        "entities_updated": folded.where("version > 1").join(stored.select("chain_id", "version"), ["chain_id", "version"], "left_anti").count(),
        "entities_deleted": touched.where("deleted_at is not null").join(heads.where("deleted_at is not null").select("chain_id", "version"), ["chain_id", "version"], "left_anti").count(),
        "edges_created": opened.count(),
        "edges_closed": closed.count(),
    }
    outcomes = {r.outcome: r.n for r in seen.where("outcome is not null").groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}  # four kinds at most
    claims = {scan.collection: scan.generation} if scan is not None else None
    return store.commit(run_id, tables, counts, parent, claims, KEYS) | {"outcomes": outcomes}


def references_woken(live: DataFrame, moved: DataFrame) -> DataFrame:
    """Sources ``(chain_id)`` that carry one of the ``moved (token)`` key values."""
    return reference_tokens(live).join(moved, "token", "left_semi").select(F.col("source").alias("chain_id")).distinct()


def _deaths(heads: DataFrame, deleted: DataFrame, run_id: str) -> DataFrame:
    """Deleting observations of live heads named by ``deleted (chain_id, captured_at)``."""
    rows = _live(heads).join(deleted, "chain_id").where(F.col("captured_at") > F.greatest("valid_from", "last_seen_at"))
    return rows.select("chain_id", "captured_at", F.lit("deleted").alias("content"), F.lit("deleted").alias("lifecycle"), F.lit(run_id).alias("run_id"), *_ENTITY)


def _swept(scan: Scan, members: DataFrame, good: DataFrame, seen: DataFrame, heads: DataFrame, owned: DataFrame | None, run_id: str) -> DataFrame:
    """Deaths of the collection's members that a whole scan did not see and no other collection holds."""
    captured = seen.agg(F.max("captured_at").alias("t")).first().t
    if not scan.whole or captured is None or not seen.where("outcome = 'identity conflict'").isEmpty():
        return _deaths(heads.limit(0), heads.select("chain_id", F.lit(None).cast("timestamp").alias("captured_at")).limit(0), run_id)
    mine = members.where((F.col("collection") == scan.collection) & (F.col("generation") < scan.generation)).select("chain_id")
    held = members.groupBy("chain_id").agg(F.count_distinct("collection").alias("n_collections"))
    known = heads.select("chain_id", "last_seen_at").join(mine, "chain_id", "left_semi").join(held, "chain_id")
    fate = lifecycle.sweep(known, seen.select("chain_id"), F.lit(captured))
    return _deaths(heads, fate.where("action = 'delete'").select("chain_id", F.lit(captured).alias("captured_at")), run_id)


def _orphans(good: DataFrame, heads: DataFrame, owned: DataFrame, run_id: str) -> DataFrame:
    """Deaths of owned children all of whose parents die in this run."""
    dead = good.where("lifecycle = 'deleted'").groupBy("chain_id").agg(F.max("captured_at").alias("captured_at"))
    last = dead.agg(F.max("captured_at").alias("captured_at"))
    gone = lifecycle.cascade(dead.select("chain_id"), owned).join(dead.select("chain_id"), "chain_id", "left_anti")
    return _deaths(heads, gone.join(F.broadcast(last), F.lit(True)), run_id)  # one row
