"""Relationship discovery: property values that equal other entities' complete keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.names import plain_path, slot, structural_reference
from tessera.storage import materialise

#: Carriers of one value that a lookup returns at most; one more proves that it was cut.
CARRIERS = 8
#: Tokens of an object that is looked up by all subsets of its tokens (at most 2 ** NARROW).
NARROW = 6


def scan(values: DataFrame, most: int = 128) -> DataFrame:
    """Numbered observations ``(source, location, token, ...)`` of each source; ``truncated`` marks sources beyond ``most``."""
    w = W.partitionBy("source")
    rows = values.withColumn("n", F.row_number().over(w.orderBy("location", "token"))).withColumn("truncated", F.count(F.lit(1)).over(w) > most)
    return rows.where(F.col("n") <= most).drop("n")


def carriers(observed: DataFrame, targets: DataFrame, most: int = CARRIERS, folded: bool = False, extra: list[str] | None = None) -> DataFrame:
    """Observations with the targets whose key has their token: at most ``most``, by chain; ``capped`` if there are more.

    Tokens with more than ``most`` carriers are cut down on the target side first (a map-side aggregate of counts, then
    a limited window), so a value that everything carries is never expanded.  Scope filters come before the cap: put
    their columns into ``extra``, they are join keys too.
    """
    keys = ["token", *(extra or [])]
    if folded:
        observed, targets = (d.withColumn("token", F.lower("token")) for d in (observed, targets))
    held = targets.select(*keys, "chain_id", "target_type", "key_group", "group_size").distinct()
    ranked = held.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("chain_id", "key_group"))).where(F.col("r") <= most + 1)
    ranked = ranked.withColumn("capped", F.max("r").over(W.partitionBy(*keys)) > most).where(F.col("r") <= most).drop("r")
    return observed.join(ranked, keys)


def decide(matches: DataFrame, observed: DataFrame) -> DataFrame:
    """One row an observation ``(source, location, token)``: the edge's target, or why there is none.

    ``matches`` has ``chain_id, match_class`` (3 complete group, 2 single-field group, 1 name only, 0 partial), ``capped``
    and ``structural``.
    """
    keys = ["source", "location", "token"]
    best = matches.where(F.col("chain_id") != F.col("source")).groupBy(*keys).agg(
        F.max("match_class").alias("class"),
        F.min(F.when(F.col("match_class") >= 2, F.col("chain_id"))).alias("target"),
        F.max(F.when(F.col("match_class") >= 2, F.col("chain_id"))).alias("other"),
        F.bool_or("capped").alias("capped"),
        F.bool_or(F.col("structural") & (F.col("match_class") >= 2)).alias("structural"),
    )
    rows = observed.select(*keys).distinct().join(best, keys, "left")
    why = (
        F.when(F.col("class").isNull(), "target-not-found")
        .when(F.col("capped"), "lookup-truncated")
        .when(F.col("class") == 0, "partial-key")
        .when(F.col("class") == 1, "display-name-only")
        .when(F.col("other") > F.col("target"), "multiple-candidates")
        .when(~F.col("structural"), "insufficient-reference-evidence")
    )
    return rows.select(*keys, why.alias("reason"), F.when(why.isNull(), F.col("target")).alias("target"))


def structural(matches: DataFrame) -> DataFrame:
    """Adds ``structural``: the name test is run once for each distinct place, type and key group, then joined back."""
    triples = matches.select(plain_path(F.col("location")).alias("place"), "target_type", "key_group").distinct()
    judged = triples.withColumn("structural", structural_reference(F.col("place"), F.col("target_type"), F.col("key_group")))
    return matches.withColumn("place", plain_path(F.col("location"))).join(judged, ["place", "target_type", "key_group"]).drop("place")


def objects(observed: DataFrame) -> DataFrame:
    """``(source, object_path, fields)`` of observed fields ``(source, object_path, field, token)``: one row an object."""
    return observed.groupBy("source", "object_path").agg(F.collect_set(F.struct("field", "token")).alias("fields"))


def key_groups(groups: DataFrame) -> DataFrame:
    """``(chain_id, group_id, size, parts)`` of components ``(chain_id, group_id, property, token, size)``: one row a group."""
    return groups.groupBy("chain_id", "group_id", "size").agg(F.collect_set(F.struct("property", "token")).alias("parts"))


def composite(observed: DataFrame, groups: DataFrame) -> DataFrame:
    """:func:`complete` over single fields ``(source, object_path, field, token)`` and components ``(chain_id, group_id, property, token, size)``."""
    return complete(objects(observed), key_groups(groups))


def complete(seen: DataFrame, wholes: DataFrame) -> DataFrame:
    """``(source, object_path, chain_id, group_id)``: key groups completed by sibling fields of one object.

    ``seen`` is ``(source, object_path, fields array<struct<field, token>>)``, a row an object, ``wholes`` ``(chain_id,
    group_id, size, parts array<struct<property, token>>)``, a row a group.  Every component needs a field of its own; a
    field named like a component with another value rejects the match.

    Objects of at most NARROW tokens are looked up by their sets of tokens, so they meet only groups all of whose tokens
    they have.  Wider ones collect a group's tokens one after the other, the rarest first.  What many groups share
    multiplies nothing on either way.
    """
    tokens = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.transform(c, lambda x: x["token"]))))
    seen, wholes = seen.withColumn("tokens", tokens("fields")), wholes.withColumn("tokens", tokens("parts"))
    narrow, wide = seen.where(F.size("tokens") <= NARROW), seen.where(F.size("tokens") > NARROW)
    sizes = sorted(r.n for r in wholes.select(F.size("tokens").alias("n")).where("n > 0").distinct().collect())  # as many as kinds of keys
    met = []
    if fit := [n for n in sizes if n <= NARROW]:
        asked = narrow.select("source", "object_path", "fields", F.explode(_subsets(F.col("tokens"), fit)).alias("tokens"))
        met.append(asked.join(wholes, "tokens"))
    if sizes and not wide.isEmpty():
        met.append(_collected(wide, wholes, sizes[-1]))
    if not met:
        return seen.join(wholes, F.lit(False)).select("source", "object_path", "chain_id", "group_id")
    found = F.filter("parts", lambda p: F.exists("fields", lambda f: f["token"] == p["token"]))
    used = F.filter("fields", lambda f: F.exists("parts", lambda p: f["token"] == p["token"]))
    components, own = F.size(F.array_distinct(found["property"])), F.size(F.array_distinct(used["field"]))
    conflict = F.exists("parts", lambda p: F.exists("fields", lambda f: F.coalesce((f["field"] == p["property"]) & (f["token"] != p["token"]), F.lit(False))))
    whole = (components == F.col("size")) & (own >= F.col("size")) & ~conflict
    return reduce(DataFrame.unionByName, [m.where(whole).select("source", "object_path", "chain_id", "group_id") for m in met])


def _subsets(tokens: Column, sizes: list[int]) -> Column:
    """The sorted subsets of at most NARROW sorted tokens that have one of ``sizes``."""
    if sizes == [1]:
        return F.transform(tokens, lambda t: F.array(t))
    if sizes == [2]:
        pairs = F.transform(tokens, lambda a, i: F.transform(F.slice(tokens, i + 2, NARROW), lambda b: F.array(a, b)))
        return F.flatten(pairs)
    every = F.aggregate(tokens, F.array(F.array().cast("array<string>")), lambda sets, t: F.concat(sets, F.transform(sets, lambda s: F.array_append(s, t))))
    return F.filter(every, lambda s: F.size(s).isin(*sizes))


def _collected(wide: DataFrame, wholes: DataFrame, longest: int) -> DataFrame:
    """Objects with the groups all of whose tokens they have.  A step joins what an object holds of some group with its
    other tokens and keeps what goes on in a group, so an object meets each common start of groups once."""
    each = wholes.select("chain_id", "group_id", "size", F.explode("tokens").alias("token"))
    held = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ways = each.join(held, "token").groupBy("chain_id", "group_id", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("way"))
    ways = materialise(ways.join(wholes.select("chain_id", "group_id", "size", "parts"), ["chain_id", "group_id", "size"]), "ways")
    known = ways.select(F.explode("way").alias("token")).distinct()
    have = materialise(wide.select("source", "object_path", F.explode("tokens").alias("token")).join(known, "token", "left_semi"), "tokens")
    at = have.select("source", "object_path", F.array("token").alias("held"))
    done = []
    for n in range(1, longest + 1):
        starts = ways.select(F.slice("way", 1, n).alias("held")).where(F.size("held") == n).distinct()
        at = materialise(at.join(starts, "held", "left_semi"), "held")
        done.append(at.join(ways.where(F.size("way") == n).withColumnRenamed("way", "held"), "held").drop("held"))
        at = at.join(have, ["source", "object_path"]).where(~F.array_contains("held", F.col("token"))).select("source", "object_path", F.array_append("held", F.col("token")).alias("held"))
    return reduce(DataFrame.unionByName, done).join(wide.select("source", "object_path", "fields"), ["source", "object_path"])


def guided(values: DataFrame, mappings: DataFrame, index: DataFrame) -> DataFrame:
    """Edges that a caller's mapping ``(source_type, path, target_type, key, name, inverse)`` declares.

    ``values`` is ``(source, source_type, path, value, from_list)``, ``index`` ``(target_type, key, folded, chain_id)``.
    Values meet keys in any case; one target makes an edge, owned by the observing slot also when it is inverse.
    """
    asked = values.join(mappings, ["source_type", "path"]).withColumn("folded", F.lower("value"))
    found = asked.join(index, ["target_type", "key", "folded"])
    one = found.groupBy("source", "source_type", "path", "folded", "name", "inverse", "from_list").agg(F.count_distinct("chain_id").alias("n"), F.min("chain_id").alias("target")).where("n = 1")
    a, b = F.col("source"), F.col("target")
    return one.select(
        F.when(F.col("inverse"), b).otherwise(a).alias("source_chain"), F.when(F.col("inverse"), a).otherwise(b).alias("target_chain"), "name",
        slot(F.col("source_type"), F.col("path")).alias("slot"), F.when(F.col("from_list"), "many").otherwise("one").alias("cardinality"),
    )


def edges(decisions: DataFrame, observed: DataFrame) -> DataFrame:
    """Reference edges of confirmed decisions, with slot, identity and cardinality keys; lists carry no cardinality key.

    Repeats go before the digests are made, so a reader who asks for the ends alone pays for no digest.
    """
    rows = decisions.where("target is not null").join(observed.select("source", "source_type", "location", "token", "from_list").distinct(), ["source", "location", "token"])
    single = F.coalesce(~F.col("from_list"), F.lit(False))
    rows = rows.select("source", "target", slot(F.col("source_type"), F.col("location")).alias("slot"), single.alias("single")).distinct()
    return rows.select(
        F.col("source").alias("source_chain"), F.col("target").alias("target_chain"), F.lit("RELATES_TO").alias("name"), F.lit(0.9).alias("confidence"), "slot",
        F.sha2(F.concat_ws("|", "source", "target", F.lit("RELATES_TO"), "slot"), 256).alias("identity"),
        F.when(F.col("single"), F.sha2(F.concat_ws("|", "source", F.lit("RELATES_TO"), "slot"), 256)).alias("cardinality_key"),
    )


def without_declared(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Edges between pairs that no declared relationship joins in either direction."""
    pair = lambda a, b: [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]
    known = declared.select(*pair("source_chain", "target_chain")).distinct()
    return found.select("*", *pair("source_chain", "target_chain")).join(known, ["lo", "hi"], "left_anti").drop("lo", "hi")


def retire(current: DataFrame, supported: DataFrame, covered: DataFrame, protected: DataFrame) -> DataFrame:
    """Reference edges to close: their slot was covered by an authoritative observation, the edge was not found again,
    and no uncertain entry of the slot (or of its token) protects it.

    ``covered (source_chain, slot)``, ``supported (identity)``, ``protected (source_chain, slot)``.
    """
    return current.join(covered, ["source_chain", "slot"], "left_semi").join(supported.select("identity"), "identity", "left_anti").join(protected, ["source_chain", "slot"], "left_anti")


def unresolved(entries: DataFrame) -> DataFrame:
    """The strongest reason of each ``(source, slot, token)``: not-found, then model-resolvable, then any other."""
    strength = F.when(F.col("reason") == "target-not-found", 1).when(F.col("reason").isin("multiple-candidates", "insufficient-reference-evidence"), 2).otherwise(3)
    return entries.groupBy("source", "slot", "token").agg(F.max_by("reason", F.struct(strength, "reason")).alias("reason"))


def durable_decision(decisions: DataFrame) -> DataFrame:
    """The newest decision of each slot, by time, then id."""
    w = W.partitionBy("slot").orderBy(F.desc("decided_at"), F.desc("decision_id"))
    return decisions.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def wake(pending: DataFrame, dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """Sources whose unresolved or confirmed tokens ``(source, token)`` are among the changed ones."""
    t = changed.select("token").distinct()
    return pending.select("source", "token").union(dependencies.select("source", "token")).join(t, "token", "left_semi").select("source").distinct()
