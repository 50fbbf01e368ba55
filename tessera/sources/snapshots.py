"""Snapshot requests: reading, validation and preparation of entity drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "struct<entity_type:string,name:string,primary_key_properties:array<string>,additional_key_properties:array<array<string>>,raw_properties:string,org_id:string,namespace:string,source:string,lifecycle:string,tags:map<string,string>>"
SCHEMA = f"org_id string, namespace string, source string, name string, data_type string, snapshot_kind string, complete boolean, sync_generation long, collection struct<key:string,relationships_complete:boolean>, captured_at timestamp, content string, entities array<{ENTITY}>"


def read(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Snapshots of JSON (a list) or JSON lines, under a fixed schema; malformed input is an error."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").option("multiLine", not lines).json(path)


def problems(snapshots: DataFrame, org: str) -> DataFrame:
    """Adds ``problems array<struct<field, reason>>``: fields and reasons, never the values."""
    bad = lambda cond, field, reason: F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason")))
    c = F.col
    drafts = F.coalesce(c("entities"), F.array())
    rules = [
        bad(c("org_id").isNull() | (c("org_id") != org), "org_id", "other tenant"),
        bad(c("namespace").isNull() | (F.trim("namespace") == ""), "namespace", "blank"),
        bad(c("source").isNull() | (F.trim("source") == ""), "source", "blank"),
        bad(c("captured_at").isNull(), "captured_at", "missing"),
        bad(~F.coalesce(c("data_type"), F.lit("entities")).isin("entities", "text"), "data_type", "unknown"),
        bad(F.coalesce(c("complete"), F.lit(False)) & (c("collection.key").isNull() | c("sync_generation").isNull()), "collection", "complete scans name a collection and generation"),
        bad(F.exists(drafts, lambda e: e["entity_type"].isNull() | (F.trim(e["entity_type"]) == "")), "entities.entity_type", "blank"),
        bad(F.exists(drafts, lambda e: (e["org_id"] != c("org_id")) | (e["namespace"] != c("namespace"))), "entities.scope", "differs from the snapshot"),
        bad(F.exists(drafts, lambda e: F.size(F.coalesce(e["primary_key_properties"], F.array())) + F.size(F.coalesce(e["additional_key_properties"], F.array())) == 0), "entities.keys", "none declared"),
        bad((c("data_type") == "text") & c("content").isNotNull(), "content", "text is refused"),
    ]
    return snapshots.withColumn("problems", F.array_compact(F.array(*rules)))


def collection_conflicts(snapshots: DataFrame) -> DataFrame:
    """Collections whose pages disagree on generation or completeness."""
    pages = snapshots.where(F.col("collection.key").isNotNull())
    agreed = pages.groupBy("namespace", "source", F.col("collection.key").alias("key")).agg(F.count_distinct("sync_generation").alias("generations"), F.count_distinct("complete").alias("coverages"))
    return agreed.where("generations > 1 or coverages > 1")


def usable_keys(drafts: DataFrame, properties: str = "properties") -> DataFrame:
    """Adds ``keys`` (primary key or, without one, the first additional group) and ``key_problem``.

    Every key property must be present and not blank; ``name`` may stand for the entity's name.
    """
    keys = F.when(F.size("primary_key") > 0, F.col("primary_key")).otherwise(F.try_element_at("additional_keys", F.lit(1)))
    value = lambda k: F.when(k == "name", F.col("name")).otherwise(F.try_element_at(F.col(properties), k))
    missing = F.exists("keys", lambda k: value(k).isNull() | (F.trim(value(k)) == ""))
    return drafts.withColumn("keys", keys).withColumn("key_problem", F.when(F.col("keys").isNull(), "no key").when(missing, "key property missing"))


def route(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts that live (archived ones too) and drafts that delete."""
    gone = F.lower(F.coalesce("lifecycle", F.lit("active"))).isin("deleted", "deleting")
    return drafts.where(~gone), drafts.where(gone)


def normalise(properties: Column, drop: list[str], as_json: list[str]) -> Column:
    """Properties without dropped paths; values of ``as_json`` paths become JSON text."""
    kept = F.map_filter(properties, lambda k, v: ~k.isin(*drop)) if drop else properties
    quoted = lambda v: F.when(v.rlike(r'^[\[{"]|^(true|false|null)$|^-?[0-9]'), v).otherwise(F.concat(F.lit('"'), v, F.lit('"')))
    return F.transform_values(kept, lambda k, v: F.when(k.isin(*as_json), quoted(v)).otherwise(v)) if as_json else kept


def children(parents: DataFrame, parent: str, json: str, key: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Child entities of a JSON array property and the edges to them.

    Children are ``(chain_id, entity_type, position, properties)``, named by the parent and their ``key``; edges are
    ``(source_chain, target_chain, name, owned)``.  Elements without the key make no child.
    """
    each = parents.select(parent, F.posexplode(F.from_json(F.col(json), "array<string>")).alias("position", "item"))
    keyed = each.withColumn("k", F.get_json_object("item", f"$.{key}")).where("k is not null and trim(k) <> ''")
    own = F.concat_ws("/", F.col(parent), F.lit(kind), F.col("k"))
    rows = keyed.select(own.alias("chain_id"), F.lit(kind).alias("entity_type"), "position", F.from_json("item", "map<string,string>").alias("properties"))
    return rows, keyed.select(F.col(parent).alias("source_chain"), own.alias("target_chain"), F.lit("HAS").alias("name"), F.lit(True).alias("owned")).distinct()


def schema_problems(properties: Column, schema: dict) -> Column:
    """Violations of a JSON-Schema subset (required, type, enum, minLength, maxLength, minimum, maximum), as strings."""
    out = [F.when(~F.map_contains_key(properties, F.lit(k)), F.lit(f"{k}: required")) for k in schema.get("required", [])]
    for name, rule in schema.get("properties", {}).items():
        v = F.try_element_at(properties, F.lit(name))
        number = v.try_cast("double")
        kinds = {"integer": v.rlike(r"^-?[0-9]+$"), "number": number.isNotNull(), "boolean": v.isin("true", "false"), "string": F.lit(True)}
        checks = {"type": ~kinds.get(rule.get("type", "string"), F.lit(True))}
        if "enum" in rule:
            checks["enum"] = ~v.isin(*rule["enum"])
        if "minLength" in rule:
            checks["minLength"] = F.length(v) < rule["minLength"]
        if "maxLength" in rule:
            checks["maxLength"] = F.length(v) > rule["maxLength"]
        if "minimum" in rule:
            checks["minimum"] = number < rule["minimum"]
        if "maximum" in rule:
            checks["maximum"] = number > rule["maximum"]
        out += [F.when(v.isNotNull() & F.coalesce(c, F.lit(False)), F.lit(f"{name}: {k}")) for k, c in checks.items()]
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")
