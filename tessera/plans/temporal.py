"""Queries over values, versions and time."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import values, visibility
from tessera.operators import versions
from tessera.plans.registry import query
from tessera.plans.star import SQL_EVENT_VERSIONS, event_lifecycle, event_versions
from tessera.storage import table

_T = "2024-01-15 12:00:00"
_AT = f"timestamp '{_T}'"


def _at(text: str = _T):
    return F.lit(text).cast("timestamp_ntz")


@query("select event_id, 'k' as path, 'i' as tag, json_extract_string(props, '$.k') as value from events")
def flatten_props(spark, sf):
    flat = table(spark, sf, "events").select("event_id", F.explode(values.flatten_json(F.col("props"))).alias("e"))
    v = values.decode_json(F.col("e.value"))
    return flat.select("event_id", F.col("e.key").alias("path"), v["t"].alias("tag"), v["v"].alias("value"))


@query("""select c_custkey, 'i' as key_tag, cast(c_custkey as varchar) as key_text, 'f' as balance_tag, 's' as segment_tag, c_mktsegment as segment_text,
  case when c_custkey % 3 = 0 then 'n' else 'b' end as flag_tag from customer""")
def json_scalar_decode(spark, sf):
    doc = F.struct(F.col("c_custkey").alias("k"), (F.col("c_acctbal") + 0.001).alias("b"), F.col("c_mktsegment").alias("s"))
    parts = F.from_json(F.to_json(doc), "map<string,string>")
    rows = table(spark, sf, "customer").withColumn("m", parts)
    flag = values.decode_json(F.when(F.col("c_custkey") % 3 == 0, F.lit("null")).otherwise(F.lit("true")))
    k, b, s = values.decode_json(F.col("m")["k"]), values.decode_json(F.col("m")["b"]), values.decode_json(F.to_json(F.struct(F.col("m")["s"].alias("x"))).substr(F.lit(6), F.length(F.col("m")["s"]) + 2))
    return rows.select("c_custkey", k["t"].alias("key_tag"), k["v"].alias("key_text"), b["t"].alias("balance_tag"), s["t"].alias("segment_tag"), s["v"].alias("segment_text"), flag["t"].alias("flag_tag"))


@query("select c_custkey, 's:' || c_mktsegment as segment_token, 'i:' || c_nationkey as nation_token, case when c_custkey % 7 = 0 then null else 's:' || c_name end as name_token from customer")
def typed_tokens(spark, sf):
    rows = table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 7 == 0, F.lit("  ")).otherwise(F.col("c_name"))
    return rows.select("c_custkey", values.token(values.typed("s", F.col("c_mktsegment"))).alias("segment_token"), values.token(values.typed("i", F.col("c_nationkey"))).alias("nation_token"), values.token(values.typed("s", name)).alias("name_token"))


_FRAME = "strlen({0}) || ':' || {0}"


@query(f"select c_custkey, sha256({' || '.join(_FRAME.format(x) for x in ('cast(c_nationkey as varchar)', chr(39) + 'customer' + chr(39), 'c_name', 'c_mktsegment'))}) as digest from customer")
def identity_digest(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", values.digest(F.col("c_nationkey").cast("string"), F.lit("customer"), F.col("c_name"), F.col("c_mktsegment")).alias("digest"))


@query(f"select p_partkey, sha256({' || '.join(_FRAME.format(x) for x in (chr(39) + 'size' + chr(39), chr(39) + 'i' + chr(39), 'cast(p_size as varchar)', chr(39) + 'brand' + chr(39), chr(39) + 's' + chr(39), 'p_brand'))}) as digest from part")
def structural_digest(spark, sf):
    props = F.create_map(F.lit("size"), values.typed("i", F.col("p_size")), F.lit("brand"), values.typed("s", F.col("p_brand")), F.lit("price"), values.typed("f", F.col("p_retailprice")))
    return table(spark, sf, "part").select("p_partkey", values.structural_digest(props, F.array(F.lit("price"))).alias("digest"))


@query("""select p_partkey, 'i:' || p_partkey || case when p_size > 25 then ' s:' || p_brand else '' end as tokens from part where p_partkey % 2 = 0
  union all select p_partkey, 'i:' || p_partkey from part where p_partkey % 2 = 1""")
def key_tokens(spark, sf):
    rows = table(spark, sf, "part")
    brand = F.when((F.col("p_partkey") % 2 == 0) & (F.col("p_size") > 25), F.col("p_brand"))
    props = F.create_map(F.lit("id"), values.typed("i", F.col("p_partkey")), F.lit("brand"), values.typed("s", brand))
    groups = F.array(F.array(F.lit("id")), F.array(F.lit("brand"), F.lit("id")))
    return rows.select("p_partkey", F.array_join(values.key_tokens(props, groups), " ").alias("tokens"))


@query("""with s as (select event_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) as k,
  lag(event_type) over w as pt, lag(value) over w as pv, lag(cast(json_extract_string(props, '$.k') as bigint)) over w as pk, row_number() over w as n
  from events window w as (partition by user_id order by ts, event_id))
  select event_id, concat_ws(',', case when pk <> k then 'k' end, case when pt <> event_type then 'type' end, case when pv <> value then 'value' end) as changed from s where n > 1""")
def diff_properties(spark, sf):
    props = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type"), F.lit("value"), F.col("value").cast("string"))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").withColumn("p", props).withColumn("q", F.lag("p").over(w)).where("q is not null")
    return rows.select("event_id", F.array_join(F.array_sort(F.map_keys(values.diff(F.col("p"), F.col("q")))), ",").alias("changed"))


@query("""select c_custkey, array_to_string(list_sort(['address.city', 'phone'] || case when c_custkey % 2 = 0 then ['name'] else ['name.first', 'name.last'] end
  || case when c_custkey % 3 = 0 then ['tags'] else ['tags.a'] end), ' ') as paths from customer""")
def merge_partial(spark, sf):
    """Stored name and tags maps overlaid: a whole value replaces its parts, a part replaces the whole."""
    lit = lambda *p: F.create_map(*(F.lit(x) for k in p for x in (k, "1")))
    name = F.when(F.col("c_custkey") % 2 == 0, lit("name")).otherwise(lit("name.first", "name.last"))
    tags = F.when(F.col("c_custkey") % 3 == 0, lit("tags")).otherwise(lit("tags.a"))
    stored = F.map_concat(lit("address.city", "phone"), F.when(F.col("c_custkey") % 2 == 0, lit("name.first", "name.last")).otherwise(lit("name")), F.when(F.col("c_custkey") % 3 == 0, lit("tags.a", "tags.b")).otherwise(lit("tags")))
    merged = values.merge_partial(stored, F.map_concat(name, tags))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(F.array_sort(F.map_keys(merged)), " ").alias("paths"))


@query("""select l_orderkey, l_linenumber, count(*) as n, max(l_returnflag) as flag, array_to_string(list_sort(list_distinct(list(l_linestatus))), ' ') as labels from lineitem group by all""")
def metadata_overlay(spark, sf):
    """Observations of a line: full tags of the last flag, labels united over all."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.max("l_returnflag").alias("last"), F.sort_array(F.collect_set("l_linestatus")).alias("own"))
    tags = values.overlay_tags(F.create_map(F.lit("flag"), F.lit("?")), F.create_map(F.lit("flag"), F.col("last")), F.lit(False))
    return rows.select("l_orderkey", "l_linenumber", "n", tags["flag"].alias("flag"), F.array_join(values.labels(F.slice("own", 1, 1), F.col("own")), " ").alias("labels"))


@query("select p_partkey, case when p_size % 2 = 0 then 'i' else 's' end as tag, case when p_size % 2 = 0 then '' else '0' end || p_size as value from part")
def port_normalisation(spark, sf):
    text = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.lit("0"), F.col("p_size").cast("string")))
    v = values.port_to_integer(values.typed("s", text))
    return table(spark, sf, "part").select("p_partkey", v["t"].alias("tag"), v["v"].alias("value"))


@query(f"select user_id, version, event_type, valid_from, last_seen_at, n_observations, valid_to, valid_to is null as is_latest from ({SQL_EVENT_VERSIONS})")
def entity_versions(spark, sf):
    return event_versions(spark, sf)


@query("""with s as (select event_id, event_type, value, lag(event_type) over w as pt, lag(value) over w as pv, row_number() over w as n from events window w as (partition by user_id order by ts, event_id))
  select event_id, case when n = 1 then 'created' when pt <> event_type then 'version' when pv <> value then 'in_place' else 'unchanged' end as kind from s""")
def merge_in_place_updates(spark, sf):
    return versions.in_place(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_type"], ["value"]).select("event_id", "kind")


@query(f"select user_id, version, valid_from from ({SQL_EVENT_VERSIONS}) where valid_from >= timestamp '2024-01-10' and valid_from < timestamp '2024-01-12'")
def version_history_range(spark, sf):
    v = event_versions(spark, sf)
    return v.where((F.col("valid_from") >= _at("2024-01-10 00:00:00")) & (F.col("valid_from") < _at("2024-01-12 00:00:00"))).select("user_id", "version", "valid_from")


@query(f"select user_id, max(version) as n_versions, max(valid_from) as head_since from ({SQL_EVENT_VERSIONS}) group by user_id")
def version_headers(spark, sf):
    return event_versions(spark, sf).groupBy("user_id").agg(F.max("version").alias("n_versions"), F.max("valid_from").alias("head_since"))


@query("""select event_id, coalesce(ts < max(ts) over (partition by user_id order by hash_key, event_id rows between unbounded preceding and 1 preceding), false) as is_stale
  from (select *, event_id % 97 as hash_key from events)""")
def stale_observations(spark, sf):
    """Arrival order differs from capture order: an observation older than one that came before is stale."""
    rows = table(spark, sf, "events").withColumn("arrival", F.col("event_id") % 97)
    return versions.stale_observations(rows, "user_id", ["arrival", "event_id"], "ts").select("event_id", "is_stale")


_LIFE = """with s as (select *, event_type = 'error' as del from events),
  w as (select event_id, user_id, ts, del, lag(del) over o as prior, max(case when not del then 1 else 0 end) over p as alive, max(case when del then ts end) over p as death
        from s window o as (partition by user_id order by ts, event_id), p as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding)),
  life as (select event_id, user_id, ts, case when del and coalesce(alive, 0) = 0 then 'ignored' when del and prior then 'still_deleted' when del then 'deleted'
    when coalesce(alive, 0) = 0 then 'created' when prior and ts > death then 'recreated' when prior then 'stale' else 'observed' end as lifecycle from w)"""


@query(_LIFE + " select event_id, lifecycle from life")
def tombstone_and_recreate(spark, sf):
    return event_lifecycle(spark, sf).select("event_id", "lifecycle")


@query("select user_id, n_values from (select user_id, ts, count(distinct event_type) as n_values from (select user_id, date_trunc('day', ts) as ts, event_type from events) group by all) where n_values > 4")
def observation_conflicts(spark, sf):
    """Users and days on which observations disagree in all ways but one at most."""
    rows = table(spark, sf, "events").withColumn("day", F.date_trunc("day", "ts"))
    return versions.conflicts(rows, ["user_id", "day"], "event_type").where("n_values > 4").select("user_id", "n_values")


@query(f"select user_id, version, event_type from ({SQL_EVENT_VERSIONS}) where valid_to is null")
def current_entities(spark, sf):
    v = event_versions(spark, sf).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    return v.where(visibility.current_entity()).select("user_id", "version", "event_type")


@query(f"select user_id, version, event_type from ({SQL_EVENT_VERSIONS}) where valid_from <= {_AT} and (valid_to is null or {_AT} < valid_to)")
def as_of_entities(spark, sf):
    v = event_versions(spark, sf).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    return v.where(visibility.entity_at(_at())).select("user_id", "version", "event_type")


_ORDER_EDGES = "select o_orderkey, o_custkey, o_orderdate as valid_from, case when o_orderkey % 3 = 0 then o_orderdate + interval 90 day end as valid_to, case when o_orderkey % 10 = 0 then o_orderdate + interval 5 day end as cancelled_at from orders"
_THEN = "timestamp '1998-06-01'"


def _order_edges(spark, sf):
    d = F.col("o_orderdate")
    nothing = F.lit(None).cast("timestamp_ntz")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", d.alias("valid_from"), F.when(F.col("o_orderkey") % 3 == 0, d + F.expr("interval 90 day")).alias("valid_to"), F.when(F.col("o_orderkey") % 10 == 0, d + F.expr("interval 5 day")).alias("cancelled_at"), nothing.alias("deleted_at"), nothing.alias("invalid_at"))


@query(f"select o_orderkey, o_custkey from ({_ORDER_EDGES}) where valid_from <= {_THEN} and (valid_to is null or {_THEN} < valid_to) and cancelled_at is null")
def as_of_edges(spark, sf):
    return _order_edges(spark, sf).where(visibility.edge_at(_at("1998-06-01 00:00:00"))).select("o_orderkey", "o_custkey")


@query(f"select user_id, version from ({SQL_EVENT_VERSIONS}) v where valid_from <= {_AT} and (valid_to is null or {_AT} < valid_to) and not (user_id % 5 = 0 and user_id <> 0 and timestamp '2024-01-10' <= {_AT} and {_AT} < timestamp '2024-01-20')")
def merge_period_suppression(spark, sf):
    """Chains divisible by 5 lost a merge with chain 0 between the 10th and the 20th."""
    v = event_versions(spark, sf).withColumnRenamed("user_id", "chain_id").withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    lost = table(spark, sf, "events").select(F.col("user_id").alias("loser")).distinct().where("loser % 5 = 0 and loser <> 0")
    merges = lost.select("loser", _at("2024-01-10 00:00:00").alias("valid_from"), _at("2024-01-20 00:00:00").alias("valid_to"))
    return visibility.without_merged(v.where(visibility.entity_at(_at())), merges, _at()).select(F.col("chain_id").alias("user_id"), "version")


_EARLY = "timestamp '2024-01-02'"


@query(f"""select user_id, version, valid_from <= {_EARLY} as hydrates from ({SQL_EVENT_VERSIONS})
  where (valid_from <= {_EARLY} and (valid_to is null or {_EARLY} < valid_to)) or (version = 1 and valid_from > {_EARLY})""")
def prehistory_endpoint(spark, sf):
    v = event_versions(spark, sf).select(F.col("user_id").alias("chain_id"), F.col("version").alias("uuid"), "valid_from", "valid_to").withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    return visibility.endpoint_versions(v, _at("2024-01-02 00:00:00")).select(F.col("chain_id").alias("user_id"), F.col("uuid").alias("version"), "hydrates")


@query(f"""select user_id, version, 'entity_version' as event, valid_from as "at", case when version > 1 then 'event_type' else '' end as changed from ({SQL_EVENT_VERSIONS})
  where valid_from > timestamp '2024-01-10' and valid_from <= timestamp '2024-01-20'""")
def change_feed(spark, sf):
    v = event_versions(spark, sf).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    return versions.change_feed(v, "user_id", ["event_type"], _at("2024-01-10 00:00:00"), _at("2024-01-20 00:00:00"))


@query(f"""with e as ({_ORDER_EDGES}) select chain_id, event, "at" from (
  select o_orderkey as chain_id, 'relationship_opened' as event, valid_from as "at" from e union all select o_orderkey, 'relationship_closed', valid_to from e
  union all select o_orderkey, 'relationship_cancelled', cancelled_at from e) where "at" > timestamp '1998-01-01' and "at" <= timestamp '1998-03-01'""")
def relationship_feed(spark, sf):
    e = _order_edges(spark, sf).withColumnRenamed("o_orderkey", "chain_id").withColumn("version", F.lit(1))
    return versions.edge_feed(e, _at("1998-01-01 00:00:00"), _at("1998-03-01 00:00:00")).select("chain_id", "event", "at")


@query(f"""with v as ({SQL_EVENT_VERSIONS}), t as (select distinct user_id, timestamp '2024-01-03' as t from events)
  select user_id, arg_max(version, case when valid_from <= t and (valid_to is null or t < valid_to) then 2000000 + version when valid_from <= t then 1000000 + version else -version end) as version from v join t using (user_id) group by user_id""")
def identity_candidate_at(spark, sf):
    v = event_versions(spark, sf).withColumnRenamed("user_id", "chain_id")
    asked = table(spark, sf, "events").select(F.col("user_id").alias("chain_id")).distinct().withColumn("t", _at("2024-01-03 00:00:00"))
    return versions.at_or_near(v, asked).select(F.col("chain_id").alias("user_id"), "version")


@query("""with pairs as (select a.n_name as source_ns, b.n_name as target_ns from nation a join nation b on a.n_nationkey = b.n_nationkey or b.n_regionkey = 0 or (a.n_regionkey = 1 and b.n_regionkey = 2)) select distinct * from pairs""")
def namespace_policy_pairs(spark, sf):
    """Nations are namespaces, regions their tiers; region 0 is shared, tier 1 may link into tier 2."""
    spaces = table(spark, sf, "nation").select(F.col("n_name").alias("namespace"), F.col("n_regionkey").cast("string").alias("tier"))
    grants = table(spark, sf, "region").where("r_regionkey = 1").select(F.col("r_regionkey").cast("string").alias("from_tier"), F.lit("2").alias("to_tier"))
    return visibility.namespace_pairs(spaces, grants, shared="0")


@query()
def partial_version_fold(spark, sf):
    """The full fold over partial observations: every third event gives only its type, errors delete."""
    e = table(spark, sf, "events")
    props = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("type"), F.col("event_type"))).otherwise(F.create_map(F.lit("type"), F.col("event_type"), F.lit("value"), F.floor("value").cast("string")))
    rows = e.select(F.col("user_id").alias("chain_id"), F.col("ts").alias("captured_at"), F.col("event_id").alias("idx"), (F.col("event_id") % 3 != 0).alias("full"), (F.col("event_type") == "error").alias("deleted"), props.alias("props"), F.array(F.lit("value")).alias("loose"))
    out = versions.fold(rows, "chain_id long, version int, valid_from timestamp_ntz, valid_to timestamp_ntz, deleted_at timestamp_ntz, props map<string,string>, outcome string")
    return out.withColumn("props", F.to_json("props"))
