"""Queries over identity, references, relationships and their lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import names, visibility
from tessera.operators import edges, identity, lifecycle, paging, references
from tessera.plans.registry import query
from tessera.plans.star import SQL_EDGES, SQL_ENTITIES, chain, direct_edges, entities, key_index, reference_values
from tessera.storage import table


def _index(spark, sf):
    """Stored versions by key hash: every customer by key; those divisible by 4 are tombstones, by 5 have an older version."""
    c = table(spark, sf, "customer")
    dead = F.when(F.col("c_custkey") % 4 == 0, F.lit("2020-01-01").cast("timestamp_ntz"))
    row = lambda h, v, d: c.select(h.alias("hash"), F.col("c_custkey").alias("chain_id"), F.concat(F.lit("v"), F.lit(v).cast("string"), F.lit("-"), F.col("c_custkey").cast("string")).alias("uuid"), F.lit(v).alias("version"), d.alias("deleted_at"))
    key = F.col("c_custkey").cast("string")
    old = row(key, 1, F.lit("2019-01-01").cast("timestamp_ntz")).where("chain_id % 5 = 0")
    return row(key, 2, dead).union(old)


_INDEX = """(select cast(c_custkey as varchar) as hash, c_custkey as chain_id, 'v2-' || c_custkey as uuid, 2 as version, c_custkey % 4 = 0 as dead from customer
  union all select cast(c_custkey as varchar), c_custkey, 'v1-' || c_custkey, 1, true from customer where c_custkey % 5 = 0)"""


@query(f"""select o_orderkey as obs, uuid, row_number() over (partition by o_orderkey order by dead, version desc, uuid) as preference
  from orders join {_INDEX} i on cast(o_custkey as varchar) = hash""")
def identity_lookup_live_then_deleted(spark, sf):
    observed = table(spark, sf, "orders").select(F.col("o_orderkey").alias("obs"), F.col("o_custkey").cast("string").alias("hash"))
    return identity.lookup(observed, _index(spark, sf)).select("obs", "uuid", "preference")


@query(f"select chain_id, arg_max(uuid, case when dead then 0 else 100 end + version) as uuid from {_INDEX} group by chain_id")
def prefer_live_version(spark, sf):
    return identity.preferred(_index(spark, sf)).select("chain_id", "uuid")


@query("""with k as (select o_orderkey as obs, 'c' || o_custkey as hash from orders union all select o_orderkey, 'd' || o_orderkey // 4 from orders),
  c as (select o_custkey, min(o_orderkey // 4) as g from orders group by 1) select count(*) as n from k""")
def key_rows(spark, sf):
    o = table(spark, sf, "orders")
    keys = o.select(F.col("o_orderkey").alias("obs"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("hash")).union(o.select("o_orderkey", F.concat(F.lit("d"), F.floor(F.col("o_orderkey") / 4).cast("string"))))
    return keys.agg(F.count(F.lit(1)).alias("n"))


@query("""with recursive k as (select c_custkey as obs, 'n' || c_nationkey || c_mktsegment as hash from customer union all select c_custkey, 'b' || c_custkey // 2 from customer),
  f as (select hash, min(obs) as first from k group by hash), l as (select distinct k.obs as a, f.first as b from k join f using (hash)), s as (select a, b from l union select b, a from l),
  r as (select a as node, a as seen from s union select r.node, s.b from r join s on r.seen = s.a) select node as obs, min(seen) as component from r group by node""")
def key_components(spark, sf):
    """Customers joined by segment and nation, and in pairs by key."""
    c = table(spark, sf, "customer")
    keys = c.select(F.col("c_custkey").alias("obs"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("hash")).union(c.select("c_custkey", F.concat(F.lit("b"), F.floor(F.col("c_custkey") / 2).cast("string"))))
    none = spark.createDataFrame([], "hash string, chain_id long")
    return identity.resolve(keys, none).select("obs", "component")


@query("""select o_orderkey as obs, min(c_custkey) over (partition by o_custkey // 7) as chain_id, count(*) filter (c_custkey is not null) over (partition by o_custkey // 7) > 0
  and min(c_custkey) over (partition by o_custkey // 7) <> max(c_custkey) over (partition by o_custkey // 7) as conflict
  from orders left join (select c_custkey from customer where c_custkey % 5 = 0) on c_custkey = o_custkey""")
def component_conflicts(spark, sf):
    """Orders share the key customer // 7; every fifth customer is a stored chain; two in one component conflict."""
    o = table(spark, sf, "orders")
    own = o.select(F.col("o_orderkey").alias("obs"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("hash"))
    shared = o.select(F.col("o_orderkey").alias("obs"), F.concat(F.lit("g"), F.floor(F.col("o_custkey") / 7).cast("string")).alias("hash"))
    stored = table(spark, sf, "customer").where("c_custkey % 5 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("hash"), F.col("c_custkey").alias("chain_id"))
    return identity.resolve(own.union(shared), stored).select("obs", "chain_id", "conflict")


@query("""with recursive m as (select distinct o_custkey // 7 as component, o_custkey // 5 as snapshot from orders), s as (select a.snapshot as a, b.snapshot as b from m a join m b using (component)),
  r as (select snapshot as node from m where component % 30 = 0 union select s.b from r join s on r.node = s.a) select node as snapshot from r""")
def rejected_snapshots(spark, sf):
    """Rejection spreads over snapshots (fives of customers) that share a component (sevens of them) with a conflicting one."""
    m = table(spark, sf, "orders").select(F.floor(F.col("o_custkey") / 7).alias("component"), F.floor(F.col("o_custkey") / 5).alias("snapshot")).distinct()
    return identity.reject(m.where("component % 30 = 0").select("component"), m)


@query("select o_orderkey as request, case when o_orderdate >= timestamp '1996-01-01' and o_custkey % 4 <> 0 then o_custkey end as chain_id from orders where o_custkey % 4 <> 0")
def declared_endpoints(spark, sf):
    live = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("hash"), F.col("c_custkey").alias("chain_id"), F.lit("1996-01-01").cast("timestamp_ntz").alias("last_transition_at"))
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("hash"), F.col("o_orderdate").alias("captured_at"))
    return identity.endpoints(asked, live)


@query("select chain_id from (select 'nation:' || n_nationkey as chain_id, n_name, n_nationkey from nation) where lower(n_name) in (select lower(n_name) from nation where n_nationkey % 3 = 0) or cast(n_nationkey as varchar) in ('4', '5')")
def lookup_by_name(spark, sf):
    n = table(spark, sf, "nation")
    rows = n.select(chain("nation", "n_nationkey").alias("chain_id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("key_value"))
    asked = n.where("n_nationkey % 3 = 0").select(F.upper("n_name").alias("name")).union(n.where("n_nationkey in (4, 5)").select(F.col("n_nationkey").cast("string")))
    return identity.by_name(rows, asked).select("chain_id")


@query("""with a as (select o_orderkey as id, unnest(['c' || o_custkey, 'k' || o_orderkey, 'n' || c_name]) as kv from orders join customer on c_custkey = o_custkey),
  b as (select c_custkey as right_id, unnest(['c' || c_custkey, 'k' || c_custkey, 'n' || c_name]) as kv from customer)
  select id as left_id, right_id, count(*) / 3 as overlap from a join b using (kv) group by id, right_id""")
def property_overlap(spark, sf):
    """Orders carry their customer's key and name, and a number of their own that may be another customer's."""
    three = lambda c, k, n: F.explode(F.array(*(F.struct(F.lit(x).alias("key"), v.cast("string").alias("value")) for x, v in (("c", c), ("k", k), ("n", n)))))
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"))
    a = o.select(F.col("o_orderkey").alias("id"), three(F.col("o_custkey"), F.col("o_orderkey"), F.col("c_name")).alias("e")).select("id", "e.*")
    b = c.select(F.col("c_custkey").alias("id"), three(F.col("c_custkey"), F.col("c_custkey"), F.col("c_name")).alias("e")).select("id", "e.*")
    return identity.property_overlap(a, b)


def _raw(spark, sf):
    """Reference fields of orders and customers as plain integers, which several types carry."""
    return reference_values(spark, sf).withColumn("token", F.split("token", ":")[1])


def _raw_index(spark, sf):
    return key_index(spark, sf).withColumn("token", F.split("token", ":")[1])


@query(f"select source_chain as source, location, target_chain as token from ({SQL_EDGES})")
def reference_scan(spark, sf):
    return references.scan(reference_values(spark, sf)).select("source", "location", "token")


@query(f"""with o as (select source_chain as source, split_part(target_chain, ':', 2) as token from ({SQL_EDGES}) where source_type = 'customer'),
  k as (select chain_id, split_part(chain_id, ':', 2) as token, row_number() over (partition by split_part(chain_id, ':', 2) order by chain_id) as r, count(*) over (partition by split_part(chain_id, ':', 2)) as n from ({SQL_ENTITIES}))
  select source, token, chain_id, n > 4 as capped from o join k using (token) where r <= 4""")
def reference_candidates_capped(spark, sf):
    """Plain integers have up to six carriers; four are returned and the fifth proves the cut."""
    return references.carriers(_raw(spark, sf).where("source_type = 'customer'"), _raw_index(spark, sf), most=4).select("source", "token", "chain_id", "capped")


@query(f"""with o as (select source_chain as source, location, split_part(target_chain, ':', 2) as token from ({SQL_EDGES})),
  k as (select split_part(chain_id, ':', 2) as token, count(*) as n from ({SQL_ENTITIES}) group by 1), self as (select source, split_part(source, ':', 2) as token from o group by all)
  select o.source, location, o.token, case when n - (s.source is not null)::int = 0 then 'target-not-found' when n - (s.source is not null)::int > 1 then 'multiple-candidates' end as reason
  from o join k on k.token = o.token left join self s on s.source = o.source and s.token = o.token where location <> 'o_custkey'""")
def ambiguous_references(spark, sf):
    """Plain integer keys: one value names several entities, so the references stay unresolved."""
    observed = _raw(spark, sf).where("location <> 'o_custkey'")
    found = references.structural(references.carriers(observed, _raw_index(spark, sf))).withColumn("match_class", F.lit(2))
    return references.decide(found, observed).select("source", "location", "token", "reason").withColumn("reason", F.when(F.col("reason") == "insufficient-reference-evidence", None).otherwise(F.col("reason")))


_DANGLING = f"""select source_chain as source, location, case when source_type = 'orders' and cast(split_part(source_chain, ':', 2) as bigint) % 50 = 0 then 'customer:' || (1000000000 + cast(split_part(target_chain, ':', 2) as bigint)) else target_chain end as token, target_chain from ({SQL_EDGES})"""


def _dangling(spark, sf):
    lost = (F.col("source_type") == "orders") & (F.split("source", ":")[1].cast("long") % 50 == 0)
    far = F.concat(F.lit("customer:"), (F.split("token", ":")[1].cast("long") + 1000000000).cast("string"))
    return reference_values(spark, sf).withColumn("token", F.when(lost, far).otherwise(F.col("token")))


@query(f"select source, location, token, case when token <> target_chain then 'target-not-found' end as reason, case when token = target_chain then target_chain end as target from ({_DANGLING})")
def reference_decisions(spark, sf):
    observed = _dangling(spark, sf)
    found = references.structural(references.carriers(observed, key_index(spark, sf))).withColumn("match_class", F.lit(2))
    return references.decide(found, observed)


@query(f"""select source_chain, target_chain, 'RELATES_TO' as name, 0.9 as confidence, source_type || '.' || location as slot,
  sha256(source_chain || '|' || target_chain || '|RELATES_TO|' || source_type || '.' || location) as identity, sha256(source_chain || '|RELATES_TO|' || source_type || '.' || location) as cardinality_key from ({SQL_EDGES})""")
def reference_edges(spark, sf):
    observed = reference_values(spark, sf)
    found = references.structural(references.carriers(observed, key_index(spark, sf))).withColumn("match_class", F.lit(2))
    return references.edges(references.decide(found, observed), observed)


@query("""select l.l_orderkey * 10 + l.l_linenumber as source, 'ps:' || s.l_partkey || ':' || s.l_suppkey as chain_id from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem) l
  join (select distinct l_partkey, l_suppkey from lineitem where l_returnflag = 'R') s on s.l_partkey = l.l_partkey and s.l_suppkey = l.l_suppkey group by all""")
def composite_key_edges(spark, sf):
    """Two-part keys (part, supplier) of returned lines: both components must be found among the fields of one line."""
    lines = table(spark, sf, "lineitem")
    part, supp = F.concat(F.lit("part:"), F.col("l_partkey").cast("string")), F.concat(F.lit("supp:"), F.col("l_suppkey").cast("string"))
    pair = lambda name: F.array(*(F.struct(F.lit(n).alias(name), token.alias("token")) for n, token in (("partkey", part), ("suppkey", supp))))
    line = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    seen = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source"), line.alias("object_path"), pair("field").alias("fields"))
    target = F.concat(F.lit("ps:"), F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_suppkey").cast("string"))
    returned = lines.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()
    wholes = returned.select(target.alias("chain_id"), F.lit(1).alias("group_id"), F.lit(2).alias("size"), pair("property").alias("parts"))
    return references.complete(seen, wholes).select("source", "chain_id").distinct()


@query("""select 'nation:' || c_nationkey as source_chain, 'customer:' || c_custkey as target_chain, 'HAS_CUSTOMER' as name, 'customer.c_nationkey' as slot, 'one' as cardinality from customer
  union all select 'orders:' || o_orderkey, 'customer:' || o_custkey, 'PLACED_BY', 'orders.o_custkey', 'one' from orders""")
def guided_edges(spark, sf):
    """A caller's mappings over plain integer keys; the first is inverse and stays owned by the observing slot."""
    mappings = spark.createDataFrame([("customer", "c_nationkey", "nation", "n_nationkey", "HAS_CUSTOMER", True), ("orders", "o_custkey", "customer", "c_custkey", "PLACED_BY", False)], "source_type string, path string, target_type string, key string, name string, inverse boolean")
    seen = _raw(spark, sf).select("source", "source_type", F.col("location").alias("path"), F.col("token").alias("value"), "from_list")
    index = _raw_index(spark, sf).where("target_type in ('nation', 'customer')").select("target_type", F.when(F.col("target_type") == "nation", "n_nationkey").otherwise("c_custkey").alias("key"), F.lower("token").alias("folded"), "chain_id")
    return references.guided(seen, F.broadcast(mappings), index)


@query(f"select source_chain, target_chain from ({SQL_EDGES}) where not (source_type = 'customer' and cast(split_part(source_chain, ':', 2) as bigint) % 2 = 0)")
def declared_suppression(spark, sf):
    found = direct_edges(spark, sf)
    declared = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(chain("nation", "c_nationkey").alias("source_chain"), chain("customer", "c_custkey").alias("target_chain"))
    return references.without_declared(found, declared).select("source_chain", "target_chain")


@query(f"select source_chain, target_chain from ({SQL_EDGES}) where source_type = 'orders' and cast(split_part(source_chain, ':', 2) as bigint) % 4 = 0 and cast(split_part(source_chain, ':', 2) as bigint) % 50 = 0 and cast(split_part(source_chain, ':', 2) as bigint) % 3 <> 0")
def reference_retirement(spark, sf):
    """Orders divisible by 4 were observed again; every 50th points elsewhere now; thirds are protected."""
    number = F.split("source_chain", ":")[1].cast("long")
    now = direct_edges(spark, sf, ("orders",)).withColumn("slot", F.lit("orders.o_custkey")).withColumn("identity", F.concat_ws(">", "source_chain", "target_chain"))
    covered = now.where(number % 4 == 0).select("source_chain", "slot")
    return references.retire(now, now.where(number % 50 != 0), covered, now.where(number % 3 == 0).select("source_chain", "slot")).select("source_chain", "target_chain")


@query("""select user_id as source, event_type as slot, arg_max(r, s) as reason from (select user_id, event_type, event_id % 3 as m, case event_id % 3 when 0 then 'target-not-found' when 1 then 'multiple-candidates' else 'partial-key' end as r,
  event_id % 3 as s from events) group by all""")
def unresolved_slots(spark, sf):
    e = table(spark, sf, "events")
    reason = F.when(F.col("event_id") % 3 == 0, "target-not-found").when(F.col("event_id") % 3 == 1, "multiple-candidates").otherwise("partial-key")
    rows = e.select(F.col("user_id").alias("source"), F.col("event_type").alias("slot"), F.lit("t").alias("token"), reason.alias("reason"))
    return references.unresolved(rows).select("source", "slot", "reason")


@query("select user_id as slot, max_by(event_type, ts) as decision from events group by user_id")
def durable_decisions(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("slot"), F.col("ts").alias("decided_at"), F.col("event_id").alias("decision_id"), F.col("event_type").alias("decision"))
    return references.durable_decision(rows).select("slot", "decision")


@query(f"select distinct source from ({_DANGLING}) where token in (select 'customer:' || (1000000000 + c_custkey) from customer where c_custkey % 2 = 0) or (token in (select 'nation:' || n_nationkey from nation where n_nationkey < 3))")
def repair_wakeups(spark, sf):
    seen = _dangling(spark, sf).select("source", "token")
    new = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("customer:"), (F.col("c_custkey") + 1000000000).cast("string")).alias("token")).union(table(spark, sf, "nation").where("n_nationkey < 3").select(chain("nation", "n_nationkey")))
    return references.wake(seen.where(F.col("token").rlike("1[0-9]{9}$")), seen.where(~F.col("token").rlike("1[0-9]{9}$")), new)


@query(f"select source_chain, target_chain from ({SQL_EDGES}) where target_chain in ('region:1', 'nation:3') or source_chain in ('region:1', 'nation:3')")
def edges_by_endpoint(spark, sf):
    anchors = table(spark, sf, "region").where("r_regionkey = 1").select(chain("region", "r_regionkey").alias("chain_id")).union(table(spark, sf, "nation").where("n_nationkey = 3").select(chain("nation", "n_nationkey")))
    return edges.touching(direct_edges(spark, sf), anchors).select("source_chain", "target_chain")


@query("""select o_orderkey, o_custkey, e.version from orders join (select user_id, version, valid_from, valid_to from (
  select user_id, version, min(ts) as valid_from, lead(min(ts)) over (partition by user_id order by version) as valid_to from (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as version
  from (select *, case when event_type is not distinct from lag(event_type) over (partition by user_id order by ts, event_id) and row_number() over (partition by user_id order by ts, event_id) > 1 then 0 else 1 end as new from events)) group by user_id, version)) e
  on e.user_id = o_custkey and valid_from <= timestamp '2024-01-15' and (valid_to is null or timestamp '2024-01-15' < valid_to)""")
def temporal_hydration(spark, sf):
    """Orders as edges to the version of their customer's event chain in effect at one instant."""
    from tessera.plans.star import event_versions

    v = event_versions(spark, sf).select(F.col("user_id").alias("chain_id"), F.col("version").cast("long").alias("version"), F.col("event_type").alias("name"), "valid_from", "valid_to").withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    seen = v.where(visibility.entity_at(F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))).select(F.col("chain_id").alias("o_custkey"), "version")
    return table(spark, sf, "orders").join(seen, "o_custkey").select("o_orderkey", "o_custkey", "version")


@query("""with s as (select o_custkey, o_orderpriority as target, o_orderdate as "at", o_orderkey, case when o_orderpriority is not distinct from lag(o_orderpriority) over w and row_number() over w > 1 then 0 else 1 end as new from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
  n as (select *, sum(new) over (partition by o_custkey order by "at", o_orderkey rows unbounded preceding) as i from s)
  select o_custkey, i as "interval", target, min("at") as valid_from, max("at") as last_seen_at, lead(min("at")) over (partition by o_custkey order by i) as valid_to from n group by o_custkey, i, target""")
def edge_supersede_intervals(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("target"), F.col("o_orderdate").alias("at"), "o_orderkey")
    return edges.supersede(rows, ["o_custkey"], "target", "at", ["o_orderkey"]).withColumn("interval", F.col("interval").cast("long"))


@query()
def edge_interval_plan(spark, sf):
    """The full interval rules over orders as declared changes: every 9th cancels, every 10th replaces."""
    kind = F.when(F.col("o_orderkey") % 9 == 0, "cancel").when(F.col("o_orderkey") % 10 == 0, "replace").otherwise("observe")
    start = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate") + F.expr("interval 30 days"))
    rows = table(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("target"), kind.alias("kind"), start.alias("effective_from"), F.lit(None).cast("timestamp_ntz").alias("effective_to"), F.col("o_orderdate").alias("captured_at"), F.col("o_orderkey").alias("idx"))
    return edges.plan(rows, "o_custkey long, target string, valid_from timestamp_ntz, valid_to timestamp_ntz, cancelled_at timestamp_ntz, outcome string", ["o_custkey"])


@query("""with t as (select o_custkey, o_orderdate as f, o_orderdate + interval 20 day as u, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as v, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders)
  select o_custkey, count(*) filter (n < u) as overlaps from t group by o_custkey having count(*) filter (n < u) > 0""")
def timeline_integrity(spark, sf):
    """Orders as intervals of 20 days: customers whose intervals overlap."""
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("interval 20 days")).alias("valid_to"), F.row_number().over(w).alias("version"), F.lit(False).alias("is_latest"))
    return edges.broken_timelines(rows, ["o_custkey"]).select("o_custkey", "overlaps")


@query("select c_custkey, case when c_custkey % 7 = 0 then 'protect' when c_custkey % 3 = 0 then 'release' else 'delete' end as action from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 4 = 0)")
def sweep_plan(spark, sf):
    """Customers not observed by a scan of every fourth order: protected, released or deleted."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    members = table(spark, sf, "customer").select(F.col("c_custkey").alias("chain_id"), F.when(F.col("c_custkey") % 3 == 0, 2).otherwise(1).alias("n_collections"), F.when(F.col("c_custkey") % 7 == 0, at("2024-02-01")).otherwise(at("2024-01-01")).alias("last_seen_at"))
    seen = table(spark, sf, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("chain_id"))
    return lifecycle.sweep(members, seen, at("2024-01-15")).select(F.col("chain_id").alias("c_custkey"), "action")


@query("select c_custkey from customer where c_custkey % 5 < 2")
def stale_collection_members(spark, sf):
    rows = table(spark, sf, "customer").withColumn("collections", F.array(F.struct(F.lit("crm").alias("key"), (F.col("c_custkey") % 5).alias("generation"))))
    return lifecycle.stale_members(rows, 2).select("c_custkey")


@query("""select o_orderkey, case when o_orderdate > timestamp '1998-06-01' then 'cancel' else 'close' end as action from orders where o_custkey % 10 = 0""")
def incident_close_or_cancel(spark, sf):
    e = table(spark, sf, "orders").select("o_orderkey", chain("orders", "o_orderkey").alias("source_chain"), chain("customer", "o_custkey").alias("target_chain"), F.col("o_orderdate").alias("valid_from"))
    gone = table(spark, sf, "customer").where("c_custkey % 10 = 0").select(chain("customer", "c_custkey").alias("chain_id"), F.lit("1998-06-01").cast("timestamp_ntz").alias("deleted_at"))
    return lifecycle.incident(e, gone).select("o_orderkey", "action")


@query("""with dead_n as (select n_nationkey from nation where n_regionkey = 2), dead_c as (select c_custkey from customer where c_nationkey in (select * from dead_n))
  select 'region:2' as chain_id union all select 'nation:' || n_nationkey from dead_n union all select 'customer:' || c_custkey from dead_c union all select 'orders:' || o_orderkey from orders where o_custkey in (select * from dead_c)""")
def owned_child_cascade(spark, sf):
    """A region's deletion takes its nations, their customers and their orders."""
    owned = direct_edges(spark, sf, ("nation", "customer", "orders")).select(F.col("target_chain").alias("parent"), F.col("source_chain").alias("child"))
    return lifecycle.cascade(table(spark, sf, "region").where("r_regionkey = 2").select(chain("region", "r_regionkey").alias("chain_id")), owned)


@query("select o_orderkey, timestamp '1999-01-01' as valid_to from orders where o_custkey % 6 = 1 and o_orderdate < timestamp '1999-01-01'")
def merge_closes_facts(spark, sf):
    """Customers 1 modulo 6 merge into their predecessor; their open orders close at the merge."""
    merges = table(spark, sf, "customer").where("c_custkey % 6 = 1").select(F.col("c_custkey").alias("loser"), (F.col("c_custkey") - 1).alias("winner"), F.lit("1999-01-01").cast("timestamp_ntz").alias("valid_from"))
    facts = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("source_chain"), F.col("o_orderdate").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return lifecycle.merge(merges, facts)[1].select("o_orderkey", "valid_to")


@query("select c_nationkey as winner, c_mktsegment as hash from customer where c_custkey % 2 = 0 group by all having (c_nationkey, c_mktsegment) not in (select (c_nationkey, c_mktsegment) from customer where c_custkey % 2 = 1)")
def split_releases_aliases(spark, sf):
    """Aliases granted by even merges end unless an odd one grants them too."""
    grants = table(spark, sf, "customer").select(F.col("c_nationkey").alias("winner"), F.col("c_mktsegment").alias("hash"), F.col("c_custkey").alias("merge_id"))
    return lifecycle.split(grants, grants.select("winner", "hash").limit(0), grants.where("merge_id % 2 = 0").select("merge_id"))


@query(f"select chain_id from ({SQL_ENTITIES}) where entity_type in ('nation', 'supplier') and regexp_matches(lower(name), 'a')")
def scoped_types(spark, sf):
    rows = entities(spark, sf).withColumn("org_id", F.lit("acme"))
    return rows.where(visibility.in_scope("acme") & F.col("entity_type").isin("nation", "supplier") & F.lower("name").contains("a")).select("chain_id")


@query("select event_id, 'a.b.c' as plain, event_id % 3 = 0 as is_excluded from events")
def path_exclusion(spark, sf):
    p = F.when(F.col("event_id") % 3 == 0, F.lit("meta[2].tags[0].x")).otherwise(F.lit("metadata[1].x"))
    return table(spark, sf, "events").select("event_id", names.plain_path(F.lit("a[0].b[12].c")).alias("plain"), names.excluded(p, ["meta.tags"]).alias("is_excluded"))


@query("select c_custkey, c_custkey % 4 <> 3 as is_identifier from customer")
def identifier_shapes(spark, sf):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("arn:x:y:"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com"))).when(k % 4 == 2, F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).otherwise(F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", names.identifier_shaped(text).alias("is_identifier"))


@query(f"select chain_id, lead_n from (select chain_id, row_number() over (partition by entity_type order by chain_id) as lead_n from ({SQL_ENTITIES})) where lead_n <= 3")
def top_per_type(spark, sf):
    return paging.top_per(entities(spark, sf), ["entity_type"], ["chain_id"], 3).select("chain_id", F.col("rank").alias("lead_n"))
