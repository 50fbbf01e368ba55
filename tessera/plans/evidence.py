"""Queries over evidence: relationship recall, limits of walks, sweeps, projections, rules, predicates of observations."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import names, values, visibility
from tessera.operators import edges, graph, lifecycle, references, rules, search, threads
from tessera.plans.registry import query
from tessera.plans.star import SQL_EDGES, chain, direct_edges, entities
from tessera.storage import table

_VECTOR = [1.0 if i % 3 == 0 else -0.5 if i % 3 == 1 else 0.25 for i in range(64)]
_Q = "[" + ", ".join(map(str, _VECTOR)) + "]"
_COSINE = f"list_sum(list_transform(list_zip(embedding, {_Q}), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(embedding, lambda z: z::double * z::double))) * {sum(x * x for x in _VECTOR) ** 0.5!r})"


def _facts(spark, sf):
    """Vectors as edges from a label to a bucket of ids."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("uuid"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("source_chain"), F.concat(F.lit("b"), (F.col("vec_id") % 7).cast("string")).alias("target_chain"), "embedding")


@query(f"""select uuid, rank, round(score, 6) as score from (select vec_id as uuid, {_COSINE} as score, row_number() over (order by {_COSINE} desc, vec_id) as rank from embeddings) where rank <= 25""")
def relationship_similarity(spark, sf):
    return search.relationship_similarity(_facts(spark, sf), _VECTOR, 25).select("uuid", "rank", F.round("score", 6).alias("score"))


@query(f"""select uuid, rank from (select vec_id as uuid, row_number() over (order by {_COSINE} desc, vec_id) as rank from embeddings where (label = 3 or vec_id % 7 = 2) and {_COSINE} >= -0.05) where rank <= 25""")
def relationship_similarity_anchored(spark, sf):
    anchors = spark.createDataFrame([("l3",), ("b2",)], "chain_id string")
    return search.relationship_similarity(_facts(spark, sf), _VECTOR, 25, -0.05, anchors).select("uuid", "rank")


@query("select c.conv_id, turn from conversations c join (select conv_id from conversations group by 1 having max(turn) >= 4) using (conv_id)")
def thread_members_only(spark, sf):
    """Turns that belong to the threads of at least five turns."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("snapshot"))
    long = turns.groupBy(F.col("conv_id").alias("thread")).agg(F.max("turn").alias("last")).where("last >= 4")
    return threads.in_thread(turns, turns.select(F.col("conv_id").alias("thread"), "snapshot"), long).select("conv_id", "turn")


@query("""select 'supplier:' || s_suppkey as start, 'customer:' || c_custkey as "end", 2 as length from supplier join customer on s_nationkey = c_nationkey where s_acctbal > 9000 and c_acctbal > 9000""")
def undirected_paths(spark, sf):
    """Rich suppliers meet rich customers in their nation: up one edge, down another."""
    s = table(spark, sf, "supplier").where("s_acctbal > 9000").select(chain("supplier", "s_suppkey").alias("chain_id"))
    c = table(spark, sf, "customer").where("c_acctbal > 9000").select(chain("customer", "c_custkey").alias("chain_id"))
    return graph.simple_paths(direct_edges(spark, sf, ("customer", "supplier")), s, c, hops=2, direction="both").select("start", "end", "length")


@query("""select 'region:' || r_regionkey as start, 'customer:' || c_custkey as "end", 'region:' || r_regionkey || ' nation:' || n_nationkey || ' customer:' || c_custkey as path
  from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey where r_name = 'ASIA'""")
def inward_paths(spark, sf):
    asia = table(spark, sf, "region").where("r_name = 'ASIA'").select(chain("region", "r_regionkey").alias("chain_id"))
    ends = table(spark, sf, "customer").select(chain("customer", "c_custkey").alias("chain_id"))
    found = graph.simple_paths(direct_edges(spark, sf, ("nation", "customer")), asia, ends, hops=2, direction="in")
    return found.select("start", "end", F.array_join("path", " ").alias("path"))


_SUBGRAPH = """with n as (select 'nation:' || n_nationkey as c, 'region:' || n_regionkey as up from nation where n_regionkey = 1), h1 as (select c from n order by c limit 4),
  all2 as (select 'customer:' || c_custkey as c, 'nation:' || c_nationkey as up from customer union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey from supplier),
  h2 as (select distinct c from all2 where up in (select c from h1) order by c limit 4)"""


@query(_SUBGRAPH + " select 'region:1' as chain_id, 0 as distance union all select c, 1 from h1 union all select c, 2 from h2")
def limited_subgraph(spark, sf):
    """Two hops from a region, four new chains each."""
    return graph.subgraph(direct_edges(spark, sf, ("nation", "customer", "supplier")), spark.createDataFrame([("region:1",)], "chain_id string"), 2, 4, 6)[0]


@query(_SUBGRAPH + """, e as (select h1.c as s, 'region:1' as t, 1 as d from h1 union all select all2.c, up, 2 from all2 where all2.c in (select c from h2) and up in (select c from h1))
  select s as source_chain, t as target_chain, d as distance from e order by d, s, t limit 6""")
def limited_subgraph_edges(spark, sf):
    return graph.subgraph(direct_edges(spark, sf, ("nation", "customer", "supplier")), spark.createDataFrame([("region:1",)], "chain_id string"), 2, 4, 6)[1]


@query("""select o_orderkey, case when o_orderdate + interval 1 day > timestamp '1998-01-01' and o_orderkey % 2 = 0 then 'protect' when o_orderkey % 5 = 0 then 'release' when o_orderdate > timestamp '1998-01-01' then 'cancel' else 'close' end as action
  from orders where o_orderkey % 3 < 2""")
def relationship_sweep(spark, sf):
    """Edges of orders at generations 0 to 2 of a collection, every fifth in another one, too; the scan has generation 2."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    member = lambda key, g: F.struct(F.lit(key).alias("key"), g.cast("long").alias("generation"))
    both = F.when(k % 5 == 0, F.array(member("scan", k % 3), member("other", F.lit(9)))).otherwise(F.array(member("scan", k % 3)))
    seen = F.when(k % 2 == 0, day + F.expr("interval 1 day")).otherwise(F.lit("1990-01-01").cast("timestamp_ntz"))
    rows = table(spark, sf, "orders").select("o_orderkey", both.alias("collections"), seen.alias("last_seen_at"), day.alias("valid_from"))
    return lifecycle.sweep_relationships(rows, "scan", 2, F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey", "action")


@query("select o_custkey as key from orders group by 1 having bool_and(o_orderstatus <> 'P' and o_orderpriority <> '1-URGENT')")
def sweep_suppression(spark, sf):
    """Customers as collections of their orders: one order in progress or urgent, and the scan deletes nothing."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.lit(True).alias("complete"), (F.col("o_orderstatus") == "P").alias("failed"), (F.col("o_orderpriority") == "1-URGENT").alias("partial"))
    return lifecycle.sweepable(rows)


@query("select 'supplier:' || s_suppkey as chain_id, 'supplier' as entity_type, s_name as name, cast(s_nationkey as varchar) as namespace from supplier")
def compact_entities(spark, sf):
    return values.compact(entities(spark, sf, ("supplier",)).withColumn("embedding", F.lit("x")))


@query("""select p_partkey, 'brand=' || p_brand || ' size=' || case when p_size % 2 = 0 then p_size::varchar else '{' end as properties, 'chain_id' as metadata, case when p_size % 2 = 0 then '' else 'size' end as diagnostics from part""")
def typed_records(spark, sf):
    """Stored parts: a size tagged as JSON, broken where it is odd."""
    size = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("{")
    stored = F.create_map(F.lit("chain_id"), F.lit("x"), F.lit("prop_brand"), F.col("p_brand"), F.lit("prop_size"), size, F.lit("property_type_size"), F.lit("j"), F.lit("embedding"), F.lit("[]"))
    r = values.typed_record(stored)
    pairs = F.transform(F.array_sort(F.map_entries(r["properties"])), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, sf, "part").select("p_partkey", F.array_join(pairs, " ").alias("properties"), F.array_join(F.map_keys(r["metadata"]), " ").alias("metadata"), F.array_join(r["diagnostics"], " ").alias("diagnostics"))


@query("select o_orderkey, case when o_orderstatus = 'F' then 'declared' else 'ongoing' end as time_evidence from orders")
def ongoing_evidence(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("valid_to"))
    return edges.evidence_of_time(rows).select("o_orderkey", "time_evidence")


@query("""with s as (select doc_id, len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w in ('the', 'and'))) as r from documents where doc_id % 3 <> 0 and doc_id % 5 <> 0)
  select chain_id, round(score, 6) as score from (select doc_id as chain_id, r / (1 + r) as score from s where r > 0 order by score desc, chain_id limit 30)""")
def summary_recall(spark, sf):
    """Texts as summaries: a third has none yet, a fifth is no longer valid."""
    d, at = F.col("doc_id"), lambda x: F.lit(x).cast("timestamp_ntz")
    made = F.when(d % 3 == 0, at("2025-01-01")).otherwise(at("2024-01-01"))
    rows = table(spark, sf, "documents").select(d.alias("chain_id"), F.col("text").alias("derived_summary"), made.alias("summary_as_of"), F.when(d % 5 == 0, at("2024-02-01")).alias("summary_valid_until"))
    return search.summaries(rows, at("2024-06-01"), "the AND", 30).select("chain_id", F.round("score", 6).alias("score"))


def _recipe_rows(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.concat(F.lit("label "), F.col("label").cast("string")).alias("name"), "embedding")


@query(f"""with t as (select vec_id, 1.0 as score, row_number() over (order by vec_id) as r from embeddings where label = 3 order by vec_id limit 40),
  v as (select vec_id, row_number() over (order by score desc, vec_id) as r from (select vec_id, {_COSINE} as score from embeddings) where score >= 0.1 order by r limit 40),
  f as (select vec_id, sum(vote) as score, bool_or(exact) as exact from (select vec_id, 2.0 / (1 + r) / 2 as vote, true as exact from t union all select vec_id, 2.0 / (1 + r) / 2, false from v) group by 1)
  select vec_id, rank from (select vec_id, row_number() over (order by exact desc, score desc, vec_id) as rank from f) where rank <= 10""")
def recipe_hybrid(spark, sf):
    """The hybrid recipe: names equal to the query, and vectors, fused by rank."""
    recipe = search.Recipe(vector=True, min_cosine=0.1)
    return search.recall(recipe, _recipe_rows(spark, sf), "vec_id", "name", ["name"], "label 3", "embedding", _VECTOR).select("vec_id", "rank")


@query("select event_id, case when event_type = 'error' then value < 30 else value < 50 end as is_stale from events")
def stale_predicate(spark, sf):
    """Values as minutes: a live version was last seen at 50, an erroneous one deleted at 30 (exclusive by a minute)."""
    at = lambda m: F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(mins=m)
    fixed = lambda m: at(F.lit(m))
    dead = F.col("event_type") == "error"
    rows = table(spark, sf, "events").select("event_id", F.col("value"), fixed(10).alias("valid_from"), F.when(dead, fixed(20)).otherwise(fixed(50)).alias("last_seen_at"), fixed(5).alias("last_transition_at"), F.when(dead, fixed(29)).alias("deleted_at"))
    captured = fixed(0) + F.make_dt_interval(mins=F.floor("value").cast("int"))
    return rows.select("event_id", visibility.stale(captured).alias("is_stale"))


@query("select c_custkey, c_custkey % 3 < 2 and c_custkey % 4 <> 0 as is_swept from customer")
def swept_members(spark, sf):
    k = F.col("c_custkey")
    one = lambda key, g: F.struct(F.lit(key).alias("key"), g.cast("long").alias("generation"))
    held = F.when(k % 4 == 0, F.array(one("a", k % 3), one("b", k % 3))).otherwise(F.array(one("a", k % 3)))
    return table(spark, sf, "customer").select("c_custkey", visibility.swept(held, F.lit("a"), F.lit(2)).alias("is_swept"))


@query("select p_partkey, p_partkey % 2 = 0 as same from part")
def label_fold(spark, sf):
    """Labels equal but for case and punctuation, or not."""
    other = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("--"), F.upper(F.regexp_replace("p_type", " ", "_")))).otherwise(F.concat("p_type", F.lit("x")))
    return table(spark, sf, "part").select("p_partkey", (names.label_words(F.col("p_type")) == names.label_words(other)).alias("same"))


@query("select 'o' || o_orderkey as source, 'nation:' || n_nationkey as chain_id from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey")
def folded_references(spark, sf):
    """Orders name their nation in lower case; keys are names in upper case."""
    n = table(spark, sf, "nation")
    index = n.select(F.col("n_name").alias("token"), chain("nation", "n_nationkey").alias("chain_id"), F.lit("nation").alias("target_type"), F.array(F.lit("name")).alias("key_group"), F.lit(1).alias("group_size"))
    seen = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"))
    seen = seen.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source"), F.lit("nation").alias("location"), F.lower("n_name").alias("token"))
    return references.carriers(seen, index, folded=True).select("source", "chain_id")


@query("""select p_brand as pattern, count(distinct case when p_size > 25 then p_partkey end) as positives from part group by 1
  having count(distinct case when p_size > 25 then p_partkey end) >= 3 and count(distinct case when p_size > 25 then p_size end) >= 2""")
def rule_proposals(spark, sf):
    cases = table(spark, sf, "part").select(F.col("p_brand").alias("pattern"), F.col("p_partkey").alias("case_id"), F.col("p_size").alias("value"))
    return rules.proposals(rules.evidence(cases, "pattern", "case_id", "value", F.col("value") > 25)).select("pattern", "positives")


@query("""with s as (select c_custkey as rule_id, ['proposed', 'validated', 'active', 'stale', 'revoked'][c_custkey % 5 + 1] as status, ['validated', 'active', 'stale', 'revoked'][c_custkey % 4 + 1] as to_status from customer)
  select rule_id, to_status, status <> 'revoked' and (to_status = 'revoked' or (status, to_status) in (('proposed', 'validated'), ('validated', 'active'), ('active', 'stale'), ('stale', 'validated'))) as allowed from s""")
def rule_transitions(spark, sf):
    k = F.col("c_custkey").cast("int")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), k % n + 1)
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("rule_id"), pick(("proposed", "validated", "active", "stale", "revoked"), 5).alias("status"), pick(("validated", "active", "stale", "revoked"), 4).alias("to_status"))
    return rules.transitions(rows.select("rule_id", "status"), rows.select("rule_id", "to_status")).select("rule_id", "to_status", "allowed")


@query("""select a.l_orderkey, a.l_linenumber, concat_ws(' ', case when a.l_returnflag <> b.l_returnflag then 'flag' end, case when a.l_linestatus <> b.l_linestatus then 'status' end) as conflicts
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1""")
def metadata_conflicts(spark, sf):
    """Neighbouring lines of an order as two observations of one instant."""
    tags = lambda flag, status: F.create_map(F.lit("flag"), F.col(flag), F.lit("status"), F.col(status))
    one = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    two = one.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    found = values.tag_conflicts(tags("l_returnflag", "l_linestatus"), tags("flag", "status"))
    return one.join(two, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.array_join(found, " ").alias("conflicts"))


@query(f"select source_chain, target_chain from ({SQL_EDGES}) where location = 'o_custkey' and cast(split_part(source_chain, ':', 2) as bigint) in (select o_orderkey from orders where o_orderstatus = 'P')")
def edges_of_slots(spark, sf):
    """The edges that the customer slots of orders in progress own."""
    own = direct_edges(spark, sf, ("orders",)).withColumn("slot", F.lit("orders.o_custkey")).unionByName(direct_edges(spark, sf, ("customer",)).withColumn("slot", F.lit("customer.c_nationkey")))
    asked = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(chain("orders", "o_orderkey").alias("source_chain"), F.lit("orders.o_custkey").alias("slot"))
    return edges.of_slot(own, asked).select("source_chain", "target_chain")


@query("select 'customer:' || c_custkey as source_chain, 'nation:' || c_nationkey as target_chain from customer where c_nationkey in (3, 7) union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey from supplier where s_nationkey in (3, 7)")
def edges_of_scope(spark, sf):
    return edges.of_scope(direct_edges(spark, sf, ("customer", "supplier")), entities(spark, sf, ("customer", "supplier")), ["3", "7"]).select("source_chain", "target_chain")


@query("""select 'nation:' || n_nationkey as anchor, 'in' as direction, 'customer:' || c_custkey as neighbour from nation join customer on c_nationkey = n_nationkey
  union all select 'nation:' || n_nationkey, 'in', 'supplier:' || s_suppkey from nation join supplier on s_nationkey = n_nationkey union all select 'nation:' || n_nationkey, 'out', 'region:' || n_regionkey from nation""")
def batched_anchors(spark, sf):
    """All nations as one batch of anchors."""
    anchors = table(spark, sf, "nation").select(chain("nation", "n_nationkey").alias("chain_id"))
    return graph.neighbours(direct_edges(spark, sf, ("nation", "customer", "supplier")), anchors).select("anchor", "direction", "neighbour")


#: Counters of a run that a commit adds up.
COUNTERS = ("entities_created", "entities_updated", "entities_unchanged", "entities_deleted", "edges_created", "edges_updated", "edges_closed", "edges_cancelled", "references_resolved", "references_unresolved")


def committed_counts(runs: DataFrame) -> DataFrame:
    """The sum of every counter over all runs; an overflow is an error under ANSI arithmetic."""
    return runs.agg(*(F.sum(c).alias(c) for c in COUNTERS))


@query("select " + ", ".join(f"sum(case when l_linenumber = {i % 7 + 1} then l_quantity else {i} end)::bigint as {c}" for i, c in enumerate(COUNTERS)) + " from lineitem")
def run_counters(spark, sf):
    """Lines as runs with ten counters."""
    q = F.col("l_quantity").cast("long")
    runs = table(spark, sf, "lineitem").select(*(F.when(F.col("l_linenumber") == i % 7 + 1, q).otherwise(i).alias(c) for i, c in enumerate(COUNTERS)))
    return committed_counts(runs)


@query("""with recursive u as (select l_partkey as component, l_orderkey as obs from lineitem where l_quantity >= 49),
  l as (select distinct obs, min(obs) over (partition by component) as first from u), s as (select obs as a, first as b from l union select first, obs from l),
  r as (select a as node, a as seen from s union select r.node, s.b from r join s on r.seen = s.a) select node, min(seen) as component from r group by node""")
def bulk_order_components(spark, sf):
    """Orders of large quantities that share a part."""
    from tessera.operators.components import connected_components

    rows = table(spark, sf, "lineitem").where("l_quantity >= 49").select("l_partkey", "l_orderkey")
    first = rows.groupBy("l_partkey").agg(F.min("l_orderkey").alias("dst"))
    links = rows.join(first, "l_partkey").select(F.col("l_orderkey").alias("src"), "dst")
    found = connected_components(links)
    alone = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct().join(found, "node", "left")
    return alone.select("node", F.coalesce("component", "node").alias("component"))
