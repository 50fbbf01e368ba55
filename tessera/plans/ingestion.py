"""Queries of the ingestion side and of reads that join several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.functions import values
from tessera.operators import edges, graph, identity, ontology, paging, search
from tessera.plans.registry import query
from tessera.plans.star import SQL_EDGES, SQL_ENTITIES, chain, direct_edges, entities
from tessera.sources import snapshots, store
from tessera.storage import table


@query("select cast(o_custkey % 10 as varchar) as namespace, o_orderpriority as source, count(distinct case when o_custkey % 10 < 3 then 1 else o_orderkey % 2 end) as generations from orders group by all having count(distinct case when o_custkey % 10 < 3 then 1 else o_orderkey % 2 end) > 1")
def collection_scope_conflicts(spark, sf):
    """Pages of one collection must agree on its generation."""
    generation = F.when(F.col("o_custkey") % 10 < 3, 1).otherwise(F.col("o_orderkey") % 2)
    pages = table(spark, sf, "orders").select((F.col("o_custkey") % 10).cast("string").alias("namespace"), F.col("o_orderpriority").alias("source"), F.struct(F.lit("all").alias("key")).alias("collection"), generation.alias("sync_generation"), F.lit(True).alias("complete"))
    return snapshots.collection_conflicts(pages).select("namespace", "source", "generations")


_DRAFTS = "select c_custkey, case when c_custkey % 5 = 0 then null when c_custkey % 7 = 0 then '  ' else c_name end as code from customer"


def _drafts(spark, sf):
    c = table(spark, sf, "customer")
    code = F.when(F.col("c_custkey") % 7 == 0, "  ").otherwise(F.col("c_name"))
    props = F.map_filter(F.create_map(F.lit("code"), F.when(F.col("c_custkey") % 5 != 0, code), F.lit("seg"), F.col("c_mktsegment")), lambda k, v: v.isNotNull())
    none = F.array().cast("array<string>")
    return c.select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("code"))).otherwise(none).alias("primary_key"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.array(F.lit("name"), F.lit("seg")))).otherwise(F.array().cast("array<array<string>>")).alias("additional_keys"), props.alias("properties"), F.when(F.col("c_custkey") % 11 == 0, "deleted").when(F.col("c_custkey") % 13 == 0, "archived").otherwise("active").alias("lifecycle"))


@query(f"select c_custkey, case when c_custkey % 2 = 0 then 'code' when c_custkey % 3 = 0 then 'name,seg' end as keys, case when c_custkey % 2 = 0 then case when trim(coalesce(code, '')) = '' then 'key property missing' end when c_custkey % 3 <> 0 then 'no key' end as key_problem from ({_DRAFTS})")
def draft_keys(spark, sf):
    """Keys of drafts: the primary key, or the first additional group where none is declared; all must be present."""
    return snapshots.usable_keys(_drafts(spark, sf)).select("c_custkey", F.array_join("keys", ",").alias("keys"), "key_problem")


@query("select c_custkey, case when c_custkey % 11 = 0 then 'delete' else 'live' end as route from customer")
def lifecycle_routing(spark, sf):
    live, gone = snapshots.route(_drafts(spark, sf))
    return live.select("c_custkey", F.lit("live").alias("route")).union(gone.select("c_custkey", F.lit("delete").alias("route")))


@query("select 'orders:' || o_orderkey as source_chain, 'orders:' || o_orderkey || '/Line/' || l_linenumber as target_chain from (select distinct l_orderkey as o_orderkey, l_linenumber from lineitem)")
def child_extraction(spark, sf):
    """Lines nested in their order as a JSON array become child entities owned by it."""
    line = F.to_json(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("no"), F.col("l_partkey").cast("string").alias("part"))))
    parents = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(line.alias("lines")).select(chain("orders", "l_orderkey").alias("chain_id"), "lines")
    return snapshots.children(parents, "chain_id", "lines", "no", "Line")[1].select("source_chain", "target_chain")


@query("select p_partkey, concat_ws('; ', case when p_partkey % 4 = 0 then 'brand: required' end, case when p_size > 40 then 'size: maximum' end, case when p_type like '%E%' and length(p_type) > 6 then 'type: maxLength' end) as problems from part")
def attribute_schema(spark, sf):
    kind = F.when(F.col("p_type").contains("E"), F.col("p_type")).otherwise(F.lit("x"))
    props = F.map_filter(F.create_map(F.lit("brand"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")), F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), kind), lambda k, v: v.isNotNull())
    rule = {"required": ["brand"], "properties": {"size": {"type": "integer", "maximum": 40}, "type": {"maxLength": 6}}}
    return table(spark, sf, "part").select("p_partkey", F.array_join(snapshots.schema_problems(props, rule), "; ").alias("problems"))


@query("select p_partkey, case when p_size % 2 = 0 then 'a c' else 'a b c' end as excluded from part")
def hash_exclusions(spark, sf):
    always = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(values.hash_exclusions(F.array(F.lit("c"), F.lit("a")), F.array(F.lit("b"), F.lit("a")), always), " ").alias("excluded"))


@query("select doc_id, strlen(text) as content_bytes, case when strlen(text) <= 2000 then md5(text) end as content from documents")
def snapshot_content_cap(spark, sf):
    rows = store.capped(table(spark, sf, "documents").select("doc_id", "text"), "text", 2000)
    return rows.select("doc_id", F.col("content_bytes").cast("long").alias("content_bytes"), F.md5("text").alias("content"))


@query("select event_type, count(*) as observed, count(*) filter (value > 10) as updated from events group by event_type")
def committed_counts(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.lit(1).alias("observed"), (F.col("value") > 10).cast("int").alias("updated"))
    return rows.groupBy("event_type").agg(F.sum("observed").alias("observed"), F.sum("updated").alias("updated"))


@query("select o_orderkey as obs, o_custkey as chain_id from orders where not (o_custkey % 4 = 0 and o_orderkey % 3 = 0)")
def revived_keys(spark, sf):
    """An alternate key of a deleted chain with another primary key resurrects nothing."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("obs"), F.col("o_custkey").alias("chain_id"), F.when(F.col("o_custkey") % 4 == 0, F.col("o_orderdate")).alias("deleted_at"), F.lit(False).alias("is_primary"), F.lit("a").alias("stored_primary"), F.when(F.col("o_orderkey") % 3 == 0, "b").otherwise("a").alias("observed_primary"))
    return identity.without_revived(rows).select("obs", "chain_id")


@query("select r_regionkey, case r_regionkey % 3 when 0 then 'RELATES_TO' when 1 then 'DEPENDS_ON' end as canonical from region")
def canonical_relations(spark, sf):
    raw = F.when(F.col("r_regionkey") % 3 == 0, "relates to").when(F.col("r_regionkey") % 3 == 1, "Needs!").otherwise("unknown")
    aliases = spark.createDataFrame([("needs", "depends-on")], "alias string, target string")
    vocabulary = spark.createDataFrame([("RELATES_TO",), ("DEPENDS_ON",)], "term string")
    return ontology.canonical(table(spark, sf, "region").select("r_regionkey", raw.alias("name")), aliases, vocabulary).select("r_regionkey", "canonical")


@query(f"select source_chain, target_chain from ({SQL_EDGES}) where source_type in ('nation', 'customer')")
def permitted_signatures(spark, sf):
    e = direct_edges(spark, sf).withColumn("source_type", F.split("source_chain", ":")[0]).withColumn("target_type", F.split("target_chain", ":")[0])
    allowed = spark.createDataFrame([("nation", "*", "RELATES_TO"), ("customer", "nation", "RELATES_TO"), ("orders", "part", "RELATES_TO")], "source_type string, target_type string, name string")
    return ontology.permitted(e, allowed).select("source_chain", "target_chain")


@query("select distinct c_mktsegment as source_type, 'nation' as target_type, 'r' || c_nationkey % 3 as name from customer where c_nationkey % 3 = 1")
def signature_intersection(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("source_type"), F.lit("*").alias("target_type"), F.concat(F.lit("r"), (F.col("c_nationkey") % 3).cast("string")).alias("name")).distinct()
    b = table(spark, sf, "nation").where("n_nationkey % 3 = 1").select(F.lit("*").alias("source_type"), F.lit("nation").alias("target_type"), F.concat(F.lit("r"), (F.col("n_nationkey") % 3).cast("string")).alias("name")).distinct()
    return ontology.common_signatures(a, b)


@query("select label as scope, vec_id % 5 as community_id, count(*) as n from embeddings where (label % 2 = 0 and vec_id % 5 < 2) or (label % 2 = 1 and vec_id % 5 >= 2) group by all")
def published_communities(spark, sf):
    """Communities 0 and 1 are of generation 1, the others of 2; even scopes publish 1, odd ones 2."""
    e = table(spark, sf, "embeddings")
    id_ = F.concat_ws("/", "label", (F.col("vec_id") % 5))
    communities = e.select(F.col("label").alias("scope"), id_.alias("community_id"), F.when(F.col("vec_id") % 5 < 2, 1).otherwise(2).alias("generation")).distinct()
    states = e.select(F.col("label").alias("scope"), F.when(F.col("label") % 2 == 0, 1).otherwise(2).alias("active_generation")).distinct()
    found = ontology.community_members(e.select(F.col("label").alias("scope"), id_.alias("community_id"), "vec_id"), communities, states)
    return found.groupBy("scope", F.split("community_id", "/")[1].cast("long").alias("community_id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select chain_id, entity_type, name from ({SQL_ENTITIES}) where chain_id in ('nation:3', 'customer:7', 'part:1')")
def entities_by_chains(spark, sf):
    """Batched anchors at one read instant: a semi-join with the anchor table."""
    anchors = reduce(lambda a, b: a.union(b), (table(spark, sf, t).where(c).select(chain(k, col).alias("chain_id")) for t, c, k, col in (("nation", "n_nationkey = 3", "nation", "n_nationkey"), ("customer", "c_custkey = 7", "customer", "c_custkey"), ("part", "p_partkey = 1", "part", "p_partkey"))))
    return entities(spark, sf).join(anchors, "chain_id", "left_semi").select("chain_id", "entity_type", "name")


@query("select o_orderkey, o_custkey, c_name from orders join customer on c_custkey = o_custkey where o_orderkey % 5 = 0 and c_custkey % 2 = 0")
def snapshot_observations(spark, sf):
    """Snapshots (orders) with the exact entity versions they mention."""
    snaps = table(spark, sf, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", "o_custkey")
    versions = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return snaps.join(versions, "o_custkey").select("o_orderkey", "o_custkey", "c_name")


@query("select o_orderkey, cast(1 as double) / 2 as score from orders join customer on c_custkey = o_custkey where lower(o_orderpriority) like '%urgent%' and c_mktsegment = 'BUILDING' order by o_orderkey limit 50")
def relationship_keyword(spark, sf):
    """Keyword search over relationships, both of whose ends are visible."""
    e = table(spark, sf, "orders").select("o_orderkey", chain("orders", "o_orderkey").alias("source_chain"), chain("customer", "o_custkey").alias("target_chain"), F.regexp_replace("o_orderpriority", "-", " ").alias("description"))
    seen = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(chain("customer", "c_custkey").alias("chain_id")).union(table(spark, sf, "orders").select(chain("orders", "o_orderkey")))
    return search.keyword(graph.overview(seen, e), "o_orderkey", "description", ["description"], "urgent", 50).select("o_orderkey", "score")


_COS1 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(a.embedding, lambda z: z::double * z::double))) * sqrt(list_sum(list_transform(b.embedding, lambda z: z::double * z::double))))"


@query(f"""with near as (select distinct b.label as label from (select * from embeddings where vec_id = 0) a join embeddings b on abs(a.label - b.label) <= 1)
  select b.vec_id, round({_COS1}, 6) as score from (select * from embeddings where vec_id = 0) a join embeddings b on b.vec_id <> 0 where b.label in (select label from near) order by {_COS1} desc, b.vec_id limit 15""")
def graph_anchored_search(spark, sf):
    """Similarity inside a neighbourhood: labels are nodes, neighbouring labels are linked."""
    e = table(spark, sf, "embeddings")
    labels = e.select("label").distinct()
    links = labels.select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("source_chain"), F.concat(F.lit("l"), (F.col("label") + 1).cast("string")).alias("target_chain"))
    root = e.where("vec_id = 0").select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("chain_id"))
    near = graph.bounded_search(links, root, 1).select(F.substring("chain_id", 2, 9).cast("int").alias("label"))
    inside = e.join(near, "label", "left_semi")
    return search.nearest(inside, e.where("vec_id = 0"), "vec_id", "embedding", 15).select("vec_id", F.round("score", 6).alias("score"))


@query("""with seeds as (select c_custkey from customer order by c_acctbal desc, c_custkey limit 5) select 'orders:' || o_orderkey as chain_id, 1 as distance from orders where o_custkey in (select * from seeds)
  union all select 'nation:' || c_nationkey, 1 from customer where c_custkey in (select * from seeds) group by 1 union all select 'customer:' || c_custkey, 0 from seeds""")
def expansion_from_fused(spark, sf):
    """The best fused hits seed a one-hop expansion."""
    c = table(spark, sf, "customer")
    best = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(5).select(chain("customer", "c_custkey").alias("chain_id"))
    near = graph.bounded_search(direct_edges(spark, sf), best, 1)
    return near.groupBy("chain_id").agg(F.min("distance").alias("distance"))


@query("""with hits as (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as rank from customer qualify rank <= 7), s as (select *, 20 // 7 + case when rank <= 20 % 7 then 1 else 0 end as share from hits),
  f as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as n from orders) select c_custkey, o_orderkey from s join f on o_custkey = c_custkey where n <= share""")
def attached_evidence(spark, sf):
    """Facts attached to ranked hits under an even budget."""
    hits = paging.page(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), "c_custkey"], 7)
    from pyspark.sql import Window as W

    ranked = search.budget_split(hits.withColumn("rank", F.row_number().over(W.orderBy(F.desc("c_acctbal"), "c_custkey"))), 20)
    facts = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey").join(F.broadcast(ranked.select("c_custkey", "share")), "c_custkey")
    top = paging.top_per(facts, ["c_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 3)
    return top.where(F.col("rank") <= F.col("share")).select("c_custkey", "o_orderkey")


@query("select least(count(*), 513) as population from embeddings where label = 3")
def vector_population(spark, sf):
    """The population of a scope, counted up to the bound that decides on an exact scan."""
    return table(spark, sf, "embeddings").where("label = 3").limit(513).agg(F.count(F.lit(1)).alias("population"))


@query(f"select source_chain, target_chain from ({SQL_EDGES}) where (source_chain, target_chain) in (select 'customer:' || c_custkey, 'nation:' || c_nationkey from customer where c_custkey % 9 = 0)")
def edges_by_pair(spark, sf):
    pairs = table(spark, sf, "customer").where("c_custkey % 9 = 0").select(chain("customer", "c_custkey").alias("source_chain"), chain("nation", "c_nationkey").alias("target_chain"))
    return edges.between(direct_edges(spark, sf), pairs).select("source_chain", "target_chain")
