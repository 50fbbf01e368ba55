"""Queries of the read side: graph, search, threads, rules, paging."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import names
from tessera.operators import graph, paging, references, rules, search, threads
from tessera.plans.registry import query
from tessera.plans.star import SQL_EDGES, SQL_ENTITIES, chain, direct_edges, entities, key_index, reference_values
from tessera.storage import table


def asia_orders(spark, sf):
    """Flagship: orders within three reference hops of region ASIA.

    References are discovered from typed key values, decided, turned into edges, and walked hop by hop from the region.
    """
    kinds = ("region", "nation", "customer", "orders")
    observed = reference_values(spark, sf, kinds)
    found = references.structural(references.carriers(observed, key_index(spark, sf, kinds))).withColumn("match_class", F.lit(2))
    edges = references.edges(references.decide(found, observed), observed)
    root = entities(spark, sf, ("region",)).where("name = 'ASIA'").select("chain_id")
    near = graph.bounded_search(edges, root, 3)
    return near.where(F.col("chain_id").startswith("orders:")).select("chain_id", "distance")


@query("""select 'orders:' || o_orderkey as chain_id, 3 as distance from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where r_name = 'ASIA'""")
def orders_near_asia(spark, sf):
    return asia_orders(spark, sf)


@query(f"select namespace, entity_type, count(*) as n from ({SQL_ENTITIES}) group by all")
def catalog_counts(spark, sf):
    return graph.catalog(entities(spark, sf))


@query("select p_type as value, count(*) as n from part where contains(lower(p_type), 'e') group by p_type")
def filter_options(spark, sf):
    return graph.filter_options(table(spark, sf, "part"), "p_type", "E")


@query(f"""select source_chain as anchor, target_chain as neighbour, 'out' as direction from ({SQL_EDGES}) where source_chain like 'nation:1%' union all
  select target_chain, source_chain, 'in' from ({SQL_EDGES}) where target_chain like 'nation:1%'""")
def neighbors_out_in_both(spark, sf):
    anchors = entities(spark, sf, ("nation",)).where("chain_id like 'nation:1%'").select("chain_id")
    return graph.neighbours(direct_edges(spark, sf), anchors).select("anchor", "neighbour", "direction")


_BFS = f"""with recursive p as (select source_chain as a, target_chain as b from ({SQL_EDGES}) where source_type <> 'orders' union select target_chain, source_chain from ({SQL_EDGES}) where source_type <> 'orders'),
  w as (select 'region:' || r_regionkey as root, 'region:' || r_regionkey as chain_id, 0 as d from region where r_regionkey < 2 union select w.root, p.b, w.d + 1 from w join p on w.chain_id = p.a where w.d < 2),
  r as (select root, chain_id, min(d) as distance from w group by all)"""


@query(_BFS + " select root, chain_id, distance, 1 / (1 + distance) as score from r")
def bfs_neighborhood(spark, sf):
    roots = table(spark, sf, "region").where("r_regionkey < 2").select(chain("region", "r_regionkey").alias("chain_id"))
    return graph.bounded_search(direct_edges(spark, sf, ("nation", "customer", "supplier")), roots, 2)


@query(_BFS + " select root, chain_id, distance from (select *, row_number() over (partition by root order by distance, chain_id) as n from r) where n <= 40")
def bfs_budget(spark, sf):
    roots = table(spark, sf, "region").where("r_regionkey < 2").select(chain("region", "r_regionkey").alias("chain_id"))
    return graph.bounded_search(direct_edges(spark, sf, ("nation", "customer", "supplier")), roots, 2, 40).select("root", "chain_id", "distance")


@query("""select 'orders:' || o_orderkey as start, 'region:' || n_regionkey as "end", 3 as length, 'orders:' || o_orderkey || ' customer:' || o_custkey || ' nation:' || c_nationkey || ' region:' || n_regionkey as path
  from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey""")
def simple_paths_3(spark, sf):
    starts = table(spark, sf, "orders").select(chain("orders", "o_orderkey").alias("chain_id"))
    ends = table(spark, sf, "region").select(chain("region", "r_regionkey").alias("chain_id"))
    return graph.simple_paths(direct_edges(spark, sf), starts, ends).withColumn("path", F.array_join("path", " "))


@query("select 'customer:' || c_custkey as source_chain, 'nation:' || c_nationkey as target_chain from customer where c_nationkey < 10 union all select 'nation:' || n_nationkey, 'region:' || n_regionkey from nation where n_nationkey < 10")
def namespace_overview(spark, sf):
    seen = entities(spark, sf, ("region", "nation", "customer")).where("entity_type <> 'nation' or cast(split(chain_id, ':')[1] as int) < 10")
    return graph.overview(seen, direct_edges(spark, sf)).select("source_chain", "target_chain")


@query("select chain_id, name from (select 'supplier:' || s_suppkey as chain_id, s_name as name from supplier) order by name, chain_id limit 20 offset 10")
def entity_inventory(spark, sf):
    return paging.page(entities(spark, sf, ("supplier",)), ["name", "chain_id"], 20, 10).select("chain_id", "name")


@query("select o_custkey, o_orderkey, rank, n > 3 as truncated from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rank, count(*) over (partition by o_custkey) as n from orders) where rank <= 3")
def attached_facts_topk(spark, sf):
    return paging.top_per(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank", "truncated")


@query("select r_regionkey as chain, r_regionkey + 1 as rank, 12 // 5 + case when r_regionkey + 1 <= 12 % 5 then 1 else 0 end as share from region")
def evidence_budget_split(spark, sf):
    ranked = table(spark, sf, "region").select(F.col("r_regionkey").alias("chain"), (F.col("r_regionkey") + 1).alias("rank"))
    return search.budget_split(ranked, 12)


@query("select user_id as chain_id, count(distinct cast(ts as date)) as observations from events group by user_id")
def observation_signal(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("chain_id"), F.to_date("ts").alias("snapshot"))
    return graph.observation_signal(e)


@query(f"select target_chain as chain_id, count(distinct source_chain) as dependents from ({SQL_EDGES}) group by target_chain")
def dependents_signal(spark, sf):
    return graph.dependents_signal(direct_edges(spark, sf))


_TF = """len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x in ('the', 'of')))"""


@query(f"select doc_id, cast(r as double) / (1 + r) as score from (select doc_id, {_TF} as r from documents) where r > 0 order by score desc, doc_id limit 50")
def keyword_text(spark, sf):
    d = table(spark, sf, "documents").withColumn("name", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    return search.keyword(d, "doc_id", "name", ["text"], "the OF --", 50).select("doc_id", "score")


@query("""select s_suppkey, 1.0 as score, 'exact' as method from supplier where lower(s_name) = 'supplier#000000003'
  union all select s_suppkey, 0.5, 'text' from (select * from supplier where lower(s_name) <> 'supplier#000000003' and list_contains(string_split_regex(lower(s_name), '[^a-z0-9]+'), 'supplier#000000003'))""")
def keyword_exact_then_text(spark, sf):
    return search.keyword(table(spark, sf, "supplier"), "s_suppkey", "s_name", ["s_name"], "Supplier#000000003", 20)


@query("""with h as (select doc_id, text, instr(lower(text), 'thing') as p from documents), s as (select *, case when p > 0 then greatest(0, p - 1 - 256, p - 1 + 5 - 4096) else 0 end as b from h)
  select doc_id, b as start, least(b + 4096, length(text)) as "end", md5(substring(text, b + 1, 4096)) as content, p > 0 as matched from s""")
def excerpt_window(spark, sf):
    x = search.excerpt(F.col("text"), ["thing"])
    return table(spark, sf, "documents").select("doc_id", x.alias("x")).select("doc_id", "x.start", "x.end", F.md5("x.content").alias("content"), "x.matched")


@query(f"select doc_id, cast(r as double) / (1 + r) as score from (select doc_id, {_TF} as r from documents where source = 'src1') where r > 0 order by score desc, doc_id limit 20")
def snapshot_keyword(spark, sf):
    hits = search.text_search(table(spark, sf, "documents").where("source = 'src1'"), "doc_id", "text", "the of", 20)
    return hits.select("doc_id", "score")


_COS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(a.embedding, lambda z: z::double * z::double))) * sqrt(list_sum(list_transform(b.embedding, lambda z: z::double * z::double))))"


@query(f"""select query, vec_id, round(score, 6) as score, rank from (select a.vec_id as query, b.vec_id, {_COS} as score, row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id) as rank
  from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0) where rank <= 10""")
def cosine_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return search.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10).select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""select query, vec_id, round(score, 6) as score, rank from (select a.vec_id as query, b.vec_id, {_COS} as score, row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id) as rank
  from embeddings a join embeddings b on a.vec_id <> b.vec_id and a.label = b.label where a.vec_id % 50 = 0 and {_COS} >= 0.35) where rank <= 5""")
def cosine_topk_scoped(spark, sf):
    e = table(spark, sf, "embeddings")
    return search.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5, 0.35, "label").select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


def _lists(spark, sf):
    c = table(spark, sf, "customer")
    by_balance = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(100).select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("score"), F.lit("text").alias("method"))
    by_orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.sum("o_totalprice").alias("score")).orderBy(F.desc("score"), "key").limit(100)
    return by_balance, by_orders.withColumn("method", F.lit("vector"))


_RRF = """with a as (select c_custkey as key, row_number() over (order by c_acctbal desc, c_custkey) as r from customer qualify r <= 100),
  b as (select o_custkey as key, row_number() over (order by sum(o_totalprice) desc, o_custkey) as r from orders group by o_custkey qualify r <= 100),
  f as (select key, sum(61.0 / (60.0 + r) / 2) as score from (select * from a union all select * from b) {where} group by key)
  select key, round(score, 9) as score, row_number() over (order by score desc, key) as rank from f"""


@query(_RRF.format(where=""))
def rrf_fusion(spark, sf):
    return search.fuse(list(_lists(spark, sf)), "key").select("key", F.round("score", 9).alias("score"), "rank")


@query(_RRF.format(where="where key % 3 <> 0"))
def rrf_visible_only(spark, sf):
    """Ranks come before visibility: hidden hits promote nobody."""
    seen = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"))
    return search.fuse(list(_lists(spark, sf)), "key", visible=seen).select("key", F.round("score", 9).alias("score"), "rank")


@query()
def mmr_select(spark, sf):
    e = table(spark, sf, "embeddings")
    hits = search.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 50).select("query", "vec_id", "score").join(e.select("vec_id", "embedding"), "vec_id")
    return search.diversify(hits, "vec_id", "embedding", 0.7, 10, "query")


@query()
def mmr_by_names(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", (F.col("p_size") / 50).alias("score"))
    return search.diversify_names(paging.top_per(p, ["p_brand"], [F.desc("score"), F.col("p_partkey")], 40), "p_partkey", "p_name", 0.7, 8, "p_brand")


@query()
def fair_round_robin(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("request"), F.col("o_orderpriority").alias("grp"), (F.col("o_orderkey") % 40).alias("item"), F.col("o_orderkey").alias("position"))
    w = W.partitionBy("request", "grp", "item").orderBy("position")
    return search.fair_selection(rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r"), "request", 12)


@query("""with h as (select c_custkey as key, row_number() over (order by c_acctbal desc, c_custkey) as r, c_acctbal as score from customer qualify r <= 100), n as (select o_custkey as key, count(*) as n from orders group by 1)
  select h.key, row_number() over (order by n desc nulls last, score desc, h.key) as rank from h left join n using (key)""")
def observation_frequency_rank(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return search.by_signal(_lists(spark, sf)[0], n, "key", "n").select("key", "rank")


@query(_BFS + """, h as (select 'customer:' || c_custkey as key, c_acctbal as score, row_number() over (order by c_acctbal desc, c_custkey) as r from customer qualify r <= 100), d as (select chain_id as key, min(distance) as d from r group by 1)
  select h.key, row_number() over (order by d nulls last, score desc, h.key) as rank from h left join d using (key)""")
def node_distance_rank(spark, sf):
    roots = table(spark, sf, "region").where("r_regionkey < 2").select(chain("region", "r_regionkey").alias("chain_id"))
    near = graph.bounded_search(direct_edges(spark, sf, ("nation", "customer", "supplier")), roots, 2).groupBy(F.col("chain_id").alias("key")).agg(F.min("distance").alias("d"))
    hits = _lists(spark, sf)[0].withColumn("key", F.concat(F.lit("customer:"), F.col("key").cast("string")))
    return search.by_signal(hits, near, "key", "d", ascending=True).select("key", "rank")


@query("select o_custkey, max(o_totalprice) as score from orders group by o_custkey")
def candidate_dedup(spark, sf):
    return search.strongest(table(spark, sf, "orders").withColumnRenamed("o_totalprice", "score"), ["o_custkey"])


@query("select count(*) as eligible, count(*) filter (label < 5) as compatible, count(*) filter (label >= 5) as missing from embeddings")
def embedding_readiness(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("v", F.when(F.col("label") < 5, F.col("embedding")))
    return search.readiness(rows, "v", 64)


@query("select conv_id, turn, row_number() over w as ordinal, lag(turn) over w as previous_snapshot, lead(turn) over w as next_snapshot from conversations window w as (partition by conv_id order by turn)")
def thread_next_links(spark, sf):
    return threads.members(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", ["turn"], "turn")


@query("select conv_id, min(turn) as first_snapshot, max(turn) as last_snapshot, count(*) as n_members from conversations group by conv_id having min(turn) <= 0")
def threads_as_of(spark, sf):
    states = threads.state(table(spark, sf, "conversations").withColumn("captured", F.col("turn")), "conv_id", ["turn"], "turn", "captured")
    return threads.visible(states, F.lit(0)).drop("first_captured_at")


@query("select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn) as n from conversations) where n < 4 and n >= 2")
def thread_context(spark, sf):
    numbered = threads.members(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", ["turn"], "turn")
    return threads.context(numbered, "conv_id", F.lit(4), 2).select("conv_id", "turn")


@query("select o_orderpriority as pattern, count(distinct case when o_orderstatus = 'F' then o_custkey end) as positives, count(distinct case when o_orderstatus <> 'F' then o_custkey end) as negatives, count(distinct case when o_orderstatus = 'F' then o_orderkey % 10 end) as n_values from orders group by 1")
def rule_evidence(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("pattern"), "o_custkey", (F.col("o_orderkey") % 10).alias("value"), "o_orderstatus")
    return rules.evidence(rows, "pattern", "o_custkey", "value", F.col("o_orderstatus") == "F")


_MATRIX = """with c as (select source, case when quality = 1 then 1 end as e, case when length(text) > 300 then 1 end as p from labels join documents using (doc_id)),
  m as (select source, count(*) filter (e = p) as tp, count(*) filter (p is not null and e is distinct from p) as fp, count(*) filter (e is not null and e is distinct from p) as fn, count(*) filter (e is not null) as positives, count(*) filter (e is null) as negatives from c group by 1),
  r as (select *, round(case when tp + fp > 0 then cast(tp as double) / (tp + fp) end, 6) as precision, round(case when tp + fn > 0 then cast(tp as double) / (tp + fn) end, 6) as recall from m)"""


def _matrix(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return rules.confusion(rows.select("source", F.when(F.col("quality") == 1, 1).alias("expected"), F.when(F.length("text") > 300, 1).alias("predicted")), ["source"])


@query(_MATRIX + " select * from r")
def rule_confusion(spark, sf):
    return _matrix(spark, sf)


@query(_MATRIX + " select source, coalesce(positives >= 20 and negatives >= 20 and precision >= 0.99 and recall >= 0.95, false) as promote from r")
def rule_promotion(spark, sf):
    return rules.promotable(_matrix(spark, sf)).select("source", "promote")


@query("select p_name as alias, c as canonical from (select lower(p_type) as p_name, p_type as c from part where p_partkey % 3 = 0 union select p_type || ' ', p_type from part where p_partkey % 5 = 0)")
def alias_proposal(spark, sf):
    """Raw names with other case or spaces than the most frequent one of their normal form."""
    p = table(spark, sf, "part")
    raw = p.select(F.col("p_type").alias("name")).union(p.select("p_type")).union(p.where("p_partkey % 3 = 0").select(F.lower("p_type"))).union(p.where("p_partkey % 5 = 0").select(F.concat("p_type", F.lit(" "))))
    return rules.alias_proposals(raw)


@query("select r_regionkey, upper(replace(r_name, ' ', '_')) || '_X' as name from region")
def normalized_names(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", names.normalized_name(F.concat(F.lit("--"), F.lower("r_name"), F.lit(" / x!"))).alias("name"))


@query("select o_custkey, count(distinct o_orderpriority) as n_targets from orders group by 1 having count(distinct o_orderpriority) > 1")
def mapping_conflicts(spark, sf):
    return rules.mapping_conflicts(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")


@query("select s_suppkey, s_nationkey = 1 as drift from supplier where s_nationkey in (1, 2)")
def schema_drift(spark, sf):
    s = table(spark, sf, "supplier").where("s_nationkey in (1, 2)")
    r = s.select(F.col("s_suppkey").alias("source"), F.lit("active").alias("status"), F.lit("2").alias("fingerprint"))
    moved = rules.drifted(r, s.select(F.col("s_suppkey").alias("source"), F.when(F.col("s_nationkey") == 1, "1").otherwise("2").alias("fingerprint"))).select(F.col("source").alias("s_suppkey"), F.lit(True).alias("drift"))
    return s.select("s_suppkey").join(moved, "s_suppkey", "left").withColumn("drift", F.coalesce("drift", F.lit(False)))


@query("select c_custkey, case when c_custkey % 2 = 0 then 'authored' else 'rule' end as origin from customer")
def materialised_rules(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    return rules.materialised(c, c.where("c_custkey % 2 = 0"), ["c_custkey"])


@query("select c_custkey, lower(c_mktsegment) as folded, substring(c_name, 10) as stripped from customer")
def value_transforms(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", names.transform_value(F.col("c_mktsegment"), fold=True).alias("folded"), names.transform_value(F.col("c_name"), prefix="Customer#").alias("stripped"))


@query("select doc_id, true as truncated from (select doc_id from documents order by doc_id desc limit 25)")
def page_truncated_flag(spark, sf):
    return paging.page(table(spark, sf, "documents").select("doc_id"), [F.desc("doc_id")], 25)


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where (l_orderkey, l_linenumber) > (1000, 3)")
def keyset_page(spark, sf):
    rows = table(spark, sf, "lineitem").where(paging.after(["l_orderkey", "l_linenumber"], [1000, 3]))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")
