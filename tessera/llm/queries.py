"""The registered queries of the subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, decontaminate, html_text, licenses, passages, quality, simhash, suffixes, url_filter
from tessera.llm.words import bounded_batches
from tessera.storage import table


def _bounded(query):
    """The query, run with small Arrow batches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text = html_text.extract(pages, ["page_id", "url"], html_text.fit(pages))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))  # without an id: no
    scored = quality.score(docs, quality.fit(docs, labels.where(~held_out)), ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(table(spark, sf_dir, "documents"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matches(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_url_filter": op3_url_filter,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_neighbours": op6_neighbours,
    "op7_suffixes": op7_suffixes,
    "op8_passages": op8_passages,
    "op9_licenses": op9_licenses,
    "op10_decontamination": op10_decontamination,
}
QUERIES = {name: _bounded(query) for name, query in QUERIES.items()}

#: The words of an item or text, A-Z lower-cased, each between two spaces.
_SPACED = "' ' || trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+', ' ', 'g'), ' ') || ' '"

#: What SQL can say of the operators' results.
ORACLES: dict[str, str] = {
    "bpe_round_trip": "select doc_id, sha256(coalesce(text, '')) as decoded_sha256 from documents",
    "url_rules": """with u as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
      p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
      r(h, q) as (values ('org', '/'), ('example.org', '/es/'), ('example.org', '/en/1'), ('com', '/fr/'), ('com', '/de/')),
      f as (select page_id, h || q as rule, row_number() over (partition by page_id order by length(h || q) desc) as n from p, r where (host = h or ends_with(host, '.' || h)) and starts_with(path, q))
      select p.page_id, host, path, rule from p left join f on p.page_id = f.page_id and n = 1""",
    "verbatim_leaks": f"""with d as (select doc_id, {_SPACED.format('text')} as t from documents), b as (select item_id, {_SPACED.format('text')} as t from benchmark)
      select doc_id, item_id from d, b where length(b.t) > 2 and contains(d.t, b.t)""",
}


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded bytes of op2 alone."""
    return op2_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosts, paths and rules of op3 alone."""
    return url_filter.with_rule(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule")


def verbatim_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of op10 without an edit."""
    return op10_decontamination(spark, sf_dir).where("edit = 0").select("doc_id", "item_id")


QUERIES |= {q.__name__: _bounded(q) for q in (bpe_round_trip, url_rules, verbatim_leaks)}
