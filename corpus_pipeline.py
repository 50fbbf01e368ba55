"""The corpus pipeline: quality filter, near-dedup, substring dedup, decontamination, tokens.

Each stage takes the documents its predecessor kept (written and read again in between) and its decisions take effect:
rows go, or their texts lose passages.  All but the last return the columns of ``documents``; the last returns a row of
token counts and digests for every document left.  Rows whose doc_id is null pass the near-dedup and decontamination
stages: nothing can name them as a copy or a leak.  Helper columns take names that the documents do not have.

Near copies are documents whose fingerprints over three-word shingles differ in at most 3 of 64 bits, as the operator's
contract says.  That links copies of almost the same text; of documents that share 80 % of their five-word shingles it links
about one pair in seven (README), and what those have in common goes in the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, passages, quality, simhash
from tessera.llm.words import bounded_batches, spare
from tessera.storage import materialise, table

#: The stages need Python models and walks that SQL cannot express.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list:
    return [docs[f"`{c}`"] for c in docs.columns]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose doc_id is not in ``gone`` ``(doc_id)``."""
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti").select(*_columns(docs))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is fitted on the labelled ones among them."""
    bounded_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = spare(docs.columns, "score")
    return quality.score(docs, model, docs.columns, out=out).where(F.col(out) >= quality.THRESHOLD).drop(out)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest id (rows that repeat an id are one document)."""
    bounded_batches(spark)
    found = simhash.classes(docs.where("doc_id is not null").select("doc_id", "text"))
    return _without(docs, found.where("doc_id <> component_id").select("doc_id").distinct())


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; a document of which nothing is left goes, n_chars follows."""
    bounded_batches(spark)
    before = spare(docs.columns, "before")
    cleaned = passages.clean(docs.withColumn(before, F.length("text")))
    kept = cleaned.where((F.coalesce(before, F.lit(0)) == 0) | (F.length(F.trim("text")) > 0))
    changed = F.length("text") != F.col(before)
    kept = kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*(kept[f"`{c}`"] for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    bounded_batches(spark)
    found = decontaminate.matches(docs.where("doc_id is not null").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return _without(docs, materialise(found.select("doc_id").distinct(), "leaks"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    bounded_batches(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", cut_passages),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "_"))
    return docs
