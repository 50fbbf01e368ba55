"""Vocabularies and endpoint signatures of relationships, and published communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import normalized_name


def canonical(names: DataFrame, aliases: DataFrame, vocabulary: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``canonical``: the alias's target or the vocabulary's spelling of the normalised name, null if neither knows it.

    ``aliases (alias, target)`` and ``vocabulary (term)`` are profile tables, small by nature and joined by normal form.
    """
    rows = names.withColumn("norm", normalized_name(F.col(name)))
    a = aliases.select(normalized_name(F.col("alias")).alias("norm"), normalized_name(F.col("target")).alias("via")).distinct()
    v = vocabulary.select(normalized_name(F.col("term")).alias("final"), F.col("term").alias("canonical")).distinct()
    return rows.join(a, "norm", "left").withColumn("final", F.coalesce("via", "norm")).join(v, "final", "left").drop("norm", "via", "final")


def permitted(edges: DataFrame, signatures: DataFrame) -> DataFrame:
    """Edges ``(source_type, target_type, name)`` that a signature allows; ``*`` stands for any type."""
    s = signatures.select(F.col("source_type").alias("s"), F.col("target_type").alias("t"), "name").distinct()
    either = lambda c: F.explode(F.array(F.col(c), F.lit("*")))
    asked = edges.select("source_type", "target_type", "name").distinct()
    asked = asked.withColumn("s", either("source_type")).withColumn("t", either("target_type"))
    allowed = asked.join(s, ["s", "t", "name"], "left_semi").select("source_type", "target_type", "name").distinct()
    return edges.join(allowed, ["source_type", "target_type", "name"], "left_semi")


def common_signatures(a: DataFrame, b: DataFrame) -> DataFrame:
    """Signatures allowed by both tables: equal ones, and the narrower of a wildcard and a type."""
    x, y = (d.select(*(F.col(c).alias(p + c) for c in ("source_type", "target_type", "name"))) for d, p in ((a, "a_"), (b, "b_")))
    met = x.join(y, x.a_name == y.b_name)
    same = lambda c: (F.col("a_" + c) == F.col("b_" + c)) | (F.col("a_" + c) == "*") | (F.col("b_" + c) == "*")
    pick = lambda c: F.when(F.col("a_" + c) == "*", F.col("b_" + c)).otherwise(F.col("a_" + c)).alias(c)
    return met.where(same("source_type") & same("target_type")).select(pick("source_type"), pick("target_type"), F.col("a_name").alias("name")).distinct()


def published(communities: DataFrame, states: DataFrame) -> DataFrame:
    """Communities of each scope's active generation only."""
    return communities.join(states.select("scope", F.col("active_generation").alias("generation")), ["scope", "generation"], "left_semi")


def community_members(members: DataFrame, communities: DataFrame, states: DataFrame) -> DataFrame:
    """Members of published communities."""
    return members.join(published(communities, states).select("community_id"), "community_id", "left_semi")
