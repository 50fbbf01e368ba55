"""Learned mapping rules: evidence, validation, promotion, drift, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import normalized_name

#: Gate of a promotion: independent cases, precision and recall.
POSITIVES, NEGATIVES, PRECISION, RECALL = 20, 20, 0.99, 0.95
#: Allowed changes of a rule's status; revoked is final.
TRANSITIONS = (("proposed", "validated"), ("validated", "active"), ("active", "stale"), ("stale", "validated"), ("proposed", "revoked"), ("validated", "revoked"), ("active", "revoked"), ("stale", "revoked"))


def evidence(cases: DataFrame, pattern: str, case: str, value: str, positive: Column) -> DataFrame:
    """Distinct positive and negative cases and distinct positive values of each pattern."""
    return cases.groupBy(pattern).agg(F.count_distinct(F.when(positive, F.col(case))).alias("positives"), F.count_distinct(F.when(~positive, F.col(case))).alias("negatives"), F.count_distinct(F.when(positive, F.col(value))).alias("n_values"))


def proposals(found: DataFrame) -> DataFrame:
    """Patterns with at least 3 positives over 2 values."""
    return found.where("positives >= 3 and n_values >= 2")


def confusion(cases: DataFrame, group: list[str]) -> DataFrame:
    """Counts and rates from ``(expected, predicted)`` targets, null meaning none; a wrong target is both fp and fn."""
    e, p = F.col("expected"), F.col("predicted")
    rows = cases.groupBy(*group).agg(
        F.count_if(e == p).alias("tp"), F.count_if(p.isNotNull() & ~e.eqNullSafe(p)).alias("fp"), F.count_if(e.isNotNull() & ~e.eqNullSafe(p)).alias("fn"),
        F.count_if(e.isNotNull()).alias("positives"), F.count_if(e.isNull()).alias("negatives"),
    )
    return rows.withColumn("precision", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6))


def promotable(matrix: DataFrame) -> DataFrame:
    """Adds ``promote``: enough cases of both kinds and both rates reached."""
    gate = (F.col("positives") >= POSITIVES) & (F.col("negatives") >= NEGATIVES) & (F.col("precision") >= PRECISION) & (F.col("recall") >= RECALL)
    return matrix.withColumn("promote", F.coalesce(gate, F.lit(False)))


def holdout(key: Column, per_mille: int) -> Column:
    """A deterministic split by a hash of the key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(1000)) < per_mille


def transitions(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Status changes ``(rule_id, to_status)`` with ``allowed``."""
    table = rules.sparkSession.createDataFrame(TRANSITIONS, "status string, to_status string")
    return changes.join(rules, "rule_id").join(F.broadcast(table.withColumn("allowed", F.lit(True))), ["status", "to_status"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def drifted(rules: DataFrame, schemas: DataFrame) -> DataFrame:
    """Active rules whose source's schema fingerprint changed."""
    return rules.where("status = 'active'").join(schemas.withColumnRenamed("fingerprint", "now"), "source").where("now <> fingerprint")


def materialised(active: DataFrame, authored: DataFrame, key: list[str]) -> DataFrame:
    """Guidance rows: authored mappings, and active rules where none is authored."""
    return authored.withColumn("origin", F.lit("authored")).unionByName(active.join(authored.select(*key), key, "left_anti").withColumn("origin", F.lit("rule")))


def mapping_conflicts(mappings: DataFrame, key: list[str], target: str) -> DataFrame:
    """Places with more than one mapping target."""
    return mappings.groupBy(*key).agg(F.count_distinct(target).alias("n_targets")).where("n_targets > 1")


def alias_proposals(names: DataFrame, name: str = "name") -> DataFrame:
    """``(alias, canonical)`` of names that normalise alike: the most frequent raw name is canonical, then the first."""
    counted = names.groupBy(F.col(name).alias("alias")).agg(F.count(F.lit(1)).alias("n")).withColumn("norm", normalized_name(F.col("alias"))).where("norm <> ''")
    best = counted.groupBy("norm").agg(F.min_by("alias", F.struct(-F.col("n"), "alias")).alias("canonical"))
    return counted.join(best, "norm").where("alias <> canonical").select("alias", "canonical")
