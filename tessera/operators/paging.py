"""Pages with total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows from ``offset`` with ``truncated``: whether a row follows.  One top-k of offset + limit + 1 rows."""
    cut = df.orderBy(*order).limit(offset + limit + 1)
    w = W.orderBy(*order)
    rows = cut.withColumn("__r", F.row_number().over(w))
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("truncated", F.max("__r").over(whole) > offset + limit)
    return rows.where((F.col("__r") > offset) & (F.col("__r") <= offset + limit)).drop("__r")


def after(keys: list[str], values: list) -> Column:
    """Rows after a key tuple, in the order of ``keys``; the predicate reaches the scan."""
    out = F.lit(False)
    for i in range(len(keys)):
        step = F.col(keys[i]) > F.lit(values[i])
        for k, v in zip(keys[:i], values[:i], strict=True):
            step = (F.col(k) == F.lit(v)) & step
        out = out | step
    return out


def top_per(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group, with ``rank`` and ``truncated``; Spark limits groups before the shuffle."""
    w = W.partitionBy(*group).orderBy(*order)
    rows = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)
    return rows.withColumn("truncated", F.max("rank").over(W.partitionBy(*group)) > k).where(F.col("rank") <= k)
