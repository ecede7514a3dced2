"""Key joins.

Strategy is left to Catalyst + AQE: a side is broadcast only when its
runtime size is below `spark.sql.adaptive.autoBroadcastJoinThreshold`
(a size-checked broadcast); otherwise the join is sort-merge with AQE
skew splitting. No unconditional broadcast hints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def semi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Rows of `left` whose key occurs in `right` (left-semi)."""
    right_key = right_key or left_key
    r = right.select(F.col(right_key).alias("_k"))
    return left.join(r, left[left_key] == r["_k"], "left_semi")


def inner_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Equi-join of a column to another frame's key; the right key is not repeated."""
    if left_key == right_key:
        return left.join(right, on=left_key, how="inner")
    return left.join(right, left[left_key] == right[right_key], "inner").drop(right[right_key])


def exists_flag(left: DataFrame, right: DataFrame, left_key: str, right_key: str, flag: str = "has_match") -> DataFrame:
    """left + boolean: does the key exist in `right`? Distinct right keys are
    map-side de-duplicated before the shuffle. (J3)"""
    r = right.select(F.col(right_key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    j = left.join(r, left[left_key] == r["_k"], "left")
    return j.withColumn(flag, F.coalesce(F.col("_hit"), F.lit(False))).drop("_k", "_hit")


def flag_tally(df: DataFrame, flag: str) -> DataFrame:
    """value_counts of a boolean flag."""
    return df.groupBy(flag).agg(F.count(F.lit(1)).alias("count"))


def attach(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Index-aligned column attach = left join on the group key."""
    return left.join(right, on=key, how="left")


def attach_predictions(source: DataFrame, predictions: DataFrame, key: str, cols) -> DataFrame:
    """Attach model outputs to their source rows by carrying the row key (no re-split)."""
    return source.join(predictions.select(key, *cols), on=key, how="inner")
