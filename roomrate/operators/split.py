"""Deterministic splits.

The source splits with a seeded shuffle tied to numpy's generator, which no
distributed engine can reproduce; `randomSplit` depends on partitioning. We
split by a hash of the row key instead: stable across runs, partitionings and
executor loss.

* M1: test if the first hex digit of md5(key) < '4' (about 25 %).
* M2: exact per-label shares. Rows are ordered by (h, key) with h the first
  13 hex digits of md5(key) (52 bits, exact in a double); each label's cut
  points are order statistics found by distributed selection, then every
  row is assigned by comparison. No window over a whole label (a label may
  hold a third of all rows).
* M16: fold = h mod k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomrate.operators.profile import order_statistics
from roomrate.session import written


def key_hash52(key) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 13), 16, 10).cast("bigint")


def hash_split(df: DataFrame, key: str, out: str = "is_test") -> DataFrame:
    """25 % test by md5 prefix. (M1)"""
    return df.withColumn(out, F.substring(F.md5(F.col(key).cast("string")), 1, 1) < F.lit("4"))


def kfold(df: DataFrame, key: str, k: int = 5, out: str = "fold") -> DataFrame:
    """(M16)"""
    return df.withColumn(out, F.pmod(key_hash52(key), F.lit(k)).cast("int"))


def stratified_split(df: DataFrame, key: str, label: str, shares=(0.6, 0.2, 0.2), out: str = "part") -> DataFrame:
    """part in {'train', 'val', 'test'} with exact per-label sizes; NULL for a row without a label. (M2)

    Rows of a label are ordered by (hash of the key, key). The cut ranks are order statistics of the hash over
    (label, hash, count); keys that share a cut's hash (collisions, repeated keys) are ordered among themselves
    only. Labels may be many: cut points are a table that is joined, and nothing is collected. Cut points and ties are
    written, so that Spark knows their size: few of them need no shuffle of the rows, which would put a label in one task."""
    h = key_hash52(key).cast("double")
    rows = df.withColumns({"_label": F.col(label).cast("string"), "_h": h})
    counts = written(rows.where(F.col("_label").isNotNull()).groupBy(F.col("_label").alias("column"), F.col("_h").alias("value"))
                     .agg(F.count(F.lit(1)).alias("n")), "split-counts")
    total = counts.groupBy("column").agg(F.sum("n").alias("total"))
    holdout = F.ceil(F.round((1 - shares[0]) * F.col("total"), 10))
    test = F.ceil(F.round(shares[2] / (1 - shares[0]) * holdout, 10))
    cuts = total.select("column", "total", (F.col("total") - holdout).alias("a"), (F.col("total") - test).alias("b"))
    ranks = cuts.select("column", F.col("a").alias("rank"), "total").union(cuts.select("column", F.col("b").alias("rank"), "total"))
    at = written(order_statistics(counts, ranks.where(F.col("rank") < F.col("total")).select("column", "rank")), "split-cuts")

    # ranks of the few keys that share a hash with a cut point
    ties = (rows.join(at.select(F.col("column").alias("_label"), F.col("value").alias("_h"), "below").distinct(), ["_label", "_h"])
            .groupBy("_label", "_h", "below", F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")))
    order = Window.partitionBy("_label", "_h").orderBy("_key")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ties = written(ties.select("_label", "_h", "_key", (F.col("below") + before).alias("_tied")), "split-ties")

    point = lambda name: at.select(F.col("column").alias("_c"), F.col("rank").alias(name), F.col("value").alias(f"{name}_h"))
    table = written(cuts.withColumnRenamed("column", "_c").join(point("a"), ["_c", "a"], "left").join(point("b"), ["_c", "b"], "left")
                    .select("_c", "a", "b", "a_h", "b_h"), "split-table")
    joined = (rows.join(table, F.col("_label") == F.col("_c"), "left").alias("r")
              .join(ties.alias("t"), (F.col("r._label") == F.col("t._label")) & (F.col("r._h") == F.col("t._h"))
                    & (F.col(f"r.{key}") == F.col("t._key")), "left"))

    def before_cut(cut: str) -> Column:  # a cut after the last row has no hash: every row is before it
        return F.when(F.col(f"{cut}_h").isNull() | (F.col("r._h") < F.col(f"{cut}_h")), F.lit(True)).when(
            F.col("r._h") > F.col(f"{cut}_h"), F.lit(False)).otherwise(F.col("_tied") < F.col(cut))

    part = (F.when(F.col("r._label").isNull(), F.lit(None).cast("string")).when(before_cut("a"), F.lit("train"))
            .when(before_cut("b"), F.lit("val")).otherwise(F.lit("test")))
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], part.alias(out))
