"""Model metrics and univariate feature scoring (M9, M10, M11), as SQL aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomrate.functions.scalar import safe_corr

LOG_EPS = 1e-7


def regression_metrics(df: DataFrame, label: str = "label", pred: str = "prediction", by=()) -> DataFrame:
    """R^2 = 1 - SSE / SST (SST from a stable population variance) and MAE, per group. (M9)"""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(
        F.count(F.lit(1)).alias("n"),
        (F.lit(1.0) - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))).alias("r2"),
        F.avg(F.abs(y - p)).alias("mae"),
    )


def classification_metrics(df: DataFrame, label: str, pred: str, prob_of_label: str | None = None, by=()) -> DataFrame:
    """Accuracy and (if the probability of the true class is given) clipped log-loss."""
    g = df.groupBy(*by) if by else df.groupBy()
    aggs = [F.count(F.lit(1)).alias("n"),
            F.avg(F.when(F.col(pred) == F.col(label), 1.0).otherwise(0.0)).alias("accuracy")]
    if prob_of_label:
        pr = F.least(F.greatest(F.col(prob_of_label).cast("double"), F.lit(LOG_EPS)), F.lit(1 - LOG_EPS))
        aggs.append((-F.avg(F.ln(pr))).alias("log_loss"))
    return g.agg(*aggs)


def f_regression_scores(df: DataFrame, features, label: str) -> DataFrame:
    """(feature, r, f_score, n) with F = r^2 / (1 - r^2) * (n - 2), one aggregate."""
    feats = list(features)
    y = F.col(label).cast("double")
    aggs = []
    for i, f in enumerate(feats):
        x = F.col(f).cast("double")
        aggs += [safe_corr(x, y).alias(f"r{i}"), F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias(f"n{i}")]
    wide = df.agg(*aggs)
    stacked = wide.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
        for i, f in enumerate(feats)])).alias("s")).select("s.*")
    r = F.col("r")
    return stacked.withColumn("f_score", F.try_divide(r * r, F.lit(1.0) - r * r) * (F.col("n") - 2))


def top_k_features(scores: DataFrame, k: int) -> DataFrame:
    """Best k by F score (ties by name)."""
    return scores.orderBy(F.desc_nulls_last("f_score"), F.asc("feature")).limit(k)
