"""Profiling, frequencies, summaries, ordering.

All summaries are distributed aggregates; only bounded results reach the
driver (one row per column, per bin, per quantile). Exact quartiles use a
selection scheme instead of Spark's `percentile` (whose final buffer holds
every distinct value in one task):

  1. a mergeable quantile sketch (KLL) of each column bounds every wanted rank by
     two values; one more pass counts what lies below each bracket and, inside the brackets
     only, aggregates to (column, value, count). So the shuffle holds a few
     thousandths of the distinct values, and a value that a third of all rows hold is one row.
     The counts prove a bracket right; a column whose bracket misses takes all its values;
  2. each wanted rank keeps a bracket of values. A round cuts every bracket
     into SELECT_BINS equal bins and sums the counts of each; a running sum
     over the bins of a bracket (never over rows or values) finds the bin that
     holds the rank, and the least and greatest value in it are the next bracket;
  3. a bracket of one value is the answer. Brackets of a column are equal or
     disjoint, so a value is in one at most: rows are never multiplied.
Interpolation matches pandas/numpy 'linear'.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SELECT_BINS = 1024  # bins of a bracket per selection round
SKETCH_SIZE, SKETCH_MARGIN = 4096, 0.004  # a KLL sketch of this size is off by about a thousandth of the ranks
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def unpivot_values(df: DataFrame, columns, name: str = "column", value: str = "value") -> DataFrame:
    """(column, value as double) for the given columns; NULL values dropped."""
    cols = list(columns)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, name, value)
    return long.where(F.col(value).isNotNull())


# ---------------------------------------------------------------------------
# A4 / A5 means and default profile
# ---------------------------------------------------------------------------
def column_means(df: DataFrame, columns=None) -> DataFrame:
    """One row: mean of each numeric column (NULLs skipped). (A4)"""
    cols = list(columns) if columns is not None else numeric_columns(df)
    return df.agg(*[F.avg(F.col(c)).alias(c) for c in cols])


def default_profile(df: DataFrame, exclude, unrounded, columns=None) -> DataFrame:
    """Means without the excluded columns, half-even rounded except `unrounded`. (A5)"""
    cols = [c for c in (columns if columns is not None else numeric_columns(df)) if c not in set(exclude)]
    exprs = []
    for c in cols:
        m = F.avg(F.col(c))
        exprs.append((m if c in unrounded else F.bround(m, 0)).alias(c))
    return df.agg(*exprs)


# ---------------------------------------------------------------------------
# A6-A9, A11 counts
# ---------------------------------------------------------------------------
def frequencies(df: DataFrame, column: str, where=None) -> DataFrame:
    """value_counts: non-NULL values with counts, most frequent first (ties by value)."""
    src = df.where(where) if where is not None else df
    return (src.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.col(column)))


def conditional_count(df: DataFrame, predicate, alias: str = "count") -> DataFrame:
    """(A8)"""
    return df.agg(F.count_if(predicate).alias(alias))


def null_counts(df: DataFrame, columns=None) -> DataFrame:
    """(column, null_count) for every column, one pass."""
    cols = list(columns) if columns is not None else df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "null_count")


def column_profile(df: DataFrame) -> DataFrame:
    """(position, column, non_null, dtype) like DataFrame.info(); one aggregate."""
    cols = df.columns
    wide = df.agg(*[F.count(F.col(c)).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column", "non_null")
    meta = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, dtype string")
    return meta.join(long, on="column", how="inner").select("position", "column", "non_null", "dtype")


# ---------------------------------------------------------------------------
# A10, A13 exact quantiles, describe, box statistics
# ---------------------------------------------------------------------------
def value_counts(df: DataFrame, columns) -> DataFrame:
    """(column, value, n) of the non-NULL values of the columns, written once: every round of a selection
    reads it, and an expensive input (e.g. a de-duplicated calendar) is computed once."""
    from roomrate.session import written

    return written(unpivot_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "value-counts")


def order_statistics(counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """(column, rank, value, below) for the 0-based ranks (column, rank) over counts (column, value, n); `below`
    rows of the column have a smaller value."""
    from roomrate.session import written

    spread = counts.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    pending = ranks.distinct().join(spread, "column").withColumn("below", F.lit(0).cast("bigint"))
    answers = None
    while True:
        pending = written(pending.select("column", "rank", "lo", "hi", "below"), "brackets")
        found = pending.where(F.col("lo") == F.col("hi")).select("column", "rank", F.col("lo").alias("value"), "below")
        answers = found if answers is None else answers.unionByName(found)
        open_ = pending.where(F.col("lo") < F.col("hi"))
        if open_.isEmpty():
            return answers
        brackets = open_.select("column", "lo", "hi", "below").distinct()
        share = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        bins = (counts.join(brackets, "column").where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
                .withColumn("bin", F.least(F.floor(share * SELECT_BINS), F.lit(SELECT_BINS - 1)))
                .groupBy("column", "lo", "below", "bin")
                .agg(F.sum("n").alias("inside"), F.min("value").alias("first"), F.max("value").alias("last")))
        before = Window.partitionBy("column", "lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("start", F.col("below") + F.coalesce(F.sum("inside").over(before), F.lit(0))).drop("below")
        pending = (open_.select("column", "rank", "lo").join(bins, ["column", "lo"])
                   .where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("inside")))
                   .select("column", "rank", F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("start").alias("below")))


def exact_quantiles(df: DataFrame, columns, probs, margin: float = SKETCH_MARGIN) -> DataFrame:
    """(column, p, quantile) with linear interpolation between order statistics. df is read twice (a scan of the columns;
    callers write an expensive input first). `margin` widens the sketch's brackets on either side."""
    from roomrate.session import written

    probs = sorted(float(p) for p in probs)
    long = unpivot_values(df, columns)
    sketch = F.col("sketch")
    cuts = [e for p in probs for e in (p - margin, p + margin)]
    ends = written(long.groupBy("column").agg(F.kll_sketch_agg_double("value", F.lit(SKETCH_SIZE)).alias("sketch"), F.count("*").alias("total"),
                                              F.min("value").alias("least"), F.max("value").alias("most"))
                   .select("column", "total", F.array(*[F.col("least") if c <= 0 else F.col("most") if c >= 1 else F.kll_sketch_get_quantile_double(sketch, F.lit(c))
                                                        for c in cuts]).alias("cuts")), "rank-brackets")
    x = F.col("value")
    low, high = [F.col("cuts")[2 * i] for i in range(len(probs))], [F.col("cuts")[2 * i + 1] for i in range(len(probs))]
    inside = reduce(lambda a, b: a | b, [x.between(a, b) for a, b in zip(low, high, strict=True)])
    # values inside a bracket one by one; those outside by the number of brackets that begin below them
    counts = written(long.join(ends, "column").groupBy("column", F.when(inside, x).alias("value"),
                                                       F.when(~inside, sum((x > a).cast("int") for a in low)).alias("outside"))
                     .agg(F.count("*").alias("n")), "bracket-counts")
    which = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), a.alias("lo"), b.alias("hi"))
                                for i, (p, a, b) in enumerate(zip(probs, low, high, strict=True))])).alias("w")
    wanted = (ends.select("column", "total", which).select("column", "total", "w.*")
              .withColumn("at", (F.col("total") - 1) * F.col("p")).withColumn("rank", F.floor("at"))
              .withColumn("next", F.least(F.col("rank") + 1, F.col("total") - 1)))
    met = counts.join(wanted, "column")
    below = F.coalesce(x < F.col("lo"), F.col("outside") <= F.col("i"))
    told = written(met.groupBy(*wanted.columns).agg(F.coalesce(F.sum(F.when(below, F.col("n"))), F.lit(0)).alias("below"),
                                                    F.coalesce(F.sum(F.when(x.between(F.col("lo"), F.col("hi")), F.col("n"))), F.lit(0)).alias("inside")), "bracket-ranks")
    held = told.withColumn("held", (F.col("below") <= F.col("rank")) & (F.col("next") < F.col("below") + F.col("inside")))
    key = F.concat_ws("|", F.col("i"), F.col("column")).alias("column")
    found = order_statistics(
        met.where(x.between(F.col("lo"), F.col("hi"))).select(key, "value", "n"),
        held.where("held").select(key, F.explode(F.array(F.col("rank") - F.col("below"), F.col("next") - F.col("below"))).alias("rank")))
    found = found.select("column", "rank", "value")
    upper = found.select("column", F.col("rank").alias("next"), F.col("value").alias("upper"))
    part = F.col("at") - F.col("first")
    out = (held.where("held").select(F.col("column").alias("name"), "p", "at", F.col("rank").alias("first"), key,
                                     (F.col("rank") - F.col("below")).alias("rank"), (F.col("next") - F.col("below")).alias("next"))
           .join(found, ["column", "rank"]).join(upper, ["column", "next"])
           .select(F.col("name").alias("column"), "p", F.when(part > 0, F.col("value") + part * (F.col("upper") - F.col("value")))
                   .otherwise(F.col("value")).alias("quantile")))
    missed = [r["column"] for r in held.where("not held").select("column").distinct().collect()]  # names of df's columns
    if missed:
        out = out.where(~F.col("column").isin(missed)).union(_quantiles(value_counts(df, missed), probs))
    return out


def _quantiles(counts: DataFrame, probs) -> DataFrame:
    p = F.explode(F.array(*[F.lit(float(x)) for x in probs])).alias("p")
    wanted = (counts.groupBy("column").agg(F.sum("n").alias("total")).select("column", "total", p)
              .withColumn("at", (F.col("total") - 1) * F.col("p")).withColumn("rank", F.floor("at"))
              .withColumn("next", F.least(F.col("rank") + 1, F.col("total") - 1)).withColumn("part", F.col("at") - F.col("rank")))
    ranks = wanted.select("column", "rank").union(wanted.select("column", F.col("next").alias("rank")))
    values = order_statistics(counts, ranks).select("column", "rank", "value")
    upper = values.select("column", F.col("rank").alias("next"), F.col("value").alias("upper"))
    return (wanted.join(values, ["column", "rank"]).join(upper, ["column", "next"])
            .select("column", "p", F.when(F.col("part") > 0, F.col("value") + F.col("part") * (F.col("upper") - F.col("value")))
                    .otherwise(F.col("value")).alias("quantile")))


def describe(df: DataFrame, columns=None) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) — pandas describe(), exact quartiles. (A10)"""
    cols = list(columns) if columns is not None else numeric_columns(df)
    x = F.col("value")
    stats = unpivot_values(df, cols).groupBy("column").agg(
        F.count(x).cast("double").alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    qw = (q.groupBy("column").pivot("p", [0.25, 0.5, 0.75]).agg(F.first("quantile"))
          .withColumnsRenamed({"0.25": "q25", "0.5": "q50", "0.75": "q75"}))
    return stats.join(qw, on="column", how="left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def box_stats(df: DataFrame, column: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, 1.5*IQR whiskers (most extreme values inside the fences), outlier count."""
    rows = unpivot_values(df, [column])
    q = {r["p"]: r["quantile"] for r in exact_quantiles(df, [column], [0.25, 0.5, 0.75]).collect()}
    q1, med, q3 = q.get(0.25), q.get(0.5), q.get(0.75)
    iqr = q3 - q1 if q else None
    inside = F.col("value").between(q1 - whisker * iqr, q3 + whisker * iqr) if q else F.lit(False)
    return rows.agg(
        *[F.lit(v).cast("double").alias(k) for k, v in (("q1", q1), ("median", med), ("q3", q3), ("iqr", iqr))],
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"), F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


# ---------------------------------------------------------------------------
# A12 histogram, A14 correlation
# ---------------------------------------------------------------------------
def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin closed), zero bins included.
    A constant column uses [v - 0.5, v + 0.5] like numpy."""
    x = F.col(column).cast("double")
    src = df.where(x.isNotNull())
    lo = src.select(F.min(x)).scalar()
    hi = src.select(F.max(x)).scalar()
    lo2 = F.when(lo == hi, lo - 0.5).otherwise(lo)
    hi2 = F.when(lo == hi, hi + 0.5).otherwise(hi)
    b = F.least(F.floor((x - lo2) / (hi2 - lo2) * bins).cast("int"), F.lit(bins - 1))
    counts = src.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    edges = src.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edges = edges.select("bin", (lo2 + (hi2 - lo2) * F.col("bin") / bins).alias("bin_start"),
                         (lo2 + (hi2 - lo2) * (F.col("bin") + 1) / bins).alias("bin_end"))
    return (edges.join(counts, on="bin", how="left")
            .select("bin", "bin_start", "bin_end", F.coalesce(F.col("count"), F.lit(0)).alias("count")))


def correlation_matrix(df: DataFrame, columns) -> DataFrame:
    """Pairwise-complete Pearson r for every pair (a < b by position); NULL where a side is constant.

    Every task sums the products of its rows, centred at the columns' means, in Gram matrices (values and presence, four
    matrix products a batch); the sums of the pairs are added up in a grouped aggregate. So tables of hundreds of columns
    take one pass and no expression per pair; a task holds 32 bytes a pair of columns."""
    cols = list(columns)
    means = np.array([0.0 if m is None else m for m in df.agg(*[F.avg(F.col(c).cast("double")) for c in cols]).first()])

    def run(batches):
        sums = np.zeros((4, len(cols), len(cols)))
        for batch in batches:
            x = np.column_stack([np.asarray(c.fill_null(np.nan).to_numpy(zero_copy_only=False), float) for c in batch.columns]) - means
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            sums += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        a, b = np.triu_indices(len(cols), 1)
        n, sx, sxx, sxy = sums
        parts = [a.astype(np.int32), b.astype(np.int32), n[a, b], sx[a, b], sx[b, a], sxx[a, b], sxx[b, a], sxy[a, b]]
        yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names=["a", "b", *_GRAM])

    data = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    g = (data.mapInArrow(run, "a int, b int, " + ", ".join(f"{c} double" for c in _GRAM))
         .groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in _GRAM]))
    table = F.array(*[F.lit(float(m)) for m in means])

    def spread(square, plain, at):
        within = F.col("n") * F.col(square) - F.col(plain) * F.col(plain)
        rounding = F.greatest(F.lit(1e-13) * F.col("n") * F.col(square), F.pow(F.lit(1e-13) * F.col("n") * F.get(table, F.col(at)), F.lit(2.0)))
        return F.when(within > rounding, within)

    r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(spread("sxx", "sx", "a")) * F.sqrt(spread("syy", "sy", "b")))
    names = F.array(*[F.lit(c) for c in cols])
    return g.select(F.get(names, F.col("a")).alias("col_a"), F.get(names, F.col("b")).alias("col_b"), r.alias("r"))


_GRAM = ("n", "sx", "sy", "sxx", "syy", "sxy")


# ---------------------------------------------------------------------------
# O1-O3 ordering
# ---------------------------------------------------------------------------
def ordered_series(df: DataFrame, key: str, ids, order: str, cols) -> DataFrame:
    """Rows of selected keys, sorted by key then order column. (O1)"""
    return df.where(F.col(key).isin(list(ids))).select(key, order, *cols).orderBy(key, order)


def top_n(df: DataFrame, by: str, n: int, tie_key: str, descending: bool = True) -> DataFrame:
    """Largest (or smallest) n by a column with a deterministic tie-break; planned as a
    TakeOrderedAndProject (per-task top-n, then merge). (O2)"""
    o = F.desc(by) if descending else F.asc(by)
    return df.orderBy(o, F.asc(tie_key)).limit(n)


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First n rows in key order. (O3)"""
    return df.orderBy(key).limit(n)
