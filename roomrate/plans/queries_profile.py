"""Registered queries: profiling, frequencies, summaries, ordering."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from roomrate import constants as K
from roomrate.operators import profile as A
from roomrate.plans import calendar as C1
from roomrate.plans.common import CAL_CTE, calendar, listings, lst_cte, r, round_doubles, tables
from roomrate.plans.queries_jobs import _calendar_features_sql
from roomrate.plans.registry import register
from roomrate.session import written
from roomrate.sources.bindings import CALENDAR_ORDER

_LI_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("column_means", "SELECT " + ", ".join(r(f"avg({c})", c) for c in _LI_COLS) + " FROM lineitem")
def q_column_means(spark, sf_dir):
    """A4"""
    return round_doubles(A.column_means(tables(spark, sf_dir).lineitem, _LI_COLS))


@register("event_type_counts", "SELECT event_type, count(*) AS count FROM events WHERE event_type IS NOT NULL "
                               "GROUP BY event_type")
def q_freq(spark, sf_dir):
    """A6"""
    return A.frequencies(tables(spark, sf_dir).events, "event_type")


@register("quantity_counts_above", "SELECT l_quantity, count(*) AS count FROM lineitem WHERE l_quantity > 25 "
                                   "GROUP BY l_quantity")
def q_freq_filtered(spark, sf_dir):
    """A7"""
    return A.frequencies(tables(spark, sf_dir).lineitem, "l_quantity", F.col("l_quantity") > 25)


@register("low_price_count", f"SELECT count(*) FILTER (WHERE l_extendedprice / 200 < {K.PRICE_MIN}) AS count FROM lineitem")
def q_cond_count(spark, sf_dir):
    """A8"""
    return A.conditional_count(tables(spark, sf_dir).lineitem, F.col("l_extendedprice") / 200 < K.PRICE_MIN)


_LST_COLS = ("id", "description", "host_is_superhost", "latitude", "longitude", "room_type", "accommodates",
             "bathrooms", "bedrooms", "beds", "amenities", "neighbourhood", "review_scores_rating")


@register("listing_null_counts", f"WITH {lst_cte()} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM lst" for c in _LST_COLS))
def q_null_counts(spark, sf_dir):
    """A9"""
    return A.null_counts(listings(spark, sf_dir))


_DUCK_TO_SPARK = "CASE t WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' " \
                 "WHEN 'VARCHAR' THEN 'string' ELSE lower(t) END"


@register("listing_column_profile", f"WITH {lst_cte()} " + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column, count({c}) AS non_null, "
    f"(SELECT {_DUCK_TO_SPARK} FROM (SELECT typeof({c}) AS t FROM lst LIMIT 1)) AS dtype FROM lst"
    for i, c in enumerate(_LST_COLS)))
def q_column_profile(spark, sf_dir):
    """A11"""
    return A.column_profile(listings(spark, sf_dir))


def _describe_sql() -> str:
    parts = []
    for c in _LI_COLS:
        parts.append(
            f"SELECT '{c}' AS column, CAST(count({c}) AS DOUBLE) AS count, {r(f'avg({c})', 'mean')}, "
            f"{r(f'stddev_samp({c})', 'std')}, CAST(min({c}) AS DOUBLE) AS min, "
            f"{r(f'quantile_cont({c}, 0.25)', 'q25')}, {r(f'quantile_cont({c}, 0.5)', 'q50')}, "
            f"{r(f'quantile_cont({c}, 0.75)', 'q75')}, CAST(max({c}) AS DOUBLE) AS max FROM lineitem")
    return " UNION ALL ".join(parts)


@register("describe_lineitem", _describe_sql())
def q_describe(spark, sf_dir):
    """A10: count, mean, std, min, exact interpolated quartiles, max."""
    return round_doubles(A.describe(tables(spark, sf_dir).lineitem, _LI_COLS))


@register("describe_calendar", f"""
WITH {CAL_CTE},
d AS (SELECT listing_id, CAST(date AS DATE) AS date, minimum_nights, adjusted_price,
             row_number() OVER (PARTITION BY listing_id, CAST(date AS DATE) ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rn
      FROM cal WHERE listing_id IS DISTINCT FROM {K.EXCLUDED_LISTING_ID}),
k AS (SELECT CAST(minimum_nights AS DOUBLE) AS minimum_nights,
             CAST(replace(replace(adjusted_price, '$', ''), ',', '') AS DOUBLE) AS price FROM d WHERE rn = 1)
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count({c}) AS DOUBLE) AS count, {r(f'avg({c})', 'mean')}, "
    f"{r(f'stddev_samp({c})', 'std')}, min({c}) AS min, {r(f'quantile_cont({c}, 0.25)', 'q25')}, "
    f"{r(f'quantile_cont({c}, 0.5)', 'q50')}, {r(f'quantile_cont({c}, 0.75)', 'q75')}, max({c}) AS max FROM k"
    for c in ("minimum_nights", "price")))
def q_describe_calendar(spark, sf_dir):
    """A10 over the cleaned calendar (one row per listing-day)."""
    cal = C1.clean_calendar(calendar(spark, sf_dir), CALENDAR_ORDER)
    return round_doubles(A.describe(written(cal.select("minimum_nights", "price"), "described"), ["minimum_nights", "price"]))


@register("price_histogram", f"""
WITH x AS (SELECT l_extendedprice / 200 AS v FROM lineitem),
m AS (SELECT min(v) AS lo, max(v) AS hi FROM x),
b AS (SELECT least(CAST(floor((v - lo) / (hi - lo) * 10) AS INTEGER), 9) AS bin FROM x, m),
c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin)
SELECT CAST(g.bin AS INTEGER) AS bin, {r('lo + (hi - lo) * g.bin / 10', 'bin_start')},
       {r('lo + (hi - lo) * (g.bin + 1) / 10', 'bin_end')}, coalesce(c.count, 0) AS count
FROM range(10) g(bin) CROSS JOIN m LEFT JOIN c ON c.bin = g.bin
""")
def q_histogram(spark, sf_dir):
    """A12"""
    li = tables(spark, sf_dir).lineitem.select((F.col("l_extendedprice") / 200).alias("v"))
    return round_doubles(A.histogram(li, "v", 10))


@register("min_nights_box", f"""
WITH c AS ({_calendar_features_sql(K.PERIODS_PRODUCTION)}),
q AS (SELECT quantile_cont(min_nights_year_avg, 0.25) AS q1, quantile_cont(min_nights_year_avg, 0.5) AS med,
             quantile_cont(min_nights_year_avg, 0.75) AS q3 FROM c)
SELECT {r('q1')}, {r('med', 'median')}, {r('q3')}, {r('q3 - q1', 'iqr')},
  {r('min(CASE WHEN x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN x END)', 'whisker_low')},
  {r('max(CASE WHEN x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN x END)', 'whisker_high')},
  count(*) FILTER (WHERE NOT (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS outliers
FROM (SELECT min_nights_year_avg AS x FROM c), q GROUP BY q1, med, q3
""")
def q_box(spark, sf_dir):
    """A13 over the calendar features."""
    feats = round_doubles(C1.calendar_features(calendar(spark, sf_dir), CALENDAR_ORDER))
    return round_doubles(A.box_stats(written(feats.select("min_nights_year_avg"), "boxed"), "min_nights_year_avg"))


_CORR_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@register("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r(f'corr({a}, {b})', 'r')} FROM lineitem"
    for a, b in combinations(_CORR_COLS, 2)))
def q_corr(spark, sf_dir):
    """A14"""
    return round_doubles(A.correlation_matrix(tables(spark, sf_dir).lineitem, _CORR_COLS))


_SERIES_IDS = (3, 71, 149, 777, 1500)


@register("listing_price_series", f"""
WITH {CAL_CTE}
SELECT listing_id, CAST(date AS DATE) AS date, adjusted_price FROM cal WHERE listing_id IN {_SERIES_IDS}
""")
def q_series(spark, sf_dir):
    """O1"""
    cal = calendar(spark, sf_dir).withColumn("date", F.to_date("date"))
    return A.ordered_series(cal, "listing_id", _SERIES_IDS, "date", ["adjusted_price"])


_ERR = "abs(l_extendedprice * (1 - l_discount) - l_extendedprice)"


@register("worst_best_errors", f"""
(SELECT 'worst' AS kind, l_orderkey * 10 + l_linenumber AS row_key, {r(_ERR, 'abs_error')} FROM lineitem
 ORDER BY {_ERR} DESC, row_key LIMIT 1000)
UNION ALL
(SELECT 'best' AS kind, l_orderkey * 10 + l_linenumber AS row_key, {r(_ERR, 'abs_error')} FROM lineitem
 ORDER BY {_ERR} ASC, row_key LIMIT 1000)
""")
def q_worst_best(spark, sf_dir):
    """O2: worst / best 1000 rows by absolute error (a stand-in prediction), deterministic ties."""
    li = tables(spark, sf_dir).lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_key"),
        F.abs(F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("l_extendedprice")).alias("abs_error"))
    worst = A.top_n(li, "abs_error", 1000, "row_key", descending=True).withColumn("kind", F.lit("worst"))
    best = A.top_n(li, "abs_error", 1000, "row_key", descending=False).withColumn("kind", F.lit("best"))
    return round_doubles(worst.unionByName(best).select("kind", "row_key", "abs_error"))


@register("part_head", "SELECT * FROM part ORDER BY p_partkey LIMIT 5")
def q_head(spark, sf_dir):
    """O3"""
    return A.head(tables(spark, sf_dir).part, "p_partkey", 5)
