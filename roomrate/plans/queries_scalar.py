"""Registered queries: projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomrate import constants as K
from roomrate.functions import scalar as S
from roomrate.functions.text import amenity_token_set, join_tokens, normalise_amenity_text
from roomrate.operators import filters as P
from roomrate.operators.encode import min_max_scale
from roomrate.operators.periods import period_column
from roomrate.plans.common import listings, lst_cte, r, round_doubles, tables
from roomrate.plans.queries_jobs import _calendar_features_sql
from roomrate.plans.registry import register
from roomrate.streaming.scoring import text_bin
from roomrate.plans.sqltext import amenity_norm_sql, amenity_rename_sql, q
from roomrate.plans import calendar as C1
from roomrate.plans.common import calendar
from roomrate.sources.bindings import CALENDAR_ORDER, inject_null

# ---------------------------------------------------------------------------
# P1-P11
# ---------------------------------------------------------------------------
_DROPPED = ("l_tax", "l_returnflag", "l_linestatus")


@register("drop_columns", f"SELECT * EXCLUDE ({', '.join(_DROPPED)}) FROM lineitem")
def q_drop_columns(spark, sf_dir):
    return P.drop_columns(tables(spark, sf_dir).lineitem, _DROPPED, strict=True)


@register("rename_columns", "SELECT p_partkey AS id, p_name, p_brand AS neighbourhood, p_type AS room_type, "
                            "p_size, p_retailprice FROM part")
def q_rename(spark, sf_dir):
    return P.rename_columns(tables(spark, sf_dir).part, {"p_partkey": "id", "p_brand": "neighbourhood",
                                                         "p_type": "room_type"})


@register("room_type_in_set", f"""
WITH {lst_cte()} SELECT id, room_type FROM lst WHERE room_type IN ({', '.join(q(x) for x in K.KEPT_ROOM_TYPES)})
""")
def q_in_set(spark, sf_dir):
    return P.in_set(listings(spark, sf_dir), "room_type", K.KEPT_ROOM_TYPES).select("id", "room_type")


@register("listing_caps", f"""
WITH {lst_cte()} SELECT id, bathrooms, bedrooms, beds FROM lst
WHERE bedrooms <= {K.LISTING_CAPS['bedrooms']} AND beds <= {K.LISTING_CAPS['beds']} AND bathrooms <= {K.LISTING_CAPS['bathrooms']}
""")
def q_caps(spark, sf_dir):
    return P.within_caps(listings(spark, sf_dir), K.LISTING_CAPS).select("id", "bathrooms", "bedrooms", "beds")


@register("description_not_null", f"WITH {lst_cte()} SELECT id, description FROM lst WHERE description IS NOT NULL")
def q_not_null(spark, sf_dir):
    return P.not_null(listings(spark, sf_dir), "description").select("id", "description")


@register("exclude_listing", """
SELECT l_orderkey, l_linenumber, pk FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_partkey END AS pk FROM lineitem)
WHERE pk IS DISTINCT FROM 1
""")
def q_exclude_key(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    df = li.select("l_orderkey", "l_linenumber",
                   inject_null(F.col("l_partkey"), F.col("l_orderkey"), 0).alias("pk"))
    return P.exclude_key(df, "pk", 1)


@register("columns_differ", """
SELECT l_orderkey, l_linenumber, l_discount, tax FROM (
  SELECT l_orderkey, l_linenumber, l_discount, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_tax END AS tax FROM lineitem)
WHERE l_discount IS DISTINCT FROM tax OR (l_discount IS NULL AND tax IS NULL)
""")
def q_columns_differ(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    df = li.select("l_orderkey", "l_linenumber", "l_discount",
                   inject_null(F.col("l_tax"), F.col("l_orderkey"), 0).alias("tax"))
    return P.columns_differ(df, "l_discount", "tax")


_LOOKUP_LAT, _LOOKUP_LON = 40.7035, -73.8965


@register("point_lookup", f"""
WITH {lst_cte()}
SELECT id FROM lst WHERE latitude = {_LOOKUP_LAT} AND longitude = {_LOOKUP_LON}
UNION ALL SELECT id FROM lst WHERE description = 'small ring'
""")
def q_point_lookup(spark, sf_dir):
    df = listings(spark, sf_dir)
    a = P.point_lookup(df, {"latitude": _LOOKUP_LAT, "longitude": _LOOKUP_LON}, ["id"])
    b = P.point_lookup(df, {"description": "small ring"}, ["id"])
    return a.unionByName(b)


_SEGMENTS_SQL = {
    "rooms": "room_type <> 'Entire home/apt'",
    "homes": "room_type = 'Entire home/apt'",
    "all": "TRUE",
    "exclude_a": "neighbourhood <> 'Brand#1'",
    "exclude_b": "neighbourhood <> 'Brand#2'",
    "exclude_a_b": "neighbourhood <> 'Brand#1' AND neighbourhood <> 'Brand#2'",
}


def listing_segments():
    c, n = F.col("room_type"), F.col("neighbourhood")
    return {"rooms": c != K.HOME_ROOM_TYPE, "homes": c == K.HOME_ROOM_TYPE, "all": F.lit(True),
            "exclude_a": n != "Brand#1", "exclude_b": n != "Brand#2",
            "exclude_a_b": (n != "Brand#1") & (n != "Brand#2")}


@register("segment_summary", f"""
WITH {lst_cte(False)},
j AS (SELECT lst.*, li.n_lines FROM lst JOIN (SELECT l_partkey, count(*) AS n_lines FROM lineitem GROUP BY l_partkey) li
      ON lst.id = li.l_partkey)
""" + " UNION ALL ".join(
    f"SELECT '{name}' AS segment, count(*) AS n_listings, sum(n_lines) AS n_lines, "
    f"{r('avg(review_scores_rating)', 'mean_rating')} FROM j WHERE {cond}"
    for name, cond in _SEGMENTS_SQL.items()))
def q_segments(spark, sf_dir):
    lines = tables(spark, sf_dir).lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_lines"))
    df = listings(spark, sf_dir, with_nulls=False).join(lines, F.col("id") == F.col("l_partkey"))
    tagged = P.tag_segments(df, listing_segments())
    return round_doubles(tagged.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_listings"), F.sum("n_lines").alias("n_lines"),
        F.avg("review_scores_rating").alias("mean_rating")))


_PERIOD_COLS = [period_column(m, p) for m in K.CALENDAR_MEASURES for p in K.PERIODS_PRODUCTION]


@register("feature_projection", f"""
WITH c AS ({_calendar_features_sql(K.PERIODS_PRODUCTION)})
SELECT listing_id, available_year_avg, min_nights_year_avg, price_year_avg AS label FROM c
""")
def q_feature_projection(spark, sf_dir):
    feats = round_doubles(C1.calendar_features(calendar(spark, sf_dir), CALENDAR_ORDER))
    return P.feature_projection(feats, _PERIOD_COLS, re_add=K.PERIOD_COMBOS[0][:2], label=K.PERIOD_COMBOS[0][2])


# ---------------------------------------------------------------------------
# F1-F16
# ---------------------------------------------------------------------------
@register("available_flag", """
SELECT l_orderkey, l_linenumber, CASE WHEN f = 'A' THEN 1 ELSE 0 END AS available FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_returnflag END AS f FROM lineitem)
""")
def q_available_flag(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    f = inject_null(F.col("l_returnflag"), F.col("l_orderkey"), 0)
    return li.select("l_orderkey", "l_linenumber", S.text_flag(f, "A").alias("available"))


@register("category_flag", "SELECT p_partkey, CASE WHEN p_type = 'STANDARD' THEN 1 ELSE 0 END AS is_standard FROM part")
def q_category_flag(spark, sf_dir):
    return tables(spark, sf_dir).part.select("p_partkey", S.category_flag("p_type", "STANDARD").alias("is_standard"))


@register("high_price_flag", f"""
SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice / 200 >= {K.HIGH_PRICE_THRESHOLD} THEN 1 ELSE 0 END AS is_high_price_range
FROM lineitem""")
def q_threshold_flag(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    return li.select("l_orderkey", "l_linenumber",
                     S.threshold_flag(F.col("l_extendedprice") / 200, K.HIGH_PRICE_THRESHOLD).alias("is_high_price_range"))


@register("currency_parse", """
SELECT l_orderkey, l_linenumber, t AS price_text, CAST(replace(replace(t, '$', ''), ',', '') AS DOUBLE) AS price
FROM (SELECT l_orderkey, l_linenumber, '$' || format('{:,.2f}', l_extendedprice) AS t FROM lineitem)
""")
def q_currency_parse(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    t = F.concat(F.lit("$"), F.format_number("l_extendedprice", 2))
    return li.select("l_orderkey", "l_linenumber", t.alias("price_text"), S.currency_to_double(t).alias("price"))


@register("floor_to_day", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def q_floor_day(spark, sf_dir):
    return tables(spark, sf_dir).events.select("event_id", S.floor_day("ts").alias("day"))


@register("year_shift", f"""
SELECT o_orderkey, CASE WHEN year(o_orderdate) = 2000 THEN CAST(CAST(o_orderdate AS DATE) - INTERVAL {K.SHIFT_DAYS} DAY AS DATE)
       ELSE CAST(o_orderdate AS DATE) END AS day FROM orders
""")
def q_year_shift(spark, sf_dir):
    return tables(spark, sf_dir).orders.select("o_orderkey", S.shift_year_back("o_orderdate", 2000).alias("day"))


@register("month_season", """
SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month,
  CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'spring'
       WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 'summer' ELSE 'fall' END AS season
FROM orders
""")
def q_month_season(spark, sf_dir):
    o = tables(spark, sf_dir).orders
    return o.select("o_orderkey", F.month("o_orderdate").alias("month"), S.season("o_orderdate").alias("season"))


_AMENITY_TEXT_SQL = ("'{' || p_type || ',\"' || p_name || ' / ' || p_brand || '’s\",,,,\"Pack ’n Play/travel crib\","
                     "_x_,24-hour check-in,translation missing: en.hosting_amenity_49}'")


def _amenity_text_spark():
    return F.concat(F.lit("{"), F.col("p_type"), F.lit(',"'), F.col("p_name"), F.lit(" / "), F.col("p_brand"),
                    F.lit('’s",,,,"Pack ’n Play/travel crib",_x_,24-hour check-in,translation missing: en.hosting_amenity_49}'))


@register("amenity_normalise", f"""
SELECT p_partkey, {amenity_norm_sql(_AMENITY_TEXT_SQL)} AS normalised,
       array_to_string(string_split({amenity_norm_sql(_AMENITY_TEXT_SQL)}, ','), '|') AS tokens,
       array_to_string(list_sort(list_distinct(list_filter(list_transform(
           string_split({amenity_norm_sql(_AMENITY_TEXT_SQL)}, ','), lambda t: {amenity_rename_sql('t')}),
           lambda t: t <> ''))), '|') AS token_set
FROM part
""")
def q_amenity_normalise(spark, sf_dir):
    p = tables(spark, sf_dir).part.select("p_partkey", _amenity_text_spark().alias("raw"))
    norm = normalise_amenity_text("raw")
    return p.select("p_partkey", norm.alias("normalised"),
                    join_tokens(F.split(norm, ",", -1), "|").alias("tokens"),
                    join_tokens(F.array_sort(amenity_token_set("raw")), "|").alias("token_set"))


@register("slug", "SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS slug FROM part")
def q_slug(spark, sf_dir):
    return tables(spark, sf_dir).part.select("p_partkey", S.slug("p_name").alias("slug"))


@register("half_even_round", """
SELECT p_partkey, p_size / 2.0 AS half, round_even(p_size / 2.0, 0) AS rounded FROM part
""")
def q_half_even(spark, sf_dir):
    p = tables(spark, sf_dir).part.select("p_partkey", (F.col("p_size") / 2.0).alias("half"))
    return p.withColumn("rounded", S.round_half_even("half"))


@register("prediction_errors", f"""
SELECT l_orderkey, l_linenumber, {r('l_extendedprice * (1 - l_discount) - l_extendedprice', 'error')},
       {r('abs(l_extendedprice * (1 - l_discount) - l_extendedprice)', 'abs_error')} FROM lineitem
""")
def q_errors(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem.withColumn("pred", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return round_doubles(li.select("l_orderkey", "l_linenumber",
                                   S.signed_error("pred", "l_extendedprice").alias("error"),
                                   S.abs_error("pred", "l_extendedprice").alias("abs_error")))


@register("text_bin_override", """
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL AND d.text <> '' AND l.quality IS NOT NULL THEN l.quality ELSE 2 END
       AS pred_price_year_avg_bin
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def q_text_override(spark, sf_dir):
    t = tables(spark, sf_dir)
    j = t.documents.join(t.labels, "doc_id", "left")
    default = F.lit(dict((n, d) for n, _, d in K.REQUEST_TAIL_DEFAULTS)["pred_price_year_avg_bin"])
    return j.select("doc_id", text_bin(F.col("text"), F.coalesce("quality", default), default).alias("pred_price_year_avg_bin"))


@register("min_max_scale", f"""
SELECT p_partkey, {r('(p_retailprice - (SELECT min(p_retailprice) FROM part)) / ((SELECT max(p_retailprice) FROM part) - (SELECT min(p_retailprice) FROM part))', 'scaled')}
FROM part
""")
def q_min_max(spark, sf_dir):
    p = tables(spark, sf_dir).part.select("p_partkey", "p_retailprice")
    return round_doubles(min_max_scale(p, ["p_retailprice"], "_s").select(
        "p_partkey", F.col("p_retailprice_s").alias("scaled")))
