"""Registered queries: key joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomrate import constants as K
from roomrate.operators import joins as J
from roomrate.operators.periods import period_averages
from roomrate.plans import calendar as C1
from roomrate.plans.common import calendar, listings, lst_cte, r, round_doubles, tables
from roomrate.plans.queries_jobs import _calendar_features_sql
from roomrate.plans.registry import register
from roomrate.sources.bindings import CALENDAR_ORDER


@register("parts_in_lineitem", "SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def q_semi_a(spark, sf_dir):
    """Listings that have calendar rows."""
    t = tables(spark, sf_dir)
    return J.semi_join(t.part, t.lineitem, "p_partkey", "l_partkey")


@register("lines_of_standard_parts", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'STANDARD')
""")
def q_semi_b(spark, sf_dir):
    """J1 other direction: calendar rows whose listing is in a filtered listing set."""
    t = tables(spark, sf_dir)
    return J.semi_join(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"),
                       t.part.where(F.col("p_type") == "STANDARD"), "l_partkey", "p_partkey")


@register("listing_calendar_join", f"""
WITH {lst_cte(False)}, c AS ({_calendar_features_sql(K.PERIODS_PRODUCTION)})
SELECT lst.id, lst.room_type, c.price_year_avg, c.available_year_avg FROM lst JOIN c ON lst.id = c.listing_id
""")
def q_inner(spark, sf_dir):
    """Listing column joined to the calendar-feature key."""
    feats = round_doubles(C1.calendar_features(calendar(spark, sf_dir), CALENDAR_ORDER))
    j = J.inner_join(listings(spark, sf_dir, with_nulls=False), feats, "id", "listing_id")
    return j.select("id", "room_type", "price_year_avg", "available_year_avg")


@register("order_customer_flag_tally", """
SELECT o.o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS has_match, count(*) AS count
FROM orders o GROUP BY 1
""")
def q_exists(spark, sf_dir):
    """Which order rows have a (positive-balance) customer, tallied."""
    t = tables(spark, sf_dir)
    flagged = J.exists_flag(t.orders, t.customer.where(F.col("c_acctbal") > 0), "o_custkey", "c_custkey")
    return J.flag_tally(flagged, "has_match")


@register("season_attach", f"""
WITH c AS ({_calendar_features_sql(K.PERIODS_PRODUCTION, drop_outliers=False)})
SELECT listing_id, price_year_avg, price_winter_avg FROM c
""")
def q_attach(spark, sf_dir):
    """A per-period table attached to the yearly table by a left join on the group key."""
    cal = C1.clean_calendar(calendar(spark, sf_dir), CALENDAR_ORDER)
    year = period_averages(cal, "listing_id", "date", {"price": "price"}, {"year": None})
    winter = period_averages(cal.where(F.month("date").isin(12, 1, 2)), "listing_id", "date",
                             {"price": "price"}, {"winter": None})
    return round_doubles(J.attach(year, winter, "listing_id"))
