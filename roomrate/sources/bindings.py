"""Role bindings: the rental roles played by the driver's star-schema tables.

The analysis reads two snapshots (listings, calendar) and JSON score requests.
The driver ships none of them, so each role is a projection of a driver table:

  calendar     <- lineitem   (l_partkey -> listing_id, l_shipdate -> date, ...)
  listings     <- part       (p_partkey -> id, p_type -> room_type, ...)
  descriptions <- documents  (+ labels)
  requests     <- events.props

Each binding is a narrow projection (no shuffle), so the work of every job
grows with the source table. The matching DuckDB text of each binding lives
next to it (``*_SQL``) so oracle twins derive the same rows.

NULL injection: the driver tables hold no NULLs, so bindings that must
exercise missing-value semantics blank a deterministic tenth of the rows
(`key % 10 == offset`). This is a NULL-injection rule, never a row filter.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inject_null(value: Column, key: Column, offset: int = 0, every: int = 10) -> Column:
    """value, but NULL on the deterministic 1-in-`every` rows whose key % every == offset."""
    return F.when(F.pmod(key, F.lit(every)) == F.lit(offset), F.lit(None)).otherwise(value)


# ---------------------------------------------------------------------------
# calendar <- lineitem
# ---------------------------------------------------------------------------
# One row per (listing, day) in the source snapshot; duplicates exist and the
# keep-first order is the file order, here (l_orderkey, l_linenumber, l_suppkey).
CALENDAR_ORDER = ("l_orderkey", "l_linenumber", "l_suppkey")
CALENDAR_PRICE_SCALE = 200  # l_extendedprice / 200 -> nightly price


def _price_text(extendedprice: Column) -> Column:
    """'$1,234.56'-style text of extendedprice / 200, built with integer arithmetic
    (cents truncated) — exact in every engine and far cheaper than format_number."""
    cents = F.floor(F.round(extendedprice * 100) / CALENDAR_PRICE_SCALE).cast("bigint")
    dollars = F.floor(cents / 100).cast("bigint")
    grouped = F.when(dollars >= 1000, F.concat(F.floor(dollars / 1000).cast("bigint").cast("string"), F.lit(","),
                                               F.lpad(F.pmod(dollars, F.lit(1000)).cast("string"), 3, "0"))
                     ).otherwise(dollars.cast("string"))
    return F.concat(F.lit("$"), grouped, F.lit("."), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"))


def calendar_from_lineitem(lineitem: DataFrame) -> DataFrame:
    price_text = _price_text(F.col("l_extendedprice"))
    return lineitem.select(
        F.col("l_partkey").alias("listing_id"),
        F.col("l_shipdate").alias("date"),
        F.when(F.col("l_returnflag") == "A", F.lit("t")).otherwise(F.lit("f")).alias("available"),
        price_text.alias("price"),
        price_text.alias("adjusted_price"),
        F.col("l_quantity").alias("minimum_nights"),
        *[F.col(c) for c in CALENDAR_ORDER],
    )


CENTS_SQL = f"CAST(floor(round(l_extendedprice * 100) / {CALENDAR_PRICE_SCALE}) AS BIGINT)"
DOLLARS_SQL = f"CAST(floor({CENTS_SQL} / 100) AS BIGINT)"
PRICE_TEXT_SQL = (
    f"'$' || CASE WHEN {DOLLARS_SQL} >= 1000 THEN CAST(CAST(floor({DOLLARS_SQL} / 1000) AS BIGINT) AS VARCHAR) || ',' "
    f"|| lpad(CAST({DOLLARS_SQL} % 1000 AS VARCHAR), 3, '0') ELSE CAST({DOLLARS_SQL} AS VARCHAR) END "
    f"|| '.' || lpad(CAST({CENTS_SQL} % 100 AS VARCHAR), 2, '0')"
)

CALENDAR_SQL = f"""
SELECT l_partkey AS listing_id,
       l_shipdate AS date,
       CASE WHEN l_returnflag = 'A' THEN 't' ELSE 'f' END AS available,
       {PRICE_TEXT_SQL} AS price,
       {PRICE_TEXT_SQL} AS adjusted_price,
       l_quantity AS minimum_nights,
       l_orderkey, l_linenumber, l_suppkey
FROM lineitem
"""

# ---------------------------------------------------------------------------
# listings <- part
# ---------------------------------------------------------------------------
# Coordinates grow with the table: every DISTRICT_ROWS consecutive keys form a district of their own, a
# lattice of 13 x 17 points of 0.0007 degrees, 0.02 degrees from the next district. About a third of a
# district's rows share a coordinate with another one (keep-first dedupe has work at every scale), and the
# +-0.002 box holds up to 5 x 5 lattice points of one district, so neighbours per row stay constant.
LAT_BASE, LON_BASE, LATTICE_STEP = 40.7, -73.9, 0.0007
LAT_MOD, LON_MOD = 13, 17
DISTRICT_ROWS, DISTRICT_STEP, DISTRICTS_PER_ROW = 331, 0.02, 1000
ROOM_TYPE_OF_PART_TYPE = {
    "STANDARD": "Entire home/apt", "MEDIUM": "Entire home/apt", "LARGE": "Entire home/apt",
    "ECONOMY": "Private room", "SMALL": "Private room", "PROMO": "Shared room",
}


def _room_type(p_type: Column) -> Column:
    expr = None
    for k, v in ROOM_TYPE_OF_PART_TYPE.items():
        expr = F.when(p_type == k, F.lit(v)) if expr is None else expr.when(p_type == k, F.lit(v))
    return expr.otherwise(p_type)


def listings_from_part(part: DataFrame, with_nulls: bool = True) -> DataFrame:
    key = F.col("p_partkey")
    size = F.col("p_size")

    def maybe_null(v, off):
        return inject_null(v, key, off) if with_nulls else v

    # exact decimal arithmetic, then one rounding to double (same value in every engine)
    step = F.lit(Decimal(str(LATTICE_STEP)))
    district = F.floor(key / DISTRICT_ROWS).cast("bigint")
    apart = F.lit(Decimal(str(DISTRICT_STEP)))
    lat = (F.lit(Decimal(str(LAT_BASE))) + F.pmod(key, F.lit(LAT_MOD)) * step
           + F.floor(district / DISTRICTS_PER_ROW).cast("int") * apart).cast("double")
    lon = (F.lit(Decimal(str(LON_BASE))) + F.pmod(key, F.lit(LON_MOD)) * step
           + F.pmod(district, F.lit(DISTRICTS_PER_ROW)).cast("int") * apart).cast("double")
    amenities = F.concat(F.lit('{'), F.col("p_type"), F.lit(',"'), F.col("p_name"), F.lit('","'),
                         F.col("p_brand"), F.lit('",24-hour check-in'), F.lit('}'))
    return part.select(
        key.alias("id"),
        maybe_null(F.col("p_name"), 3).alias("description"),
        F.when(F.pmod(size, F.lit(3)) == 0, F.lit("t")).otherwise(F.lit("f")).alias("host_is_superhost"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        _room_type(F.col("p_type")).alias("room_type"),
        (F.pmod(size, F.lit(6)) + 1).cast("int").alias("accommodates"),
        maybe_null(F.pmod(size, F.lit(7)).cast("double"), 0).alias("bathrooms"),
        maybe_null(F.pmod(size, F.lit(12)).cast("double"), 1).alias("bedrooms"),
        maybe_null(F.pmod(size, F.lit(14)).cast("double"), 2).alias("beds"),
        amenities.alias("amenities"),
        F.col("p_brand").alias("neighbourhood"),
        F.col("p_retailprice").alias("review_scores_rating"),
    )


def _room_type_sql() -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROOM_TYPE_OF_PART_TYPE.items())
    return f"CASE p_type {whens} ELSE p_type END"


def listings_sql(with_nulls: bool = True) -> str:
    def maybe_null(v, off):
        return f"CASE WHEN p_partkey % 10 = {off} THEN NULL ELSE {v} END" if with_nulls else v

    return f"""
SELECT p_partkey AS id,
       {maybe_null('p_name', 3)} AS description,
       CASE WHEN p_size % 3 = 0 THEN 't' ELSE 'f' END AS host_is_superhost,
       CAST(CAST({LAT_BASE} AS DECIMAL(10,4)) + CAST(p_partkey % {LAT_MOD} AS INTEGER) * {LATTICE_STEP}
            + CAST(p_partkey // {DISTRICT_ROWS * DISTRICTS_PER_ROW} AS INTEGER) * {DISTRICT_STEP} AS DOUBLE) AS latitude,
       CAST(CAST({LON_BASE} AS DECIMAL(10,4)) + CAST(p_partkey % {LON_MOD} AS INTEGER) * {LATTICE_STEP}
            + CAST((p_partkey // {DISTRICT_ROWS}) % {DISTRICTS_PER_ROW} AS INTEGER) * {DISTRICT_STEP} AS DOUBLE) AS longitude,
       {_room_type_sql()} AS room_type,
       CAST(p_size % 6 + 1 AS INTEGER) AS accommodates,
       {maybe_null('CAST(p_size % 7 AS DOUBLE)', 0)} AS bathrooms,
       {maybe_null('CAST(p_size % 12 AS DOUBLE)', 1)} AS bedrooms,
       {maybe_null('CAST(p_size % 14 AS DOUBLE)', 2)} AS beds,
       '{{' || p_type || ',"' || p_name || '","' || p_brand || '",24-hour check-in}}' AS amenities,
       p_brand AS neighbourhood,
       p_retailprice AS review_scores_rating
FROM part
"""


# ---------------------------------------------------------------------------
# descriptions <- documents (+ labels), requests <- events.props
# ---------------------------------------------------------------------------
def requests_from_events(events: DataFrame) -> DataFrame:
    """Score requests from `events.props` ({"k": n}): k becomes `accommodates`; one event in ten
    carries a badly typed field ({"bedrooms": "x<n>"}) and one in ten is not valid JSON."""
    props, eid = F.col("props"), F.col("event_id")
    badly_typed = F.replace(F.replace(props, F.lit('"k": '), F.lit('"bedrooms": "x')), F.lit("}"), F.lit('"}'))
    body = (F.when(F.pmod(eid, F.lit(10)) == 0, badly_typed)
            .when(F.pmod(eid, F.lit(10)) == 5, F.replace(props, F.lit("}"), F.lit("")))
            .otherwise(F.replace(props, F.lit('"k"'), F.lit('"accommodates"'))))
    return events.select(eid.alias("request_id"), body.alias("body"),
                         F.col("event_type").alias("description"))


REQUESTS_SQL = """
SELECT event_id AS request_id,
       CASE WHEN event_id % 10 = 0 THEN replace(replace(props, '"k": ', '"bedrooms": "x'), '}', '"}')
            WHEN event_id % 10 = 5 THEN replace(props, '}', '')
            ELSE replace(props, '"k"', '"accommodates"') END AS body,
       event_type AS description
FROM events
"""
