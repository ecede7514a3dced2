"""C1 — calendar features: one row per listing with yearly/seasonal averages.

exclude key -> floor to day -> keep-first per (listing, day) -> 0/1 availability
-> currency text to double -> conditional averages (one group-by) -> outlier band.

Physical plan: scan (pruned to 8 columns, key filter pushed) -> partial
min_by aggregate -> shuffle on (listing, day) -> final -> partial averages ->
shuffle on listing -> final -> filter. Both shuffles carry map-side-combined
rows, so a duplicated (listing, day) — however many copies — costs one row
per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomrate import constants as K
from roomrate.functions.scalar import currency_to_double, floor_day, not_equal_key, shift_year_back, text_flag
from roomrate.operators.dedupe import keep_first
from roomrate.operators.periods import outlier_band, period_averages


def clean_calendar(calendar: DataFrame, order_by, excluded_listing=K.EXCLUDED_LISTING_ID,
                   shift_year: int | None = None) -> DataFrame:
    """Rows (listing_id, date, available 0/1, price double, minimum_nights), one per listing-day."""
    cal = calendar
    if excluded_listing is not None:
        cal = cal.where(not_equal_key("listing_id", excluded_listing))
    # the notebook moves rows of one year back 365 days (production skips it)
    day = shift_year_back("date", shift_year) if shift_year is not None else floor_day("date")
    cal = cal.withColumn("date", day)
    cal = keep_first(cal, ["listing_id", "date"], order_by,
                     values=["available", "adjusted_price", "minimum_nights"])
    return cal.select(
        "listing_id", "date",
        text_flag("available").alias("available"),
        currency_to_double("adjusted_price").alias("price"),
        F.col("minimum_nights").cast("double").alias("minimum_nights"),
    )


def calendar_features(calendar: DataFrame, order_by, periods: dict = K.PERIODS_PRODUCTION,
                      excluded_listing=K.EXCLUDED_LISTING_ID, shift_year: int | None = None,
                      drop_outliers: bool = True) -> DataFrame:
    cal = clean_calendar(calendar, order_by, excluded_listing, shift_year)
    feats = period_averages(cal, "listing_id", "date", K.CALENDAR_MEASURES, periods)
    return outlier_band(feats, periods) if drop_outliers else feats
