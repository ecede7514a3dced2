"""Scalar column expressions (all JVM-side built-ins, no Python UDFs).

Every function takes column names or Columns and returns a Column, so the
expressions stay inside whole-stage codegen wherever they are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomrate import constants as K

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x: ColumnOrName) -> Column:
    """NaN -> NULL. Spark orders NaN above every number (NaN >= 20 is true), so a
    NaN must become NULL before any range filter to keep 'missing drops out'."""
    c = _c(x)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def text_flag(x: ColumnOrName, true_text: str = K.AVAILABLE_TRUE_TEXT) -> Column:
    """'t' -> 1, anything else (NULL included) -> 0. (F1)"""
    return F.when(_c(x) == F.lit(true_text), F.lit(1)).otherwise(F.lit(0))


def category_flag(x: ColumnOrName, value: str) -> Column:
    """category == value -> 1 else 0; NULL -> 0. (F2)"""
    return F.when(_c(x) == F.lit(value), F.lit(1)).otherwise(F.lit(0))


def threshold_flag(x: ColumnOrName, threshold: float) -> Column:
    """x >= threshold -> 1 else 0; NULL -> 0."""
    return F.when(_c(x) >= F.lit(threshold), F.lit(1)).otherwise(F.lit(0))


def currency_to_double(x: ColumnOrName, strict: bool = True) -> Column:
    """'$1,234.50' -> 1234.5. Strict casts fail on bad text under ANSI mode
    (as the source does); strict=False yields NULL instead. (F4)"""
    cleaned = F.regexp_replace(_c(x), K.CURRENCY_STRIP_PATTERN, "")
    return cleaned.cast("double") if strict else cleaned.try_cast("double")


def floor_day(x: ColumnOrName) -> Column:
    """Timestamp -> its day as DateType."""
    return F.to_date(_c(x))


def shift_year_back(x: ColumnOrName, year: int = K.SHIFT_YEAR, days: int = K.SHIFT_DAYS) -> Column:
    """Rows dated in `year` move back `days` days (then floor to day); others are floored.

    The source subtracts 365 days and adds 12 hours before flooring; for day-level
    inputs the 12 hours never cross midnight, so date_sub on the day is identical."""
    d = F.to_date(_c(x))
    return F.when(F.year(d) == F.lit(year), F.date_sub(d, days)).otherwise(d)


def season(x: ColumnOrName) -> Column:
    """Month -> season class: winter (12,1,2), spring (3-5), summer (6-8), fall (9-11)."""
    m = F.month(_c(x))
    return (F.when(m.isin(12, 1, 2), F.lit("winter"))
            .when(m.between(3, 5), F.lit("spring"))
            .when(m.between(6, 8), F.lit("summer"))
            .when(m.between(9, 11), F.lit("fall")))


def in_period(date_col: ColumnOrName, months) -> Column:
    """Predicate for a period of the period table (None = whole year)."""
    if months is None:
        return F.lit(True)
    return F.month(_c(date_col)).isin(*months)


def slug(x: ColumnOrName) -> Column:
    """'Upper East Side' -> 'upper_east_side'."""
    return F.lower(F.replace(_c(x), F.lit(" "), F.lit("_")))


def round_half_even(x: ColumnOrName, scale: int = 0) -> Column:
    """Banker's rounding (0.5 -> 0, 1.5 -> 2, 2.5 -> 2). F.round is half-up."""
    return F.bround(_c(x), scale)


def signed_error(pred: ColumnOrName, actual: ColumnOrName) -> Column:
    """prediction - actual."""
    return _c(pred) - _c(actual)


def abs_error(pred: ColumnOrName, actual: ColumnOrName) -> Column:
    return F.abs(_c(pred) - _c(actual))


def not_equal_pandas(a: ColumnOrName, b: ColumnOrName) -> Column:
    """pandas `a != b`: true when values differ, when exactly one side is missing,
    and also when both are missing (NaN != NaN). (P8)"""
    ca, cb = _c(a), _c(b)
    return ~ca.eqNullSafe(cb) | (ca.isNull() & cb.isNull())


def not_equal_key(x: ColumnOrName, key) -> Column:
    """pandas `df[c != k]` keeps missing keys; SQL `!=` would drop them."""
    return ~_c(x).eqNullSafe(F.lit(key))


def all_within(columns, low=None, high=None) -> Column:
    """Conjunction low <= c <= high over columns; a NULL value fails the test."""
    preds = []
    for c in columns:
        col = _c(c)
        if low is not None:
            preds.append(col >= F.lit(low))
        if high is not None:
            preds.append(col <= F.lit(high))
    # coalesce(...) so a NULL comparison drops the row rather than keeping it as unknown
    return F.coalesce(reduce(lambda a, b: a & b, preds), F.lit(False)) if preds else F.lit(True)


def min_max_scaled(x: ColumnOrName, lo: ColumnOrName, hi: ColumnOrName) -> Column:
    """(x - min) / (max - min); a constant column scales to 0 like sklearn. (F16)"""
    c, l, h = _c(x), _c(lo), _c(hi)
    rng = h - l
    return F.when(rng == 0, F.lit(0.0)).otherwise((c - l) / rng)


def safe_corr(x: ColumnOrName, y: ColumnOrName) -> Column:
    """Pearson r as an aggregate that yields NULL (not an ANSI divide-by-zero error) when a
    side is constant. Pairs with a NULL on either side are skipped, like corr()."""
    cx, cy = _c(x).cast("double"), _c(y).cast("double")
    both = cx.isNotNull() & cy.isNotNull()
    xx, yy = F.when(both, cx), F.when(both, cy)
    return F.try_divide(F.covar_pop(xx, yy), F.sqrt(F.var_pop(xx)) * F.sqrt(F.var_pop(yy)))
