"""Shared helpers for registered queries: role tables and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomrate.plans.registry import ORACLE_DIGITS
from roomrate.sources import bindings as B
from roomrate.sources.tables import Tables, read_table


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.calendar_from_lineitem(read_table(spark, sf_dir, "lineitem"))


def listings(spark: SparkSession, sf_dir: str, with_nulls: bool = True) -> DataFrame:
    return B.listings_from_part(read_table(spark, sf_dir, "part"), with_nulls=with_nulls)


def folded_flags(df: DataFrame, fixed, others=()) -> DataFrame:
    """Fixed columns, then the 0/1 columns that are neither fixed nor `others` as n_flags and a sorted '|' list of
    the names that are 1, then the others."""
    flags = sorted(c for c in df.columns if c not in set(fixed) | set(others))
    names = F.array(*[F.when(F.col(f"`{c}`") == 1, F.lit(c)) for c in flags]) if flags else F.array().cast("array<string>")
    on = F.filter(names, lambda x: x.isNotNull())
    return df.select(*fixed, F.size(on).alias("n_flags"), F.array_join(on, "|").alias("flags"), *others)


def listed_tokens(df: DataFrame, fixed, tokens: str = "amenities", others=()) -> DataFrame:
    """Fixed columns, then a token set as n_flags and a sorted '|' list of its tokens, then the others."""
    return df.select(*fixed, F.size(tokens).alias("n_flags"), F.array_join(tokens, "|").alias("flags"), *others)


def round_doubles(df: DataFrame, digits: int = ORACLE_DIGITS) -> DataFrame:
    """Round every double column (summation order differs between engines)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def r(expr: str, alias: str | None = None, digits: int = ORACLE_DIGITS) -> str:
    """SQL: round(expr, digits) AS alias."""
    return f"round({expr}, {digits}) AS {alias or expr}"


CAL_CTE = f"cal AS ({B.CALENDAR_SQL})"


def lst_cte(with_nulls: bool = True) -> str:
    return f"lst AS ({B.listings_sql(with_nulls)})"
