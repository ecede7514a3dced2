"""Projections and filters (P1-P11). All narrow: no shuffle, pushed to the scan where possible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomrate.functions.scalar import all_within, not_equal_key, not_equal_pandas


def drop_columns(df: DataFrame, columns, strict: bool = True) -> DataFrame:
    """Drop named columns. pandas raises on an unknown name and Spark silently ignores it,
    so strict=True checks the names first. (P1)"""
    columns = list(columns)
    if strict:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise KeyError(f"columns not found: {missing}")
    return df.drop(*columns)


def rename_columns(df: DataFrame, mapping: dict) -> DataFrame:
    """(P2)"""
    return df.withColumnsRenamed(mapping)


def in_set(df: DataFrame, column: str, values) -> DataFrame:
    """category in a fixed set (NULL never matches)."""
    return df.where(F.col(column).isin(list(values)))


def within_caps(df: DataFrame, caps: dict) -> DataFrame:
    """Every capped column <= its cap; NULL fails (like NaN comparisons)."""
    cond = reduce(lambda a, b: a & b, [all_within([c], None, hi) for c, hi in caps.items()])
    return df.where(cond)


def not_null(df: DataFrame, column: str) -> DataFrame:
    """(P5)"""
    return df.where(F.col(column).isNotNull())


def exclude_key(df: DataFrame, column: str, key) -> DataFrame:
    """Drop one key value, keeping rows whose key is missing."""
    return df.where(not_equal_key(column, key))


def columns_differ(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where a != b with pandas semantics."""
    return df.where(not_equal_pandas(a, b))


def point_lookup(df: DataFrame, equals: dict, select) -> DataFrame:
    """Rows matching every column == value, projected."""
    cond = reduce(lambda x, y: x & y, [F.col(c) == F.lit(v) for c, v in equals.items()])
    return df.where(cond).select(*select)


def tag_segments(df: DataFrame, segments: dict[str, Column], tag: str = "segment") -> DataFrame:
    """One pass over the data for overlapping segments: each row is exploded to the
    names of the segments whose predicate it satisfies. (P10)"""
    names = F.array(*[F.when(pred, F.lit(name)) for name, pred in segments.items()])
    return df.withColumn(tag, F.explode(F.filter(names, lambda x: x.isNotNull())))


def feature_projection(df: DataFrame, drop, re_add=(), label: str | None = None, keep=()) -> DataFrame:
    """Feature/label projection for a period combo: drop the period columns, re-append the
    chosen ones at the end, and carry the label. (P11)"""
    drop = list(drop)
    base = [c for c in df.columns if c not in drop and c not in keep]
    cols = list(keep) + base + [c for c in re_add if c not in base]
    if label is not None:
        cols.append(F.col(label).alias("label"))
    return df.select(*cols)
