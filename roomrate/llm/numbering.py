"""Gapless numbers of rows within groups, without one task per group.

Each group is cut into CELLS cells by a hash; rows are numbered within a cell, and each cell is moved up
by the rows of the cells before it. Only the cells' counts (a grouped sum) are ordered per group: CELLS rows
for each. A group that holds a third of all rows is thus numbered by as many tasks as any other data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 4096


def numbered(df: DataFrame, group: Column, order: list[Column], into: str, by: Column) -> DataFrame:
    """df with `into`: 0, 1, ... within each group, by cell (a hash of `by`) and `order` in it. A null group is a
    group; rows equal in `order` get their numbers in any order."""
    cells = df.withColumns({"__group": group, "__cell": F.pmod(F.xxhash64(by), F.lit(CELLS))})
    within = Window.partitionBy("__group", "__cell").orderBy(*order)
    counts = cells.groupBy("__group", "__cell").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__group").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.select(F.col("__group").alias("__g"), F.col("__cell").alias("__c"),
                          F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rows = cells.withColumn("__rank", F.row_number().over(within))
    return (rows.join(moved, F.col("__group").eqNullSafe(F.col("__g")) & (F.col("__cell") == F.col("__c")))
            .withColumn(into, F.col("__before") + F.col("__rank") - 1)
            .drop("__group", "__cell", "__g", "__c", "__before", "__rank"))
