"""Keep-first de-duplication.

`dropDuplicates` keeps an arbitrary row; the analysis keeps the FIRST row in
file order. We express "first" with an explicit order key and pick it with
`min_by` inside a grouped aggregate. Spark plans this as a partial
(map-side) aggregate before the shuffle, so a group of copies — even one
holding a third of all rows — collapses inside each map task and never
lands in one reducer. A window `row_number()` variant is kept for callers
that need it (Spark inserts a partial group-limit before its shuffle too).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys, order_by, values=None, method: str = "aggregate") -> DataFrame:
    """One row per `keys`: the row with the smallest `order_by` tuple.

    keys      grouping columns (NULL keys form their own group, like pandas)
    order_by  columns giving the file order (must be unique within a key)
    values    columns to carry (default: every other column)
    """
    keys, order_by = list(keys), list(order_by)
    if values is None:
        values = [c for c in df.columns if c not in keys and c not in order_by]
    values = list(values)
    if method == "window":
        w = Window.partitionBy(*keys).orderBy(*order_by)
        return (df.withColumn("_rn", F.row_number().over(w))
                .where(F.col("_rn") == 1).select(*keys, *values))
    if method != "aggregate":
        raise ValueError(method)
    order = F.struct(*[F.col(c) for c in order_by])
    picked = F.min_by(F.struct(*[F.col(c) for c in values]), order).alias("_first")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col("_first")[c].alias(c) for c in values])


def with_file_order(df: DataFrame) -> DataFrame:
    """Attach a file-order key to a freshly read file source: (_file, _block, _row).

    Within a task, splits are read sequentially, so the partition-local row id
    rises with file offset; the block start orders splits of the same file."""
    return (df.withColumn("_file", F.input_file_name())
            .withColumn("_block", F.input_file_block_start())
            .withColumn("_row", F.monotonically_increasing_id()))


FILE_ORDER = ("_file", "_block", "_row")
