"""Tables that cut a lineage: written as Parquet into the shared folder of spark.checkpoint.dir, read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomrate.session import shared_path

#: column of keyed()
KEY = "__row_key"


def written(df: DataFrame, name: str) -> DataFrame:
    """df from a Parquet table in the shared folder (any executor can read it again after a loss)."""
    path = shared_path(df.sparkSession, f"llm-{name}")
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def keyed(df: DataFrame) -> DataFrame:
    """df with KEY, a number of its own for each row, from a written table: it stays the same however often it is read."""
    return written(df.withColumn(KEY, F.monotonically_increasing_id()), "keyed")
