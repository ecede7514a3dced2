"""CSV snapshots.

Listing snapshots hold free text with quoted newlines and embedded quotes, so
the reader always uses multiLine + '"' quote/escape and an explicit schema
(inference costs a second pass and mis-types mixed columns). NaN is not a
CSV value here: an empty field is NULL, so missing values compare as NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

READ_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "mode": "FAILFAST",
                "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
WRITE_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "false",
                 "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, date_format: str = "yyyy-MM-dd",
             timestamp_format: str = TIMESTAMP_FORMAT, multi_line: bool = True) -> DataFrame:
    """Header CSV (gzip inferred from the extension) with a declared schema.
    Date / timestamp columns are parsed by the declared type. (S2) Without line breaks in its fields
    a file is read with multi_line=False: it is then split over tasks (unless gzipped)."""
    return (spark.read.options(**READ_OPTIONS).option("multiLine", str(multi_line).lower())
            .option("dateFormat", date_format)
            .option("timestampFormat", timestamp_format)
            .option("timestampNTZFormat", timestamp_format)
            .schema(schema).csv(path))


def write_csv(df: DataFrame, path: str, compression: str = "gzip",
              timestamp_format: str = TIMESTAMP_FORMAT) -> str:
    (df.write.mode("errorifexists").options(**WRITE_OPTIONS)
     .option("compression", compression)
     .option("timestampFormat", timestamp_format)
     .option("timestampNTZFormat", timestamp_format)
     .csv(path))
    return path
