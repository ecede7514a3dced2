"""C3 as a job: two CSV snapshots in; feature table, default profile (JSON) and text model out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomrate import constants as K
from roomrate.functions.scalar import nan_to_null
from roomrate.operators.dedupe import with_file_order
from roomrate.plans import calendar as C1
from roomrate.plans import listings as C2
from roomrate.plans import merge as C3
from roomrate.session import shared_path, written
from roomrate.sources.csv_io import read_csv
from roomrate.sources.json_io import write_profile_rows

_TYPES = {"id": T.LongType(), "latitude": T.DoubleType(), "longitude": T.DoubleType(), "accommodates": T.IntegerType(),
          "bathrooms": T.DoubleType(), "bedrooms": T.DoubleType(), "beds": T.DoubleType()}
LISTING_COLUMNS = ("id", "description", "host_is_superhost", "latitude", "longitude", "room_type", "accommodates",
                   "bathrooms", "bedrooms", "beds", "amenities")
CALENDAR_SCHEMA = T.StructType([
    T.StructField("listing_id", T.LongType()), T.StructField("date", T.TimestampNTZType()),
    T.StructField("available", T.StringType()), T.StructField("price", T.StringType()),
    T.StructField("adjusted_price", T.StringType()), T.StructField("minimum_nights", T.DoubleType())])


def listing_schema(columns=LISTING_COLUMNS) -> T.StructType:
    """Declared types of the used columns; every other column is text (it is pruned right after)."""
    return T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in columns])


class Built(NamedTuple):
    table: DataFrame  # identifiers and text still present
    features: DataFrame
    profile: DataFrame  # (feature, value)
    vocabulary: DataFrame  # (token, rank): the entries of the table's amenity vector
    profile_path: str
    text_model: PipelineModel


def _without_nan(df: DataFrame) -> DataFrame:
    return df.select(*[nan_to_null(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def read_snapshots(spark: SparkSession, listings_csv: str, calendar_csv: str, listing_columns=LISTING_COLUMNS):
    """(listings, calendar), typed, NaN as NULL, with their file order. Listings hold free text with line
    breaks (one task per file); the calendar has none, so its files are split."""
    rows = read_csv(spark, listings_csv, listing_schema(listing_columns), multi_line=True)
    days = read_csv(spark, calendar_csv, CALENDAR_SCHEMA, multi_line=False)
    return with_file_order(_without_nan(rows)), with_file_order(_without_nan(days))


def build_features(spark: SparkSession, listings_csv: str, calendar_csv: str, listing_columns=LISTING_COLUMNS,
                   max_iter: int = 50) -> Built:
    rows, days = read_snapshots(spark, listings_csv, calendar_csv, listing_columns)
    order = [c for c in rows.columns if c not in listing_columns]
    features, ranks = C2.encoded_listings(C2.listing_features(rows, order_by=order).drop(*order))
    averages = C1.calendar_features(days, [c for c in days.columns if c not in CALENDAR_SCHEMA.names])
    merged = written(C3.merge_features(features, averages), "filled")
    scored, text_model, _ = C3.add_text_bin(merged, max_iter=max_iter)
    table = written(scored, "features")
    final = C3.final_features(table)
    profile = C3.profile_rows(final, ranks)
    path = write_profile_rows(profile, shared_path(spark, "profiles", "default_features"))
    return Built(table, final, profile, ranks, path, text_model)


def stored_defaults(spark: SparkSession, path: str) -> dict[str, float]:
    """The written profile (one JSON object) as request defaults; only the request's fields are taken from it."""
    fields = {n: t for n, t, _ in K.request_fields()}
    profile = spark.read.text(path).select(F.from_json("value", "map<string,double>").alias("p"))
    row = profile.select(*[F.try_element_at("p", F.lit(n)).alias(n) for n in fields]).first().asDict()
    return {n: int(v) if fields[n] == "int" else float(v) for n, v in row.items() if v is not None}
