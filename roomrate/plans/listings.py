"""C2 — listing features.

prune -> keep-first per (latitude, longitude) -> description present ->
room type in set -> entire-home flag -> caps -> amenity token set (+ renames) ->
superhost flag.

The de-duplication runs BEFORE the description filter (a NULL first row hides a
valid later one), as in the source. The amenities of a row stay one set of tokens,
whatever the size of the vocabulary; nothing is collected. `encoded_listings` adds
the multi-hot form: the vocabulary as a table of ranks and one sparse vector per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomrate import constants as K
from roomrate.functions.scalar import category_flag, text_flag
from roomrate.functions.text import amenity_token_set
from roomrate.operators.dedupe import keep_first
from roomrate.operators.filters import drop_columns, in_set, not_null, within_caps
from roomrate.operators.vectors import token_list, token_ranks, with_token_vectors
from roomrate.session import written

VECTOR = "amenity_vector"


def prune(listings: DataFrame, columns=K.LISTING_PRUNE_COLUMNS, strict: bool = False) -> DataFrame:
    cols = list(columns) if strict else [c for c in columns if c in listings.columns]
    return drop_columns(listings, cols, strict=True)


def clean_listings(listings: DataFrame, order_by=("id",), prune_columns=K.LISTING_PRUNE_COLUMNS) -> DataFrame:
    df = prune(listings, prune_columns)
    cols = df.columns
    df = keep_first(df, ["latitude", "longitude"], list(order_by),
                    values=[c for c in cols if c not in ("latitude", "longitude")]).select(*cols)
    df = not_null(df, "description")
    df = in_set(df, "room_type", K.KEPT_ROOM_TYPES)
    df = df.withColumn("entire_home_apt", category_flag("room_type", K.HOME_ROOM_TYPE))
    df = within_caps(df, K.LISTING_CAPS)
    return df


def listing_features(listings: DataFrame, order_by=("id",), prune_columns=K.LISTING_PRUNE_COLUMNS) -> DataFrame:
    """Fixed columns and `amenities`, the sorted token set."""
    df = clean_listings(listings, order_by, prune_columns)
    return df.withColumns({"amenities": token_list(amenity_token_set("amenities")), "host_is_superhost": text_flag("host_is_superhost")})


def encoded_listings(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listing features with the fields of VECTOR, (token, rank) of their whole vocabulary)."""
    features = written(features, "listing-features")
    ranks = token_ranks(features, "amenities")
    return with_token_vectors(features, "amenities", VECTOR, ranks), ranks
