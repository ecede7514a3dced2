"""C3 — merged feature table, text-bin feature and default profile.

listing features ⋈ calendar features on id (inner; the source's two semi-joins
are implied by it) -> neighbour fill of the price averages (grid band join)
-> optional text-bin model column -> drop identifiers/text -> default profile.
The amenities travel as a token set and, with `encoded_listings`, as one sparse
vector; their means join the profile's rows under the tokens' names.
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomrate import constants as K
from roomrate.functions.bins import right_closed_bin
from roomrate.operators.joins import inner_join
from roomrate.operators.models import PARALLEL_FITS, append_class, text_classifier
from roomrate.operators.neighbours import neighbour_fill
from roomrate.operators.profile import default_profile
from roomrate.operators.split import kfold, stratified_split
from roomrate.operators.vectors import vector_means, written_vectors
from roomrate.plans.listings import VECTOR
from roomrate.session import written


def merge_features(listing_feats: DataFrame, calendar_feats: DataFrame, materialise: bool = True) -> DataFrame:
    """The fill reads the joined table three times (aggregate, join-back, output); the joined
    table is listing-level, so it is written once into the shared folder instead of
    re-running the calendar pipeline over the full calendar for each read."""
    m = inner_join(listing_feats, calendar_feats, "id", "listing_id")
    if materialise:
        m = written_vectors(m, "merged", (VECTOR,))
    return neighbour_fill(m, K.PRICE_FILL_COLUMNS, round_result=False)


def add_text_bin(merged: DataFrame, text: str = "description", key: str = "id", max_iter: int = 50):
    """Fit the text -> price-bin classifier on the 60 % stratified train part and append the
    predicted bin for every row (as the source does, rows it trained on included). (M6, M8)
    Returns (frame with pred_price_year_avg_bin, fitted model, held-out frame)."""
    data = merged.withColumn("price_year_avg_bin", right_closed_bin("price_year_avg"))
    data = data.where(F.col("price_year_avg_bin").isNotNull())
    parts = stratified_split(data, key, "price_year_avg_bin", K.STRATIFIED_SHARES)
    train = parts.where(F.col("part") == "train").withColumn("_label", F.col("price_year_avg_bin").cast("double"))
    model = text_classifier(text, "_label", max_iter=max_iter).fit(train)
    scored = append_class(model, merged, "pred_price_year_avg_bin")
    return scored, model, parts.where(F.col("part") == "test")


def cross_text_bin(merged: DataFrame, folds: int, text: str = "description", key: str = "id", max_iter: int = 50) -> DataFrame:
    """merged with pred_price_year_avg_bin out of fold: the rows are dealt to folds by the hash of their key, and a row's bin
    comes from the model that was fitted without its fold (add_text_bin, as the source, scores rows it trained on).
    `fold` is the row's own; `fitted_on` lists the folds of the rows that its model was fitted on, read off those
    rows. (M6, M8, M16)"""
    data = written(kfold(merged.withColumn("price_year_avg_bin", right_closed_bin("price_year_avg")), key, folds), "cross-fit")

    def scored(k: int) -> DataFrame:
        train = (data.where((F.col("fold") != k) & F.col("price_year_avg_bin").isNotNull())
                 .withColumn("_label", F.col("price_year_avg_bin").cast("double")))
        model = text_classifier(text, "_label", max_iter=max_iter).fit(train)
        seen = train.agg(F.array_sort(F.collect_set("fold"))).scalar()
        return append_class(model, data.where(F.col("fold") == k), "pred_price_year_avg_bin").withColumn("fitted_on", seen)

    with ThreadPool(PARALLEL_FITS) as pool:
        parts = pool.map(scored, range(folds), chunksize=1)
    return reduce(DataFrame.unionByName, parts).drop("price_year_avg_bin")


def final_features(merged: DataFrame) -> DataFrame:
    return merged.drop(*[c for c in K.MERGE_DROP_COLUMNS if c in merged.columns])


def profile_defaults(features: DataFrame) -> DataFrame:
    """A5: means minus label/season columns, half-even rounded except four columns."""
    return default_profile(features, K.PROFILE_EXCLUDED, K.PROFILE_UNROUNDED)


def profile_rows(features: DataFrame, ranks: DataFrame, vector: str = VECTOR) -> DataFrame:
    """A5 as (feature, value): profile_defaults of the columns, and the rounded mean of every token of the vocabulary."""
    columns = profile_defaults(features)
    tokens = vector_means(features, vector, ranks).select(F.col("token").alias("feature"), F.bround("mean", 0).alias("value"))
    return columns.unpivot([], columns.columns, "feature", "value").union(tokens)
