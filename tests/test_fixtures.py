"""Literal edge fixtures: hand-derived expected values for the semantic traps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from roomrate import constants as K
from roomrate.functions import scalar as S
from roomrate.functions.bins import right_closed_bin
from roomrate.functions.text import amenity_token_set, amenity_tokens, filtered_ngrams
from roomrate.operators.neighbours import neighbour_fill
from roomrate.operators.periods import outlier_band, period_averages
from roomrate.plans.listings import clean_listings


def test_amenity_text(spark):
    raw = '{TV,"Air conditioning","Pack ’n Play/travel crib","translation missing: en.hosting_amenity_49"}'
    row = spark.createDataFrame([(raw,)], "a string").select(amenity_tokens("a").alias("t")).first()
    assert row.t == ["tv", "air_conditioning", "pack_n_play_travel_crib", ""]


def test_amenity_rename_and_set(spark):
    raw = '{"24-hour check-in", toilet, TV, TV}'
    row = spark.createDataFrame([(raw,)], "a string").select(amenity_token_set("a").alias("t")).first()
    # raw tokens: 24_hour_check_in, _toilet, _tv, _tv -> renamed and de-duplicated
    assert sorted(row.t) == sorted(["all_day_check_in", "toilet", "_tv"])


def test_comma_run_is_one_pass(spark):
    row = spark.createDataFrame([("a,,,,b",)], "a string").select(amenity_tokens("a").alias("t")).first()
    assert row.t == ["a", "", "b"]


def test_price_text(spark):
    row = spark.createDataFrame([("$1,234.50",)], "p string").select(S.currency_to_double("p").alias("x")).first()
    assert row.x == 1234.5


def test_bins_right_closed(spark):
    vals = [0.0, 20.0, 50.0, 50.01, 400.0, 400.01, -5.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.b for r in df.select(right_closed_bin("x").alias("b")).collect()]
    assert got == [None, 0, 0, 1, 7, 8, None, None]


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r.y for r in df.select(S.round_half_even("x").alias("y")).collect()] == [0.0, 2.0, 2.0, -0.0]


def test_text_flag_maps_missing_to_zero(spark):
    df = spark.createDataFrame([("t",), ("f",), (None,)], "a string")
    assert [r.y for r in df.select(S.text_flag("a").alias("y")).collect()] == [1, 0, 0]


def test_nan_is_not_missing_until_normalised(spark):
    df = spark.createDataFrame([(float("nan"),), (25.0,)], "x double")
    # Spark orders NaN above every number: it passes >= 20 unless turned into NULL first
    assert df.where(F.col("x") >= 20).count() == 2
    assert df.select(S.nan_to_null("x").alias("x")).where(F.col("x") >= 20).count() == 1


def test_dedupe_before_null_filter(spark):
    rows = [(1, None, 40.7, -73.9, "Entire home/apt", 1.0, 1.0, 1.0, "f", 2, "{}"),
            (2, "nice", 40.7, -73.9, "Entire home/apt", 1.0, 1.0, 1.0, "f", 2, "{}")]
    df = spark.createDataFrame(rows, "id long, description string, latitude double, longitude double, "
                                     "room_type string, bathrooms double, bedrooms double, beds double, "
                                     "host_is_superhost string, accommodates int, amenities string")
    assert clean_listings(df).count() == 0


def test_season_gap_drops_listing(spark):
    rows = [(1, dt.date(2019, m, 1), 1, 2.0, 100.0) for m in range(3, 12)] + \
           [(2, dt.date(2019, m, 1), 1, 2.0, 100.0) for m in range(1, 13)]
    cal = spark.createDataFrame(rows, "listing_id long, date date, available int, minimum_nights double, price double")
    feats = period_averages(cal, "listing_id")
    one = feats.where("listing_id = 1").first()
    assert one.available_winter_avg is None and one.price_spring_avg == 100.0
    assert [r.listing_id for r in outlier_band(feats).collect()] == [2]


def test_box_edges_and_room_type(spark):
    rows = [(1, "A", 40.0, -73.0, None),      # probe
            (2, "A", 40.001, -73.001, 10.0),  # inside
            (3, "A", 40.003, -73.0, 99.0),    # 0.003 away: outside
            (4, "B", 40.0005, -73.0, 50.0),   # other room type
            (5, "A", 40.002, -73.0, 77.0)]    # exactly on the open edge: outside
    df = spark.createDataFrame(rows, "id long, room_type string, latitude double, longitude double, x double")
    out = {r.id: r.x for r in neighbour_fill(df, ["x"], round_result=False).collect()}
    assert out[1] == 10.0 and out[2] == 10.0 and out[3] == 99.0


def test_rounded_fill_is_half_even(spark):
    rows = [(1, "A", 40.0, -73.0, None), (2, "A", 40.0, -73.0005, 2.0), (3, "A", 40.0005, -73.0, 3.0)]
    df = spark.createDataFrame(rows, "id long, room_type string, latitude double, longitude double, x double")
    out = {r.id: r.x for r in neighbour_fill(df, ["x"], round_result=True).collect()}
    assert out[1] == 2.0  # mean 2.5 -> 2 (half-even)


def test_year_shift(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 2, 29, 0, 0),), (dt.datetime(2019, 12, 31),)], "d timestamp")
    got = [r.y for r in df.select(S.shift_year_back("d", 2020).alias("y")).collect()]
    assert got == [dt.date(2019, 3, 1), dt.date(2019, 12, 31)]


def test_gram_filter(spark):
    df = spark.createDataFrame([("great room in the park",)], "t string")
    assert df.select(filtered_ngrams("t", 2).alias("g")).first().g == ["great room"]


def test_empty_description_keeps_default_bin(spark):
    from roomrate.sources.json_io import decode_requests

    df = spark.createDataFrame([(1, '{"description": "", "bedrooms": 2}'), (2, '{"bedrooms": "x"}'), (3, "{oops")],
                               "request_id long, body string")
    rows = {r.request_id: r for r in decode_requests(df).collect()}
    assert rows[1].pred_price_year_avg_bin == 2 and rows[1].bedrooms == 2 and rows[1].is_valid
    assert rows[2].bedrooms == 1 and not rows[2].is_valid
    assert rows[3].accommodates == 3 and not rows[3].is_valid
    assert rows[1].wifi == 1 and rows[1].toilet == 0 and len(K.request_fields()) == 138


def test_gram_hits_or_into_flags(spark):
    from roomrate.functions.text import filtered_ngrams, gram_vocabulary_hits
    from roomrate.operators.encode import or_gram_flags

    df = spark.createDataFrame([(1, "Hot water and free street parking nearby", 0, 1)],
                               "id int, d string, hot_water int, tv int")
    df = df.withColumn("hits", gram_vocabulary_hits(filtered_ngrams("d", 2), ["hot_water", "tv", "parking"],
                                                    match_subgram=True))
    row = or_gram_flags(df, "hits", ["hot_water", "tv", "parking"]).first()
    assert (row.hot_water, row.tv, row.parking) == (1, 1, 1)


def test_default_profile_rounding(spark):
    from roomrate.plans.merge import profile_defaults

    rows = [(1, 40.1, 2.5, 0.25, 3.0, 100.0), (2, 40.2, 2.5, 0.35, 2.0, 300.0)]
    df = spark.createDataFrame(rows, "beds int, latitude double, bathrooms double, available_year_avg double, "
                                     "min_nights_year_avg double, price_year_avg double")
    r = profile_defaults(df).first()
    assert r.beds == 2.0                      # mean 1.5 -> 2 (half-even)
    assert r.bathrooms == 2.0                 # mean 2.5 -> 2 (half-even)
    assert abs(r.latitude - 40.15) < 1e-12    # kept unrounded
    assert abs(r.available_year_avg - 0.3) < 1e-12 and r.min_nights_year_avg == 2.5
    assert "price_year_avg" not in r.asDict()  # label columns are excluded
