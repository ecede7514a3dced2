"""Sparse feature vectors: the same flags, means, scores and fits as the wide layout, for large vocabularies too."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from roomrate.operators import models as ML
from roomrate.operators import vectors as V
from roomrate.operators.encode import multi_hot, vocabulary
from roomrate.operators.metrics import f_regression_scores
from roomrate.operators.profile import column_means


def _rows(n, tokens, seed):
    rnd = random.Random(seed)
    names = [f"t{i:05d}" for i in range(tokens)]
    rows = []
    for i in range(n):
        own = [names[int(tokens * rnd.random() ** 2)] for _ in range(rnd.randrange(12))]
        rows.append((i, own + [""] * (i % 3 == 0) + own[:1], 10.0 * len(set(own)) + 5.0 * (names[0] in own) + rnd.random()))
    return rows + [(n, None, 3.0), (n + 1, [names[0]], None)]


def _encoded(spark, rows):
    df = spark.createDataFrame(rows, "id int, t array<string>, y double")
    ranks = V.token_ranks(df, "t")
    return df, ranks, V.written_vectors(V.with_token_vectors(df, "t", "v", ranks), "test-vectors", ("v",))


def test_three_thousand_tokens_give_what_the_wide_layout_gives(spark):
    rows = _rows(900, 3000, 1)
    df, ranks, vectors = _encoded(spark, rows)
    names = vocabulary(df, "t")
    assert len(names) > 2000 and [r.token for r in ranks.orderBy("rank").collect()] == names
    assert dict(vectors.dtypes)["v"] == "vector"
    got = {r.id: r.v for r in vectors.collect()}
    rank = {n: i for i, n in enumerate(names)}
    for i, own, _ in rows:
        want = sorted({rank[t] for t in own or [] if t})
        assert got[i].size == len(names) and got[i].indices.tolist() == want and set(got[i].values) <= {1.0}
    wide = multi_hot(df.withColumn("t", F.coalesce("t", F.array().cast("array<string>"))), "t", names)
    means = {r.token: r["mean"] for r in V.vector_means(vectors, "v", ranks).collect()}
    plain = column_means(wide, names).first().asDict()
    assert means.keys() == plain.keys() and all(math.isclose(means[t], plain[t]) for t in names)


def test_scores_equal_the_column_scores_and_numpy(spark):
    rows = _rows(400, 40, 2)
    df, ranks, vectors = _encoded(spark, rows)
    names = vocabulary(df, "t")
    wide = multi_hot(df.withColumn("t", F.coalesce("t", F.array().cast("array<string>"))), "t", names)
    want = {r.feature: r for r in f_regression_scores(wide, names, "y").collect()}
    got = {r.token: r for r in V.vector_f_scores(vectors, "v", "y").join(ranks.withColumnRenamed("rank", "index"), "index").collect()}
    assert got.keys() == want.keys()
    for t in names:
        assert got[t].n == want[t].n and math.isclose(got[t].r, want[t].r, rel_tol=1e-9) and math.isclose(got[t].f_score, want[t].f_score, rel_tol=1e-9)
    best = [r.token for r in V.top_entries(V.vector_f_scores(vectors, "v", "y"), ranks, 5).collect()]
    assert best == sorted(names, key=lambda t: (-want[t].f_score, t))[:5]


def test_scores_of_dense_vectors_and_constants(spark):
    from pyspark.ml.feature import VectorAssembler

    rnd = random.Random(3)
    rows = [(rnd.random(), 2.0, rnd.gauss(0, 5), rnd.random()) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="v").transform(df)
    got = {r["index"]: r.r for r in V.vector_f_scores(vec, "v", "y").collect()}
    x = np.array(rows)
    assert got[1] is None and all(math.isclose(got[i], np.corrcoef(x[:, i], x[:, 3])[0, 1], rel_tol=1e-9) for i in (0, 2))


def test_a_hundred_thousand_indices(spark):
    n = 100_000
    df = spark.range(20_000).select(F.col("id"), F.transform(F.sequence(F.lit(0), F.lit(14)), lambda j: F.concat(
        F.lit("w"), F.pmod(F.xxhash64("id", j), F.lit(n)).cast("string"))).alias("t"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("y"))
    ranks = V.token_ranks(df, "t")
    vectors = V.written_vectors(V.with_token_vectors(df, "t", "v", ranks), "test-vectors", ("v",))
    assert vectors.first().v.size > 90_000
    scores = V.vector_f_scores(vectors, "v", "y")
    assert scores.count() == ranks.count()
    model = ML.fit_on_entries(vectors, "v", [r["index"] for r in V.top_entries(scores, ranks, 3).collect()], "y", "lr")
    assert len(model.stages[-1].coefficients) == 3


def test_fits_on_entries_equal_fits_on_columns(spark):
    rows = [r for r in _rows(400, 12, 4) if r[2] is not None]
    df, ranks, vectors = _encoded(spark, rows)
    names = vocabulary(df, "t")
    wide = multi_hot(df.withColumn("t", F.coalesce("t", F.array().cast("array<string>"))), "t", names)
    a = ML.fit_regression(wide, names, "y", "lr", solver="normal").transform(wide)
    b = ML.fit_on_entries(vectors, "v", range(len(names)), "y", "lr", solver="normal").transform(vectors)
    c = ML.fit_regression(vectors, ["v"], "y", "lr", solver="normal").transform(vectors)
    one, two, three = ({r.id: r.prediction for r in x.collect()} for x in (a, b, c))
    assert all(math.isclose(one[i], two[i], rel_tol=1e-7) and math.isclose(one[i], three[i], rel_tol=1e-7) for i in one)
    split = vectors.withColumn("is_test", F.col("id") % 4 == 0)
    found, best = ML.select_k_entries(split, "v", ranks, "y", (12, 4, 99), "lr")
    assert [r[:2] for r in found] == [(12, 12), (4, 4), (99, 12)] and best in (12, 4, 99) and all(r[2] > 0 for r in found)


def test_vectors_are_made_without_python(spark):
    df, ranks, _ = _encoded(spark, _rows(20, 5, 5))
    plan = V.with_token_vectors(df, "t", "v", ranks)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_profile_rows_are_one_json_object(spark):
    import json

    from roomrate.plans.job import stored_defaults
    from roomrate.session import shared_path
    from roomrate.sources.json_io import write_profile_rows

    rows = [("beds", 2.0), ("wifi", 1.0), ("a token, \"odd\"", 0.0), ("latitude", 40.25)] + [(f"t{i}", 0.0) for i in range(3000)]
    path = write_profile_rows(spark.createDataFrame(rows, "feature string, value double").repartition(4), shared_path(spark, "test-profile"))
    text = [r.value for r in spark.read.text(path).collect()]
    assert len(text) == 1 and json.loads(text[0]) == dict(rows)
    assert stored_defaults(spark, path) == {"beds": 2, "wifi": 1, "latitude": 40.25}


def test_merged_profile_has_every_token(spark):
    """Tokens that no merged row has are in the profile, with mean 0."""
    from roomrate.plans import listings as C2
    from roomrate.plans import merge as C3

    lst = spark.createDataFrame([(i, "d", "t", 40.0 + i, -73.0, "Private room", 2, 1.0, 1.0, 1.0, "{TV,\"Hot tub\"}" if i else "{Sauna}")
                                 for i in range(4)], "id long, description string, host_is_superhost string, latitude double, longitude double, "
                                "room_type string, accommodates int, bathrooms double, bedrooms double, beds double, amenities string")
    cal = spark.createDataFrame([(i, 100.0) for i in (1, 2, 3)], "listing_id long, price_year_avg double")
    for c in ("price_winter_avg", "price_spring_avg", "price_summer_avg", "price_fall_avg"):
        cal = cal.withColumn(c, F.lit(90.0))
    features, ranks = C2.encoded_listings(C2.listing_features(lst))
    merged = C3.merge_features(features, cal)
    got = {r.feature: r.value for r in C3.profile_rows(C3.final_features(merged), ranks).collect()}
    assert {t: got[t] for t in ("tv", "hot_tub", "sauna")} == {"tv": 1.0, "hot_tub": 1.0, "sauna": 0.0}
    assert got["accommodates"] == 2.0 and got["latitude"] == 42.0 and "price_year_avg" not in got


def test_bodies_are_parsed_once_with_reasons(spark):
    from roomrate.sources.json_io import decode_requests

    rows = [(1, '{"bedrooms": "x", "latitude": "y", "beds": 2, "own": [1]}'), (2, "{oops"), (3, "[1]"), (4, "{}"), (5, None),
            (6, '{"tv": null, "wifi": 0, "description": "d"}')]
    df = decode_requests(spark.createDataFrame(rows, "request_id long, body string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    got = {r.request_id: r for r in df.collect()}
    assert got[1].rejects == ["latitude", "bedrooms"] and got[1].beds == 2 and got[1].bedrooms == 1 and not got[1].is_valid
    assert got[2].rejects is None and got[3].rejects is None and got[5].rejects is None
    assert [got[i].is_valid for i in range(1, 7)] == [False, False, False, True, False, True]
    assert got[6].tv == 1 and got[6].wifi == 0 and got[6].description == "d"
