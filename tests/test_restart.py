"""Streams that go on where they stopped, models that are published whole, stored tables that follow their input, wide correlations."""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomrate.operators import models as ML
from roomrate.operators.profile import correlation_matrix
from roomrate.session import shared_path
from roomrate.sources import model_store
from roomrate.sources.json_io import decode_requests
from roomrate.streaming.scoring import drained, reject_stream

SCHEMA = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("body", T.StringType())])


def _put(spark, folder, ids):
    rows = [(i, '{"accommodates": 2}' if i % 3 else '{"beds": "x"}' if i % 2 else "{oops") for i in ids]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _run(spark, base, poisoned=None):
    stream = spark.readStream.schema(SCHEMA).parquet(base + "/in")
    if poisoned is not None:  # a task that dies in the middle of a batch
        stream = stream.withColumn("body", F.when(F.col("request_id") == poisoned, F.raise_error(F.lit("lost"))).otherwise(F.col("body")))
    return drained(decode_requests(stream).select("request_id", "accommodates", "is_valid"), base + "/sink", base + "/checkpoint")


def test_stream_goes_on_and_gives_each_request_once(spark):
    base = shared_path(spark, "test-stream")
    _put(spark, base + "/in", range(0, 50))
    assert _run(spark, base).count() == 50
    assert _run(spark, base).count() == 50  # nothing new
    _put(spark, base + "/in", range(50, 80))
    with pytest.raises(Exception, match="lost|failed|terminated"):
        _run(spark, base, poisoned=60)
    got = _run(spark, base).collect()  # the killed batch is done again
    assert sorted(r.request_id for r in got) == list(range(80))
    _put(spark, base + "/in", range(80, 90))
    assert sorted(r.request_id for r in _run(spark, base).collect()) == list(range(90))


def test_dead_letters_go_on_too(spark):
    base = shared_path(spark, "test-dead")
    for part in (range(0, 30), range(30, 40)):
        _put(spark, base + "/in", part)
        dead = reject_stream(spark, base + "/in", "*.parquet", SCHEMA, lambda s: s, base + "/sink", base + "/checkpoint")
    got = {r.request_id: (r.reason, r.body) for r in dead.collect()}
    assert dead.count() == len(got)
    assert got == {i: ("beds", '{"beds": "x"}') if i % 2 else ("not a JSON object", "{oops") for i in range(0, 40, 3)}


def test_eight_saves_at_once_give_eight_models(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)], "a double, y double")
    model = ML.fit_regression(df, ["a"], "y", "lr")
    folder = shared_path(spark, "test-models")
    with ThreadPoolExecutor(8) as pool:
        paths = list(pool.map(lambda _: model_store.save_model(spark, model, "m", folder), range(8)))
    assert len(set(paths)) == 8 and f"{folder}/m_default" in paths
    assert all(model_store.load_model(p).transform(df).count() == 20 for p in paths)


def test_a_name_is_claimed_once(spark):
    path = shared_path(spark, "test-claims") + "/x.claim"
    with ThreadPoolExecutor(8) as pool:
        assert sorted(pool.map(lambda _: model_store.claimed(spark, path), range(8))) == [False] * 7 + [True]


def test_stored_tables_follow_their_input(spark):
    source = shared_path(spark, "test-source")
    spark.range(5).write.parquet(source)
    stored = lambda: model_store.stored_table(spark, "sum", source, lambda: spark.read.parquet(source).agg(F.sum("id").alias("s"))).first().s
    assert stored() == 10 and stored() == 10
    spark.range(5, 7).write.mode("append").parquet(source)
    assert stored() == 21


def test_correlations_of_140_columns_equal_corr(spark):
    rnd = random.Random(8)
    n, p = 300, 140
    rows = []
    for i in range(n):
        base = [rnd.gauss(0, 1) for _ in range(7)]
        rows.append([None if rnd.random() < 0.1 and c % 3 == 0 else 7.25 if c == 5 else 1e6 + base[c % 7] + 0.5 * rnd.gauss(0, 1) for c in range(p)])
    cols = [f"c{i}" for i in range(p)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(3)
    got = {(r.col_a, r.col_b): r.r for r in correlation_matrix(df, cols).collect()}
    assert len(got) == p * (p - 1) // 2 == 9730
    pairs = [(f"c{a}", f"c{b}") for a, b in [(0, 1), (0, 3), (3, 6), (9, 139), (2, 100), (7, 14), (21, 63)]]
    want = df.agg(*[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()
    assert all(math.isclose(got[a, b], want[f"{a}_{b}"], rel_tol=1e-7, abs_tol=1e-9) for a, b in pairs)
    assert all(r is None for (a, b), r in got.items() if "c5" in (a, b))
    assert {r.r for r in correlation_matrix(df.limit(0), cols[:3]).collect()} <= {None}


@pytest.mark.parametrize("margin", [0.004, 0.3, -0.2])
def test_quantiles_from_sketch_brackets_are_exact(spark, margin):
    """Also where the brackets are wide, and where they miss (a negative margin) and all values are taken."""
    import numpy as np

    from roomrate.operators.profile import exact_quantiles

    rnd = random.Random(6)
    x = [float(rnd.choice([1, 2, 2, 2, 3])) if rnd.random() < 0.4 else rnd.gauss(0, 1e6) for _ in range(6000)]
    y = [float(i % 7) if i % 11 else None for i in range(6000)]
    df = spark.createDataFrame([(a, b, 5) for a, b in zip(x, y, strict=True)], "x double, y double, z int").repartition(6)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r.column, r.p): r.quantile for r in exact_quantiles(df, ["x", "y", "z"], probs, margin).collect()}
    for name, values in (("x", x), ("y", [v for v in y if v is not None]), ("z", [5.0] * 6000)):
        for p in probs:
            assert math.isclose(got[name, p], float(np.quantile(values, p)), rel_tol=1e-12, abs_tol=1e-9), (name, p)
    assert len(got) == 21


def test_brackets_shuffle_few_of_the_values(spark):
    from roomrate.operators import profile as A

    df = spark.range(200_000).select((F.col("id") * 1.5).alias("x"))
    assert A.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75]).count() == 3
    base = shared_path(spark, "bracket-counts", unique=False)
    fs, path = model_store._located(spark, base)
    newest = max(fs.listStatus(path), key=lambda s: s.getModificationTime()).getPath().toString()
    assert spark.read.parquet(newest).count() < 0.03 * 200_000
