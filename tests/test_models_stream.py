"""Model sanity (beats a mean predictor on data with known signal), save/load, batch = stream."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from conftest import SMALL_SF
from roomrate.operators import models as ML
from roomrate.session import shared_path
from roomrate.sources import model_store
from roomrate.sources.bindings import requests_from_events
from roomrate.sources.json_io import decode_requests
from roomrate.sources.tables import read_table


def _signal(spark, n=600):
    rnd = random.Random(1)
    rows = []
    for i in range(n):
        a, b = rnd.random(), rnd.random()
        rows.append((i, a, b, 100 * a + 20 * b * b + rnd.gauss(0, 1)))
    return spark.createDataFrame(rows, "id long, a double, b double, y double")


def test_gbt_beats_mean(spark):
    df = _signal(spark)
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    model = ML.fit_regression(train, ["a", "b"], "y", "gbt", maxIter=20, maxDepth=4)
    m = ML.evaluate(model, test, "y").first()
    assert m.r2 > 0.8


def test_model_save_never_overwrites(spark):
    df = _signal(spark, 100)
    model = ML.fit_regression(df, ["a", "b"], "y", "lr")
    folder = shared_path(spark, "test_models")
    p1 = model_store.save_model(spark, model, "m", folder)
    p2 = model_store.save_model(spark, model, "m", folder)
    assert p1.endswith("m_default") and p1 != p2
    loaded = model_store.load_model(p2)
    assert loaded.transform(df).count() == 100


def test_decode_batch_equals_stream(spark):
    events = read_table(spark, SMALL_SF, "events")
    batch = decode_requests(requests_from_events(events))
    stream = (spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SMALL_SF))
    base = shared_path(spark, "test_stream")
    q = (decode_requests(requests_from_events(stream)).writeStream.format("parquet")
         .option("path", base + "/sink").option("checkpointLocation", base + "/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(base + "/sink")
    assert got.count() == batch.count()
    agg = lambda d: d.agg(F.sum("accommodates"), F.sum(F.col("is_valid").cast("int"))).first()
    assert agg(got) == agg(batch)
