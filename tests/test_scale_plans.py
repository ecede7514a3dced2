"""Plan-level properties that matter at scale (checked on small inputs)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from conftest import SMALL_SF
from roomrate.operators.dedupe import keep_first
from roomrate.operators.periods import period_averages
from roomrate.operators.profile import exact_quantiles
from roomrate.plans import calendar as C1
from roomrate.plans.common import calendar
from roomrate.sources.bindings import CALENDAR_ORDER


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keep_first_combines_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("o"), F.col("id").alias("v"))
    plan = _plan(keep_first(df, ["k"], ["o"], ["v"]))
    assert "partial_min_by" in plan
    assert plan.index("Exchange") < plan.rindex("partial_min_by")  # partial below the exchange


def test_calendar_filter_reaches_the_scan(spark):
    plan = C1.calendar_features(calendar(spark, SMALL_SF), CALENDAR_ORDER)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters: [Not(EqualNullSafe(l_partkey" in plan or "Not(EqualNullSafe(l_partkey" in plan


def test_hot_key_with_copies_is_exact(spark):
    """One (listing, day) holds a third of all rows as copies; results equal plain Python."""
    day = dt.date(2019, 7, 1)
    hot = [(1, day, i, 1, 50.0 + i, 2.0) for i in range(2000)]
    rest = [(2 + i % 50, dt.date(2019, 1 + i % 12, 1 + i % 28), i, i % 2, 30.0 + i % 100, 1.0 + i % 5)
            for i in range(4000)]
    df = spark.createDataFrame(hot + rest, "listing_id long, date date, o long, available int, price double, "
                                           "minimum_nights double")
    first = keep_first(df, ["listing_id", "date"], ["o"], ["available", "price", "minimum_nights"])
    got = {(r.listing_id, r.date): r.price for r in first.collect()}
    want = {}
    for lid, d, o, _a, p, _m in sorted(hot + rest, key=lambda t: t[2]):
        want.setdefault((lid, d), p)
    assert got == want
    feats = {r.listing_id: r.price_summer_avg for r in period_averages(first, "listing_id").collect()}
    assert feats[1] == 50.0


def test_listings_grow_with_the_table(spark):
    """Coordinates come from growing districts: rows kept and neighbours per row do not depend on the scale."""
    from roomrate.plans.queries_encode import q_band_join, q_listing_dedupe

    kept, around = [], []
    for sf in ("sf0.001", "sf0.01"):
        path = SMALL_SF.replace("sf0.001", sf)
        parts = spark.read.parquet(f"{path}/part.parquet").count()
        kept.append(q_listing_dedupe(spark, path).count() / parts)
        around.append(q_band_join(spark, path).agg(F.avg("n_neighbours")).first()[0])
    assert all(k > 0.6 for k in kept) and kept[1] > 0.6 * kept[0] and around[1] < 2 * around[0]


def test_exact_quantiles_never_use_exact_percentile(spark):
    df = spark.range(5000).select((F.col("id") * 1.0).alias("x"))
    # the selection runs distributed jobs; the result frame is tiny and the input is never
    # aggregated by Spark's exact percentile (whose buffer holds every distinct value)
    out = exact_quantiles(df, ["x"], [0.5])
    assert out.first().quantile == 2499.5
    assert "percentile(" not in _plan(out)


def test_band_pairs_broadcast_neither_side(spark):
    """Both sides are far below the broadcast threshold here; at scale packed files look that small too."""
    from roomrate.operators.neighbours import band_pairs

    rows = spark.createDataFrame([(1, "a", 40.0, -73.0), (2, "a", 40.001, -73.001), (3, "b", 40.0, -73.0), (4, "a", 40.0, None)],
                                 "id long, room_type string, latitude double, longitude double")
    pairs = band_pairs(rows, rows, "room_type", "latitude", "longitude", 0.002, 0.002).where("id <> r_id")
    assert "BroadcastExchange" not in _plan(pairs)
    assert sorted((r.id, r.r_id) for r in pairs.collect()) == [(1, 2), (2, 1)]


def test_fits_take_no_more_partitions_than_cores(spark):
    from roomrate.operators.models import training_rows

    rows = spark.range(0, 200, 1, 50).withColumn("y", F.col("id") * 1.0)
    assert training_rows(rows, "y").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < 50


def test_deep_forests_keep_the_nodes_of_rows(spark):
    from roomrate.operators.models import regressor

    forest = regressor("rf")
    assert forest.getCacheNodeIds() and forest.getMaxMemoryInMB() > 256 and forest.getMaxDepth() == 30 and forest.getNumTrees() == 100


def test_few_labels_split_without_a_shuffle_of_the_rows(spark):
    """Cut points and ties are tables of known size, so a label that holds most rows is not one task."""
    from roomrate.operators.split import stratified_split

    rows = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    parts = stratified_split(rows, "k", "y")
    assert "SortMergeJoin" not in _plan(parts) and "Exchange hashpartitioning" not in _plan(parts)
    assert {(r.y, r.part): r["count"] for r in parts.groupBy("y", "part").count().collect()} == {
        (0, "train"): 216, (0, "val"): 72, (0, "test"): 72, (1, "train"): 24, (1, "val"): 8, (1, "test"): 8}


def test_six_segments_fit_at_once(spark, monkeypatch):
    """Boosted fits of all segments are under way together: each waits here until the six have begun."""
    from threading import Barrier

    from roomrate.operators import models as ML

    begun = Barrier(6, timeout=20)

    class Metrics:
        @staticmethod
        def first():
            return {"n": 1, "r2": 0.0, "mae": 0.0}

    monkeypatch.setattr(ML, "fit_regression", lambda rows, features, label, kind, **_: kind == "gbt" and begun.wait())
    monkeypatch.setattr(ML, "evaluate", lambda *_: Metrics)
    rows = spark.range(4).withColumn("is_test", F.col("id") > 2)
    told = ML.compare_models({f"s{i}": rows for i in range(6)}, lambda d: ["id"], "id")
    assert sorted(r[:2] for r in told) == sorted((k, f"s{i}") for k in ("lr", "rf", "gbt") for i in range(6))


def _price_rows(spark, n=300, parts=8):
    return (spark.range(0, n, 1, parts).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
            .withColumn("y", F.col("a") * 3 + F.col("b") + (F.col("id") % 3)))


def test_forests_grow_in_groups_that_the_driver_can_hold(spark, monkeypatch):
    """Nodes of all trees are never held at once; all trees are there, every row's prediction is the mean over all of them, and
    the stored forest scores as the fitted one."""
    from pyspark.ml import PipelineModel
    from roomrate.operators import models as ML
    from roomrate.session import shared_path
    from roomrate.sources.model_store import stored_model

    rows = _price_rows(spark)
    monkeypatch.setattr(ML, "FOREST_NODES", 1200)
    source = shared_path(spark, "forest-source")
    rows.write.parquet(source)
    fitted = ML.fit_regression(rows, ["a", "b"], "y", "rf", numTrees=9)
    assert sum(trees for _, trees, _ in fitted.groups) == 9 and len(fitted.groups) > 1
    assert all(nodes <= 1200 for _, _, nodes in fitted.groups)
    plain = [(PipelineModel.load(path).transform(rows).orderBy("id").collect(), trees) for path, trees, _ in fitted.groups]
    assert len({str([r.prediction for r in part]) for part, _ in plain}) == len(plain)  # groups draw rows of their own
    want = [sum(part[i].prediction * trees for part, trees in plain) / 9 for i in range(300)]
    got = fitted.transform(rows).orderBy("id").collect()
    assert max(abs(r.prediction - w) for r, w in zip(got, want, strict=True)) < 1e-9
    monkeypatch.setattr(ML, "FOREST_NODES", 1)  # every group is loaded alone, sums between them are written
    stored = stored_model(spark, "grouped", source, lambda: fitted)
    again = stored_model(spark, "grouped", source, lambda: 1 / 0).transform(rows).orderBy("id").collect()
    assert [r.asDict() for r in stored.transform(rows).orderBy("id").collect()] == [r.asDict() for r in again]
    assert max(abs(r.prediction - w) for r, w in zip(again, want, strict=True)) < 1e-9
    assert set(again[0].asDict()) == {"id", "a", "b", "y", "prediction"}


def test_groups_of_trees_hold_every_tree():
    from roomrate.operators.models import group_sizes

    assert group_sizes(97, 1000, 6) == [[17, 16, 16, 16, 16, 16]]
    assert group_sizes(7, 3, 2) == [[2, 1], [2, 1], [1]]
    assert group_sizes(2, 0, 4) == [[1], [1]] and group_sizes(0, 5, 4) == []


def test_small_forests_are_one_fit(spark):
    from pyspark.ml import PipelineModel
    from roomrate.operators import models as ML

    model = ML.fit_regression(_price_rows(spark), ["a", "b"], "y", "rf", numTrees=5)
    assert isinstance(model, PipelineModel) and model.stages[-1].getNumTrees == 5


def test_tree_fits_read_rows_written_once(spark, monkeypatch):
    """Tasks of the many jobs of a boosted fit carry a scan of two columns, in one task for each TASK_ROWS rows."""
    from pyspark.ml.feature import VectorAssembler
    from roomrate.operators import models as ML

    rows = _price_rows(spark).where("id % 2 = 0")
    assembler = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    fit, n = ML.tree_rows(rows, assembler, "y")
    assert n == 150 and fit.columns == ["features", "label"] and fit.rdd.getNumPartitions() == 1 and "Range" not in _plan(fit)
    assert sorted((*r.features, r.label) for r in fit.collect()) == sorted((r.a, r.b, r.y) for r in rows.collect())
    monkeypatch.setattr(ML, "TASK_ROWS", 50)
    assert ML.tree_rows(rows, assembler, "y")[0].rdd.getNumPartitions() == 3


def test_tree_fits_of_no_rows_fail_as_before(spark):
    import pytest
    from roomrate.operators import models as ML

    for kind in ("gbt", "rf"):
        with pytest.raises(Exception, match="(?i)empty|size 0"):
            ML.fit_regression(_price_rows(spark).where("id < 0"), ["a", "b"], "y", kind, maxIter=2, numTrees=2)
