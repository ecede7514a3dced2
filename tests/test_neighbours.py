"""Box sums in dense areas: equal to the naive sums, with work that hardly grows with the density."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from roomrate.operators import neighbours as N

HALF = 0.002
SCHEMA = "id long, room_type string, latitude double, longitude double, x double, z double"


def _points(n, seed, side=0.01, kinds=("A", "A", "B")):
    rnd = random.Random(seed)
    grid = [40.7 + HALF * i / 2 for i in range(8)]  # coordinates that lie on each other's box edges
    rows = []
    for i in range(n):
        lat = rnd.choice(grid) if rnd.random() < 0.3 else 40.7 + side * rnd.random() ** 2
        lon = -73.9 + (HALF * rnd.randrange(6) / 2 if rnd.random() < 0.3 else side * rnd.random())
        rows.append((i, rnd.choice(kinds), lat, lon, None if rnd.random() < 0.3 else float(rnd.randrange(9)), rnd.choice([None, 0.5, 1.5])))
    return rows + rows[: n // 10] + [(-1, None, 40.7, -73.9, 1.0, 1.0), (-2, "A", None, -73.9, 1.0, 1.0)]


def _naive(rows):
    out = {}
    for _, c, lat, lon, x, _ in rows:
        if None in (c, lat, lon) or x is not None:
            continue
        near = [r for r in rows if r[1] == c and r[2] is not None and lat - HALF < r[2] < lat + HALF and lon - HALF < r[3] < lon + HALF]
        out[c, lat, lon] = tuple((sum(r[k] for r in near if r[k] is not None), sum(r[k] is not None for r in near)) for k in (4, 5))
    return out


@pytest.mark.parametrize("leaf", [1, 4, 16, 64])
def test_box_sums_equal_naive_sums(spark, leaf):
    rows = _points(700, leaf)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = N.neighbour_sums(df, ["x", "z"], F.col("x").isNull(), leaf=leaf).collect()
    want = _naive(rows)
    assert {(r.room_type, r.latitude, r.longitude) for r in got} == set(want)
    for r in got:
        (sx, nx), (sz, nz) = want[r.room_type, r.latitude, r.longitude]
        assert (r._n_x, r._n_z) == (nx, nz) and math.isclose(r._s_x, sx, abs_tol=1e-9) and math.isclose(r._s_z, sz, abs_tol=1e-9)


def test_work_for_a_box_hardly_grows_with_the_density(spark):
    def work(n):
        rnd = random.Random(n)
        rows = [(i, "A", 40.7 + 0.008 * rnd.random(), -73.9 + 0.008 * rnd.random(), None if i % (n // 200) == 0 else 1.0, 1.0) for i in range(n)]
        coords = (spark.createDataFrame(rows, SCHEMA).groupBy("room_type", "latitude", "longitude")
                  .agg(F.sum("x").alias("_s_x"), F.count("x").alias("_n_x"), F.max(F.col("x").isNull()).alias("_probe")))
        points, boxes = N._tiled(N.written(coords, "test-coords"), "room_type", "latitude", "longitude", HALF, HALF)
        ranked, lookups = N._dense_lookups(points, boxes, N.LEAF)
        blocks, ends = N._dense_sums(ranked, lookups, ["_s_x", "_n_x"], N.LEAF)
        return (blocks.count() + ends.count()) / 200, N._compared(points, boxes).count() / 200

    (few, few_naive), (many, many_naive) = work(2_000), work(20_000)
    assert many_naive > 8 * few_naive
    assert many < 2 * few and many < many_naive / 5


def test_running_sums_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
                                  F.col("id").alias("o"), F.lit(2).alias("v"))
    got = N.running_sums(df, "g", ["o"], ["v"]).collect()
    assert len(got) == 5000
    seen: dict = {}
    for r in sorted(got, key=lambda r: r.o):
        assert r.v == seen.get(r.g, 0)
        seen[r.g] = r.v + 2
