"""Property tests: distributed operators against brute force on small random fixtures."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from roomrate.operators.dedupe import keep_first
from roomrate.operators.encode import multi_hot, vocabulary
from roomrate.operators.neighbours import neighbour_fill
from roomrate.operators.profile import exact_quantiles
from roomrate.operators.split import stratified_split


def _points(seed, n=300):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lat = 40.7 + rnd.randint(0, 40) * 0.0005
        lon = -73.9 + rnd.randint(0, 40) * 0.0005
        x = None if rnd.random() < 0.25 else float(rnd.randint(0, 9))
        rows.append((i, rnd.choice("AB"), lat, lon, x))
    return rows


def _naive_fill(rows, round_result):
    out = {}
    for i, rt, la, lo, x in rows:
        if x is not None:
            out[i] = x
            continue
        vals = [x2 for _, rt2, la2, lo2, x2 in rows if rt2 == rt and la - 0.002 < la2 < la + 0.002
                and lo - 0.002 < lo2 < lo + 0.002 and x2 is not None]
        m = sum(vals) / len(vals) if vals else None
        out[i] = (float(np.round(m)) if round_result and m is not None else m)
    return out


def test_grid_fill_equals_naive(spark):
    for seed in (1, 2, 3):
        rows = _points(seed)
        df = spark.createDataFrame(rows, "id long, room_type string, latitude double, longitude double, x double")
        for rr in (False, True):
            got = {r.id: r.x for r in neighbour_fill(df, ["x"], round_result=rr).collect()}
            want = _naive_fill(rows, rr)
            for k in want:
                assert (got[k] is None and want[k] is None) or math.isclose(got[k], want[k], rel_tol=1e-12), (seed, k)


def test_fill_keeps_present_values(spark):
    rows = _points(7)
    df = spark.createDataFrame(rows, "id long, room_type string, latitude double, longitude double, x double")
    got = {r.id: r.x for r in neighbour_fill(df, ["x"], round_result=False).collect()}
    assert all(got[i] == x for i, _, _, _, x in rows if x is not None)


def test_keep_first_matches_python(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 20), rnd.randint(0, 5), i, rnd.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, o int, v double")
    want = {}
    for a, b, o, v in rows:
        if (a, b) not in want:
            want[(a, b)] = v
    for method in ("aggregate", "window"):
        got = {(r.a, r.b): r.v for r in keep_first(df, ["a", "b"], ["o"], ["v"], method=method).collect()}
        assert got == want


def test_exact_quantiles_match_numpy(spark):
    rnd = np.random.default_rng(3)
    x = np.concatenate([rnd.normal(size=997), [5.0] * 300])  # heavy tie at one value
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = {r.p: r.quantile for r in exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0]).collect()}
    for p, q in got.items():
        assert math.isclose(q, float(np.quantile(x, p)), rel_tol=1e-12, abs_tol=1e-12)


def test_stratified_split_exact_and_complete(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([0, 1, 1, 1, 2, 5])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, label int")
    out = stratified_split(df, "k", "label").collect()
    assert len(out) == 2000 and len({r.k for r in out}) == 2000
    for lab in {r[1] for r in rows}:
        n = sum(1 for r in rows if r[1] == lab)
        holdout = math.ceil(round(0.4 * n, 10))
        test = math.ceil(round(0.5 * holdout, 10))
        parts = [r.part for r in out if r.label == lab]
        assert parts.count("train") == n - holdout and parts.count("val") == holdout - test


def test_stratified_split_null_labels_and_repeated_keys(spark):
    rows = [(i, "a" if i % 2 else None) for i in range(100)] + [(7, "b")] * 50 + [(i, "b") for i in range(200, 250)]
    out = stratified_split(spark.createDataFrame(rows, "k long, label string"), "k", "label").collect()
    assert len(out) == len(rows) and all(r.part is None for r in out if r.label is None)
    # the copies of one key are never torn apart, though they are half of the label's rows
    assert len({r.part for r in out if r.k == 7 and r.label == "b"}) == 1
    parts = [r.part for r in out if r.label == "a"]
    assert (parts.count("train"), parts.count("val"), parts.count("test")) == (30, 10, 10)


def test_quantiles_of_a_value_held_by_a_third_of_all_rows(spark):
    from roomrate.operators.profile import describe, value_counts

    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.normal(size=2000) * 1e6, np.full(1000, 3.25), [1e300, -1e300, 0.0]])
    df = spark.createDataFrame([(float(v), float(int(v) % 7) if abs(v) < 1e9 else None) for v in x], "x double, y double")
    assert value_counts(df, ["x"]).where("value = 3.25").collect()[0]["n"] == 1000
    got = {r.column: r for r in describe(df, ["x", "y"]).collect()}
    for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
        assert math.isclose(got["x"][name], float(np.quantile(x, p)), rel_tol=1e-9)
    assert got["x"]["count"] == len(x) and got["y"]["count"] == len(x) - 2
    assert describe(df.limit(0), ["x"]).collect() == []


def test_category_codes_and_token_codes_have_no_ceiling(spark):
    from roomrate.operators.encode import category_codes, multi_hot_sets

    names = [f"c{i:05d}" for i in range(5000)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(9999, None)], "id int, c string")
    got = {r.id: r.c_code for r in category_codes(df, "c").collect()}
    assert got == {i: i for i in range(5000)} | {9999: -1}
    sets = [(i, [names[(7 * i + j) % 5000] for j in range(i % 4)] + [""] * (i % 2)) for i in range(5000)] + [(5001, None)]
    wide = spark.createDataFrame(sets, "id int, t array<string>")
    rank = {n: i for i, n in enumerate(sorted({x for _, s in sets[:-1] for x in s if x}))}
    out = {r.id: r.codes for r in multi_hot_sets(wide, "t", "codes").collect()}
    assert out == {i: sorted({rank[x] for x in s or [] if x}) for i, s in sets}


def test_multi_hot_refuses_tokens_that_are_columns(spark):
    import pytest

    df = spark.createDataFrame([(1, 3.0, ["beds", "tv"])], "id int, beds double, t array<string>")
    with pytest.raises(ValueError, match="beds"):
        multi_hot(df, "t")


def test_neighbour_fill_with_one_dense_cell(spark):
    rnd = random.Random(2)
    rows = [(i, "A", 40.7 + rnd.random() * 0.0004, -73.9 + rnd.random() * 0.0004, None if i % 3 == 0 else float(i)) for i in range(300)]
    rows += [(1000 + i, "A", 40.75 + i, -73.9, None) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, room_type string, latitude double, longitude double, x double")
    got, want = {r.id: r.x for r in neighbour_fill(df, ["x"], round_result=False).collect()}, _naive_fill(rows, False)
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or math.isclose(got[k], want[k], rel_tol=1e-12)) for k in want)


def test_multi_hot_row_sum_equals_distinct_tokens(spark):
    rows = [(1, ["a", "b", "b", ""]), (2, []), (3, ["c", "a"])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    df = df.withColumn("t", F.array_distinct(F.filter("t", lambda x: x != "")))
    vocab = vocabulary(df, "t")
    wide = multi_hot(df, "t", vocab, drop_tokens=False)
    for r in wide.collect():
        assert sum(r[v] for v in vocab) == len(r.t)
    assert vocab == ["a", "b", "c"]


def test_exploded_ngrams_match_python(spark):
    from roomrate import constants as K
    from roomrate.functions.text import exploded_ngrams

    rnd = random.Random(11)
    words = ["the", "room", "park", "a", "view", "of", "great", "big"]
    docs = [(i, [rnd.choice(words) for _ in range(rnd.randint(0, 12))]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id int, tokens array<string>")
    stop = set(K.ENGLISH_STOP_WORDS)
    for n in (2, 3):
        want = sorted((d, " ".join(t[i:i + n])) for d, t in docs for i in range(len(t) - n + 1)
                      if not any(w in stop for w in t[i:i + n]))
        got = sorted((r.doc_id, r.gram) for r in exploded_ngrams(df, "tokens", n, keep=["doc_id"]).collect())
        assert got == want
