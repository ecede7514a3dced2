"""Token codes by a broadcast of frequent tokens and a join of the others; word tables that are written once."""

import random

from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from roomrate.operators import encode as E
from roomrate.operators import vectors as V


def _rows(n=400):
    rng = random.Random(5)
    common, rare = [f"c{i:02d}" for i in range(20)], [f"r{i:04d}" for i in range(2000)]
    rows = [(i, rng.sample(common, 12) + rng.sample(rare, i % 5) + [""] * (i % 2)) for i in range(n)]
    return rows + [(n, None), (n + 1, []), (n + 2, ["c03", "c03", "zz"]), (n + 3, rows[7][1]), (n + 4, [None, "c01"])]


def _expected(rows):
    rank = {t: i for i, t in enumerate(sorted({t for _, ts in rows for t in ts or [] if t}))}
    return rank, {i: sorted({rank[t] for t in ts or [] if t}) for i, ts in rows}


def test_frequent_tokens_are_the_most_used(spark):
    ranks = V.token_uses(spark.createDataFrame(_rows(), "id long, t array<string>"), "t")
    uses = {r.token: r.uses for r in ranks.collect()}
    some = {r.token for r in E.frequent(ranks, most=30).collect()}
    assert {f"c{i:02d}" for i in range(20)} <= some and len(some) <= 30
    assert min(uses[t] for t in some) > max(n for t, n in uses.items() if t not in some)
    assert E.frequent(ranks, most=0).count() == 0 and E.frequent(ranks, most=10**6).count() == len(uses)
    assert E.frequent(ranks.limit(0)).count() == 0


def test_codes_are_the_same_with_any_number_of_frequent_tokens(spark, monkeypatch):
    rows = _rows()
    rank, expected = _expected(rows)
    df = spark.createDataFrame(rows, "id long, t array<string>")
    ranks, frequent = V.token_uses(df, "t"), E.frequent
    assert {r.token: r["rank"] for r in ranks.collect()} == rank
    for most in (0, 25, E.FREQUENT):
        monkeypatch.setattr(E, "frequent", lambda codes, most=most: frequent(codes, most=most))
        for given, key in ((None, None), (None, "id"), (ranks, None), (ranks, "id")):
            got = {r.id: r.codes for r in E.multi_hot_sets(df, "t", "codes", given, key).collect()}
            assert got == expected, (most, given is None, key)


def test_uses_of_frequent_tokens_are_not_shuffled_by_token(spark):
    df = spark.createDataFrame(_rows(), "id long, t array<string>")
    ranks = V.token_uses(df, "t")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = E.multi_hot_sets(df, "t", "codes", ranks, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("BroadcastHashJoin") >= 2 and "sha2" not in plan


def test_word_vectors_are_written_once_and_without_words(spark, tmp_path):
    from roomrate.plans.queries_encode import word_vectors

    docs = [(1, "one two 2 two", 13), (1, "two three", 9), (None, "one", 3), (4, None, None), (5, "12 34", 5)]
    path = f"{tmp_path}/sf"
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{path}/documents.parquet")
    vectors, ranks = word_vectors(spark, path)
    assert vectors.columns == ["doc_id", "n_chars", "word_vector"] and ranks.columns == ["token", "rank"]
    assert {r.token: r["rank"] for r in ranks.collect()} == {"one": 0, "three": 1, "two": 2}
    got = sorted((r.doc_id or 0, r.n_chars or 0.0, r.word_vector.indices.tolist()) for r in vectors.collect())
    assert got == [(0, 3.0, [0]), (1, 9.0, [1, 2]), (1, 13.0, [0, 2]), (4, 0.0, []), (5, 5.0, [])]
    assert all(isinstance(r.word_vector, SparseVector) and r.word_vector.size == 3 for r in vectors.collect())
    files = vectors.select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("/tables/" in r.f for r in files)
