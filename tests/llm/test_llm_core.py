import random
import re
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from roomrate.llm import queries as Q

SF = "/root/testdata/sf0.001"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(d, low.get(root(i), d))
    return sorted((d, len(s), low[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 9, 14, 30, 60, 200]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((" ".join(copy)).title() if rng.random() < .3 else "\t".join(copy))
    rows += [None, "", "  \n", "ü é", "ü é", "x" * 3000]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,k,num,family", [(1, 4, 85, 10**6), (2, 5, 80, 10**6), (3, 2, 60, 10**6), (4, 4, 85, 100), (5, 2, 70, 0)])
def test_near_components_equal_brute_force(spark, seed, k, num, family):
    from roomrate.llm.ngram_jaccard import near_components

    rows = near_corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("tile", F.lit("x"))
    got = sorted(map(tuple, near_components(df, k, num, 100, family=family).collect()))
    assert got == components(rows, k, num, 100)


def test_near_components_on_the_table(spark):
    got = sorted(map(tuple, Q.op1_ngram_jaccard(spark, SF).collect()))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got == components(rows, 4, 85, 100)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_connected_equals_union_find(spark, seed):
    from roomrate.llm.components import connected

    rng = random.Random(seed)
    n = 300
    shapes = {1: [(rng.randrange(n), rng.randrange(n)) for _ in range(220)],
              2: [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 3000) for i in range(50)],
              3: [(5, 5), (7, 6), (6, 7)] + [(i, 2 * i) for i in range(1, n)]}
    links = shapes[seed]
    up = {x: x for e in links for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_links_of_a_large_family_fall_to_one_each(spark):
    """Near copies of 300 words meet in many tiles: the joins of the components see few links a set."""
    from roomrate.llm import components as C
    from roomrate.llm import ngram_jaccard as J

    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(1500):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "id long, text string").repartition(8)
    sets = J.document_sets(df, 5, bits=True).selectExpr("id c", "n", "s1", "bits")
    members = J.document_tiles(df, 5, 80, 100).join(sets.select("s1", "c", "n"), "s1").select("tile", "c", "n").distinct()
    links = C.written(J.tile_links(members, sets.select("c", "bits"), 80, 100), "test-links")
    edges = C.starred(C.ordered(links))
    assert edges.count() < 2 * len(rows)
    assert {r.component for r in C.connected(links).collect()} == {0}


def test_near_components_edges(spark):
    from roomrate.llm.ngram_jaccard import near_components

    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_components(empty).collect() == []
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (2, "A B C D E F"), (9, None)]
    got = near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(2, 2), (5, 2), (5, 2), (9, 9)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_chain_of_near_copies_reaches_the_smallest_id(spark):
    from roomrate.llm.ngram_jaccard import near_components

    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(30):
        words[3 * i] = f"new{i}"
        rows.append((100 - i, " ".join(words)))
    got = near_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert sorted(map(tuple, got)) == components(rows, 4, 85, 100)
    assert len({r.component_id for r in got}) == 1


def test_language_id(spark):
    from roomrate.llm.language_id import predicted, train

    got = {r.doc_id: r for r in Q.op2_language_id(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [d for d, r in got.items() if r.held_out]
    assert len(got) == len(truth) and 0.2 < len(held) / len(got) < 0.5
    assert sum(got[d].lang_pred == truth[d] for d in held) / len(held) > 0.9
    df = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et la maison", "fr"), (3, None, "en"), (4, "123 !", None),
                                (None, "the dog", None), (6, "", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    out = {r.doc_id: (r.lang_pred, r.score) for r in predicted(df, train(df, F.lit(True))).collect()}
    assert out[1][0] == "en" and out[2][0] == "fr" and out[None][0] == "en"
    assert out[3] == out[4] == out[6] == ("und", 0.0)
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert predicted(none, train(none, F.lit(True))).first().lang_pred == "und"
    assert predicted(none.limit(0), train(none, F.lit(True))).collect() == []


def test_language_id_equals_plain_naive_bayes():
    import numpy as np

    from roomrate.llm import language_id as L

    rng = np.random.default_rng(1)
    logp = np.log(rng.random((L.BUCKETS, 3)))
    texts = ["Ab c", "Zürich 12", None, "a", "x y z " * 40]
    best, score = L.scored(texts, ["a", "b", "c"], logp)
    for t, b, s in zip(texts, best, score):
        c = L.cleaned(t)
        if not c:
            assert (b, s) == ("und", 0)
            continue
        total = np.zeros(3)
        for o in L.ORDERS:
            for i in range(len(c) - o + 1):
                total += logp[L.hashed(np.array([ord(x) for x in c[i: i + o]], np.uint32), o)[0]]
        p = np.exp(total - total.max())
        assert b == "abc"[total.argmax()] and abs(s - (p / p.sum()).max()) < 1e-9


def contaminated_corpus(seed):
    rng = random.Random(seed)
    v = [f"w{i}" for i in range(40)] + ["é1", "x"]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([1, 2, 5, 9, 10, 12, 30])))) for i in range(20)]
    items += [(100, None), (101, "--"), (102, items[3][1])]
    docs = []
    for d in range(60):
        w = [rng.choice(v) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(items)[1]
            theirs = (t or "").split()
            lo = rng.randrange(len(theirs) + 1)
            w[rng.randrange(len(w) + 1):0] = theirs[lo: lo + rng.randint(5, 14)] if rng.random() < .5 else theirs
        docs.append((d, (", " if rng.random() < .5 else " ").join(w).upper()))
    return docs + [(98, None), (99, "")], items


@pytest.mark.parametrize("seed,bits", [(1, 1 << 24), (2, 64)])
def test_decontamination_equals_brute_force(spark, seed, bits):
    from roomrate.llm.decontaminate import brute_force, contamination, digest

    docs, items = contaminated_corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(0))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit("x"))
    got = {r.doc_id: r for r in digest(contamination(d, b, bits=bits)).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        n, hit, found, sha = brute_force(t, items)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), sha, hit > 0), i
    from roomrate.llm.decontaminate import without_contaminated

    clean = {i for i, t in docs if not brute_force(t, items)[1]}
    assert {r.doc_id for r in without_contaminated(d, b, bits=bits).collect()} == clean
    assert all(r.n_hit == 0 for r in digest(contamination(d, b.limit(0))).collect())
    assert digest(contamination(d.limit(0), b)).collect() == []


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_decontamination_tells_rows_with_null_and_repeated_ids_apart(spark, bits):
    from collections import Counter

    from roomrate.llm.decontaminate import brute_force, contamination, digest, without_contaminated

    docs, items = contaminated_corpus(3)
    clean = " ".join(f"z{i}" for i in range(30))
    hit = next(t for _, t in docs if brute_force(t, items)[1])
    same = clean + " z30" * (len(hit.split()) - 30)  # as many words as hit, if that has 30 or more
    docs = [(None if i % 3 else 7, t) for i, t in docs] + [(None, clean), (7, clean), (7, same), (None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                  for r in digest(contamination(d, b, bits=bits)).collect())
    want = [(i, *brute_force(t, items)) for i, t in docs]
    assert got == Counter((i, n, h, len(found), sha, h > 0) for i, n, h, found, sha in want)
    left = Counter(tuple(r) for r in without_contaminated(d, b, bits=bits).collect())
    assert left == Counter(row for row, w in zip(docs, want) if not w[2])


def test_decontamination_of_a_phrase_in_all_items_and_of_long_texts(spark):
    from roomrate.llm.decontaminate import brute_force, contamination, digest

    phrase = " ".join(f"p{i}" for i in range(14))
    items = [(i, f"a{i} b{i} {phrase} c{i}") for i in range(60)] + [(60, "the"), (61, "Ü2 two")]
    docs = [(i, f"x{i} y {phrase} z") for i in range(200)] + [(200, f"{phrase} q " * 2000), (201, "m " * 300_000 + "the Ü2 Two"), (202, "n " * 40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in digest(contamination(d, b)).collect()}
    for i in (0, 199, 202):
        n, hit, found, sha = brute_force(docs[i][1], items)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (n, hit, len(found), sha)
    assert (got[200].n_words, got[200].n_hit, got[200].n_items) == (30_000, 28_000, 60)
    assert (got[201].n_words, got[201].n_hit, got[201].n_items) == (300_003, 3, 2)


def test_decontamination_on_the_table(spark):
    from roomrate.llm.decontaminate import brute_force

    got = {r.doc_id: r for r in Q.op10_decontaminate(spark, SF).collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n, hit, found, sha = brute_force(r.text, items)
        assert (got[r.doc_id].n_words, got[r.doc_id].n_hit, got[r.doc_id].items_sha256) == (n, hit, sha)


def test_sharding(spark):
    import zlib

    from roomrate.llm.sharding import sharded

    rows = [(i, f"text {i % 50}" * (i % 3)) for i in range(4000)] + [(None, "x"), (None, None), (7, "text 7")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(1)).withColumn("slot", F.lit(1))
    got = sharded(df, [1.0, 1.0, 2.0], 4.0).collect()
    assert len(got) == len(rows)
    share = [sum(r.shard == s for r in got) / len(got) for s in range(3)]
    assert abs(share[2] - 0.5) < 0.05 and abs(share[0] - 0.25) < 0.05
    assert all(r.grown_shard in (r.shard, 3) for r in got) and abs(sum(r.grown_shard == 3 for r in got) / len(got) - 0.5) < 0.05
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    texts = dict(rows[:4000])
    for r in got:
        if r.doc_id and r.doc_id != 7:
            raw = texts[r.doc_id].encode()
            assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
    assert sharded(df.limit(0)).collect() == []


def fluid(t, blocks, weights):
    """Blocks of each source after t slots of the fluid schedule."""
    left, had = dict(blocks), dict.fromkeys(blocks, Fraction(0))
    t = Fraction(t)
    while t > 0 and any(had[s] < blocks[s] for s in blocks):
        active = {s: weights[s] for s in blocks if had[s] < blocks[s]}
        whole = sum(active.values())
        step = min(min((blocks[s] - had[s]) / w for s, w in active.items()), t / whole)
        for s, w in active.items():
            had[s] += step * w
        t -= step * whole
    return had


def test_pfair_deviation():
    from roomrate.llm.mixing import given, turns

    rng = random.Random(4)
    for _ in range(40):
        weights = {f"s{i}": Fraction(rng.randint(1, 40), rng.choice([1, 1, 3])) for i in range(rng.randint(1, 9))}
        blocks = {s: rng.randint(0, 25) for s in weights}
        had = dict.fromkeys(weights, 0)
        order = turns(blocks, weights)
        assert len(order) == sum(blocks.values())
        for t, (s, j, release, deadline, slot) in enumerate(order, 1):
            assert slot == t - 1 and release <= slot < deadline and j == had[s]
            had[s] += 1
            ideal = fluid(t, blocks, weights)
            assert all(abs(had[x] - ideal[x]) < 1 for x in weights)
        assert had == blocks
    one = {s: Fraction(1) for s in "abcd"}
    assert given({"a": 100, "b": 100, "c": 100, "d": 1}, one) == {"a": 100, "b": 100, "c": 100, "d": 1}  # a tiny source costs nothing
    assert given({"a": 900, "b": 100, "c": 100, "d": 100}, one) == {"a": 100, "b": 100, "c": 100, "d": 100}  # a hot one gives its share
    assert given({"a": 700, "b": 100}, {"a": Fraction(6), "b": Fraction(1)}) == {"a": 700, "b": 100}


def test_fifty_thousand_sources(spark):
    from roomrate.llm.mixing import scheduled

    df = spark.range(120_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40_000, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 50_000)).alias("source"))
    got = scheduled(df, {"big": 20_000}, 1).agg(F.count("*"), F.count_if("in_mix"), F.countDistinct("slot"), F.max("slot")).first()
    assert got[0] == 120_000 and got[1] == 120_000 and got[2] == got[3] + 1


def test_mixing(spark):
    from roomrate.llm.mixing import mixed, scheduled

    rows = [(i, "a" if i % 3 else "b" if i % 2 else None) for i in range(1200)] + [(5000, "tiny")] * 2 + [(None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("block", F.lit(1)).withColumn("w", F.lit(2))
    got = scheduled(df, {"a": 2, "b": 1, None: 1, "tiny": 0}, block_rows=4).collect()
    assert len(got) == len(rows)
    mix = [r for r in got if r.in_mix]
    slots = sorted({r.slot for r in mix})
    assert slots == list(range(len(slots))) and len(mix) == 800 and len(slots) == 200  # then a alone, half of the weight, would be left
    assert all(r.slot is None and not r.in_mix for r in got if r.source == "tiny")
    assert [sum(r.source == s for r in mix) for s in ("a", "b", None)] == [400, 200, 200]
    assert all(r.release <= r.slot < r.deadline for r in mix)
    more = scheduled(df, {"a": 2, "b": 1, None: 1, "tiny": 1}, block_rows=4).collect()
    assert [sum(r.source == s and r.in_mix for r in more) for s in ("a", "b", None, "tiny")] == [400, 200, 200, 2]
    wide = scheduled(df, {}, block_rows=4, slots=20).collect()  # larger blocks where rows are many
    assert len({r.slot for r in wide if r.in_mix}) <= 20 + 4
    had = {}
    for t, s in enumerate(sorted({(r.slot, r.source) for r in mix}), 1):
        had[s[1]] = had.get(s[1], 0) + 1
        assert abs(had.get("a", 0) - t / 2) < 1 and abs(had.get("b", 0) - t / 4) < 1
    assert {r.doc_id for r in mixed(df, {"a": 2, "tiny": 0}, 1, 4).collect()} <= {r[0] for r in rows}
    assert scheduled(df.limit(0), {}).collect() == []


def test_query_and_stage_mix_to_the_target_weights(spark, tmp_path):
    import corpus_pipeline as P
    from roomrate.llm.mixing import DEFAULT_TARGET, TARGETS

    own = {"src0": 700, "src1": 100, "src2": 160, "src3": 120}  # no share is its target
    rows = [(i, "words", s) for i, s in enumerate(s for s, n in own.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    # src1 is used up first and bounds no other; with src0 most of the weight is gone, after 700 / 6 rounds
    want = {"src0": 700, "src1": 100, "src2": 116, "src3": 116}
    assert TARGETS.get("src0") == 6 and DEFAULT_TARGET == 1
    mix = [r.source for r in Q.op5_mixing(spark, str(tmp_path)).collect() if r.in_mix]
    assert {s: mix.count(s) for s in own} == want
    kept = [r.source for r in P.mix(spark, df, str(tmp_path)).collect()]
    assert {s: kept.count(s) for s in own} == want
