"""Quality classifier, periodic runs and Merkle manifest against plain versions of their contracts."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from roomrate.llm import queries as Q
from roomrate.sources.tables import read_table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def crc(x):
    return zlib.crc32(str(x).encode())


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


# --- periodic runs ----------------------------------------------------------------------------------------

def plain_runs(w, least, times):
    """Every maximal stretch of every period, kept if no smaller period holds in it."""
    found = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            stretch = w[i: j + q]
            if j > i and len(stretch) >= max(least, times * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                found.add((i, len(stretch), q))
            i = j + 1 if j > i else i + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and crc(doc_id) % 10 == 0 and w:
        n, g = len(w), crc(doc_id) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 24, 3)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = (None,) * 4
    if runs:
        top = max(n / q for _, n, q in runs)
        s, n, q = next(r for r in runs if r[1] / r[2] == top)
        best = (s, n, q, 1000 * n // q)
    return (doc_id, len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


@pytest.mark.parametrize("least, times", [(24, 3), (6, 2), (4, 3), (5, 2)])
def test_runs_of_a_sequence_equal_plain_runs(least, times):
    from roomrate.llm.periodic_runs import runs_of

    rng = random.Random(least * times)
    seen = 0
    for _ in range(400):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(3)):
            a, p = rng.randrange(len(w) + 1), rng.randrange(1, 12)
            for i in range(a, min(len(w), a + rng.randrange(60))):
                w[i] = w[a + (i - a) % p]
        want = plain_runs(w, least, times)
        assert runs_of(np.array(w, np.int64), least, times) == want
        seen += len(want)
    assert seen > 30


def test_runs_of_long_sequences():
    from roomrate.llm.periodic_runs import runs_of

    assert runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert runs_of(np.arange(90_000) % 30_000) == [(0, 90_000, 30_000)]
    assert runs_of(np.arange(89_999) % 30_000) == []
    many = np.concatenate([np.tile(np.arange(k, k + 5), 40) for k in range(0, 5000, 5)])
    assert runs_of(many) == [(i * 200, 200, 5) for i in range(1000)]


def test_periodic_runs_equal_plain_version(spark):
    from roomrate.llm.periodic_runs import periodic_runs

    rng = random.Random(7)
    rows = [(None, "a " * 40), (1, None), (2, ""), (3, "a b c " * 8), (3, "a b c " * 8), (4, "a b c " * 7 + "a b"), (5, " x\x1fy " * 30), (6, "é\tü\n" * 20)]
    for d in range(10, 130):
        words = [f"w{rng.randrange(8)}" for _ in range(rng.randrange(200))]
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(words + words[-7:] * rng.randrange(6))))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit("x"), "runs": F.lit(1)})
    got = [tuple(r)[:1] + tuple(r)[2:9] for r in periodic_runs(df).collect()]
    assert sorted(got, key=repr) == sorted((plain_row(*r) for r in rows), key=repr)
    assert periodic_runs(df.where("false")).count() == 0
    long = periodic_runs(df.where("doc_id = 3").limit(1).withColumn("text", F.repeat("text", 20_000))).first()
    assert (long.n_runs, long.length, long.period) == (1, 480_000, 3)


def test_periodic_runs_of_the_table(spark):
    got = {tuple(r) for r in Q.op12_periodic_runs(spark, SF).drop("n_words").collect()}
    docs = read_table(spark, SF, "documents").select("doc_id", "text").collect()
    assert got == {plain_row(r.doc_id, r.text) for r in docs if len(r.text) < 6000} | {g for g in got if g[0] in {r.doc_id for r in docs if len(r.text) >= 6000}}
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got) >= 10


# --- Merkle manifest --------------------------------------------------------------------------------------

def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars)."""
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, more=0):
        d, text, lang, source, n = r
        return sha("".join(map(enc, (d, source, lang, n if n is None else n + more, text))))

    def tree(nodes):
        """(top, for each leaf its siblings and sides)"""
        ways, place = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for way, p in zip(ways, place, strict=True):
                way.append((p % 2, nodes[p ^ 1] if p ^ 1 < len(nodes) else None))
            nodes = [sha("".join(nodes[i: i + 2])) for i in range(0, len(nodes), 2)]
            place = [p // 2 for p in place]
        return nodes[0], ways

    def order(v):
        return (v is not None, v)

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    subs, out = [], []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (order(r[0]), leaf(r)))
        subs.append((own, *tree([leaf(r) for r in own])))
    root, tops = tree([s[1] for s in subs]) if subs else (None, [])
    for (own, sub, ways), top in zip(subs, tops, strict=True):
        for r, way in zip(own, ways, strict=True):
            now = leaf(r, 1 if r[0] is not None and crc(r[0]) % 7 == 0 else 0)
            for side, other in way + top:
                now = sha(now if other is None else other + now if side else now + other)
            proof = sha("".join(other for _, other in way + top if other is not None))
            out.append((r[0], leaf(r), sub, root, proof, now, now == root))
    return out


def some_documents(n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, d, d, d, 5]), rng.choice([None, "", "text", "tëxt é " * rng.randrange(9)]),
             rng.choice([None, "en", "en", "en", "en", "de", "Zu", "é"]), rng.choice([None, "s"]), rng.choice([None, 7])) for d in range(n)]
    return rows + rows[:3] + [(77, "same", "en", "s", 1)] * 5


@pytest.mark.parametrize("n, lift", [(40, 1), (150, 2), (150, 3), (150, 8), (0, 8)])
def test_manifest_equals_plain_version(spark, n, lift):
    from roomrate.llm.merkle import manifest, verified

    rows = some_documents(n, n + lift)
    df = spark.createDataFrame(rows, DOC).withColumns({"rank": F.lit(1), "group": F.lit("x"), "digest": F.lit("y")})
    got = [tuple(r) for r in verified(manifest(df, lift)).collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)


def test_manifest_of_one_row_and_of_none(spark):
    from roomrate.llm.merkle import manifest, verified

    one = [(1, "x" * 100_000, None, None, None)]
    assert [tuple(r) for r in verified(manifest(spark.createDataFrame(one, DOC))).collect()] == plain_manifest(one)
    assert verified(manifest(spark.createDataFrame([], DOC))).collect() == []


def test_manifest_has_a_twin(spark):
    from scripts.check_oracle import canon

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    duck.execute(f"CREATE VIEW twin AS {Q.oracle_sql()['op13_merkle']}")
    found = Q.op13_merkle(spark, SF).toPandas()
    assert canon(found) == canon(duck.execute("SELECT * FROM twin").df())
    assert (found["verified"] == found["doc_id"].map(lambda d: crc(d) % 7 != 0)).all()


# --- quality ----------------------------------------------------------------------------------------------

def test_rounds_equal_a_plain_ftrl(spark):
    from roomrate.llm import quality as C

    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        at = np.unique(rng.integers(0, 30, 6)).tolist()
        rows.append((i % 3, i, float(rng.integers(0, 2)), at, rng.random(len(at)).tolist()))
    df = spark.createDataFrame(rows, "shard int, key long, label double, buckets array<int>, values array<double>")
    z0, n0 = rng.normal(size=C.BUCKETS + 1), rng.random(C.BUCKETS + 1)
    got = {r.bucket: (r.z, r.n) for r in C.one_round(df.repartition(5, "shard").sortWithinPartitions("shard", "key"), z0, n0).collect()}
    want: dict = {}
    for shard in range(3):
        z, n = {}, {}
        for _, _, y, at, x in (r for r in rows if r[0] == shard):
            feats = list(zip([*at, C.BUCKETS], [*x, 1.0], strict=True))
            w = {}
            for b, _ in feats:
                zb, nb = z.get(b, z0[b]), n.get(b, n0[b])
                w[b] = 0.0 if abs(zb) <= C.L1 else -(zb - np.sign(zb) * C.L1) / ((C.BETA + nb ** 0.5) / C.ALPHA + C.L2)
            p = 1 / (1 + np.exp(-sum(w[b] * v for b, v in feats)))
            for b, v in feats:
                zb, nb, g = z.get(b, z0[b]), n.get(b, n0[b]), (p - y) * v
                z[b] = zb + g - ((nb + g * g) ** 0.5 - nb ** 0.5) / C.ALPHA * w[b]
                n[b] = nb + g * g
        for b in z:
            dz, dn = want.get(b, (0, 0))
            want[b] = (dz + z[b] - z0[b], dn + n[b] - n0[b])
    assert set(got) == set(want)
    assert all(np.allclose(got[b], want[b]) for b in want)


def test_features_equal_plain_features():
    import pyarrow as pa

    from roomrate.llm import quality as C

    texts = ["Ab cD ab. x9-99 x9-99", None, "", "  ", "é ü", "w " * 3000]
    (lo, hi, buckets, values, first), = C.features(pa.array(texts))
    assert (lo, hi) == (0, 6)
    own = [dict(zip(buckets[a:b].tolist(), values[a:b].tolist(), strict=True)) for a, b in zip(first[:-1], first[1:], strict=True)]
    plain = []
    for view in (["ab", "cd", "ab.", "x9-99", "x9-99"], ["za", "az", "a.", "a0-0", "a0-0"]):
        for k in (1, 2):
            grams = [tuple(view[i: i + k]) for i in range(len(view) - k + 1)]
            plain += [grams.count(g) for g in dict.fromkeys(grams)]
    want = np.sort(np.log1p(plain) / np.sqrt((np.log1p(plain) ** 2).sum()))
    assert np.allclose(np.sort(list(own[0].values())), want)
    assert not own[1] and not own[2] and not own[3]
    assert len(own[4]) == 5 and np.isclose(sum(v * v for v in own[5].values()), 1)


def test_quality_scores_hold_out(spark):
    """Whole table of the small scale factor: separated on the fold that training never saw."""
    sf = SF.replace("0.001", "0.01")
    got = Q.op11_quality(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.join(read_table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").collect()
    assert len(rows) == read_table(spark, sf, "documents").count()
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert len(bad) >= 10
    assert np.mean([[g > b for b in bad] for g in good]) > 0.98
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_quality_learns_nothing_from_the_fold_and_handles_edges(spark):
    from roomrate.llm.quality import quality_scores

    rng = random.Random(5)
    docs = [(d, " ".join(rng.choice(["good", "fine", "bad!", "ugly!"][2 * (d % 2): 2 * (d % 2) + 2]) for _ in range(20))) for d in range(300)]
    docs += [(None, None), (1000, None), (1001, ""), (1002, "bad! " * 200_000), (1003, "good fine"), (1003, "good fine")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "held_out": F.lit(1), "label": F.lit(3)})
    labels = [(d, 1 - d % 2) for d in range(300)] + [(3, None), (None, 1), (5, 1), (5, 0), (5, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int").withColumn("text", F.lit("z"))
    got = quality_scores(df, table).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(docs)
    assert by_id[1002].predicted == 0 and by_id[1003].predicted == 1 and by_id[None].held_out is False
    assert by_id[1000].score == by_id[1001].score == by_id[None].score
    assert np.mean([by_id[d].predicted == 1 - d % 2 for d in range(300)]) > 0.97
    turned = table.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r.doc_id, r.score) for r in quality_scores(df, turned).collect()} == {(r.doc_id, r.score) for r in got}
    assert {r.score for r in quality_scores(df, table.where("false")).collect()} == {0.5}
    assert quality_scores(df.where("false"), table).count() == 0
