"""Quality classifier (11): logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's features are its word n-grams of ORDERS words, once over the words themselves and once over their shapes (runs
of letters and of digits as one sign each, capitals apart, other characters as they are: an invented word still has a
familiar shape), hashed into BUCKETS buckets. A bucket weighs log(1 + occurrences); a text's features have length 1. The
last feature is a constant 1.

Training (FTRL-proximal, one update per text): the labelled texts are dealt to SHARDS shards by hash; in each of EPOCHS
rounds every shard goes through its texts one after the other from the common state (z, n of each bucket), and the
shards' changes of the state are added up in a grouped sum of BUCKETS rows at most: n grows by every shard's squared
gradients, so that steps shorten with the number of shards. Scores are sparse dot products with the weights, which are
broadcast (2 MB).

The fit takes SAMPLE labelled documents, about, picked by a hash of doc_id where there are more; everything else covers
all rows. Of texts that share a labelled doc_id one is learnt from; unlike labels of one doc_id go by their mean, a tie
counts as 1.

Defined results: null text counts as empty, and an empty text scores by the constant feature alone; very long texts are
worked off in pieces of their own; a null doc_id is not held out and never learnt from; without labelled rows every score
is 0.5; repeated rows score alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomrate.llm import textops as X
from roomrate.llm.language_id import held_out
from roomrate.llm.storage import written

BITS = 18
BUCKETS = 1 << BITS
ORDERS = (1, 2)
#: labelled documents that the fit takes, about, and the shards and rounds of its training
SAMPLE = 100_000
SHARDS = 16
EPOCHS = 4
#: step size, its offset, and the weights of the absolute and the squared penalty
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("z")
_SHAPE[48:58] = ord("0")
_RUNS = np.zeros(256, bool)
_RUNS[[ord("a"), ord("z"), ord("0")]] = True


def shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts with every word replaced by its shape."""
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | ~_RUNS[shape[1:]]
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    return shape[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def features(texts: pa.Array):
    """Per piece of the texts: (first row, end row, buckets, values, first feature of each row)."""
    for lo, hi, data, offsets in X.pieces(texts):
        keys = []
        for view, (d, o) in enumerate(((data, offsets), shapes(data, offsets))):
            w = X.Words(d, o, X.NOT_SPACE)
            for k in ORDERS:
                h, rows, _ = X.grams(w.hash, w.first, w.count, w.row, k)
                h = X.mix64(h + X.multiplier(70 + 2 * k + view)) >> np.uint64(64 - BITS)
                keys.append((rows.astype(np.uint64) << np.uint64(BITS)) | h)
        keys, times = np.unique(np.concatenate(keys), return_counts=True)
        first = np.searchsorted(keys >> np.uint64(BITS), np.arange(hi - lo + 1, dtype=np.uint64))
        values = np.log1p(times)
        square = np.concatenate([[0], np.cumsum(values * values)])
        length = np.sqrt(square[first[1:]] - square[first[:-1]])
        values /= np.repeat(length, np.diff(first))
        yield lo, hi, (keys & np.uint64(BUCKETS - 1)).astype(np.int32), values, first


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the state (z, n)."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def probability(logit):
    return 1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35)))


def learn(z: np.ndarray, n: np.ndarray, buckets: np.ndarray, values: np.ndarray, label: float) -> None:
    """One update of the state by one text."""
    at, x = np.append(buckets, BUCKETS), np.append(values, 1.0)
    w = weights(z[at], n[at])
    g = (probability(w @ x) - label) * x
    z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
    n[at] += g * g


def labelled_features(docs: DataFrame, labels: DataFrame, train_on: Column, sample: int, id_col: str, text_col: str,
                      label_col: str) -> DataFrame:
    """(shard, key, label, buckets, values) of the documents that the fit takes, dealt to shards and sorted in them."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).dropna()
             .groupBy("id").agg((F.avg("label") >= 0.5).cast("double").alias("label")))
    share = min(1.0, sample / max(1, known.count()))
    taken = known.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30))  # about `sample` rows
    rows = (docs.where(train_on).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(taken), "id")
            .groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
            .withColumn("key", F.xxhash64("id"))
            .select(F.pmod("key", F.lit(SHARDS)).cast("int").alias("shard"), "key", "label", "text")
            .repartition(SHARDS, "shard").sortWithinPartitions("shard", "key"))

    def run(batches):
        for batch in batches:
            for lo, hi, buckets, values, first in features(batch.column("text")):
                first = pa.array(first.astype(np.int32))
                columns = [batch.column(c).slice(lo, hi - lo) for c in ("shard", "key", "label")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.ListArray.from_arrays(first, pa.array(buckets)), pa.ListArray.from_arrays(first, pa.array(values.astype(np.float32)))],
                    names=["shard", "key", "label", "buckets", "values"])

    return rows.mapInArrow(run, "shard int, key long, label double, buckets array<int>, values array<float>")


def one_round(rows: DataFrame, z: np.ndarray, n: np.ndarray) -> DataFrame:
    """(bucket, z, n): the sum of the shards' changes of the state, each shard starting from (z, n); rows come sorted by
    shard and key within partitions (a shard that a partition ends in goes on as one more shard)."""
    shared = rows.sparkSession.sparkContext.broadcast((z, n))

    def changes(state):
        dz, dn = state[0] - shared.value[0], state[1] - shared.value[1]
        at = np.flatnonzero((dz != 0) | (dn != 0))
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(dz[at]), pa.array(dn[at])], names=["bucket", "z", "n"])

    def run(batches):
        own, state = None, None
        for batch in batches:
            shards, labels = batch.column("shard").to_numpy(), batch.column("label").to_numpy()
            buckets, values = batch.column("buckets"), batch.column("values")
            for i in range(batch.num_rows):
                if shards[i] != own:
                    if state:
                        yield changes(state)
                    own, state = shards[i], (shared.value[0].copy(), shared.value[1].copy())
                learn(*state, buckets[i].values.to_numpy(), values[i].values.to_numpy(), labels[i])
        if state:
            yield changes(state)

    return rows.mapInArrow(run, "bucket int, z double, n double").groupBy("bucket").agg(F.sum("z").alias("z"), F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the buckets, and of the constant feature in the last place."""
    # a file holds whole shards in order and is one row group, so a round reads it without another shuffle
    rows = written(labelled_features(docs, labels, train_on, sample, id_col, text_col, label_col), "quality-features")
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for _ in range(epochs):
        change = one_round(rows, z, n).toPandas()  # BUCKETS + 1 rows at most
        at = change["bucket"].to_numpy()
        z[at] += change["z"].to_numpy()
        n[at] += change["n"].to_numpy()
    return weights(z, n)


def score(spark: SparkSession, model: np.ndarray, text_col: str = "text") -> Column:
    """Probability of label 1 of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        w, out = shared.value, np.zeros(len(texts))
        for lo, hi, buckets, values, first in features(texts):
            sums = np.concatenate([[0], np.cumsum(w[buckets] * values)])
            out[lo:hi] = probability(sums[first[1:]] - sums[first[:-1]] + w[BUCKETS])
        return pa.array(out)

    return scored(F.col(text_col))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, learnt from labels outside the held-out fold."""
    model = train(docs, labels, ~held_out(id_col), id_col, text_col, label_col)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                        score(docs.sparkSession, model, text_col).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
