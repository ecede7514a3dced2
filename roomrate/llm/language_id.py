"""Language ID (2): multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every labelled text (a grouped sum in Spark; one row per language and
bucket from each task). The model is the log-probability matrix, languages x BUCKETS, broadcast to the
tasks; its size is bounded by MAX_LANGUAGES. Scoring looks the n-grams of a batch up in the matrix and
sums the rows of each text.

N-grams are runs of 1 to 3 code points of the lower-cased text in which every run of characters other
than letters counts as one blank, so that digits, punctuation and markup say nothing about a language.

Defined results: null text, or text without a letter, is `und` with score 0; without any labelled text
everything is `und`; ties go to the language that sorts first; other columns are ignored. The score is the
posterior probability of the predicted language.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomrate.llm.storage import written

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: bound on the languages of a model (the matrix has MAX_LANGUAGES x BUCKETS numbers at most: 64 MB)
MAX_LANGUAGES = 500
UNKNOWN = "und"
#: code points worked off at once, and rows whose texts are decoded at once
PIECE = 1 << 18
ROWS = 256

_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def cleaned(text: str | None) -> str:
    """Lower-cased letters and marks with single blanks around every word; empty without a letter."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return f" {words} " if regex.search(r"\p{L}", words) else ""


def hashed(points: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram of `order` code points that begins at each position but the last order - 1."""
    n = len(points) - order + 1
    h = np.full(max(n, 0), order, np.uint32)
    for j in range(order):
        h = (h ^ points[j: j + len(h)]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h % np.uint32(BUCKETS)).astype(np.int64)


def pieces(texts: list[str], limit: int = PIECE):
    """(indices, code points, first position of each text) of runs of non-empty cleaned texts."""
    run, size = [], 0
    for i, t in enumerate(texts):
        if t:
            run.append(i)
            size += len(t)
        if run and (size >= limit or i == len(texts) - 1):
            points = np.frombuffer("".join(texts[j] for j in run).encode("utf-32-le", "surrogatepass"), np.uint32)
            first = np.concatenate([[0], np.cumsum([len(texts[j]) for j in run])])
            yield run, points, first
            run, size = [], 0
    if run:
        points = np.frombuffer("".join(texts[j] for j in run).encode("utf-32-le", "surrogatepass"), np.uint32)
        yield run, points, np.concatenate([[0], np.cumsum([len(texts[j]) for j in run])])


def inside(first: np.ndarray, order: int, n: int) -> np.ndarray:
    """True for the positions whose n-gram stays within its text."""
    ok = np.ones(n, bool)
    for end in first[1:-1]:
        ok[max(0, end - order + 1): end] = False
    return ok


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all texts of labelled (lang, text)."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                own = [cleaned(texts[i]) for i in np.flatnonzero(langs == lang)]
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, points, first in pieces(own):
                    for order in ORDERS:
                        h = hashed(points, order)
                        total += np.bincount(h[inside(first, order, len(h))], minlength=BUCKETS)
            if len(totals) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                              pa.array(total[at])], names=["lang", "bucket", "n"])

    return (labelled.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def train(docs: DataFrame, train_on, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages in order, log-probability matrix BUCKETS x languages with the prior in an added last row)
    from the rows of docs for which the condition train_on holds and the language is known."""
    labelled = (docs.where(train_on).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
                .where("lang is not null and text is not null"))
    counts = written(gram_counts(labelled), "lang-counts")
    langs = [r[0] for r in counts.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    frame = counts.toPandas()  # MAX_LANGUAGES x BUCKETS rows at most
    table = np.zeros((BUCKETS, len(langs)))
    where = {lang: i for i, lang in enumerate(langs)}
    table[frame["bucket"].to_numpy(np.int64), [where[x] for x in frame["lang"]]] = frame["n"].to_numpy()
    return langs, np.log(table + SMOOTHING) - np.log(table.sum(axis=0) + SMOOTHING * BUCKETS)


def scored(texts: list[str | None], langs: list[str], logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Predicted language and posterior probability (equal priors) of each text."""
    best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    clean = [cleaned(t) for t in texts] if langs else []
    for run, points, first in pieces(clean, max(1, 4 * PIECE // max(4, len(langs)))):
        def part(order):
            h = hashed(points, order)
            rows = logp[h]
            rows[~inside(first, order, len(h))] = 0
            starts = np.minimum(first[:-1], max(len(h) - 1, 0))
            return np.add.reduceat(rows, starts, axis=0)

        total = reduce(np.add, (part(order) for order in ORDERS))
        share = np.exp(total - total.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        top = total.argmax(axis=1)
        for j, i in enumerate(run):
            best[i], score[i] = langs[top[j]], share[j, top[j]]
    return best, score


def prediction(spark: SparkSession, model: tuple[list[str], np.ndarray], text_col: str = "text") -> Column:
    """Struct column (lang_pred, score) of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        langs, logp = shared.value
        best, score = [], [np.zeros(0)]
        for at in range(0, len(texts), ROWS):
            b, s = scored(texts.slice(at, ROWS).to_pylist(), langs, logp)
            best += b
            score.append(s)
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(np.concatenate(score))], names=["lang_pred", "score"])

    return predict(F.col(text_col))


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score added (columns of these names are replaced)."""
    found = docs.drop("lang_pred", "score").withColumn("__predicted", prediction(docs.sparkSession, model, text_col))
    return found.select("*", "__predicted.lang_pred", "__predicted.score").drop("__predicted")


def held_out(id_col: str = "doc_id"):
    """Condition: the remainder of crc32(id as text) by 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
