"""Suffix-array dedup (8): sparse suffix arrays.

Suffixes are retained at content-selected positions only: the minimiser of every window of PASSAGE - GRAM + 1
consecutive GRAM-word hashes (one word in about eighteen). Equal passages of PASSAGE words retain the same
positions, so a repeated passage always shows as two retained suffixes that begin with the same GRAM words.

The retained suffixes are ordered by the hash of their first GRAM words, which makes suffixes that begin
alike neighbours; a suffix without a like neighbour is dropped. Matches are then extended to the left and
the right: every run of PASSAGE words around a shared position (the runs whose minimiser it is) is hashed,
and runs that occur at two places are repeated. Overlapping runs merge into spans. The order is one of
hashes, not of letters, because only likeness matters here; that lets Spark group the suffixes and spares
a total sort. A passage that a third of all documents share costs each of them its own rows and no pairs.

Texts with equal words are one class, which goes through the search once.

Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case. A word is repeated if a run of PASSAGE words around it
occurs at another place (in any document), and duplicate if one occurs at an earlier place, by doc_id, then
position.

Rows are told apart by a key of their own, so rows of one doc_id with unlike texts are documents like others; places
are earlier by doc_id and position, and places that tie are none the earlier.

Defined results: null or empty text has no words; rows with a null id are returned without repeats and take
no part; repeated rows are repeats of each other, none the earlier; very long texts are worked off whole, in a piece of
their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomrate.llm import textops as X
from roomrate.llm.storage import KEY, keyed, written

PASSAGE = 50
GRAM = 16


def window_minima(h: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first index, index of the rightmost minimum) of every window of `width` hashes of one row."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, at = h[:n].copy(), np.arange(n)
    for j in range(1, width):
        other = h[j: j + n]
        less = other <= low
        low[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    whole = np.flatnonzero(rows[:n] == rows[width - 1:])
    return whole, at[whole]


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each word on (rows are not looked at)."""
    n = len(hashes)
    power, inverse = X._power_table(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power[:n], out=sums[1:])
    m = max(0, n - length + 1)
    return X.mix64((sums[length: length + m] - sums[:m]) * inverse[:m])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def word_keys(docs: DataFrame) -> DataFrame:
    """(id, n, w1, w2): number of words and two keys of the word sequence of each row of docs (id, text)."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in X.pieces(batch.column("text")):
                w = X.Words(data, offsets, X.NOT_SPACE)
                place = (np.arange(len(w.hash)) - w.first[:-1][w.row]).astype(np.uint64) if len(w.hash) else w.hash
                keys = [X.mix64(X.segment_sums(X.mix64(w.hash * X.multiplier(a) + place * X.multiplier(a + 1)), w.first)) for a in (41, 43)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(w.count.astype(np.int64)),
                                                  _signed(keys[0]), _signed(keys[1])], names=["id", "n", "w1", "w2"])

    return docs.mapInArrow(run, "id long, n long, w1 long, w2 long")


def retained_suffixes(docs: DataFrame, passage: int, gram: int) -> DataFrame:
    """(start, id, at): hash of the first words, document and word position of each retained suffix."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for lo, _, data, offsets in X.pieces(batch.column("text")):
                w = X.Words(data, offsets, X.NOT_SPACE)
                h, rows, pos = X.grams(w.hash, w.first, w.count, w.row, gram)
                keep = np.unique(window_minima(h, rows, passage - gram + 1)[1])
                yield pa.RecordBatch.from_arrays([_signed(h[keep]), pa.array(ids[lo + rows[keep]]), pa.array(pos[keep].astype(np.int64))],
                                                 names=["start", "id", "at"])

    return docs.mapInArrow(run, "start long, id long, at long")


def extended_runs(docs: DataFrame, passage: int, gram: int) -> DataFrame:
    """(run, doc, id, at) of every run of `passage` words whose minimiser is one of the positions `shared` of the
    row of docs (doc, id, text, shared)."""

    def run(batches):
        for batch in batches:
            own_docs, ids, shared = batch.column("doc").to_numpy(), batch.column("id").to_numpy(), batch.column("shared")
            for lo, hi, data, offsets in X.pieces(batch.column("text")):
                w = X.Words(data, offsets, X.NOT_SPACE)
                h, rows, pos = X.grams(w.hash, w.first, w.count, w.row, gram)
                first, at = window_minima(h, rows, passage - gram + 1)
                mark = np.zeros(len(w.hash) + 1, bool)
                for r in range(lo, hi):
                    own = shared[r].values
                    if own is not None:
                        mark[w.first[r - lo] + own.to_numpy()] = True
                take = mark[w.first[rows[at]] + pos[at]] if len(at) else at.astype(bool)
                begin = first[take]
                whole = w.first[rows[begin]] + pos[begin]
                row = lo + rows[begin]
                yield pa.RecordBatch.from_arrays([_signed(run_hashes(w.hash, passage)[whole]), pa.array(own_docs[row]), pa.array(ids[row]),
                                                  pa.array(pos[begin].astype(np.int64))], names=["run", "doc", "id", "at"])

    return docs.mapInArrow(run, "run long, doc long, id long, at long")


def merged_runs(starts: pd.Series, passage: int) -> tuple[list[list[list[int]]], list[int]]:
    """Spans and number of words that the runs beginning at the sorted starts cover, per row."""
    spans, words = [], []
    for own in starts:
        own = np.asarray(own, np.int64)
        if not len(own):
            spans.append([])
            words.append(0)
            continue
        cut = np.flatnonzero(np.diff(own) > passage)
        lo, hi = own[np.append(0, cut + 1)], own[np.append(cut, len(own) - 1)] + passage
        spans.append(np.stack([lo, hi], 1).tolist())
        words.append(int((hi - lo).sum()))
    return spans, words


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_repeated, n_duplicate, repeated, duplicate) of every row of docs: spans are
    [first word, end word]."""
    rows = keyed(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))).withColumnRenamed(KEY, "id")
    keys = written(word_keys(rows).join(rows.select("id", "doc"), "id"), "word-keys")
    classes = written(keys.where("doc is not null and n > 0").groupBy("n", "w1", "w2")
                      .agg(F.min(F.struct("doc", "id")).alias("first"), F.count("*").alias("copies"))
                      .select("n", "w1", "w2", "copies", "first.doc", F.col("first.id").alias("c")), "word-classes")
    first_of = classes.select(F.col("c").alias("id"))

    suffixes = retained_suffixes(rows.where("doc is not null"), passage, gram)
    suffixes = written(suffixes.join(first_of, "id", "left_semi"), "suffixes")
    place = F.xxhash64("id", "at")
    alike = suffixes.groupBy("start").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("start")
    shared = suffixes.join(alike, "start").groupBy("id").agg(F.collect_set("at").alias("shared"))
    texts = rows.join(written(shared, "shared"), "id")

    runs = written(extended_runs(texts, passage, gram), "runs")
    occurs = (runs.groupBy("run").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("first"))
              .where("n > 1").select("run", "first"))
    per_row = (runs.join(occurs, "run").groupBy("id")
               .agg(F.sort_array(F.collect_list("at")).alias("all"),
                    F.sort_array(F.collect_list(F.when((F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at")), F.col("at")))).alias("later")))

    @F.pandas_udf("spans array<array<long>>, words long")
    def merged(starts: pd.Series) -> pd.DataFrame:
        spans, words = merged_runs(starts, passage)
        return pd.DataFrame({"spans": spans, "words": words})

    found = per_row.select(F.col("id").alias("c"), merged("all").alias("r"), merged("later").alias("d"))
    by_class = classes.join(found, "c", "left").select("n", "w1", "w2", F.col("doc").alias("c"), "copies", "r", "d")
    whole = F.array(F.array(F.lit(0).cast("long"), F.col("n")))
    none = F.array().cast("array<array<long>>")
    copied = F.coalesce((F.col("copies") > 1) & (F.col("n") >= passage), F.lit(False))
    later = copied & (F.col("doc") != F.col("c"))
    return (keys.join(by_class, ["n", "w1", "w2"], "left")
            .withColumns({"known": F.col("doc").isNotNull(), "copied": copied, "later": later})
            .select(F.col("doc").alias("doc_id"), F.col("n").alias("n_words"),
                    F.when(F.col("known") & F.col("copied"), F.col("n")).when(F.col("known"), F.coalesce("r.words", F.lit(0))).otherwise(F.lit(0)).alias("n_repeated"),
                    F.when(F.col("known") & F.col("later"), F.col("n")).when(F.col("known"), F.coalesce("d.words", F.lit(0))).otherwise(F.lit(0)).alias("n_duplicate"),
                    F.when(F.col("known") & F.col("copied"), whole).when(F.col("known"), F.coalesce("r.spans", none)).otherwise(none).alias("repeated"),
                    F.when(F.col("known") & F.col("later"), whole).when(F.col("known"), F.coalesce("d.spans", none)).otherwise(none).alias("duplicate")))


def listed(found: DataFrame) -> DataFrame:
    """The rows of repeated_passages() with their spans as strings: start:end, comma-joined."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s[0].cast("string"), s[1].cast("string"))), ",")

    return found.withColumns({"repeated": text(F.col("repeated")), "duplicate": text(F.col("duplicate"))})


def sql(passage: int = PASSAGE) -> str:
    """DuckDB twin of listed(repeated_passages())."""
    return f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(len(words))) AS i FROM w),
g AS (SELECT doc_id, i, CASE WHEN i + {passage} <= len(words) THEN array_to_string(words[i + 1:i + {passage}], ' ') END AS run FROM p),
o AS (SELECT run, count(*) AS n, min((doc_id, i)) AS place FROM g WHERE run IS NOT NULL GROUP BY run HAVING count(*) > 1),
m AS (SELECT g.doc_id, g.i, o.run IS NOT NULL AS rep, coalesce(o.place <> (g.doc_id, g.i), false) AS dup FROM g LEFT JOIN o ON g.run = o.run),
c AS (SELECT doc_id, i, max(CASE WHEN rep THEN i END) OVER f > i - {passage} AS rep, max(CASE WHEN dup THEN i END) OVER f > i - {passage} AS dup
      FROM m WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
s AS (SELECT doc_id, count(*) FILTER (rep) AS n_repeated, count(*) FILTER (dup) AS n_duplicate FROM c GROUP BY doc_id),
x AS (SELECT doc_id, 'r' AS kind, i FROM c WHERE rep UNION ALL SELECT doc_id, 'd', i FROM c WHERE dup),
y AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) AS island FROM x),
z AS (SELECT doc_id, kind, min(i) AS a, max(i) + 1 AS b FROM y GROUP BY doc_id, kind, island),
l AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) FILTER (kind = 'r') AS r,
             string_agg(a || ':' || b, ',' ORDER BY a) FILTER (kind = 'd') AS d FROM z GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(s.n_repeated, 0) AS n_repeated, coalesce(s.n_duplicate, 0) AS n_duplicate,
       coalesce(l.r, '') AS repeated, coalesce(l.d, '') AS duplicate
FROM w LEFT JOIN s ON w.doc_id = s.doc_id LEFT JOIN l ON w.doc_id = l.doc_id
"""
