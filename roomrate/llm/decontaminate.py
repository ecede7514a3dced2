"""Benchmark decontamination (10): winnowing.

Words are runs of digits, letters and non-ASCII characters, A-Z in lower case. A window is SPAN
consecutive words of a benchmark item (all its words, if fewer). A document word inside any occurrence
of a window is hit.

Items and documents are fingerprinted alike: of the hashes of GRAM words, the minimum of every window of
SPAN - GRAM + 1 hashes is kept. Equal spans of SPAN words hold the same window and keep the same minimum,
so every shared span shares a fingerprint. An item of fewer words has the hash of its whole sequence as its
fingerprint, and documents have those of their runs of that many words.

The items' fingerprints are a table; nothing of it passes through the driver but a bitmap of BITS bits, whatever
the benchmark's size. It thins out the documents' fingerprints before they are joined with the items': where it
is full it only stops saving rows. A fingerprint is joined together with the hash of the span around it, so that
the rows of a fingerprint that many spans share are no pairs; the spans that agree are extended by uniting
those that overlap. The items' side is repeated SALT times, so that a passage that a third of all
documents hold is dealt to as many tasks.

Defined results: null or word-less text has no words and no hits; so has a null or word-less item; an item with a
null id is no item; repeated items count by distinct item_id; an empty benchmark hits nothing; the result has one row
per document row, null and repeated ids included, in which other columns are left out. A long text is one row of the
tasks' arrays; its hits are rows of their own until their runs are put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomrate.llm import textops as X
from roomrate.llm.storage import KEY, written

SPAN = 10
GRAM = 6
#: bits of the bitmap of fingerprints (2 MB), a power of two, and bits of one of Spark's bitmaps
BITS = 1 << 24
BUCKET = 1 << 15
#: copies of the items' side of the joins
SALT = 8

SPANS = "array<struct<print:bigint,span:bigint,size:int,at:bigint>>"
_SPANS = pa.list_(pa.struct([("print", pa.int64()), ("span", pa.int64()), ("size", pa.int32()), ("at", pa.int64())]))


def minima(h: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, index of the rightmost minimum) of every window of `width` consecutive hashes of one row."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, at = h[:n].copy(), np.arange(n)
    for j in range(1, width):
        other = h[j: j + n]
        less = other <= low
        low[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    start = np.flatnonzero(rows[:n] == rows[width - 1:])
    return start, at[start]


def fingerprinted(w: X.Words, span: int, gram: int, sizes: list[int] | None, known: Callable[[np.ndarray], np.ndarray] | None):
    """(row, print, span, size, at) arrays of the spans of a piece, row by row. Items (`sizes` is None) have all spans of `span`
    words, or their whole sequence; documents those of `span` words and of each of `sizes`, if their print is `known`."""
    rows, prints, spans, lengths, places = [], [], [], [], []

    def add(row, h, s, size, at):
        rows.append(row)
        prints.append(h)
        spans.append(s)
        lengths.append(np.full(len(row), size, np.int32))
        places.append(at)

    h, row, pos = X.grams(w.hash, w.first, w.count, w.row, gram)
    start, least = minima(h, row, span - gram + 1)
    if known is not None:
        keep = known(h)[least]
        start, least = start[keep], least[keep]
    first = w.first[row[start]] + pos[start]
    total = np.zeros(len(first), np.uint64)
    for j in range(span):
        total += w.hash[first + j] * X.multiplier(j)
    add(row[start], h[least], X.mix64(total), span, pos[start])
    for size in range(1, span) if sizes is None else sizes:
        h, row, pos = X.grams(w.hash, w.first, w.count, w.row, size)
        keep = w.count[row] == size if sizes is None else known(h)
        add(row[keep], h[keep], h[keep], size, pos[keep])
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return (row[order], np.concatenate(prints)[order].view(np.int64), np.concatenate(spans)[order].view(np.int64),
            np.concatenate(lengths)[order], np.concatenate(places)[order].astype(np.int64))


def listed(w: X.Words, found: tuple, n_rows: int) -> pa.Array:
    """The spans of fingerprinted() as one list for each row of the piece."""
    row, *parts = found
    offsets = np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(x) for x in parts], fields=list(_SPANS.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def item_spans(benchmark: DataFrame, id_col: str, text_col: str, span: int, gram: int) -> DataFrame:
    """The distinct (item, print, span, size) of the benchmark, written."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in X.pieces(batch.column("text")):
                w = X.Words(data, offsets, X.ALNUM)
                row, prints, spans, sizes, _ = fingerprinted(w, span, gram, None, None)
                ids = batch.column("item").slice(lo, hi - lo).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(prints), pa.array(spans), pa.array(sizes)], names=["item", "print", "span", "size"])

    items = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    return written(items.mapInArrow(run, "item long, print long, span long, size int").distinct(), "item-spans")


def bitmap(items: DataFrame, bits: int) -> np.ndarray:
    """`bits` bits, packed; those of the fingerprints' lowest digits are set."""
    at = F.col("print").bitwiseAND(F.lit(bits - 1)) + 1
    maps = (items.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("place"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("map")))
    out = np.zeros(max(bits, BUCKET) // 8, np.uint8)
    for r in maps.collect():  # bits / BUCKET rows at most, or one
        out[(r["bucket"] - 1) * BUCKET // 8: r["bucket"] * BUCKET // 8] = np.frombuffer(r["map"], np.uint8)
    return out


def document_spans(items: DataFrame, span: int, gram: int, bits: int) -> Callable[[str], Column]:
    """Column function: struct (n_words, spans) of a text column, the spans being those whose print's bit is set."""
    sizes = sorted(r[0] for r in items.where(F.col("size") < span).select("size").distinct().collect())  # span - 1 at most
    shared = items.sparkSession.sparkContext.broadcast(bitmap(items, bits))

    def known(h: np.ndarray) -> np.ndarray:
        at = (h & np.uint64(bits - 1)).astype(np.int64)
        return (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    @F.arrow_udf(f"struct<n_words:bigint,spans:{SPANS}>")
    def spans(texts: pa.Array) -> pa.Array:
        counts, lists = [pa.array([], pa.int64())], [pa.array([], _SPANS)]
        for lo, hi, data, offsets in X.pieces(texts):
            w = X.Words(data, offsets, X.ALNUM)
            counts.append(pa.array(w.count.astype(np.int64)))
            lists.append(listed(w, fingerprinted(w, span, gram, sizes, known), hi - lo))
        return pa.StructArray.from_arrays([pa.concat_arrays(counts), pa.concat_arrays([x.cast(_SPANS) for x in lists])], names=["n_words", "spans"])

    # otherwise a filter on the spans has every text worked off twice, in a second Python worker of the task
    once = spans.asNondeterministic()
    return lambda text: once(F.col(text))


JOINED = ["print", "span", "size", "salt"]


def salted(items: DataFrame) -> DataFrame:
    return items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM,
                  bits: int = BITS) -> DataFrame:
    """(id, n_words, items, spans) of each row of docs; items are the ids of the items found, in order, spans the merged hit
    runs as [first word, end word]."""
    items = item_spans(benchmark, item_id_col, item_text_col, span, gram)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # a key for each row, which stays as it is written before anything is joined
    rows = written(rows.select(F.monotonically_increasing_id().alias(KEY), "id", document_spans(items, span, gram, bits)("text").alias("w"))
                   .select(KEY, "id", "w.n_words", "w.spans"), "doc-spans")
    open_spans = rows.where(F.size("spans") > 0).select(KEY, F.pmod(F.col(KEY), F.lit(SALT)).cast("int").alias("salt"), F.explode("spans").alias("s")).select(KEY, "salt", "s.*")
    runs = (open_spans.join(salted(items.select("print", "span", "size").distinct()), JOINED, "left_semi")
            .select(KEY, F.col("at").alias("lo"), (F.col("at") + F.col("size")).alias("hi")))
    order = Window.partitionBy(KEY).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = (runs.withColumn("fresh", F.when(F.col("lo") > before, 1).when(before.isNull(), 1).otherwise(0))
              .withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy(KEY, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
              .groupBy(KEY).agg(F.sort_array(F.collect_list(F.array("lo", "hi"))).alias("spans")))
    found = (open_spans.drop("at").distinct().join(salted(items), JOINED).select(KEY, "item").distinct()
             .groupBy(KEY).agg(F.sort_array(F.collect_list("item")).alias("items")))
    empty_items, empty_spans = F.array().cast("array<long>"), F.array().cast("array<array<long>>")
    return (rows.select(KEY, "id", "n_words").join(found, KEY, "left").join(merged, KEY, "left")
            .select("id", "n_words", F.coalesce("items", empty_items).alias("items"), F.coalesce("spans", empty_spans).alias("spans")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                         item_text_col: str = "text", span: int = SPAN, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """The rows of docs without a hit word. Whether a text is hit depends on the text alone, so that hit texts are told by
    their digest: docs are read twice and not written."""
    items = item_spans(benchmark, item_id_col, item_text_col, span, gram)
    spans = document_spans(items, span, gram, bits)
    digest_of = F.unhex(F.sha2(F.col(text_col), 256))
    open_spans = (docs.select(digest_of.alias(KEY), spans(text_col).alias("w")).where(F.size("w.spans") > 0)
                  .select(KEY, F.explode("w.spans").alias("s")).select(KEY, "s.print", "s.span", "s.size").distinct()
                  .withColumn("salt", F.pmod(F.xxhash64(KEY), F.lit(SALT)).cast("int")))
    hit = written(open_spans.join(salted(items.select("print", "span", "size").distinct()), JOINED, "left_semi").select(KEY).distinct(), "hit-texts")
    return docs.join(hit, digest_of == hit[KEY], "left_anti")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) from the rows of contamination()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    names = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def brute_force(text: str | None, items: list[tuple[int, str | None]], span: int = SPAN) -> tuple[int, int, list[int], str]:
    """Reference for tests: (n_words, n_hit, items, sha256) of one document by comparing every window."""
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    own, hit, found = words(text), set(), set()
    for item, t in items:
        theirs = words(t)
        n = min(span, len(theirs))
        windows = {tuple(theirs[i: i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for i in range(len(own) - n + 1 if n else 0):
            if tuple(own[i: i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(own), len(hit), sorted(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
