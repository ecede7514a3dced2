"""Line dedup (4): site-relative frequency. Column expressions and SQL only.

Lines are the parts of a text between line feeds, compared without blanks, tabs and carriage returns at
their ends. The unlike texts of each host that contain a line are counted (a line twice in a page counts once, and so do
copies of one page: copies of an article are no boilerplate), divided by the host's unlike texts, and lines above the
boilerplate ratio (and in MIN_PAGES unlike texts at least) are dropped from all its pages. Blank lines stay. Copies of a
text collapse before the count, as its digest and the hashes of its lines.

The lines to drop are few for each host, by proof: a host with n pages of m different lines on average has
at most m / ratio lines on more than ratio * n of them. They are gathered into one row per host and joined
to the pages, which therefore are neither exploded again nor shuffled when that table is small.

Defined results: null text stays null with no lines; a null host is a host; repeated rows are pages that count
once; a line at the ratio exactly stays; very long texts are split whole; columns of clashing names are ignored; a text of which every line is dropped becomes empty; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomrate.llm.storage import written

RATIO = 0.05
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, drops): hashes of the lines to drop of each host of pages (host, text)."""
    blank = F.xxhash64(F.lit(""))
    unlike = written(pages.where("text is not null")
                     .select("host", F.xxhash64("text", F.length("text")).alias("digest"), F.array_distinct(F.transform(_lines(F.col("text")), _key)).alias("lines"))
                     .dropDuplicates(["host", "digest"]).select("host", "lines"), "page-lines")
    each = unlike.select("host", F.explode("lines").alias("line"))
    counts = each.where(F.col("line") != blank).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = unlike.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("total"))
    return (counts.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > F.lit(ratio) * F.col("total"))
            .groupBy("host").agg(F.collect_list("line").alias("drops")))


def without_boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, id_col: str = "doc_id",
                        host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every row of docs, the text without its host's boilerplate lines."""
    pages = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    drops = written(boilerplate(pages.select("host", "text"), ratio, min_pages), "boilerplate").withColumnRenamed("host", "h")
    lines = _lines(F.col("text"))
    kept = F.filter("lines", lambda line: ~F.array_contains("drops", _key(line)))
    return (pages.join(drops, F.col("host").eqNullSafe(F.col("h")), "left").withColumn("lines", lines)
            .withColumn("kept", F.when(F.col("drops").isNull(), F.col("lines")).otherwise(kept))
            .select("doc_id", F.array_join("kept", "\n").alias("text"),
                    F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
                    F.when(F.col("text").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_dropped")))


def sql(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """DuckDB twin of without_boilerplate() over documents."""
    return f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
u AS (SELECT DISTINCT source, text, lines FROM d WHERE text IS NOT NULL),
e AS (SELECT source, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13))))) AS line FROM u),
t AS (SELECT source, count(*) AS total FROM u GROUP BY source),
n AS (SELECT source, line, count(*) AS n FROM e WHERE line <> '' GROUP BY source, line),
b AS (SELECT n.source, list(n.line) AS drops FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
      WHERE n.n >= {min_pages} AND n.n > CAST({ratio} AS DOUBLE) * t.total GROUP BY n.source),
k AS (SELECT d.doc_id, d.text, d.lines, CASE WHEN b.drops IS NULL THEN d.lines
             ELSE list_filter(d.lines, lambda x: NOT list_contains(b.drops, trim(x, ' ' || chr(9) || chr(13)))) END AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
       CAST(CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS BIGINT) AS n_lines,
       CAST(CASE WHEN text IS NULL THEN 0 ELSE len(lines) - len(kept) END AS BIGINT) AS n_dropped
FROM k
"""
