"""Registered queries: n-grams, gram flags, clean tokens (X1-X3) over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomrate import constants as K
from roomrate.functions.text import exploded_ngrams, treebank_tokens, word_tokens
from roomrate.plans.common import tables
from roomrate.plans.registry import register
from roomrate.plans.sqltext import stop_words_sql, treebank_sql

_STOP = stop_words_sql(K.ENGLISH_STOP_WORDS)
_TOKENS_SQL = r"regexp_extract_all(regexp_replace(lower(text), '\d+', '', 'g'), '\p{L}+')"
_POS_SQL = f"""
t AS (SELECT doc_id, {_TOKENS_SQL} AS toks FROM documents),
w AS (SELECT doc_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos FROM t)"""


def _doc_tokens(spark, sf_dir):
    """(doc_id, tokens) — tokens computed once per document."""
    docs = tables(spark, sf_dir).documents
    return docs.select("doc_id", word_tokens("text").alias("tokens"))


@register("summary_bigrams", f"""
WITH {_POS_SQL}
SELECT a.w || ' ' || b.w AS gram, count(*) AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
WHERE NOT list_contains({_STOP}, a.w) AND NOT list_contains({_STOP}, b.w)
GROUP BY 1
""")
def q_bigrams(spark, sf_dir):
    """X1 (n=2): grams formed first, then any gram holding a stop word is dropped."""
    g = exploded_ngrams(_doc_tokens(spark, sf_dir), "tokens", 2)
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@register("summary_trigrams", f"""
WITH {_POS_SQL}
SELECT a.w || ' ' || b.w || ' ' || c.w AS gram, count(*) AS n
FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN w c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2
WHERE NOT list_contains({_STOP}, a.w) AND NOT list_contains({_STOP}, b.w) AND NOT list_contains({_STOP}, c.w)
GROUP BY 1
""")
def q_trigrams(spark, sf_dir):
    """X1 (n=3)."""
    g = exploded_ngrams(_doc_tokens(spark, sf_dir), "tokens", 3)
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


_VOCAB_SQL = "[" + ", ".join(f"'{v}'" for v in K.REQUEST_AMENITIES) + "]"


@register("gram_amenity_hits", f"""
WITH {_POS_SQL},
g AS (SELECT a.doc_id, a.w AS w1, b.w AS w2 FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
      WHERE NOT list_contains({_STOP}, a.w) AND NOT list_contains({_STOP}, b.w)),
h AS (SELECT doc_id, w1 || '_' || w2 AS hit FROM g UNION SELECT doc_id, w1 FROM g UNION SELECT doc_id, w2 FROM g)
SELECT d.doc_id, CAST(count(h.hit) AS INTEGER) AS n_hits, coalesce(string_agg(h.hit, '|' ORDER BY h.hit), '') AS hits
FROM documents d LEFT JOIN (SELECT * FROM h WHERE list_contains({_VOCAB_SQL}, hit)) h ON d.doc_id = h.doc_id
GROUP BY d.doc_id
""")
def q_gram_hits(spark, sf_dir):
    """X2 with sub-gram matching: bigram (joined by '_') or either word is a known amenity token. Grams are
    exploded and tested with a hashed `isin`; only the hits are grouped again."""
    docs = tables(spark, sf_dir).documents.select("doc_id")
    grams = exploded_ngrams(_doc_tokens(spark, sf_dir), "tokens", 2, keep=["doc_id"])
    words = F.split("gram", " ")
    tested = grams.select("doc_id", F.explode(F.array(F.replace("gram", F.lit(" "), F.lit("_")), words[0], words[1])).alias("hit"))
    hits = (tested.where(F.col("hit").isin(list(K.REQUEST_AMENITIES))).groupBy("doc_id")
            .agg(F.array_sort(F.collect_set("hit")).alias("hits")))
    found = F.coalesce(F.col("hits"), F.array().cast("array<string>"))
    return docs.join(hits, "doc_id", "left").select("doc_id", F.size(found).alias("n_hits"), F.array_join(found, "|").alias("hits"))


_CLEAN_STOP = stop_words_sql(list(K.ENGLISH_STOP_WORDS) + list(K.EXTRA_STOP_WORDS))


@register("clean_token_counts", f"""
WITH {_POS_SQL}
SELECT w AS token, count(*) AS n FROM w WHERE NOT list_contains({_CLEAN_STOP}, w) GROUP BY 1
""")
def q_clean_tokens(spark, sf_dir):
    """Digit-free lower-case tokens minus stop words and the extra list (no lemmas)."""
    words = tables(spark, sf_dir).documents.select(F.explode(word_tokens("text")).alias("token"))
    stop = list(K.ENGLISH_STOP_WORDS) + list(K.EXTRA_STOP_WORDS)
    return words.where(~F.col("token").isin(stop)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_TREEBANK_SQL = f"""
t AS (SELECT doc_id, {treebank_sql('text')} AS toks FROM documents),
w AS (SELECT doc_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos FROM t)"""


@register("treebank_bigrams", f"""
WITH {_TREEBANK_SQL}
SELECT a.w || ' ' || b.w AS gram, count(*) AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
WHERE NOT list_contains({_STOP}, a.w) AND NOT list_contains({_STOP}, b.w)
GROUP BY 1
""")
def q_treebank_bigrams(spark, sf_dir):
    """X1 (n=2) over tokens of the source's kind."""
    docs = tables(spark, sf_dir).documents.select("doc_id", treebank_tokens("text").alias("tokens"))
    return exploded_ngrams(docs, "tokens", 2).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
