"""Registered queries: de-duplication, encoding, imputation, neighbour fill, band join."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from roomrate import constants as K
from roomrate.functions.bins import right_closed_bin
from roomrate.functions.text import amenity_token_set, word_tokens
from roomrate.operators.dedupe import keep_first
from roomrate.operators.encode import category_codes, mean_fill, multi_hot, multi_hot_sets, vocabulary
from roomrate.operators.vectors import token_uses, top_entries, vector_f_scores, vector_means, with_token_vectors
from roomrate.operators.neighbours import band_pairs, neighbour_fill, neighbour_sums
from roomrate.plans import listings as C2
from roomrate.plans.common import CAL_CTE, calendar, folded_flags, listed_tokens, listings, lst_cte, r, round_doubles, tables
from roomrate.plans.registry import register
from roomrate.plans.sqltext import amenity_norm_sql, amenity_rename_sql, naive_fill_sql, q
from roomrate.session import written
from roomrate.sources.bindings import CALENDAR_ORDER, inject_null

HALF = K.NEIGHBOUR_LAT_HALF_WIDTH


# E1 keep-first on (latitude, longitude)
@register("listing_dedupe_latlon", f"""
WITH {lst_cte()},
d AS (SELECT *, row_number() OVER (PARTITION BY latitude, longitude ORDER BY id) AS rn FROM lst)
SELECT id, latitude, longitude, description, room_type FROM d WHERE rn = 1
""")
def q_listing_dedupe(spark, sf_dir):
    df = listings(spark, sf_dir)
    return keep_first(df, ["latitude", "longitude"], ["id"], values=["id", "description", "room_type"]).select(
        "id", "latitude", "longitude", "description", "room_type")


# E2 keep-first on (listing, day)
@register("calendar_dedupe_listing_day", f"""
WITH {CAL_CTE},
d AS (SELECT listing_id, CAST(date AS DATE) AS date, available, adjusted_price, minimum_nights,
             row_number() OVER (PARTITION BY listing_id, CAST(date AS DATE) ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rn
      FROM cal)
SELECT listing_id, date, available, adjusted_price, minimum_nights FROM d WHERE rn = 1
""")
def q_calendar_dedupe(spark, sf_dir):
    cal = calendar(spark, sf_dir).withColumn("date", F.to_date("date"))
    return keep_first(cal, ["listing_id", "date"], CALENDAR_ORDER,
                      values=["available", "adjusted_price", "minimum_nights"])


# E3 + E4 multi-hot with data vocabulary; flags folded back into a sorted '|' list to compare
@register("amenity_multi_hot", f"""
WITH {lst_cte(False)},
t AS (SELECT id, unnest(string_split({amenity_norm_sql('amenities')}, ',')) AS tok FROM lst),
u AS (SELECT DISTINCT id, {amenity_rename_sql('tok')} AS tok FROM t WHERE tok <> '')
SELECT id, CAST(count(*) AS INTEGER) AS n_flags, string_agg(tok, '|' ORDER BY tok) AS flags
FROM u GROUP BY id
""")
def q_amenity_multi_hot(spark, sf_dir):
    df = listings(spark, sf_dir, with_nulls=False).select("id", amenity_token_set("amenities").alias("tokens"))
    vocab = vocabulary(df, "tokens")
    wide = multi_hot(df, "tokens", vocab)
    return folded_flags(wide, ("id",))


@register("amenity_vocabulary", f"""
WITH {lst_cte(False)},
t AS (SELECT id, unnest(string_split({amenity_norm_sql('amenities')}, ',')) AS tok FROM lst),
u AS (SELECT DISTINCT id, {amenity_rename_sql('tok')} AS tok FROM t WHERE tok <> '')
SELECT tok AS token, count(*) AS n_listings FROM u GROUP BY tok
""")
def q_amenity_vocabulary(spark, sf_dir):
    df = listings(spark, sf_dir, with_nulls=False).select("id", F.explode(amenity_token_set("amenities")).alias("token"))
    return df.groupBy("token").agg(F.count(F.lit(1)).alias("n_listings"))


# E5 ordinal codes
@register("brand_codes", """
SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand_code FROM part
""")
def q_brand_codes(spark, sf_dir):
    return category_codes(tables(spark, sf_dir).part.select("p_partkey", "p_brand"), "p_brand")


# E6 right-closed bins (prices on a 10-step grid so bin edges and <= 0 occur)
_BIN_PRICE_SQL = "floor(l_extendedprice / 2000) * 10 - 10"


def _bins_sql() -> str:
    edges = K.PRICE_BIN_EDGES
    whens = " ".join(f"WHEN price <= {edges[i]} THEN {i - 1}" for i in range(1, len(edges)))
    return f"""
SELECT l_orderkey, l_linenumber, price,
       CAST(CASE WHEN price IS NULL OR price <= {edges[0]} THEN NULL {whens} ELSE {len(edges) - 1} END AS INTEGER) AS price_bin
FROM (SELECT l_orderkey, l_linenumber, CAST({_BIN_PRICE_SQL} AS DOUBLE) AS price FROM lineitem)
"""


@register("price_bins", _bins_sql())
def q_price_bins(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    price = (F.floor(F.col("l_extendedprice") / 2000) * 10 - 10).cast("double")
    return li.select("l_orderkey", "l_linenumber", price.alias("price")).withColumn(
        "price_bin", right_closed_bin("price"))


# E7 global-mean fill
@register("mean_fill", """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_retailprice END AS x FROM part)
SELECT p_partkey, round(coalesce(x, (SELECT avg(x) FROM p)), 6) AS x FROM p
""")
def q_mean_fill(spark, sf_dir):
    p = tables(spark, sf_dir).part
    df = p.select("p_partkey", inject_null(F.col("p_retailprice"), F.col("p_partkey"), 0).alias("x"))
    return round_doubles(mean_fill(df, ["x"]))


# E8 neighbour fill, rounded half-even
@register("neighbour_fill_rooms", f"""
WITH {lst_cte()},
f AS ({naive_fill_sql('lst', K.LISTING_FILL_COLUMNS, True)})
SELECT id, bathrooms, bedrooms, beds FROM f
""")
def q_neighbour_fill_rooms(spark, sf_dir):
    df = listings(spark, sf_dir)
    return neighbour_fill(df, K.LISTING_FILL_COLUMNS, round_result=True).select("id", "bathrooms", "bedrooms", "beds")


# E9 neighbour fill, unrounded; and the notebook variant where 0 also counts as missing
def _priced_listings(spark, sf_dir, zeros: bool):
    df = listings(spark, sf_dir)
    x = inject_null(F.col("review_scores_rating"), F.col("id"), 4)
    if zeros:
        x = F.when(F.pmod(F.col("id"), F.lit(10)) == 6, F.lit(0.0)).otherwise(x)
    return df.withColumn("price_year_avg", x).withColumn("price_winter_avg", F.col("bedrooms") * 10)


_PRICED_SQL = (f"SELECT *, CASE WHEN id % 10 = 4 THEN NULL ELSE review_scores_rating END AS price_year_avg, "
               f"bedrooms * 10 AS price_winter_avg FROM lst")
_PRICED_ZERO_SQL = (f"SELECT *, CASE WHEN id % 10 = 6 THEN 0.0 WHEN id % 10 = 4 THEN NULL ELSE review_scores_rating END "
                    f"AS price_year_avg, bedrooms * 10 AS price_winter_avg FROM lst")


@register("neighbour_fill_prices", f"""
WITH {lst_cte()}, pr AS ({_PRICED_SQL}),
f AS ({naive_fill_sql('pr', ['price_year_avg', 'price_winter_avg'], False)})
SELECT id, {r('price_year_avg')}, {r('price_winter_avg')} FROM f
""")
def q_neighbour_fill_prices(spark, sf_dir):
    df = _priced_listings(spark, sf_dir, zeros=False)
    out = neighbour_fill(df, ["price_year_avg", "price_winter_avg"], round_result=False)
    return round_doubles(out.select("id", "price_year_avg", "price_winter_avg"))


@register("neighbour_fill_prices_zero_missing", f"""
WITH {lst_cte()}, pr AS ({_PRICED_ZERO_SQL}),
f AS ({naive_fill_sql('pr', ['price_year_avg'], False, zero_is_missing=True)})
SELECT id, {r('price_year_avg')} FROM f
""")
def q_neighbour_fill_prices_zero(spark, sf_dir):
    df = _priced_listings(spark, sf_dir, zeros=True)
    out = neighbour_fill(df, ["price_year_avg"], round_result=False, zero_is_missing=True)
    return round_doubles(out.select("id", "price_year_avg"))


# J5 band (range) self-join: neighbours per listing inside the open box, same room type
@register("band_join_neighbours", f"""
WITH {lst_cte(False)}
SELECT a.id, count(*) AS n_neighbours, {r('avg(b.review_scores_rating)', 'mean_rating')}
FROM lst a JOIN lst b ON a.room_type = b.room_type
 AND b.latitude > a.latitude - {HALF} AND b.latitude < a.latitude + {HALF}
 AND b.longitude > a.longitude - {HALF} AND b.longitude < a.longitude + {HALF}
GROUP BY a.id
""")
def q_band_join(spark, sf_dir):
    df = listings(spark, sf_dir, with_nulls=False).select("id", "room_type", "latitude", "longitude",
                                                         "review_scores_rating")
    # a count and a mean need no pairs: box sums per coordinate, joined back to the rows there
    df = df.withColumn("one", F.lit(1.0))
    sums = neighbour_sums(df, ["one", "review_scores_rating"], F.lit(True))
    rated = df.join(sums, ["room_type", "latitude", "longitude"])
    return round_doubles(rated.select("id", F.col("_n_one").alias("n_neighbours"),
                                      (F.col("_s_review_scores_rating") / F.col("_n_review_scores_rating")).alias("mean_rating")))


# J5 as pairs: each row with its neighbours (districts keep their number constant at every scale)
@register("band_join_pairs", f"""
WITH {lst_cte(False)}
SELECT a.id, b.id AS r_id, {r('b.review_scores_rating', 'r_rating')}
FROM lst a JOIN lst b ON a.room_type = b.room_type AND a.id <> b.id
 AND b.latitude > a.latitude - {HALF} AND b.latitude < a.latitude + {HALF}
 AND b.longitude > a.longitude - {HALF} AND b.longitude < a.longitude + {HALF}
""")
def q_band_join_pairs(spark, sf_dir):
    df = listings(spark, sf_dir, with_nulls=False).select("id", "room_type", "latitude", "longitude",
                                                         "review_scores_rating")
    pairs = band_pairs(df, df, "room_type", "latitude", "longitude", HALF, HALF).where("id <> r_id")
    return round_doubles(pairs.select("id", "r_id", F.col("r_review_scores_rating").alias("r_rating")))


# C2 listing features. The library keeps a row's amenities as one token set; the query shows it as a sorted list.
LISTING_FIXED = ("id", "description", "host_is_superhost", "latitude", "longitude", "room_type", "accommodates",
                 "bathrooms", "bedrooms", "beds", "entire_home_apt")


def c2_ctes() -> str:
    """CTEs of the listing features: lst, c2 (fixed columns), c2_tokens (id, tok), c2_flags (id, n_flags, flags)."""
    return f"""{lst_cte()},
first_rows AS (SELECT *, row_number() OVER (PARTITION BY latitude, longitude ORDER BY id) AS rn FROM lst),
c2 AS (SELECT id, description, CASE WHEN host_is_superhost = 't' THEN 1 ELSE 0 END AS host_is_superhost,
              latitude, longitude, room_type, accommodates, bathrooms, bedrooms, beds,
              CASE WHEN room_type = {q(K.HOME_ROOM_TYPE)} THEN 1 ELSE 0 END AS entire_home_apt, amenities
       FROM first_rows
       WHERE rn = 1 AND description IS NOT NULL
         AND room_type IN ({', '.join(q(x) for x in K.KEPT_ROOM_TYPES)})
         AND bedrooms <= {K.LISTING_CAPS['bedrooms']} AND beds <= {K.LISTING_CAPS['beds']}
         AND bathrooms <= {K.LISTING_CAPS['bathrooms']}),
c2_tokens AS (SELECT DISTINCT id, {amenity_rename_sql('tok')} AS tok
              FROM (SELECT id, unnest(string_split({amenity_norm_sql('amenities')}, ',')) AS tok FROM c2) t WHERE tok <> ''),
c2_flags AS (SELECT c2.id, CAST(count(tok) AS INTEGER) AS n_flags, coalesce(string_agg(tok, '|' ORDER BY tok), '') AS flags
             FROM c2 LEFT JOIN c2_tokens ON c2.id = c2_tokens.id GROUP BY c2.id)"""


@register("listing_features", f"""
WITH {c2_ctes()}
SELECT c2.* EXCLUDE (amenities), n_flags, flags FROM c2 JOIN c2_flags ON c2.id = c2_flags.id
""")
def q_listing_features(spark, sf_dir):
    return listed_tokens(C2.listing_features(listings(spark, sf_dir)), LISTING_FIXED)


_ROW = "row"


def document_words(spark, sf_dir):
    """(row, doc_id, n_chars, words) of the documents from a written table, so that texts are cut into words once; `row`
    tells the rows apart, as ids may repeat or be missing."""
    docs = tables(spark, sf_dir).documents
    words = docs.select(F.monotonically_increasing_id().alias(_ROW), "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                        F.array_distinct(word_tokens("text")).alias("words"))
    return written(words, "document-words", compression="zstd")


# E3 without a bound on the vocabulary: token codes by a joined rank table, over the words of whole documents
@register("word_code_sets", r"""
WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(regexp_replace(lower(text), '\d+', '', 'g'), '\p{L}+')) AS toks FROM documents),
u AS (SELECT doc_id, unnest(toks) AS tok FROM t),
v AS (SELECT tok, row_number() OVER (ORDER BY encode(tok)) - 1 AS code FROM (SELECT DISTINCT tok FROM u))
SELECT d.doc_id, CAST(count(v.code) AS INTEGER) AS n_codes, CAST(coalesce(sum(v.code), 0) AS BIGINT) AS code_sum
FROM documents d LEFT JOIN u ON d.doc_id = u.doc_id LEFT JOIN v ON u.tok = v.tok GROUP BY d.doc_id
""")
def q_word_code_sets(spark, sf_dir):
    codes = multi_hot_sets(document_words(spark, sf_dir), "words", "codes", key=_ROW)
    return codes.select("doc_id", F.size("codes").alias("n_codes"),
                        F.aggregate("codes", F.lit(0).cast("bigint"), lambda a, c: a + c).alias("code_sum"))


# E3 -> A5 / M11 / M4 over vocabularies of any size: the words of whole documents as one sparse vector per document
WORDS_CTE = r"""
t AS (SELECT doc_id, n_chars, list_distinct(regexp_extract_all(regexp_replace(lower(text), '\d+', '', 'g'), '\p{L}+')) AS toks FROM documents),
u AS (SELECT doc_id, n_chars, unnest(toks) AS token FROM t)"""


def word_vectors(spark, sf_dir):
    """((doc_id, n_chars, word_vector), (token, rank)) of the documents, written once per session and input."""
    from roomrate.sources.model_store import stored_table

    words = cache(lambda: document_words(spark, sf_dir))
    ranks = stored_table(spark, "words", sf_dir, lambda: token_uses(words(), "words"))
    vectors = stored_table(spark, "word-vectors", sf_dir, lambda: with_token_vectors(
        words(), "words", "word_vector", ranks, key=_ROW).drop(_ROW, "words"), vectors=("word_vector",))
    return vectors, ranks.select("token", "rank")


@register("word_vector_profile", f"""
WITH {WORDS_CTE}
SELECT token AS feature, {r('count(*) / (SELECT count(*) FROM documents)', 'mean')},
       round_even(count(*) / (SELECT count(*) FROM documents), 0) AS value FROM u GROUP BY token
""")
def q_word_vector_profile(spark, sf_dir):
    """E3 + A4 + A5: mean of every entry of a sparse vector as profile rows, by the tokens' names."""
    vectors, ranks = word_vectors(spark, sf_dir)
    means = vector_means(vectors, "word_vector", ranks)
    return round_doubles(means.select(F.col("token").alias("feature"), "mean", F.bround("mean", 0).alias("value")))


_WORD_SCORES_SQL = """
n AS (SELECT count(*) AS n, avg(n_chars) AS m, var_pop(n_chars) * count(*) AS syy FROM documents),
s AS (SELECT token, count(*) AS c, sum(n_chars - m) AS sxy FROM u, n GROUP BY token),
f AS (SELECT token, n, CASE WHEN c < n AND syy > 0 THEN sxy / sqrt((c - c * c / n) * syy) END AS r FROM s, n),
g AS (SELECT token, n, r, r * r / (1 - r * r) * (n - 2) AS f_score FROM f)"""


@register("word_vector_f_test", f"""
WITH {WORDS_CTE}, {_WORD_SCORES_SQL}
SELECT token, n, {r('r', 'r')}, {r('f_score', 'f_score', 4)} FROM g
""")
def q_word_vector_f_test(spark, sf_dir):
    """M11 over a sparse vector: F score of every word (one grouped sum per index) against the document's length."""
    vectors, ranks = word_vectors(spark, sf_dir)
    scores = vector_f_scores(vectors, "word_vector", "n_chars").join(ranks.withColumnRenamed("rank", "index"), "index")
    return scores.select("token", "n", F.round("r", 6).alias("r"), F.round("f_score", 4).alias("f_score"))


_TOP_WORDS = 12


@register("word_vector_ols", f"""
WITH {WORDS_CTE}, {_WORD_SCORES_SQL},
k AS (SELECT token FROM g ORDER BY round(f_score, 4) DESC NULLS LAST, token LIMIT {_TOP_WORDS})
SELECT token, 0.0 AS moment, TRUE AS explains FROM k
""")
def q_word_vector_ols(spark, sf_dir):
    """M4 + M11 + M12: least squares on the top words of the vector (VectorSlicer). The moments of the residuals with
    each chosen word, relative to the label's, are zero for the least-squares fit and for no other; `explains` is a
    smaller residual sum of squares than the label's own."""
    from roomrate.operators import models as ML

    vectors, ranks = word_vectors(spark, sf_dir)
    scores = vector_f_scores(vectors, "word_vector", "n_chars").withColumn("f_score", F.round("f_score", 4))
    top = top_entries(scores, ranks, _TOP_WORDS).collect()
    model = ML.fit_on_entries(vectors, "word_vector", [row["index"] for row in top], "n_chars", "lr", solver="normal")
    scored = model.transform(vectors).select(F.unwrap_udt("word_vector")["indices"].alias("entries"), "n_chars",
                                             (F.col("n_chars") - F.col("prediction")).alias("e"))
    mean = vectors.select(F.avg("n_chars")).scalar()
    size = F.sum(F.abs("n_chars"))
    stats = scored.agg(*[F.round(F.sum(F.when(F.array_contains("entries", F.lit(row["index"]).cast("int")), F.col("e")).otherwise(0.0)) / size, 6).alias(f"m{i}")
                         for i, row in enumerate(top)],
                       (F.sum(F.col("e") * F.col("e")) < F.sum((F.col("n_chars") - mean) * (F.col("n_chars") - mean))).alias("explains"))
    rows = F.array(*[F.struct(F.lit(row["token"]).alias("token"), (F.col(f"m{i}") + 0.0).alias("moment")) for i, row in enumerate(top)])
    return stats.select(F.explode(rows).alias("r"), "explains").select("r.token", F.abs("r.moment").alias("moment"), "explains")
