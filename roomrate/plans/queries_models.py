"""Registered queries: splits, metrics, feature scoring and models.

Split/metric/F-test queries have DuckDB twins. Of fitted models, the twins check what
is determined (Spark ML's trees and logistic regression are not the source's
libraries; parity is by metric, see tests); their predictions and metrics are the
*_values queries, which have no twin. Fits have the source's size; a model or a table of
scores that several queries use is worked out once and read from the store.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from roomrate import constants as K
from roomrate.functions.bins import right_closed_bin
from roomrate.operators import metrics as M
from roomrate.operators import models as ML
from roomrate.operators import split as SP
from roomrate.operators.vectors import entries, top_entries, vector_f_scores
from roomrate.plans.common import listed_tokens, r, round_doubles, tables
from roomrate.plans.listings import VECTOR
from roomrate.plans.queries_encode import WORDS_CTE, word_vectors
from roomrate.plans.queries_scalar import listing_segments
from roomrate.plans.registry import register

# lineitem has no single-column key: (orderkey, linenumber, suppkey, partkey, shipdate) is unique
def _row_key():
    return F.concat_ws("|", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
                       F.col("l_shipdate").cast("string")).alias("row_key")
_ROW_KEY_SQL = ("concat_ws('|', l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(l_shipdate AS VARCHAR))")
_MD5 = f"md5(CAST({_ROW_KEY_SQL} AS VARCHAR))"


@register("hash_split", f"SELECT {_ROW_KEY_SQL} AS row_key, substr({_MD5}, 1, 1) < '4' AS is_test FROM lineitem")
def q_hash_split(spark, sf_dir):
    """M1: 75/25 split by md5 of the row key."""
    return SP.hash_split(tables(spark, sf_dir).lineitem.select(_row_key()), "row_key")


@register("kfold_sizes", f"""
SELECT CAST(('0x' || substr({_MD5}, 1, 13))::BIGINT % 5 AS INTEGER) AS fold, count(*) AS n FROM lineitem GROUP BY 1
""")
def q_kfold(spark, sf_dir):
    """Fold sizes of a 5-fold key-hash assignment."""
    f = SP.kfold(tables(spark, sf_dir).lineitem.select(_row_key()), "row_key", 5)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


def _bin_sql(x: str) -> str:
    edges = K.PRICE_BIN_EDGES
    whens = " ".join(f"WHEN {x} <= {edges[i]} THEN {i - 1}" for i in range(1, len(edges)))
    return f"CAST(CASE WHEN {x} IS NULL OR {x} <= {edges[0]} THEN NULL {whens} ELSE {len(edges) - 1} END AS INTEGER)"


@register("stratified_split", f"""
WITH b AS (SELECT {_ROW_KEY_SQL} AS row_key, {_bin_sql('l_extendedprice / 200')} AS price_bin FROM lineitem),
k AS (SELECT row_key, price_bin,
             row_number() OVER (PARTITION BY price_bin ORDER BY substr(md5(CAST(row_key AS VARCHAR)), 1, 13), row_key) AS rn,
             count(*) OVER (PARTITION BY price_bin) AS n FROM b WHERE price_bin IS NOT NULL),
c AS (SELECT *, CAST(ceil(0.4 * n) AS BIGINT) AS holdout FROM k)
SELECT row_key, price_bin,
       CASE WHEN rn <= n - holdout THEN 'train' WHEN rn <= n - CAST(ceil(0.5 * holdout) AS BIGINT) THEN 'val'
            ELSE 'test' END AS part
FROM c
""")
def q_stratified(spark, sf_dir):
    """M2: exact 60/20/20 per price bin without a window over a whole label."""
    li = tables(spark, sf_dir).lineitem.select(_row_key(), right_closed_bin(F.col("l_extendedprice") / 200).alias("price_bin"))
    return SP.stratified_split(li.where(F.col("price_bin").isNotNull()), "row_key", "price_bin", K.STRATIFIED_SHARES)


@register("regression_metrics", f"""
SELECT l_returnflag, count(*) AS n,
  {r('1 - sum(power(l_extendedprice - l_extendedprice * (1 - l_discount), 2)) / (var_pop(l_extendedprice) * count(l_extendedprice))', 'r2')},
  {r('avg(abs(l_extendedprice - l_extendedprice * (1 - l_discount)))', 'mae')}
FROM lineitem GROUP BY l_returnflag
""")
def q_reg_metrics(spark, sf_dir):
    """M9: R^2 and MAE per segment of a stand-in prediction."""
    li = tables(spark, sf_dir).lineitem.withColumn("pred", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return round_doubles(M.regression_metrics(li, "l_extendedprice", "pred", by=["l_returnflag"]))


@register("classification_metrics", f"""
WITH j AS (SELECT l.quality, CASE WHEN d.n_chars > 3000 THEN 1 ELSE 0 END AS pred FROM documents d JOIN labels l USING (doc_id))
SELECT count(*) AS n, {r('avg(CASE WHEN pred = quality THEN 1.0 ELSE 0.0 END)', 'accuracy')},
       {r('-avg(ln(CASE WHEN pred = quality THEN 0.8 ELSE 0.2 END))', 'log_loss')} FROM j
""")
def q_cls_metrics(spark, sf_dir):
    """Accuracy and log-loss of a stand-in classifier."""
    t = tables(spark, sf_dir)
    j = t.documents.join(t.labels, "doc_id").select(
        "quality", F.when(F.col("n_chars") > 3000, 1).otherwise(0).alias("pred"))
    j = j.withColumn("p_label", F.when(F.col("pred") == F.col("quality"), 0.8).otherwise(0.2))
    return round_doubles(M.classification_metrics(j, "quality", "pred", "p_label"))


_F_FEATURES = ("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey")


@register("f_test_top_k", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {r(f'corr({f}, l_extendedprice)', 'r')}, count(*) AS n, "
    f"{r(f'power(corr({f}, l_extendedprice), 2) / (1 - power(corr({f}, l_extendedprice), 2)) * (count(*) - 2)', 'f_score')} "
    f"FROM lineitem" for f in _F_FEATURES) + ") ORDER BY f_score DESC, feature LIMIT 3")
def q_ftest(spark, sf_dir):
    """Univariate F scores, best 3."""
    scores = M.f_regression_scores(tables(spark, sf_dir).lineitem, _F_FEATURES, "l_extendedprice")
    return round_doubles(M.top_k_features(scores, 3).select("feature", "r", "n", "f_score"))


@register("linear_one_feature", f"""
SELECT {r('regr_slope(l_extendedprice, l_quantity)', 'slope')}, {r('regr_intercept(l_extendedprice, l_quantity)', 'intercept')}
FROM lineitem
""")
def q_linear_one(spark, sf_dir):
    """M4 (one feature, checkable): OLS coefficients equal regr_slope / regr_intercept."""
    model = ML.fit_regression(tables(spark, sf_dir).lineitem, ["l_quantity"], "l_extendedprice", "lr", solver="normal")
    lr = model.stages[-1]
    return round_doubles(spark.createDataFrame([(float(lr.coefficients[0]), float(lr.intercept))],
                                               "slope double, intercept double"))


# ----------------------------------------------------------------------------------------------
# fitted models over the merged feature table. Spark ML's values are not the source's, so a query shows what is
# determined: the hold-out rows and labels, that every row has a prediction, and that the model beats the mean.
# ----------------------------------------------------------------------------------------------
def _merged(spark, sf_dir):
    from roomrate.plans.queries_jobs import materialised_merged

    return materialised_merged(spark, sf_dir)


def model_features(df, combo=K.PERIOD_COMBOS[0]) -> list[str]:
    """Numeric features of the merged table minus all period columns, the amenity vector, and the combo's availability
    and minimum-nights averages last. (P11)"""
    period = {c for c in df.columns if c.endswith("_avg")}
    base = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "vector") and c not in period | {"id", combo[2]}]
    return base + list(combo[:2])


def amenity_features(df, ranks):
    """(df with the vector `searched` of the superhost flag and the amenities alone, (token, rank) of its entries).
    (P11, the set that M12 searches)"""
    from pyspark.ml.feature import VectorAssembler

    searched = VectorAssembler(inputCols=["host_is_superhost", VECTOR], outputCol="searched").transform(df)
    first = df.sparkSession.createDataFrame([("host_is_superhost", 0)], "token string, rank long")
    return searched, first.union(ranks.select("token", F.col("rank") + 1))


def _tokens(spark, sf_dir):
    from roomrate.plans.queries_jobs import merged_features_and_tokens

    return merged_features_and_tokens(spark, sf_dir)[1]


def _split(spark, sf_dir):
    return SP.hash_split(_merged(spark, sf_dir), "id")


def price_model(spark, sf_dir, kind: str, combo=K.PERIOD_COMBOS[0]):
    """The model of a kind and period combo, fitted once on the 75 % split and read from the store."""
    from roomrate.sources.model_store import stored_model

    def fit():
        df = _split(spark, sf_dir)
        return ML.fit_regression(df.where(~F.col("is_test")), model_features(df, combo), combo[2], kind)

    return stored_model(spark, f"{kind}:{combo}", sf_dir, fit)


def _held_out_sql() -> str:
    from roomrate.plans.queries_jobs import _merged_ctes

    return f"""
WITH {_merged_ctes()},
h AS (SELECT CAST(id AS BIGINT) AS id, price_year_avg FROM f WHERE substr(md5(CAST(id AS VARCHAR)), 1, 1) < '4')
SELECT id, round(price_year_avg, 6) AS price_year_avg, TRUE AS has_prediction, TRUE AS sound FROM h
"""


def _held_out(spark, sf_dir, kind: str):
    """Hold-out rows with whether their prediction is one of a price like those that were fitted (within the range of
    the training labels, widened by its width on either side), and whether the model errs less than the mean does on the
    rows that it was fitted on. (The tables' prices are drawn at random: no model beats the mean on the hold-out; see
    price_model_values.)"""
    label = K.PERIOD_COMBOS[0][2]
    df = _split(spark, sf_dir)
    model = price_model(spark, sf_dir, kind)
    train = df.where(~F.col("is_test"))
    fitted = ML.evaluate(model, train, label)
    ends = train.agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    rows = ML.predict(model, df.where(F.col("is_test")))
    return round_doubles(rows.select("id", label, F.col("prediction").between(lo - (hi - lo), hi + (hi - lo)).alias("has_prediction"),
                                     (fitted.select("r2").scalar() > 0).alias("sound")))


@register("gbt_price_model", _held_out_sql())
def q_gbt(spark, sf_dir):
    """M3: gradient-boosted trees (depth 8, 200 rounds) on the 75 % split, the 25 % hold-out."""
    return _held_out(spark, sf_dir, "gbt")


@register("forest_price_model", _held_out_sql())
def q_rf(spark, sf_dir):
    """M5: random forest (100 trees, all features, depth 30), the hold-out."""
    return _held_out(spark, sf_dir, "rf")


@register("linear_price_model", _held_out_sql())
def q_lr(spark, sf_dir):
    """M4: linear regression, the hold-out."""
    return _held_out(spark, sf_dir, "lr")


@register("price_predictions_values")
def q_price_predictions(spark, sf_dir):
    """M3 + M4 + M5: the three models' predictions of the hold-out."""
    out = _split(spark, sf_dir).where(F.col("is_test"))
    for kind in ("lr", "rf", "gbt"):
        out = ML.predict(price_model(spark, sf_dir, kind), out, f"predicted_{kind}")
    return out.select("id", K.PERIOD_COMBOS[0][2], "predicted_lr", "predicted_rf", "predicted_gbt")


@register("price_model_values")
def q_price_model_values(spark, sf_dir):
    """M3 + M4 + M5 + M9: R^2 and MAE of the three models on the rows they were fitted on and on the hold-out, beside the MAE
    of the training mean."""
    label = K.PERIOD_COMBOS[0][2]
    df = _split(spark, sf_dir)
    mean = df.where(~F.col("is_test")).select(F.avg(label)).scalar()
    out = None
    for kind in ("lr", "rf", "gbt"):
        scored = price_model(spark, sf_dir, kind).transform(df.withColumns({"label": F.col(label), "_off": F.abs(F.col(label) - mean)}))
        rows = (M.regression_metrics(scored, "label", "prediction", by=["is_test"])
                .join(scored.groupBy("is_test").agg(F.avg("_off").alias("mae_of_mean")), "is_test"))
        rows = rows.select(F.lit(kind).alias("model"), F.when(F.col("is_test"), "hold-out").otherwise("fitted").alias("rows"), "n", "r2", "mae", "mae_of_mean")
        out = rows if out is None else out.union(rows)
    return out


def _fold_sql() -> str:
    from roomrate.plans.queries_jobs import _merged_ctes

    return f"""
WITH {_merged_ctes()}
SELECT CAST(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 13))::BIGINT % 5 AS INTEGER) AS fold, count(*) AS n, TRUE AS scored
FROM f GROUP BY 1
"""


@register("kfold_scores", _fold_sql())
def q_kfold_scores(spark, sf_dir):
    """Linear regression fitted on four folds and scored on the fifth, for each fold."""
    return q_kfold_values(spark, sf_dir).select("fold", "n", _possible().alias("scored"))


def _docs_with_bins(spark, sf_dir):
    d = tables(spark, sf_dir).documents
    return d.select("doc_id", "text", right_closed_bin(F.col("n_chars") / 20).alias("length_bin"))


def _parts_sql(source: str, label: str) -> str:
    """CTE `parts` (doc_id, label, part): exact 60/20/20 of each label in the order of the key's hash."""
    return f"""
k AS (SELECT doc_id, {label}, row_number() OVER (PARTITION BY {label} ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 13), doc_id) AS rn,
             count(*) OVER (PARTITION BY {label}) AS n FROM ({source}) s WHERE {label} IS NOT NULL),
c AS (SELECT *, CAST(ceil(round(0.4 * n, 10)) AS BIGINT) AS holdout FROM k),
parts AS (SELECT doc_id, {label}, CASE WHEN rn <= n - holdout THEN 'train' WHEN rn <= n - CAST(ceil(round(0.5 * holdout, 10)) AS BIGINT)
                 THEN 'val' ELSE 'test' END AS part FROM c)"""


@register("text_price_bin_model", f"""
WITH {_parts_sql("SELECT doc_id, " + _bin_sql("n_chars / 20") + " AS length_bin FROM documents", "length_bin")}
SELECT doc_id, part, length_bin, TRUE AS has_bin FROM parts
""")
def q_text_bins(spark, sf_dir):
    """M6 + M8: multinomial text classifier (stratified 60/20/20), predicted bin appended to every row."""
    docs = _docs_with_bins(spark, sf_dir).where(F.col("length_bin").isNotNull())
    parts = SP.stratified_split(docs, "doc_id", "length_bin", K.STRATIFIED_SHARES)
    train = parts.where(F.col("part") == "train").withColumn("_label", F.col("length_bin").cast("double"))
    model = ML.text_classifier("text", "_label").fit(train)
    scored = ML.append_class(model, parts, "pred_bin")
    return scored.select("doc_id", "part", "length_bin", F.col("pred_bin").between(0, len(K.PRICE_BIN_EDGES) - 1).alias("has_bin"))


@register("text_quality_classifier", f"""
WITH {_parts_sql("SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id", "quality")}
SELECT part, count(*) AS n, TRUE AS scored FROM parts WHERE part = 'test' GROUP BY part
""")
def q_text_binary(spark, sf_dir):
    """M7 + M8 + M10: binary text classifier on labelled documents; 0/1 appended, test metrics."""
    t = tables(spark, sf_dir)
    docs = t.documents.join(t.labels, "doc_id").select("doc_id", "text", "quality")
    parts = SP.stratified_split(docs, "doc_id", "quality", K.STRATIFIED_SHARES)
    train = parts.where(F.col("part") == "train").withColumn("_label", F.col("quality").cast("double"))
    model = ML.text_classifier("text", "_label", num_classes=2).fit(train)
    scored = ML.append_class(model, parts, "pred_quality", label="quality")
    m = M.classification_metrics(scored.where(F.col("part") == "test"), "quality", "pred_quality",
                                 "pred_quality_p_label", by=["part"])
    return m.select("part", "n", (F.col("accuracy").between(0, 1) & (F.col("log_loss") >= 0)).alias("scored"))


def _search_sql() -> str:
    from roomrate.plans.queries_jobs import _merged_ctes

    ks = ", ".join(f"({k})" for k in K.KBEST_CANDIDATES)
    return f"""
WITH {_merged_ctes()},
t AS (SELECT count(DISTINCT tok) + 1 AS n FROM c2_tokens)
SELECT CAST(k.k AS INTEGER) AS k, CAST(least(k.k, t.n) AS INTEGER) AS n_features, TRUE AS scored, CAST(1 AS BIGINT) AS n_best
FROM (VALUES {ks}) k(k), t
"""


@register("select_k_search", _search_sql())
def q_kbest(spark, sf_dir):
    """M11 + M12: F-test top-k of the amenity flags for each candidate k; fit; keep the best R^2."""
    found = q_select_k_values(spark, sf_dir)
    label = K.PERIOD_COMBOS[0][2]
    told = found.withColumns({"variance": _merged_variance(_split(spark, sf_dir).where(F.col("is_test")), label),
                              "_top": found.agg(F.max("r2")).scalar()})
    return told.select("k", "n_features", (_possible() & (~F.col("best") | (F.col("r2") == F.col("_top")))).alias("scored"),
                       found.agg(F.count_if("best")).scalar().alias("n_best"))


def _amenity_sql() -> str:
    from roomrate.plans.queries_jobs import _merged_ctes

    return f"""
WITH {_merged_ctes()}
SELECT CAST(f.id AS BIGINT) AS id, host_is_superhost, n_flags, flags, round(price_year_avg, 6) AS label
FROM f JOIN c2_flags ON f.id = c2_flags.id
"""


@register("amenity_projection", _amenity_sql())
def q_amenity_projection(spark, sf_dir):
    """The amenity-only feature set (a vector of the superhost flag and the amenities) with the label, told by
    the names of its entries."""
    df, names = amenity_features(_merged(spark, sf_dir), _tokens(spark, sf_dir))
    rows = df.select("id", "searched", F.col(K.PERIOD_COMBOS[0][2]).alias("label"))
    on = (entries(rows, "searched", ["id"]).join(names, F.col("index") == F.col("rank")).groupBy("id")
          .agg(F.array_sort(F.collect_list("token")).alias("on")))
    host, on_ = F.lit("host_is_superhost"), F.coalesce("on", F.array().cast("array<string>"))
    told = rows.join(on, "id", "left").select("id", F.array_contains(on_, host).cast("int").alias("host_is_superhost"),
                                              F.array_remove(on_, host).alias("amenities"), "label")
    return round_doubles(listed_tokens(told, ["id", "host_is_superhost"], others=["label"]))


def _segments_sql() -> str:
    from roomrate.plans.queries_jobs import _merged_ctes
    from roomrate.plans.queries_scalar import _SEGMENTS_SQL

    counts = " UNION ALL ".join(f"SELECT '{name}' AS segment, count(*) AS n_test FROM h WHERE {cond}" for name, cond in _SEGMENTS_SQL.items())
    return f"""
WITH {_merged_ctes()},
h AS (SELECT f.*, lst.neighbourhood FROM f JOIN lst ON f.id = lst.id WHERE substr(md5(CAST(f.id AS VARCHAR)), 1, 1) < '4'),
s AS ({counts})
SELECT m.model, s.segment, '{K.PERIOD_COMBOS[0][2]}' AS label, CAST(s.n_test AS INTEGER) AS n_test, TRUE AS scored
FROM s, (VALUES ('lr'), ('rf'), ('gbt')) m(model)
"""


@register("model_segment_table", _segments_sql())
def q_model_segments(spark, sf_dir):
    """M13 + M15: linear / forest / boosted models over the six segments, per period combo."""
    found = q_segment_values(spark, sf_dir)
    return found.select("model", "segment", "label", "n_test", ((F.col("r2") <= 1) & (F.col("mae") >= 0)).alias("scored"))


def _merged_variance(df, label: str):
    return df.agg(F.var_pop(label)).scalar()


def _possible():
    """R^2 and MAE that go together: the mean absolute error is not above the root of the mean squared one."""
    return (F.col("r2") <= 1) & (F.col("mae") >= 0) & (F.col("mae") <= F.sqrt((1 - F.col("r2")) * F.col("variance")) * (1 + 1e-9))


@register("kfold_values")
def q_kfold_values(spark, sf_dir):
    """N, R^2 and MAE of each fold, and the variance of its labels."""
    from roomrate.sources.model_store import stored_table

    def scores():
        df = SP.kfold(_merged(spark, sf_dir), "id", 5)
        rows = ML.fold_scores(df, [c for c in model_features(df) if c != "fold"], K.PERIOD_COMBOS[0][2], 5)
        table = spark.createDataFrame(rows, "fold int, n long, r2 double, mae double")
        return table.join(df.groupBy("fold").agg(F.var_pop(K.PERIOD_COMBOS[0][2]).alias("variance")), "fold")

    return stored_table(spark, "kfold-values", sf_dir, scores)


@register("select_k_values")
def q_select_k_values(spark, sf_dir):
    """R^2 and MAE of the hold-out for each number of amenity features, and the best number."""
    from roomrate.sources.model_store import stored_table

    def scores():
        df, names = amenity_features(_split(spark, sf_dir), _tokens(spark, sf_dir))
        rows, best = ML.select_k_entries(df, "searched", names, K.PERIOD_COMBOS[0][2], K.KBEST_CANDIDATES, "gbt")
        return spark.createDataFrame([(*row, row[0] == best) for row in rows], "k int, n_features int, r2 double, mae double, best boolean")

    return stored_table(spark, "select-k-values", sf_dir, scores)


@register("model_segment_values")
def q_segment_values(spark, sf_dir):
    """M13 + M15: n, R^2 and MAE of every model on every segment's hold-out, per period combo."""
    from roomrate.plans.common import listings
    from roomrate.sources.model_store import stored_table

    def scores():
        hoods = listings(spark, sf_dir, with_nulls=False).select("id", "neighbourhood")
        df = SP.hash_split(_merged(spark, sf_dir).join(hoods, "id", "left"), "id")
        segs = {name: df.where(pred) for name, pred in listing_segments().items()}
        rows = []
        for combo in K.PERIOD_COMBOS:
            rows += ML.compare_models(segs, lambda d, combo=combo: model_features(d, combo), combo[2], kinds=("lr", "rf", "gbt"))
        return spark.createDataFrame(rows, "model string, segment string, label string, n_test int, r2 double, mae double")

    return stored_table(spark, "segment-values", sf_dir, scores)


# cross-validation over a stored fold column, out-of-fold text bins
_CV_FOLDS, _CV_SIZES = 4, (2, 5, 10)


@register("cross_validated_k", f"""
WITH {WORDS_CTE}, c AS (SELECT count(DISTINCT token) AS words FROM u)
SELECT CAST(k AS INTEGER) AS k, CAST(least(k, words) AS INTEGER) AS n_features, TRUE AS means_agree, CAST(1 AS BIGINT) AS n_best
FROM (VALUES {', '.join(f'({k})' for k in _CV_SIZES)}) s(k), c
""")
def q_cross_validated_k(spark, sf_dir):
    """M11 + M12 + M16: how many of the best words of a sparse vector tell a document's length, by Spark's cross-validation
    over a stored fold column. means_agree compares the mean R^2 of each choice with a plain loop over the folds."""
    vectors, ranks = word_vectors(spark, sf_dir)
    df = SP.kfold(vectors, "doc_id", _CV_FOLDS)
    scores = vector_f_scores(vectors, "word_vector", "n_chars").withColumn("f_score", F.round("f_score", 4))
    top = [row["index"] for row in top_entries(scores, ranks, max(_CV_SIZES)).collect()]
    found = ML.cross_validated(df, "word_vector", "n_chars", [top[:k] for k in _CV_SIZES], _CV_FOLDS, solver="normal")
    best, rows = max(found.avgMetrics), []
    for k, mean in zip(_CV_SIZES, found.avgMetrics, strict=True):
        own = [ML.evaluate(ML.fit_on_entries(df.where(F.col("fold") != f), "word_vector", top[:k], "n_chars", "lr", solver="normal"),
                           df.where(F.col("fold") == f), "n_chars").first()["r2"] for f in range(_CV_FOLDS)]
        agree = abs(sum(own) / _CV_FOLDS - mean) <= 1e-6 * max(1.0, abs(mean))
        rows.append((k, len(top[:k]), bool(agree), sum(bool(m == best) for m in found.avgMetrics)))
    return spark.createDataFrame(rows, "k int, n_features int, means_agree boolean, n_best long")


_TEXT_FOLDS = 3


def _cross_text_sql() -> str:
    from roomrate.plans.queries_jobs import _merged_ctes

    return f"""
WITH {_merged_ctes()}
SELECT CAST(id AS BIGINT) AS id, CAST(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 13))::BIGINT % {_TEXT_FOLDS} AS INTEGER) AS fold,
       FALSE AS seen, TRUE AS has_bin FROM f
"""


@register("text_bin_cross_fit", _cross_text_sql())
def q_text_bin_cross_fit(spark, sf_dir):
    """M6 + M8 + M16: text bins out of fold. `seen` says whether the model that scored a row was fitted on rows of the row's
    own fold, by the folds stored with the model's training rows."""
    from roomrate.plans.merge import cross_text_bin

    merged = _merged(spark, sf_dir).select("id", F.coalesce("description", F.lit("")).alias("description"), "price_year_avg")
    scored = cross_text_bin(merged, _TEXT_FOLDS)
    return scored.select("id", "fold", F.array_contains("fitted_on", F.col("fold")).alias("seen"),
                         F.col("pred_price_year_avg_bin").between(0, len(K.PRICE_BIN_EDGES) - 1).alias("has_bin"))
