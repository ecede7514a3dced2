"""Spark ML models.

Re-aimed where the source used single-machine libraries:
  gradient boosting  -> ml.regression.GBTRegressor (depth 8, 200 rounds, step 0.1 by default)
  linear regression  -> ml.regression.LinearRegression (no regularisation)
  random forest      -> ml.regression.RandomForestRegressor (100 trees, all features, depth 30: Spark's greatest)
  text price bin     -> RegexTokenizer -> HashingTF(2^14) -> IDF -> multinomial LogisticRegression
                        (replaces the pretrained sentence-encoder fine-tune)
Fits are distributed (tree aggregation); driver loops only iterate over a small,
fixed list of candidates (k values, segments, period combos).
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool
from threading import Lock

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomrate import constants as K
from roomrate.functions.text import WORD_TOKEN_REGEX
from roomrate.operators.metrics import f_regression_scores, regression_metrics, top_k_features
from roomrate.operators.vectors import top_entries, vector_f_scores
from roomrate.session import ensure_checkpoint_dir, shared_path, written

TEXT_FEATURES = 1 << 14
PARALLEL_FITS = 4  # independent fits that are submitted to Spark at once
PARALLEL_MODELS = 8  # the same for models of segments: small fits of many short jobs, most of whose time is the driver's
FOREST_MEMORY_MB = 512  # statistics of the nodes that a forest splits in one pass (Spark: 256)
FOREST_NODES = 300_000  # most nodes of a forest that the driver holds at once (some 450 bytes each while they grow)
TASK_ROWS = 1 << 16  # rows that a task of a tree fit takes before there is a second one: every task has statistics of all nodes
SEED = 42
_growing = Lock()


def regressor(kind: str, **params):
    if kind == "gbt":
        p = {**K.GBT_PARAMS, **params}
        return GBTRegressor(featuresCol="features", labelCol="label", maxDepth=p["maxDepth"],
                            maxIter=p["maxIter"], stepSize=p["stepSize"], seed=SEED, checkpointInterval=10)
    if kind == "lr":
        return LinearRegression(featuresCol="features", labelCol="label", regParam=0.0,
                                solver=params.get("solver", "auto"))
    if kind == "rf":
        p = {**K.FOREST_PARAMS, **params}
        return RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=p["numTrees"],
                                     maxDepth=p["maxDepth"], featureSubsetStrategy=p["featureSubsetStrategy"],
                                     seed=SEED, checkpointInterval=10, cacheNodeIds=True, maxMemoryInMB=FOREST_MEMORY_MB)
    raise ValueError(kind)


def training_rows(df: DataFrame, label: str) -> DataFrame:
    """df with `label`, in no more partitions than the cluster has cores: a boosted fit is some thousand jobs, each with a
    task, and a result sent to the driver, per partition."""
    data = df.withColumn("label", F.col(label).cast("double"))
    return data.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def tree_rows(df: DataFrame, assembler, label: str) -> tuple[DataFrame, int]:
    """(`features` and `label` of df, their number), written once for the many jobs of a tree fit: a task of theirs carries the
    plan that its rows come from. A task takes TASK_ROWS rows, or more where no other core is left."""
    rows = written(assembler.transform(training_rows(df, label)).select("features", "label"), "fit-rows")
    n = rows.count()
    return rows.coalesce(max(1, min(-(-n // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism))), n


class GroupedForest:
    """A forest that was grown in groups of trees, each a saved model: groups are (path, trees, nodes). A prediction is the
    mean over the trees of all groups. Groups are loaded while they hold FOREST_NODES nodes or less together, for as many as that
    a row's sum is then written and the next ones are loaded, so that the driver never holds more."""

    def __init__(self, spark: SparkSession, groups):
        self.spark, self.groups = spark, [tuple(g) for g in groups]

    def transform(self, df: DataFrame) -> DataFrame:
        out, held = df.withColumn("_sum", F.lit(0.0)), 0
        for path, trees, nodes in self.groups:
            if held and held + nodes > FOREST_NODES:
                out, held = written(out, "forest-sums"), 0
            held += nodes
            scored = PipelineModel.load(path).transform(out)
            out = scored.withColumn("_sum", F.col("_sum") + F.col("prediction") * trees).drop("features", "prediction")
        return out.withColumn("prediction", F.col("_sum") / sum(trees for _, trees, _ in self.groups)).drop("_sum")

    def save(self, path: str) -> None:
        rows = self.spark.createDataFrame(self.groups, "path string, trees int, nodes long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/groups")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GroupedForest:
        return cls(spark, spark.read.parquet(f"{path}/groups").orderBy("path").collect())


def group_sizes(trees: int, at_once: int, side_by_side: int) -> list[list[int]]:
    """Waves of groups of trees: no more than at_once trees (one at least) a wave, dealt evenly to side_by_side groups at most."""
    waves = []
    while trees > 0:
        wave = max(1, min(trees, at_once))
        many = min(wave, side_by_side)
        waves.append([wave // many + (i < wave % many) for i in range(many)])
        trees -= wave
    return waves


def fit_forest(rows: DataFrame, n: int, assembler, **params) -> PipelineModel | GroupedForest:
    """The forest over n rows of `features` and `label`. Grown to the end a tree has up to twice as many nodes as it draws rows
    (63 % of them), and the driver holds those of trees that grow: where they can be more than FOREST_NODES, the trees are grown and saved in groups, as many at a
    time as stay below it by the nodes of the first trees. Groups of a forest grow side by side, forests one after the other. (M5)"""
    numTrees, most = {**K.FOREST_PARAMS, **params}["numTrees"], max(1, FOREST_NODES // max(1, 13 * n // 10))
    if numTrees <= most:
        return PipelineModel([assembler, regressor("rf", **params).fit(rows)])
    spark = rows.sparkSession
    folder = shared_path(spark, "forest-trees")

    def grown(job):
        i, trees = job
        model = regressor("rf", **{**params, "numTrees": trees}).setSeed(SEED + 1_000_003 * i).fit(rows)
        path = f"{folder}/{i:04d}"
        PipelineModel([assembler, model]).write().save(path)
        return path, trees, model.totalNumNodes

    with _growing:
        groups = [grown((0, most))]
        a_tree = -(-groups[0][2] // most)
        side_by_side = max(1, spark.sparkContext.defaultParallelism // rows.rdd.getNumPartitions())
        for wave in group_sizes(numTrees - most, FOREST_NODES // a_tree, side_by_side):
            with ThreadPool(len(wave)) as pool:
                groups += pool.map(grown, list(enumerate(wave, len(groups))), chunksize=1)
    return GroupedForest(spark, groups)


def _fitted(df: DataFrame, assembler, label: str, kind: str, **params) -> PipelineModel | GroupedForest:
    ensure_checkpoint_dir(df.sparkSession)
    if kind not in ("gbt", "rf"):
        return Pipeline(stages=[assembler, regressor(kind, **params)]).fit(training_rows(df, label))
    rows, n = tree_rows(df, assembler, label)
    if kind == "rf":
        return fit_forest(rows, n, assembler, **params)
    return PipelineModel([assembler, regressor(kind, **params).fit(rows)])


def fit_regression(df: DataFrame, features, label: str, kind: str = "gbt", **params) -> PipelineModel | GroupedForest:
    """Assemble features + fit. Input rows must be NULL-free in features and label. (M3, M4, M5)"""
    return _fitted(df, VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error"), label, kind, **params)


def fit_on_entries(df: DataFrame, vector: str, indices, label: str, kind: str = "gbt", **params) -> PipelineModel | GroupedForest:
    """Slice the given entries of a vector column + fit."""
    slicer = VectorSlicer(inputCol=vector, outputCol="features", indices=[int(i) for i in indices])
    return _fitted(df, slicer, label, kind, **params)


def text_classifier(text: str, label: str, num_classes: int | None = None, max_iter: int = 50) -> Pipeline:
    """Text -> class (multinomial) or 0/1 (binomial). (M6, M7)"""
    family = "binomial" if num_classes == 2 else "multinomial"
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=WORD_TOKEN_REGEX, gaps=False, toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=TEXT_FEATURES),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        LogisticRegression(featuresCol="_tfidf", labelCol=label, family=family, maxIter=max_iter,
                           probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred"),
    ])


def append_class(model: PipelineModel, df: DataFrame, out: str, label: str | None = None) -> DataFrame:
    """Append the predicted class (argmax) as an int column; with a binomial model this is
    prob > 0.5 (a tie at exactly 0.5 maps to 0). Also keeps the probability of `label`. (M8)"""
    scored = model.transform(df)
    cols = [c for c in df.columns] + [F.col("_pred").cast("int").alias(out)]
    if label is not None:
        cols.append(F.element_at(vector_to_array(F.col("_prob")), F.col(label).cast("int") + 1).alias(f"{out}_p_label"))
    return scored.select(*cols)


def predict(model: PipelineModel, df: DataFrame, out: str = "prediction") -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", out).drop("features")


def evaluate(model: PipelineModel, test: DataFrame, label: str) -> DataFrame:
    scored = model.transform(test.withColumn("label", F.col(label).cast("double")))
    return regression_metrics(scored, "label", "prediction")


def select_k_search(df: DataFrame, features, label: str, ks, kind: str = "gbt", is_test: str = "is_test", **params):
    """For each k: F-test top-k features over all rows (the source selects before it splits), fit on the train
    part, R^2 on the test part; returns rows (k, n_features, r2, mae) and best k. Values of k that
    choose the same features share one fit. (M11, M12)"""
    ranking = [r["feature"] for r in top_k_features(f_regression_scores(df, features, label), len(features)).collect()]
    train, test = df.where(~F.col(is_test)), df.where(F.col(is_test))

    def scored(n: int):
        m = evaluate(fit_regression(train, ranking[:n], label, kind, **params), test, label).first()
        return m["r2"], m["mae"]

    sizes = sorted({min(k, len(ranking)) for k in ks})
    with ThreadPool(PARALLEL_FITS) as pool:
        fitted = dict(zip(sizes, pool.map(scored, sizes), strict=True))
    rows = [(int(k), min(k, len(ranking)), *fitted[min(k, len(ranking))]) for k in ks]
    best = max((r for r in rows if r[2] is not None), key=lambda r: r[2], default=(None,))
    return rows, best[0]


def select_k_entries(df: DataFrame, vector: str, names: DataFrame, label: str, ks, kind: str = "gbt", is_test: str = "is_test",
                     name: str = "token", **params):
    """select_k_search over the entries of a vector column; names (name, rank) tells them apart. Only the indices of
    the largest k go through the driver. (M11, M12)"""
    top = top_entries(vector_f_scores(df, vector, label), names, max(ks), name).collect()
    ranking = [r["index"] for r in top]
    train, test = df.where(~F.col(is_test)), df.where(F.col(is_test))

    def scored(n: int):
        m = evaluate(fit_on_entries(train, vector, ranking[:n], label, kind, **params), test, label).first()
        return m["r2"], m["mae"]

    sizes = sorted({min(k, len(ranking)) for k in ks})
    with ThreadPool(PARALLEL_FITS) as pool:
        fitted = dict(zip(sizes, pool.map(scored, sizes), strict=True))
    rows = [(int(k), min(k, len(ranking)), *fitted[min(k, len(ranking))]) for k in ks]
    return rows, max((r for r in rows if r[2] is not None), key=lambda r: r[2], default=(None,))[0]


def fold_scores(df: DataFrame, features, label: str, folds: int, kind: str = "lr", fold: str = "fold", **params):
    """(fold, n, r2, mae): fit on the other folds, score on the fold."""
    out = []
    for k in range(folds):
        model = fit_regression(df.where(F.col(fold) != k), features, label, kind, **params)
        m = evaluate(model, df.where(F.col(fold) == k), label).first()
        out.append((k, int(m["n"]), m["r2"], m["mae"]))
    return out


def cross_validated(df: DataFrame, vector: str, label: str, choices, folds: int, kind: str = "lr", fold: str = "fold",
                    metric: str = "r2", **params) -> CrossValidatorModel:
    """Spark's cross-validation over the fold column: each choice of the vector's entries is fitted on the other folds and
    scored on each fold; avgMetrics has a mean for each choice, and bestModel is fitted on all rows. Fits run
    PARALLEL_FITS at a time. (M12, M16)"""
    ensure_checkpoint_dir(df.sparkSession)
    data = df.withColumn("label", F.col(label).cast("double")).select("label", vector, fold)
    slicer = VectorSlicer(inputCol=vector, outputCol="features")
    grid = [{slicer.indices: [int(i) for i in choice]} for choice in choices]
    return CrossValidator(estimator=Pipeline(stages=[slicer, regressor(kind, **params)]), estimatorParamMaps=grid,
                          evaluator=RegressionEvaluator(labelCol="label", metricName=metric), numFolds=folds, foldCol=fold,
                          parallelism=PARALLEL_FITS).fit(data)


def compare_models(segments: dict, features_of, label: str, kinds=("lr", "rf", "gbt"), is_test: str = "is_test",
                   params: dict | None = None):
    """Model x segment table rows (model, segment, label, n_test, r2, mae). Boosted fits take longest and begin first."""
    def scored(job):
        (name, rows), kind = job
        model = fit_regression(rows.where(~F.col(is_test)), features_of(rows), label, kind, **(params or {}).get(kind, {}))
        m = evaluate(model, rows.where(F.col(is_test)), label).first()
        return kind, name, label, int(m["n"]), m["r2"], m["mae"]

    order = sorted(kinds, key=("gbt", "rf", "lr").index)
    with ThreadPool(PARALLEL_MODELS) as pool:
        return pool.map(scored, [(segment, kind) for kind in order for segment in segments.items()], chunksize=1)
