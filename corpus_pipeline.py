"""Corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

1 language_id         drops documents without letters or whose language stays a toss-up (op 2)
2 near_duplicates     keeps one row of each group of near copies, of the smallest doc_id: five words, 0.8 (op 1)
3 decontaminate       drops documents that hold ten consecutive words of a benchmark item (op 10)
4 mix                 brings the sources to the target weights while sources of most of the weight last: rows beyond go (op 5)
5 shard               places what is left on shards (op 6)

All but the last return the columns of documents. Null texts go in stage 1. Stages 2 to 4 tell rows apart by a key of
their own, not by doc_id: rows with a null doc_id, and rows of one doc_id with unrelated texts, are documents like
others (of near copies, a null doc_id counts as the largest). Repeated rows are copies; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomrate.llm.decontaminate import without_contaminated
from roomrate.llm.language_id import UNKNOWN, prediction, train
from roomrate.llm.mixing import DEFAULT_TARGET, TARGETS, mixed
from roomrate.llm.ngram_jaccard import near_components
from roomrate.llm.sharding import sharded
from roomrate.llm.storage import KEY, keyed, written
from roomrate.sources.tables import read_table

#: below this posterior probability no language is told
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = docs.withColumn("__told", prediction(spark, train(docs, F.lit(True))))
    return told.where((F.col("__told.lang_pred") != UNKNOWN) & (F.col("__told.score") >= LEAST_SCORE)).drop("__told")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    groups = near_components(rows, k=5, num=80, den=100, id_col=KEY).select(F.col("doc_id").alias(KEY), "n_shingles", "component_id")
    # texts without words are no near copies: of these only rows that repeat whole go
    bare = F.col("n_shingles") == 0
    told = (rows.select(KEY, F.col("doc_id").alias("__id"), F.xxhash64(*docs.columns).alias("__digest"),
                        F.when(F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)), F.struct(*docs.columns)).alias("__row"))
            .join(groups, KEY)
            .select(F.when(~bare, F.col("component_id")).alias("__group"), F.when(bare, F.col("__row")).alias("__row"),
                    F.struct(F.col("__id").isNull().alias("null"), F.col("__id").alias("id"), F.col("__digest").alias("digest"),
                             F.col(KEY).alias("key")).alias("__first")))
    stays = told.groupBy("__group", "__row").agg(F.min("__first")["key"].alias(KEY)).select(KEY)
    return rows.join(stays, KEY, "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str, targets: dict = TARGETS, default: float = DEFAULT_TARGET) -> DataFrame:
    return mixed(docs, targets, default)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharded(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("mix", mix), ("shard", shard)]

#: Fingerprints, hashes and trained models are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents one after the other."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
