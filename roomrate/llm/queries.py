"""The registered queries of this folder: one per operator, over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomrate.sources.tables import read_table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomrate.llm.ngram_jaccard import near_components

    return near_components(read_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomrate.llm.language_id import held_out, predicted, train

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = train(docs, ~F.col("held_out"))
    return predicted(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomrate.llm.html_extract import extracted

    return extracted(read_table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomrate.llm.line_dedup import without_boilerplate

    return without_boilerplate(read_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomrate.llm.mixing import DEFAULT_TARGET, TARGETS, scheduled

    return scheduled(read_table(spark, sf_dir, "documents"), TARGETS, DEFAULT_TARGET)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomrate.llm.sharding import sharded

    return sharded(read_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomrate.llm.pii import private_spans

    return private_spans(read_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomrate.llm.suffix_dedup import listed, repeated_passages

    return listed(repeated_passages(read_table(spark, sf_dir, "documents")))


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomrate.llm.hnsw import neighbours

    return neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomrate.llm.decontaminate import contamination, digest

    return digest(contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomrate.llm.quality import quality_scores

    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomrate.llm.periodic_runs import periodic_runs

    return periodic_runs(read_table(spark, sf_dir, "documents")).drop("runs")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomrate.llm.merkle import manifest, verified

    return verified(manifest(read_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_ngram_jaccard, op2_language_id, op3_html_extract, op4_line_dedup, op5_mixing, op6_sharding, op7_pii,
        op8_suffix_dedup, op9_hnsw, op10_decontaminate, op11_quality, op12_periodic_runs, op13_merkle)}


def oracle_sql() -> dict[str, str]:
    """Twins of the operators that SQL expresses; the others are tested against brute force."""
    from roomrate.llm import line_dedup, merkle, suffix_dedup

    return {"op4_line_dedup": line_dedup.sql(), "op8_suffix_dedup": suffix_dedup.sql(), "op13_merkle": merkle.sql()}
