"""Token sets as sparse feature vectors, for vocabularies of any size.

A token's code is its rank in the sorted vocabulary, a table (token, rank) that is joined and never collected; code i
is column i of the wide multi-hot layout. A row's codes become a sparse ML vector without Python: the struct of a
vector's fields is written as Parquet, which every consumer reads from anyway, and read again as vectors. Names of
entries stay in the rank table. Means and F scores are grouped sums over the stored entries, so they cost what the
entries cost, not rows times vocabulary.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomrate.operators.encode import exploded_tokens, multi_hot_sets, ranked, token_table
from roomrate.session import shared_path


def token_ranks(df: DataFrame, tokens_col: str) -> DataFrame:
    """(token, rank) of the distinct non-empty tokens, by a range sort."""
    return ranked(token_table(df, tokens_col), "token")


def token_uses(df: DataFrame, tokens_col: str) -> DataFrame:
    """(token, rank, uses): token_ranks with the number of times that each token is there."""
    return ranked(exploded_tokens(df, tokens_col), "token", "uses")


def with_token_vectors(df: DataFrame, tokens_col: str, out_col: str, ranks: DataFrame, key: str | None = None) -> DataFrame:
    """df with `out_col`, the fields of a sparse 0/1 vector of the row's tokens; vector_schema() or written_vectors() makes
    it one. Tokens that are not in ranks have no entry; NULL tokens give the zero vector. For `key` and ranks with a
    column `uses`, see multi_hot_sets()."""
    size = ranks.count()
    coded = multi_hot_sets(df, tokens_col, "_codes", ranks, key)
    fields = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
                      F.col("_codes").cast("array<int>").alias("indices"),
                      F.transform("_codes", lambda _: F.lit(1.0)).alias("values"))
    return coded.select(*df.columns, fields.alias(out_col))


def vector_schema(schema: T.StructType, vectors: tuple[str, ...]) -> T.StructType:
    """schema with the columns `vectors` (structs of a vector's fields) as vectors, to read a written table by."""
    return T.StructType([T.StructField(f.name, VectorUDT() if f.name in vectors else f.dataType) for f in schema])


def written_vectors(df: DataFrame, name: str, vectors: tuple[str, ...]) -> DataFrame:
    """df from a Parquet table in the shared folder, its columns `vectors` (structs of a vector's fields) as vectors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(vector_schema(df.schema, vectors)).parquet(path)


def entries(df: DataFrame, vector: str, keep=()) -> DataFrame:
    """(keep..., index, x): one row for each stored entry of a vector column, sparse or dense."""
    v = F.unwrap_udt(F.col(vector))
    at = F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1))
    some = df.where(F.col(vector).isNotNull() & (F.size(v["values"]) > 0))
    return (some.select(*keep, F.explode(F.arrays_zip(at.alias("index"), v["values"].alias("x"))).alias("_e"))
            .select(*keep, F.col("_e.index").cast("bigint").alias("index"), "_e.x"))


def vector_means(df: DataFrame, vector: str, ranks: DataFrame, name: str = "token") -> DataFrame:
    """(name, mean) of every entry in ranks (name, rank), tokens that no row has among them; NULL over no rows. (A4, A5)"""
    n = df.select(F.count(vector)).scalar()
    sums = entries(df, vector).groupBy("index").agg(F.sum("x").alias("_sum"))
    return (ranks.join(sums, ranks["rank"] == sums["index"], "left")
            .select(name, F.try_divide(F.coalesce(F.col("_sum"), F.lit(0.0)), n).alias("mean")))


def vector_f_scores(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(index, r, n, f_score) with F = r^2 / (1 - r^2) * (n - 2) of every vector index that has an entry; the label is
    centred first, so one grouped sum of x, x^2 and x * y per index is enough. A constant entry or label has no r. (M11)"""
    rows = df.select(F.col(vector).alias("_v"), F.col(label).cast("double").alias("_y")).where("_v is not null and _y is not null")
    n, mean, spread = rows.agg(F.count("_y"), F.avg("_y"), F.var_pop("_y") * F.count("_y")).first()
    x, y = F.col("x"), F.col("_y") - F.lit(mean).cast("double")
    sums = entries(rows, "_v", ["_y"]).groupBy("index").agg(F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    within = F.col("sxx") - F.col("sx") * F.col("sx") / n
    square = within * F.lit(spread).cast("double")
    r = F.when((within > 1e-12 * F.col("sxx")) & (square > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sxy") / F.sqrt(square))))
    return (sums.select("index", r.alias("r"), F.lit(n).alias("n"))
            .withColumn("f_score", F.try_divide(F.col("r") * F.col("r"), F.lit(1.0) - F.col("r") * F.col("r")) * (F.col("n") - 2)))


def top_entries(scores: DataFrame, names: DataFrame, k: int, name: str = "token") -> DataFrame:
    """The k best (index, name, r, n, f_score) of names (name, rank), ties by name; entries without a score come last."""
    scored = names.join(scores, names["rank"] == scores["index"], "left").drop("index").withColumnRenamed("rank", "index")
    return scored.select("index", name, "r", "n", "f_score").orderBy(F.desc_nulls_last("f_score"), F.asc(name)).limit(k)


def named_flags(df: DataFrame, tokens_col: str, names) -> DataFrame:
    """df with a 0/1 column for each of the given tokens (a fixed, named choice, such as the fields of a request)."""
    has = F.coalesce(F.col(tokens_col), F.array().cast("array<string>"))
    return df.select("*", *[F.array_contains(has, F.lit(v)).cast("int").alias(v) for v in names])


def token_list(tokens_col) -> Column:
    """Distinct non-empty tokens, sorted."""
    return F.array_sort(F.array_distinct(F.filter(tokens_col, lambda t: t != "")))
