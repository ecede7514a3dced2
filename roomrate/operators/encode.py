"""Encoding and simple imputation.

`multi_hot_sets` takes a vocabulary of any size: the tokens of each row stay an
array, and codes come from a rank table that is joined, so nothing is collected
(operators/vectors.py makes sparse vectors of them, which the feature table, the
profile and the models use). Most uses are of few tokens: the codes of those, up
to FREQUENT of them, are broadcast, and only uses of the others are shuffled by
token. Category codes use the same rank table. The wide layout (one column per
token) is there for callers that want it: its names go through the driver, as
any schema does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomrate.functions.scalar import min_max_scaled

FREQUENT = 1 << 16  # most tokens whose codes are broadcast


def ranked(values: DataFrame, column: str, uses: str | None = None) -> DataFrame:
    """(column, rank): 0, 1, ... over the distinct non-NULL values in ascending order, by a range sort; with a name
    for `uses`, also the number of rows of each value.
    Rows get their place within a sorted partition; partitions are moved up by the counts before them."""
    from roomrate.session import cut_lineage

    mask = (1 << 33) - 1
    some = values.select(column).where(F.col(column).isNotNull())
    once = some.groupBy(column).agg(F.count(F.lit(1)).alias(uses)) if uses else some.distinct()
    ordered = cut_lineage(once.orderBy(column).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    moved = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (ordered.withColumn("_part", part).join(moved, "_part")
            .select(column, (F.col("_before") + F.col("_id").bitwiseAND(F.lit(mask))).alias("rank"), *([uses] if uses else [])))


def frequent(ranks: DataFrame, uses: str = "uses", most: int = FREQUENT) -> DataFrame:
    """(token, rank) of the tokens of ranks (token, rank, uses) with at least 2^i uses, for the smallest i that leaves no
    more than `most` of them. Only the counts per power of two go through the driver."""
    level = F.floor(F.log2(uses)).cast("int")
    least, held = 63, 0
    for row in sorted(ranks.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        held += row["n"]
        if held > most:
            break
        least = row["level"]
    return ranks.where(level >= least).select("token", "rank")


def exploded_tokens(df: DataFrame, tokens_col: str) -> DataFrame:
    """(token): every non-empty token of an array column, a row each time."""
    return df.select(F.explode(F.col(tokens_col)).alias("token")).where(F.col("token") != "")


def token_table(df: DataFrame, tokens_col: str) -> DataFrame:
    """Distinct non-empty tokens of an array column, one row each (any size)."""
    return exploded_tokens(df, tokens_col).distinct()


def vocabulary(df: DataFrame, tokens_col: str) -> list[str]:
    """Sorted distinct tokens: the column names of the wide layout."""
    return [r["token"] for r in token_table(df, tokens_col).orderBy("token").collect()]


def multi_hot(df: DataFrame, tokens_col: str, vocab: list[str] | None = None, drop_tokens: bool = True) -> DataFrame:
    """One 0/1 int column per vocabulary token (sorted by name), in ONE select.
    Set-valued: a token repeated in a row still gives 1; '' never makes a column. A token that
    is also the name of a column raises, as silently replacing that column would lose data."""
    if vocab is None:
        vocab = vocabulary(df, tokens_col)
    base = [c for c in df.columns if not (drop_tokens and c == tokens_col)]
    clash = sorted(set(base) & set(vocab))
    if clash:
        raise ValueError(f"tokens of {tokens_col} are also columns: {', '.join(clash)}")
    flags = [F.array_contains(F.col(tokens_col), F.lit(v)).cast("int").alias(v) for v in vocab]
    return df.select(*base, *flags)


def multi_hot_sets(df: DataFrame, tokens_col: str, out_col: str = "token_codes", ranks: DataFrame | None = None,
                   key: str | None = None) -> DataFrame:
    """df with the sorted codes of each row's tokens, for vocabularies of any size; the code of a token is its
    rank in the sorted vocabulary, so code i is column i of the wide layout. `ranks` (token, rank) is another
    table's vocabulary; tokens that it lacks have no code. With a column `uses` its frequent tokens are broadcast,
    and only the others' uses are shuffled by token. `key` is a column that tells the rows apart, the same at each
    evaluation (from a written table): tokens then travel with it alone. Without it, rows with equal token sets
    share one lookup. (E3)"""
    codes = ranked(exploded_tokens(df, tokens_col), "token", "uses") if ranks is None else ranks
    tokens = F.array_distinct(tokens_col)
    if key is None:
        keys, keyed = ["_set"], df.withColumn("_set", F.sha2(F.to_json(F.array_sort(tokens)), 256))
        sets = keyed.groupBy("_set").agg(F.any_value(tokens_col).alias("_tokens")).select("_set", F.array_distinct("_tokens").alias("_tokens"))
    else:
        keys, keyed = [key], df
        sets = df.select(key, tokens.alias("_tokens"))
    uses = sets.select(*keys, F.explode("_tokens").alias("token"))
    if "uses" in codes.columns:
        often = F.broadcast(frequent(codes))
        rare = codes.join(often, "token", "left_anti").select("token", "rank")
        pairs = (uses.join(often, "token").select(*keys, "rank")
                 .unionAll(uses.join(often, "token", "left_anti").join(rare, "token").select(*keys, "rank")))
    else:
        pairs = uses.join(codes, "token").select(*keys, "rank")
    found = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list("rank")).alias("_codes"))
    return (keyed.join(found, keys, "left")
            .select(*df.columns, F.coalesce(F.col("_codes"), F.array().cast("array<bigint>")).alias(out_col)))


def category_codes(df: DataFrame, column: str, out_col: str | None = None) -> DataFrame:
    """Ordinal codes in sorted category order; missing -> -1. Any number of categories: the codes are a
    rank table joined to the rows (Spark broadcasts it when small). (E5)"""
    codes = ranked(df, column).withColumnRenamed("rank", "_rank")
    return (df.join(codes, column, "left")
            .select(*df.columns, F.coalesce(F.col("_rank"), F.lit(-1)).cast("int").alias(out_col or f"{column}_code")))


def mean_fill(df: DataFrame, columns) -> DataFrame:
    """Fill NULLs with the column mean over the whole frame (one scalar subquery each)."""
    out = df
    for c in columns:
        m = df.select(F.avg(F.col(c))).scalar()
        out = out.withColumn(c, F.coalesce(F.col(c), m))
    return out


def min_max_scale(df: DataFrame, columns, suffix: str = "") -> DataFrame:
    """(x - min) / (max - min) per column; min/max from one scalar-subquery aggregate. (F16)"""
    out = df
    for c in columns:
        lo = df.select(F.min(F.col(c))).scalar()
        hi = df.select(F.max(F.col(c))).scalar()
        out = out.withColumn(c + suffix, min_max_scaled(F.col(c).cast("double"), lo, hi))
    return out


def or_gram_flags(df: DataFrame, hits_col: str, vocab) -> DataFrame:
    """Set a multi-hot flag to 1 when the token also occurs among the text-gram hits of the row
    (X2: grams matched against the vocabulary, OR-ed into the E3 flags). Flags absent from the
    frame are added. Narrow, one select."""
    vocab = list(vocab)
    hit = {v: F.array_contains(F.col(hits_col), F.lit(v)).cast("int") for v in vocab}
    out = [F.greatest(F.col(c), hit[c]).alias(c) if c in hit else F.col(c) for c in df.columns]
    out += [hit[v].alias(v) for v in vocab if v not in df.columns]
    return df.select(*out)
