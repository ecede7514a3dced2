"""Sharding (6): rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number u in (0, 1) for a key from a hash of (key, shard); the key goes to the shard of
the smallest -ln(u) / weight. A shard's share of the keys is its share of the weights, and a shard that is
added takes keys only into itself, as all other draws stay as they are. Every step is a column expression;
the slots within shards come from numbering.py.

Defined results: a null key is a key of its own; repeated rows go to one shard and take a slot each; null
text has no bytes and the CRC of the empty text; ties go to the lower shard; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomrate.llm.numbering import numbered

SHARDS = 16


def shard_of(key: Column, weights: list[float]) -> Column:
    """Shard (index into weights) of a key."""
    draws = [F.struct((-F.log((F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11) + 0.5) / float(1 << 53)) / float(w)).alias("d"),
                      F.lit(s).alias("s")) for s, w in enumerate(weights)]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["s"]


def sharded(docs: DataFrame, weights: list[float] | None = None, added: float = 1.0, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs; grown_shard is the shard
    once a further one of weight `added` is there."""
    weights = [1.0] * SHARDS if weights is None else weights
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    rows = rows.withColumns({"law": F.lit("key"), "shard": shard_of(F.col("doc_id"), weights),
                             "grown_shard": shard_of(F.col("doc_id"), [*weights, added])})
    return (numbered(rows, F.col("shard"), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot",
                     F.xxhash64("doc_id", "text_crc32", "size"))  # rows of a null or repeated id are no one cell
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
