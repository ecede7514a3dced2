"""Mixing sources to target weights (5): Pfair scheduling.

Each source's rows are numbered and cut into blocks of equally many rows. While all sources last, a source of weight w
has the share w / W of the slots (one block each), W being the weights' sum; once a source is used up, the others'
shares are renormalised, so a small source costs no rows of any other. That is a fluid schedule: its j-th block begins
and ends at two points of time, whose floor and ceiling are the block's release and deadline, in exact whole-number
arithmetic with the weights as they are. The schedule gives each slot to the released block of the earliest deadline
(ties: the source that sorts first). The fluid schedule fills every slot, so no deadline is missed and none is idle: after
any number of slots each source has had its share, less than one block off.

The mix ends when the sources that still have rows hold LEAST_ACTIVE of the target weights or less, as what follows would be
no mix at target weights. Rows beyond are marked as not in the mix; no row is repeated. The registered query and
stage 4 of the pipeline mix to TARGETS and DEFAULT_TARGET.

The driver goes through the blocks, not the rows: a block has as many rows as make SLOTS blocks of all rows, BLOCK_ROWS at
least, so there are SLOTS and one for each source at most (a hundred bytes each). Rows stay distributed and meet
their block by a join.

Defined results: sources without a weight get default_weight (0 leaves a source out); a null source is a source; repeated
rows, and rows with a null or repeated id, are rows; very long texts only pass through a digest; an empty table gives an
empty result; a weight that is negative raises; other columns are ignored.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomrate.llm.numbering import numbered
from roomrate.llm.storage import KEY, keyed, written

#: target weights of op5 and the pipeline's stage 4, whatever rows the sources have; DEFAULT_TARGET is that of the others
TARGETS: dict[str | None, int] = {"src0": 6}
DEFAULT_TARGET = 1
#: the mix ends when the sources that are not used up hold this part of the target weights or less
LEAST_ACTIVE = Fraction(1, 2)
DIGEST = "__row_digest"
#: rows of a block, at least, and blocks that all rows make, about
BLOCK_ROWS = 8
SLOTS = 1 << 17


def given(rows: dict[str | None, int], weights: dict[str | None, Fraction]) -> dict[str | None, int]:
    """Rows that each source of a weight gives to the mix."""
    ends = sorted((Fraction(rows[s]) / w, w) for s, w in weights.items())
    active, end = sum(weights.values()), Fraction(0)
    least = LEAST_ACTIVE * active
    for end, w in ends:
        active -= w
        if active <= least:
            break
    return {s: min(rows[s], int(end * w)) for s, w in weights.items()}


def turns(blocks: dict[str | None, int], weights: dict[str | None, Fraction]) -> list[tuple[str | None, int, int, int, int]]:
    """The schedule of the sources' blocks, all of them: (source, block from 0, release, deadline, slot)."""
    scale = lcm(*(w.denominator for w in weights.values()))
    names = sorted((s for s in weights if blocks[s]), key=lambda s: (s is not None, s))
    rate = {s: int(weights[s] * scale) for s in names}

    # phases of the fluid schedule: up to the time (in blocks per unit of rate) at which one more source is used up,
    # the slot of time v is used + active * v
    phases, active, used = [], sum(rate.values()), 0
    for end, s in sorted(((Fraction(blocks[s], rate[s]), s) for s in names), key=lambda x: x[0]):
        phases.append((end, active, used))
        active -= rate[s]
        used += blocks[s]
    at = dict.fromkeys(names, 0)

    def slot_of(s, j: int) -> int:
        """Slot, times the source's rate, at which its first j blocks end; phases are gone through once."""
        while phases[at[s]][0] * rate[s] < j:
            at[s] += 1
        _, a, u = phases[at[s]]
        return u * rate[s] + a * j

    def window(s, j: int) -> tuple[int, int]:
        return slot_of(s, j) // rate[s], -(-slot_of(s, j + 1) // rate[s])

    waiting = [(0, i, 0) for i in range(len(names))]
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for slot in range(sum(blocks[s] for s in names)):
        while waiting and waiting[0][0] <= slot:
            release, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window(names[i], j)[1], i, j, release))
        deadline, i, j, release = heapq.heappop(ready)
        out.append((names[i], j, release, deadline, slot))
        if j + 1 < blocks[names[i]]:
            heapq.heappush(waiting, (window(names[i], j + 1)[0], i, j + 1))
    return out


def scheduled(docs: DataFrame, weights: dict[str | None, float], default_weight: float = 1, block_rows: int = BLOCK_ROWS,
              id_col: str = "doc_id", source_col: str = "source", apart: tuple[str, ...] = (), slots: int = SLOTS) -> DataFrame:
    """(doc_id, source, block, release, deadline, slot, in_mix) of every row of docs; block, times and slot are null
    for rows that are not in the mix. Columns `apart`, the first a digest, tell rows of one id apart and come along."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), *apart,
                       *[] if apart else [F.xxhash64(*docs.columns).alias(DIGEST)])
    digest = apart[0] if apart else DIGEST
    placed = written(numbered(rows, F.col("source"), [F.col("doc_id"), F.col(digest), *map(F.col, apart[1:])], "at", F.xxhash64("doc_id", digest))
                     .select("doc_id", "source", *apart, "at"), "placed")
    sizes = {r["source"]: r["n"] for r in placed.groupBy("source").agg(F.count("*").alias("n")).collect()}  # a row per source
    each = {s: Fraction(str(weights.get(s, default_weight))) for s in sizes}
    if min(each.values(), default=0) < 0:
        raise ValueError("weights must be 0 or more")
    each = {s: w for s, w in each.items() if w}
    size = max(block_rows, -(-sum(sizes.values()) // slots))
    take = given(sizes, each)
    order = turns({s: -(-n // size) for s, n in take.items()}, each) if each else []
    table = spark.createDataFrame([(*turn, take[turn[0]]) for turn in order], "s string, block long, release long, deadline long, slot long, take long")
    there = F.col("source").eqNullSafe(F.col("s")) & (F.col("__block") == F.col("block")) & (F.col("at") < F.col("take"))
    return (placed.withColumn("__block", F.expr(f"at div {size}")).join(table, there, "left")
            .select("doc_id", "source", "block", "release", "deadline", "slot", F.col("slot").isNotNull().alias("in_mix"), *apart))


def mixed(docs: DataFrame, weights: dict[str | None, float], default_weight: float = 1, block_rows: int = BLOCK_ROWS,
          id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of docs that are in the mix, told apart by a key of the row: null and repeated ids are rows like others."""
    rows = keyed(docs.withColumn(DIGEST, F.xxhash64(*docs.columns)))
    chosen = scheduled(rows, weights, default_weight, block_rows, id_col, source_col, (DIGEST, KEY)).where("in_mix")
    return rows.join(chosen.select(KEY), KEY, "left_semi").select(*docs.columns)
