"""Periodic run detection (12): descending-LCP Kruskal over the suffixes of a text.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST_WORDS, TIMES * q) words that no
neighbouring word extends keeping the period. Per text:

* The suffixes (of words) are ordered by prefix doubling; the longest common prefixes (LCP) of neighbours come from the
  ranks kept of each doubling.
* Neighbours are edges. They are united by decreasing LCP with union-find; each class is an ordered set of positions,
  and the smaller set is put into the larger. Two positions i < j of different classes that become neighbours in the
  united set share exactly LCP words, so with j - i <= LCP they seed a run of period j - i that ends at j + LCP.
* Seeds of one end and period are one run, which begins at the smallest of them: the first two periods of a run become
  neighbours when they are united, as a position between them would give a smaller period. Multiples of a period are
  dropped. Nothing is hashed here: the runs are exact.
* Any run has two such positions with an LCP of `least_lcp()` words (16), so edges below it are left out, and a text whose
  16-word stretches are all unlike is not sorted at all.

Every text is worked on by itself, whole, in a task: there is no shuffle. Memory is about 200 bytes for each word of the
longest text of a task.

Defined results: null or empty text has no words and no runs; a null doc_id leaves the words as they are; very long texts
are handled whole; ties between runs go to the smaller start, then period; repeated rows are handled one by one; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from fractions import Fraction
from itertools import count, cycle, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomrate.llm import textops as X

LEAST_WORDS = 24
TIMES = 3
#: rows whose texts are taken out of a batch at once
ROWS = 64
#: positions of one block of an ordered set
BLOCK = 1024

SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>")


class OrderedSet:
    """Ascending positions in blocks, so that putting one in costs about the root of their number."""

    __slots__ = ("blocks", "lows", "size")

    def __init__(self, first: int):
        self.blocks, self.lows, self.size = [[first]], [first], 1

    def add(self, x: int) -> tuple[int, int]:
        """Put x in; (position before it, position after it), -1 where there is none."""
        b = max(0, bisect_right(self.lows, x) - 1)
        block = self.blocks[b]
        at = bisect_right(block, x)
        before = block[at - 1] if at else -1
        after = block[at] if at < len(block) else (self.lows[b + 1] if b + 1 < len(self.lows) else -1)
        block.insert(at, x)
        self.lows[b] = block[0]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[b: b + 1] = [block[:BLOCK], block[BLOCK:]]
            insort(self.lows, block[BLOCK])
        return before, after

    def __iter__(self):
        for block in self.blocks:
            yield from block


def least_lcp(least: int = LEAST_WORDS, times: int = TIMES) -> int:
    """Words that the first two periods of any run have in common, at least."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def repeats(ids: np.ndarray, words: int) -> bool:
    """False if no stretch of `words` ids, or of the largest power of two below it, occurs twice (by hash)."""
    h, have = X.mix64(ids.astype(np.uint64) + np.uint64(1)), 1
    while 2 * have <= words:
        h = X.mix64(h[:-have] * X.multiplier(1) + h[have:] * X.multiplier(2))
        have *= 2
    return len(np.unique(h)) < len(h)


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the order of their suffixes, LCP of each with the next)."""
    n = len(ids)
    levels, step = [np.unique(ids, return_inverse=True)[1].astype(np.int64)], 1
    while levels[-1].max() < n - 1:
        rank = levels[-1]
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        levels.append(np.unique(key, return_inverse=True)[1].astype(np.int64))
        step *= 2
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    i, j, common = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for rank in reversed(levels):
        step, rank = max(1, step), np.append(rank, -1)
        same = (i < n) & (j < n)
        same[same] = rank[i[same]] == rank[j[same]]
        i[same] += step
        j[same] += step
        common[same] += step
        step //= 2
    return order, common


def seeds(order: np.ndarray, common: np.ndarray, least: int) -> dict[tuple[int, int], int]:
    """(end, period) -> smallest start of the seeds, from edges of at least `least` words."""
    edges = np.flatnonzero(common >= least)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    up: dict[int, int] = {}
    sets: dict[int, OrderedSet] = {}
    found: dict[tuple[int, int], int] = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def seed(i, j, lcp):
        if j - i <= lcp and found.get((j + lcp, j - i), j) > i:
            found[j + lcp, j - i] = i

    for x, y, lcp in zip(order[edges].tolist(), order[edges + 1].tolist(), common[edges].tolist(), strict=True):
        x, y = root(x), root(y)
        large, small = sets.get(x) or OrderedSet(x), sets.pop(y, None) or OrderedSet(y)
        sets.pop(x, None)
        if large.size < small.size:
            x, y, large, small = y, x, small, large
        up[y] = x
        own = list(small) if small.size > 1 else [y]
        for at, z in enumerate(own):
            before, after = large.add(z)
            if before >= 0 and not (at and before == own[at - 1]):
                seed(before, z, lcp)
            if after >= 0 and not (at + 1 < len(own) and own[at + 1] < after):
                seed(z, after, lcp)
        sets[x] = large
    return found


def runs_of(ids: np.ndarray, least: int = LEAST_WORDS, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, by start, then period."""
    lcp = least_lcp(least, times)
    if len(ids) < least or not repeats(ids, lcp):
        return []
    by_end: dict[int, list[tuple[int, int]]] = {}
    for (end, period), start in seeds(*suffix_order(ids), lcp).items():
        if end - start >= max(least, times * period):
            by_end.setdefault(end, []).append((period, start))
    out = []
    for end, own in by_end.items():
        for period, start in own:
            if not any(q < period and period % q == 0 and s <= start for q, s in own):
                out.append((start, end - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of one document in ten with all words from some place on repeating a stretch from there."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + list(islice(cycle(words[a: a + p]), n - a))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that follow the first period of a run."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _row(doc_id: int | None, text: str | None) -> tuple:
    words = made_periodic((text or "").encode().split(), doc_id)  # on bytes, split() knows exactly \x20 and \x09-\x0D
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, count()), np.int64, len(words))
    runs = runs_of(ids)
    best = (None,) * 4
    if runs:
        start, length, period = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (start, length, period, 1000 * length // period)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(words), len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
            [{"start": s, "length": n, "period": q} for s, n, q in runs])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of SCHEMA for every row of docs; runs lists all of the text's runs."""
    fields = [part.split()[0] for part in SCHEMA.split(", ")]

    def run(batches):
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        types = [pa.int64()] * 7 + [pa.string()] * 2 + [run_type]
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows = [_row(d, t) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=fields)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA))
