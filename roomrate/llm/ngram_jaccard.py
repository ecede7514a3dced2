"""N-gram Jaccard join (1): documents whose sets of word n-grams have a Jaccard similarity of at least num/den.

Method: size-banded tiles with hashed bitmap signatures; bit counts bound the overlap from above before
the exact intersection of sorted arrays.

* A document's set is its distinct k-word n-grams (64-bit hashes). Equal sets form one class at once, so
  exact copies cost one row each and are never paired.
* Sizes are cut into bands. Two sets that link have sizes within num/den of each other, so both occur in
  one band level; there they differ in at most `differ` hashes. Each set is cut by hash value into
  differ + 1 + spare ranges, of which at least 1 + spare are equal in both. A tile is (level, range,
  content of the range): linked sets meet in a tile, for certain, and unlike sets hardly ever do, as a
  tile asks for some five equal n-grams. (A set with more than `spare` empty ranges also enters the
  tiles of its empty ranges, which keeps the guarantee.)
* Within a tile, bitmaps are compared: one bit per hash value modulo the bitmap's length. Each bit that differs
  is one n-gram outside the intersection, so (a + b - differing bits) / 2 bounds the overlap from above. A tile
  is walked from set to set among those not reached yet, so a tile of like sets takes about one comparison
  for each. Tiles of the same sets are compared once; a tile of more than TILE sets is cut into blocks, and
  each pair of blocks is compared.
* Sets that the bound lets through, directly or through others, are a family. A link only joins sets of one
  family, so a family's components are worked out where its texts are gathered: exact intersection of the
  sorted arrays of n-grams, between rows of different components until none is left.
* A family of more than FAMILY n-grams in all is not gathered in one place: its sizes are banded, bands are cut
  into blocks, and each pair of blocks that can hold links is gathered for itself; the links that span them
  are joined up afterwards.

Defined results: null or blank text has no n-grams and links with nothing; a text of fewer than k words
is one n-gram; repeated rows and equal texts link; a null id is returned with its own null component;
an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomrate.llm import textops as X
from roomrate.llm.components import connected
from roomrate.llm.storage import written

#: sets of a tile that are compared in one place (1 to 2 bits per n-gram each)
TILE = 4096
#: n-grams of a family that is compared in one place (32 MB of hashes)
FAMILY = 4_000_000
#: bytes of text whose n-grams a task holds at once (some 50 bytes of arrays for each, kept by the worker once taken)
PIECE = 1 << 18


def sets_of(texts: pa.Array, k: int):
    """Per piece of the texts: (first row, end row, sorted distinct hashes, row of each, first index)."""
    for lo, hi, data, offsets in X.pieces(texts, PIECE):
        w = X.Words(data, offsets, X.NOT_SPACE)
        h, rows, _ = X.grams(w.hash, w.first, w.count, w.row, k, short=True)
        yield lo, hi, *X.sorted_sets(h, rows, hi - lo)


def set_keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each set."""
    return (X.mix64(X.segment_sums(X.mix64(h), first)), X.mix64(X.segment_sums(X.mix64(h * X.multiplier(91)), first)))


def bitmap(h: np.ndarray) -> bytes:
    """Bitmap of 1 to 2 bits per hash, a power of two long: bit (hash modulo length) of every hash."""
    m = max(64, 1 << (len(h) - 1).bit_length())
    bits = np.zeros(m, bool)
    bits[(h & np.uint64(m - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


@cache
def bands(num: int, den: int, up_to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower sizes of the bands, most differing hashes at each level, ranges at each level). Level i holds
    the pairs whose smaller set is in band i; the larger is then in band i or i + 1."""
    low = [1]
    while low[-1] <= up_to:
        low.append(max(low[-1] + 1, low[-1] * den * den // (num * num)))
    low = np.array(low, np.int64)
    a = low[1:] - 1
    differ = (den - num) * (a + a * den // num) // (den + num)
    return low, differ, differ + 2 + differ // 32


def signatures(h: np.ndarray, rows: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(tile, row) of every tile that the sets enter."""
    sizes = np.diff(first)
    low, differ, ranges = bands(num, den, 1 << int(sizes.max(initial=1) + 1).bit_length())
    own = np.searchsorted(low, sizes, side="right") - 1
    tiles, owners = [], []
    element = X.mix64(h)
    for step in (0, 1):
        level = own - step
        join = (sizes > 0) & (level >= 0)
        if step:
            join[join] = sizes[join] <= (low[own[join]] - 1) * den // num
        join[join] = differ[level[join]] > 0
        level = np.where(join, level, 0)
        p = np.where(join, ranges[level], 1).astype(np.uint64)
        take = join[rows]
        hh, rr, ee = h[take], rows[take], element[take]
        if not len(hh):
            continue
        part = ((hh >> np.uint64(32)) * p[rr]) >> np.uint64(32)
        new = np.ones(len(hh), bool)
        new[1:] = (part[1:] != part[:-1]) | (rr[1:] != rr[:-1])
        at = np.flatnonzero(new)
        content = X.segment_sums(ee, np.append(at, len(hh)))
        salt = X.mix64(level.astype(np.uint64) * X.multiplier(92) + np.uint64(1))
        r, q = rr[at], part[at]
        tiles.append(X.mix64(content + X.mix64(q * X.multiplier(93) + salt[r])))
        owners.append(r)
        full = np.bincount(r, minlength=len(sizes))
        spare = ranges[level] - differ[level]
        for i in np.flatnonzero(join & (p.astype(np.int64) - full >= spare)):
            empty = np.setdiff1d(np.arange(int(p[i]), dtype=np.uint64), q[r == i])
            tiles.append(X.mix64(X.mix64(empty * X.multiplier(93) + salt[i])))
            owners.append(np.full(len(empty), i))
    if not tiles:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(tiles), np.concatenate(owners)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def document_sets(docs: DataFrame, k: int, bits: bool = False) -> DataFrame:
    """(id, n, s1, s2) of every row of docs (id, text); with `bits`, also the set's bitmap."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id")
            for lo, hi, h, _, first in sets_of(batch.column("text"), k):
                s1, s2 = set_keys(h, first)
                columns = [ids.slice(lo, hi - lo), pa.array(np.diff(first)), _signed(s1), _signed(s2)]
                if bits:
                    columns.append(pa.array([bitmap(h[first[i]: first[i + 1]]) for i in range(hi - lo)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "s1", "s2", "bits"][: len(columns)])

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long" + ", bits binary" * bits)


def document_tiles(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(tile, s1) of every tile that the rows of docs (id, text) enter."""

    def run(batches):
        for batch in batches:
            for _, _, h, rows, first in sets_of(batch.column("text"), k):
                tiles, owners = signatures(h, rows, first, num, den)
                s1, _ = set_keys(h, first)
                yield pa.RecordBatch.from_arrays([_signed(tiles), _signed(s1[owners])], names=["tile", "s1"])

    return docs.mapInArrow(run, "tile long, s1 long")


def reached(n: np.ndarray, bits: list[bytes], num: int, den: int) -> np.ndarray:
    """Group of each set of a tile: sets that the bound lets through, directly or through others."""
    length = min(map(len, bits))
    maps = []
    for x in bits:
        x = np.frombuffer(x, np.uint8)
        while len(x) > length:
            x = x[: len(x) // 2] | x[len(x) // 2:]
        maps.append(x)
    maps = np.stack(maps).view(np.uint64)
    group = np.full(len(n), -1)
    left = np.arange(len(n))
    while len(left):
        group[left[0]] = left[0]
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            xor = np.bitwise_count(maps[left] ^ maps[i]).sum(axis=1, dtype=np.int64)
            most = np.minimum((n[i] + n[left] - xor) // 2, np.minimum(n[i], n[left]))
            near = den * most >= num * (n[i] + n[left] - most)
            if near.any():
                group[left[near]] = group[i]
                queue += left[near].tolist()
                left = left[~near]
    return group


def tile_links(members: DataFrame, bits: DataFrame, num: int, den: int, limit: int = TILE) -> DataFrame:
    """(a, b): links that span the groups of sets in each tile of members (tile, c, n) that the bound lets through."""
    h = F.xxhash64("c")
    same = (members.groupBy("tile").agg(F.count("*").alias("m"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"))
            .groupBy("m", "x", "y").agg(F.min("tile").alias("tile")))
    blocks = F.ceil(F.col("m") / limit).cast("int")
    block = F.pmod(h, F.col("blocks")).cast("int")
    dealt = (members.join(same.select("tile", blocks.alias("blocks")), "tile").withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.xxhash64("tile", F.least("block", "other"), F.greatest("block", "other")).alias("at"), "c", "n"))
    rows = dealt.join(bits, "c").repartition("at").sortWithinPartitions("at", "c")

    def done(table):
        at, c, n = (table.column(x).to_numpy() for x in ("at", "c", "n"))
        bits = table.column("bits").to_pylist()
        cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        low = np.empty(len(c), np.int64)
        for lo, hi in zip(cuts, np.append(cuts[1:], len(c)), strict=True):
            low[lo:hi] = c[lo:hi][reached(n[lo:hi], bits[lo:hi], num, den)]
        pairs = np.unique(np.stack([low, c], 1)[low != c], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])

    return rows.mapInArrow(lambda batches: by_key(batches, "at", done), "a long, b long").distinct()


def by_key(batches, key: str, done):
    """done(table) of runs of rows that hold whole groups of equal, sorted keys."""
    held = None
    for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut:
            yield done(table.slice(0, cut))
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield done(held)


def family_components(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Component number of each of the sets of one family."""
    n = len(sets)
    up = np.arange(n)

    def enough(both, a, b):
        return (den * both >= num * (a + b - both)) & (both > 0)

    if n == 2:
        x, y = sets
        both = len(np.intersect1d(x, y, assume_unique=True))
        return up if not enough(both, len(x), len(y)) else np.zeros(2, int)
    sizes = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sets, sizes = [sets[i] for i in order], sizes[order]
    first = np.concatenate([[0], np.cumsum(sizes)])
    words, at = np.unique(np.concatenate(sets), return_inverse=True)
    m = max(64, min(1 << (2 * int(sizes[-1]) - 1).bit_length(), 1 << ((1 << 29) // n).bit_length() - 1))  # 64 MB at most
    maps = np.zeros((n, m // 64), np.uint64)
    bit = (np.concatenate(sets) & np.uint64(m - 1)).astype(np.int64)
    np.bitwise_or.at(maps, (np.repeat(np.arange(n), sizes), bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    mark = np.zeros(len(words), bool)
    for i in range(n):
        # the larger sets of other components that are not too large
        others = np.arange(i + 1, int(np.searchsorted(sizes, sizes[i] * den // num, side="right")))
        others = others[up[others] != up[i]]
        if not len(others):
            continue
        xor = np.bitwise_count(maps[others] ^ maps[i]).sum(axis=1, dtype=np.int64)
        others = others[enough((sizes[i] + sizes[others] - xor) // 2, sizes[i], sizes[others])]
        if not len(others):
            continue
        mark[at[first[i]: first[i + 1]]] = True
        n_words = sizes[others]
        begin = np.cumsum(n_words) - n_words
        where = np.repeat(first[others] - begin, n_words) + np.arange(n_words.sum())
        both = np.add.reduceat(mark[at[where]], begin, dtype=np.int64)
        mark[at[first[i]: first[i + 1]]] = False
        linked = others[enough(both, sizes[i], sizes[others])]
        if len(linked):
            joined = np.unique(np.append(up[linked], up[i]))
            up[np.isin(up, joined)] = joined[0]
    out = np.empty(n, int)
    out[order] = up
    return out


def gathered_components(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, component) of the sets of rows (family, id, text), which come sorted by family."""

    def done(table):
        family, ids = table.column("family").to_numpy(), table.column("id").to_numpy()
        sets: list[np.ndarray] = []
        for lo, hi, h, _, first in sets_of(table.column("text"), k):
            sets += [h[first[i]: first[i + 1]] for i in range(hi - lo)]
        cuts = np.flatnonzero(np.append(True, family[1:] != family[:-1]))
        low = ids.copy()
        for lo, hi in zip(cuts, np.append(cuts[1:], len(ids)), strict=True):
            own, up = ids[lo:hi], family_components(sets[lo:hi], num, den)
            for c in np.unique(up):
                low[lo:hi][up == c] = own[up == c].min()
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(low)], names=["node", "component"])

    return rows.mapInArrow(lambda batches: by_key(batches, "family", done), "node long, component long")


def apart_components(rows: DataFrame, sized: DataFrame, k: int, num: int, den: int, limit: int) -> DataFrame:
    """(node, component) of the sets of families (family, c, n) that are too large for one place. Sizes are banded so
    that linked sets are in the same or the next band; each band is cut into blocks by hash, and each pair of
    blocks of a band, and of neighbouring bands, is compared in a place of its own for links that span."""
    ratio = float(np.log(den / num * 1.0001)) if num < den else 1.0
    sized = sized.withColumn("band", F.floor(F.log("n") / ratio))
    cut = sized.groupBy("family", "band").agg(F.ceil(F.sum("n") / max(1, limit // 2)).cast("int").alias("blocks"))
    near = [cut.select("family", (F.col("band") + d).alias("band"), F.col("blocks").alias(name)) for d, name in ((0, "own"), (-1, "above"), (1, "below"))]
    dealt = sized.join(near[0], ["family", "band"]).join(near[1], ["family", "band"], "left").join(near[2], ["family", "band"], "left")
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("c"), F.col("own")).cast("int"))

    def with_blocks(count, low, first, second):
        at = F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.xxhash64("family", low, first(j), second(j)))
        return F.when(count.isNull(), F.array().cast("array<bigint>")).otherwise(at)

    i, band = F.col("i"), F.col("band")
    places = F.concat(
        with_blocks(F.col("own"), band, lambda j: F.least(i, j), lambda j: F.greatest(i, j)),
        with_blocks(F.col("above"), band, lambda j: i, lambda j: -1 - j),
        with_blocks(F.col("below"), band - 1, lambda j: j, lambda j: -1 - i))
    at = dealt.select(F.col("c").alias("id"), F.explode(places).alias("family"))
    each = rows.join(at, "id").repartition("family").sortWithinPartitions("family", "id")
    links = gathered_components(each, k, num, den).where("node <> component").distinct()
    return connected(links.toDF("b", "a"))


def near_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                    text_col: str = "text", family: int = FAMILY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs: the size of its n-gram set and the smallest
    id that it reaches over links of Jaccard similarity >= num / den (itself included)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = written(document_sets(rows, k, bits=True), "sets")
    classes = written(sets.where("n > 0 and id is not null").groupBy("n", "s1", "s2")
                      .agg(F.min("id").alias("c"), F.any_value("bits").alias("bits")), "classes")

    tile = Window.partitionBy("tile")
    shared = (document_tiles(rows.where("id is not null"), k, num, den)
              .select("tile", "s1", F.min("s1").over(tile).alias("lo"), F.max("s1").over(tile).alias("hi"))
              .where("lo < hi").select("tile", "s1").distinct())
    members = written(shared.join(classes.select("s1", "c", "n"), "s1").select("tile", "c", "n"), "members")
    families = connected(tile_links(members, classes.select("c", "bits"), num, den)).toDF("c", "family")
    sized = families.join(classes.select("c", "n"), "c")
    loads = written(sized.groupBy("family").agg(F.sum("n").alias("load")).where(F.col("load") > family), "loads")
    gathered = written(families.join(loads, "family", "left_anti"), "families")
    texts = rows.join(gathered.select(F.col("c").alias("id"), "family"), "id")
    each = texts.repartition("family").sortWithinPartitions("family", "id")
    labels = gathered_components(each, k, num, den).distinct()
    if not loads.isEmpty():
        labels = labels.union(apart_components(rows, sized.join(loads, "family", "left_semi"), k, num, den, family))

    found = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").select(
        "n", "s1", "s2", F.coalesce("component", "c").alias("component"))
    return (sets.select("id", "n", "s1", "s2").join(found, ["n", "s1", "s2"], "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")))
