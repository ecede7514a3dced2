"""Neighbour-mean fill through box sums.

For every row whose target value is missing, the analysis averages that
column over all rows of the same category inside an OPEN box of
+-half-width around the row (own row included; its value is missing so it
does not count), before any fill of that column.

Spark plan (no nested loop, no per-row Python):
  1. coordinates = rows aggregated per exact (category, lat, lon): sum and count of each
     target's non-NULL values (copies at one coordinate collapse map-side), written once;
  2. tiles as large as a box: a box meets 4 of them at most. In a tile of LEAF coordinates
     at most, the box's coordinates are found by an equi-join on the tile and the exact
     strict predicate;
  3. in a denser tile nothing is paired. Its coordinates are ranked by latitude and form
     blocks of LEAF, 2 LEAF, 4 LEAF ... ranks, each with running sums by longitude. A
     box is a range of ranks: the blocks of the two ends' binary digits, each read at the
     box's two longitudes, and less than LEAF coordinates at either end that are compared.
     Work for a box grows with the logarithm of the density. Ranks and running sums come
     from a range sort, so a tile that holds a third of all rows is dealt out like others;
  4. left-join the means back on (category, lat, lon) and coalesce.
Each column uses its own unfilled values (one pass serves all targets, no iteration).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomrate import constants as K
from roomrate.session import written

# cells of the pair join: side = half-width / K * (1 + CELL_SLACK); every neighbour lies within K cells of the
# probe's cell on each axis, with slack far above rounding error
CELL_SLACK = 1e-6
CELLS_PER_HALF_WIDTH = 2
LEAF = 64  # coordinates that a box is compared with, in a tile or at either end of its ranks; a power of two


def _offsets(k: int):
    return F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                     for dx in range(-k, k + 1) for dy in range(-k, k + 1)])


def _missing(col: str, zero_is_missing: bool):
    c = F.col(col)
    return (c.isNull() | (c == 0)) if zero_is_missing else c.isNull()


def running_sums(df: DataFrame, group: str, order, values) -> DataFrame:
    """df with each column of `values` replaced by its sum over the earlier rows of the group, in `order`. Rows are
    range-sorted and summed within their partitions; partitions are moved up by the sums before them, so no
    group is one task."""
    rows = written(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                   .withColumn("_place", F.monotonically_increasing_id()), "running-sums")
    rows = rows.withColumn("_part", F.shiftright("_place", 33))
    upto = Window.unboundedPreceding, -1
    parts = rows.groupBy(group, "_part").agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(*upto)  # a row for each partition of the group
    moved = parts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_m_{v}") for v in values])
    within = Window.partitionBy(group, "_part").orderBy("_place").rowsBetween(*upto)
    rest = [c for c in df.columns if c not in values]
    summed = rows.select(*rest, "_part", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(v) for v in values])
    return (summed.join(moved, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
            .select(*rest, *[(F.col(v) + F.col(f"_m_{v}")).alias(v) for v in values]))


def _tiled(coords: DataFrame, category: str, lat: str, lon: str, half_lat: float, half_lon: float):
    """(points (tile, x, y, sums...), boxes (box, tile, x0, x1, y0, y1)): coordinates by tile, and the probes' open boxes
    in each tile that they meet. A box is known by the struct of its category and coordinate."""
    side_x, side_y = 2 * half_lat * (1 + CELL_SLACK), 2 * half_lon * (1 + CELL_SLACK)
    x, y = F.col(lat), F.col(lon)

    def tile(tx, ty):
        return F.struct(F.col(category).alias("c"), tx.alias("x"), ty.alias("y"))

    points = coords.select(tile(F.floor(x / side_x), F.floor(y / side_y)).alias("tile"), x.alias("x"), y.alias("y"),
                           *[c for c in coords.columns if c[:3] in ("_s_", "_n_")])
    ends = {"x0": x - F.lit(half_lat), "x1": x + F.lit(half_lat), "y0": y - F.lit(half_lon), "y1": y + F.lit(half_lon)}
    meets = [F.array_distinct(F.array(F.floor(ends[a] / side), F.floor(ends[b] / side)))
             for a, b, side in (("x0", "x1", side_x), ("y0", "y1", side_y))]
    boxes = (coords.where("_probe").select(F.struct(F.col(category).alias("c"), x.alias("x"), y.alias("y")).alias("box"),
                                           *[e.alias(n) for n, e in ends.items()], meets[1].alias("_ty"), F.explode(meets[0]).alias("_tx"))
             .select("*", F.explode("_ty").alias("_t"))
             .select("box", F.struct(F.col("box.c").alias("c"), F.col("_tx").alias("x"), F.col("_t").alias("y")).alias("tile"), *ends))
    return points, boxes


def _compared(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """(box, tile, ends..., point columns): every box with every coordinate of its tiles, for tiles of few coordinates."""
    return boxes.join(points, "tile")


def _dense_lookups(points: DataFrame, boxes: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Of dense tiles: (ranked points (tile, x, y, rank, sums...); lookups (box, tile, to, sign, y0, y1): the box's sums are those
    of the ranks below `to`, times the sign, between y0 and y1)."""
    bounds = boxes.select("tile", "box", "y0", "y1", F.explode(F.array(
        F.struct(F.lit(1).alias("sign"), F.col("x1").alias("x"), F.lit(0).alias("kind")),  # below x1: before points at x1
        F.struct(F.lit(-1).alias("sign"), F.col("x0").alias("x"), F.lit(2).alias("kind")))).alias("b"))  # up to x0: after points at x0
    own = points.select("tile", "x", F.lit(1).alias("kind"), F.lit(1).cast("bigint").alias("rank"), F.struct(*points.columns[1:]).alias("point"),
                        F.lit(None).cast(bounds.select(F.struct("box", "b.sign", "y0", "y1").alias("q")).schema["q"].dataType).alias("q"))
    asked = bounds.select("tile", "b.x", "b.kind", F.lit(0).cast("bigint").alias("rank"), F.lit(None).cast(own.schema["point"].dataType).alias("point"),
                          F.struct("box", "b.sign", "y0", "y1").alias("q"))
    ranked = written(running_sums(own.unionByName(asked), "tile", ["x", "kind"], ["rank"]), "ranked-by-latitude")
    return (ranked.where("kind = 1").select("tile", "point.*", "rank"),
            ranked.where("kind <> 1 and rank > 0").select("tile", "q.*", F.col("rank").alias("to")))


def _dense_sums(ranked: DataFrame, lookups: DataFrame, sums: list[str], leaf: int) -> tuple[DataFrame, DataFrame]:
    """(rows (box, sums...) that add up to the boxes' sums from the ends' blocks; compared ends (box, sign, point columns))."""
    low = leaf.bit_length() - 1
    last = F.col("to") - F.pmod(F.col("to"), F.lit(leaf))
    ends = (lookups.join(ranked.withColumn("_slab", F.floor(F.col("rank") / leaf)), (lookups["tile"] == ranked["tile"]) & (F.floor(lookups["to"] / leaf) == F.col("_slab")))
            .where((F.col("rank") >= last) & (F.col("rank") < F.col("to")))
            .select("box", "sign", "y0", "y1", "y", *sums))
    # blocks of 2^level ranks: of a point, one on each level up to the tile's largest; of `to`, one for each digit
    most = ranked.groupBy("tile").agg(F.max("rank").alias("_most"))
    levels = F.sequence(F.lit(low), F.greatest(F.lit(low), F.floor(F.log2(F.col("_most") + 1)).cast("int")))

    points = (ranked.join(most, "tile").select("*", F.explode(levels).alias("_l")).withColumn("block", F.expr("struct(tile as t, _l as l, shiftright(rank, _l) as b)"))
              .select("block", "y", F.lit(1).alias("kind"), F.lit(None).cast(lookups.schema["box"].dataType).alias("box"), F.lit(0).alias("sign"), *sums))
    digits = (lookups.select("*", F.explode(F.expr(f"filter(sequence({low}, 62), l -> shiftright(to, l) % 2 = 1)")).alias("_l"))
              .withColumn("block", F.expr("struct(tile as t, _l as l, shiftright(to, _l) - 1 as b)")))
    read = digits.select("block", "box", F.explode(F.array(
        F.struct(F.col("y1").alias("y"), F.lit(0).alias("kind"), F.col("sign").alias("sign")),
        F.struct(F.col("y0").alias("y"), F.lit(2).alias("kind"), (-F.col("sign")).alias("sign")))).alias("r"))
    read = read.select("block", "r.y", "r.kind", "box", "r.sign", *[F.lit(0).cast(points.schema[c].dataType).alias(c) for c in sums])
    run = running_sums(points.unionByName(read), "block", ["y", "kind"], sums)
    return run.where("kind <> 1").select("box", *[(F.col("sign") * F.col(c)).alias(c) for c in sums]), ends


def neighbour_sums(df: DataFrame, targets, probe, category: str = "room_type", lat: str = "latitude",
                   lon: str = "longitude", half_lat: float = K.NEIGHBOUR_LAT_HALF_WIDTH,
                   half_lon: float = K.NEIGHBOUR_LON_HALF_WIDTH, leaf: int = LEAF) -> DataFrame:
    """(category, lat, lon, _s_<t>, _n_<t>, ...): sum and count of each target over the open box around every
    coordinate at which `probe` holds for some row. (J5 without the pairs)"""
    targets = list(targets)
    sums = [f"_s_{t}" for t in targets] + [f"_n_{t}" for t in targets]
    coords = written(df.where(F.col(category).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull())
                     .groupBy(category, lat, lon)
                     .agg(*[F.coalesce(F.sum(F.col(t).cast("double")), F.lit(0.0)).alias(f"_s_{t}") for t in targets],
                          *[F.count(F.col(t)).alias(f"_n_{t}") for t in targets],
                          F.max(probe).alias("_probe")), "coordinates")
    points, boxes = _tiled(coords, category, lat, lon, half_lat, half_lon)
    dense = written(points.groupBy("tile").agg(F.count("*").alias("n")).where(F.col("n") > leaf).select("tile"), "dense-tiles")
    inside = ((F.col("x") > F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") > F.col("y0")) & (F.col("y") < F.col("y1")))
    if dense.isEmpty():
        found = _compared(points, boxes).where(inside).select("box", *sums)
    else:
        sparse = [d.join(dense, "tile", "left_anti") for d in (points, boxes)]
        found = _compared(*sparse).where(inside).select("box", *sums)
        ranked, lookups = _dense_lookups(*[d.join(dense, "tile", "left_semi") for d in (points, boxes)], leaf)
        blocks, ends = _dense_sums(ranked, lookups, sums, leaf)
        between = (F.col("y") > F.col("y0")) & (F.col("y") < F.col("y1"))
        found = (found.union(blocks).union(ends.where(between).select("box", *[(F.col("sign") * F.col(c)).alias(c) for c in sums])))
    return (found.groupBy("box").agg(*[F.sum(c).alias(c) for c in sums])
            .select(F.col("box.c").alias(category), F.col("box.x").alias(lat), F.col("box.y").alias(lon), *sums))


def neighbour_means(df: DataFrame, targets, category: str = "room_type", lat: str = "latitude",
                    lon: str = "longitude", half_lat: float = K.NEIGHBOUR_LAT_HALF_WIDTH,
                    half_lon: float = K.NEIGHBOUR_LON_HALF_WIDTH, zero_is_missing: bool = False,
                    leaf: int = LEAF) -> DataFrame:
    """(category, lat, lon, <t>_nbr_mean...) for every coordinate with a row that misses any target."""
    targets = list(targets)
    any_missing = reduce(lambda a, b: a | b, [_missing(t, zero_is_missing) for t in targets])
    sums = neighbour_sums(df, targets, any_missing, category, lat, lon, half_lat, half_lon, leaf)
    return sums.select(category, lat, lon, *[F.try_divide(f"_s_{t}", f"_n_{t}").alias(f"{t}_nbr_mean") for t in targets])


def neighbour_fill(df: DataFrame, targets, round_result: bool, category: str = "room_type",
                   lat: str = "latitude", lon: str = "longitude", half_lat: float = K.NEIGHBOUR_LAT_HALF_WIDTH,
                   half_lon: float = K.NEIGHBOUR_LON_HALF_WIDTH, zero_is_missing: bool = False) -> DataFrame:
    """Fill each target where missing with the neighbour mean (half-even rounded if asked).
    Present values are never changed; a probe with no neighbour value stays NULL. (E8, E9)"""
    targets = list(targets)
    means = neighbour_means(df, targets, category, lat, lon, half_lat, half_lon, zero_is_missing)
    joined = df.join(means, on=[category, lat, lon], how="left")
    out = []
    for c in df.columns:
        if c in targets:
            m = F.col(f"{c}_nbr_mean")
            if round_result:
                m = F.bround(m, 0)
            out.append(F.when(_missing(c, zero_is_missing), m).otherwise(F.col(c).cast("double")).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def band_pairs(left: DataFrame, right: DataFrame, category: str, lat: str, lon: str,
               half_lat: float, half_lon: float) -> DataFrame:
    """General 2-D band join: every (left, right) pair of the same category whose
    coordinates differ by less than the half-widths (strict). Right columns get
    the prefix 'r_'. Both sides are shuffled: packed files look small enough to broadcast long after their
    rows have outgrown the driver. (J5)"""
    k = CELLS_PER_HALF_WIDTH
    cell_lat, cell_lon = half_lat / k * (1 + CELL_SLACK), half_lon / k * (1 + CELL_SLACK)
    offsets = _offsets(k)
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    r = (r.withColumn("_cx", F.floor(F.col(f"r_{lat}") / cell_lat))
         .withColumn("_cy", F.floor(F.col(f"r_{lon}") / cell_lon)))
    l = (left.withColumn("_o", F.explode(offsets))
         .withColumn("_cx", F.floor(F.col(lat) / cell_lat) + F.col("_o.dx"))
         .withColumn("_cy", F.floor(F.col(lon) / cell_lon) + F.col("_o.dy")).drop("_o"))
    cond = [l[category] == r[f"r_{category}"], l["_cx"] == r["_cx"], l["_cy"] == r["_cy"],
            r[f"r_{lat}"] > l[lat] - F.lit(half_lat), r[f"r_{lat}"] < l[lat] + F.lit(half_lat),
            r[f"r_{lon}"] > l[lon] - F.lit(half_lon), r[f"r_{lon}"] < l[lon] + F.lit(half_lon)]
    return l.join(r.hint("merge"), on=reduce(lambda a, b: a & b, cond), how="inner").drop("_cx", "_cy")
