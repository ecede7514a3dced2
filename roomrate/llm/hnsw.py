"""Approximate nearest neighbours (9): a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of about SHARD_ROWS by a hash of their id, so shards grow in number and not in
size. The graph of a shard is stored as flat neighbour arrays, one row of a written table. Equal vectors are
one node with all their ids. Levels are drawn geometrically from a hash of the node. Nodes are inserted from the
highest level down, so the nodes of a level are the first ones of a shard. An insertion searches the graph of the
nodes before it, greedily with a beam from level to level, and links the node at each of its levels to nodes
found there, chosen by the diversity rule (a candidate nearer to a chosen neighbour than to the node is passed
over; free places are filled with the nearest ones passed over). The nodes chosen link back; where their places
are used up, the same rule chooses anew among all of theirs. Nodes are inserted BATCH at a time, and
as many as the graph holds at most; those of a batch do not find each other in the graph and are compared directly.

A search starts at the top level and goes down, with a beam of nodes at each level; a block of queries moves
in step, so that numpy works on all of them at once. The inner product is searched by the known reduction:
nodes get one more component that makes all norms equal, queries get 0 there. Scores are inner products of
the original vectors in double precision. The shards' results of each query are merged by a window over at
most shards x k rows.

Vectors null, zero, empty or holding null or non-finite components take no part; nor do vectors of another
length than the most frequent one. A null id takes no part. A repeated id is a candidate as often as its
vectors differ. Ties go to the smaller id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomrate.llm.storage import written

SHARD_ROWS = 8192
QUERY_ROWS = 1024
LINKS = 24
CANDIDATES = 64
#: nodes inserted at once, and nodes of the same batch that are candidates
BATCH = 256
MATES = 16
BEAM = 96
UPPER_BEAM = 32

INDEX = "shard int, ids binary, first binary, vectors binary, dim int, levels array<binary>"


def diverse(x: np.ndarray, c: np.ndarray, v: np.ndarray, limit: int, fill: bool) -> np.ndarray:
    """Up to `limit` candidates for each row of c (nodes of x, nearest first, -1 for none; v their inner products with the
    row's node) by the diversity rule, -1 for none; `fill` uses free places for the nearest ones passed over."""
    out = np.full((len(c), limit), -1, np.int32)
    width = c.shape[1]
    for lo in range(0, len(c), BATCH):
        some, s = c[lo: lo + BATCH], v[lo: lo + BATCH]
        y = x[some]
        among = y @ y.transpose(0, 2, 1)
        chosen = np.zeros(some.shape, bool)
        for j in range(width):
            closer = (among[:, j, :] > s[:, j: j + 1]) & chosen
            chosen[:, j] = (some[:, j] >= 0) & ~closer.any(axis=1) & (chosen.sum(axis=1) < limit)
        rank = np.where(chosen, 0, np.where(some >= 0, 1, 2)) * width + np.arange(width)
        order = np.argsort(rank, axis=1)[:, :limit]
        best = np.take_along_axis(some, order, 1)
        out[lo: lo + BATCH, : order.shape[1]] = best if fill else np.where(np.take_along_axis(chosen, order, 1), best, -1)
    return out


def ranked(c: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n best candidates of each row with their values, best first."""
    order = np.argsort(-v, axis=1, kind="stable")[:, :n]
    return np.take_along_axis(c, order, 1), np.take_along_axis(v, order, 1)


def link_back(x: np.ndarray, links: np.ndarray, origin: np.ndarray, target: np.ndarray) -> None:
    """Adds the links target -> origin to the neighbour array; where places are used up, diverse() chooses anew."""
    fresh = ~(links[target] == origin[:, None]).any(axis=1)
    origin, target = origin[fresh], target[fresh]
    order = np.lexsort((-np.einsum("ad,ad->a", x[origin], x[target]), target))
    origin, target = origin[order], target[order]
    node, first, n = np.unique(target, return_index=True, return_counts=True)
    at = np.arange(len(target)) - np.repeat(first, n)
    used = (links[node] >= 0).sum(axis=1)
    fits = used + n <= links.shape[1]
    row = np.repeat(np.arange(len(node)), n)
    easy = fits[row]
    links[target[easy], (used[row] + at)[easy]] = origin[easy]
    full = np.flatnonzero(~fits)
    if len(full):
        wide = np.full((len(full), links.shape[1] + n[full].max()), -1, np.int32)
        wide[:, : links.shape[1]] = links[node[full]]
        place = np.full(len(node), -1)
        place[full] = np.arange(len(full))
        wide[place[row[~easy]], links.shape[1] + at[~easy]] = origin[~easy]
        v = np.empty(wide.shape, x.dtype)
        for lo in range(0, len(full), BATCH):
            v[lo: lo + BATCH] = np.einsum("ad,awd->aw", x[node[full[lo: lo + BATCH]]], x[wide[lo: lo + BATCH]], optimize=True)
        v[wide < 0] = -np.inf
        links[node[full]] = diverse(x, *ranked(wide, v, links.shape[1] + MATES), links.shape[1], fill=False)


def graph(x: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Neighbour array (nodes x 2 LINKS, -1 for none) of each level from 0 over the first sizes[level] rows of x,
    built by inserting one batch of nodes after the other."""
    levels = [np.full((n, 2 * LINKS), -1, np.int32) for n in sizes]
    lo = 0
    while lo < len(x):
        hi = min(len(x), lo + min(BATCH, max(lo, LINKS)))
        q = x[lo:hi]
        mates = q @ q.T
        np.fill_diagonal(mates, -np.inf)
        entry = np.tile(np.arange(min(lo, sizes[-1], UPPER_BEAM), dtype=np.int32), (len(q), 1))
        for at in range(len(levels) - 1, -1, -1):
            new = min(hi, sizes[at]) - lo  # nodes of the batch that have this level
            before = min(lo, sizes[at])
            if before:
                found, v = beam_search(x[:before], levels[at], q, entry, CANDIDATES if new > 0 else UPPER_BEAM)
                entry = found
            if new <= 0:
                continue
            mate, score = ranked(np.tile(np.arange(lo, lo + new, dtype=np.int32), (new, 1)), mates[:new, :new], MATES)
            mate = np.where(score > -np.inf, mate, -1)
            if before:
                mate, score = ranked(np.hstack([found[:new], mate]), np.hstack([v[:new], score]), CANDIDATES + MATES)
            own = diverse(x, mate, score, LINKS, fill=True)
            levels[at][lo: lo + new, :LINKS] = own
            row, col = np.nonzero(own >= 0)
            link_back(x, levels[at], (lo + row).astype(np.int32), own[row, col])
        lo = hi
    return levels


def equalised(vectors: np.ndarray) -> np.ndarray:
    """The vectors with one more component that makes all norms 1 at the longest vector's scale."""
    norms = np.sqrt((vectors ** 2).sum(axis=1))
    top = norms.max()
    return (np.hstack([vectors, np.sqrt(np.maximum(top ** 2 - norms ** 2, 0))[:, None]]) / top).astype(np.float32)


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, scores) of the best `beam` nodes found for each query from the entry nodes (-1: none)."""
    n_q = len(q)
    rows = np.arange(n_q)
    seen = np.zeros((n_q, len(x) + 1), bool)
    seen[:, -1] = True

    def scores(nodes):
        s = np.einsum("qd,qnd->qn", q, x[nodes], optimize=True)
        s[nodes < 0] = -np.inf
        return s

    nodes = np.full((n_q, max(beam, entry.shape[1])), -1, np.int32)
    nodes[:, : entry.shape[1]] = entry
    value = scores(nodes)
    seen[np.repeat(rows, entry.shape[1]), entry.ravel()] = True
    todo = nodes >= 0
    live = rows
    while len(live):
        v = np.where(todo[live], value[live], -np.inf)
        best = v.argmax(axis=1)
        more = v[np.arange(len(live)), best] > -np.inf
        live, best = live[more], best[more]
        if not len(live):
            break
        todo[live, best] = False
        fresh = links[nodes[live, best]]
        fresh = np.where(seen[live[:, None], fresh], -1, fresh)
        seen[live[:, None], fresh] = True
        s = np.einsum("qd,qnd->qn", q[live], x[fresh], optimize=True)
        s[fresh < 0] = -np.inf
        all_nodes, all_value = np.hstack([nodes[live], fresh]), np.hstack([value[live], s])
        all_todo = np.hstack([todo[live], fresh >= 0])
        keep = np.argpartition(-all_value, nodes.shape[1] - 1, axis=1)[:, : nodes.shape[1]]
        nodes[live] = np.take_along_axis(all_nodes, keep, 1)
        value[live] = np.take_along_axis(all_value, keep, 1)
        todo[live] = np.take_along_axis(all_todo, keep, 1)
    order = np.argsort(-value, axis=1, kind="stable")[:, :beam]
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(value, order, 1)


def built(shard: int, ids: np.ndarray, vectors: np.ndarray) -> dict:
    """Index row of one shard."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
    _, at, node = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(),
                            return_index=True, return_inverse=True)
    # nodes are renumbered by falling level, as they are inserted
    seed = (((ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    order = np.argsort(seed, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    at, node, level = at[order], number[node], np.floor(-np.log(seed[order]) / np.log(LINKS))
    by_node = np.argsort(node, kind="stable")
    first = np.searchsorted(node[by_node], np.arange(len(at) + 1))
    nodes = vectors[at]
    sizes = [len(nodes)]
    while sizes[-1] > LINKS and (level >= len(sizes)).any():
        sizes.append(int((level >= len(sizes)).sum()))
    return {"shard": shard, "ids": ids[by_node].astype(np.int64).tobytes(), "first": first.astype(np.int64).tobytes(),
            "vectors": nodes.tobytes(), "dim": nodes.shape[1], "levels": [x.tobytes() for x in graph(equalised(nodes), sizes)]}


def searched(index, query_ids: np.ndarray, q: np.ndarray, k: int, beam: int = BEAM) -> pd.DataFrame:
    """(query_id, vec_id, score) of the k nearest found in one shard for each query."""
    ids, first = np.frombuffer(index["ids"], np.int64), np.frombuffer(index["first"], np.int64)
    vectors = np.frombuffer(index["vectors"], np.float64).reshape(-1, index["dim"])
    levels = [np.frombuffer(x, np.int32).reshape(-1, 2 * LINKS) for x in index["levels"]]
    x = (vectors / np.sqrt((vectors ** 2).sum(axis=1)).max()).astype(np.float32)
    query = (q / np.sqrt((q ** 2).sum(axis=1, keepdims=True))).astype(np.float32)
    entry = np.tile(np.arange(min(len(levels[-1]), UPPER_BEAM), dtype=np.int32), (len(q), 1))
    for at in range(len(levels) - 1, -1, -1):
        entry, _ = beam_search(x[: len(levels[at])], levels[at], query, entry, max(beam, k + 1) if at == 0 else UPPER_BEAM)
    row, col = np.nonzero(entry >= 0)
    node = entry[row, col]
    n = np.minimum(first[node + 1] - first[node], k + 1)
    pick = np.repeat(np.arange(len(node)), n)
    vec = ids[first[node][pick] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    row, score = row[pick], np.einsum("ad,ad->a", q[row], vectors[node])[pick]
    other = vec != query_ids[row]
    row, vec, score = row[other], vec[other], score[other]
    order = np.lexsort((vec, -score, row))
    row, vec, score = row[order], vec[order], score[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pd.DataFrame({"query_id": query_ids[row[best]], "vec_id": vec[best], "score": score[best]})


def _valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def neighbours(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
               shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row for which is_query holds."""
    vectors = (table.withColumn("__query", is_query)
               .select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col("__query").alias("query"))
               .where("id is not null"))
    vectors = vectors.where(F.coalesce(_valid(F.col("v")), F.lit(False))).withColumn("dim", F.size("v"))
    sizes = vectors.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("query").alias("q")).orderBy(F.desc("n"), F.desc("dim")).first()
    result = "query_id long, vec_id long, score double"
    if sizes is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = vectors.where(F.col("dim") == sizes["dim"])
    shards, blocks = -(-sizes["n"] // shard_rows), max(1, -(-sizes["q"] // query_rows))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([built(int(rows["shard"].iloc[0]), rows["id"].to_numpy(), np.stack(rows["v"].to_list()))])

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).select("shard", "id", "v")
    index = written(dealt.repartition(2 * shards, "shard").groupBy("shard").applyInPandas(build, INDEX), "hnsw")

    asked = (vectors.where("query").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)))
             .groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("queries")))
    pairs = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(2 * shards, "shard")

    def search(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                index = {c: batch.column(c)[row].as_py() for c in ("ids", "first", "vectors", "dim", "levels")}
                queries = batch.column("queries")[row].values
                ids = queries.field("id").to_numpy()
                q = queries.field("v").flatten().to_numpy().reshape(len(ids), -1)
                yield pa.RecordBatch.from_pandas(searched(index, ids, q, k, beam), preserve_index=False)

    found = pairs.join(index, "shard").select("queries", "ids", "first", "vectors", "dim", "levels").mapInArrow(search, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
