"""Approximate nearest neighbours: one navigable small-world graph per shard.

Equal vectors are one index entry that carries the smallest ids behind it, so copies neither
clog a graph nor meet in one task. Entries are dealt by hash into shards of about
``shard_size``; each shard becomes a hierarchical navigable small-world graph, stored as one
row of flat arrays (vectors, and per layer a node list and a fixed-width neighbour table).
Queries are searched in blocks in every shard, all queries of a block in step, and the
shards' results are merged.

Defined cases: vectors that are null, all zero, or hold null or non-finite components take
no part, nor do rows without an id; vectors of different lengths are never compared;
repeated rows count once; with fewer candidates than ``k`` all are returned; distances tie to
the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

M = 16
EF_BUILD = 64
EF_SEARCH = 128
SHARD_SIZE = 4096
QUERY_BLOCK = 2048


def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    d = (rows * rows).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2.0 * rows @ points.T
    return np.maximum(d, 0, out=d)


def _spread(points: np.ndarray, centre: np.ndarray, cand: np.ndarray, dist: np.ndarray, keep: int) -> np.ndarray:
    """Neighbour selection: a candidate stays if it is nearer to its centre than to all kept before.

    ``cand`` [b, c] holds candidates by ascending ``dist`` (-1 at inf); gives [b, keep] with -1.
    """
    b, c = cand.shape
    vectors = points[np.maximum(cand, 0)]
    norms = (vectors * vectors).sum(2)
    between = norms[:, :, None] + norms[:, None, :] - 2.0 * np.einsum("bid,bjd->bij", vectors, vectors, optimize=True)
    kept = np.zeros((b, c), bool)
    for j in range(c):
        near = (kept & (between[:, j, :] < dist[:, j, None])).any(1)
        kept[:, j] = np.isfinite(dist[:, j]) & ~near & (kept.sum(1) < keep)
    # Free places go to the nearest of the rest, so that dense regions stay linked.
    order = np.argsort(np.where(kept, 0, np.where(np.isfinite(dist), 1, 2)), axis=1, kind="stable")[:, :keep]
    chosen = np.take_along_axis(cand, order, 1)
    return np.where(np.isfinite(np.take_along_axis(dist, order, 1)), chosen, -1)


def _layer(points: np.ndarray, nodes: np.ndarray, width: int) -> np.ndarray:
    """Neighbour table [len(nodes), width] of one layer; nodes are linked in insertion order."""
    n = len(nodes)
    table = np.full((n, width), -1, np.int32)
    if n < 2:
        return table
    x = points[nodes]
    half, forward = max(1, width // 2), []
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        d = _distances(x[lo:hi], x[:hi])
        d[np.arange(hi)[None, :] >= np.arange(lo, hi)[:, None]] = np.inf  # only earlier nodes
        c = min(EF_BUILD, hi)
        cand = np.argpartition(d, c - 1, axis=1)[:, :c]
        dist = np.take_along_axis(d, cand, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        forward.append(_spread(x, x[lo:hi], np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1), half))
    width_f = max(f.shape[1] for f in forward)
    ahead = np.concatenate([np.pad(f, ((0, 0), (0, width_f - f.shape[1])), constant_values=-1) for f in forward])
    src, col = np.nonzero(ahead >= 0)
    dst = ahead[src, col]
    # Links run both ways; a node with too many keeps a spread selection.
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    d = ((x[a] - x[b]) ** 2).sum(1)
    order = np.lexsort((d, a))
    a, b, d = a[order], b[order], d[order]
    begin = np.searchsorted(a, np.arange(n + 1))
    rank = np.arange(len(a)) - begin[a]
    count = np.diff(begin)
    few = count[a] <= width
    table[a[few], rank[few]] = b[few]
    many = np.nonzero(count > width)[0]
    for lo in range(0, len(many), 256):
        part = many[lo : lo + 256]
        c = int(min(count[part].max(), 3 * width))
        at = begin[part][:, None] + np.arange(c)[None, :]
        ok = np.arange(c)[None, :] < count[part][:, None]
        at = np.minimum(at, len(a) - 1)
        table[part] = _spread(x, x[part], np.where(ok, b[at], -1), np.where(ok, d[at], np.inf), width)
    return table


def build_graph(points: np.ndarray, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Layers, the lowest first: node numbers, and flat neighbour tables of positions in them."""
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(1.0 - rng.random(len(points))) / math.log(M)).astype(int)
    nodes, tables = [], []
    for at in range(int(level.max()) + 1 if len(level) else 0):
        here = np.nonzero(level >= at)[0].astype(np.int32)
        nodes.append(here)
        tables.append(_layer(points, here, 2 * M if at == 0 else M))
    return nodes, tables


def _beam(points: np.ndarray, table: np.ndarray, queries: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for all queries in step: positions and distances, ascending."""
    q = len(queries)
    ids = np.full((q, ef), -1, np.int32)
    dist = np.full((q, ef), np.inf, np.float32)
    ids[:, 0] = start
    dist[:, 0] = ((points[start] - queries) ** 2).sum(1)
    closed = np.ones((q, ef), bool)
    closed[:, 0] = False
    seen = np.zeros((q, len(points)), bool)
    seen[np.arange(q), start] = True
    live = np.arange(q)
    while len(live):
        open_d = np.where(closed[live], np.inf, dist[live])
        pick = open_d.argmin(1)
        more = np.isfinite(open_d[np.arange(len(live)), pick])
        live, pick = live[more], pick[more]
        if not len(live):
            break
        closed[live, pick] = True
        near = table[ids[live, pick]]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        rows, cols = np.nonzero(fresh)
        hit = near[rows, cols]
        seen[live[rows], hit] = True
        new_d = np.full(near.shape, np.inf, np.float32)
        new_d[rows, cols] = ((points[hit] - queries[live[rows]]) ** 2).sum(1)
        all_d = np.concatenate([dist[live], new_d], 1)
        all_i = np.concatenate([ids[live], near], 1)
        all_c = np.concatenate([closed[live], ~np.isfinite(new_d)], 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
        dist[live] = np.take_along_axis(all_d, order, 1)
        ids[live] = np.take_along_axis(all_i, order, 1)
        closed[live] = np.take_along_axis(all_c, order, 1)
    return ids, dist


def search_graph(points: np.ndarray, nodes: list[np.ndarray], tables: list[np.ndarray], queries: np.ndarray, k: int, ef: int) -> np.ndarray:
    """[queries, k] point numbers, -1 where there are fewer."""
    found = []
    for lo in range(0, len(queries), 512):
        block = queries[lo : lo + 512]
        at = np.full(len(block), nodes[-1][0], np.int32)
        for layer in range(len(nodes) - 1, 0, -1):
            here = points[nodes[layer]]
            ids, _ = _beam(here, tables[layer], block, np.searchsorted(nodes[layer], at).astype(np.int32), 1)
            at = nodes[layer][ids[:, 0]]
        ids, dist = _beam(points, tables[0], block, at, min(max(ef, k), len(points)))
        found.append(np.pad(np.where(np.isfinite(dist), ids, -1)[:, :k], ((0, 0), (0, max(0, k - ids.shape[1]))), constant_values=-1))
    return np.concatenate(found)


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(vector, bad), F.lit(True)) & F.exists(vector, lambda x: x != 0)


def build_index(vectors: DataFrame, id_col: str, vector_col: str, k: int, shard_size: int = SHARD_SIZE) -> tuple[DataFrame, DataFrame, int]:
    """(entries, graphs, shards): distinct vectors with their smallest k + 1 ids, one graph row per shard, their number."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"))).distinct()
    # The limit on the rank is applied before the shuffle too, so copies don't travel.
    first = rows.withColumn("rn", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("rn") <= k + 1)
    entries = written(first.groupBy("v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    n_shards = max(1, math.ceil(entries.count() / shard_size))
    dealt = entries.select("rep", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("rep"), F.lit(n_shards)).alias("shard"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        rng = np.random.default_rng(int(pdf["shard"].iloc[0]))
        pdf = pdf.iloc[rng.permutation(len(pdf))]  # insertion in random order
        exact = np.stack(pdf["v"].to_numpy())
        nodes, tables = build_graph(exact.astype(np.float32), int(pdf["shard"].iloc[0]))
        return pd.DataFrame(
            {
                "dim": [int(pdf["dim"].iloc[0])],
                "shard": [int(pdf["shard"].iloc[0])],
                "reps": [pdf["rep"].to_numpy("<i8").tobytes()],
                "points": [exact.astype("<f8").tobytes()],
                "nodes": [[x.astype("<i4").tobytes() for x in nodes]],
                "neighbours": [[x.astype("<i4").tobytes() for x in tables]],
            }
        )

    graphs = dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard long, reps binary, points binary, nodes array<binary>, neighbours array<binary>")
    return entries, written(graphs, "graphs"), n_shards


def nearest(vectors: DataFrame, query_ids: Column, k: int = 10, ef: int = EF_SEARCH, shard_size: int = SHARD_SIZE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest other rows by Euclidean distance.

    ``query_ids``: a condition on ``vectors`` that tells the queries.
    """
    entries, graphs, n_shards = build_index(vectors, id_col, vector_col, k, shard_size)
    queries = vectors.where(query_ids).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("query_id").isNotNull() & usable(F.col("v"))).distinct()
    # Equal queries are searched once, under the name of their index entry.
    asked = written(queries.join(entries.select("v", "rep"), "v").select("query_id", "rep"), "asked")
    once = written(asked.select("rep").distinct().join(entries.select("rep", "v"), "rep"), "once")
    n_blocks = max(1, math.ceil(once.count() / QUERY_BLOCK))
    blocks = once.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "rep"), F.lit(n_blocks))).withColumn("dim", F.size("v"))
    # The stated queries against all rows, block by block: each block meets each shard once.
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = graphs.withColumn("block", up_to(n_blocks))
    right = blocks.withColumn("shard", up_to(n_shards))
    top = k + 1

    def search(graph: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = {"rep": [], "cand": [], "dist": []}
        if len(graph) and len(block):
            g = graph.iloc[0]
            exact = np.frombuffer(g["points"], "<f8").reshape(-1, int(g["dim"]))
            reps = np.frombuffer(g["reps"], "<i8")
            nodes = [np.frombuffer(x, "<i4") for x in g["nodes"]]
            tables = [np.frombuffer(x, "<i4").reshape(len(n), -1) for x, n in zip(g["neighbours"], nodes, strict=True)]
            asked_v = np.stack(block["v"].to_numpy())
            found = search_graph(exact.astype(np.float32), nodes, tables, asked_v.astype(np.float32), top, ef)
            rows, cols = np.nonzero(found >= 0)
            hit = found[rows, cols]
            out = {"rep": block["rep"].to_numpy()[rows], "cand": reps[hit], "dist": np.sqrt(((asked_v[rows] - exact[hit]) ** 2).sum(1))}
        return pd.DataFrame(out).astype({"rep": "int64", "cand": "int64", "dist": "float64"})

    key = ["dim", "shard", "block"]
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "rep long, cand long, dist double")
    best = hits.withColumn("rn", F.row_number().over(W.partitionBy("rep").orderBy("dist", "cand"))).where(F.col("rn") <= top)
    # From entries back to rows: at most (k + 1)^2 per distinct query, cut to k + 1 again.
    members = best.join(entries.select(F.col("rep").alias("cand"), "ids"), "cand").select("rep", F.explode(F.transform("ids", lambda x: F.struct(F.col("dist").alias("score"), x.alias("vec_id")))).alias("hit"))
    lists = written(members.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list("hit")), 1, top).alias("hits")), "lists")
    own = asked.join(lists, "rep").select("query_id", F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k).alias("hits"))
    ranked = own.select("query_id", F.posexplode("hits").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
