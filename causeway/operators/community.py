"""Communities: seeded Louvain runs, co-association, average linkage, Girvan-Newman."""

from __future__ import annotations

import zlib
from collections import _count_elements, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from causeway.functions.java import register
from causeway.functions.tables import SMALL_ROWS, small, written


def goi_frequency(parts: DataFrame, gene) -> DataFrame:
    """(gene, frequency): share of runs (run, gene, community) in the community of ``gene``.

    One row of the co-association matrix, in work proportional to runs times genes.
    """
    runs = parts.agg(F.countDistinct("run").alias("runs"))
    home = parts.where(F.col("gene") == gene).select("run", "community")
    hits = parts.join(home, ["run", "community"]).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    every = parts.select("gene").distinct().join(hits, "gene", "left").join(F.broadcast(runs))
    return every.select("gene", (F.coalesce("n", F.lit(0)) / F.col("runs")).alias("frequency"))


@dataclass(frozen=True)
class Together:
    """Runs in which genes share a community, by classes of genes that are in the same communities in every run.

    ``members`` (gene, cls): each gene's class, named by its smallest gene. ``pairs`` (a, b, n),
    a <= b: the runs of two classes, a class with itself included; so all cells of the matrix of
    genes are there, in as many rows as there are pairs of classes.
    """

    members: DataFrame
    pairs: DataFrame


def _classes(parts: DataFrame, only_runs: int | None = None) -> DataFrame:
    """(gene, cls) of rows (run, gene, community); with ``only_runs``, genes not once in each of so many runs are classes of their own."""
    per = parts.groupBy("gene").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("run", "community")))), 256).alias("sig"), F.countDistinct("run").alias("runs"), F.count(F.lit(1)).alias("n"))
    own = F.lit(None) if only_runs is None else F.when((F.col("runs") != only_runs) | (F.col("n") != only_runs), F.col("gene"))
    per = written(per.select("gene", "sig", own.cast(parts.schema["gene"].dataType).alias("own")), "signatures")
    first = per.groupBy("sig", "own").agg(F.min("gene").alias("cls"))
    return written(per.alias("g").join(first.alias("f"), F.expr("g.sig = f.sig and g.own <=> f.own")).select("gene", "cls"), "members")


def _told(parts: DataFrame) -> DataFrame:
    return parts.select("run", "community", "gene").where("run is not null and community is not null and gene is not null")


def together(parts: DataFrame) -> Together:
    """The counts of the runs (run, gene, community); only a class's first gene meets others."""
    parts = _told(parts)
    members = _classes(parts)
    first = parts.join(small(members.select(F.col("cls").alias("gene")).distinct()), "gene", "left_semi")
    x = first.select("run", "community", F.col("gene").alias("a"))
    y = first.select("run", "community", F.col("gene").alias("b"))
    return Together(members, written(x.join(y, ["run", "community"]).where("a <= b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "together"))


#: Genes of a class that are spread out at once.
CHUNK = 256


def expanded(t: Together) -> DataFrame:
    """(a, b, n) with a <= b for genes: the classes' pairs spread out, without a shuffle of the result."""
    few = t.members.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    size = t.members.groupBy("cls").agg(F.count(F.lit(1)).alias("size"))
    dealt = t.members.join(size, "cls").withColumn("k", F.pmod(F.xxhash64("gene"), F.floor(F.col("size") / CHUNK) + 1))
    chunks = written(dealt.groupBy("cls", "k").agg(F.collect_list("gene").alias("genes")), "chunks")
    side = lambda c: (F.broadcast if few else lambda x: x)(chunks.select(F.col("cls").alias(c), F.col("k").alias("k" + c), F.col("genes").alias("genes_" + c)))
    pairs = t.pairs.repartition(8 * chunks.sparkSession.sparkContext.defaultParallelism)
    met = pairs.join(side("a"), "a").join(side("b"), "b").where("a <> b or ka <= kb").withColumn("same", F.expr("a = b and ka = kb"))
    x = met.select("n", "same", "genes_b", F.explode("genes_a").alias("x")).select("n", "same", "x", F.explode("genes_b").alias("y"))
    return x.where("not same or x <= y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n")


def coassociation(parts: DataFrame) -> DataFrame:
    """(a, b, n) with a <= b: runs in which two genes share a community. Its size is the answer's."""
    return expanded(together(parts))


def _refined(t: Together, u: Together) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes (gene, cls) that both agree on, and both counts over these classes."""
    both = t.members.withColumnRenamed("cls", "c1").join(u.members.withColumnRenamed("cls", "c2"), "gene", "full")
    both = written(both, "both")
    named = written(both.groupBy("c1", "c2").agg(F.min("gene").alias("cls")), "refined")
    members = both.alias("g").join(named.alias("r"), F.expr("g.c1 <=> r.c1 and g.c2 <=> r.c2")).select("gene", "cls")
    over = lambda c, x: expanded(Together(named.where(F.col(c).isNotNull()).select(F.col("cls").alias("gene"), F.col(c).alias("cls")), x.pairs))
    return written(members, "members"), over("c1", t), over("c2", u)


def add_runs(t: Together, parts: DataFrame) -> Together:
    """Earlier counts and those of further runs together; no earlier run is read again."""
    members, old, new = _refined(t, together(parts))
    return Together(members, written(old.unionByName(new).groupBy("a", "b").agg(F.sum("n").alias("n")), "together"))


def _sized(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``pairs`` of classes with the cells of the symmetric matrix of genes that each stands for."""
    size = written(members.groupBy("cls").agg(F.count(F.lit(1)).alias("size")), "sizes")
    side = lambda c: small(size.select(F.col("cls").alias(c), F.col("size").alias("size_" + c)))
    cells = F.col("size_a") * F.col("size_b") * F.when(F.col("a") == F.col("b"), 1).otherwise(2)
    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn("cells", cells)


def shares(counts: DataFrame, runs: int) -> DataFrame:
    """(a, b, share): counts over the number of runs."""
    return counts.select("a", "b", (F.col("n") / runs).alias("share"))


def coassociation_quantiles(t: Together, runs: int, qs: tuple[float, ...] = (0.9, 0.95)) -> DataFrame:
    """(q, value): quantiles of all positive cells of the symmetric matrix, diagonal included; 0 without any.

    Values are counted before they are ranked, and there are at most as many as runs.
    """
    cells = _sized(t.pairs.where("n > 0"), t.members).groupBy("n").agg(F.sum("cells").alias("cells"))
    marks = F.array(*map(F.lit, qs))
    at = cells.agg(F.percentile(F.col("n") / runs, marks, F.col("cells")).alias("v"))
    return at.select(F.explode(F.arrays_zip(marks.alias("q"), F.coalesce("v", F.array(*[F.lit(0.0)] * len(qs))).alias("value"))).alias("x")).select(F.col("x.q").alias("q"), F.col("x.value").alias("value"))


def ever_together(parts: DataFrame, gene) -> DataFrame:
    """(gene): genes that share the community of ``gene`` in any run, itself included."""
    home = parts.where(F.col("gene") == gene).select("run", "community")
    return parts.join(home, ["run", "community"], "left_semi").select("gene").distinct()


def matrix_change(prev: Together, prev_runs: int, curr: Together, curr_runs: int, q: float = 0.9, eps: float = 1e-9) -> DataFrame:
    """(rel_change): quantile of the relative change over all cells of two co-association matrices of the same genes.

    Cells that are 0 in both count too; changes are counted before they are ranked.
    """
    members, old, new = _refined(prev, curr)
    n = members.count()
    both = old.select("a", "b", (F.col("n") / prev_runs).alias("p")).join(new.select("a", "b", (F.col("n") / curr_runs).alias("c")), ["a", "b"], "full").fillna(0.0, ["p", "c"])
    change = F.abs(F.col("p") - F.col("c")) / F.greatest("p", F.lit(eps))
    cells = written(_sized(both, members).groupBy(change.alias("d")).agg(F.sum("cells").alias("cells")), "changes")
    known = cells.agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("known"))
    rest = known.select(F.lit(0.0).alias("d"), (F.lit(n).cast("long") * F.lit(n) - F.col("known")).alias("cells")).where("cells > 0")
    return cells.unionByName(rest).agg(F.percentile("d", q, F.col("cells")).alias("rel_change"))


def partition_metrics(parts: DataFrame, gene) -> DataFrame:
    per = parts.groupBy("run").agg(F.countDistinct("community").alias("k"))
    home = parts.where(F.col("gene") == gene).select("run", "community")
    size = parts.join(home, ["run", "community"], "left_semi").groupBy("run").agg(F.count(F.lit(1)).alias("s"))
    return per.join(size, "run", "left").agg(F.avg("k").alias("avg_k"), F.min("k").alias("min_k"), F.max("k").alias("max_k"), F.avg("s").alias("avg_home"), F.min("s").alias("min_home"), F.max("s").alias("max_home"))


#: Links of a gene from which NumPy counts its neighbours' communities.
MANY = 192


class _Level:
    """A symmetric graph by rows of links, loops apart, as Louvain reads it; made once for all its runs."""

    def __init__(self, start: np.ndarray, to: np.ndarray, weight: np.ndarray | None = None, loop: np.ndarray | None = None):
        self.start, self.to, self.weight, self.size = start.tolist(), to, weight, len(start) - 1
        self.loop = np.zeros(self.size) if loop is None else loop
        many = np.diff(start)
        sums = many.astype(float) if weight is None else np.bincount(np.repeat(np.arange(self.size), many), weight, minlength=self.size)
        self.degree = (sums + 2 * self.loop).tolist()
        self.total = sum(self.degree) or 1.0
        self.many = (many > MANY).tolist()
        self.any_many = any(self.many)
        rows = [(i, *self.start[i : i + 2]) for i in range(self.size) if not self.many[i]]
        self.near = {i: to[a:b].tolist() for i, a, b in rows}
        self.weights = {} if weight is None else {i: weight[a:b].tolist() for i, a, b in rows}
        self.get = {i: itemgetter(*x) for i, x in self.near.items() if len(x) > 1} if weight is None else {}

    def moved(self, rng: np.random.Generator) -> tuple[np.ndarray, bool]:
        """Each node's community once no node gains by moving, and whether any moved.

        A node is looked at again when a neighbour moved; at the end all are, in a new order,
        until none of them moves.
        """
        comm, tot, degree, total, ever = list(range(self.size)), list(self.degree), self.degree, self.total, False
        many, near_of, get, weights = self.many, self.near, self.get, self.weights
        fast_comm, fast_tot, known, looked = np.arange(self.size), np.array(tot), self.size, 0
        while True:
            todo, any_moved = deque(rng.permutation(self.size).tolist()), False
            waiting = bytearray(b"\1") * self.size
            waits = np.frombuffer(waiting, np.uint8)
            while todo:
                i = todo.popleft()
                waiting[i] = 0
                own, d = comm[i], degree[i]
                f = d / total
                tot[own] -= d
                fast_tot[own] = tot[own]
                best = own
                if many[i]:
                    a, b = self.start[i], self.start[i + 1]
                    ends = self.to[a:b]
                    theirs, w = fast_comm[ends], None if self.weight is None else self.weight[a:b]
                    if known > 32 * (b - a):
                        found, at = np.unique(theirs, return_inverse=True)
                        sums = np.bincount(at, w)
                    else:
                        sums = np.bincount(theirs, w)
                        found = np.flatnonzero(sums)
                        sums = sums[found]
                    gains = sums - fast_tot[found] * f
                    k = int(gains.argmax())
                    held = found.searchsorted(own)
                    stay = (sums[held] if held < len(found) and found[held] == own else 0.0) - tot[own] * f
                    if gains[k] > stay + 1e-12:
                        best = int(found[k])
                else:
                    near: dict[int, float] = {}
                    if i in get:
                        _count_elements(near, get[i](comm))
                    elif weights:
                        for j, w in zip(near_of[i], weights[i], strict=True):
                            c = comm[j]
                            near[c] = near.get(c, 0.0) + w
                    elif near_of[i]:
                        near[comm[near_of[i][0]]] = 1.0
                    gain = near.get(own, 0.0) - tot[own] * f
                    for c, w in near.items():
                        g = w - tot[c] * f
                        if g > gain + 1e-12:
                            best, gain = c, g
                tot[best] += d
                fast_tot[best] = tot[best]
                if best != own:
                    comm[i] = best
                    fast_comm[i] = best
                    any_moved = True
                    if many[i]:
                        again = ends[(waits[ends] == 0) & (theirs != best)]
                        waits_on = again.tolist()
                        for j in waits_on:
                            waiting[j] = 1
                        todo.extend(waits_on)
                    else:
                        for j in near_of[i]:
                            if not waiting[j] and comm[j] != best:
                                waiting[j] = 1
                                todo.append(j)
                looked += 1
                if self.any_many and looked % self.size == 0:
                    # Numbers of communities that are left, so that counts by number stay short.
                    left, fast_comm = np.unique(fast_comm, return_inverse=True)
                    known = len(left)
                    comm, tot = fast_comm.tolist(), fast_tot[left].tolist()
                    fast_tot = np.array(tot)
            ever |= any_moved
            if not any_moved:
                return np.array(comm, np.int64), ever

    def folded(self, comm: np.ndarray, n: int) -> _Level:
        """The graph of ``n`` communities; links are read a part at a time."""
        loop = np.bincount(comm, self.loop, minlength=n)
        keys, sums = np.zeros(0, np.int64), np.zeros(0)
        start = np.array(self.start)
        at = 0
        while at < self.size:
            end = max(at + 1, int(np.searchsorted(start, start[at] + BLOCK_LINKS // 4, "right")) - 1)
            part = slice(start[at], start[end])
            key = np.repeat(comm[at:end], np.diff(start[at : end + 1])) * n + comm[self.to[part]]
            w = None if self.weight is None else self.weight[part]
            if n * n <= 4_000_000:
                own = np.bincount(key, w)
                found = np.flatnonzero(own)
                own = own[found]
            else:
                found, place = np.unique(key, return_inverse=True)
                own = np.bincount(place, w)
            both, place = np.unique(np.concatenate([keys, found]), return_inverse=True)
            keys, sums, at = both, np.bincount(place, np.concatenate([sums, own])), end
        a, b = keys // n, keys % n
        loop += np.bincount(a[a == b], sums[a == b] / 2, minlength=n)
        a, b, w = a[a != b], b[a != b], sums[a != b]
        return _Level(np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]), b, w, loop)


def _communities(level: _Level, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    label = np.arange(level.size)
    while True:
        comm, moved = level.moved(rng)
        if not moved:
            return label
        first, comm = np.unique(comm, return_index=True, return_inverse=True)[1:]
        # In the order of their first nodes.
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        comm = rank[comm]
        label = comm[label]
        level = level.folded(comm, len(first))


def louvain(u: np.ndarray, v: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Community per node of an undirected graph of ``n`` nodes; repeated edges weigh more, node order is drawn from the seed."""
    u, v = np.asarray(u, np.int64), np.asarray(v, np.int64)
    same = u == v
    key, times = np.unique(np.concatenate([u[~same] * n + v[~same], v[~same] * n + u[~same]]), return_counts=True)
    start = np.concatenate([[0], np.cumsum(np.bincount(key // n, minlength=n))])
    plain = not same.any() and (times == 1).all()
    return _communities(_Level(start, key % n, None if plain else times.astype(float), np.bincount(u[same], minlength=n).astype(float)), seed)


@dataclass(frozen=True)
class Graph:
    """``genes`` (gene, i), numbered in their order, and ``blocks`` of links from smaller numbers to larger ones, each in a row."""

    genes: DataFrame
    n: int
    blocks: DataFrame

    @cached_property
    def whole(self) -> DataFrame:
        """All blocks in one row, in their order."""
        return written(self.blocks.agg(F.sort_array(F.collect_list(F.struct("blk", "n", "links"))).alias("b")).select(F.transform("b", lambda x: F.struct(x["n"], x["links"])).alias("blocks")), "whole")


#: Links of a block, about, both ways counted.
BLOCK_LINKS = 1_000_000


def louvain_graph(e: DataFrame) -> Graph:
    """The undirected graph of the edges, packed for tasks that each need all of it; none of it goes to the driver."""
    pairs = e.select(F.col("gene1").alias("u"), F.col("gene2").alias("v")).where("u <> v")
    genes = pairs.select(F.col("u").alias("gene")).union(pairs.select("v")).distinct()
    genes = written(genes.select("gene", (F.row_number().over(Window.orderBy("gene")) - 1).cast("int").alias("i")), "numbers")
    n, links = genes.count(), 2 * pairs.count()
    side = lambda c: small(genes.select(F.col("gene").alias(c), F.col("i").alias("i" + c)))
    count = max(1, -(-links // BLOCK_LINKS))
    linked = pairs.join(side("u"), "u").join(side("v"), "v").select(F.least("iu", "iv").alias("s"), F.greatest("iu", "iv").alias("t")).withColumn("blk", F.floor(F.col("s").cast("long") * count / max(1, n)).cast("int"))

    def pack(key: tuple, block: pa.Table) -> pa.Table:
        s, t = (block[c].to_numpy().astype(np.int64) for c in ("s", "t"))
        links = np.unique(s * n + t)
        return pa.table({"blk": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(links)]), "links": pa.array([zlib.compress(np.diff(links, prepend=0).tobytes(), 1)], pa.binary())})

    return Graph(genes, n, written(linked.groupBy("blk").applyInArrow(pack, "blk int, n long, links binary"), "graph"))


def _level_of(blocks: list[tuple[int, int, bytes]], n: int) -> _Level:
    """The graph of all blocks, which are used up; a gene's links are in one block, in order."""

    def ends(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        links = np.cumsum(np.frombuffer(zlib.decompress(packed), np.int64))
        return links // n, links % n

    above, below = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for _, _, packed in blocks:
        s, t = ends(packed)
        above += np.bincount(s, minlength=n)
        below += np.bincount(t, minlength=n)
    start, to = np.concatenate([[0], np.cumsum(above + below)]), np.empty(2 * sum(x[1] for x in blocks), np.int32)
    # Of a gene's neighbours the smaller ones come first, as their blocks do.
    free = start[:-1].copy()
    blocks.sort(reverse=True)
    while blocks:
        s, t = ends(blocks.pop()[2])
        to[start[s] + below[s] + np.arange(len(s)) - np.searchsorted(s, s)] = t
        order = np.argsort(t, kind="stable")
        s, t = s[order], t[order]
        to[free[t] + np.arange(len(t)) - np.searchsorted(t, t)] = s
        free += np.bincount(t, minlength=n)
    return _Level(start, to)


def _seeds(graph: Graph, first: int, last: int, each: int = 8) -> DataFrame:
    """(lo, hi): the seeds by tasks, ``each`` for a core."""
    spark = graph.genes.sparkSession
    tasks = max(1, min(last - first, each * spark.sparkContext.defaultParallelism))
    part = lambda k: (F.lit(first) + F.floor(k * (last - first) / tasks)).cast("long")
    return spark.range(0, tasks, 1, tasks).select(part(F.col("id")).alias("lo"), part(F.col("id") + 1).alias("hi"))


def _each_run(graph: Graph, first: int, last: int, rows, schema: str) -> DataFrame:
    """What ``rows`` yields of a task's runs (seed, community by number); a task reads the written graph once for its seeds."""
    seeds, n = _seeds(graph, first, last), graph.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, lo, hi = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                lo, hi = batch.column("lo")[0].as_py(), batch.column("hi")[0].as_py()
                blocks += zip(*(batch.column(c).to_pylist() for c in ("blk", "n", "links")), strict=True)
        batch = None  # else it stays beside its copy
        pa.default_memory_pool().release_unused()
        if blocks:
            level = _level_of(blocks, n)
            yield from rows((seed, _communities(level, seed)) for seed in range(lo, hi))

    return seeds.hint("shuffle_replicate_nl").crossJoin(graph.blocks.coalesce(1).hint("shuffle_replicate_nl")).mapInArrow(run, schema)


def louvain_runs(spark: SparkSession, e: DataFrame, first: int, last: int, graph: Graph | None = None) -> DataFrame:
    """(run, gene, community) for seeds ``first`` to ``last`` - 1.

    Louvain needs the whole graph in a run: each task reads the packed graph, eight bytes or
    less a link, and no other place holds it.
    """
    graph = louvain_graph(e) if graph is None else graph

    def rows(runs: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for seed, label in runs:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(label), seed)), pa.array(np.arange(len(label), dtype=np.int32)), pa.array(label)], names=["run", "i", "community"])

    return _each_run(graph, first, last, rows, "run long, i int, community long").join(small(graph.genes), "i").select("run", "gene", "community")


def louvain_hits(graph: Graph, first: int, last: int, gene) -> DataFrame:
    """(gene, n): runs of the seeds in which a gene is in the community of ``gene``; added up in the tasks, so no run is written.

    The runs are those of :func:`louvain_runs`, number by number, made in Java; none is needed
    for a gene that is not in the graph.
    """
    home = graph.genes.where(F.col("gene") == gene).first()
    if home is None:
        return graph.genes.select("gene", F.lit(0).cast("long").alias("n"))
    hits = register(graph.genes.sparkSession, "causeway_louvain_hits", "LouvainHits", ArrayType(LongType()))
    both = _seeds(graph, first, last).hint("shuffle_replicate_nl").crossJoin(graph.whole.hint("shuffle_replicate_nl"))
    each = both.select(F.posexplode(F.call_udf(hits, "blocks", F.lit(graph.n), "lo", "hi", F.lit(home["i"]))).alias("i", "n"))
    return each.groupBy("i").agg(F.sum("n").alias("n")).join(small(graph.genes), "i").select("gene", "n")


def average_linkage(similarity: np.ndarray, k: int, size: np.ndarray | None = None) -> np.ndarray:
    """Cluster numbers after merging by average linkage on 1 - similarity until ``k`` remain.

    ``size``: how many equal rows each row stands for. Ties go to the first row, then the first
    column; each row's nearest one is kept, so a merge reads few rows.
    """
    n = len(similarity)
    d = 1.0 - similarity.astype(float)
    np.fill_diagonal(d, np.inf)
    size, label = (np.ones(n) if size is None else size.astype(float)), np.arange(n)
    near = d.argmin(1)
    best = d[np.arange(n), near]
    for _ in range(n - max(1, k)):
        i = int(best.argmin())
        i, j = sorted((i, int(near[i])))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[i] = row[j] = np.inf
        d[i] = d[:, i] = row
        d[j] = d[:, j] = np.inf
        size[i] += size[j]
        label[label == j] = i
        lost = (near == i) | (near == j)
        lost[[i, j]] = True
        won = ~lost & ((row < best) | ((row == best) & (i < near) & np.isfinite(row)))
        near[won], best[won] = i, row[won]
        for r in np.flatnonzero(lost).tolist():
            near[r] = d[r].argmin()
            best[r] = d[r, near[r]]
    return np.unique(label, return_inverse=True)[1]


#: Classes of genes up to which their shares are held as a matrix.
MATRIX = 5000


def average_linkage_by_places(cls: np.ndarray, place: np.ndarray, times: np.ndarray, runs: int, k: int, size: np.ndarray) -> np.ndarray:
    """As :func:`average_linkage`, of shares that are never held as a matrix: class ``cls`` is ``times`` in ``place``, entry by entry.

    A cluster's shares with all others come from its counts by place. Counts are whole numbers,
    so equal distances are equal. Memory is that of the entries; each step reads them all.
    """
    n, places = len(size), int(place.max()) + 1
    order = np.argsort(cls, kind="stable")
    cls, place, weight = cls[order], place[order], (times * size[cls])[order].astype(float)
    ends = np.searchsorted(cls, np.arange(n + 1))
    entries = [np.arange(ends[i], ends[i + 1]) for i in range(n)]
    label, held, alive, owner = np.arange(n), size.astype(float), np.ones(n, bool), cls.copy()

    def distances(i: int) -> np.ndarray:
        own = np.bincount(place[entries[i]], weight[entries[i]], minlength=places)
        d = np.where(alive, 1.0 - np.bincount(owner, weight * own[place], minlength=n) / (runs * held[i] * held), np.inf)
        d[i] = np.inf
        return d

    near, best = np.zeros(n, np.int64), np.zeros(n)
    for i in range(n):
        d = distances(i)
        near[i] = d.argmin()
        best[i] = d[near[i]]
    for _ in range(n - max(1, k)):
        i = int(best.argmin())
        i, j = sorted((i, int(near[i])))
        owner[entries[j]] = i
        entries[i], entries[j] = np.concatenate([entries[i], entries[j]]), entries[j][:0]
        held[i] += held[j]
        alive[j], best[j] = False, np.inf
        label[label == j] = i
        row = distances(i)
        lost = alive & ((near == i) | (near == j))
        lost[i] = True
        won = alive & ~lost & ((row < best) | ((row == best) & (i < near)))
        near[won], best[won] = i, row[won]
        for r in np.flatnonzero(lost).tolist():
            d = row if r == i else distances(r)
            near[r] = d.argmin()
            best[r] = d[near[r]]
    return np.unique(label, return_inverse=True)[1]


def consensus_clusters(parts: DataFrame, max_genes: int | None = None, max_classes: int | None = None, matrix: int = MATRIX) -> DataFrame:
    """(gene, community): average linkage on 1 - share, cut at the mean number of communities.

    The number is rounded half to even, and 1 at least. Genes in the same communities in all
    runs are at distance 0 and merge first, so classes of such genes are clustered, in one task.
    It holds a matrix of them up to ``matrix`` classes, beyond only their places. It raises
    beyond ``max_classes`` or ``max_genes`` if these are given. Communities are numbered in the
    order of their first genes.
    """
    k = parts.groupBy("run").agg(F.countDistinct("community").alias("k")).agg(F.avg("k"), F.count(F.lit(1))).first()
    genes = parts.select("gene").distinct()
    if max_genes is not None and genes.limit(max_genes + 1).count() > max_genes:
        raise ValueError(f"more than {max_genes} genes: select a smaller network")
    if not k[1]:
        return genes.withColumn("community", F.lit(0).cast("long"))
    keep, runs = max(1, round(k[0])), k[1]
    kind = parts.schema["gene"].dataType.simpleString()
    told = _told(parts)
    members = _classes(told, runs)
    first = members.select(F.col("cls").alias("gene")).distinct()
    if max_classes is not None and first.limit(max_classes + 1).count() > max_classes:
        raise ValueError(f"more than {max_classes} classes of genes: select a smaller network")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["place"] < 0].sort_values(["cls", "gene"])
        rows = pdf[pdf["place"] >= 0]
        names, cls = np.unique(own["cls"].to_numpy(), return_inverse=True)
        spare = len(own) - max(keep, len(names))
        if keep > len(names):
            # Equal genes merge in their order, until so many remain.
            later = np.flatnonzero(own["cls"].to_numpy() != own["gene"].to_numpy())
            alone = later[spare:]
            head = own["cls"].to_numpy().copy()
            head[alone] = own["gene"].to_numpy()[alone]
            return pd.DataFrame({"gene": own["gene"].to_numpy(), "community": np.unique(head, return_inverse=True)[1]})
        at = np.searchsorted(names, rows["gene"].to_numpy())
        if len(names) > matrix:
            told = pd.DataFrame({"at": at, "place": np.unique(rows["place"].to_numpy(), return_inverse=True)[1]}).value_counts().reset_index()
            label = average_linkage_by_places(told["at"].to_numpy(), told["place"].to_numpy(), told["count"].to_numpy(), runs, keep, np.bincount(cls))
            return pd.DataFrame({"gene": own["gene"].to_numpy(), "community": label[cls]})
        same = np.zeros((len(names), len(names)), np.int32)
        for _, part in pd.DataFrame({"at": at, "place": rows["place"].to_numpy()}).groupby("place"):
            i, n = np.unique(part["at"].to_numpy(), return_counts=True)
            same[np.ix_(i, i)] += np.outer(n, n).astype(np.int32)
        label = average_linkage(same / runs, keep, np.bincount(cls))
        return pd.DataFrame({"gene": own["gene"].to_numpy(), "community": label[cls]})

    held = told.join(small(first), "gene", "left_semi")
    places = written(held.groupBy("run", "community").agg(F.collect_list("gene").alias("genes")), "places")
    rows = places.select(F.lit(None).cast(kind).alias("cls"), F.explode("genes").alias("gene"), F.pmod(F.xxhash64("run", "community"), F.lit(1 << 62)).alias("place"))
    both = members.select("cls", "gene", F.lit(-1).cast("long").alias("place")).unionByName(rows).withColumn("all", F.lit(0))
    return both.groupBy("all").applyInPandas(lambda pdf: cluster(pdf), f"gene {kind}, community long")


def consensus_metrics(clusters: DataFrame, gene) -> DataFrame:
    """Communities, the largest, and the community of ``gene`` and its size: -1 and 0 if it is absent."""
    size = clusters.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("gene") == gene).cast("int")).alias("home"))
    return size.agg(
        F.count(F.lit(1)).alias("communities"), F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("largest"),
        F.coalesce(F.max("home") == 1, F.lit(False)).alias("present"), F.coalesce(F.max(F.when(F.col("home") == 1, F.col("community"))), F.lit(-1).cast("long")).alias("home"),
        F.coalesce(F.max(F.when(F.col("home") == 1, F.col("n"))), F.lit(0).cast("long")).alias("home_size"),
    )


def subcommunities(clusters: DataFrame, gene) -> DataFrame:
    """(communities, largest, home, home_size, home_genes): the community of ``gene``, whatever its case, with its genes in order."""
    same = F.upper(F.col("gene").cast("string")) == str(gene).upper()
    home = clusters.where(same).agg(F.min("community").alias("home"))
    size = clusters.groupBy("community").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("communities"), F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("largest"))
    own = clusters.join(F.broadcast(home), F.col("community") == F.col("home"), "left_semi").agg(F.count(F.lit(1)).alias("home_size"), F.sort_array(F.collect_list("gene")).alias("home_genes"))
    return size.join(F.broadcast(home)).join(F.broadcast(own))


def community_of(clusters: DataFrame, gene) -> DataFrame:
    """(gene): the genes in the community of ``gene``."""
    home = clusters.where(F.col("gene") == gene).select("community")
    return clusters.join(F.broadcast(home), "community", "left_semi").select("gene")


def community_export(e: DataFrame, clusters: DataFrame, gene, added: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(genes, edges) of the community of ``gene``: degrees inside it and a Steiner flag; its inner edges."""
    from causeway.operators import edges

    own = community_of(clusters, gene)
    inner = edges.induced(e, own)
    extra = own.limit(0) if added is None else added.select("gene").distinct()
    flag = extra.withColumn("is_steiner", F.lit(1))
    genes = edges.degrees(inner, own).join(own, "gene", "left_semi").join(flag, "gene", "left").fillna(0, ["is_steiner"])
    return genes.select("gene", "out_degree", "in_degree", "is_steiner"), inner


def export_order(genes: DataFrame) -> DataFrame:
    return genes.orderBy(F.desc("is_steiner"), F.desc("out_degree"), F.desc("in_degree"), "gene")


def top_consensus_network(e: DataFrame, freq: DataFrame, fraction: float, gene, p: float) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): significant edges between the top genes, which meet the network's names whatever their case.

    Selected genes without such an edge are nodes too, isolated.
    """
    from causeway.operators import edges, ranking

    good = e.where(F.col("p_value") <= p)
    fold = lambda c: F.upper(F.col(c).cast("string"))
    named = edges.nodes(good).groupBy(fold("gene").alias("u")).agg(F.max("gene").alias("known"))
    picked = ranking.top_consensus(freq, fraction, gene).withColumn("u", fold("gene")).join(named, "u", "left")
    return edges.induced_network(good, picked.select(F.coalesce("known", "gene").alias("gene")), p)


def stable_consensus(spark: SparkSession, e: DataFrame, gene, start: int = 5000, growth: float = 0.2, tol: float = 0.05, q: float = 0.9, overlap: float = 95.0, max_runs: int | None = None) -> DataFrame:
    """(gene, frequency, runs, stable) around ``gene`` once a further batch of runs no longer changes them.

    Without ``max_runs`` it goes on until that is so; with it, ``stable`` tells whether it was.
    """
    from causeway.operators import ranking
    from causeway.operators.graph import _cut

    graph = louvain_graph(e)

    def hits(first: int, last: int) -> DataFrame:
        return louvain_hits(graph, first, last, gene)

    # Hits add up over the batches, so that no run is read twice.
    total, runs, previous = _cut(hits(0, start), "hits"), start, None
    while True:
        freq = total.select("gene", (F.col("n") / runs).alias("frequency"))
        stable = False
        if previous is not None:
            s = ranking.stability(previous, freq, q).first()
            stable = (s["rel_change"] or 0.0) <= tol and s["overlap"] >= overlap
        if stable or (max_runs is not None and runs >= max_runs):
            return freq.withColumns({"runs": F.lit(runs).cast("long"), "stable": F.lit(stable)})
        more = max(1, int(runs * growth))
        total = _cut(total.unionByName(hits(runs, runs + more)).groupBy("gene").agg(F.sum("n").alias("n")), "hits")
        runs, previous = runs + more, freq


def edge_betweenness(near: dict[int, set[int]]) -> dict[tuple[int, int], float]:
    """Shares of all shortest paths that use each undirected edge."""
    load = dict.fromkeys(((a, b) for a in near for b in near[a] if a < b), 0.0)
    for source in near:
        level, ways, order = {source: 0}, {source: 1.0}, [source]
        for x in order:
            for y in near[x]:
                if y not in level:
                    level[y], ways[y] = level[x] + 1, 0.0
                    order.append(y)
                if level[y] == level[x] + 1:
                    ways[y] += ways[x]
        owed = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in near[y]:
                if level[x] == level[y] - 1:
                    part = ways[x] / ways[y] * (1.0 + owed[y])
                    load[min(x, y), max(x, y)] += part
                    owed[x] += part
    return load


#: Links times genes up to which one task removes links; loads in bytes, of all tasks, that go to the driver as they are.
ONE_TASK_WORK = 2_000_000
LOAD_BYTES = 100_000_000


class _Loads:
    """Loads of a graph's links, by number, as links go; only the loads are on the driver."""

    def __init__(self, graph: Graph):
        self.graph, self.gone = graph, []
        self.ends = np.cumsum([0, *(r.n for r in graph.blocks.select("blk", "n").orderBy("blk").collect())])
        register(graph.genes.sparkSession, "causeway_edge_loads", "EdgeLoads", "array<struct<chunk: int, loads: binary>>")
        self.load = self._made(False)[0]

    def _made(self, change: bool) -> tuple[np.ndarray, bool]:
        """All loads or their change by the last link that went, added up over the genes, and whether its ends fell apart."""
        both = _seeds(self.graph, 0, self.graph.n, 2).hint("shuffle_replicate_nl").crossJoin(self.graph.whole.hint("shuffle_replicate_nl"))
        gone = F.lit(bytearray(np.array(self.gone, "<i8").tobytes()))
        told = both.select("lo", F.explode(F.call_udf("causeway_edge_loads", "blocks", F.lit(self.graph.n), gone, F.lit(change), "lo", "hi")).alias("x")).select("lo", "x.chunk", "x.loads")
        if 8 * int(self.ends[-1]) * 2 * told.sparkSession.sparkContext.defaultParallelism > LOAD_BYTES:
            told = told.groupBy("chunk").applyInArrow(_added, "lo long, chunk int, loads binary")
        load, apart = np.zeros(int(self.ends[-1])), False
        for r in sorted(told.collect(), key=lambda r: r.lo):
            part = np.frombuffer(r.loads)
            apart |= r.chunk < 0
            load[max(r.chunk, 0) * LOAD_CHUNK :][: len(part)] += part
        return load, apart

    def remove(self) -> bool:
        """The link of the highest load goes, of equal ones the first; whether its ends fell apart.

        Loads that follow changes are off by far less than a millionth of them; where that leaves
        more than one link, all are made anew.
        """
        near = lambda by: np.flatnonzero(self.load >= self.load.max() * (1 - by))
        if len(near(1e-6)) > 1:
            self.load = self._made(False)[0]
            self.load[self.gone] = 0
        self.gone.append(int(near(1e-11)[0]))
        change, apart = self._made(True)
        self.load += change
        self.load[self.gone] = 0
        return apart

    def removed(self) -> list[tuple[int, int]]:
        """The ends of the links that went, by number."""
        out = []
        for j in np.unique(np.searchsorted(self.ends, self.gone, "right") - 1).tolist():
            r = self.graph.blocks.orderBy("blk").offset(j).first()
            links = np.cumsum(np.frombuffer(zlib.decompress(bytes(r.links)), np.int64))
            lo, hi = self.ends[j : j + 2]
            out += [divmod(int(links[x - lo]), self.graph.n) for x in self.gone if lo <= x < hi]
        return out


#: Links whose loads travel together, as in EdgeLoads.java.
LOAD_CHUNK = 65536


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("lo")
    load = sum(np.frombuffer(x.as_py()) for x in rows["loads"])
    return pa.table({"lo": pa.array([0]), "chunk": pa.array([key[0].as_py()], pa.int32()), "loads": pa.array([load.tobytes()], pa.binary())})


def _numbered(found: DataFrame) -> DataFrame:
    """(gene, community) of (gene, component), in the components' order."""
    ranked = found.select("component").distinct().select("component", (F.row_number().over(Window.orderBy("component")) - 1).cast("long").alias("community"))
    return found.join(ranked, "component").select("gene", "community")


def _removed_in_rounds(pairs: DataFrame, found: DataFrame, k: int | None) -> DataFrame:
    """(gene, community): a job for each link that goes, dealt by genes."""
    from causeway.operators.graph import components

    spark = pairs.sparkSession
    edges = pairs.select(F.col("u").alias("gene1"), F.col("v").alias("gene2"))
    graph = louvain_graph(edges)
    if k is None:
        k = louvain_runs(spark, edges, 0, 1, graph).select("community").distinct().count()
    parts = found.select("component").distinct().count()
    if graph.n < k:
        return _numbered(found).limit(0)
    loads = _Loads(graph) if parts < k else None
    while parts < k:
        parts += loads.remove()
    if loads:
        ends = spark.createDataFrame(loads.removed(), "s int, t int")
        name = lambda c, out: small(graph.genes.select(F.col("gene").alias(out), F.col("i").alias(c)))
        gone = ends.join(name("s", "gene1"), "s").join(name("t", "gene2"), "t").select("gene1", "gene2")
        loops = graph.genes.select(F.col("gene").alias("gene1"), F.col("gene").alias("gene2"))
        found = written(components(edges.join(F.broadcast(gone), ["gene1", "gene2"], "left_anti").unionByName(loops)), "components")
    return _numbered(found)


def girvan_newman(e: DataFrame, k: int | None = None, max_edges: int | None = None) -> DataFrame:
    """(gene, community): edges of highest betweenness go until ``k`` communities remain.

    A graph that is in ``k`` parts from the start needs no removal, so its weak components are
    returned. Small graphs are split by one task, others by a job for each removal, which reads
    only the paths that used the edge. Without ``k`` it is the number that one Louvain run finds.
    Ties go to the smaller edge; fewer genes than ``k``: no rows. There is no bound of edges but
    ``max_edges``, beyond which a graph in fewer parts raises.
    """
    from causeway.operators.graph import components

    rows = written(e.select(F.least("gene1", "gene2").alias("u"), F.greatest("gene1", "gene2").alias("v")).where("u <> v").distinct(), "pairs")
    links = rows.count()
    if links * rows.select("u").union(rows.select("v")).distinct().count() > ONE_TASK_WORK or (max_edges is not None and links > max_edges):
        found = written(components(rows.select(F.col("u").alias("gene1"), F.col("v").alias("gene2"))), "components")
        if k is not None and found.select("component").distinct().limit(k).count() == k:
            return _numbered(found)
        if max_edges is not None and links > max_edges:
            raise ValueError(f"more than {max_edges} edges: lower the threshold")
        return _removed_in_rounds(rows, found, k)

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        names, flat = np.unique(pdf[["u", "v"]].to_numpy().ravel(), return_inverse=True)
        near: dict[int, set[int]] = {i: set() for i in range(len(names))}
        for a, b in flat.reshape(-1, 2).tolist():
            near[a].add(b)
            near[b].add(a)
        want = k
        if want is None:
            ends = flat.reshape(-1, 2)
            want = len(set(louvain(ends[:, 0], ends[:, 1], len(names), 0).tolist()))
        while True:
            label: dict[int, int] = {}
            for i in near:
                if i not in label:
                    label[i], todo = i, [i]
                    for x in todo:
                        for y in near[x] - label.keys():
                            label[y] = i
                            todo.append(y)
            found = sorted(set(label.values()))
            load = edge_betweenness(near) if len(found) < want else {}
            if not load:
                break
            a, b = min(load, key=lambda x: (-round(load[x], 9), x))
            near[a].discard(b)
            near[b].discard(a)
        keep = len(found) >= want
        number = {c: j for j, c in enumerate(found)}
        return pd.DataFrame({"gene": names[: len(names) * keep], "community": [number[label[i]] for i in near][: len(names) * keep]})

    kind = e.schema["gene1"].dataType.simpleString()
    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda pdf: split(pdf), f"gene {kind}, community long")


def reduce_communities(parts: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest communities stay; genes of others join the smallest kept number."""
    kept = parts.groupBy("community").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "community").limit(k).select("community")
    low = kept.agg(F.min("community").alias("low"))
    tagged = parts.join(F.broadcast(kept.withColumn("hit", F.lit(True))), "community", "left").join(F.broadcast(low))
    return tagged.select("gene", F.when(F.col("hit"), F.col("community")).otherwise(F.col("low")).alias("community"))
