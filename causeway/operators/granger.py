"""Lag-1 Granger causality over all or chosen ordered pairs of series.

With y = v[1:] and l = v[:-1], centred, a pair needs two dot products besides the moments of
its two series; all pairs are two matrix products. Series are packed into blocks, a row each,
written once; every two blocks meet by a Cartesian product of these rows, which reads them
again instead of shuffling copies. Memory is bounded by the block whatever the number of
series, and nothing is broadcast. A pair's figures are the same to the last bit in whatever
blocks its series meet, as every matrix product has the shape of one tile.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.stats import f_tail_numpy
from causeway.functions.tables import small, written

#: Series of a block at most, about, and those of a tile: all matrix products are TILE x points x TILE.
BLOCK = 2000
TILE = 512
SINGULAR = 1e-12
#: Why a pair has no test, by code; 0 is a test that went well.
ERRORS = [None, "constant data", "singular fit", "unequal length", "missing value", "too few points"]
CONSTANT, SINGULAR_FIT, UNEQUAL, MISSING, SHORT = range(1, 6)


class _Side:
    """Centred values and moments of series of one length, padded to whole tiles."""

    def __init__(self, v: np.ndarray):
        self.n, self.df = len(v), v.shape[1] - 4
        y, x = v[:, 1:], v[:, :-1]
        y, x = y - y.mean(1, keepdims=True), x - x.mean(1, keepdims=True)
        self.ll, self.yl, self.yy = (x * x).sum(1), (y * x).sum(1), (y * y).sum(1)
        with np.errstate(all="ignore"):
            self.slope = self.yl / self.ll
            self.rss = self.yy - self.yl * self.yl / self.ll
        rest = ((0, -self.n % TILE), (0, 0))
        self.now, self.lag = np.pad(y, rest), np.pad(x, rest)


def _products(a: _Side, b: _Side, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """num and den of the tile of the causes from ``i`` on and the targets from ``j`` on."""
    rows, cols = min(TILE, a.n - i), min(TILE, b.n - j)
    lag = a.lag[i : i + TILE]
    xy, xl = (lag @ b.now[j : j + TILE].T)[:rows, :cols], (lag @ b.lag[j : j + TILE].T)[:rows, :cols]
    num = xy - xl * b.slope[j : j + TILE]
    den = a.ll[i : i + TILE, None] - xl * xl / b.ll[j : j + TILE]
    return num, den


def _tested(num: np.ndarray, den: np.ndarray, ll: np.ndarray, rss: np.ndarray, df: int) -> tuple[np.ndarray, np.ndarray]:
    """F and p, NaN where the fit is singular."""
    gain = num * num / den
    f = gain / (rss - gain) * df
    ok = (den > SINGULAR * np.maximum(ll, 1e-300)) & np.isfinite(f)
    return np.where(ok, f, np.nan), np.where(ok, f_tail_numpy(f, df), np.nan)


def pair_tests(cause: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """F statistics and p-values [causes, targets] of the test that a cause helps its target."""
    a, b = _Side(cause), _Side(target)
    f, p = (np.full((a.n, b.n), np.nan) for _ in range(2))
    with np.errstate(all="ignore"):
        for i in range(0, a.n, TILE):
            for j in range(0, b.n, TILE):
                at = slice(i, i + TILE), slice(j, j + TILE)
                f[at], p[at] = _tested(*_products(a, b, i, j), a.ll[at[0], None], b.rss[at[1]], a.df)
    return f, p, a.df


def _share(max_p: float, df: int) -> float | None:
    """A share of the restricted fit's squares that a gain must have for p to be at most ``max_p``; None: any."""
    want = max_p + 1e-12
    if want >= 1:
        return None
    low, high = 0.0, 1.0
    while float(f_tail_numpy(np.array(high), df)) > want:
        low, high = high, high * 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if float(f_tail_numpy(np.array(mid), df)) > want else (low, mid)
    return low / (low + df) * (1 - 1e-6)


def _kept(a: _Side, b: _Side, i: int, j: int, max_p: float, share: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, column, F and p of a tile's pairs with p at most ``max_p``; p is worked out only where it may be."""
    with np.errstate(all="ignore"):
        num, den = _products(a, b, i, j)
        r, c = np.nonzero(np.full(num.shape, True) if share is None else num * num >= den * (b.rss[j : j + TILE] * share))
        f, p = _tested(num[r, c], den[r, c], a.ll[i + r], b.rss[j + c], a.df)
        hit = p <= max_p
    return i + r[hit], j + c[hit], f[hit], p[hit]


def n_blocks(n: int, block: int, cores: int) -> int:
    """Blocks of at most ``block`` series, but enough for the cores as long as they hold 64 or so."""
    return max(1, -(-n // block), min(-(-n // 64), int((2 * cores) ** 0.5 + 1)))


def blocks_of(series: DataFrame, n: int) -> DataFrame:
    """(blk, gene, series): genes dealt by hash into ``n`` blocks."""
    return series.select(F.pmod(F.xxhash64("gene"), F.lit(n)).cast("int").alias("blk"), "gene", "series")


def _series(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values in a row, with NaN for nulls; where each series begins; its length."""
    lists = column.combine_chunks()
    length = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False)
    return values, np.cumsum(length) - length, length


def _block_tests(x: pa.Table, y: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """F, p and error code of every pair of a series of ``x`` with one of ``y``."""
    (vx, bx, nx), (vy, by, ny) = _series(x["series"]), _series(y["series"])
    f, p = (np.full((len(nx), len(ny)), np.nan) for _ in range(2))
    code = np.full(f.shape, UNEQUAL, np.int8)
    for n in np.intersect1d(nx, ny).tolist():
        i, j = np.flatnonzero(nx == n), np.flatnonzero(ny == n)
        part = np.ix_(i, j)
        if n < 5:
            code[part] = SHORT
            continue
        m1, m2 = vx[bx[i][:, None] + np.arange(n)], vy[by[j][:, None] + np.arange(n)]
        f[part], p[part], _ = pair_tests(m1, m2)
        own = np.where(np.isnan(p[part]), SINGULAR_FIT, 0)
        own[(m1.max(1) == m1.min(1))[:, None] | (m2.max(1) == m2.min(1))] = CONSTANT
        own[~np.isfinite(m1).all(1)[:, None] | ~np.isfinite(m2).all(1)] = MISSING
        code[part] = own
    f[code > 0] = p[code > 0] = np.nan
    return f, p, code


def _sides(x: pa.StructArray, y: pa.StructArray) -> Iterator[tuple[np.ndarray, np.ndarray, _Side, _Side]]:
    """Places in both blocks and values of the series of each length that can be tested: all values there, not constant."""
    found = []
    for block in (x, y):
        values, begin, length = _series(pa.chunked_array([block.field("series")]))
        own = {}
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            m = values[begin[at][:, None] + np.arange(n)]
            if n >= 5 and (good := np.isfinite(m).all(1) & (m.max(1) > m.min(1))).any():
                own[n] = at[good], m[good]
        found.append(own)
    for n in found[0].keys() & found[1].keys():
        (i, m1), (j, m2) = found[0][n], found[1][n]
        yield i, j, _Side(m1), _Side(m2)


def _differ(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))


def _packed(series: DataFrame, n: int) -> DataFrame:
    """(blk, rows): a row for each block, written once."""
    kind = series.schema["gene"].dataType.simpleString()
    rows = blocks_of(series, n).groupBy("blk").agg(F.collect_list(F.struct("gene", "series")).alias("rows"))
    return written(rows.select("blk", F.col("rows").cast(f"array<struct<gene:{kind},series:array<double>>>").alias("rows")), "blocks")


def _met(left: DataFrame, right: DataFrame, which: str | None = None) -> DataFrame:
    """Every two blocks (bi, x, bj, y), by a Cartesian product at any size."""
    a = left.select(F.col("blk").alias("bi"), F.col("rows").alias("x")).hint("shuffle_replicate_nl")
    b = right.select(F.col("blk").alias("bj"), F.col("rows").alias("y")).hint("shuffle_replicate_nl")
    return a.crossJoin(b) if which is None else a.join(b, F.expr(which))


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.StructArray, pa.StructArray]]:
    """Whether it is a block with itself, and the rows of both."""
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        for k in range(batch.num_rows):
            yield batch.column("bi")[k] == batch.column("bj")[k], x.slice(k, 1).flatten(), y.slice(k, 1).flatten()


def granger(causes: DataFrame, targets: DataFrame | None = None, max_p: float = 1.0, audit: bool = False, block: int = BLOCK, done: DataFrame | None = None, same_genes: bool = True) -> DataFrame:
    """(gene1, gene2, f_stat, p_value, error): gene1 -> gene2 for every ordered pair of two genes.

    Inputs: (gene, series). Rows with p <= ``max_p`` are kept; with ``audit`` failed pairs too,
    as null p and one of ``ERRORS``: constant series, singular fits, series of unequal length,
    with a missing value, or of fewer than five points. ``done`` (gene1, gene2) holds the pairs
    of earlier runs: they are left out, and two blocks whose pairs are all done never meet.
    With ``same_genes`` off, equal names on both sides are different series.
    """
    spark = causes.sparkSession
    cores = spark.sparkContext.defaultParallelism
    block = min(block, TILE) if audit else block
    nl = n_blocks(causes.count(), block, cores)
    left = _packed(causes, nl)
    nr, right = (nl, left) if targets is None else ((n := n_blocks(targets.count(), block, cores)), _packed(targets, n))
    met = _met(left, right)
    if done is not None:
        done = done.select("gene1", "gene2").distinct()
        full = _finished(blocks_of(causes, nl), blocks_of(causes if targets is None else targets, nr), done, nl, nr, same_genes)
        met = met.join(F.broadcast(written(full, "full")), ["bi", "bj"], "left_anti")  # a row per pair of blocks at most
    kind = causes.schema["gene"].dataType.simpleString()
    columns = ["gene1", "gene2", "f_stat", "p_value"]

    def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, y in _pairs_of_blocks(batches):
            f, p, code = _block_tests(*(pa.table({"series": side.field("series")}) for side in (x, y)))
            i, j = np.nonzero((p <= max_p) | (code > 0))
            found = [x.field("gene").take(pa.array(i)), y.field("gene").take(pa.array(j)), pa.array(f[i, j], from_pandas=True), pa.array(p[i, j], from_pandas=True)]
            why = pa.DictionaryArray.from_arrays(pa.array(code[i, j]), pa.array(ERRORS, pa.string())).cast(pa.string())
            out = pa.RecordBatch.from_arrays([*found, why], names=[*columns, "error"])
            yield out.filter(_differ(found[0], found[1])) if same_genes else out

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, y in _pairs_of_blocks(batches):
            for at, to, a, b in _sides(x, y):
                share = _share(max_p, a.df)
                for i in range(0, a.n, TILE):
                    r, c, f, p = (np.concatenate(v) for v in zip(*(_kept(a, b, i, j, max_p, share) for j in range(0, b.n, TILE)), strict=True))
                    out = pa.RecordBatch.from_arrays([x.field("gene").take(pa.array(at[r])), y.field("gene").take(pa.array(to[c])), pa.array(f), pa.array(p)], names=columns)
                    yield out.filter(_differ(out.column(0), out.column(1))) if same_genes else out

    out = met.mapInArrow(audited if audit else tested, f"gene1 {kind}, gene2 {kind}, f_stat double, p_value double" + ", error string" * audit)
    if not audit:
        out = out.withColumn("error", F.lit(None).cast("string"))
    return out if done is None else out.join(done, ["gene1", "gene2"], "left_anti")


def both_ways(series: DataFrame, max_p: float, least_p: float | None = None, block: int = BLOCK) -> DataFrame:
    """(u, v, p_uv, p_vu), u < v: both tests of two genes, null if above ``max_p``; pairs with neither are left out.

    Both tests of a pair are made where its blocks meet, so no edge travels to its reverse.
    With ``least_p`` the smaller of both must be at most that. Every gene must have one series;
    it raises otherwise.
    """
    n, genes, nulls = series.agg(F.count(F.lit(1)), F.countDistinct("gene"), F.count_if(F.col("gene").isNull())).first()
    if n != genes + nulls or nulls:
        raise ValueError("a gene without a name, or with more than one series")
    packed = _packed(series, n_blocks(n, block, series.sparkSession.sparkContext.defaultParallelism))
    kind = series.schema["gene"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for same, x, y in _pairs_of_blocks(batches):
            for at, to, a, b in _sides(x, y):
                share = _share(max_p, a.df)
                for i in range(0, a.n, TILE):
                    for j in range(i if same else 0, b.n, TILE):
                        shape = min(TILE, a.n - i), min(TILE, b.n - j)
                        p1, p2 = (np.full(shape, np.nan) for _ in range(2))
                        r, c, _, p = _kept(a, b, i, j, max_p, share)
                        p1[r - i, c - j] = p
                        c, r, _, p = _kept(b, a, j, i, max_p, share)
                        p2[r - i, c - j] = p
                        least = np.fmin(p1, p2)
                        hit = least <= (max_p if least_p is None else min(max_p, least_p))
                        if same and i == j:
                            hit = np.triu(hit, 1)
                        r, c = np.nonzero(hit)
                        g, h = x.field("gene").take(pa.array(at[i + r])), y.field("gene").take(pa.array(to[j + c]))
                        p1, p2 = pa.array(p1[r, c], from_pandas=True), pa.array(p2[r, c], from_pandas=True)
                        first = pc.less(g, h)
                        pick = lambda s, t: pc.if_else(first, s, t)  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([pick(g, h), pick(h, g), pick(p1, p2), pick(p2, p1)], names=["u", "v", "p_uv", "p_vu"])

    return _met(packed, packed, "bi <= bj").mapInArrow(run, f"u {kind}, v {kind}, p_uv double, p_vu double")


def undirected(series: DataFrame, max_p: float) -> DataFrame:
    """(u, v, w): the smaller p of both directions of every two genes with an edge, as :func:`edges.undirected` of the edges."""
    return both_ways(series, max_p).select("u", "v", F.least("p_uv", "p_vu").alias("w"))


def redirected(series: DataFrame, max_p: float, least_p: float) -> DataFrame:
    """(gene1, gene2, p_value): edges between two genes of which one direction is at most ``least_p``."""
    both = both_ways(series, max_p, least_p)
    ways = F.array(F.struct(F.col("u").alias("gene1"), F.col("v").alias("gene2"), F.col("p_uv").alias("p_value")), F.struct(F.col("v").alias("gene1"), F.col("u").alias("gene2"), F.col("p_vu").alias("p_value")))
    return both.select(F.explode(ways).alias("x")).select("x.*").where("p_value is not null")


def ego_network(series: DataFrame, gene, max_p: float) -> DataFrame:
    """The edges among a gene and its neighbours; tests of no other pairs are made but the gene's own."""
    own = series.where(F.col("gene") == gene)
    near = granger(own, series, max_p).select(F.col("gene2").alias("gene")).union(granger(series, own, max_p).select("gene1"))
    wanted = written(near.union(series.sparkSession.range(1).select(F.lit(gene).cast(series.schema["gene"].dataType).alias("gene"))).distinct(), "near")
    return granger(series.join(small(wanted), "gene", "left_semi"), max_p=max_p)


def after(series: DataFrame, finished: DataFrame, max_p: float = 1.0) -> DataFrame:
    """What is left of the all-pairs tests after a run over all pairs of the ``finished`` genes, which are never listed."""
    known = small(finished.select("gene").distinct())
    inside, outside = series.join(known, "gene", "left_semi"), series.join(known, "gene", "left_anti")
    return granger(inside, outside, max_p).unionByName(granger(outside, series, max_p))


def _finished(left: DataFrame, right: DataFrame, done: DataFrame, nl: int, nr: int, same_genes: bool) -> DataFrame:
    """(bi, bj): pairs of blocks all of whose pairs of genes are in ``done``."""
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    known = done.join(left.select(F.col("gene").alias("gene1")), "gene1", "left_semi").join(right.select(F.col("gene").alias("gene2")), "gene2", "left_semi")
    have = known.where("gene1 <> gene2") if same_genes else known
    have = have.groupBy(of("gene1", nl).alias("bi"), of("gene2", nr).alias("bj")).agg(F.count(F.lit(1)).alias("have"))
    size = lambda side, name, n: side.groupBy(F.col("blk").alias(name)).agg(F.count(F.lit(1)).alias(n))
    need = have.join(size(left, "bi", "nx"), "bi").join(size(right, "bj", "ny"), "bj")
    if same_genes:
        own = left.select("gene", F.col("blk").alias("bi")).join(right.select("gene", F.col("blk").alias("bj")), "gene").groupBy("bi", "bj").agg(F.count(F.lit(1)).alias("own"))
        need = need.join(own, ["bi", "bj"], "left")
    else:
        need = need.withColumn("own", F.lit(0))
    return need.where(F.col("have") >= F.col("nx") * F.col("ny") - F.coalesce("own", F.lit(0))).select("bi", "bj")


def resumable(spark: SparkSession, series: DataFrame, path: str, max_p: float = 1.0, waves: int = 16) -> tuple[DataFrame, int]:
    """All-pairs tests in ``waves`` by their cause, each a folder of ``path``; the table, and how many waves ran now.

    A wave whose folder is complete is not run again. Another set of genes, threshold or
    number of waves starts afresh, as the folder's manifest tells.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda name: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
    genes = series.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("gene", "series"))).first()
    stamp = json.dumps([*genes, max_p, waves])
    if there("manifest"):
        if spark.read.text(f"{path}/manifest").first()[0] != stamp:
            fs.delete(root, True)
    if not there("manifest/_SUCCESS"):
        spark.createDataFrame([(stamp,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    ran = 0
    for k in range(waves):
        if not there(f"wave={k}/_SUCCESS"):
            causes = series.where(F.pmod(F.xxhash64(F.lit(3), "gene"), F.lit(waves)) == k)
            granger(causes, series, max_p).write.mode("overwrite").parquet(f"{path}/wave={k}")
            ran += 1
    return spark.read.parquet(*[f"{path}/wave={k}" for k in range(waves)]), ran


def probe_pairs(genes: DataFrame, probes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(gene1, gene2) with a probe on at least one side; 2gN - g^2 - g pairs.

    Blocks of probes meet blocks of genes by an equi-join, as in the tests.
    """
    tagged = genes.select("gene").distinct().join(probes.select("gene").distinct().withColumn("probe", F.lit(True)), "gene", "left").withColumn("probe", F.coalesce("probe", F.lit(False)))
    n = n_blocks(tagged.count(), block, genes.sparkSession.sparkContext.defaultParallelism)
    blk, each = F.pmod(F.xxhash64("gene"), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = tagged.where("probe").select(F.col("gene").alias("p"), blk.alias("i")).withColumn("j", each)
    other = tagged.select(F.col("gene").alias("g"), "probe", blk.alias("j")).withColumn("i", each)
    # From a probe to every gene; and from every gene that is no probe to a probe.
    both = F.array(F.struct(F.col("p").alias("gene1"), F.col("g").alias("gene2")), F.struct(F.col("g").alias("gene1"), F.col("p").alias("gene2")))
    pairs = p.join(other, ["i", "j"]).where("p <> g").select(F.explode(F.when(F.col("probe"), F.slice(both, 1, 1)).otherwise(both)).alias("x"))
    return pairs.select("x.*")


def probe_granger(series: DataFrame, probes: DataFrame, max_p: float = 1.0) -> DataFrame:
    """The tests of :func:`probe_pairs`, without forming the pairs."""
    known = probes.select("gene").distinct()
    inside, outside = series.join(known, "gene", "left_semi"), series.join(known, "gene", "left_anti")
    return granger(inside, series, max_p).unionByName(granger(outside, inside, max_p))


def noise_tests(series: DataFrame, noise: DataFrame) -> DataFrame:
    """The tests gene -> noise row of every gene with every row of the noise matrices, equal names or not."""
    return granger(series, noise, same_genes=False)


def noise_summary(tests: DataFrame, thresholds: list[float]) -> DataFrame:
    """(gene, median_p, below_<k>): per gene the median p and the tests strictly below each threshold; null p skipped."""
    below = [F.count_if(F.col("p_value") < t).alias(f"below_{k}") for k, t in enumerate(thresholds)]
    return tests.groupBy(F.col("gene1").alias("gene")).agg(F.median("p_value").alias("median_p"), *below)


def pair_index(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """``pairs`` with ``k`` from 0: the place of (i, j) among the ordered pairs of two of the genes (gene, pos)."""
    n = genes.count()
    side = lambda g, p: genes.select(F.col("gene").alias(g), F.col("pos").cast("long").alias(p))
    placed = pairs.join(side("gene1", "i"), "gene1").join(side("gene2", "j"), "gene2")
    k = F.col("i") * (n - 1) + F.when(F.col("j") < F.col("i"), F.col("j")).otherwise(F.col("j") - 1)
    return placed.withColumn("k", k).select(*pairs.columns, "k")


def fixture_pairs(genes: DataFrame, targets: DataFrame | None = None, first: int = 150) -> DataFrame:
    """(gene1, gene2, lag, p_value): a fixed answer for trial runs, p 0.001 for every pair.

    All ordered pairs of ``genes``; with ``targets`` (gene, pos) instead the pairs in both
    directions with the ``first`` of those, which is the feature here.
    """
    if targets is None:
        pairs = probe_pairs(genes, genes)
    else:
        near = targets.orderBy("pos").limit(first).select("gene")
        out = probe_pairs(genes.select("gene").union(near), genes)
        into = out.join(near.withColumnRenamed("gene", "gene2"), "gene2", "left_semi").join(genes.select(F.col("gene").alias("gene1")), "gene1", "left_semi")
        back = into.select(F.col("gene2").alias("gene1"), F.col("gene1").alias("gene2"))
        pairs = into.select("gene1", "gene2").union(back).distinct()
    return pairs.select("gene1", "gene2", F.lit(1).alias("lag"), F.lit(0.001).alias("p_value"))


def present(genes: DataFrame, matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The listed genes that a matrix has, and those that it lacks."""
    known = matrix.select("gene").distinct()
    return genes.join(known, "gene", "left_semi"), genes.join(known, "gene", "left_anti")


def restrict(matrix: DataFrame, *lists: DataFrame) -> DataFrame:
    """The rows of the listed genes; raises if none of them is there."""
    wanted = lists[0].select("gene")
    for more in lists[1:]:
        wanted = wanted.union(more.select("gene"))
    kept = matrix.join(wanted.distinct(), "gene", "left_semi")
    if kept.isEmpty():
        raise ValueError("none of the listed genes is in the matrix")
    return kept
