"""Algebra of edge tables (gene1, gene2, p_value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.tables import small


def strict_below(e: DataFrame, p: float) -> DataFrame:
    return e.where(F.col("p_value") < p)


def dual_threshold(e: DataFrame, p: float, genes: list, p_start: float) -> DataFrame:
    """p at most ``p``, or an end among ``genes`` and p at most ``p_start``."""
    touches = F.col("gene1").isin(genes) | F.col("gene2").isin(genes)
    return e.where((F.col("p_value") <= p) | (touches & (F.col("p_value") <= p_start)))


def digraph(e: DataFrame, order: str, second: str | None = None) -> DataFrame:
    """One row per ordered pair; the last by ``order`` wins.

    With ``second``, another column of p-values, both come along, and their mean as ``p_mean``.
    """
    if second is None:
        return e.groupBy("gene1", "gene2").agg(F.max_by("p_value", order).alias("p_value"))
    last = e.groupBy("gene1", "gene2").agg(F.max_by(F.struct("p_value", second), order).alias("x")).select("gene1", "gene2", "x.*")
    return last.withColumn("p_mean", (F.col("p_value") + F.col(second)) / 2)


def first_edges(e: DataFrame, order: str) -> DataFrame:
    """One row per ordered pair; the first by ``order`` wins, with all its columns."""
    rest = [c for c in e.columns if c not in ("gene1", "gene2")]
    return e.groupBy("gene1", "gene2").agg(F.min_by(F.struct(*rest), order).alias("x")).select("gene1", "gene2", "x.*")


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("gene1").alias("gene")).union(e.select("gene2")).distinct()


def degrees(e: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """(gene, in_degree, out_degree, total_degree); genes of ``universe`` without edges have 0."""
    ends = e.select(F.col("gene1").alias("gene"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(e.select(F.col("gene2"), F.lit(1), F.lit(0)))
    if universe is not None:
        ends = ends.unionAll(universe.select("gene", F.lit(0), F.lit(0)))
    d = ends.groupBy("gene").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return d.withColumn("total_degree", F.col("in_degree") + F.col("out_degree"))


def induced(e: DataFrame, genes: DataFrame) -> DataFrame:
    """Edges with both ends in ``genes``."""
    g = genes.select("gene").distinct()
    return e.join(g.withColumnRenamed("gene", "gene1"), "gene1", "left_semi").join(g.withColumnRenamed("gene", "gene2"), "gene2", "left_semi")


def induced_network(e: DataFrame, genes: DataFrame, p: float) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): edges up to ``p`` between the genes, and all the genes (gene, isolated)."""
    inside = induced(e.where(F.col("p_value") <= p), genes)
    linked = nodes(inside).withColumn("linked", F.lit(True))
    return inside, genes.select("gene").distinct().join(linked, "gene", "left").select("gene", F.col("linked").isNull().alias("isolated"))


def neighbours(e: DataFrame, gene) -> DataFrame:
    out = e.where(F.col("gene1") == gene).select(F.col("gene2").alias("gene"))
    into = e.where(F.col("gene2") == gene).select(F.col("gene1").alias("gene"))
    return out.union(into).where(F.col("gene") != gene).distinct()


def ego_network(e: DataFrame, gene) -> DataFrame:
    me = e.sparkSession.createDataFrame([(gene,)], "gene long") if isinstance(gene, int) else e.sparkSession.createDataFrame([(gene,)], "gene string")
    return induced(e, neighbours(e, gene).union(me))


def compare_neighbours(e: DataFrame, a, b) -> DataFrame:
    """(gene, side): shared, only_a or only_b."""
    x, y = neighbours(e, a).withColumn("a", F.lit(True)), neighbours(e, b).withColumn("b", F.lit(True))
    both = x.join(y, "gene", "full")
    return both.select("gene", F.when(F.col("a") & F.col("b"), "shared").when(F.col("a"), "only_a").otherwise("only_b").alias("side"))


def connection(e: DataFrame, genes: DataFrame, mode: str, gene=None) -> DataFrame:
    """Edges with both ends ("both"), or one at least ("any"), in ``genes``, or between them and ``gene`` ("goi")."""
    g = genes.select("gene").distinct()
    if mode == "both":
        return induced(e, g)
    tag = lambda c: g.select(F.col("gene").alias(c), F.lit(True).alias("in_" + c))
    joined = e.join(tag("gene1"), "gene1", "left").join(tag("gene2"), "gene2", "left")
    a, b = F.col("in_gene1").isNotNull(), F.col("in_gene2").isNotNull()
    wanted = {"any": lambda: a | b, "goi": lambda: ((F.col("gene1") == gene) & b) | ((F.col("gene2") == gene) & a)}[mode]()
    return joined.where(wanted).select(e.columns)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of both tables with both p-values; the key holds lag if both tables do."""
    key = ["gene1", "gene2", *(["lag"] if "lag" in a.columns and "lag" in b.columns else [])]
    return a.select(*key, F.col("p_value").alias("p_a")).join(b.select(*key, F.col("p_value").alias("p_b")), key)


def new_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of ``b`` that touch a gene that ``a`` has not."""
    fresh = nodes(b).join(nodes(a), "gene", "left_anti")
    return connection(b, fresh, "any")


def undirected(e: DataFrame, terminals: DataFrame | None = None, hop_penalty: float = 0.0) -> DataFrame:
    """(u, v, w): the smaller p of the two directions, plus ``hop_penalty`` unless both ends are terminals."""
    pairs = e.groupBy(F.least("gene1", "gene2").alias("u"), F.greatest("gene1", "gene2").alias("v")).agg(F.min("p_value").alias("w"))
    return pairs if terminals is None else penalised(pairs, terminals, hop_penalty)


def penalised(pairs: DataFrame, terminals: DataFrame, hop_penalty: float) -> DataFrame:
    """Undirected pairs (u, v, w) with ``hop_penalty`` added to w unless both ends are terminals."""
    t = terminals.select("gene").distinct()
    tag = lambda c: small(t.select(F.col("gene").alias(c), F.lit(True).alias("t" + c)))
    tagged = pairs.join(tag("u"), "u", "left").join(tag("v"), "v", "left")
    return tagged.select("u", "v", (F.col("w") + F.when(F.col("tu") & F.col("tv"), 0.0).otherwise(hop_penalty)).alias("w"))


def redirect(pairs: DataFrame, e: DataFrame) -> DataFrame:
    """The directed edges behind undirected pairs (u, v)."""
    keyed = e.withColumns({"u": F.least("gene1", "gene2"), "v": F.greatest("gene1", "gene2")})
    return keyed.join(pairs.select("u", "v").distinct(), ["u", "v"], "left_semi").select(e.columns)


def candidates(e: DataFrame, terminals: DataFrame | None, p: float, p_max: float) -> DataFrame:
    """Edges between terminals up to ``p``, and all edges up to ``p_max``, each once.

    Without terminals: the edges up to the smaller of both.
    """
    if terminals is None:
        return e.where(F.col("p_value") <= min(p, p_max))
    return induced(e, terminals).where(F.col("p_value") <= p).unionByName(e.where(F.col("p_value") <= p_max)).dropDuplicates()


def list_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(gene, side): genes of two lists, as both, only_a or only_b."""
    x, y = (t.select("gene").distinct().withColumn(n, F.lit(True)) for t, n in ((a, "a"), (b, "b")))
    return x.join(y, "gene", "full").select("gene", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_a").otherwise("only_b").alias("side"))


def pairwise(e: DataFrame, gene, others: DataFrame) -> DataFrame:
    """Edges in both directions between a gene and the listed others, by p (missing last), then source, then target."""
    rest = others.where(F.col("gene") != gene)
    p = F.when(~F.isnan("p_value"), F.col("p_value"))
    return connection(e, rest, "goi", gene).orderBy(p.asc_nulls_last(), "gene1", "gene2")


def coverage(e: DataFrame, attempted: int | None = None) -> DataFrame:
    """(rows_written, pairs_attempted, coverage_fraction, appears_complete) of a table of tests."""
    n = F.count(F.lit(1))
    tried = n if attempted is None else F.lit(attempted).cast("long")
    out = e.agg(n.alias("rows_written"), tried.alias("pairs_attempted"))
    return out.withColumns({
        "coverage_fraction": F.when(F.col("pairs_attempted") > 0, F.col("rows_written") / F.col("pairs_attempted")).otherwise(0.0),
        "appears_complete": F.col("rows_written") == F.col("pairs_attempted"),
    })


def of_communities(e: DataFrame, parts: DataFrame, chosen: list[int]) -> DataFrame:
    """Edges inside the chosen communities (gene, community), taken together."""
    return induced(e, parts.where(F.col("community").isin(chosen)))


def degree_summary(e: DataFrame, p: float | None = None) -> DataFrame:
    """Rows, rows up to ``p``, genes, sources, targets and largest total degree of the selected edges."""
    picked = e if p is None else e.where(F.col("p_value") <= p)
    total = e.agg(F.count(F.lit(1)).alias("n_rows"))
    own = picked.agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("gene1").alias("sources"), F.countDistinct("gene2").alias("targets"))
    deg = degrees(picked).agg(F.count(F.lit(1)).alias("n_genes"), F.max("total_degree").alias("max_degree"))
    return own.join(F.broadcast(deg)).join(F.broadcast(total))


def top_degrees(e: DataFrame, k: int) -> DataFrame:
    return degrees(e).orderBy(F.desc("total_degree"), "gene").limit(k)


def cutoff_sweep(e: DataFrame, freq: DataFrame, cutoffs: list[float], once: bool = False) -> DataFrame:
    """(cutoff, mode, seed_genes, nodes, edges): networks of the genes from each frequency on, by connection mode.

    The edges are read one time and only counts are kept, a row for each gene. ``once``: no
    edge is there twice, so they need not be told apart first.
    """
    cuts = sorted({float(c) for c in cutoffs})
    marks = e.sparkSession.createDataFrame([(c,) for c in cuts], "cutoff double")
    f = lambda c: small(freq.select(F.col("gene").alias(c), F.col("frequency").alias("f_" + c)))
    ends = e.select("gene1", "gene2") if once else e.select("gene1", "gene2").distinct()
    known = ends.join(f("gene1"), "gene1", "left").join(f("gene2"), "gene2", "left").fillna(-1.0, ["f_gene1", "f_gene2"])
    # An edge's ends decide for every cutoff: both from the smaller frequency down, any from the larger.
    # A gene is in a network if one of its edges is; an edge is counted at its source.
    level = {"both": F.least("f_gene1", "f_gene2"), "any": F.greatest("f_gene1", "f_gene2")}
    side = lambda c, own: F.struct(F.col(c).alias("gene"), F.lit(own).alias("own"))
    spread = known.select(*[x.alias(mode) for mode, x in level.items()], F.explode(F.array(side("gene1", 1), side("gene2", 0))).alias("x"))
    place = [(k, c, mode) for k, c in enumerate(cuts) for mode in level]
    per = spread.groupBy("x.gene").agg(*[F.max(m).alias(m) for m in level], *[F.sum(F.when(F.col(mode) >= c, F.col("x.own")).otherwise(0)).alias(f"{mode}_{k}") for k, c, mode in place])
    total = per.agg(*[F.struct(F.count_if(F.col(mode) >= c).alias("nodes"), F.coalesce(F.sum(f"{mode}_{k}"), F.lit(0)).alias("edges")).alias(f"{mode}_{k}") for k, c, mode in place])
    rows = total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cutoff"), F.lit(mode).alias("mode"), F.col(f"{mode}_{k}.nodes").alias("nodes"), F.col(f"{mode}_{k}.edges").alias("edges")) for k, c, mode in place])).alias("x")).select("x.*")
    seeds = freq.join(F.broadcast(marks), F.col("frequency") >= F.col("cutoff")).groupBy("cutoff").agg(F.count(F.lit(1)).alias("seed_genes"))
    return rows.join(seeds, "cutoff", "left").select("cutoff", "mode", "seed_genes", "nodes", "edges").fillna(0, ["seed_genes"])


def growth(expanded: DataFrame, seeds: DataFrame) -> DataFrame:
    """Sizes of an expanded and a seed list, genes of both, new genes, and their shares in %."""
    n = _overlap(expanded, seeds)
    share = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b)).otherwise(0.0)
    return n.select(
        F.col("n_b").alias("n_seeds"), F.col("n_a").alias("n_expanded"), F.col("both").alias("n_overlap"), (F.col("n_a") - F.col("both")).alias("n_new"),
        share("both", "n_a").alias("overlap_percent"), (F.when(F.col("n_a") > 0, 100.0 * (F.col("n_a") - F.col("both")) / F.col("n_a")).otherwise(0.0)).alias("new_percent"), share("both", "n_b").alias("retention_percent"),
    )


def list_overlap(a: DataFrame, b: DataFrame, warn: float = 95.0) -> DataFrame:
    """Sizes, overlap, its share of either list in %, and whether both shares reach ``warn``."""
    n = _overlap(a, b)
    share = lambda c: F.when(F.col(c) > 0, 100.0 * F.col("both") / F.col(c)).otherwise(0.0)
    out = n.select(F.col("n_a").alias("n_left"), F.col("n_b").alias("n_right"), F.col("both").alias("n_overlap"), share("n_a").alias("left_percent"), share("n_b").alias("right_percent"))
    return out.withColumn("alike", (F.col("left_percent") >= warn) & (F.col("right_percent") >= warn))


def _overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    side = list_difference(a, b).groupBy().agg(F.count_if(F.col("side") == "both").alias("both"), F.count_if(F.col("side") == "only_a").alias("a"), F.count_if(F.col("side") == "only_b").alias("b"))
    return side.select("both", (F.col("both") + F.col("a")).alias("n_a"), (F.col("both") + F.col("b")).alias("n_b"))


def pair_count_audit(tests: DataFrame, n_genes: int) -> int:
    """The number of rows of an all-pairs table; raises if it isn't n(n - 1)."""
    found, expected = tests.count(), n_genes * max(0, n_genes - 1)
    if found != expected:
        raise ValueError(f"expected {expected} pairs of {n_genes} genes, found {found}")
    return found
