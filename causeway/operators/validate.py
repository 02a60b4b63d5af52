"""Checks as single aggregates of flags, and the errors that they amount to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.functions.tables import written


def gene_list(genes: DataFrame, least: int = 1, required=None) -> DataFrame:
    """The list; raises if it has fewer than ``least`` different genes, or not the required one."""
    n, has = genes.agg(F.countDistinct("gene"), F.max((F.col("gene") == required).cast("int"))).first()
    if n < least:
        raise ValueError(f"at least {least} genes are needed, found {n}")
    if required is not None and not has:
        raise ValueError(f"gene {required!r} is missing")
    return genes


def matrix(m: DataFrame) -> DataFrame:
    per = m.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("d"), F.min("value").alias("lo"), F.count_if(F.col("value").isNull()).alias("missing"))
    return per.agg(F.count(F.lit(1)).alias("n_genes"), F.min("d").alias("min_points"), F.count_if(F.col("n") != F.col("d")).alias("duplicated"), F.count_if(F.col("lo") < 0).alias("negative"), F.sum("missing").alias("missing"))


def check_matrix(m: DataFrame, gene, seeds: DataFrame, transform: str = "none", min_points: int = 5, min_seeds: int = 2) -> DataFrame:
    """The matrix (gene, t, value); raises on the first rule that it breaks.

    Rules: not empty, one row per gene and point, no blank genes, enough points, the gene of
    interest and enough seeds there, nothing negative under log1p or sqrt.
    """
    flags = matrix(m).first()
    blank, has = m.agg(F.count_if(F.col("gene").isNull() | (F.trim(F.col("gene").cast("string")) == "")), F.max((F.col("gene") == gene).cast("int"))).first()
    there = seeds.select("gene").distinct().join(m.select("gene").distinct(), "gene", "left_semi").count()
    rules = {
        "the matrix is empty": not flags["n_genes"],
        "it has duplicate genes": flags["duplicated"],
        "it has blank genes": blank,
        f"fewer than {min_points} points": flags["n_genes"] and flags["min_points"] < min_points,
        f"gene {gene!r} is missing": not has,
        f"fewer than {min_seeds} of the listed genes": there < min_seeds,
        f"{transform} of negative values": flags["negative"] and str(transform).lower() in ("log1p", "log+1", "sqrt"),
    }
    return _checked(m, rules)


def _checked(df: DataFrame, rules: dict[str, object]) -> DataFrame:
    for text, broken in rules.items():
        if broken:
            raise ValueError(text)
    return df


def edge_table(e: DataFrame) -> DataFrame:
    p, blank = F.col("p_value"), lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    return e.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("gene1") == F.col("gene2")).alias("self_pairs"), F.count_if(blank("gene1") | blank("gene2")).alias("blank"),
        F.count_if(p.isNull() | F.isnan(p)).alias("missing"), F.count_if(F.abs(p) == float("inf")).alias("infinite"), F.count_if(~F.isnan(p) & ~p.between(0, 1)).alias("out_of_range"),
    )


def check_edges(e: DataFrame, expected: int | None = None) -> DataFrame:
    """The table; raises on another number of rows than expected, blank genes, self pairs or infinite p."""
    f = edge_table(e).first()
    return _checked(e, {f"expected {expected} rows, found {f['n_rows']}": expected is not None and f["n_rows"] != expected, "blank genes": f["blank"], "self pairs": f["self_pairs"], "infinite p-values": f["infinite"]})


def frequency_table(freq: DataFrame, gene) -> DataFrame:
    return freq.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("frequency").between(0, 1)).alias("out_of_range"), F.max((F.col("gene") == gene).cast("int")).alias("has_goi"))


def check_frequency(freq: DataFrame, gene, pos: str | None = None) -> DataFrame:
    """The table; raises on frequencies outside [0, 1], a missing gene of interest or, with ``pos``, rising frequencies."""
    f = frequency_table(freq, gene).first()
    return _checked(freq, {"frequencies outside [0, 1]": f["out_of_range"], f"gene {gene!r} is missing": not f["has_goi"], "frequencies are not sorted": pos is not None and not unsorted(freq, pos).isEmpty()})


def unsorted(freq: DataFrame, pos: str) -> DataFrame:
    """Rows that are larger than the one before, by ``pos``.

    Places are cut into ranges; the last row of each range is compared with the first of the
    next, so no task holds them all.
    """
    parts = written(freq.repartitionByRange(pos).withColumn("__part", F.spark_partition_id()), "ranges")
    before = F.lag("frequency").over(W.partitionBy("__part").orderBy(pos))
    inner = parts.withColumn("before", before)
    ends = parts.groupBy("__part").agg(F.min_by(F.struct(*freq.columns), pos).alias("first"), F.max_by("frequency", pos).alias("last")).orderBy("__part").withColumn("before", F.lag("last").over(W.orderBy("__part")))
    across = ends.where(F.col("first.frequency") > F.col("before")).select("first.*", "before")
    return inner.where(F.col("frequency") > F.col("before")).select(*freq.columns, "before").unionByName(across)


def bundle(edges: DataFrame, nodes: DataFrame, summary: dict, graph_edges: int, graph_nodes: set[str]) -> None:
    """Raises unless the edge table, the node list and the summary of a network agree with its drawing."""
    found = {str(r["gene"]) for r in nodes.select("gene").limit(len(graph_nodes) + 1).collect()}  # bounded by the drawing
    rules = {
        "the edges do not match the graph": edges.count() != graph_edges,
        "the nodes do not match the graph": found != graph_nodes,
        "the summary's nodes do not match the graph": summary.get("nodes") != len(graph_nodes),
        "the summary's edges do not match the graph": summary.get("edges") != graph_edges,
    }
    _checked(edges, rules)


def fits_memory(n_genes: int, budget_bytes: int) -> None:
    """Raises if the n x n counts of four bytes each would take more than three quarters of ``budget_bytes``."""
    need = 4 * n_genes * n_genes
    if need > 0.75 * budget_bytes:
        raise MemoryError(f"{need} bytes are needed for {n_genes} genes, {int(0.75 * budget_bytes)} are free")
