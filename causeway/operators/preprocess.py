"""Matrix preparation on long frames (gene, t, [rep,] value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log1p(m: DataFrame) -> DataFrame:
    return m.withColumn("value", F.log1p("value"))


def square_root(m: DataFrame) -> DataFrame:
    return m.withColumn("value", F.sqrt("value"))


def zscore(m: DataFrame) -> DataFrame:
    """Per column; a constant column and nulls become 0. One aggregate per column, joined back."""
    col = m.groupBy("t").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    z = (F.col("value") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0))
    return m.join(col, "t").select("gene", "t", F.coalesce(z, F.lit(0.0)).alias("value"))


def size_factors(m: DataFrame, sample: list[str]) -> DataFrame:
    """Median of ratios to the geometric mean over non-zero values; 0 and non-finite count as 1."""
    mean = m.groupBy("gene").agg(F.exp(F.avg(F.ln(F.nullif(F.col("value"), F.lit(0.0))))).alias("gm"))
    ratio = m.join(mean, "gene").where("gm is not null").select(*sample, (F.col("value") / F.col("gm")).alias("ratio"))
    factor = ratio.groupBy(*sample).agg(F.percentile("ratio", 0.5).alias("factor"))
    return factor.withColumn("factor", F.when(F.col("factor") > 0, F.col("factor")).otherwise(1.0))


def deseq(m: DataFrame, sample: list[str]) -> DataFrame:
    return m.join(size_factors(m, sample), sample).withColumn("value", F.col("value") / F.col("factor")).drop("factor")


def drop_all_zero(m: DataFrame) -> DataFrame:
    keep = m.groupBy("gene").agg(F.bool_or(F.col("value") != 0).alias("any")).where("any")
    return m.join(keep.select("gene"), "gene", "left_semi")


def fill_grid(m: DataFrame, genes: DataFrame, points: DataFrame) -> DataFrame:
    """Every gene at every point, absent values 0. ``points`` is the short list of timepoints."""
    steps = points.agg(F.sort_array(F.collect_set("t")).alias("ts"))
    grid = genes.select("gene").distinct().join(F.broadcast(steps)).select("gene", F.explode("ts").alias("t"))
    return grid.join(m.groupBy("gene", "t").agg(F.sum("value").alias("value")), ["gene", "t"], "left").select("gene", "t", F.coalesce("value", F.lit(0.0)).alias("value"))


def robust_mean(values: Column) -> Column:
    """Weighted mean with weights 1 / (1 + distance to the median), over a sorted array."""
    n = F.size(values)
    mid = lambda v: (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2
    w = F.transform(values, lambda x: F.struct((1 / (1 + F.abs(x - mid(values)))).alias("w"), x.alias("x")))
    total = F.aggregate(w, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, e: F.struct((s["a"] + e["w"] * e["x"]).alias("a"), (s["b"] + e["w"]).alias("b")))
    return total["a"] / total["b"]


def aggregate_replicates(m: DataFrame, how: str = "mean", keys: tuple[str, ...] = ("gene", "t")) -> DataFrame:
    """Mean, median or robust mean of the replicates of a cell, in one shuffle."""
    if how == "mean":
        value = F.avg("value")
    elif how == "median":
        value = F.median("value")
    elif how == "robust":
        return m.groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("v")).select(*keys, robust_mean(F.col("v")).alias("value"))
    else:
        raise ValueError(how)
    return m.groupBy(*keys).agg(value.alias("value"))


def min_max(m: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rescaled to a range; equal values become its low end."""
    span = m.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    part = (F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return m.join(F.broadcast(span)).select(*m.columns[:-1], (F.lit(low) + F.coalesce(part, F.lit(0.0)) * (high - low)).alias("value"))


def to_series(m: DataFrame) -> DataFrame:
    """(gene, series) in the order of t, for the pair kernels."""
    return m.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("s")).select("gene", F.transform("s", lambda x: x["value"]).alias("series"))


def to_number(m: DataFrame, col: str = "value") -> DataFrame:
    """Text cells as numbers; what is none, NaN included, is 0."""
    v = F.col(col).try_cast("double")
    return m.withColumn(col, F.coalesce(F.when(~F.isnan(v), v), F.lit(0.0)))


def strict_number(m: DataFrame, col: str = "value") -> DataFrame:
    """Text cells as numbers; NaN and blank cells become null, any other text fails the job."""
    text = F.trim(F.col(col).cast("string"))
    v = F.when((text == "") | F.lower(text).isin("nan", "na", "null"), None).otherwise(text).cast("double")
    return m.withColumn(col, v)


def natural_log(m: DataFrame) -> DataFrame:
    """ln of the values; 0 and below become null."""
    return m.withColumn("value", F.ln("value"))


def minus_log10(e: DataFrame, col: str = "p_value", out: str = "score") -> DataFrame:
    """-log10 of a p-value, which counts as 1e-300 at least."""
    return e.withColumn(out, -F.log10(F.greatest(F.col(col), F.lit(1e-300))))


def zscore_samples(m: DataFrame, sample: list[str]) -> DataFrame:
    """:func:`zscore` per sample, whatever columns name one."""
    col = m.groupBy(*sample).agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    z = (F.col("value") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0))
    return m.join(col, sample).withColumn("value", F.coalesce(z, F.lit(0.0))).select(m.columns)


#: Names that options go by; fixed values.
NORMALISE = {"false": "none", "null": "none", "none": "none", "no": "none", "deseq": "deseq", "deseq2": "deseq", "size_factors": "deseq", "zscore": "zscore", "z-score": "zscore"}
TRANSFORM = {"false": "none", "null": "none", "none": "none", "no": "none", "log+1": "log1p", "log1p": "log1p", "sqrt": "sqrt"}
AGGREGATE = {"mean": "mean", "median": "median", "robust": "robust"}


def option(value, names: dict[str, str]) -> str:
    """The one name of an option; None and False mean none."""
    name = "none" if value in (None, False) else str(value).lower()
    if name not in names:
        raise ValueError(f"no such option: {value}")
    return names[name]


def normalise_and_transform(m: DataFrame, normalise=None, transform=None, sample: tuple[str, ...] = ("t",)) -> DataFrame:
    """Normalisation per sample, then the transform of every value.

    log1p and sqrt of negative values are refused.
    """
    how, then = option(normalise, NORMALISE), option(transform, TRANSFORM)
    if how == "deseq":
        m = deseq(m, list(sample)).select(m.columns)
    elif how == "zscore":
        m = zscore_samples(m, list(sample))
    if then != "none" and not m.where(F.col("value") < 0).isEmpty():
        raise ValueError(f"{then} cannot be applied to negative values")
    return {"none": lambda x: x, "log1p": log1p, "sqrt": square_root}[then](m)


def prepare(m: DataFrame, normalise=None, transform=None, aggregation: str = "mean", replicates: bool = True) -> tuple[DataFrame, DataFrame]:
    """(summarised, replicates): (gene, t, value), and the prepared input (gene, t, [rep,] value).

    With replicates, size factors and transforms come before their aggregation and z-scores
    after it. Without, all come first, and rows of one gene are then aggregated.
    """
    if aggregation not in AGGREGATE:
        raise ValueError(f"no such aggregation: {aggregation}")
    how = option(normalise, NORMALISE)
    if not replicates:
        ready = normalise_and_transform(m, how, transform)
        return aggregate_replicates(ready, aggregation), ready
    ready = normalise_and_transform(drop_all_zero(m), "deseq" if how == "deseq" else "none", transform, ("t", "rep"))
    summarised = aggregate_replicates(ready, aggregation)
    return (zscore(summarised) if how == "zscore" else summarised), ready


def collapse_duplicates(m: DataFrame, how: str = "mean") -> DataFrame:
    """(pos, gene, t, value): one row per gene and column; ``pos`` is the gene's first place in the input's ``pos``."""
    first = m.groupBy("gene").agg(F.min("pos").alias("pos"))
    return aggregate_replicates(m, how).join(first, "gene").select("pos", "gene", "t", "value")


def day_replicates(m: DataFrame, kind: str) -> DataFrame:
    """(gene, t, rep, value) of the sample columns (gene, label, value) that are replicates of a day.

    ``kind``: "wild_type" takes labels with WT and a day as d<number>_; "runs" takes labels
    with SRR and a day as "Day <number>". Other columns are left out.
    """
    wanted, day = {"wild_type": ("WT", r"d(\d+)_"), "runs": ("SRR", r"Day (\d+)")}[kind]
    found = F.regexp_extract("label", day, 1)
    return m.where(F.col("label").contains(wanted) & (found != "")).select("gene", found.cast("int").alias("t"), F.col("label").alias("rep"), "value")


def replicates_per_day(m: DataFrame, expected: int = 7) -> DataFrame:
    """(t, n, ok): replicates of every day, and whether there are as many as expected."""
    n = F.countDistinct("rep")
    return m.groupBy("t").agg(n.alias("n")).withColumn("ok", F.col("n") == expected)


def traces(summarised: DataFrame, replicates: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pos, gene, t, rep, value): the summarised and replicate rows of the genes (pos, gene); absent ones are left out."""
    both = summarised.select("gene", "t", F.lit(None).cast("string").alias("rep"), "value").unionByName(replicates.select("gene", "t", F.col("rep").cast("string").alias("rep"), "value"))
    return both.join(wanted.groupBy("gene").agg(F.min("pos").alias("pos")), "gene").select("pos", "gene", "t", "rep", "value")


def unpivot_degrees(d: DataFrame, top: int) -> DataFrame:
    """(gene, kind, degree): the in, out and total degrees of the ``top`` genes of most edges, in long form."""
    first = d.orderBy(F.desc("total_degree"), "gene").limit(top)
    return first.unpivot("gene", ["in_degree", "out_degree", "total_degree"], "kind", "degree")
