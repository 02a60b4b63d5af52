"""Quantiles, rankings and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def number(c: str) -> Column:
    """NaN counts as missing, as quantiles and medians skip it."""
    return F.when(F.isnan(c), None).otherwise(F.col(c))


def lower_quantile(e: DataFrame, q: float, col: str = "p_value") -> DataFrame:
    """(threshold): linear quantile of one column, exact; NaN and null skipped, null without values."""
    if not 0 < q <= 1:
        raise ValueError("a quantile must be in (0, 1]")
    return e.sparkSession.createDataFrame([(exact_quantiles(e, col, [q])[0],)], "threshold double")


def goi_relationships(e: DataFrame, gene, quantiles: list[float]) -> DataFrame:
    """Per quantile: threshold, selected edges, those out of and into a gene, its distinct partners, its share in %."""
    qs = sorted({float(q) for q in quantiles})
    if not all(0 < q <= 1 for q in qs):
        raise ValueError("quantiles must be in (0, 1]")
    marks = e.sparkSession.createDataFrame(list(zip(qs, exact_quantiles(e, "p_value", qs), strict=True)), "q double, threshold double")
    out, into = F.col("gene1") == gene, F.col("gene2") == gene
    related = F.when(out, F.col("gene2")).when(into, F.col("gene1"))
    # A handful of thresholds beside all edges, and only edges up to the largest count.
    hit = e.join(F.broadcast(marks), F.col("p_value") <= F.col("threshold"))
    counts = hit.groupBy("q").agg(F.count(F.lit(1)).alias("selected"), F.count_if(out).alias("outgoing"), F.count_if(into).alias("incoming"), F.countDistinct(related).alias("related"))
    none = {c: 0 for c in ("selected", "outgoing", "incoming", "related")}
    share = F.when(F.col("selected") > 0, 100.0 * (F.col("outgoing") + F.col("incoming")) / F.col("selected")).otherwise(0.0)
    return marks.join(counts, "q", "left").fillna(none).withColumn("share", share)


def rank_order() -> list[Column]:
    """By falling frequency, then name whatever its case, then name."""
    return [F.desc("frequency"), F.lower(F.col("gene").cast("string")), F.asc("gene")]


def share_size(n: int, percent: float, rounding: str = "ceil") -> int:
    """How many of ``n`` a share of ``percent`` % holds, by one of the roundings in use; one at least for the first three."""
    raw = n * percent / 100
    if rounding in ("ceil", "floor", "even"):
        return max(1, {"ceil": -int(-raw // 1), "floor": int(raw // 1), "even": round(raw)}[rounding])
    return {"floor_plus_one": int(raw // 1) + 1, "floor_of_next": int((n + 1) * percent / 100 // 1), "int": int(raw)}[rounding]


def _with_goi(selected: DataFrame, freq: DataFrame, gene, fold: bool = False) -> DataFrame:
    """``selected``, and the gene of interest in front of it: with its own frequency, or null if the table lacks it."""
    if gene is None:
        return selected
    same = (F.upper(F.col("gene").cast("string")) == str(gene).upper()) if fold else F.col("gene") == gene
    if not selected.where(same).isEmpty():
        return selected
    own = freq.where(same).limit(1)
    if own.isEmpty():
        own = freq.sparkSession.createDataFrame([(gene, None)], freq.select("gene", "frequency").schema)
    return own.select("gene", "frequency").unionByName(selected)


def top_percent(freq: DataFrame, percent: float, gene=None, rounding: str = "ceil") -> DataFrame:
    """(gene, frequency): the top share of a frequency table; a gene of interest is put in if it is missing there.

    A gene that the table does not have at all comes with a null frequency.
    """
    top = freq.select("gene", "frequency").orderBy(*rank_order()).limit(share_size(freq.count(), percent, rounding))
    return _with_goi(top, freq, gene).dropDuplicates(["gene"])


def min_frequency(freq: DataFrame, least: float, gene=None) -> DataFrame:
    """(gene, frequency): genes from ``least`` on, and the gene of interest as in :func:`top_percent`."""
    return _with_goi(freq.select("gene", "frequency").where(F.col("frequency") >= least), freq, gene).dropDuplicates(["gene"])


def top_consensus(freq: DataFrame, fraction: float, gene) -> DataFrame:
    """The top share by :func:`top_percent`, but the gene of interest, and genes among each other, meet whatever their case."""
    if not 0 < fraction <= 1:
        raise ValueError("a fraction must be in (0, 1]")
    top = freq.select("gene", "frequency").orderBy(*rank_order()).limit(share_size(freq.count(), 100 * fraction))
    best = F.min_by(F.struct("gene", "frequency"), F.struct((-F.col("frequency")).alias("f"), F.lower(F.col("gene").cast("string")).alias("l"), "gene"))
    return _with_goi(top, freq, gene, fold=True).groupBy(F.upper(F.col("gene").cast("string")).alias("u")).agg(best.alias("b")).select("b.*")


def legacy_selection(freq: DataFrame, min_freq: float | None = None, percent: float | None = None, top_n: int | None = None) -> DataFrame:
    """Genes from a frequency on, then a share of those rounded down (one at least) or a number of them."""
    kept = freq if min_freq is None else freq.where(F.col("frequency") >= min_freq)
    if percent is not None:
        return kept.orderBy(*rank_order()).limit(share_size(kept.count(), percent, "floor"))
    return kept if top_n is None else kept.orderBy(*rank_order()).limit(top_n)


def head(freq: DataFrame, n: int) -> DataFrame:
    """The first ``n`` by priority."""
    return freq.orderBy(*rank_order()).limit(n)


def na_last(df: DataFrame, *cols: str) -> DataFrame:
    """Sorted by several columns, descending where a name begins with "-"; null and NaN come last either way."""
    order = []
    for c in cols:
        name = c.lstrip("-")
        value = number(name) if df.schema[name].dataType.typeName() in ("double", "float") else F.col(name)
        order.append(value.desc_nulls_last() if c.startswith("-") else value.asc_nulls_last())
    return df.orderBy(*order)


def annotate_new(ranked: DataFrame, known: DataFrame, top: int | None = None) -> DataFrame:
    """``is_new``: 1 for genes that a known list has not, whatever their case; of the first ``top`` if given."""
    rows = ranked if top is None else head(ranked, top)
    k = known.select(F.lower(F.col("gene").cast("string")).alias("k")).distinct()
    joined = rows.withColumn("k", F.lower(F.col("gene").cast("string"))).join(k.withColumn("hit", F.lit(1)), "k", "left")
    return joined.withColumn("is_new", F.when(F.col("hit").isNull(), 1).otherwise(0)).drop("k", "hit")


def new_counts(annotated: DataFrame) -> DataFrame:
    """(n, n_new, n_known) of an annotated list."""
    return annotated.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_new") == 1).alias("n_new"), F.count_if(F.col("is_new") == 0).alias("n_known"))


def frequency_metrics(freq: DataFrame, gene=None) -> DataFrame:
    """Count, maximum, mean, size and mean of the top 5 % (rounded half to even), a gene's own frequency."""
    n = freq.count()
    top_n = max(1, round(n * 0.05)) if n else 0
    top = freq.orderBy(F.desc("frequency")).limit(top_n).agg(F.avg("frequency").alias("top5_mean"))
    own = F.max(F.when(F.upper(F.col("gene").cast("string")) == str(gene).upper(), F.col("frequency")))
    all_ = freq.agg(F.count(F.lit(1)).alias("n"), F.max("frequency").alias("max_f"), F.avg("frequency").alias("mean_f"), own.alias("goi_f"))
    return all_.join(F.broadcast(top)).withColumn("top5_n", F.lit(top_n).cast("long"))


def relative_difference(p: Column, c: Column, denominator: str = "previous", eps: float = 1e-9) -> Column:
    """|p - c| over the previous value, the larger or the mean of both; never over less than ``eps``."""
    den = {"previous": p, "max": F.greatest(p, c), "mean": (p + c) / 2}
    if denominator not in den:
        raise ValueError(f"no such denominator: {denominator}")
    return F.abs(p - c) / F.greatest(den[denominator], F.lit(eps))


def _paired(prev: DataFrame, curr: DataFrame, rows: str, fold: bool) -> DataFrame:
    """(gene, p, c, in_prev, in_curr): both tables side by side; an absent frequency is 0."""
    if rows not in ("inter", "union"):
        raise ValueError(f"rows must be inter or union: {rows}")
    gene = F.lower(F.trim("gene")) if fold else F.col("gene")
    side = lambda f, v, flag: f.select(gene.alias("gene"), F.col("frequency").alias(v), F.lit(1).alias(flag))
    both = side(prev, "p", "in_prev").join(side(curr, "c", "in_curr"), "gene", "inner" if rows == "inter" else "full")
    return both.fillna({"p": 0.0, "c": 0.0, "in_prev": 0, "in_curr": 0})


def overlap_size(prev: DataFrame, curr: DataFrame, top: float = 0.05, top_k: int | None = None) -> int:
    """K of the top-K overlap: given, or a share of the shorter table, rounded half to even."""
    return top_k if top_k is not None else max(1, round(top * min(prev.count(), curr.count())))


def top_overlap(prev: DataFrame, curr: DataFrame, k: int, fold: bool = False) -> DataFrame:
    """(overlap): % of the top ``k`` genes that both have; ties go to the smaller gene."""
    gene = F.lower(F.trim("gene")) if fold else F.col("gene")
    best = lambda f: f.select(gene.alias("gene"), "frequency").orderBy(F.desc("frequency"), "gene").limit(k).select("gene")
    return best(prev).join(best(curr), "gene").agg((100.0 * F.count(F.lit(1)) / k).alias("overlap"))


def stability(prev: DataFrame, curr: DataFrame, q: float = 0.9, top: float = 0.05, eps: float = 1e-9, denominator: str = "previous", rows: str = "inter", fold: bool = False, top_k: int | None = None) -> DataFrame:
    """(rel_change, n_common, overlap): quantile of relative differences, genes compared, overlap of the top in %."""
    both = _paired(prev, curr, rows, fold).select(relative_difference(F.col("p"), F.col("c"), denominator, eps).alias("d"))
    change = both.agg(F.percentile("d", min(max(q, 0.0), 1.0)).alias("rel_change"), F.count(F.lit(1)).alias("n_common"))
    return change.join(F.broadcast(top_overlap(prev, curr, overlap_size(prev, curr, top, top_k), fold)))


def frequency_diff(prev: DataFrame, curr: DataFrame, denominator: str = "previous", rows: str = "union", fold: bool = False, eps: float = 1e-9) -> DataFrame:
    """(gene, prev_f, curr_f, abs_diff, rel_diff, in_prev, in_curr); an absent frequency counts as 0."""
    both = _paired(prev, curr, rows, fold)
    p, c = F.col("p"), F.col("c")
    return both.select("gene", p.alias("prev_f"), c.alias("curr_f"), F.abs(p - c).alias("abs_diff"), relative_difference(p, c, denominator, eps).alias("rel_diff"), "in_prev", "in_curr")


def sorted_diff(diff: DataFrame, by: str = "rel_diff", descending: bool = True) -> DataFrame:
    if by not in ("rel_diff", "abs_diff", "gene"):
        raise ValueError(f"cannot sort by {by}")
    return diff.orderBy(F.desc(by) if descending else F.asc(by), "gene")


def edge_parity(a: DataFrame, b: DataFrame, tol: float, p: float, order: str | None = None) -> DataFrame:
    """Rows of both, shared, missing and extra keys, p-values that differ, their largest difference, flips of significance.

    Keys are gene1, gene2 and, if both tables have it, lag; of repeated keys the last by
    ``order`` counts. A p that only one table has differs, and flips.
    """
    key = ["gene1", "gene2", *(["lag"] if "lag" in a.columns and "lag" in b.columns else [])]
    last = lambda t: F.max_by(F.struct("p_value"), order) if order else F.max(F.struct("p_value"))
    side = lambda t, v, flag: t.groupBy(*key).agg(last(t).alias("x")).select(*key, F.nanvl("x.p_value", F.lit(None).cast("double")).alias(v), F.lit(True).alias(flag))
    j = side(a, "pa", "ina").join(side(b, "pb", "inb"), key, "full")
    both, diff = F.col("ina") & F.col("inb"), F.abs(F.col("pa") - F.col("pb"))
    one = both & (F.col("pa").isNull() != F.col("pb").isNull())
    flip = both & ((F.col("pa") <= p) != (F.col("pb") <= p))
    return j.agg(
        F.count_if("ina").alias("n_reference"), F.count_if("inb").alias("n_candidate"),
        F.count_if(both).alias("shared"), F.count_if(F.col("inb").isNull()).alias("missing"), F.count_if(F.col("ina").isNull()).alias("extra"),
        F.count_if(one | (both & (diff > tol))).alias("p_differs"), F.coalesce(F.max(F.when(both, diff)), F.lit(0.0)).alias("max_diff"), F.count_if(one | flip).alias("flips"),
    )


def histogram(e: DataFrame, bins: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin, n): half-open bins on [low, high], whose upper end belongs to the last; what lies outside is left out."""
    inside = e.where(F.col("p_value").between(low, high))
    b = F.least(F.floor((F.col("p_value") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return inside.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def drill_down(e: DataFrame, bin_: int, bins: int = 20, finer: int = 20) -> DataFrame:
    """The histogram of one bin of another, in ``finer`` bins."""
    low, high = bin_ / bins, (bin_ + 1) / bins
    part = e if bin_ == bins - 1 else e.where(F.col("p_value") < high)
    return histogram(part, finer, low, high)


def log_histogram(e: DataFrame, bins: int = 60) -> DataFrame:
    """(bin, low, n): -log10 of p in equal bins from its least to its largest value; p below 1e-300 counts as that."""
    x = e.select((-F.log10(F.greatest(F.col("p_value"), F.lit(1e-300)))).alias("x")).where("x is not null and not isnan(x)")
    span = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    return x.join(F.broadcast(span)).groupBy(b.alias("bin"), (F.col("lo") + b * width).alias("low")).agg(F.count(F.lit(1)).alias("n"))
