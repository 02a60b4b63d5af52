"""Ordinary least squares of genes on time and an anchor gene, in both directions.

Samples are the same for all genes, so time is taken out of every series by one projection,
and what is left of predictor and target gives the last coefficient (Frisch and Waugh). Series
travel as arrays; a batch of genes is a handful of matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.stats import f_tail, f_tail_numpy

NUMBERS = [
    "linear_time_r_squared", "linear_time_sse", "quadratic_time_r_squared", "quadratic_time_sse", "quadratic_term_coefficient", "quadratic_term_p_value",
    "final_model_r_squared", "final_model_sse", "predictor_coefficient", "predictor_p_value", "predictor_t_statistic", "adjusted_r_squared", "residual_degrees_of_freedom",
]
SINGULAR = 1e-12


def linear_time(m: DataFrame, points: int) -> DataFrame:
    """(gene, slope, intercept, r2, p_value) of value on t for genes with ``points`` rows."""
    a = m.groupBy("gene").agg(
        F.count(F.lit(1)).alias("n"), F.avg("t").alias("mt"), F.avg("value").alias("mv"),
        F.covar_pop("t", "value").alias("ctv"), F.var_pop("t").alias("vt"), F.var_pop("value").alias("vv"),
    ).where(F.col("n") == points)
    slope = F.col("ctv") / F.col("vt")
    r2 = F.col("ctv") * F.col("ctv") / (F.col("vt") * F.nullif(F.col("vv"), F.lit(0.0)))
    f = r2 / F.nullif(1 - r2, F.lit(0.0)) * (points - 2)
    return a.select("gene", slope.alias("slope"), (F.col("mv") - slope * F.col("mt")).alias("intercept"), r2.alias("r2"), f_tail(f, points - 2).alias("p_value"))


def aligned(m: DataFrame, anchor) -> tuple[DataFrame, np.ndarray, np.ndarray, list]:
    """(gene, samples, series) in sample order, the anchor's series, the times, and the names of the samples.

    Input: (gene, t, rep, value). The anchor's samples are the reference; raises if it is absent.
    """
    one = m.where(F.col("gene") == anchor).select("t", "rep", "value").orderBy("t", "rep").collect()  # one gene
    if not one:
        raise ValueError(f"anchor gene {anchor!r} is absent")
    per = m.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("t", "rep", "value"))).alias("s"))
    rows = per.select("gene", F.transform("s", lambda x: F.concat_ws("|", x["t"].cast("string"), x["rep"].cast("string"))).alias("samples"), F.transform("s", lambda x: x["value"].cast("double")).alias("series"))
    return rows, np.array([np.nan if r["value"] is None else r["value"] for r in one], float), np.array([r["t"] for r in one], float), [f"{r['t']}|{r['rep']}" for r in one]


def _time_fit(y: np.ndarray, t: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """Linear and quadratic fits on time of every row of ``y``, and which of them is chosen."""
    n = len(t)
    one, c = np.ones(n) / np.sqrt(n), t - t.mean()
    c /= np.sqrt(c @ c)
    q = t * t
    q = q - (q @ one) * one - (q @ c) * c
    size = np.sqrt(q @ q)
    q = q / size
    centred = y - y.mean(1, keepdims=True)
    total, by_c, by_q = (centred**2).sum(1), centred @ c, centred @ q
    sse1 = np.maximum(total - by_c**2, 0)
    sse2 = np.maximum(sse1 - by_q**2, 0)
    with np.errstate(all="ignore"):
        p = f_tail_numpy(by_q**2 / (sse2 / (n - 3)), n - 3)
        fit = {"r1": 1 - sse1 / total, "sse1": sse1, "r2": 1 - sse2 / total, "sse2": sse2, "b2": by_q / size, "p2": p, "total": total}
    fit["quadratic"] = np.isfinite(p) & (p < threshold)
    rest = centred - np.outer(by_c, c)
    fit["rest"] = np.where(fit["quadratic"][:, None], rest - np.outer(by_q, q), rest)
    fit["basis"] = (c, q)
    return fit


def _final(x: np.ndarray, fit: dict, rows: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """The model of time and predictor ``x`` for the targets ``rows`` of ``fit``, row by row."""
    c, q = fit["basis"]
    quad = fit["quadratic"][rows]
    xc = x - x.mean(1, keepdims=True)
    rx = xc - np.outer(xc @ c, c)
    rx = np.where(quad[:, None], rx - np.outer(rx @ q, q), rx)
    ry = fit["rest"][rows]
    sxx, sxy, syy = (rx * rx).sum(1), (rx * ry).sum(1), (ry * ry).sum(1)
    df = n - 3 - quad.astype(int)
    total = fit["total"][rows]
    with np.errstate(all="ignore"):
        b = sxy / sxx
        sse = np.maximum(syy - b * sxy, 0)
        t = b / np.sqrt(sse / df / sxx)
        p = np.where(quad, f_tail_numpy(t * t, n - 4), f_tail_numpy(t * t, n - 3))
        r2 = 1 - sse / total
        out = {"r2": r2, "sse": sse, "b": b, "p": p, "t": t, "adj": 1 - (1 - r2) * (n - 1) / df, "df": df.astype(float)}
    out["bad"] = ~(sxx > SINGULAR * np.maximum((xc * xc).sum(1), 1e-300)) | ~(total > 0)
    return out


def both_directions(m: DataFrame, anchor, threshold: float = 0.05, expected: int | None = None, per_time: int | None = None) -> DataFrame:
    """Two rows for every gene but the anchor: gene -> anchor and anchor -> gene.

    Input: (gene, t, rep, value), one row per sample. A target's time model is quadratic if
    the p of its square term is below ``threshold``, else linear; the predictor is added to
    it. A relation that can't be fitted is a row too, with status "failed" and its error:
    samples that differ from the anchor's, another number than ``expected`` or than
    ``per_time`` for each time, missing or infinite values, or a predictor that time explains.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    rows, own, t, names = aligned(m, anchor)
    kind = m.schema["gene"].dataType.simpleString()
    n, problem = len(t), None
    if expected is not None and n != expected:
        problem = f"expected {expected} observations, found {n}"
    elif per_time is not None and any(np.unique(t, return_counts=True)[1] != per_time):
        problem = f"expected {per_time} observations for each time"
    elif n < 5 or len(np.unique(t)) < 3:
        problem = "too few observations"
    elif not np.isfinite(own).all():
        problem = "the anchor has missing or non-finite values"
    texts = ["selected_time_model", "status", "error"]

    def fit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = [("target", None), ("predictor", None), ("n_observations", pa.int32()), *[(x, pa.string()) for x in texts], *[(x, pa.float64()) for x in NUMBERS]]
        for batch in batches:
            genes, samples, series = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            why = [problem or ("sample names are not aligned with the anchor's" if s != names else None) for s in samples]
            values = [np.array([np.nan if v is None else v for v in x], float) for x in series]
            why = [w or ("missing or non-finite values" if not np.isfinite(v).all() else None) for w, v in zip(why, values, strict=True)]
            good = np.array([w is None for w in why], bool)
            columns: dict[str, list] = {name: [] for name, _ in schema}
            anchors = pa.array([anchor] * len(genes), genes.type)
            y = np.stack([v for v, ok in zip(values, good, strict=True) if ok]) if good.any() else None
            for to_anchor in (True, False):
                columns["target"].append(anchors if to_anchor else genes)
                columns["predictor"].append(genes if to_anchor else anchors)
                number = {c: np.full(len(genes), np.nan) for c in NUMBERS}
                model, errors = np.full(len(genes), "", object), list(why)
                if y is not None:
                    target = own[None, :] if to_anchor else y
                    time = _time_fit(target, t, threshold)
                    at = np.zeros(len(y), int) if to_anchor else np.arange(len(y))
                    end = _final(y if to_anchor else np.repeat(own[None, :], len(y), 0), time, at, n)
                    made = [time["r1"][at], time["sse1"][at], time["r2"][at], time["sse2"][at], time["b2"][at], time["p2"][at], end["r2"], end["sse"], end["b"], end["p"], end["t"], end["adj"], end["df"]]
                    fine = ~end["bad"]
                    places = np.flatnonzero(good)
                    for c, v in zip(NUMBERS, made, strict=True):
                        number[c][places[fine]] = v[fine]
                    model[places[fine]] = np.where(time["quadratic"][at][fine], "quadratic", "linear")
                    for i in places[~fine]:
                        errors[i] = "singular fit"
                ok = [e is None for e in errors]
                columns["n_observations"].append(pa.array([n if k else 0 for k in ok], pa.int32()))
                for name, v in (("selected_time_model", model.tolist()), ("status", ["ok" if k else "failed" for k in ok]), ("error", [e or "" for e in errors])):
                    columns[name].append(pa.array(v, pa.string()))
                for c in NUMBERS:
                    columns[c].append(pa.array(number[c], from_pandas=True))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(v) for v in columns.values()], names=list(columns))

    out = f"target {kind}, predictor {kind}, n_observations int, " + ", ".join(f"{x} string" for x in texts) + ", " + ", ".join(f"{x} double" for x in NUMBERS)
    return rows.where(F.col("gene") != anchor).mapInArrow(fit, out)
