"""Exact linear quantiles of columns of any length."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to this many values one task sorts a column; beyond, counts by bin tell where to look.
ONE_TASK = 2_000_000
BINS = 4096


def exact_quantiles(df: DataFrame, col: str, qs: list[float]) -> list[float | None]:
    """Linear quantiles as by sorting all values; null and NaN are skipped, q is cut to [0, 1]; None without values."""
    v = df.select(F.col(col).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = v.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(qs)
    qs = [min(max(q, 0.0), 1.0) for q in qs]
    if n <= ONE_TASK:
        return list(v.agg(F.percentile("v", F.array(*map(F.lit, qs)))).first()[0])
    ranks = sorted({r for q in qs for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})
    at = _ranked(v, low, high, 0, ranks)
    out = []
    for q in qs:
        place = q * (n - 1)
        lo, hi = at[math.floor(place)], at[math.ceil(place)]
        out.append(lo + (hi - lo) * (place - math.floor(place)))
    return out


def _ranked(v: DataFrame, low: float, high: float, before: int, ranks: list[int]) -> dict[int, float]:
    """Values by their rank among all; ``v`` holds those from ``low`` to ``high``, ``before`` are smaller."""
    if low == high:
        return dict.fromkeys(ranks, low)
    width = (high - low) / BINS
    which = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
    binned = v.withColumn("b", which)
    bins = binned.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()  # at most BINS rows
    found: dict[int, float] = {}
    for row in bins:
        own = [r for r in ranks if before <= r < before + row["n"]]
        if own:
            part = binned.where(F.col("b") == row["b"]).select("v")
            if row["n"] <= ONE_TASK and row["lo"] < row["hi"]:
                places = [(r - before) / max(1, row["n"] - 1) for r in own]
                found |= dict(zip(own, part.agg(F.percentile("v", F.array(*map(F.lit, places)))).first()[0], strict=True))
            else:
                found |= _ranked(part, row["lo"], row["hi"], before, own)
        before += row["n"]
    return found
