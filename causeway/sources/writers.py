"""Writers for edges, rankings, gene lists and bounded networks (GraphML, SVG)."""

from __future__ import annotations

import csv
import json
import math
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Drawings and GraphML files are made on the driver, up to this many edges.
MAX_DRAWN = 20_000

#: Fill colours of communities, dealt in turn.
COLOURS = ["#4e79a7", "#f28e2b", "#59a14f", "#e15759", "#76b7b2", "#edc948", "#b07aa1", "#9c755f", "#ff9da7", "#86bcb6"]


def edges_csv(e: DataFrame, path: str, mode: str = "append", errors: bool = False) -> None:
    """SK1: pairs with digits enough to read the same p back, appended; with ``errors`` failed ones too, as NaN and their error."""
    p = F.when(F.col("p_value").isNull(), "NaN").otherwise(F.format_string("%.17g", "p_value"))
    lag = F.col("lag") if "lag" in e.columns else F.lit(1)
    rows = e.select("gene1", "gene2", lag.alias("lag"), p.alias("p-value"), *([F.coalesce("error", F.lit("")).alias("error")] if errors else []))
    (rows if errors else rows.where(F.col("p-value") != "NaN")).write.mode(mode).option("header", True).csv(path)


def result_name(p: float, kept: int, tested: int) -> str:
    """SK2: the name of a result by its threshold and counts."""
    return f"granger_results_p{p:g}_{kept}of{tested}.csv"


def rounded_csv(e: DataFrame, path: str) -> None:
    """SK3: p-values to four digits, half to even; failed pairs as NaN for lag and p."""
    bad = F.col("p_value").isNull()
    text = F.when(bad, "NaN").otherwise(F.bround("p_value", 4).cast("string"))
    e.select("gene1", "gene2", F.when(bad, "NaN").otherwise("1").alias("lag"), text.alias("p-value")).write.mode("overwrite").option("header", True).csv(path)


def diff_report(diff: DataFrame, path: str, quantile: float, overlap: float, k: int) -> str:
    """SK5: the differences of two rankings with 12 digits; the text of their summary."""
    digits = [F.format_string("%.12g", c).alias(n) for c, n in (("prev_f", "PrevFreq"), ("curr_f", "CurrFreq"), ("abs_diff", "AbsDiff"), ("rel_diff", "RelDiff"))]
    diff.select(F.col("gene").alias("Gene"), *digits, F.col("in_prev").alias("InPrev"), F.col("in_curr").alias("InCurr")).write.mode("overwrite").option("header", True).csv(path)
    return f"relative difference at the quantile: {quantile:.6f}\noverlap of the top {k}: {overlap:.2f} %\n"


def preparation(summarised: DataFrame, replicates: DataFrame, genes: DataFrame, root: str, wanted: tuple[str, ...]) -> None:
    """SK8: any of all_replicates, all_summarised, subset_replicates, subset_summarised, each a folder of ``root``."""
    for name in wanted:
        part, kind = name.split("_", 1)
        df = {"replicates": replicates, "summarised": summarised}[kind]
        df = df if part == "all" else df.join(genes.select("gene").distinct(), "gene", "left_semi")
        df.write.mode("overwrite").option("header", True).csv(f"{root.rstrip('/')}/{name}")


def thresholds_csv(rows: list[tuple[str, float, float]], spark, path: str) -> None:
    """SK10: (csv_path, quantile, threshold)."""
    spark.createDataFrame(rows, "csv_path string, quantile double, threshold double").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report_json(report: dict, path: str) -> None:
    """SK11: a report of bounded size."""
    Path(path).write_text(json.dumps(report, indent=1, sort_keys=True), encoding="utf-8")


def history_line(record: dict, path: str) -> None:
    """SK12: one line for an iteration of a consensus, appended."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record) + "\n")


def pairs_csv(pairs: DataFrame, path: str) -> None:
    """SK13: the pairs of a probe design."""
    pairs.select("gene1", "gene2").write.mode("overwrite").option("header", True).csv(path)


def benchmark(stage: str, base_seconds: float, seconds: float, units: int | None = None, least_speedup: float | None = None) -> dict:
    """Times of two ways to do a stage, their rates and speed-up; infinite if the second took no time."""
    speedup = float("inf") if seconds == 0 else base_seconds / seconds
    rate = lambda s: None if units is None or s == 0 else units / s
    return {"stage": stage, "base_seconds": base_seconds, "seconds": seconds, "speedup": speedup, "base_rate": rate(base_seconds), "rate": rate(seconds), "passed": None if least_speedup is None else speedup >= least_speedup}


def bundle(e: DataFrame, root: str, summary: dict, community: dict[str, int] | None = None) -> dict:
    """SK6: the edges, nodes, GraphML, drawing and summary of a network of bounded size, in a local folder; their paths."""
    out = {k: str(Path(root) / n) for k, n in (("edges", "edges.csv"), ("nodes", "nodes.txt"), ("graphml", "network.graphml"), ("svg", "network.svg"), ("summary", "summary.json"))}
    Path(root).mkdir(parents=True, exist_ok=True)
    rows = _bounded(e)
    names = sorted({g for a, b, _ in rows for g in (a, b)})
    with open(out["edges"], "w", encoding="utf-8", newline="") as f:
        csv.writer(f).writerows([("gene1", "gene2", "p-value"), *((a, b, f"{p:.17g}") for a, b, p in rows)])
    Path(out["nodes"]).write_text("".join(f"{n}\n" for n in names), encoding="utf-8")
    graphml(e, out["graphml"])
    svg(e, out["svg"], community)
    report_json({"nodes": len(names), "edges": len(rows), "metrics": {"genes_total": len(names)} | summary}, out["summary"])
    return out


def frequency_csv(freq: DataFrame, path: str) -> None:
    """SK4: by falling frequency, then gene."""
    freq.orderBy(F.desc("frequency"), "gene").write.mode("overwrite").option("header", True).csv(path)


def gene_list_text(genes: DataFrame, path: str, order: str | None = None) -> None:
    """SK9: one gene a line, sorted and distinct, or in the order of a column."""
    rows = genes.orderBy(order) if order else genes.select("gene").distinct().orderBy("gene")
    rows.select(F.col("gene").cast("string")).write.mode("overwrite").text(path)


def _bounded(e: DataFrame) -> list[tuple[str, str, float]]:
    rows = e.select(F.col("gene1").cast("string"), F.col("gene2").cast("string"), "p_value").limit(MAX_DRAWN + 1).collect()
    if len(rows) > MAX_DRAWN:
        raise ValueError(f"more than {MAX_DRAWN} edges: select a smaller network")
    return sorted((r[0], r[1], r[2]) for r in rows)


def graphml(e: DataFrame, path: str) -> None:
    """SK6: a directed GraphML file with the p-value on each edge."""
    edges = _bounded(e)
    names = sorted({g for a, b, _ in edges for g in (a, b)})
    out = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="p" for="edge" attr.name="p_value" attr.type="double"/>', '<graph edgedefault="directed">']
    out += [f"<node id={quoteattr(n)}/>" for n in names]
    out += [f"<edge source={quoteattr(a)} target={quoteattr(b)}><data key=\"p\">{p!r}</data></edge>" for a, b, p in edges]
    Path(path).write_text("\n".join([*out, "</graph>", "</graphml>", ""]), encoding="utf-8")


def svg(e: DataFrame, path: str, community: dict[str, int] | None = None, size: int = 900) -> None:
    """SK14: genes on a circle in the order of their communities, edges as chords."""
    edges, group = _bounded(e), community or {}
    names = sorted({g for a, b, _ in edges for g in (a, b)}, key=lambda g: (group.get(g, 0), g))
    at = {g: (size / 2 + size * 0.42 * math.cos(2 * math.pi * i / len(names)), size / 2 + size * 0.42 * math.sin(2 * math.pi * i / len(names))) for i, g in enumerate(names)}
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size} {size}" font-size="9">']
    for a, b, _ in edges:
        out.append('<line x1="{:.1f}" y1="{:.1f}" x2="{:.1f}" y2="{:.1f}" stroke="#bbb" stroke-width="0.5"/>'.format(*at[a], *at[b]))
    for g in names:
        x, y = at[g]
        out.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="4" fill="{COLOURS[group.get(g, 0) % len(COLOURS)]}"/><text x="{x + 5:.1f}" y="{y:.1f}">{escape(g)}</text>')
    Path(path).write_text("\n".join([*out, "</svg>", ""]), encoding="utf-8")
