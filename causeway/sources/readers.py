"""Readers for expression matrices, gene lists, maps, edge tables and frequency tables."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.operators import preprocess

EDGE_SCHEMA = T.StructType([T.StructField("gene1", T.StringType()), T.StructField("gene2", T.StringType()), T.StructField("lag", T.IntegerType()), T.StructField("p_value", T.DoubleType())])


def _first_line(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path).limit(1).collect()
    if not rows:
        raise ValueError(f"{path} is empty")
    return rows[0][0].lstrip("﻿")


def unpivot(wide: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(gene, t, label, value): ``order`` gives the semantic order of the columns."""
    long = wide.unpivot([key], order, "label", "raw")
    place = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))])
    return long.select(F.col(key).alias("gene"), place[F.col("label")].alias("t"), "label", F.col("raw").alias("value"))


def expression_matrix(spark: SparkSession, path: str, min_points: int = 5) -> DataFrame:
    """SC1: delimiter from the header line, a Gene column, at least ``min_points`` others."""
    header = _first_line(spark, path)
    sep = csv.Sniffer().sniff(header, delimiters=",\t;|").delimiter
    wide = spark.read.option("header", True).option("sep", sep).csv(path)
    wide = wide.toDF(*[c.lstrip("﻿") for c in wide.columns])
    points = [c for c in wide.columns if c != "Gene"]
    if "Gene" not in wide.columns or len(points) < min_points:
        raise ValueError(f"{path}: a Gene column and {min_points} timepoints are needed")
    return preprocess.strict_number(unpivot(wide, "Gene", points))


def artifact(spark: SparkSession, path: str) -> DataFrame:
    """A prepared matrix as CSV: a Gene column and numbers; anything else fails the job."""
    wide = spark.read.option("header", True).csv(path)
    if "Gene" not in wide.columns:
        raise ValueError(f"{path}: a Gene column is needed")
    return preprocess.strict_number(unpivot(wide, "Gene", [c for c in wide.columns if c != "Gene"]))


def count_matrix(spark: SparkSession, path: str) -> DataFrame:
    """SC2: tab-separated counts; every column but the first is a sample; cells must be numbers."""
    wide = spark.read.option("header", True).option("sep", "\t").csv(path)
    return preprocess.strict_number(unpivot(wide, wide.columns[0], wide.columns[1:]))


def feature_counts(spark: SparkSession, path: str) -> DataFrame:
    """SC3: a comment line, then the header; malformed lines are dropped."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    header = lines.limit(1).collect()[0][0].split("\t")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = lines.where(F.col("value") != "\t".join(header)).where(F.size(F.split("value", "\t")) == len(header))
    wide = rows.select(F.split("value", "\t").alias("f")).select(*[F.col("f")[i].alias(f.name) for i, f in enumerate(schema)])
    return wide


def run_labels(labels: list[str], runs: list[tuple[str, str]]) -> dict[str, str]:
    """SC5: names of sample columns with the time of their run: the first run whose id is in the name decides.

    The id is followed by _<time>, and the name ends before _REF.
    """
    out = {}
    for label in labels:
        run, time = next(((r, t) for r, t in runs if r in label), ("", ""))
        out[label] = (label.replace(run, f"{run}_{time}") if run else label).split("_REF")[0]
    return out


def wild_type_counts(spark: SparkSession, path: str) -> DataFrame:
    """(gene, t, rep, value): the wild-type replicates of a count matrix, days from the column names; all-zero genes dropped."""
    return preprocess.drop_all_zero(preprocess.day_replicates(count_matrix(spark, path), "wild_type"))


def run_counts(spark: SparkSession, path: str, mapping: str, runs: str) -> DataFrame:
    """(gene, t, rep, value): replicates of a featureCounts table under gene symbols and days.

    Columns get their times by the table of runs (Run, Time_point), ids their symbols by the
    mapping; cells that are no numbers count as 0, unmapped ids and all-zero genes are dropped.
    """
    wide = feature_counts(spark, path)
    meta = spark.read.option("header", True).csv(runs).select("Run", "Time_point").collect()  # a row per sequencing run
    samples = [c for c in wide.columns if c != "Geneid" and "SRR" in c]
    names = run_labels(samples, [(r["Run"], r["Time_point"]) for r in meta])
    long = unpivot(wide.select("Geneid", *[F.col(f"`{c}`").alias(names[c]) for c in samples]), "Geneid", [names[c] for c in samples])
    mapped = map_symbols(preprocess.to_number(long), id_symbol_map(spark, mapping))
    return preprocess.drop_all_zero(preprocess.day_replicates(mapped, "runs"))


def graphml(path: str) -> tuple[list[str], list[tuple[str, str, float | None]]]:
    """SC15: (nodes, edges) of a GraphML file of bounded size, as the writer makes it."""
    import xml.etree.ElementTree as ET

    space = "{http://graphml.graphdrawing.org/xmlns}"
    root = ET.parse(path).getroot()
    keys = {k.get("id"): k.get("attr.name") for k in root.iter(f"{space}key")}
    edges = []
    for e in root.iter(f"{space}edge"):
        p = next((float(d.text) for d in e.iter(f"{space}data") if keys.get(d.get("key")) == "p_value"), None)
        edges.append((e.get("source"), e.get("target"), p))
    return [n.get("id") for n in root.iter(f"{space}node")], edges


def resolve(name: str, *roots: str) -> str:
    """SC16: the file itself, or under the first root that has it, or the only file of that name below a root."""
    from pathlib import Path

    for base in (Path("."), *map(Path, roots)):
        if (base / name).exists():
            return str(base / name)
    found = sorted({str(p) for base in roots for p in Path(base).rglob(Path(name).name)})
    if len(found) != 1:
        raise FileNotFoundError(f"{name}: {'several files' if found else 'no file'} of that name")
    return found[0]


def tsv_to_csv(spark: SparkSession, source: str, target: str) -> None:
    """SC17: a headerless tab-separated matrix as CSV."""
    spark.read.option("sep", "\t").csv(source).write.mode("overwrite").csv(target)


def noise_rows(spark: SparkSession, *paths: str) -> DataFrame:
    """(gene, series): every row of headerless noise matrices, named <matrix>:<row> by their order in the file."""
    out = None
    for k, path in enumerate(paths):
        wide = spark.read.csv(path)
        series = F.array(*[F.col(c).cast("double") for c in wide.columns])
        rows = wide.select(F.concat(F.lit(f"{k}:"), F.monotonically_increasing_id()).alias("gene"), series.alias("series"))
        out = rows if out is None else out.unionByName(rows)
    return out


def id_symbol_map(spark: SparkSession, path: str) -> DataFrame:
    """SC4: headerless two columns; a repeated id keeps its last symbol."""
    rows = spark.read.option("sep", "\t").schema("id string, symbol string").csv(path).withColumn("pos", F.monotonically_increasing_id())
    return rows.groupBy("id").agg(F.max_by("symbol", "pos").alias("symbol"))


def map_symbols(matrix: DataFrame, mapping: DataFrame, key: str = "gene") -> DataFrame:
    """Genes under their symbols; unmapped ones are dropped."""
    return matrix.join(mapping.withColumnRenamed("id", key), key).drop(key).withColumnRenamed("symbol", key)


def gene_list(spark: SparkSession, path: str) -> DataFrame:
    """SC6: (pos, gene): blank lines and comments skipped, the first of equal names kept."""
    rows = spark.read.text(path).select(F.trim("value").alias("gene"), F.monotonically_increasing_id().alias("pos"))
    rows = rows.where((F.col("gene") != "") & ~F.col("gene").startswith("#"))
    found = rows.groupBy("gene").agg(F.min("pos").alias("pos")).select("pos", "gene")
    if found.isEmpty():
        raise ValueError(f"{path} has no genes")
    return found


def edge_table(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """SC7 to SC10: gene1, gene2, lag and a p column under any of its names.

    Strict reading fails on values that are no numbers; otherwise they become null.
    """
    wide = spark.read.option("header", True).csv(path)
    names = {c.lstrip("﻿").strip().lower(): c for c in wide.columns}
    p = next((names[a] for a in ("p-value", "p_value", "pval") if a in names), None)
    if p is None or "gene1" not in names or "gene2" not in names:
        raise ValueError(f"{path}: gene1, gene2 and p-value columns are needed")
    cast = (lambda c, kind: c.cast(kind)) if strict else (lambda c, kind: c.try_cast(kind))
    lag = cast(F.col(names["lag"]), "int") if "lag" in names else F.lit(1)
    value = F.col(f"`{p}`")
    number = F.when(F.lower(value) == "nan", None).otherwise(cast(value, "double"))
    return wide.select(F.trim(F.col(names["gene1"])).alias("gene1"), F.trim(F.col(names["gene2"])).alias("gene2"), lag.alias("lag"), number.alias("p_value"))


def frequency_table(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """SC11: (gene, frequency): bad rows skipped, the last of equal genes wins."""
    wide = spark.read.option("header", True).csv(path)
    names = {c.lower(): c for c in wide.columns}
    freq = next(c for n, c in names.items() if "freq" in n)
    gene = F.trim(F.col(next(names[a] for a in ("gene", "symbol", "gene_symbol") if a in names)))
    rows = wide.select((F.lower(gene) if lower else gene).alias("gene"), F.col(f"`{freq}`").try_cast("double").alias("frequency"), F.monotonically_increasing_id().alias("pos"))
    return rows.where((F.col("gene") != "") & F.col("frequency").isNotNull()).groupBy("gene").agg(F.max_by("frequency", "pos").alias("frequency"))
