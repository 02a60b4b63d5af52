"""Long expression matrices (gene, t, value) over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, series): one array per gene, ready for the pair kernels."""
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gene"), F.col("embedding").cast("array<double>").alias("series"))


def embedding_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_series(spark, sf_dir).select("gene", F.posexplode("series").alias("t", "value"))


def supplier_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, t, rep, value): quantity by supplier, year and return status."""
    li = _table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("gene"), F.year("l_shipdate").alias("t"), F.concat("l_returnflag", "l_linestatus").alias("rep")).agg(F.sum("l_quantity").alias("value"))


def event_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, t, rep, value): value by user, day and kind of event; sparse."""
    ev = _table(spark, sf_dir, "events")
    return ev.groupBy(F.col("user_id").alias("gene"), F.dayofmonth("ts").alias("t"), F.col("event_type").alias("rep")).agg(F.sum("value").alias("value"))


EMB_SQL = "SELECT vec_id AS gene, unnest(range(0, len(embedding)))::INT AS t, unnest(embedding)::DOUBLE AS value FROM embeddings"
LI_SQL = "SELECT l_suppkey AS gene, year(l_shipdate)::INT AS t, l_returnflag || l_linestatus AS rep, sum(l_quantity) AS value FROM lineitem GROUP BY ALL"
EV_SQL = "SELECT user_id AS gene, day(ts)::INT AS t, event_type AS rep, sum(value) AS value FROM events GROUP BY ALL"
