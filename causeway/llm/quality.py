"""Document rules with verdicts on hosts, with DataFrame functions only.

Every document gets base figures and a base verdict. Failures are counted by host, each
host's failure rate is shrunk towards a beta prior that is fitted to all hosts by the method
of moments, and documents of a host whose shrunk rate exceeds ``max_host_rate`` go too.

Defined cases: null or blank text has no words and fails; a null host is a host of its own;
repeated rows are counted each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import identity, words, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5


def covered_words(starts: Column) -> Column:
    """Words inside the 3-word windows that begin at ``starts``, an array in ascending order."""
    # Sorted starts: each covers three words, less where the next one begins earlier.
    widths = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1), p + 3) - p))
    return F.coalesce(F.aggregate(widths, F.lit(0).cast("long"), lambda n, w: n + w), F.lit(0).cast("long"))


def with_figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.withColumn("__cw_words", words(text))
    df = df.withColumn("__cw_hashes", F.transform("__cw_words", lambda w: F.xxhash64(w)))
    n = F.size("__cw_hashes")
    h = F.col("__cw_hashes")
    windows = F.when(n >= 3, F.transform(F.slice(h, F.lit(1), n - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("__cw_grams", windows)
    # A sort of plain numbers tells the many texts without a repeated window.
    df = df.withColumn("__cw_repeats", F.size(F.array_distinct("__cw_grams")) < F.size("__cw_grams"))
    placed = F.when(F.col("__cw_repeats"), F.sort_array(F.transform("__cw_grams", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    df = df.withColumn("__cw_placed", placed)
    p = F.col("__cw_placed")
    twice = F.filter(p, lambda s, j: ((j > 0) & (F.get(p, j - 1)["x"] == s["x"])) | F.coalesce(F.get(p, j + 1)["x"] == s["x"], F.lit(False)))
    df = df.withColumn("__cw_starts", F.sort_array(F.transform(twice, lambda s: s["i"])))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__cw_lines", lines)
    n_words, repeated = F.size("__cw_words").cast("long"), covered_words(F.col("__cw_starts"))
    df = df.withColumns(
        {
            "n_words": n_words,
            "word_chars": F.char_length(F.array_join("__cw_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__cw_lines") - F.size(F.array_distinct("__cw_lines"))).cast("long"),
            "n_repeat_words": repeated,
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__cw_words", "__cw_hashes", "__cw_grams", "__cw_repeats", "__cw_placed", "__cw_starts", "__cw_lines")


def host_verdicts(judged: DataFrame, host_col: str = "host", failed_col: str = "base_failed", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_kept): one row per host, null included."""
    hosts = written(judged.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col(failed_col)).alias("n_failed")), "hosts")
    raw = F.col("n_failed") / F.col("n_docs")
    fit = hosts.agg(F.avg(raw).alias("m"), F.var_pop(raw).alias("v"), F.avg(1 / F.col("n_docs")).alias("inv")).first()
    m, v, inv = (fit["m"] or 0.0), (fit["v"] or 0.0), (fit["inv"] or 1.0)
    m = min(max(m, 1e-6), 1 - 1e-6)
    # The spread of raw rates is that of the prior plus sampling noise m(1-m)/n.
    between = v - m * (1 - m) * inv
    strength = min(max(m * (1 - m) / between - 1, 1.0), 1e6) if between > 0 else 1e6
    rate = (F.col("n_failed") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("rate", rate).withColumn("host_kept", F.col("rate") <= max_host_rate)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: its identity (r1, r2), id, figures, host, host rate and verdict."""
    r1, r2 = identity(id_col, text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"), r1.alias("r1"), r2.alias("r2"))
    figures = written(with_figures(slim).drop("text"), "figures")
    verdicts = written(host_verdicts(figures, max_host_rate=max_host_rate), "verdicts").withColumnRenamed("host", "verdict_host")
    # Plain tables on both sides: broadcast if the hosts are few enough, else skew is split.
    # The two columns make null hosts meet without a null-safe key.
    side = lambda c: [F.coalesce(F.col(c), F.lit("")), F.col(c).isNull()]
    a, b = side("host"), side("verdict_host")
    joined = figures.join(verdicts.select("verdict_host", "rate", "host_kept"), (a[0] == b[0]) & (a[1] == b[1]), "left")
    return joined.drop("verdict_host").withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were."""
    good = judge(docs, id_col, text_col, host_col, max_host_rate).where("kept").select(F.col("r1").alias("__cw_r1"), F.col("r2").alias("__cw_r2")).distinct()
    r1, r2 = identity(id_col, text_col)
    return docs.withColumns({"__cw_r1": r1, "__cw_r2": r2}).join(good, ["__cw_r1", "__cw_r2"], "left_semi").drop("__cw_r1", "__cw_r2")
