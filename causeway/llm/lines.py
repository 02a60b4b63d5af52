"""Line dedup with DataFrame functions only.

Lines are keyed by two 64-bit hashes of their normalised text. The hashes are
range-partitioned by (hash, document, row, position) and sorted within the ranges, so one
frequent key spreads over several ranges; every range streams its runs and hands on one
partial count and one first occurrence per key. The verdicts come back as a run-length
compressed keep bitmap per document, never as text.

Defined cases: a null or empty text is one empty line; every row is a document of its own
(repeated rows and rows with a null id too), unless ``different`` counts rows of the same keys
in the same order as one; equal places don't occur; keys shorter than ``min_chars`` never count;
texts of any length are split whole; an empty table gives no rows; other columns pass through,
and one with the name of an output column, whatever its case, gives way to it, while
:func:`without_frequent_lines` keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sealed, identity, shuffle_width, written

#: ASCII white space, stripped from both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def folded(text: Column) -> Column:
    """A-Z lower-cased, nothing else; lower() does the same to pure ASCII, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def line_table(docs: DataFrame, min_chars: int, id_col: str | Column, text_col: str | Column) -> DataFrame:
    """(rid, doc, r1, r2, same, pos, h1, h2): every line whose key has ``min_chars`` code points.

    ``same`` is equal for rows that have the same such keys in the same order.
    """
    text = _of(text_col).cast("string")
    keys = F.transform(split_lines(folded(text)), lambda x: F.btrim(x, F.lit(STRIPPED)))
    r1, r2 = identity(id_col, text_col)
    # The row number is made below the explosion: made beside it, each line would get its own.
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), _of(id_col).alias("doc"), r1.alias("r1"), r2.alias("r2"), keys.alias("keys"))
    # So is the hash: made beside it, every line would hash its whole document again.
    rows = rows.withColumn("same", F.xxhash64(F.lit(11), F.filter("keys", lambda x: F.char_length(x) >= min_chars)))
    rows = rows.select("rid", "doc", "r1", "r2", "same", F.posexplode("keys").alias("pos", "key"))
    return rows.where(F.char_length("key") >= min_chars).select("rid", "doc", "r1", "r2", "same", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))


def frequent_keys(lines: DataFrame, min_docs: int, different: bool = False) -> DataFrame:
    """(h1, h2, n_docs, first): keys found in at least ``min_docs`` rows, with their first place.

    ``different``: rows of the same keys in the same order count once.
    """
    if different:
        # Minima are taken before the shuffle: copies are one row per key and task.
        texts = lines.groupBy("h1", "h2", "same").agg(F.min(F.struct("doc", "rid", "pos")).alias("first"))
        return texts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("first").alias("first")).where(F.col("n_docs") >= min_docs)
    order = ["h1", "h2", "doc", "rid"]
    ranged = lines.select(*order, "pos").repartitionByRange(shuffle_width(lines.sparkSession), *order).sortWithinPartitions(*order, "pos")
    # Ranges of (key, row) hold a row's lines of one key together: no exchange here.
    once = ranged.groupBy(*order).agg(F.min("pos").alias("pos"))
    # One row per key and range goes on, however many lines the key has.
    return (
        once.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc", "rid", "pos")).alias("first"))
        .where(F.col("n_docs") >= min_docs)
    )


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str | Column = "doc_id", text_col: str | Column = "text", different: bool = False) -> DataFrame:
    """(r1, r2, dropped) of the documents that lose lines; r1 and r2 identify id and text.

    ``dropped`` is the compressed bitmap: the runs (start, end) of dropped lines in order,
    end exclusive; all other lines are kept. With ``keep_first`` a key's first line, by
    document and position, stays.
    """
    lines = line_table(docs, min_chars, id_col, text_col)
    lines = written(lines if different else lines.drop("same"), "lines")
    frequent = written(frequent_keys(lines, min_docs, different), "frequent")
    # A join on plain tables: Spark broadcasts the keys if their size allows, else it may
    # split the lines of a frequent key over tasks.
    hit = lines.join(frequent, ["h1", "h2"])
    if keep_first:
        hit = hit.where((F.col("rid") != F.col("first.rid")) | (F.col("pos") != F.col("first.pos")))
    per_row = hit.groupBy("rid").agg(F.first("r1").alias("r1"), F.first("r2").alias("r2"), F.sort_array(F.collect_list("pos")).alias("at"))
    starts = F.filter("at", lambda p, i: (i == 0) | (F.get(F.col("at"), i - 1) != p - 1))
    ends = F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.get(F.col("at"), i + 1) != p + 1))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))
    per_row = per_row.select("r1", "r2", runs.alias("dropped"))
    # Rows of equal id and text lose the same lines, unless only the first stays.
    return per_row.groupBy("r1", "r2").agg((F.max_by("dropped", F.size("dropped")) if keep_first else F.first("dropped")).alias("dropped"))


def _judged(own: Sealed, text: Column, ident: Column, min_docs: int, min_chars: int, keep_first: bool, different: bool) -> tuple[DataFrame, Column, Column]:
    """The sealed rows with their lines and dropped runs, the kept text, and the number of dropped lines."""
    bitmaps = keep_bitmaps(own.df, min_docs, min_chars, keep_first, ident, text, different)
    r1, r2 = identity(ident, text)
    joined = own.df.withColumns({"r1": r1, "r2": r2}).join(bitmaps, ["r1", "r2"], "left").withColumn("__lines", split_lines(text))
    first = F.transform("dropped", lambda r: r["start"])
    last = F.transform("dropped", lambda r: r["end"])
    kept_runs = F.zip_with(F.concat(F.array(F.lit(0)), last), F.concat(first, F.array(F.size("__lines"))), lambda a, b: F.slice(F.col("__lines"), a + 1, b - a))
    kept = F.when(F.col("dropped").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.flatten(kept_runs), "\n"))
    n_dropped = F.coalesce(F.aggregate("dropped", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]), F.lit(0).cast("long"))
    return joined, kept, n_dropped


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", different: bool = False) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before dropping) and ``n_dropped``."""
    own = Sealed(docs)
    joined, kept, n_dropped = _judged(own, own[text_col].cast("string"), own[id_col], min_docs, min_chars, keep_first, different)
    return own.back(joined, {"kept_text": kept, "n_lines": F.size("__lines").cast("long"), "n_dropped": n_dropped})


def without_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, different: bool = False) -> DataFrame:
    """All columns of ``docs``, in their order; the text is what is kept, ``chars_col`` its code points."""
    own = Sealed(docs)
    joined, kept, _ = _judged(own, own[text_col].cast("string"), own[id_col], min_docs, min_chars, keep_first, different)
    joined = joined.withColumn("__kept", kept)
    made = {text_col: F.col("__kept").cast(own.kind(text_col))}
    if chars_col is not None:
        made[chars_col] = F.char_length("__kept").cast(own.kind(chars_col))
    return own.back(joined, made).select(*[f"`{c}`" for c in docs.columns])
