"""Removal of repeated lines and passages by global digests.

Each text is cut into units: its lines (or paragraphs, with another ``separator``), and the
passages of a line. A passage ends with a sentence of at least ``sentence_words`` words; the
shorter sentences before it belong to it, those behind the last such sentence of a line join
the last passage. Where a passage ends depends on its own words alone, so a text that is set
into different lines is cut alike there. Every word of a text belongs to one passage and one
line, and every unit with a word counts, however short.

A unit is normalised (A-Z lower-cased, ASCII white space collapsed and stripped) and digested
to 128 bits. Digests are grouped over all documents, the earliest occurrence by (id, line,
passage) stays, and all others are removed: a line whose digest occurs earlier, or all of
whose passages do, goes with its separator; of other lines the repeated passages go. Offsets
are code points of the original text, so what is removed can be traced.

Defined cases: null text is one line without a word; blank lines never count; repeats inside
one document count like all others; rows equal in id and text are one document and keep the
same units; rows of equal id and different text are ranked by a hash of the text; null ids
come last; texts of any length are read whole; an empty table gives no rows; other columns
pass through, and one with the name of an output column, whatever its case, gives way to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sealed, identity, written

_SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: White space that normalising would change: a longer run, another character, or an edge.
_ODD = re.compile(r"[\x09-\x0D]|\x20\x20|\A\x20|\x20\Z")
_END = re.compile(r"[.!?] ")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SENTENCE_WORDS = 6
#: Rows that a driver-checked broadcast may have; they are single hashes.
BROADCAST_ROWS = 1_000_000


def normalised(unit: str) -> str:
    return folded(_SPACE.sub(" ", unit).strip(" "))


def folded(text: str) -> str:
    """A-Z lower-cased, nothing else."""
    return text.lower() if text.isascii() else text.translate(_FOLD)


def passages(key: str, sentence_words: int) -> list[int]:
    """Where the passages of a normalised line begin, as places in it; the first is 0."""
    starts, begin = [0], 0
    for m in _END.finditer(key):
        end = m.end()
        if key.count(" ", begin, end) >= sentence_words:  # one blank behind every word
            starts.append(end)
        begin = end
    # Behind the last cut all sentences but the line's last are short; if that is, too, they join the passage before.
    if len(starts) > 1 and key.count(" ", begin) + 1 < sentence_words:
        starts.pop()
    return starts


def units_of(text: str, separator: str, sentence_words: int) -> Iterator[tuple[int, int, int, int, int, str]]:
    """(line, passage, passages in the line, start, end, key) of every unit; passage -1 is the whole line.

    A line of one passage is given once, as a whole.
    """
    at = 0
    for line, raw in enumerate(text.split(separator)):
        end = at + len(raw)
        odd = _ODD.search(raw)
        key = normalised(raw) if odd else folded(raw)
        if key:
            starts = passages(key, sentence_words)
            yield line, -1, len(starts), at, end, key
            if len(starts) > 1:
                places = _original_places(raw, key, starts) if odd else starts
                bounds, cuts = [*starts, len(key)], [*places, len(raw)]
                for i in range(len(starts)):
                    yield line, i, len(starts), at + cuts[i], at + cuts[i + 1], key[bounds[i] : bounds[i + 1]].rstrip(" ")
        at = end + len(separator)


def _original_places(raw: str, key: str, starts: list[int]) -> list[int]:
    """Places in the original line of words that begin at places of its normalised form."""
    words = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", raw)]
    return [0, *(words[key.count(" ", 0, s)] for s in starts[1:])]


def unit_table(docs: DataFrame, separator: str, sentence_words: int, id_col: str | Column, text_col: str | Column) -> DataFrame:
    """(doc, r1, line, passage, n, start, end, h1, h2): all units, with their offsets."""
    r1, _ = identity(id_col, text_col)
    of = lambda c: F.col(c) if isinstance(c, str) else c
    slim = docs.select(of(id_col).alias("doc"), r1.alias("r1"), of(text_col).cast("string").alias("text"))
    kind = slim.schema["doc"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

        def made(batch, rows: tuple[list, ...], digests: bytearray):
            own = pa.array(rows[0], pa.int64())
            pair = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), *(pa.array(r, k) for r, k in zip(rows[1:], kinds, strict=True)), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())],
                names=["doc", "r1", "line", "passage", "n", "start", "end", "h1", "h2"],
            )

        for batch in batches:
            rows, digests = tuple([] for _ in range(6)), bytearray()
            for i, text in enumerate(t.as_py() for t in batch.column(2)):
                for line, passage, n, start, end, key in units_of(text or "", separator, sentence_words):
                    for column, value in zip(rows, (i, line, passage, n, start, end), strict=True):
                        column.append(value)
                    digests += hashlib.blake2b(key.encode(), digest_size=16).digest()
                if len(rows[0]) >= 1 << 16:  # a long text alone may fill a batch
                    yield made(batch, rows, digests)
                    rows, digests = tuple([] for _ in range(6)), bytearray()
            yield made(batch, rows, digests)

    return slim.mapInArrow(run, f"doc {kind}, r1 long, line int, passage int, n int, start long, end long, h1 long, h2 long")


def repeated_units(units: DataFrame) -> DataFrame:
    """The rows of :func:`unit_table` whose digest an earlier unit has."""
    # Most digests are unique: half a digest finds those that may not be. A frequent unit is
    # one row per task here, and a semi-join may split it.
    twice = written(units.groupBy("h1").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h1"), "twice")
    near = written(units.join(F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice, "h1", "left_semi"), "near")
    place = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "r1", "line", "passage")
    # Minima are taken before the shuffle, too.
    firsts = near.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return near.join(written(firsts, "firsts"), ["h1", "h2"]).where(place != F.col("first")).drop("first", "h1", "h2")


def cleaned(text: str, hits: list[dict], separator: str) -> tuple[list[dict], str]:
    """Removed stretches (line, start, end, whole) in order, and the text without them."""
    lines = text.split(separator)
    by_line: dict[int, list[dict]] = {}
    for h in hits:
        by_line.setdefault(h["line"], []).append(h)
    removed, kept, at = [], [], 0
    for number, raw in enumerate(lines):
        found = by_line.get(number, [])
        if any(h["passage"] < 0 for h in found) or (found and len(found) == found[0]["n"]):
            removed.append({"line": number, "start": at, "end": at + len(raw), "whole": True})
        elif found:
            parts, lo = [], 0
            for h in sorted(found, key=lambda h: h["start"]):
                parts.append(raw[lo : h["start"] - at])
                lo = h["end"] - at
                removed.append({"line": number, "start": h["start"], "end": h["end"], "whole": False})
            kept.append("".join(parts) + raw[lo:])
        else:
            kept.append(raw)
        at += len(raw) + len(separator)
    return removed, separator.join(kept)


def drop_repeated_units(docs: DataFrame, separator: str = "\n", sentence_words: int = SENTENCE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``removed`` (array of line, start, end, whole; null if nothing is), ``n_lines`` and ``kept_text``."""
    own = Sealed(docs)
    ident, text = own[id_col], own[text_col].cast("string")
    units = written(unit_table(own.df, separator, sentence_words, ident, text), "units")
    hits = repeated_units(units).groupBy("doc", "r1").agg(F.collect_set(F.struct("line", "passage", "n", "start", "end")).alias("hits"))

    @F.arrow_udf("struct<removed: array<struct<line: int, start: long, end: long, whole: boolean>>, kept_text: string>")
    def clean(texts: pa.Array, found: pa.Array) -> pa.Array:
        stretch = pa.struct([("line", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("whole", pa.bool_())])
        out = []
        for t, h in zip(texts, found, strict=True):
            gone, kept = cleaned(t.as_py() or "", h.as_py(), separator) if h.is_valid else (None, t.as_py() or "")
            out.append({"removed": gone, "kept_text": kept})
        return pa.array(out, pa.struct([("removed", pa.list_(stretch)), ("kept_text", pa.string())]))

    keyed = own.df.withColumn("__r1", identity(ident, text)[0])
    joined = keyed.join(hits, ident.eqNullSafe(F.col("doc")) & (F.col("__r1") == F.col("r1")), "left").withColumn("__done", clean(text, F.col("hits")))
    n_lines = F.size(F.split(F.coalesce(text, F.lit("")), f"\\Q{separator}\\E", -1)).cast("long")
    return own.back(joined, {"removed": F.col("__done.removed"), "n_lines": n_lines, "kept_text": F.col("__done.kept_text")})
