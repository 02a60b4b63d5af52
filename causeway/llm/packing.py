"""Sum-of-squares packing of token sequences.

Documents are tokenised, cut into pieces of at most ``budget`` ids, and the pieces are
placed into sequences with the sum-of-squares rule: a piece goes where the sum, over all
residual gaps, of the squared number of open bins with that gap becomes smallest.

Distribution: tokens are written once; only (key, length) of the pieces travels to the
packers. Pieces are dealt by hash into shards of about ``shard_pieces`` pieces, each packed
by one task in memory bounded by the shard. The bins that a shard leaves worst filled are
dissolved and packed once more in a second, much smaller, round.

Defined cases: null text is an empty text (one piece holding the end id); repeated rows are
separate documents; a null ``doc_id`` is carried along; an empty table gives no rows.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Entries in each of the two generations of a worker's memory of encoded chunks.
CACHE_ENTRIES = 300_000
#: A memory above this is emptied when its task ends, as idle workers hold it beside other stages.
KEPT_ENTRIES = 50_000

#: A chunk that is a run of ASCII or Latin-1 letters with at most one comma or full stop.
SIMPLE = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,]?)")


class ChunkEncoder(dict):
    """Token ids of white-space separated chunks, as little-endian unsigned 32-bit bytes.

    The word tokenizer splits at white space before it merges, so a text's ids are those of
    its ASCII-white-space separated chunks, and each distinct chunk is encoded once. Chunks
    of plain letters go straight to the merge model (lower-cased, bytes mapped as its
    pre-tokenizer does); all others through the whole tokenizer. A full memory becomes the
    older generation, and chunks met again move back to the younger one.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_str(spec)
        self.merge = self.tokenizer.model.tokenize
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.mapped = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        # Plain letters may skip the pipeline only where the pipeline is the known one.
        self.direct = self.full("Étéß".encode()) == self.letters("étéß".encode())

    def full(self, chunk: bytes) -> bytes:
        ids = self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def letters(self, word: bytes) -> bytes:
        text = word.decode()
        if not text.isascii():
            text = text.lower().translate(self.mapped)
        of = self.bytes_of
        return b"".join([of[t.id] for t in self.merge(text)])

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is not None:
            self[chunk] = ids
            return ids
        m = SIMPLE.fullmatch(chunk) if self.direct else None
        if not m:
            ids = self.full(chunk)
        else:
            word, mark = m.groups()
            word = word.lower()  # ASCII only; letters() does the rest
            ids = self.get(word) or self.older.get(word)
            if ids is None:
                ids = self[word] = self.letters(word)
            if mark:
                ids += self.get(mark) or self.setdefault(mark, self.full(mark))
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, text.encode().split()))

    def trim(self) -> None:
        self.older = {}
        if len(self) > KEPT_ENTRIES:
            self.clear()


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder_of(spec: str) -> ChunkEncoder:
    """One encoder for each tokenizer and worker process: its memory outlives a task."""
    if spec not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[spec] = ChunkEncoder(spec)
    return _ENCODERS[spec]


def token_pieces(docs: DataFrame, tokenizer_file: str, budget: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, tokens): tokens are little-endian uint32 bytes."""
    with open(tokenizer_file, encoding="utf-8") as f:  # a file of fixed size, beside the driver
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.asarray([end_id], dtype="<u4").tobytes()
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("tokens", T.BinaryType())]
    )

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        encoder, step = encoder_of(spec.value), 4 * budget
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            held = 0
            for at, text in enumerate(t.as_py() for t in batch.column(1)):
                ids = encoder.encode(text or "") + end
                for piece, lo in enumerate(range(0, len(ids), step)):
                    part = ids[lo : lo + step]
                    for column, value in zip(rows, (at, piece, lo // 4, len(part) // 4, part), strict=True):
                        column.append(value)
                    held += len(part)
                if held > 8 << 20 or at == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), *map(pa.array, rows[1:], kinds)], names=["doc_id", "piece", "start", "length", "tokens"])
                    rows, held = ([], [], [], [], []), 0
        encoder.trim()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the gap that each bin keeps.

    Placing a length s into a bin with gap g changes the sum of squares by
    (N[g]-1)^2 - N[g]^2 + (N[g-s]+1)^2 - N[g-s]^2; gap 0 is a closed bin and counts nothing,
    and a new bin has only the second part. Ties go to the smallest gap.
    """
    counts = np.zeros(budget + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(budget + 1)]
    gaps: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        if s >= budget:
            choice = budget
        else:
            gap_counts = counts[s:budget]
            after = counts[: budget - s]
            delta = after - gap_counts
            delta *= 2
            delta += 2
            delta[0] -= 2 * counts[0] + 1  # an exact fit: closed bins don't count
            delta[gap_counts == 0] = never
            best = int(delta.argmin()) if len(delta) else 0
            fresh = 2 * int(counts[budget - s]) + 1
            choice = s + best if len(delta) and delta[best] <= fresh else budget
        if choice == budget:
            b = len(gaps)
            gaps.append(budget)
        else:
            b = stacks[choice].pop()
            counts[choice] -= 1
        bins[i], offsets[i] = b, budget - gaps[b]
        gaps[b] -= s
        if gaps[b] > 0:
            stacks[gaps[b]].append(b)
            counts[gaps[b]] += 1
    return bins, offsets, np.asarray(gaps, np.int64)


def _packed(shards: DataFrame, budget: int) -> DataFrame:
    """(key, shard, length) packed shard by shard: adds bin, offset and the bin's gap."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        # Long pieces first; equal lengths in key order, so that reruns agree.
        pdf = pdf.sort_values(["length", "key"], ascending=[False, True], ignore_index=True)
        bins, offsets, gaps = sum_of_squares(pdf["length"].to_numpy(), budget)
        return pd.DataFrame({"key": pdf["key"], "shard": pdf["shard"], "length": pdf["length"], "bin": bins, "offset": offsets, "gap": gaps[bins]})

    return shards.groupBy("shard").applyInPandas(pack, "key long, shard long, length long, bin long, offset long, gap long")


def pack_documents(docs: DataFrame, tokenizer_file: str, budget: int = 4096, end_id: int = 1, shard_pieces: int = 8192, id_col: str = "doc_id", text_col: str = "text", derive: dict[str, Column] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, tokens, sequence_id, offset.

    ``tokens`` are the piece's ids as little-endian uint32; sequence ids are unique numbers
    without order. Pieces of a whole budget are sequences of their own. ``derive`` names
    columns to be made of a piece instead of ``tokens``, which then stay where they are.
    """
    # The key is made before the write, so that it is fixed from there on.
    pieces = written(token_pieces(docs, tokenizer_file, budget, end_id, id_col, text_col).withColumn("key", F.monotonically_increasing_id()), "pieces")
    loose = pieces.where(F.col("length") < budget).select("key", "length")
    n_loose = loose.count()
    n_shards = max(1, math.ceil(n_loose / shard_pieces))

    def dealt(df: DataFrame, n: int, base: int) -> DataFrame:
        return df.select("key", (F.pmod(F.xxhash64("key"), F.lit(n)) + F.lit(base)).cast("long").alias("shard"), "length")

    first = written(_packed(dealt(loose, n_shards, 0), budget), "packed")
    # Bins with a gap that any further piece might use are dissolved and packed again.
    bad = F.col("gap") > F.lit(budget // 64)
    n_bad = first.where(bad).count()
    plan = first
    if n_shards > 1 and n_bad:
        n_again = max(1, math.ceil(n_bad / shard_pieces))
        again = _packed(dealt(first.where(bad).select("key", "length"), n_again, n_shards), budget)
        plan = first.where(~bad).unionByName(again)
    plan = plan.select("key", (F.shiftleft(F.col("shard"), 32) + F.col("bin")).alias("sequence_id"), "offset")
    if derive is not None:
        pieces = pieces.withColumns(derive).drop("tokens")
    return (
        pieces.join(plan, "key", "left")
        .withColumn("sequence_id", F.coalesce("sequence_id", -F.col("key") - 1))
        .withColumn("offset", F.coalesce("offset", F.lit(0).cast("long")))
        .drop("key")
    )
