"""Removal of byte strings that an earlier document has, by sorting suffixes.

A byte goes if a ``length``-byte string that covers it also starts in a document with a
smaller id. Only suffixes that can matter are sorted:

1. Every window of ``length`` bytes has an anchor, the smallest hash of a ``GRAM``-byte
   string in it; equal windows have equal anchors. The anchors of each document are dealt
   by hash, and those found in at least two documents are shared.
2. Documents send the surroundings of their shared anchors to the task of the anchor. Equal
   surroundings are one entry with its smallest id.
3. There, deep-shallow sorting orders the surroundings of each anchor, and then the suffixes
   that start at its windows: multikey quicksort by machine words down to ``SHALLOW`` bytes,
   then blind tries for the groups that still agree. Equal strings end up side by side, the
   smallest id first; that id decides.

Texts that are whole copies of another leave before that: all but the smallest id lose every
byte. Records travel packed in arrays, so a frequent anchor costs bytes, not rows. Anchors are
dealt into parts of about ``PART_BYTES`` of text, whatever the input, and a task takes its
parts one after the other, so its memory follows the part.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; matches never
cross documents; documents of equal id are not earlier than each other; null ids come last;
texts of any length are read whole, in slices that overlap by a window; an empty table gives
no rows; other columns pass through, and one with the name of an output column, whatever its
case, gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sealed, identity, shuffle_width, written
from .shingles import mix, text_buffers

GRAM = 24
SHALLOW = 24
SLICE = 1 << 20
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)
_UP = np.cumprod(np.append(np.uint64(1), np.full(SLICE, _BASE, np.uint64)), dtype=np.uint64)
_DOWN = np.cumprod(np.append(np.uint64(1), np.full(SLICE, np.uint64(pow(int(_BASE), -1, 2**64)), np.uint64)), dtype=np.uint64)
_LAST_ID = np.iinfo(np.int64).max
#: Bytes of text whose anchors make a part.
PART_BYTES = 4 << 20
#: Bytes of text whose anchors are found at once.
SLICE_BYTES = 8 << 20
#: Rows of three numbers that a driver-checked broadcast may have.
BROADCAST_ROWS = 1_000_000
#: Strings that a blind trie takes; larger groups are split by quicksort first.
BLIND = 4096


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    sums = np.cumsum(np.append(np.uint64(0), _TABLE[raw] * _UP[: len(raw)]), dtype=np.uint64)
    return mix((sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(raw) - GRAM + 1])


def _window_minima(x: np.ndarray, width: int) -> np.ndarray:
    have, n = 1, len(x)
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: n - width + 1], x[rest : rest + n - width + 1]) if rest else x


def anchor_runs(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, anchor, first window, last window): windows in a row with one anchor.

    Positions count from the start of the text.
    """
    width, out = length - GRAM + 1, []
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo + length <= end:
        hi = min(end, lo + SLICE)
        grams = _gram_hashes(raw[lo:hi])
        # Ties go to the leftmost, which depends on the window's bytes alone.
        packed = (grams & ~np.uint64(SLICE - 1)) | np.arange(len(grams), dtype=np.uint64)
        place = (_window_minima(packed, width) & np.uint64(SLICE - 1)).astype(np.int64)
        start = np.arange(len(place), dtype=np.int64) + lo
        text = np.searchsorted(offsets, start, side="right") - 1
        inside = start + length <= offsets[text + 1]
        start, text, place = start[inside], text[inside], place[inside]
        if len(start):
            new = np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(start)) - 1
            base = offsets[text[first]]
            out.append((grams[place[first]], text[first], place[first] + lo - base, start[first] - base, start[last] - base))
        if hi == end:
            break
        lo = hi - length + 1
    if not out:
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e, e, e
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class BlindTrie:
    """Orders byte strings that share a prefix, looking at branching positions only.

    Inserting walks down by single bytes without comparing (blindly), compares once with the
    leaf that it reaches, and branches where the two differ. Equal strings share a leaf.
    """

    def __init__(self) -> None:
        self.root: list | None = None

    def insert(self, text: bytes, item: int) -> None:
        if self.root is None:
            self.root = [None, text, [item]]
            return
        node = self.root
        while node[0] is not None:
            kids = node[1]
            node = kids.get(text[node[0]]) or next(iter(kids.values()))
        other = node[1]
        if other == text:
            node[2].append(item)
            return
        at = next(i for i, (x, y) in enumerate(zip(other, text, strict=True)) if x != y)
        above, node = None, self.root
        while node[0] is not None and node[0] < at:
            above, node = node, node[1][text[node[0]]]
        leaf = [None, text, [item]]
        if node[0] == at:
            node[1][text[at]] = leaf
            return
        branch = [at, {other[at]: node, text[at]: leaf}]
        if above is None:
            self.root = branch
        else:
            above[1][text[above[0]]] = branch

    def runs(self) -> Iterator[list[int]]:
        """Items in order of their strings; those of equal strings together."""
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[0] is None:
                yield node[2]
            else:
                todo.extend(kid for _, kid in sorted(node[1].items(), reverse=True))


def deep_shallow(strings: np.ndarray, groups: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``strings`` [n, depth] ordered within their groups, and flags of those unlike the row before.

    Multikey quicksort: all open segments are parted at once around the median of three words,
    the equal ones go on with the next word. From ``SHALLOW`` bytes on, a segment of one
    string is done, and one of at most ``BLIND`` rows is ordered by a blind trie. Rows of equal
    strings are in the order of their ids.
    """
    n, depth = strings.shape
    padded = np.zeros((n, -(-depth // 8) * 8), np.uint8)
    padded[:, :depth] = strings
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((ids, groups))
    if not n:
        return order, np.zeros(0, bool)
    new = np.append(True, groups[order[1:]] != groups[order[:-1]])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    level = np.zeros(len(start), np.int64)
    while True:
        # Segments of one row, or whose words are used up, are in order.
        live = (size > 1) & (level < words.shape[1])
        start, size, level = start[live], size[live], level[live]
        deep = np.flatnonzero(level * 8 >= SHALLOW)
        if len(deep):
            at = _ranges(start[deep], size[deep])
            head = np.repeat(order[start[deep]], size[deep])
            alike = np.logical_and.reduceat((words[order[at]] == words[head]).all(1), np.cumsum(size[deep]) - size[deep])
            blind = ~alike & (size[deep] <= BLIND)
            for g in deep[blind]:
                rows = order[start[g] : start[g] + size[g]]
                trie = BlindTrie()
                for i in rows.tolist():
                    trie.insert(strings[i, 8 * level[g] :].tobytes(), i)
                order[start[g] : start[g] + size[g]] = [i for run in trie.runs() for i in run]
            done = np.zeros(len(start), bool)
            done[deep[alike | blind]] = True
            start, size, level = start[~done], size[~done], level[~done]
        if not len(start):
            break
        at = _ranges(start, size)
        seg = np.repeat(np.arange(len(start)), size)
        key = words[order[at], level[seg]]
        first = np.cumsum(size) - size
        three = np.sort(np.stack([key[first], key[first + size // 2], key[first + size - 1]]), axis=0)
        pivot = three[1][seg]
        side = (key >= pivot).astype(np.int8) + (key > pivot)
        # A stable partition of every segment into less, equal, greater.
        counts = np.stack([np.add.reduceat((side == c).astype(np.int64), first) for c in range(3)])
        place = np.empty(len(at), np.int64)
        offset = np.zeros(len(start), np.int64)
        for c in range(3):
            mine = side == c
            rank = np.cumsum(mine) - 1
            before = np.cumsum(counts[c]) - counts[c]
            place[mine] = (start + offset - before)[seg[mine]] + rank[mine]
            offset = offset + counts[c]
        order[place] = order[at]
        start = np.concatenate([start, start + counts[0], start + counts[0] + counts[1]])
        size = counts.ravel()
        level = np.concatenate([level, level + 1, level])
    return order, np.append(True, (groups[order[1:]] != groups[order[:-1]]) | (words[order[1:]] != words[order[:-1]]).any(1))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every segment, one segment after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def earlier_windows(context: np.ndarray, lo: np.ndarray, hi: np.ndarray, hashes: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """[n, width] flags: the window that starts there is also in a document with a smaller id.

    ``context`` [n, width - 1 + length]: the bytes around an anchor, which begins at byte
    width - 1; windows ``lo`` to ``hi`` (starts within the context) belong to the anchor.
    """
    n, width = len(context), length - GRAM + 1
    flags = np.zeros((n, width), bool)
    if not n:
        return flags
    by = np.lexsort((hi, lo, hashes))
    number = np.empty(n, np.int64)
    number[by] = np.cumsum(np.append(False, (hashes[by[1:]] != hashes[by[:-1]]) | (lo[by[1:]] != lo[by[:-1]]) | (hi[by[1:]] != hi[by[:-1]])))
    # Equal surroundings are one entry; all its documents but the smallest lose every window.
    order, fresh = deep_shallow(context, number, ids)
    entry = np.cumsum(fresh) - 1
    reps = order[fresh]
    inside = lambda rows: (np.arange(width) >= lo[rows][:, None]) & (np.arange(width) <= hi[rows][:, None])
    later = ids[order] > ids[reps][entry]
    flags[order[later]] = inside(order[later])
    # Entries of anchors with several surroundings: their windows are sorted.
    per_hash = np.unique(hashes[reps], return_inverse=True)[1]
    several = np.bincount(per_hash)[per_hash] > 1
    reps_of = reps[several][np.argsort(per_hash[several], kind="stable")]
    hits = np.zeros((n, width), bool)
    cuts = np.append(np.flatnonzero(np.append(True, hashes[reps_of][1:] != hashes[reps_of][:-1])), len(reps_of)) if len(reps_of) else np.zeros(1, int)
    done = 0
    while done < len(reps_of):
        # Whole hash groups, some 40,000 entries at a time.
        nxt = int(cuts[min(np.searchsorted(cuts, done + 40_000), len(cuts) - 1)])
        part = reps_of[done:nxt]
        row, col = np.nonzero(inside(part))
        strings = np.lib.stride_tricks.sliding_window_view(context[part], length, axis=1)[row, col]
        groups = np.unique(hashes[part], return_inverse=True)[1][row] * width + col
        own = ids[part][row]
        sorted_, new = deep_shallow(strings, groups, own)
        least = np.empty(len(own), np.int64)
        least[sorted_] = own[sorted_[new]][np.cumsum(new) - 1]  # the first of equal strings has the smallest id
        hits[part[row], col] = least < own
        done = nxt
    # What the first document of an entry loses, the others of its id lose too.
    flags[order] |= hits[reps][entry] & inside(order)
    return flags


def _parts(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the records by the part of their hash, and where each part begins."""
    part = (mix(hashes) % np.uint64(n)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(n + 1))


SHORT = np.uint64((1 << 40) - 1)


def _short(hashes: np.ndarray, n: int) -> np.ndarray:
    """Part and 40 bits of a hash: enough to find candidates, which are compared in full later."""
    return (mix(hashes) % np.uint64(n) << np.uint64(40)) | (hashes & SHORT)


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(x: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def squeezed(text: Column) -> Column:
    """A text's UTF-8 bytes under zstd, null as empty: what travels when whole texts must."""

    @F.arrow_udf("binary")
    def squeeze(texts: pa.Array) -> pa.Array:
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        return pa.array([c.compress((t.as_py() or "").encode()) for t in texts], pa.binary())

    return squeeze(text)


def _unsqueezed(packed: pa.Array) -> pa.Array:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return pa.array([d.decompress(z) for z in packed.to_pylist()], pa.large_binary())


def _ids(column) -> np.ndarray:
    return column.fill_null(_LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(batches: Iterator, column: int, limit: int) -> Iterator:
    """The rows of the batches, about ``limit`` bytes of a column at a time: work arrays are several times as large."""
    for batch in batches:
        step = max(1, int(batch.num_rows * limit / max(1, batch.column(column).nbytes)))
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


def _one_part_at_a_time(batches: Iterator) -> Iterator[tuple[int, list]]:
    """(part, its rows without the part's number) of batches that are sorted by their first column."""
    part, rows = None, []
    for batch in batches:
        for p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part and rows:
                yield part, rows
                rows = []
            part = p
            rows.append(row)
    if rows:
        yield part, rows


def removed_runs(docs: DataFrame, length: int = 50, id_col: str | Column = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """(r1, r2, runs): maximal removed runs (start, end) in bytes, end exclusive, of documents that lose any."""
    r1, r2 = identity(id_col, text_col)
    of = lambda c: F.col(c) if isinstance(c, str) else c
    slim = docs.select(of(id_col).cast("long").alias("doc_id"), r1.alias("r1"), r2.alias("r2"), of(text_col).cast("string").alias("text"))
    # Whole copies go first: only the smallest id of a text can be the earlier one elsewhere.
    t1, t2 = F.xxhash64("text"), F.xxhash64(F.lit(3), F.col("text"))
    slim = slim.withColumns({"t1": t1, "t2": t2})
    texts = slim.where("text is not null").groupBy("t1", "t2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first(F.octet_length("text")).alias("bytes"))
    texts = written(texts, "texts")
    total = texts.agg(F.sum("bytes")).first()[0] or 0
    first_of = texts.where("n > 1").select("t1", "t2", "first_id")
    slim = slim.join(F.broadcast(first_of) if first_of.count() <= BROADCAST_ROWS else first_of, ["t1", "t2"], "left").drop("t1", "t2")
    is_copy = F.coalesce(F.coalesce("doc_id", F.lit(_LAST_ID)) > F.col("first_id"), F.lit(False))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end")))
    copies = slim.where(is_copy & (F.octet_length("text") >= length)).select("r1", "r2", whole.alias("runs"))
    slim = slim.where(~is_copy).select("doc_id", "r1", "r2", "text")
    n_tasks = 2 * shuffle_width(docs.sparkSession)
    n_parts = max(n_tasks, -(-total // PART_BYTES))
    width = length - GRAM + 1

    def anchors(batches: Iterator) -> Iterator:
        for batch in _slices(batches, 2, SLICE_BYTES):
            hashes, text, *_ = anchor_runs(*text_buffers(batch.column(2)), length)
            # A document counts once for each anchor.
            order = np.lexsort((hashes, text))
            hashes, text = hashes[order], text[order]
            once = np.append(True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1]))[: len(hashes)]
            hashes, text = hashes[once], text[once]
            order, begin = _parts(hashes, n_parts)
            ids, keys = _ids(batch.column(0)), batch.column(1).to_numpy()
            rows: tuple[list, ...] = ([], [], [], [], [])
            for p in range(n_parts):
                own = order[begin[p] : begin[p + 1]]
                if len(own):
                    who, number = np.unique(text[own], return_inverse=True)
                    for column, value in zip(rows, (p, hashes[own].view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), _pack(np.diff(number, prepend=0).astype("<u4")), ids[who].tobytes(), keys[who].tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *[pa.array(c, pa.binary()) for c in rows[1:]]], names=["part", "hashes", "number", "ids", "keys"])

    def shared(batches: Iterator) -> Iterator:
        for p, rows in _one_part_at_a_time(batches):
            found = []
            for cols in rows:
                number = np.cumsum(_unpack(cols[1], np.uint32))
                low = np.zeros((len(number), 8), np.uint8)
                low[:, :5] = np.frombuffer(cols[0], np.uint8).reshape(-1, 5)
                found.append((low.view(np.uint64).ravel() | np.uint64(p << 40), np.frombuffer(cols[2], np.int64)[number], np.frombuffer(cols[3], np.int64)[number]))
            hashes, ids, keys = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(hashes, kind="stable")
            hashes, ids, keys = hashes[order], ids[order], keys[order]
            first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            size = np.diff(np.append(first, len(hashes)))
            wanted = np.repeat(np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first), size)
            hashes, keys = hashes[wanted], keys[wanted]
            if not len(hashes):
                continue
            order = np.argsort(keys, kind="stable")
            hashes, keys = hashes[order], keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            cuts = np.append(first, len(keys))
            lists = [hashes[cuts[i] : cuts[i + 1]].tobytes() for i in range(len(first))]
            yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(lists, pa.binary())], names=["r1", "shared"])

    # Small Arrow batches bound the packed arrays, whatever the length of the texts.
    packed = slim.select("doc_id", "r1", "text").mapInArrow(anchors, "part long, hashes binary, number binary, ids binary, keys binary")
    lists = packed.repartitionById(n_tasks, F.col("part").cast("int")).sortWithinPartitions("part").mapInArrow(shared, "r1 long, shared binary")
    per_doc = written(lists, "shared").groupBy("r1").agg(F.collect_list("shared").alias("shared"))

    def surroundings(batches: Iterator) -> Iterator:
        for batch in _slices(batches, 3, SLICE_BYTES // 2):
            raw, offsets = text_buffers(_unsqueezed(batch.column(3)).cast(pa.large_string()))
            hashes, text, anchor, lo, hi = anchor_runs(raw, offsets, length)
            short = _short(hashes, n_parts)
            wanted = np.zeros(len(hashes), bool)
            begin = np.searchsorted(text, np.arange(batch.num_rows + 1))
            for i, found in enumerate(batch.column(4).to_pylist()):
                own = slice(begin[i], begin[i + 1])
                wanted[own] = np.isin(short[own], np.concatenate([np.frombuffer(x, np.uint64) for x in found]))
            hashes, text, anchor, lo, hi = (x[wanted] for x in (hashes, text, anchor, lo, hi))
            # Byte j of a record is byte anchor - (width - 1) + j of the text; beyond its ends, 0.
            rel = anchor - (width - 1)
            order, begin = _parts(hashes, n_parts)
            ids, k1, k2 = _ids(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            size = np.diff(offsets)
            rows: tuple[list, ...] = ([], [])
            for p in range(n_parts):
                own = order[begin[p] : begin[p + 1]]
                if not len(own):
                    continue
                at = rel[own][:, None] + np.arange(width - 1 + length)
                ok = (at >= 0) & (at < size[text[own]][:, None])
                context = np.where(ok, raw[np.where(ok, at + offsets[text[own]][:, None], offsets[0])], 0).astype(np.uint8)
                rows[0].append(p)
                rows[1].append([_pack(context), hashes[own].tobytes(), rel[own].tobytes(), (lo[own] - rel[own]).astype(np.uint8).tobytes(), (hi[own] - rel[own]).astype(np.uint8).tobytes(), ids[text[own]].tobytes(), k1[text[own]].tobytes(), k2[text[own]].tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.list_(pa.binary()))], names=["part", "record"])

    def sorted_runs(batches: Iterator) -> Iterator:
        kinds = [np.uint8, np.uint64, np.int64, np.uint8, np.uint8, np.int64, np.int64, np.int64]
        for _, rows in _one_part_at_a_time(batches):
            found = [[_unpack(record[0], np.uint8), *[np.frombuffer(x, kind) for x, kind in zip(record[1:], kinds[1:], strict=True)]] for (record,) in rows]
            context, hashes, rel, lo, hi, ids, k1, k2 = (np.concatenate(x) for x in zip(*found, strict=True))
            del found
            context = context.reshape(len(hashes), width - 1 + length)
            flags = earlier_windows(context, lo.astype(np.int64), hi.astype(np.int64), hashes, ids, length)
            edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, begin = np.nonzero(edge == 1)
            _, stop = np.nonzero(edge == -1)
            out = [k1[row], k2[row], rel[row] + begin, rel[row] + stop - 1 + length]
            for at in range(0, len(row), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 17)]) for x in out], names=["r1", "r2", "start", "end"])

    near = slim.withColumn("text", squeezed(F.col("text"))).join(per_doc, "r1").select("doc_id", "r1", "r2", "text", "shared")
    records = near.mapInArrow(surroundings, "part long, record array<binary>").repartitionById(n_tasks, F.col("part").cast("int")).sortWithinPartitions("part")
    pieces = written(records.mapInArrow(sorted_runs, "r1 long, r2 long, start long, end long").distinct(), "pieces")
    # Overlapping pieces of a document become maximal runs; adjacent ones count as one.
    ordered = F.sort_array(F.collect_list(F.struct("start", "end")))
    merged = pieces.groupBy("r1", "r2").agg(ordered.alias("p"))

    def merge(batches: Iterator) -> Iterator:
        for pdf in batches:
            runs = []
            for found in pdf["p"]:
                own: list[list[int]] = []
                for x in found:
                    if own and x["start"] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], x["end"])
                    else:
                        own.append([x["start"], x["end"]])
                runs.append([{"start": a, "end": b} for a, b in own])
            yield pdf[["r1", "r2"]].assign(runs=runs)

    partial = merged.mapInPandas(merge, "r1 long, r2 long, runs array<struct<start: long, end: long>>")
    return written(partial.unionByName(copies).dropDuplicates(["r1", "r2"]), "runs")


def drop_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``removed`` (runs of bytes, original offsets; null if there are none), ``n_bytes`` and ``kept_bytes`` (binary)."""
    own = Sealed(docs)
    ident, text = own[id_col], own[text_col].cast("string")
    runs = removed_runs(own.df, length, ident, text)
    r1, r2 = identity(ident, text)
    # The texts travel to their runs under zstd; they are the bulk of that shuffle.
    keyed = own.df.withColumns({"r1": r1, "r2": r2, "no_text": text.isNull(), "z": squeezed(text)}).drop(own[text_col])
    joined = keyed.join(runs.hint("merge"), ["r1", "r2"], "left")

    @F.arrow_udf("binary")
    def whole(packed: pa.Array) -> pa.Array:
        return _unsqueezed(packed).cast(pa.binary())

    @F.arrow_udf("struct<n: long, kept: binary>")
    def kept(packed: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for raw, own_runs in zip(_unsqueezed(packed).to_pylist(), found.to_pylist(), strict=True):
            parts, at = [], 0
            for x in own_runs or []:
                parts.append(raw[at : x["start"]])
                at = x["end"]
            out.append({"n": len(raw), "kept": b"".join([*parts, raw[at:]]) if parts else raw})
        return pa.array(out, pa.struct([("n", pa.int64()), ("kept", pa.binary())]))

    back = F.when(~F.col("no_text"), F.decode(whole(F.col("z")), "UTF-8")).cast(own.kind(text_col))
    done = joined.withColumn("made", kept(F.col("z"), F.col("runs"))).withColumn(own.at(text_col), back)
    return own.back(done, {"removed": F.col("runs"), "n_bytes": F.col("made.n"), "kept_bytes": F.col("made.kept")})
