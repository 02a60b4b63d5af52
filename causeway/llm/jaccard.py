"""Exact Jaccard join on word shingles by a partitioned universe and the pigeonhole principle.

Sets fall into size bands. A band cuts the universe of shingle hashes into segments; sets of
Jaccard similarity t differ in at most H elements, so of any H + 1 segments at least one is
equal. Every set therefore indexes a subset of its segments: the H + 1 of least cost among
those that hold enough elements to be selective (``good``). The cost of a segment is the
posting list to expect, the count of its rarest element over all documents. Goodness and
cost depend on a segment's content alone, so the cheapest segment on which two linked sets
agree is among the H + 1 of both: what comes before it in either order differs. That is the
cheap allocation. A set that has too few good segments is given the dear one: all its segments
together with their one-deletion neighbourhoods, which survive one difference per segment.
Sets of one band meet there; a set near a band's upper end also goes to the next band.

Elements share counters, so a count is at least the true one; it tells costs only: other counts
make other posting lists, never other links.

Equal sets are one class and never paired. Signatures are grouped, each group links its
members to one of them, links are verified exactly on whole sets, and linked classes are
contracted. Groups that still hold several components then have the pairs across components
compared, large groups block by block, so that no link that joins two components is lost.

Defined cases: null, empty or blank texts have no shingles and link with nothing; repeated
rows are members of one class; null ids are carried along and never name a component unless
all its ids are null; ties in the choice of a representative go to the smaller hash, in that of
a row to the smaller id; texts of any length are shingled whole, about a megabyte at a time; an
empty table gives no rows; names of other columns don't matter, and :func:`one_of_each` keeps
all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.components import component_of

from .common import identity, written
from .shingles import mix, shingle_sets

BAND_RATIO = 1.5
#: Rounds of further stars before the pairs across components are taken one by one.
MAX_STARS = 2
#: Pairs per member from which on a group is compared block by block, and members of a block.
HEAVY = 32
BLOCK = 512
#: Rows that a driver-checked broadcast may have.
BROADCAST_ROWS = 1_000_000
#: Counters of shingles for the costs.
COUNTERS = 1 << 16


class Bands:
    """Size bands and their segments for a threshold of ``percent`` / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lows = [1]

    def most_apart(self, n: int) -> int:
        """Largest symmetric difference of a set of ``n`` and any set linked with it."""
        return (100 - self.percent) * (n + 100 * n // self.percent) // (100 + self.percent)

    def low(self, band: int) -> int:
        while len(self.lows) <= band:
            last = self.lows[-1]
            nxt = max(last + 1, int(last * BAND_RATIO))
            while self.most_apart(nxt - 1) == 0 and self.most_apart(nxt) == 0:
                nxt += 1
            self.lows.append(nxt)
        return self.lows[band]

    def of(self, n: int) -> list[int]:
        """The bands of a set of ``n``: its own, and the next if a linked set may be there."""
        band = 0
        while self.low(band + 1) <= n:
            band += 1
        own = [band]
        while 100 * n >= self.percent * self.low(own[-1] + 1):
            own.append(own[-1] + 1)
        return own

    def segments(self, band: int) -> tuple[int, int]:
        """Number of segments, and elements that make one good."""
        need = self.most_apart(self.low(band + 1) - 1) + 1
        if need == 1:
            return 1, 1
        return (need + 1, 1) if need <= 3 else (need + need // 10 + 2, 2)


@lru_cache
def bands_for(percent: int) -> Bands:
    return Bands(percent)


def counter_of(elements: np.ndarray) -> np.ndarray:
    return (mix(elements ^ np.uint64(0x5A3317)) % np.uint64(COUNTERS)).astype(np.int64)


def element_counts(docs: DataFrame, k: int, text_col: str) -> np.ndarray:
    """In how many documents the shingles of each counter occur, over all documents."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            held, n = [], 0
            for s in shingle_sets(batch.column(0), k):
                held.append(counter_of(s))
                n += len(s)
                if n > COUNTERS:
                    counts += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, n = [], 0
            if n:
                counts += np.bincount(np.concatenate(held), minlength=COUNTERS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used])], names=["at", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    out = np.zeros(COUNTERS, np.int64)
    for r in texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row per counter at most
        out[r["at"]] = r["n"]
    return out


def signatures(elements: np.ndarray, bands: Bands, counts: np.ndarray | None = None) -> np.ndarray:
    """Distinct 64-bit signatures of a set; linked sets share at least one.

    ``counts``: see :func:`element_counts`; it must be the same for all sets.
    """
    n, out = len(elements), []
    need = bands.most_apart(n) + 1
    spread = mix(elements ^ np.uint64(0xA5A5A5A5DEADBEEF))
    known = counts[counter_of(elements)] if counts is not None else np.zeros(n, np.int64)
    value = mix(elements + np.uint64(0x1234567))
    for band in bands.of(n):
        m, least = bands.segments(band)
        seg = (spread % np.uint64(m)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        count = np.bincount(seg, minlength=m)
        full = np.flatnonzero(count)
        sums = np.add.reduceat(value[order], (np.cumsum(count) - count)[full])
        tag = mix(full.astype(np.uint64) + np.uint64(band << 32))
        good = np.flatnonzero(count[full] >= least)
        if len(good) >= need:
            # Of equal cost, segments of more elements first, then in their order.
            rarest = np.minimum.reduceat(known[order], (np.cumsum(count) - count)[full])
            good = good[np.lexsort((-count[full][good], rarest[good]))[:need]]
            out.append(mix(sums[good] ^ tag[good]))
            continue
        # Every segment, and every segment without one of its elements.
        out.append(mix(sums ^ tag))
        within = np.repeat(np.arange(len(full)), count[full])
        several = count[full][within] > 1
        out.append(mix((sums[within] - value[order])[several] ^ tag[within][several]))
        if (count >= 2).sum() <= (need - 1) // 2:
            out.append(mix(np.array([band], np.uint64) ^ np.uint64(0xFA11BACC)))
    return np.unique(np.concatenate(out))


def _based(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, identity, number of shingles, class, signatures."""
    r1, r2 = identity(id_col, text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), r1.alias("r1"), r2.alias("r2"), F.col(text_col).cast("string").alias("text"))
    counts = docs.sparkSession.sparkContext.broadcast(element_counts(docs, k, text_col))  # half a megabyte

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bands = bands_for(percent)
        for batch in batches:
            sizes, classes, sigs = [], [], []
            for s in shingle_sets(batch.column(3), k):
                sizes.append(len(s))
                classes.append(int(mix(mix(s).sum(keepdims=True) + np.uint64(len(s)))[0].astype(np.int64)) if len(s) else None)
                sigs.append(signatures(s, bands, counts.value).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(sigs, pa.binary())],
                names=["doc_id", "r1", "r2", "n_shingles", "cls", "sigs"],
            )

    id_kind = docs.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {id_kind}, r1 long, r2 long, n_shingles long, cls long, sigs binary")


def _signature_rows(base: DataFrame) -> DataFrame:
    """(sig, cls), each once per partition of ``base``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            classes, sigs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            new = [i for i, c in enumerate(classes) if c is not None and not (c in seen or seen.add(c))]
            if new:
                rows = [np.frombuffer(sigs[i], np.int64) for i in new]
                cls = np.repeat(np.array([classes[i] for i in new], np.int64), [len(r) for r in rows])
                sig = np.concatenate(rows)
                for lo in range(0, len(sig), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(sig[lo : lo + (1 << 17)]), pa.array(cls[lo : lo + (1 << 17)])], names=["sig", "cls"])

    return base.select("cls", "sigs").mapInArrow(run, "sig long, cls long")


def _groups(rows: DataFrame) -> DataFrame:
    """(grp, a, b): each member b of a signature group with the group's first member a.

    Rows of one signature are together; equal groups within a partition are given once.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        sig, cls = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        # Most signatures stand alone; they go before the sort by both columns.
        order = np.argsort(sig, kind="stable")
        sig, cls = sig[order], cls[order]
        same = np.append(False, sig[1:] == sig[:-1])
        live = same | np.append(same[1:], False)
        sig, cls = sig[live], cls[live]
        order = np.lexsort((cls, sig))
        sig, cls = sig[order], cls[order]
        new = np.append(True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1]))[: len(sig)]
        sig, cls = sig[new], cls[new]
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)])
        size = np.diff(np.append(first, len(sig)))
        first, size = first[size > 1], size[size > 1]
        if not len(first):
            return
        place = np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        member = cls[place]
        begins = np.append(0, np.cumsum(size)[:-1])
        # Groups of the same members have the same name.
        name = mix(np.add.reduceat(mix(member.view(np.uint64)), begins) + size.astype(np.uint64))
        _, once = np.unique(name, return_index=True)
        pick = np.zeros(len(size), bool)
        pick[once] = True
        rows_of = np.repeat(pick, size)
        lead = np.repeat(member[begins], size)
        out = [np.repeat(name.view(np.int64), size)[rows_of], lead[rows_of], member[rows_of]]
        for lo in range(0, len(out[0]), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 17)]) for x in out], names=["grp", "a", "b"])

    return rows.mapInArrow(run, "grp long, a long, b long")


def _sets_of(docs: DataFrame, base: DataFrame, classes: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(cls, elements): the set of each wanted class, from one of its documents."""
    reps = written(base.join(classes, "cls").groupBy("cls").agg(F.min(F.struct("r1", "r2")).alias("r")).select("cls", F.col("r.r1").alias("r1"), F.col("r.r2").alias("r2")), "reps")
    r1, r2 = identity(id_col, text_col)
    slim = docs.select(r1.alias("r1"), r2.alias("r2"), F.col(text_col).cast("string").alias("text"))
    found = slim.join(F.broadcast(reps) if reps.count() <= BROADCAST_ROWS else reps, ["r1", "r2"]).select("cls", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = list(shingle_sets(batch.column(1), k))
            sketches = [parity_sketch(s).tolist() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "n", "sketch", "elements"]
            )

    return written(found.mapInArrow(run, "cls long, n long, sketch array<long>, elements binary").dropDuplicates(["cls"]), "sets")


def _across(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of heavy groups (grp, n, b, cb) that sizes and sketches don't rule out.

    Groups are cut into blocks of about ``BLOCK`` members, and every two blocks meet in one
    task of bounded size.
    """
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    # A pair that meets in several groups is given in the smallest of them only.
    mine = groups.groupBy("b").agg(F.sort_array(F.collect_set("grp")).alias("grps"))
    rows = groups.join(mine, "b").join(sets.select(F.col("cls").alias("b"), F.col("n").alias("size"), "sketch"), "b")
    rows = rows.select("grp", "grps", "b", "cb", "size", "sketch", n_blocks.alias("nb"), F.pmod(F.hash("b"), n_blocks).alias("i"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("grp", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "b", "cb", "size", "sketch", "grps")

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["i"] == key[1]], pdf[pdf["i"] == key[2]]
        sketch = lambda x: np.stack(x["sketch"].to_numpy()).astype(np.int64).view(np.uint64)
        out_a, out_b = [], []
        if len(left) and len(right):
            sr, nr, br, cr = sketch(right), right["size"].to_numpy(), right["b"].to_numpy(), right["cb"].to_numpy()
            gr = [frozenset(g) for g in right["grps"]]
            for row, n, x, c, g in zip(sketch(left), left["size"].to_numpy(), left["b"].to_numpy(), left["cb"].to_numpy(), left["grps"], strict=True):
                apart = np.bitwise_count(sr ^ row).sum(1).astype(np.int64)
                fit = (cr != c) & ((100 + percent) * apart <= (100 - percent) * (nr + n)) & (100 * np.minimum(nr, n) >= percent * np.maximum(nr, n))
                if key[1] == key[2]:
                    fit &= br > x
                mates = [i for i in np.flatnonzero(fit) if next(y for y in g if y in gr[i]) == key[0]]
                found = br[mates]
                out_a.append(np.minimum(found, x))
                out_b.append(np.maximum(found, x))
        return pd.DataFrame({"a": np.concatenate(out_a) if out_a else [], "b": np.concatenate(out_b) if out_b else []}).astype("int64")

    return rows.groupBy("grp", "lo", "hi").applyInPandas(meet, "a long, b long")


def _pair_counts(open_: DataFrame) -> DataFrame:
    """(grp, n, p): members, and ordered pairs across components, of every group."""
    return open_.groupBy("grp", "cb").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.sum("n").alias("n"), (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("p"))


def parity_sketch(elements: np.ndarray) -> np.ndarray:
    """512 parities: two sets differ in at least as many elements as their sketches in bits."""
    odd = np.bincount((mix(elements ^ np.uint64(0x77)) & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, counted exactly on whole sets.

    Sizes and parity sketches rule out most pairs before any set is moved.
    """
    small = lambda c: sets.select(F.col("cls").alias(c), F.col("n").alias("n" + c), F.col("sketch").alias("s" + c))
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    total = F.col("na") + F.col("nb")
    sizes_fit = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    pairs = pairs.join(small("a"), "a").join(small("b"), "b").where(sizes_fit & ((100 + percent) * apart <= (100 - percent) * total)).select("a", "b")
    joined = pairs.join(sets.select(F.col("cls").alias("a"), F.col("elements").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("elements").alias("sb")), "b")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b, sa, sb = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for i, (x, y) in enumerate(zip(sa, sb, strict=True)):
                u, v = len(x) // 8, len(y) // 8
                if 100 * min(u, v) < percent * max(u, v):
                    continue
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (u + v - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, r1, r2, n_shingles, cls, component, component_id) for every document.

    Documents link when 100 * |A and B| >= percent * |A or B|. ``component_id`` is the
    smallest id that links reach, the document's own included; r1 and r2 identify id and text.
    """
    base = written(_based(docs, k, percent, id_col, text_col), "base")
    groups = written(_groups(_signature_rows(base).repartition("sig")), "groups")
    star = groups.where("a <> b").select("a", "b").distinct()
    star = written(star, "star")
    classes = star.select(F.col("a").alias("cls")).union(star.select("b")).distinct()
    sets = _sets_of(docs, base, classes, k, id_col, text_col)
    links = written(_verified(star, sets, percent), "links")
    tested = star
    joined = written(component_of(links), "joined")
    # Groups that hold more than one component: their other pairs may still link. Further
    # stars around other members come first, since each may connect a whole group; what is
    # then still apart is verified pair by pair.
    members = written(groups.select("grp", "b").distinct(), "members")
    n_members = members.count()
    for k_round in range(MAX_STARS + 1):
        lab = joined.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        tagged = members.join(lab, "b", "left").withColumn("cb", F.coalesce("cb", "b"))
        mixed = tagged.groupBy("grp").agg(F.min("cb").alias("lo"), F.max("cb").alias("hi"), F.min_by(F.struct(F.col("b").alias("a"), F.col("cb").alias("ca")), F.xxhash64(F.lit(k_round), "b")).alias("lead")).where("lo <> hi")
        open_ = written(tagged.join(mixed.select("grp", "lead"), "grp"), "open")
        left = _pair_counts(open_).agg(F.sum("p")).first()[0] or 0
        if not left:
            break
        last = k_round == MAX_STARS or left <= 2 * n_members
        if last:
            sized = written(open_.select("grp", "b", "cb").join(_pair_counts(open_), "grp"), "sized")
            light = sized.where(F.col("p") <= HEAVY * F.col("n"))
            other = light.select("grp", F.col("b").alias("a"), F.col("cb").alias("ca"))
            pairs = light.join(other, "grp").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))).select("a", "b")
            pairs = pairs.unionByName(_across(sized.where(F.col("p") > HEAVY * F.col("n")), sets, percent))
        else:
            far = open_.where(F.col("lead.ca") != F.col("cb"))
            pairs = far.select(F.least("lead.a", "b").alias("a"), F.greatest("lead.a", "b").alias("b"))
        pairs = written(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        more = written(_verified(pairs, sets, percent), "more")
        if not more.isEmpty():
            # What is joined already is a star; only the new links change it.
            known = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
            joined = written(component_of(known.unionByName(more)), "joined")
        if last:
            break
        tested = tested.unionByName(pairs)
    final = joined
    ids = base.select("doc_id", "r1", "r2", "n_shingles", "cls").join(final.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    # The smallest id per component: partial minima travel, not the documents.
    names = written(ids.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")), "names")
    return ids.join(names, "component", "left").withColumn("component_id", F.coalesce("least", "doc_id")).drop("least")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of linked documents, the smallest id."""
    found = jaccard_components(docs, k, percent, id_col, text_col)
    place = F.coalesce(F.col("component"), F.xxhash64("r1", "r2"))
    best = found.withColumn("place", place).groupBy("place").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "r1", "r2")).alias("b"))
    keep = best.select(F.col("b.r1").alias("__cw_r1"), F.col("b.r2").alias("__cw_r2")).distinct()
    r1, r2 = identity(id_col, text_col)
    kept = docs.withColumns({"__cw_r1": r1, "__cw_r2": r2}).join(keep, ["__cw_r1", "__cw_r2"], "left_semi")
    # Rows that are equal in id and text are copies of each other too.
    return kept.dropDuplicates(["__cw_r1", "__cw_r2"]).drop("__cw_r1", "__cw_r2")
