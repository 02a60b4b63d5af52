"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong to).
A flow network routes words from patterns to sources: a pattern's first pass over its words
costs nothing, every further pass costs one more than the one before (convex repetition
cost), and each source takes up to its target. Its size follows the number of patterns and
sources, never the documents. The flow of a pattern then becomes whole passes over its
documents plus a last partial pass in seeded order.

The seeded order is the order of md5(seed, id). Sums by the leading digits of that digest
find the place where the partial pass ends, so that no pattern is ever sorted in one task;
what is still open then goes to the one further document that fits it best.

Defined cases: null text has size 0; a null source is a source of its own, ordered last;
repeated rows are separate documents that share one place in the order, and are taken
together; equal digests are ordered by id, then size; texts of any length count whole; a table
without words takes nothing; an empty table gives no rows; in :func:`mix` a column with the
name of an output column, whatever its case, gives way to it, while :func:`mixed_rows` keeps
all columns.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sealed, words, written

MAX_PATTERNS = 200_000
#: Bytes of a table with one row for each pattern that may be broadcast.
BROADCAST_BYTES = 16 << 20


def water_fill(sizes: list[int], weights: list[int], percent: int, cap: int) -> list[Fraction]:
    """Shares of ``percent`` % of all sizes by weight; none above ``cap`` times its size, the excess reshared by weight."""
    total, open_ = Fraction(percent * sum(sizes), 100), set(range(len(sizes)))
    shares = [Fraction(0)] * len(sizes)
    while open_:
        left, weight = total - sum(s for i, s in enumerate(shares) if i not in open_), sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] > weight * cap * sizes[i]}
        for i in open_:
            shares[i] = Fraction(cap * sizes[i]) if i in over else left * weights[i] / weight
        if not over:
            break
        open_ -= over
    return shares


def route(capacity: dict[int, int], members: dict[int, list[int]], targets: list[int], passes: int) -> dict[int, int]:
    """Words taken from each pattern, by successive shortest paths.

    Pattern p can send ``capacity[p]`` words in each of ``passes`` passes, pass k at cost k,
    to its sources. Costs are small whole numbers, so all flow of one distance is found
    before the next distance.
    """
    flow: dict[tuple[int, int], int] = {(p, s): 0 for p, found in members.items() for s in found}
    sent = dict.fromkeys(members, 0)
    room = list(targets)
    patterns_of: dict[int, list[int]] = {}
    for p, found in members.items():
        for s in found:
            patterns_of.setdefault(s, []).append(p)

    def marginal(p: int) -> int | None:
        """Cost of the next word of p; None if all passes are used."""
        return None if not capacity[p] or sent[p] >= passes * capacity[p] else sent[p] // capacity[p]

    queue = [(0, p) for p in sorted(members)]
    heapq.heapify(queue)
    while queue:
        cost, start = heapq.heappop(queue)
        now = marginal(start)
        if now is None:
            continue
        if now > cost:
            heapq.heappush(queue, (now, start))
            continue
        # A path start -> source -> (pattern that gives up flow there) -> source ... with room.
        parent: dict[tuple[str, int], tuple[str, int] | None] = {("p", start): None}
        todo, end = [("p", start)], None
        while todo and end is None:
            nxt = []
            for kind, x in todo:
                if kind == "p":
                    for s in members[x]:
                        if ("s", s) not in parent:
                            parent["s", s] = (kind, x)
                            nxt.append(("s", s))
                            if room[s] > 0:
                                end = ("s", s)
                                break
                else:
                    for p in patterns_of[x]:
                        if flow[p, x] > 0 and ("p", p) not in parent:
                            parent["p", p] = (kind, x)
                            nxt.append(("p", p))
                if end is not None:
                    break
            todo = nxt
        if end is None:
            continue  # nothing that this pattern reaches has room: no later word of it fits
        path = [end]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        path.reverse()
        amount = min(room[end[1]], (cost + 1) * capacity[start] - sent[start])
        for a, b in zip(path, path[1:]):
            if a[0] == "s":
                amount = min(amount, flow[b[1], a[1]])
        for a, b in zip(path, path[1:]):
            if a[0] == "p":
                flow[a[1], b[1]] += amount
            else:
                flow[b[1], a[1]] -= amount
        room[end[1]] -= amount
        sent[start] += amount
        heapq.heappush(queue, (cost, start))
    return sent


def _digest(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def _taken(own: Sealed, weights: list[int], percent: int, max_repeat: int, seed: int, id_col: str, text_col: str, sources_col: str) -> tuple[DataFrame, Column]:
    """The sealed rows with size, source_size and target, and how often each is taken."""
    spark: SparkSession = own.df.sparkSession
    ident, text, sources = own[id_col], own[text_col].cast("string"), own[sources_col]
    pattern = F.array_sort(F.array_distinct(sources)) if isinstance(own.kind(sources_col), T.ArrayType) else F.array(sources.cast("string"))
    # Patterns meet by their text form; null keeps a name that no source has.
    key = F.to_json(F.struct(F.coalesce(pattern, F.array(F.lit(None).cast("string"))).alias("s")), {"ignoreNullFields": "false"})
    # The counted sizes are used three times; the texts stay where they are.
    sized = own.df.withColumns({"key": key, "digest": _digest(ident, seed), "size": F.size(words(text)).cast("long")})
    slim = written(sized.select(ident.alias("id"), "key", "digest", "size"), "sizes")
    bucket = F.substring("digest", 1, 3)
    sums = written(slim.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("size")), "sums")
    per_pattern = sums.groupBy("key").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(per_pattern) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: merge rare ones first")
    # A row for each pattern: beside documents such a table is broadcast if it is small, so
    # that the documents of one pattern don't meet in one task.
    small = sum(len(r["key"]) + 256 for r in per_pattern) <= BROADCAST_BYTES
    beside = F.broadcast if small else lambda df: df
    plan = plan_mix({r["key"]: int(r["size"] or 0) for r in per_pattern}, list(weights), percent, max_repeat)
    plan_df = spark.createDataFrame([(k, rest) for k, (_, _, _, rest) in plan.items()], "key string, rest long")
    # Buckets in digest order: the partial pass takes whole buckets, then part of one.
    before = F.sum("size").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    edges = sums.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))).join(beside(plan_df), "key")
    edge = edges.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest"))).select("key", "bucket", "before", "rest")
    # Only the documents of one bucket per pattern are ordered among themselves.
    tied = slim.withColumn("bucket", bucket).join(beside(edge), ["key", "bucket"])
    run = F.sum("size").over(W.partitionBy("key").orderBy("digest", "id", "size"))  # equal rows go together
    chosen = tied.withColumn("until", F.col("before") + run).where(F.col("until") <= F.col("rest"))
    cut = chosen.groupBy("key").agg(F.max(F.struct("digest", "id", "size")).alias("last"), F.max("until").alias("until"))
    cut = edge.join(cut, "key", "left").select("key", "bucket", "last", F.coalesce("until", "before").alias("until"))
    ends = {r["key"]: r for r in cut.collect()}  # a row per pattern
    rows = []
    for k, (source_size, target, passes, rest) in plan.items():
        e = ends.get(k)
        last = (e["last"]["digest"], e["last"]["id"], e["last"]["size"]) if e and e["last"] else (None, None, None)
        rows.append((k, source_size, target, passes, rest - e["until"] if e else 0, e["bucket"] if e else None, *last))
    final = spark.createDataFrame(rows, f"key string, source_size long, target double, passes long, gap long, last_bucket string, last_digest string, last_id {own.kind(id_col).simpleString()}, last_size long")

    def in_prefix(x: Column) -> Column:
        """Whether the partial pass holds the document: a whole bucket, or up to the cut in the last."""
        place = F.struct(F.col("digest"), x.alias("id"), F.col("size"))
        limit = F.struct(F.col("last_digest").alias("digest"), F.col("last_id").alias("id"), F.col("last_size").alias("size"))
        edge_part = (bucket == F.col("last_bucket")) & F.col("last_digest").isNotNull() & (place <= limit)
        return F.col("last_bucket").isNotNull() & ((bucket < F.col("last_bucket")) | edge_part)

    # What the cut leaves open is filled by the one further document that fits it best.
    miss = F.abs(F.col("size") - F.col("gap"))
    spare = slim.join(beside(final), "key").where((F.col("gap") > 0) & (F.col("size") > 0) & ~in_prefix(F.col("id")) & (miss < F.col("gap")))
    best = spare.groupBy("key").agg(F.min(F.struct(miss.alias("miss"), "digest", "id", "size")).alias("b"))
    fill = best.select("key", F.col("b.digest").alias("fill_digest"), F.col("b.id").alias("fill_id"), F.col("b.size").alias("fill_size"))
    final = written(final.join(fill, "key", "left"), "mix")
    joined = sized.join(beside(final), "key", "left")
    filler = (F.col("digest") == F.col("fill_digest")) & ident.eqNullSafe(F.col("fill_id")) & (F.col("size") == F.col("fill_size"))
    extra = F.when(in_prefix(ident) | F.coalesce(filler, F.lit(False)), 1).otherwise(0)
    return joined, F.col("passes") + extra


def mix(docs: DataFrame, weights: list[int] = (3, 1, 2), percent: int = 150, max_repeat: int = 2, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", sources_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target and taken (words, repeats counted).

    ``sources_col`` holds one source, or an array of them for documents that belong to
    several. For such documents source_size and target are those of the first of their
    sources by code point.
    """
    own = Sealed(docs)
    joined, times = _taken(own, weights, percent, max_repeat, seed, id_col, text_col, sources_col)
    taken = (F.col("size") * times).cast("long")
    return own.back(joined, {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": taken})


def plan_mix(sizes: dict[str, int], weights: list[int], percent: int, max_repeat: int) -> dict[str, tuple[int, float, int, int]]:
    """For each pattern: its first source's size and target, whole passes, words of the partial pass."""
    import json

    keys = sorted(sizes)
    sets = {k: json.loads(k)["s"] or [None] for k in keys}
    names = sorted({s for found in sets.values() for s in found}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    of_source = _source_sizes(sizes, sets, place)
    used = [weights[i % len(weights)] for i in range(len(names))]
    shares = water_fill(of_source, used, percent, max_repeat)
    members = {i: sorted(place[s] for s in set(sets[k])) for i, k in enumerate(keys)}
    sent = route({i: sizes[k] for i, k in enumerate(keys)}, members, [round(x) for x in shares], max_repeat)
    plan = {}
    for i, k in enumerate(keys):
        passes, rest = divmod(sent[i], sizes[k]) if sizes[k] else (0, 0)
        first = members[i][0]
        plan[k] = (of_source[first], float(shares[first]), passes, rest)
    return plan


def _source_sizes(sizes: dict[str, int], sets: dict[str, list], place: dict) -> list[int]:
    out = [0] * len(place)
    for k, found in sets.items():
        for s in set(found):
            out[place[s]] += sizes[k]
    return out


def mixed_rows(docs: DataFrame, weights: list[int] = (3, 1, 2), percent: int = 150, max_repeat: int = 2, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", sources_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, all columns unchanged."""
    own = Sealed(docs)
    joined, times = _taken(own, weights, percent, max_repeat, seed, id_col, text_col, sources_col)
    # array_repeat keeps the row together; no join back.
    copies = F.array_repeat(F.lit(0), F.when(F.col("size") > 0, times).otherwise(0).cast("int"))
    return own.back(joined.withColumn("copy", F.explode(copies)), {})
