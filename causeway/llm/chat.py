"""Reply trees as training conversations.

Messages point to their parents. Iterative self-joins double the ancestor pointers, so a
path of length n takes log2(n) rounds; each round keeps only messages that still have an
ancestor that far up, and is written, so that no plan grows. Leaves are ranked by the score
of their root-to-leaf path, and each chosen path becomes one formatted conversation.

Template, per turn: ``<turn ROLE>``, newline, text, newline, ``</turn>``, newline. Inside a
text every ``<turn`` and ``</turn`` gets one backslash more in front than it had; since a
marker always follows a newline, this reads back exactly. Loss spans cover the assistant
texts, markers excluded, as code points (start, end).

Defined cases: null text and null role are empty; messages without a conversation id are one
conversation of their own, its id null; messages whose parent is missing are
roots; equal (conversation, turn) rows are told apart by role and text, then arbitrarily but
alike; messages in a cycle of replies belong to no path; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

_CONTROL = re.compile(r"(\\*)(</?turn)")
_ESCAPED = re.compile(r"\\(\\*)(</?turn)")
_TURN = re.compile(r"<turn ([^>\n]*)>\n(.*?)\n</turn>\n", re.S)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the spans that bear loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn {quote(role, safe=' ')}>\n", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        part = f"{head}{body}\n</turn>\n"
        parts.append(part)
        at += len(part)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The inverse of :func:`format_turns`."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unquote(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def chain_of_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as reply trees without branches: (conv, node, parent, role, text, score)."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(w)
    out = rows.select(F.col("conv_id").alias("conv"), node.cast("long").alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return out.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def boxed(messages: DataFrame) -> DataFrame:
    """``conv`` in a struct: a struct is never null, so null ids meet in joins like all others."""
    return messages.withColumn("conv", F.struct(F.col("conv").isNull().alias("n"), F.col("conv").alias("id")))


def best_paths(messages: DataFrame, branches: int | None = None, max_rounds: int = 40) -> DataFrame:
    """(conv, leaf, rank, score, node, up): the messages of each chosen root-to-leaf path.

    ``up`` counts the replies between message and leaf. ``branches``: paths per conversation,
    the best mean score first (ties: the smaller leaf); None takes all.
    """
    return _paths(boxed(messages), branches, max_rounds).withColumn("conv", F.col("conv.id"))


def _paths(messages: DataFrame, branches: int | None, max_rounds: int = 40) -> DataFrame:
    """:func:`best_paths` of messages with :func:`boxed` ids, which stay boxed."""
    base = messages.select("conv", "node", "parent", "score")
    ids = base.select("conv", F.col("node").alias("parent")).distinct()
    # A parent that is not there makes its reply a root.
    known = base.join(ids.withColumn("known", F.lit(True)), ["conv", "parent"], "left")
    links = written(known.select("conv", "node", F.when(F.col("known"), F.col("parent")).alias("anc"), "score"), "links")
    # Round k: the ancestor 2^k replies up, with score and count of the messages before it.
    jumps = [links.where("anc is not null").select("conv", "node", "anc")]
    step = written(links.select("conv", "node", "anc", F.col("score").alias("total"), F.lit(1).cast("long").alias("n")), "step0")
    done = step.where("anc is null").select("conv", "node", "total", "n")
    step = step.where("anc is not null")
    finished = done
    for k in range(1, max_rounds):
        up = step.select("conv", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("total").alias("t2"), F.col("n").alias("n2"))
        roots = finished.select("conv", F.col("node").alias("anc"), F.lit(None).cast("long").alias("anc2"), F.col("total").alias("t2"), F.col("n").alias("n2"))
        nxt = step.join(up.unionByName(roots), ["conv", "anc"]).select("conv", "node", F.col("anc2").alias("anc"), (F.col("total") + F.col("t2")).alias("total"), (F.col("n") + F.col("n2")).alias("n"))
        nxt = written(nxt, f"step{k}")
        ended = nxt.where("anc is null").select("conv", "node", "total", "n")
        finished = written(finished.unionByName(ended), f"done{k}")
        step = nxt.where("anc is not null")
        if step.isEmpty():
            break
        jumps.append(step.select("conv", "node", "anc"))
    parents = links.where("anc is not null").select("conv", F.col("anc").alias("node")).distinct()
    leaves = finished.join(parents, ["conv", "node"], "left_anti").withColumn("score", F.col("total") / F.col("n"))
    rank = F.row_number().over(W.partitionBy("conv").orderBy(F.desc("score"), "node"))
    leaves = leaves.withColumn("rank", rank)
    if branches is not None:
        leaves = leaves.where(F.col("rank") <= branches)
    chosen = leaves.select("conv", F.col("node").alias("leaf"), "rank", "score", "node", F.lit(0).cast("long").alias("up"))
    paths = written(chosen, "leaves")
    for k, jump in enumerate(jumps):
        further = paths.join(jump, ["conv", "node"]).select("conv", "leaf", "rank", "score", F.col("anc").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = written(paths.unionByName(further), f"paths{k}")
    return paths


def format_conversations(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(conv, leaf, rank, score, formatted, loss_spans): one row per chosen path.

    ``messages``: conv, node, parent (null: root), role, text, score.
    """
    messages = boxed(messages)
    turns = _paths(messages, branches).join(messages.select("conv", "node", "role", "text"), ["conv", "node"])
    # One conversation is one training example, so its turns do meet in one row.
    grouped = turns.groupBy("conv", "leaf", "rank", "score").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    grouped = grouped.withColumn("conv", F.col("conv.id"))
    conv_kind = grouped.schema["conv"].dataType.simpleString()

    # Arrow batches, as pandas would make floats of integer ids beside a null one.
    def render(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            made = [format_turns([(t["role"] or "", t["text"] or "") for t in turns]) for turns in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(4)), pa.array([m[0] for m in made], pa.string()), pa.array([[{"start": a, "end": b} for a, b in m[1]] for m in made], spans)],
                names=["conv", "leaf", "rank", "score", "formatted", "loss_spans"],
            )

    return grouped.mapInArrow(render, f"conv {conv_kind}, leaf long, rank int, score double, formatted string, loss_spans array<struct<start: long, end: long>>")
