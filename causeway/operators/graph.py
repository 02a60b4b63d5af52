"""Iterative graph operators as rounds of joins; each round is checkpointed reliably."""

from __future__ import annotations

from heapq import heappop, heappush
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.tables import small
from causeway.functions.tables import written as _cut

from .components import component_of


def symmetric(e: DataFrame, weight: str | None = None) -> DataFrame:
    cols = [weight] if weight else []
    both = e.select(F.col("gene1").alias("u"), F.col("gene2").alias("v"), *cols).unionAll(e.select(F.col("gene2"), F.col("gene1"), *cols))
    return both.groupBy("u", "v").agg(F.min(weight).alias("w")) if weight else both.distinct()


def components(e: DataFrame) -> DataFrame:
    """(gene, component): weak components, named by their smallest gene.

    A gene whose only edges lead to itself is a component of its own.
    """
    found = component_of(e.select(F.col("gene1").alias("a"), F.col("gene2").alias("b")))
    genes = e.select(F.col("gene1").alias("gene")).union(e.select("gene2")).distinct()
    return genes.join(found.withColumnRenamed("node", "gene"), "gene", "left").select("gene", F.coalesce("component", "gene").alias("component"))


def hops(e: DataFrame, sources: DataFrame, cutoff: int | None) -> DataFrame:
    """(gene, hops): fewest undirected steps from any source, up to ``cutoff``; None: all that are reached."""
    links = _cut(symmetric(e), "links")
    seen = _cut(sources.select("gene").distinct().withColumn("hops", F.lit(0)), "seen0")
    front = seen
    for k in count(1) if cutoff is None else range(1, cutoff + 1):
        step = links.join(front.select(F.col("gene").alias("u")), "u").select(F.col("v").alias("gene")).distinct().join(seen, "gene", "left_anti")
        front = _cut(step.withColumn("hops", F.lit(k)), f"front{k}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def expand(e: DataFrame, sources: DataFrame, p: float) -> DataFrame:
    """ED4: edges that passing edges connect with the sources, in either direction."""
    good = e.where(F.col("p_value") <= p)
    reached = hops(good, sources, None).select("gene")
    return good.join(reached.withColumnRenamed("gene", "gene1"), "gene1", "left_semi").dropDuplicates()


def distances(e: DataFrame, source, bottleneck: bool = False, links: DataFrame | None = None) -> DataFrame:
    """(gene, dist): least sum, or least maximum, of p along undirected paths to ``source``.

    ``links``: what :func:`symmetric` makes of the edges, if that is written already. The links
    are only read in a round: the genes that moved go to them by a checked broadcast.
    """
    links = _cut(symmetric(e, "p_value"), "links") if links is None else links
    kind = e.schema["gene1"].dataType.simpleString()
    dist = e.sparkSession.createDataFrame([(source, 0.0)], f"gene {kind}, dist double")
    front = dist
    for k in count():
        through = F.greatest("dist", "w") if bottleneck else F.col("dist") + F.col("w")
        reach = links.join(small(front.withColumnRenamed("gene", "u")), "u").groupBy(F.col("v").alias("gene")).agg(F.min(through).alias("new"))
        both = _cut(dist.join(reach, "gene", "full").select("gene", F.least("dist", "new").alias("dist"), (F.col("new") < F.coalesce("dist", F.lit(float("inf")))).alias("moved")), f"dist{k}")
        dist, front = both.select("gene", "dist"), both.where("moved").select("gene", "dist")
        if front.isEmpty():
            break
    return dist


#: Links that are walked first for upper bounds, about, and those up to which one task finishes distances.
LIGHT_LINKS = 500_000
WALK_LINKS = 5_000_000


def walked_distances(links: DataFrame, source, bottleneck: bool) -> DataFrame:
    """What :func:`distances` returns, by one task's walk along the links (u, v, w) of a checked number."""
    kind = links.schema["u"].dataType.simpleString()

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        m = len(pdf)
        codes, names = pd.factorize(pd.concat([pdf["u"], pdf["v"], pd.Series([source], dtype=pdf["u"].dtype)], ignore_index=True))
        order = np.argsort(codes[:m], kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(codes[:m], minlength=len(names)))])
        to, w = codes[m : 2 * m][order], pdf["w"].to_numpy()[order]
        dist, done = np.full(len(names), np.inf), np.zeros(len(names), bool)
        dist[codes[-1]] = 0.0
        heap = [(0.0, int(codes[-1]))]
        while heap:
            d, i = heappop(heap)
            if done[i]:
                continue
            done[i] = True
            part = slice(start[i], start[i + 1])
            new, ends = np.maximum(d, w[part]) if bottleneck else d + w[part], to[part]
            closer = new < dist[ends]
            np.minimum.at(dist, ends[closer], new[closer])
            for x in zip(new[closer].tolist(), ends[closer].tolist(), strict=True):
                heappush(heap, x)
        found = np.isfinite(dist)
        return pd.DataFrame({"gene": names[found], "dist": dist[found]})

    own = links.sparkSession.createDataFrame([(source, 0.0)], f"gene {kind}, dist double")
    found = links.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda pdf: walk(pdf), f"gene {kind}, dist double")
    return own.unionByName(found).groupBy("gene").agg(F.min("dist").alias("dist"))


def within_bounds(links: DataFrame, source, bottleneck: bool = False, light_links: int = LIGHT_LINKS) -> DataFrame:
    """The links (u, v, w) that a best path from ``source`` may use, and some others.

    A walk along the lightest links alone gives each gene an upper bound of its distance. A link
    that weighs more than its end's bound is on no best path. Links to genes that the walk does
    not reach stay.
    """
    n = links.count()
    at = links.agg(F.percentile_approx("w", min(1.0, light_links / max(1, n)), 10_000)).first()[0]
    light = links.where(F.col("w") <= F.lit(at).cast("double"))
    if light.limit(2 * light_links + 1).count() > 2 * light_links:  # many links of one weight
        return links
    bound = _cut(walked_distances(light, source, bottleneck), "bounds").select(F.col("gene").alias("v"), F.col("dist").alias("most"))
    # Sums may differ in the last bits by the order of a path.
    kept = links.join(small(bound), "v", "left").where(F.col("most").isNull() | (F.col("w") <= F.col("most") * (1 + 1e-9)))
    return _cut(kept.select("u", "v", "w"), "within")


def spanning_forest(e: DataFrame) -> DataFrame:
    """(u, v, w): minimum spanning forest by Boruvka rounds, ties by (w, u, v).

    Each round at least halves the number of trees that still have an edge out of them, so
    the rounds end by themselves.
    """
    links = _cut(symmetric(e, "p_value").where("u < v"), "links")
    forest, labels = links.limit(0), None
    for k in count():
        if labels is None:
            tagged = links.withColumns({"cu": F.col("u"), "cv": F.col("v")})
        else:
            lab = lambda c: labels.select(F.col("gene").alias(c), F.col("component").alias("c" + c))  # noqa: B023, E731
            tagged = links.join(lab("u"), "u", "left").join(lab("v"), "v", "left").withColumns({"cu": F.coalesce("cu", "u"), "cv": F.coalesce("cv", "v")})
        # Edges inside a tree never count again.
        links = _cut(tagged.where("cu <> cv").select("u", "v", "w", "cu", "cv"), f"across{k}")
        ends = links.select(F.col("cu").alias("c"), "w", "u", "v").unionAll(links.select("cv", "w", "u", "v"))
        best = _cut(ends.groupBy("c").agg(F.min(F.struct("w", "u", "v")).alias("m")).select("m.u", "m.v", "m.w").distinct(), f"best{k}")
        if best.isEmpty():
            return forest
        forest = _cut(forest.unionByName(best), f"forest{k}")
        links = links.select("u", "v", "w")
        labels = components(forest.select(F.col("u").alias("gene1"), F.col("v").alias("gene2")))


def forest_summary(forest: DataFrame, genes: DataFrame) -> DataFrame:
    """(component, n_genes, n_edges, total_p, total_score) of a spanning forest; genes without edges are components of their own."""
    linked = components(forest.select(F.col("u").alias("gene1"), F.col("v").alias("gene2")))
    every = genes.select("gene").distinct().join(linked, "gene", "left").select("gene", F.coalesce("component", "gene").alias("component"))
    size = every.groupBy("component").agg(F.count(F.lit(1)).alias("n_genes"))
    cost = forest.join(linked.withColumnRenamed("gene", "u"), "u").groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("w").alias("total_p"), F.sum(-F.log10(F.greatest("w", F.lit(1e-300)))).alias("total_score"))
    return size.join(cost, "component", "left").fillna(0, ["n_edges"]).fillna(0.0, ["total_p", "total_score"])


def summary(e: DataFrame, gene) -> DataFrame:
    """Nodes, edges, density, weak and strong components and the largest of each, average degree, degrees of a gene of interest."""
    def sizes(found: DataFrame, n: str, largest: str) -> DataFrame:
        comp = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        return comp.agg(F.sum("size").alias("n_nodes"), F.count(F.lit(1)).alias(n), F.max("size").alias(largest))

    weak = sizes(components(e), "n_components", "largest")
    strong = sizes(strong_components(e), "n_strong", "largest_strong").drop("n_nodes")
    own = e.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("gene1") == gene).alias("out_degree"), F.count_if(F.col("gene2") == gene).alias("in_degree"))
    both = weak.join(F.broadcast(strong)).join(F.broadcast(own))
    return both.withColumns({"density": F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), "avg_degree": 2 * F.col("n_edges") / F.col("n_nodes")})


def _lowest_forward(links: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, c): the smallest gene that reaches a gene along (u, v), itself included."""
    labels = genes.select("gene", F.col("gene").alias("c"))
    front = labels
    while True:
        sent = links.join(front.withColumnRenamed("gene", "u"), "u").groupBy(F.col("v").alias("gene")).agg(F.min("c").alias("new"))
        both = _cut(labels.join(sent, "gene", "left").select("gene", F.least("c", "new").alias("c"), F.coalesce(F.col("new") < F.col("c"), F.lit(False)).alias("moved")), "forward")
        labels, front = both.select("gene", "c"), both.where("moved").select("gene", "c")
        if front.isEmpty():
            return labels


#: Edges up to which one task finishes the strong components.
ONE_TASK_EDGES = 500_000


def _in_one_task(links: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, component) of a graph of a checked size, by two depth-first walks."""
    kind = genes.schema["gene"].dataType.simpleString()

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["u"])
        ahead: dict = {}
        back: dict = {}
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            ahead.setdefault(u, []).append(v)
            back.setdefault(v, []).append(u)
        order, seen = [], set()
        for start in sorted(set(ahead) | set(back)):
            if start in seen:
                continue
            seen.add(start)
            stack = [(start, iter(ahead.get(start, ())))]
            while stack:
                node, rest = stack[-1]
                nxt = next((x for x in rest if x not in seen), None)
                if nxt is None:
                    order.append(node)
                    stack.pop()
                else:
                    seen.add(nxt)
                    stack.append((nxt, iter(ahead.get(nxt, ()))))
        label: dict = {}
        for start in reversed(order):
            if start in label:
                continue
            members, todo = [start], [start]
            label[start] = start
            for x in todo:
                for y in back.get(x, ()):
                    if y not in label:
                        label[y] = start
                        members.append(y)
                        todo.append(y)
            least = min(members)
            label |= dict.fromkeys(members, least)
        return pd.DataFrame({"gene": list(label), "component": list(label.values())})

    found = links.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda pdf: walk(pdf), f"gene {kind}, component {kind}")
    return genes.join(found, "gene", "left").select("gene", F.coalesce("component", "gene").alias("component"))


def strong_components(e: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(gene, component): strong components, named by their smallest gene.

    Genes without edges into or out of the rest are components of their own and leave first.
    What is left is finished by one task if it has at most ``one_task_edges`` edges. Beyond,
    by colouring: a gene takes the smallest gene that reaches it; what reaches the colour's
    own gene inside the colour is that gene's component. It leaves, and the rest goes on.
    """
    links = _cut(e.select(F.col("gene1").alias("u"), F.col("gene2").alias("v")).where("u <> v").distinct(), "links")
    genes = _cut(e.select(F.col("gene1").alias("gene")).union(e.select("gene2")).distinct(), "genes")
    done = genes.select("gene", F.col("gene").alias("component")).limit(0)
    while not genes.isEmpty():
        if links.count() <= one_task_edges:
            return done.unionByName(_in_one_task(links, genes))
        core = genes.join(links.select(F.col("u").alias("gene")), "gene", "left_semi").join(links.select(F.col("v").alias("gene")), "gene", "left_semi")
        core = _cut(core, "core")
        found = genes.join(core, "gene", "left_anti").select("gene", F.col("gene").alias("component"))
        if found.isEmpty():
            colour = _lowest_forward(links, genes)
            inside = links.join(colour.select(F.col("gene").alias("u"), "c"), "u").join(colour.select(F.col("gene").alias("v"), F.col("c").alias("cv")), "v").where("c = cv")
            inside = _cut(inside.select(F.col("v").alias("gene1"), F.col("u").alias("gene2"), "c"), "inside")
            seen = front = _cut(colour.where("gene = c"), "roots")
            while not front.isEmpty():
                step = inside.join(front.select(F.col("gene").alias("gene1")), "gene1").select(F.col("gene2").alias("gene"), "c").distinct()
                front = _cut(step.join(seen, "gene", "left_anti"), "backward")
                seen = _cut(seen.unionByName(front), "seen")
            found = seen.select("gene", F.col("c").alias("component"))
        found = _cut(found, "found")
        done = done.unionByName(found)
        genes = _cut(genes.join(found, "gene", "left_anti"), "rest")
        stay = lambda c: genes.withColumnRenamed("gene", c)  # noqa: B023, E731
        links = _cut(links.join(stay("u"), "u", "left_semi").join(stay("v"), "v", "left_semi"), "links")
    return done


def steiner_tree(e: DataFrame, terminals: DataFrame, hop_penalty: float = 0.0) -> DataFrame:
    """(u, v, w): a tree for each component that joins its terminals, by nearest-terminal regions.

    Weights are the smaller p of both directions, plus ``hop_penalty`` on edges with an end
    that is no terminal. Ties go to the smaller (distance, terminal, predecessor). Fewer than
    two terminals in a component: no rows from it.
    """
    ends = _cut(terminals.select("gene").distinct(), "terminals")
    flag = lambda c: ends.select(F.col("gene").alias(c), F.lit(True).alias("t" + c))
    links = symmetric(e.where("gene1 <> gene2"), "p_value").join(flag("u"), "u", "left").join(flag("v"), "v", "left")
    links = _cut(links.select("u", "v", (F.col("w") + F.when(F.col("tu") & F.col("tv"), 0.0).otherwise(hop_penalty)).alias("w")), "links")
    near = ends.select("gene", F.struct(F.lit(0.0).alias("d"), F.col("gene").alias("t"), F.col("gene").alias("by")).alias("m"))
    front = near
    while not front.isEmpty():
        sent = links.join(front.withColumnRenamed("gene", "u"), "u").groupBy(F.col("v").alias("gene")).agg(F.min(F.struct((F.col("m.d") + F.col("w")).alias("d"), F.col("m.t").alias("t"), F.col("u").alias("by"))).alias("new"))
        # A step of weight 0 may tie; only a smaller (distance, terminal) moves a gene on.
        less = F.col("m").isNull() | (F.struct("new.d", "new.t") < F.struct("m.d", "m.t"))
        both = near.join(sent, "gene", "full").withColumn("moved", F.coalesce(F.col("new").isNotNull() & less, F.lit(False)))
        both = _cut(both.select("gene", F.when(F.col("moved"), F.col("new")).otherwise(F.col("m")).alias("m"), "moved"), "near")
        near, front = both.select("gene", "m"), both.where("moved").select("gene", "m")
    side = lambda c: near.select(F.col("gene").alias(c), F.col("m.d").alias("d" + c), F.col("m.t").alias("t" + c))
    across = links.where("u < v").join(side("u"), "u").join(side("v"), "v").where("tu <> tv")
    bridge = across.groupBy(F.least("tu", "tv").alias("gene1"), F.greatest("tu", "tv").alias("gene2")).agg(F.min(F.struct((F.col("du") + F.col("w") + F.col("dv")).alias("p"), "u", "v")).alias("m"))
    bridge = _cut(bridge, "bridges")
    kept = spanning_forest(bridge.select("gene1", "gene2", F.col("m.p").alias("p_value"))).select(F.col("u").alias("gene1"), F.col("v").alias("gene2"))
    kept = _cut(bridge.join(kept, ["gene1", "gene2"], "left_semi").select("m.u", "m.v"), "kept")
    used = kept
    at = kept.select(F.col("u").alias("gene")).union(kept.select("v")).distinct()
    while True:
        step = _cut(at.join(near, "gene").where(F.col("m.by") != F.col("gene")).select("gene", F.col("m.by").alias("by")), "walk")
        if step.isEmpty():
            break
        used = used.unionByName(step.select(F.least("gene", "by").alias("u"), F.greatest("gene", "by").alias("v")))
        at = step.select(F.col("by").alias("gene")).distinct()
    tree = spanning_forest(links.join(used.distinct(), ["u", "v"], "left_semi").select(F.col("u").alias("gene1"), F.col("v").alias("gene2"), F.col("w").alias("p_value")))
    while True:
        degree = tree.select(F.col("u").alias("gene")).unionAll(tree.select("v")).groupBy("gene").count().where("count = 1")
        leaves = _cut(degree.select("gene").join(ends, "gene", "left_anti"), "leaves")
        if leaves.isEmpty():
            return tree
        drop = lambda c: leaves.withColumnRenamed("gene", c)  # noqa: B023, E731
        tree = _cut(tree.join(drop("u"), "u", "left_anti").join(drop("v"), "v", "left_anti").select("u", "v", "w"), "tree")


def adaptive_candidates(e: DataFrame, terminals: DataFrame, p_values: list[float], start_hops: int = 2, max_nodes: int | None = 5000, coverage: float = 0.9) -> tuple[DataFrame, dict]:
    """Edges of the first neighbourhood of the terminals, wide to narrow, that joins enough of them.

    For each number of hops and then each threshold: genes within that distance of a terminal.
    Neighbourhoods above ``max_nodes`` are passed over. The component with most terminals is
    returned once it holds a share of at least ``coverage``; else the smallest neighbourhood seen.
    """
    ends = _cut(terminals.select("gene").distinct(), "terminals")
    best = None
    for h in range(start_hops, -1, -1):
        for p in p_values:
            good = _cut(e.where(F.col("p_value") <= p), "candidates")
            nodes = good.select(F.col("gene1").alias("gene")).union(good.select("gene2")).distinct()
            present = _cut(ends.join(nodes, "gene", "left_semi"), "present")
            total = present.count()
            if total < 2:
                continue
            near = _cut(hops(good, present, h).select("gene"), "near")
            size = near.count()
            if max_nodes is not None and size > max_nodes:
                continue
            within = lambda g: good.join(g.withColumnRenamed("gene", "gene1"), "gene1", "left_semi").join(g.withColumnRenamed("gene", "gene2"), "gene2", "left_semi")  # noqa: B023, E731
            parts = near.join(components(within(near)), "gene", "left").select("gene", F.coalesce("component", "gene").alias("c"))
            parts = _cut(parts, "parts")
            top = parts.join(present, "gene", "left_semi").groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").first()
            meta = {"hops": h, "p_value": p, "nodes": size, "terminals": total, "terminals_joined": top["n"], "coverage": top["n"] / total, "connected": False}
            if meta["coverage"] >= coverage:
                main = parts.where(F.col("c") == top["c"]).select("gene")
                return within(main), meta | {"nodes": main.count(), "connected": True}
            if best is None or size < best[1]["nodes"]:
                best = within(near), meta
    return best or (e.limit(0), {"hops": None, "p_value": None, "nodes": 0, "terminals": ends.count(), "terminals_joined": 0, "coverage": 0.0, "connected": False})
