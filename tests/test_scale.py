"""What the large runs need: no table of all edges or of all pairs, and the same results without it."""

import time

import numpy as np
import pytest

from causeway.operators import community, edges, granger, paths, ranking


def series(spark, n=40, points=20):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(g, rng.normal(size=points).cumsum().tolist()) for g in range(n)], "gene long, series array<double>")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_blocks_meet_without_a_shuffle_of_their_copies(spark):
    s = series(spark)
    plan = granger.granger(s, max_p=0.3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    # The same bits in whatever blocks a pair meets.
    whole = rows(granger.granger(s))
    assert len(whole) == 40 * 39 and whole == rows(granger.granger(s, block=3)) == rows(granger.granger(s.where("gene < 7"), s).union(granger.granger(s.where("gene >= 7"), s)))
    assert rows(granger.granger(s, max_p=0.3)) == [r for r in whole if r[3] <= 0.3]


def test_ego_network_tests_only_the_neighbours(spark):
    s = series(spark)
    e = granger.granger(s, max_p=0.2)
    assert rows(granger.ego_network(s, 3, 0.2).select("gene1", "gene2")) == rows(edges.ego_network(e, 3).select("gene1", "gene2"))
    # A gene that is not there has no neighbours.
    assert granger.ego_network(s, 99, 0.2).count() == 0


def test_community_export_needs_the_community_alone(spark):
    s = series(spark)
    parts = spark.createDataFrame([(g, g % 3) for g in range(40)], "gene long, community long")
    own = s.join(community.community_of(parts, 4), "gene", "left_semi")
    got = community.community_export(granger.granger(own, max_p=0.3), parts, 4)[0]
    assert rows(got) == rows(community.community_export(granger.granger(s, max_p=0.3), parts, 4)[0]) and got.count() == 13


def test_cutoff_sweep_reads_the_edges_once(spark):
    e = spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.1), (2, 3, 0.1), (0, 9, 0.1), (0, 1, 0.1)], "gene1 long, gene2 long, p_value double")
    f = spark.createDataFrame([(0, 0.9), (1, 0.5), (2, 0.2), (3, 0.0)], "gene long, frequency double")
    want = [(0.2, "any", 3, 5, 4), (0.2, "both", 3, 3, 2), (0.5, "any", 2, 4, 3), (0.5, "both", 2, 2, 1), (0.95, "any", 0, 0, 0), (0.95, "both", 0, 0, 0)]
    assert rows(edges.cutoff_sweep(e, f, [0.5, 0.2, 0.95])) == want == rows(edges.cutoff_sweep(e.distinct(), f, [0.5, 0.2, 0.95], once=True))
    plan = edges.cutoff_sweep(granger.granger(series(spark)), f, [0.5], once=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CartesianProduct") <= 2  # in the plan and its first form
    assert rows(edges.cutoff_sweep(e.limit(0), f, [0.5])) == [(0.5, "any", 2, 0, 0), (0.5, "both", 2, 0, 0)]


def test_redirected_pairs_without_a_table_of_edges(spark):
    s = series(spark)
    e = granger.granger(s, max_p=0.4).select("gene1", "gene2", "p_value")
    want = rows(edges.redirect(edges.undirected(e.where("p_value <= 0.1")), e))
    assert rows(granger.redirected(s, 0.4, 0.1)) == want and len(want) > 50


def test_quantile_of_edges_moves_no_edge(spark):
    s = series(spark)
    e = granger.granger(s, max_p=0.4).select("gene1", "gene2", "p_value")
    p = [r[2] for r in rows(e)]
    assert ranking.lower_quantile(e, 0.25).first().threshold == pytest.approx(np.quantile(p, 0.25))
    binned = e.selectExpr("floor(p_value * 10) AS b").groupBy("b").count()._jdf.queryExecution().executedPlan().toString()
    assert binned.count("Exchange hashpartitioning") <= 2 and "hashpartitioning(bi" not in binned


def test_undirected_pairs_are_made_where_their_blocks_meet(spark):
    s = series(spark)
    e = granger.granger(s, max_p=0.3)
    assert rows(granger.undirected(s, 0.3)) == rows(edges.undirected(e)) == rows(granger.both_ways(s, 0.3, block=4).selectExpr("u", "v", "least(p_uv, p_vu)"))
    plan = granger.undirected(s, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    with pytest.raises(ValueError, match="more than one series"):
        granger.both_ways(s.union(s), 0.3)


def test_hop_penalty_on_pairs(spark):
    s, t = series(spark), spark.createDataFrame([(g,) for g in range(0, 40, 3)], "gene long")
    want = rows(edges.undirected(granger.granger(s, max_p=0.3), t, 0.25))
    got = edges.penalised(granger.undirected(s, 0.3), t, 0.25)
    assert rows(got) == want and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_what_is_left_after_a_run_over_some_genes(spark):
    s, t = series(spark), spark.createDataFrame([(g,) for g in range(0, 40, 4)], "gene long")
    done = granger.probe_pairs(t, t)
    left = granger.after(s, t, 0.3)
    assert rows(left.select("gene1", "gene2", "p_value")) == rows(granger.granger(s, max_p=0.3, done=done).select("gene1", "gene2", "p_value"))
    assert "hashpartitioning" not in left._jdf.queryExecution().executedPlan().toString()


def parts_of(spark, genes=90, runs=7):
    return spark.createDataFrame([(r, g, (g * (2 * r + 1) + r) % (2 + r % 3)) for r in range(runs) for g in range(genes) if (g, r) != (5, 2)], "run long, gene long, community long")


def plain(spark, parts):
    parts.createOrReplaceTempView("parts_plain")
    return spark.sql("SELECT x.gene AS a, y.gene AS b, count(*) AS n FROM parts_plain x JOIN parts_plain y ON x.run = y.run AND x.community = y.community AND x.gene <= y.gene GROUP BY ALL")


def test_quantiles_by_classes_of_genes(spark):
    parts = parts_of(spark)
    t = community.together(parts)
    assert t.pairs.count() <= 14 * 13 // 2  # 12 classes and the gene that a run lacks
    cells = [r.n / 7 for r in plain(spark, parts).collect() for _ in range(1 + (r.a != r.b))]
    assert {r.q: r.value for r in community.coassociation_quantiles(t, 7, (0.3, 0.95)).collect()} == pytest.approx({q: np.quantile(cells, q) for q in (0.3, 0.95)})


def test_matrix_change_by_classes(spark):
    parts = parts_of(spark)
    old, new = ({(r.a, r.b): r.n for r in plain(spark, p).collect()} for p in (parts.where("run < 4"), parts))
    change = [abs(old.get((a, b), 0) / 4 - new.get((a, b), 0) / 7) / max(old.get((a, b), 0) / 4, 1e-9) for a in range(90) for b in range(a, 90) for _ in range(1 + (a != b))]
    t, u = community.together(parts.where("run < 4")), community.together(parts)
    assert u.pairs.count() < 100 and community.matrix_change(t, 4, u, 7, q=0.6).first().rel_change == pytest.approx(np.quantile(change, 0.6))


def test_consensus_clusters_of_many_equal_genes(spark):
    # 6,000 genes of 6 kinds: more than one matrix of genes could hold before.
    parts = spark.range(6000).selectExpr("id AS gene", "explode(sequence(0L, 3L)) AS run").selectExpr("run", "gene", "CASE WHEN run = 3 THEN gene % 6 ELSE gene % 2 END AS community")
    got = community.consensus_clusters(parts).collect()
    assert len(got) == 6000 and len({r.community for r in got}) == 3 and len({(r.gene % 6, r.community) for r in got}) == 6
    assert {r.gene: r.community for r in got}[0] == 0
    with pytest.raises(ValueError, match="classes"):
        community.consensus_clusters(parts, max_classes=5)


def test_coassociation_spreads_classes_out(spark, monkeypatch):
    monkeypatch.setattr(community, "CHUNK", 3)
    parts = parts_of(spark)
    got = community.coassociation(parts)
    assert rows(got) == rows(plain(spark, parts))
    # No row of the result is shuffled: what is spread out last is returned as it is.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "SortMergeJoin" not in plan


def test_further_runs_refine_the_classes(spark):
    parts = parts_of(spark)
    t = community.add_runs(community.together(parts.where("run < 4")), parts.where("run >= 4"))
    assert rows(community.expanded(t)) == rows(plain(spark, parts)) and t.pairs.count() < 100
    # A gene that only later runs have.
    late = community.add_runs(community.together(parts.where("run < 4 and gene <> 7")), parts.where("run >= 4"))
    want = plain(spark, parts.where("run >= 4 or gene <> 7"))
    assert rows(community.expanded(late)) == rows(want)


def test_paths_in_rounds_and_in_one_task_agree(spark):
    rng = np.random.default_rng(2)
    made = {(int(a), int(b)): float(p) for a, b, p in zip(rng.integers(0, 40, 90), rng.integers(0, 40, 90), rng.integers(1, 6, 90) / 8)}
    e = spark.createDataFrame([(a, b, p) for (a, b), p in made.items()] + [(90, 91, 0.5)], "gene1 long, gene2 long, p_value double")
    near = {v: {} for v in range(92)}
    for (a, b), p in made.items():
        for u, v in ((a, b), (b, a)):
            near[u][v] = min(p, near[u].get(v, 1.0))
    for bottleneck in (False, True):
        least = {0: 0.0}
        for _ in range(60):
            for u in list(least):
                for v, w in near[u].items():
                    least[v] = min(least.get(v, 9.0), max(least[u], w) if bottleneck else least[u] + w)
        got = [paths.paths_to(e, 0, bottleneck, one_task_links=n).collect() for n in (10**6, 0)]
        assert {r.gene: r.dist for r in got[0]} == least
        one, many = ({r.gene: (r.dist, r.hops, tuple(r.path), round(r.score, 9)) for r in x} for x in got)
        assert one == many


def test_both_kinds_of_paths_share_their_links(spark, monkeypatch):
    from causeway.plans import registry, reports

    e = spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.1), (0, 2, 0.5)], "gene1 long, gene2 long, p_value double")
    made = []
    monkeypatch.setattr(reports, "network", lambda *_: e)
    monkeypatch.setattr(reports, "_probes", lambda *_: spark.createDataFrame([(2,), (7,)], "gene long"))
    monkeypatch.setattr(paths, "symmetric", lambda *a, f=paths.symmetric: made.append(1) or f(*a))
    assert rows(registry.QUERIES["path_summary"](spark, "").fillna(-1.0)) == [(2, 0.2, 0.1), (7, -1.0, -1.0)] and len(made) == 1


def test_costs_of_signatures_count_every_document(spark):
    from causeway.llm import jaccard

    docs = spark.range(6000).selectExpr("id AS doc_id", "'one two three four' AS text")
    counts = jaccard.element_counts(docs, 4, "text")
    assert counts.sum() == counts.max() == 6000


def test_girvan_newman_of_a_graph_in_parts_has_no_bound(spark):
    e = spark.createDataFrame([(9, 5, 0.1), (5, 7, 0.1), (1, 2, 0.1), (4, 3, 0.1), (8, 8, 0.1)], "gene1 long, gene2 long, p_value double")
    want = {1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 7: 2, 9: 2}
    assert {r.gene: r.community for r in community.girvan_newman(e, 3, max_edges=2).collect()} == want == {r.gene: r.community for r in community.girvan_newman(e, 3).collect()}
    with pytest.raises(ValueError, match="more than 2 edges"):
        community.girvan_newman(e, 4, max_edges=2)


def test_clusters_by_places_merge_as_exact_shares_do():
    from fractions import Fraction

    rng = np.random.default_rng(3)
    n, runs = 24, 6
    label, size = rng.integers(0, 3, (n, runs)), rng.integers(1, 4, n)
    groups = {i: [i] for i in range(n)}
    while len(groups) > 4:
        far = {}
        for a in groups:
            for b in groups:
                if a != b:
                    hits = sum(int(size[i] * size[j] * (label[i] == label[j]).sum()) for i in groups[a] for j in groups[b])
                    far[a, b] = 1 - Fraction(hits, runs * int(size[groups[a]].sum()) * int(size[groups[b]].sum()))
        a, b = sorted(min(far, key=lambda x: (far[x], x)))
        groups[a] += groups.pop(b)
    got = community.average_linkage_by_places(np.repeat(np.arange(n), runs), (label + 3 * np.arange(runs)).ravel(), np.ones(n * runs, int), runs, 4, size)
    assert [sorted(np.flatnonzero(got == c).tolist()) for c in range(4)] == [sorted(groups[a]) for a in sorted(groups)]


def test_consensus_clusters_have_no_bound_of_classes(spark):
    # 5,100 genes, no two of which are together in all runs: more than the matrix could hold before.
    parts = spark.range(5100).selectExpr("id AS gene", "explode(sequence(0L, 5L)) AS run").selectExpr("run", "gene", "CAST(floor(gene / power(5, run)) AS LONG) % 5 AS community")
    got = community.consensus_clusters(parts).collect()
    assert len({r.gene for r in got}) == len(got) == 5100 and len({r.community for r in got}) == 4  # 4.5, half to even
    few = parts.where("gene < 60")
    assert len({r.community for r in community.consensus_clusters(few, matrix=10).collect()}) == len({r.community for r in community.consensus_clusters(few).collect()})


def test_louvain_reads_the_packed_graph(spark, monkeypatch):
    rng = np.random.default_rng(4)
    made = {tuple(sorted(x)) for x in rng.integers(0, 300, (2500, 2)).tolist() if x[0] != x[1]}
    e = spark.createDataFrame([(a, b, 0.1) for a, b in made] + [(b, a, 0.1) for a, b in list(made)[:99]] + [(7, 7, 0.1)], "gene1 long, gene2 long, p_value double")
    # Several blocks, no edge on the driver, and genes of few and of many links alike.
    monkeypatch.setattr(community, "BLOCK_LINKS", 700)
    monkeypatch.setattr(type(e), "toPandas", None)
    genes = sorted({x for p in made for x in p})
    u, v = (np.array([genes.index(x) for x in side]) for side in zip(*sorted(made), strict=True))
    for many in (community.MANY, 5):
        monkeypatch.setattr(community, "MANY", many)
        g = community.louvain_graph(e)
        want = {(s, genes[i], c) for s in (3, 4, 5) for i, c in enumerate(community._communities(community._level_of([(r.blk, r.n, bytes(r.links)) for r in g.blocks.collect()], g.n), s).tolist())}
        assert g.blocks.count() > 5
        if many == community.MANY != 5:
            assert {c for c in want if c[0] == 3} == {(3, genes[i], c) for i, c in enumerate(community.louvain(u, v, len(genes), 3).tolist())}
            # The tasks have the module's own bound.
            assert {tuple(r) for r in community.louvain_runs(spark, e, 3, 6).select("run", "gene", "community").collect()} == want
        for s in (3, 4, 5):
            label = np.array([c for _, _, c in sorted(x for x in want if x[0] == s)])
            share = np.bincount(label, np.bincount(np.concatenate([u, v]))) / (2 * len(u))
            assert (label[u] == label[v]).mean() - (share**2).sum() > 0.15


def test_hits_are_added_up_in_the_tasks(spark):
    rng = np.random.default_rng(6)
    e = spark.createDataFrame([(int(a), int(b), 0.1) for a, b in rng.integers(0, 60, (200, 2))], "gene1 long, gene2 long, p_value double")
    g = community.louvain_graph(e)
    freq = {r.gene: r.frequency for r in community.goi_frequency(community.louvain_runs(spark, e, 0, 70, g), 0).collect()}
    assert {r.gene: r.n / 70 for r in community.louvain_hits(g, 0, 70, 0).collect()} == pytest.approx(freq)
    assert {r.n for r in community.louvain_hits(g, 0, 3, 999).collect()} == {0}


def test_paths_over_many_links_need_no_rounds_of_distances(spark, monkeypatch):
    from causeway.operators import graph

    rng = np.random.default_rng(8)
    made = {(int(a), int(b)): float(p) for a, b, p in zip(rng.integers(0, 50, 700), rng.integers(0, 50, 700), rng.integers(1, 40, 700) / 64) if a != b}
    e = spark.createDataFrame([(a, b, p) for (a, b), p in made.items()] + [(0, 60, 5.0), (60, 61, 7.0), (90, 91, 0.5)], "gene1 long, gene2 long, p_value double")
    links = paths.links_of(e)
    for bottleneck in (False, True):
        want = {r.gene: (r.dist, r.hops, tuple(r.path)) for r in paths.paths_to(e, 0, bottleneck, links).collect()}
        few = graph.within_bounds(links, 0, bottleneck, light_links=150)
        assert few.count() < links.count() / 2 and 61 in want and 91 not in want
        assert {r.gene: r.dist for r in graph.walked_distances(few, 0, bottleneck).collect()} == {g: x[0] for g, x in want.items()} == {r.gene: r.dist for r in graph.distances(e, 0, bottleneck, few).collect()}
        with monkeypatch.context() as m:
            m.setattr(paths, "distances", None)
            m.setattr(paths, "within_bounds", lambda x, s, b: graph.within_bounds(x, s, b, light_links=150))
            assert {r.gene: (r.dist, r.hops, tuple(r.path)) for r in paths.paths_to(e, 0, bottleneck, links, one_task_links=400).collect()} == want


def test_hits_in_java_are_those_of_the_runs(spark, monkeypatch):
    # Hubs beyond MANY links, groups that end as few communities, separate pairs, several blocks; seeds beyond 32 bits too.
    monkeypatch.setattr(community, "BLOCK_LINKS", 3000)
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 900, (2, 9000))
    b = np.where(rng.random(9000) < 0.8, a // 150 * 150 + b % 150, b)
    pairs = {*zip(a.tolist(), b.tolist(), strict=True), *((k, x) for k in (0, 1) for x in rng.integers(2, 900, 400).tolist()), *((1000 + 2 * k, 1001 + 2 * k) for k in range(20))}
    e = spark.createDataFrame([(x, y, 0.0) for x, y in pairs if x != y], "gene1 long, gene2 long, p_value double")
    g = community.louvain_graph(e)
    level = community._level_of([(r.blk, r.n, bytes(r.links)) for r in g.blocks.collect()], g.n)
    assert level.any_many
    genes = [r.gene for r in g.genes.orderBy("i").collect()]
    for first in (0, 2**32 + 1):
        runs = [community._communities(level, seed) for seed in range(first, first + 6)]
        want = dict(zip(genes, sum((x == x[genes.index(7)]).astype(int) for x in runs).tolist(), strict=True))
        assert {r.gene: r.n for r in community.louvain_hits(g, first, first + 6, 7).collect()} == want
    # As many runs as the loop starts with; in Python these took 0.1 s each.
    began = time.time()
    many = {r.gene: r.n for r in community.louvain_hits(g, 0, 5000, 7).collect()}
    assert many[7] == 5000 and many[1000] == 0 and time.time() - began < 60


def test_girvan_newman_has_no_bound_of_edges(spark):
    # Two groups of 150 genes, all linked, and a bridge: 22,351 edges in one part.
    e = spark.createDataFrame([(g + a, g + b, 0.1) for g in (0, 150) for a in range(150) for b in range(a)] + [(7, 290, 0.1)], "gene1 long, gene2 long, p_value double")
    assert {r.gene: r.community for r in community.girvan_newman(e, 2).collect()} == {i: i // 150 for i in range(300)}


def test_girvan_newman_in_rounds_is_that_of_one_task(spark, monkeypatch):
    rng = np.random.default_rng(2)
    made = {(int(a), int(b)) for a, b in rng.integers(0, 40, (90, 2)) if a != b}
    chain = [(100 + i, 101 + i) for i in range(5)]  # equal loads
    e = spark.createDataFrame([*made, *chain], "gene1 long, gene2 long")
    split = lambda k: sorted(map(tuple, community.girvan_newman(e, k).collect()))
    want = {k: split(k) for k in (None, 7, 200)}
    # Several blocks of links, and loads that are added up before they go to the driver.
    for name, value in (("ONE_TASK_WORK", 0), ("BLOCK_LINKS", 70), ("LOAD_BYTES", 0)):
        monkeypatch.setattr(community, name, value)
    assert {k: split(k) for k in (None, 7, 200)} == want and len({c for _, c in want[7]}) == 7 and not want[200]


def test_hits_of_genes_with_many_links_are_those_of_the_runs(spark):
    # All genes have more than MANY links: looks at few communities read counts alone.
    rng = np.random.default_rng(9)
    a, b = np.triu_indices(420, 1)
    keep = rng.random(len(a)) < np.where(a % 3 == b % 3, 0.75, 0.55)
    e = spark.createDataFrame([(int(x), int(y), 0.0) for x, y in zip(a[keep], b[keep], strict=True)], "gene1 long, gene2 long, p_value double")
    g = community.louvain_graph(e)
    level = community._level_of([(r.blk, r.n, bytes(r.links)) for r in g.blocks.collect()], g.n)
    assert all(level.many)
    runs = [community._communities(level, seed) for seed in range(12)]
    assert {r.gene: r.n for r in community.louvain_hits(g, 0, 12, 7).collect()} == dict(enumerate(sum((x == x[7]).astype(int) for x in runs).tolist()))
