import json

import numpy as np
import pytest

from causeway.operators import community, components, edges, graph, paths, ranking
from causeway.plans.runner import Config, Runner
from causeway.sources import writers


def made(spark, rows):
    return spark.createDataFrame([(a, b, float(p)) for a, b, p in rows], "gene1 long, gene2 long, p_value double")


def test_strong_components_match_reachability(spark):
    rng = np.random.default_rng(3)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 14, (17, 2)) if a != b}
    reach = {a: {a} for ab in pairs for a in ab}
    for _ in reach:
        for a, b in pairs:
            for r in reach.values():
                if a in r:
                    r.add(b)
    expected = {a: min(b for b in r if a in reach[b]) for a, r in reach.items()}
    got = {r.gene: r.component for r in graph.strong_components(made(spark, [(*x, 0.1) for x in pairs])).collect()}
    assert got == expected
    by_rounds = {r.gene: r.component for r in graph.strong_components(made(spark, [(*x, 0.1) for x in pairs]), one_task_edges=0).collect()}
    assert by_rounds == expected


def test_components_of_a_long_path(spark):
    order = np.random.default_rng(7).permutation(1000).tolist()
    e = made(spark, [(a, b, 0.1) for a, b in zip(order, order[1:], strict=False)] + [(2000, 2001, 0.1), (3000, 3000, 0.1)])
    got = {r.gene: r.component for r in graph.components(e).collect()}
    assert got == dict.fromkeys(order, 0) | {2000: 2000, 2001: 2000, 3000: 3000}
    with pytest.raises(RuntimeError, match="not settled"):
        components.component_of(e.selectExpr("gene1 AS a", "gene2 AS b"), max_rounds=2)


def test_steiner_tree_joins_terminals_by_the_hub(spark):
    e = made(spark, [(0, 9, 0.1), (1, 9, 0.1), (9, 2, 0.1), (0, 1, 0.9), (2, 5, 0.1), (7, 8, 0.1)])
    got = {(r.u, r.v) for r in graph.steiner_tree(e, spark.createDataFrame([(0,), (1,), (2,), (7,)], "gene long")).collect()}
    assert got == {(0, 9), (1, 9), (2, 9)}


def test_adaptive_candidates_take_the_joining_threshold(spark):
    e = made(spark, [(0, 3, 0.01), (3, 1, 0.04), (5, 6, 0.01)])
    kept, meta = graph.adaptive_candidates(e, spark.createDataFrame([(0,), (1,)], "gene long"), [0.01, 0.05])
    assert meta["connected"] and meta["p_value"] == 0.05 and kept.count() == 2


def test_girvan_newman_cuts_the_bridge(spark):
    e = made(spark, [(0, 1, 0), (1, 2, 0), (0, 2, 0), (3, 4, 0), (4, 5, 0), (3, 5, 0), (2, 3, 0)])
    got = {r.gene: r.community for r in community.girvan_newman(e, 2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    assert community.girvan_newman(e, 7).count() == 0


def test_runner_writes_every_stage(spark, tmp_path):
    rng = np.random.default_rng(0)
    lines = ["Gene," + ",".join(map(str, range(12)))] + [f"G{i}," + ",".join(f"{v:.4f}" for v in rng.random(12)) for i in range(10)]
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "genes.txt").write_text("\n".join(f"G{i}" for i in range(6)) + "\n")
    (tmp_path / "c.yml").write_text(f"matrix: file://{tmp_path}/m.csv\ngenes: file://{tmp_path}/genes.txt\noutput: file://{tmp_path}/out\ngene_of_interest: G0\np_threshold: 0.6\nruns: 2\nmax_runs: 2\n")
    runner = Runner(spark, Config.read(str(tmp_path / "c.yml")))
    assert len(runner.run()) == 8 and "## Top genes" in (tmp_path / "out/RUN_SUMMARY.md").read_text()
    assert json.loads((tmp_path / "out/run_manifest.json").read_text())["stages"][1]["stage"] == "seed_gc"
    writers.graphml(runner.read("seed_gc"), str(tmp_path / "n.graphml"))
    writers.svg(runner.read("seed_gc"), str(tmp_path / "n.svg"))
    assert "<edge" in (tmp_path / "n.graphml").read_text() and "<circle" in (tmp_path / "n.svg").read_text()
    with pytest.raises(ValueError, match="p_threshold"):
        Config("m", "g", "o", "G0", p_threshold=0)


def test_consensus_goes_on_until_stable(spark, monkeypatch):
    e = made(spark, [(0, 1, 0), (1, 2, 0), (0, 2, 0), (3, 4, 0)])
    answers = iter([(0.5, 0.0)] * 5 + [(0.0, 100.0)])
    monkeypatch.setattr(ranking, "stability", lambda *_: spark.createDataFrame([next(answers)], "rel_change double, overlap double"))
    rows = community.stable_consensus(spark, e, 0, start=100).collect()
    assert {(r.runs, r.stable) for r in rows} == {(100 + 20 + 24 + 28 + 34 + 41 + 49, True)} and {r.gene: r.frequency for r in rows} == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0}
    answers = iter([(0.5, 0.0)] * 9)
    assert {(r.runs, r.stable) for r in community.stable_consensus(spark, e, 0, start=2, max_runs=4).collect()} == {(4, False)}
    assert Config("m", "g", "o", "G0").max_runs is None


def test_girvan_newman_query_takes_the_whole_network(spark, monkeypatch):
    from causeway.plans import registry

    e = made(spark, [(0, 1, 0.0001), (2, 3, 0.0001), (4, 5, 0.001)])
    monkeypatch.setattr(registry, "gc_edges", lambda *_: e.where(f"p_value <= {_[2]}"))
    assert {r.gene for r in registry.QUERIES["girvan_newman"](spark, "").collect()} == set(range(6))


def test_expansion_and_distances_have_no_last_round(spark):
    # A chain longer than the former bound of 1000 rounds would be slow: the bound itself is tested.
    import inspect

    assert "max_rounds" not in inspect.signature(graph.expand).parameters and "max_rounds" not in inspect.signature(graph.distances).parameters
    e = made(spark, [(i, i + 1, 0.5) for i in range(6)])
    start = spark.createDataFrame([(0,)], "gene long")
    assert graph.expand(e, start, 0.5).count() == 6 and graph.hops(e, start, 2).count() == 3
    assert {r.gene: r.dist for r in graph.distances(e, 0).collect()} == {i: i / 2 for i in range(7)}


def test_path_tables(spark):
    e = made(spark, [(0, 1, 0.1), (1, 2, 0.1), (0, 2, 0.5), (3, 4, 0.2)])
    t = spark.createDataFrame([(2,), (4,), (2,), (0,)], "gene long")
    added = spark.createDataFrame([(1,)], "gene long")
    a = {r.terminal: r for r in paths.path_table(paths.paths_to(e, 0), t, added).collect()}
    assert (a[2].length_edges, a[2].total_weight, a[2].steiner_hops_used, a[2].score_neglog10_path, a[2].path) == (2, 0.2, 1, 2.0, "2;1;0")
    assert a[4].path == "No Path Available" and a[4].total_weight is None and a[0].path == "0" and a[0].length_edges == 0
    b = paths.path_table(paths.paths_to(e, 0, bottleneck=True), t, added, "bottleneck_p")
    both = paths.in_order(paths.combined_summary(paths.path_table(paths.paths_to(e, 0), t), b)).collect()
    assert [(r.terminal, r.minsum_totalweight, r.bottleneck_p) for r in both] == [(0, 0.0, 0.0), (2, 0.2, 0.1), (4, None, None)]
    # A gene of interest that is not in the network: no terminal has a path.
    assert {r.path for r in paths.path_table(paths.paths_to(e, 99), t).collect()} == {"No Path Available"}


def test_consensus_clusters(spark):
    rows = [(run, g, int(g >= 3) if run < 4 else int(g >= 2)) for run in range(5) for g in range(6)]
    parts = spark.createDataFrame(rows, "run long, gene long, community long")
    got = {r.gene: r.community for r in community.consensus_clusters(parts).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    m = community.consensus_metrics(community.consensus_clusters(parts), 9).first()
    assert (m.communities, m.largest, m.present, m.home, m.home_size) == (2, 3, False, -1, 0)
    with pytest.raises(ValueError, match="more than 3"):
        community.consensus_clusters(parts, max_genes=3)


def test_top_consensus_network_keeps_isolated_genes(spark):
    e = spark.createDataFrame([("ka", "LB", 0.01), ("LB", "x", 0.01)], "gene1 string, gene2 string, p_value double")
    f = spark.createDataFrame([("KA", 0.9), ("lb", 0.8), ("solo", 0.7), ("x", 0.1)], "gene string, frequency double")
    inner, nodes = community.top_consensus_network(e, f, 0.75, "Goi", 0.05)
    assert [(r.gene1, r.gene2) for r in inner.collect()] == [("ka", "LB")]
    assert {(r.gene, r.isolated) for r in nodes.collect()} == {("ka", False), ("LB", False), ("solo", True), ("Goi", True)}


def test_pair_count_audit(spark):
    e = made(spark, [(0, 1, 0.1), (1, 0, 0.2)])
    assert edges.pair_count_audit(e, 2) == 2
    with pytest.raises(ValueError, match="expected 6"):
        edges.pair_count_audit(e, 3)
