import numpy as np
import pytest

from causeway.functions.stats import f_tail_numpy
from causeway.operators import community, edges, granger, graph, preprocess, ranking
from causeway.sources import readers


def test_granger_matches_least_squares(spark):
    rng = np.random.default_rng(42)
    series = rng.normal(size=(25, 24)).cumsum(1)
    f, p, df = granger.pair_tests(series, series)
    for i, j in [(0, 1), (3, 7), (24, 2)]:
        y, l, x = series[j, 1:], series[j, :-1], series[i, :-1]
        one = np.ones_like(y)
        rss = lambda m: ((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum()
        r, u = rss(np.stack([one, l], 1)), rss(np.stack([one, l, x], 1))
        assert f[i, j] == pytest.approx((r - u) / (u / df), rel=1e-8)
    rows = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(series)], "gene long, series array<double>")
    assert granger.granger(rows, block=7).count() == 600


def test_constant_series_fail(spark):
    rows = spark.createDataFrame([(g, [1.0] * 8) for g in "ABC"], "gene string, series array<double>")
    assert granger.granger(rows).count() == 0
    audit = granger.granger(rows, audit=True).collect()
    assert len(audit) == 6 and all(r.p_value is None and r.error == "constant data" for r in audit)


def test_probe_pairs(spark):
    genes = spark.createDataFrame([(g,) for g in "ABCD"], "gene string")
    probes = spark.createDataFrame([("A",), ("B",)], "gene string")
    found = {(r.gene1, r.gene2) for r in granger.probe_pairs(genes, probes).collect()}
    assert len(found) == 10 and ("C", "D") not in found


def test_f_tail_is_a_probability():
    p = f_tail_numpy(np.array([0.0, 0.5, 4.0, 60.0]), 60)
    assert p[0] == 1 and np.all(np.diff(p) < 0) and p[-1] < 1e-9


def test_robust_mean_and_median(spark):
    m = spark.createDataFrame([("g", 1, v) for v in (1.0, 2.0, 9.0)], "gene string, t int, value double")
    w = np.array([1 / 2, 1, 1 / 8])
    assert preprocess.aggregate_replicates(m, "robust").first().value == pytest.approx((w @ [1, 2, 9]) / w.sum())
    assert preprocess.aggregate_replicates(m, "median").first().value == 2.0


def test_deseq_equalises_samples(spark):
    m = spark.createDataFrame([("A", 1, 10.0), ("A", 2, 20.0), ("B", 1, 20.0), ("B", 2, 40.0)], "gene string, t int, value double")
    v = {(r.gene, r.t): r.value for r in preprocess.deseq(m, ["t"]).collect()}
    assert v["A", 1] == pytest.approx(v["A", 2]) and v["B", 1] == pytest.approx(2 * v["A", 1])


def test_expansion_follows_passing_edges(spark):
    e = spark.createDataFrame([("ZEB2", "A", 0.001), ("A", "B", 0.001), ("C", "D", 0.001), ("ZEB2", "E", 0.2)], "gene1 string, gene2 string, p_value double")
    got = {(r.gene1, r.gene2) for r in graph.expand(e, spark.createDataFrame([("ZEB2",)], "gene string"), 0.01).collect()}
    assert got == {("ZEB2", "A"), ("A", "B")}


def test_top_percent_keeps_the_gene_of_interest(spark):
    f = spark.createDataFrame([("K", 0.9), ("L", 0.8), ("M", 0.1)], "gene string, frequency double")
    assert {r.gene for r in ranking.top_percent(f, 33, "M").collect()} == {"K", "M"}
    # A gene that the table does not have is put in all the same, in front and without a frequency.
    assert [(r.gene, r.frequency) for r in ranking.top_percent(f, 33, "Z").collect()] == [("Z", None), ("K", 0.9)]
    assert {r.gene for r in ranking.min_frequency(f, 0.7, "Z").collect()} == {"K", "L", "Z"}
    assert {r.gene for r in ranking.top_consensus(f, 0.5, "m").collect()} == {"K", "L", "M"}


def test_spanning_forest_weight(spark):
    e = spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.2), (0, 2, 0.9), (5, 6, 0.3)], "gene1 long, gene2 long, p_value double")
    assert sorted(r.w for r in graph.spanning_forest(e).collect()) == [0.1, 0.2, 0.3]
    d = {r.gene: r.dist for r in graph.distances(e, 0).collect()}
    assert d[2] == pytest.approx(0.3)
    assert {r.gene: r.dist for r in graph.distances(e, 0, bottleneck=True).collect()}[2] == pytest.approx(0.2)


def test_louvain_finds_planted_groups():
    pairs = [(a, b) for lo in (0, 6) for a in range(lo, lo + 6) for b in range(a + 1, lo + 6)] + [(0, 6)]
    u, v = np.array(pairs).T
    label = community.louvain(u, v, 12, 3)
    assert len(set(label[:6])) == len(set(label[6:])) == 1 and label[0] != label[6]


def test_readers(spark, tmp_path):
    (tmp_path / "genes.txt").write_text("# seeds\nA\n\nB\nA\n")
    assert [r.gene for r in readers.gene_list(spark, f"file://{tmp_path}/genes.txt").orderBy("pos").collect()] == ["A", "B"]
    (tmp_path / "m.csv").write_text("Gene,0,2,3,5,10\nA,1,2,3,4,5\n")
    assert readers.expression_matrix(spark, f"file://{tmp_path}/m.csv").count() == 5
    (tmp_path / "e.csv").write_text("gene1,gene2,lag,p-value\nA,B,1,0.5\nA,C,1,NaN\n")
    assert [r.p_value for r in readers.edge_table(spark, f"file://{tmp_path}/e.csv").orderBy("gene2").collect()] == [0.5, None]


def test_degrees_count_both_ends(spark):
    e = spark.createDataFrame([("A", "B", 0.1), ("A", "C", 0.1)], "gene1 string, gene2 string, p_value double")
    assert {r.gene: (r.in_degree, r.out_degree) for r in edges.degrees(e).collect()} == {"A": (0, 2), "B": (1, 0), "C": (1, 0)}
