import numpy as np
import pytest

from causeway.operators import granger, preprocess, quantiles, ranking, regression, validate


def series(spark, rows):
    return spark.createDataFrame(rows, "gene string, series array<double>")


def test_every_failure_has_its_reason(spark):
    rng = np.random.default_rng(0)
    good = rng.normal(size=12).cumsum().tolist()
    rows = [("good", good), ("other", rng.normal(size=12).tolist()), ("flat", [2.0] * 12), ("gap", [None, *good[1:]]), ("long", [*good, 1.0]), ("tiny", [1.0, 2.0, 3.0]), ("tiny2", [1.0, 2.0, 4.0])]
    got = {(r.gene1, r.gene2): r for r in granger.granger(series(spark, rows), audit=True, block=3).collect()}
    assert len(got) == 42 and got["good", "other"].error is None and 0 <= got["good", "other"].p_value <= 1
    assert got["good", "flat"].error == "constant data" and got["gap", "good"].error == "missing value"
    assert got["good", "long"].error == "unequal length" and got["tiny", "tiny2"].error == "too few points"
    assert all((r.p_value is None) == (r.error is not None) for r in got.values())


def test_a_finished_run_is_not_run_again(spark, tmp_path):
    rng = np.random.default_rng(1)
    s = series(spark, [(f"g{i}", rng.normal(size=20).cumsum().tolist()) for i in range(9)])
    path = f"file://{tmp_path}/gc"
    table, ran = granger.resumable(spark, s, path, 1.0, waves=3)
    assert ran == 3 and table.count() == 72
    assert granger.resumable(spark, s, path, 1.0, waves=3)[1] == 0
    import shutil

    shutil.rmtree(tmp_path / "gc/wave=1")
    again, ran = granger.resumable(spark, s, path, 1.0, waves=3)
    assert ran == 1 and {(r.gene1, r.gene2, r.p_value) for r in again.collect()} == {(r.gene1, r.gene2, r.p_value) for r in granger.granger(s).collect()}
    assert granger.resumable(spark, s, path, 0.5, waves=3)[1] == 3
    # Pairs of a table that is already there are left out, whole blocks before any test.
    everything = granger.granger(s)
    assert granger.granger(s, done=everything, block=4).count() == 0
    part = everything.where("gene1 < 'g4'")
    assert granger.granger(s, done=part, block=4).count() == 72 - part.count()


def test_fixture_pairs_reach_the_first_targets(spark):
    genes = spark.createDataFrame([("a",), ("b",)], "gene string")
    targets = spark.createDataFrame([("x", 0), ("a", 1), ("y", 2)], "gene string, pos int")
    got = {(r.gene1, r.gene2) for r in granger.fixture_pairs(genes, targets, first=2).collect()}
    assert got == {("a", "x"), ("x", "a"), ("b", "x"), ("x", "b"), ("b", "a"), ("a", "b")}
    assert {(r.gene1, r.gene2, r.p_value) for r in granger.fixture_pairs(genes).collect()} == {("a", "b", 0.001), ("b", "a", 0.001)}


def test_quantiles_by_bins_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.random(3000), np.full(500, 0.25), rng.random(50) * 1e-9])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    qs = [0.0, 0.013, 0.2, 0.25, 0.5, 0.999, 1.0]
    monkeypatch.setattr(quantiles, "ONE_TASK", 40)
    monkeypatch.setattr(quantiles, "BINS", 16)
    assert quantiles.exact_quantiles(df, "v", qs) == pytest.approx(np.quantile(x, qs).tolist(), abs=1e-15)
    assert quantiles.exact_quantiles(df.limit(0), "v", [0.5]) == [None]
    with pytest.raises(ValueError, match="quantile"):
        ranking.lower_quantile(df, 0.0, "v")


def test_options_and_phases(spark):
    m = spark.createDataFrame([("u", 1, "a", 3.0), ("u", 1, "b", 5.0), ("w", 1, "a", 1.0), ("w", 1, "b", 3.0), ("zero", 1, "a", 0.0), ("zero", 1, "b", 0.0)], "gene string, t int, rep string, value double")
    done, reps = preprocess.prepare(m, None, "log+1")
    want = {"u": (np.log1p(3) + np.log1p(5)) / 2, "w": (np.log1p(1) + np.log1p(3)) / 2}
    assert {r.gene: r.value for r in done.collect()} == pytest.approx(want) and reps.count() == 4
    for wrong in ({"normalise": "nope"}, {"transform": "cube"}, {"aggregation": "max"}):
        with pytest.raises(ValueError, match="no such"):
            preprocess.prepare(m, **wrong)
    with pytest.raises(ValueError, match="negative"):
        preprocess.prepare(m.withColumn("value", -m["value"]), None, "sqrt")


def test_sample_columns(spark):
    rows = [("g", "WT_d3_r1", 1.0), ("g", "KO_d3_r1", 2.0), ("g", "SRR77 Day 12 x", 4.0), ("g", "SRR9", 5.0)]
    m = spark.createDataFrame(rows, "gene string, label string, value double")
    assert [(r.t, r.value) for r in preprocess.day_replicates(m, "wild_type").collect()] == [(3, 1.0)]
    assert [(r.t, r.value) for r in preprocess.day_replicates(m, "runs").collect()] == [(12, 4.0)]


def test_both_directions_match_least_squares(spark):
    rng = np.random.default_rng(5)
    t = np.repeat(np.arange(5.0), 7)
    data = {"anchor": rng.normal(size=35) + t, "bent": (t - 2) ** 2 + rng.normal(size=35) * 0.2, "flat": np.zeros(35)}
    data["led"] = 2.75 * data["anchor"] + 0.5 * t + rng.normal(size=35) * 0.05
    rows = [(g, int(t[i]), f"r{i % 7}", float(v[i])) for g, v in data.items() for i in range(35)] + [("short", 0, "r0", 1.0)]
    m = spark.createDataFrame(rows, "gene string, t int, rep string, value double")
    got = {(r.predictor, r.target): r for r in regression.both_directions(m, "anchor", expected=35, per_time=7).collect()}
    assert len(got) == 8 and abs(got["anchor", "led"].predictor_coefficient - 2.75) < 0.05
    assert got["anchor", "bent"].selected_time_model == "quadratic" and got["anchor", "led"].selected_time_model == "linear"
    for (x, y), r in got.items():
        if r.status == "ok":
            cols = [np.ones(35), t, *([t * t] if r.selected_time_model == "quadratic" else []), data[x]]
            a = np.stack(cols, 1)
            coef = np.linalg.lstsq(a, data[y], rcond=None)[0]
            sse = ((data[y] - a @ coef) ** 2).sum()
            se = np.sqrt(sse / (35 - a.shape[1]) * np.linalg.inv(a.T @ a)[-1, -1])
            assert r.predictor_coefficient == pytest.approx(coef[-1]) and r.final_model_sse == pytest.approx(sse) and r.predictor_t_statistic == pytest.approx(coef[-1] / se)
            assert r.residual_degrees_of_freedom == 35 - a.shape[1] and r.n_observations == 35
    assert got["short", "anchor"].status == "failed" and "aligned" in got["anchor", "short"].error
    assert got["flat", "anchor"].error == "singular fit" and got["anchor", "flat"].error == "singular fit"
    with pytest.raises(ValueError, match="absent"):
        regression.both_directions(m, "nobody")


def test_checks(spark):
    m = spark.createDataFrame([(g, t, 1.0 * t) for g in "ab" for t in range(5)], "gene string, t int, value double")
    seeds = spark.createDataFrame([("a",), ("b",)], "gene string")
    assert validate.check_matrix(m, "a", seeds) is m
    for text, bad in (("missing", (m, "q", seeds)), ("fewer than 2", (m, "a", seeds.limit(1))), ("points", (m.where("t < 3"), "a", seeds)), ("duplicate", (m.union(m), "a", seeds)), ("empty", (m.limit(0), "a", seeds))):
        with pytest.raises(ValueError, match=text):
            validate.check_matrix(*bad)
    with pytest.raises(ValueError, match="negative"):
        validate.check_matrix(m.withColumn("value", -m["value"]), "a", seeds, "log1p")
    f = spark.createDataFrame([(i, f"g{i}", 1 - i / 100) for i in range(50)] + [(50, "up", 0.9)], "pos int, gene string, frequency double")
    assert [r.gene for r in validate.unsorted(f, "pos").collect()] == ["up"]
    with pytest.raises(ValueError, match="sorted"):
        validate.check_frequency(f, "g1", "pos")
    e = spark.createDataFrame([("a", "b", 0.1), ("a", "a", float("inf"))], "gene1 string, gene2 string, p_value double")
    with pytest.raises(ValueError, match="self pairs"):
        validate.check_edges(e)
    with pytest.raises(ValueError, match="at least 3"):
        validate.gene_list(seeds, 3)
    with pytest.raises(MemoryError):
        validate.fits_memory(10_000, 1 << 20)
