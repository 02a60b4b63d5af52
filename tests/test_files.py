import json

import pytest

from causeway.operators import preprocess, validate
from causeway.plans.runner import Config, Runner
from causeway.sources import readers, writers


def test_run_labels():
    runs = [("SRR1", "Day 0"), ("SRR12", "Day 5")]
    got = readers.run_labels(["a/SRR12_x_REF_hg", "SRR7", "SRR3_REF"], runs)
    assert got == {"a/SRR12_x_REF_hg": "a/SRR1_Day 02_x", "SRR7": "SRR7", "SRR3_REF": "SRR3"}


def test_datasets(spark, tmp_path):
    url = f"file://{tmp_path}"
    (tmp_path / "wt.tsv").write_text("Gene\tWT_d0_1\tWT_d0_2\tKO_d0_1\tWT_d2_1\nA\t1\t3\t9\t4\nZ\t0\t0\t5\t0\n")
    done, reps = preprocess.prepare(readers.wild_type_counts(spark, f"{url}/wt.tsv"))
    assert {(r.gene, r.t): r.value for r in done.collect()} == {("A", 0): 2.0, ("A", 2): 4.0} and reps.count() == 3
    (tmp_path / "fc.tsv").write_text("# made by a counter\nGeneid\tLength\tSRR1_REF\tSRR2_REF\nE1\t9\t2\tx\nE2\t9\t7\t8\nE3\t9\t1\t1\nbad\t1\n")
    (tmp_path / "map.tsv").write_text("E1\tA\nE2\told\nE2\tB\n")
    (tmp_path / "runs.csv").write_text("Run,Organism,Time_point\nSRR1,h,Day 3\nSRR2,h,Day 5\n")
    m = readers.run_counts(spark, f"{url}/fc.tsv", f"{url}/map.tsv", f"{url}/runs.csv")
    assert {(r.gene, r.t): r.value for r in m.collect()} == {("A", 3): 2.0, ("A", 5): 0.0, ("B", 3): 7.0, ("B", 5): 8.0}
    (tmp_path / "f.csv").write_text("symbol,my Freq\nA,0.5\nB,no\na,0.7\n,0.9\nA,0.6\n")
    assert {r.gene: r.frequency for r in readers.frequency_table(spark, f"{url}/f.csv").collect()} == {"A": 0.6, "a": 0.7}
    (tmp_path / "noise.tsv").write_text("1\t2\n3\t4\n")
    readers.tsv_to_csv(spark, f"{url}/noise.tsv", f"{url}/noise_csv")
    assert sorted(r.series for r in readers.noise_rows(spark, f"{url}/noise_csv").collect()) == [[1.0, 2.0], [3.0, 4.0]]


def test_bad_cells_and_empty_lists_fail(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Gene,a,b,c,d,e\nA,1,NaN,3,4,5\nB,1,x,3,4,5\n")
    m = readers.expression_matrix(spark, f"file://{tmp_path}/m.csv")
    assert m.where("gene = 'A' and value is null").count() == 1
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        m.collect()
    (tmp_path / "none.txt").write_text("# nothing\n\n")
    with pytest.raises(ValueError, match="no genes"):
        readers.gene_list(spark, f"file://{tmp_path}/none.txt")


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([("a", "b", 0.1, None), ("b", "c", None, "constant data")], "gene1 string, gene2 string, p_value double, error string")
    url = f"file://{tmp_path}"
    writers.edges_csv(e, f"{url}/all", errors=True)
    writers.edges_csv(e, f"{url}/all", errors=True)
    assert spark.read.option("header", True).csv(f"{url}/all").count() == 4
    writers.edges_csv(e, f"{url}/good")
    assert [(r.gene1, float(r["p-value"])) for r in spark.read.option("header", True).csv(f"{url}/good").collect()] == [("a", 0.1)]
    writers.rounded_csv(e, f"{url}/four")
    assert {r["p-value"] for r in spark.read.option("header", True).csv(f"{url}/four").collect()} == {"0.1", "NaN"}
    good = e.where("p_value is not null")
    paths = writers.bundle(good, str(tmp_path / "net"), {"density": 0.5})
    nodes, edges = readers.graphml(paths["graphml"])
    assert nodes == ["a", "b"] and edges == [("a", "b", 0.1)]
    summary = json.loads((tmp_path / "net/summary.json").read_text())
    listed = spark.createDataFrame([(n,) for n in nodes], "gene string")
    validate.bundle(good, listed, summary, len(edges), set(nodes))
    with pytest.raises(ValueError, match="edges"):
        validate.bundle(good, listed, summary, 7, set(nodes))
    assert readers.resolve("edges.csv", str(tmp_path)) == paths["edges"] and writers.result_name(0.05, 3, 20) == "granger_results_p0.05_3of20.csv"
    with pytest.raises(FileNotFoundError):
        readers.resolve("nothing.csv", str(tmp_path))
    assert writers.benchmark("gc", 2.0, 0.0)["speedup"] == float("inf")


def test_runner_options(spark, tmp_path):
    lines = ["Gene," + ",".join(map(str, range(6)))] + [f"G{i}," + ",".join(str(i + j) for j in range(6)) for i in range(3)]
    (tmp_path / "m.csv").write_text("\n".join([*lines, "G0," + ",".join(["8"] * 6)]) + "\n")
    c = Config(f"file://{tmp_path}/m.csv", "genes", "out", "G0", normalise="deseq2", transform="log+1", aggregation="median")
    rows = Runner(spark, c)._prepare().collect()
    assert len(rows) == 18 and all(r.value >= 0 for r in rows)
    for wrong in ({"normalise": "nope"}, {"aggregation": "max"}, {"dataset": "runs"}, {"transform": "cube"}):
        with pytest.raises(ValueError, match=next(iter(wrong))):
            Config("m", "g", "o", "G0", **wrong)
