"""Readers of line-numbered files, runs, parameters and summaries, on small files."""

import numpy as np
import pytest
from locusweave.sources import annotations, tracks
from pyspark.sql import functions as F


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "4k"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_line_numbers_across_tasks(spark, tmp_path, small_splits):
    """A file of many ranges, one of a few lines, one with odd ends of lines, an empty one."""
    large = [f"{i} " + "x" * (i * 7919 % 50) for i in range(40_000)]
    (tmp_path / "large.txt").write_text("\n".join(large) + "\n")
    (tmp_path / "few.txt").write_text("one\n\nthree")
    (tmp_path / "dos.txt").write_bytes(b"a\r\nb\r\n" * 9000)
    (tmp_path / "none.txt").write_text("")
    df = tracks.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    got = {}
    for r in df.collect():
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.line] = r.value
    assert got["large.txt"] == dict(enumerate(large))
    assert got["few.txt"] == {0: "one", 1: "", 2: "three"} and got["dos.txt"] == {i: "ab"[i % 2] for i in range(18_000)} and "none.txt" not in got


def test_state_directory_is_split(spark, tmp_path, small_splits):
    """A chromosome of many bins is read by several tasks and equals a plain reading."""
    p = np.round(np.random.default_rng(1).dirichlet([1, 1, 1], 30_000), 4)
    (tmp_path / "cell_3_chr2_posterior.txt").write_text("cell\tchr2\nE1\tE2\tE3\n" + "".join("\t".join(map(str, x)) + "\n" for x in p.tolist()))
    (tmp_path / "cell_3_chr10_posterior.txt").write_text("cell\tchr10\nE1\tE2\tE3\n0.5\t0.5\t0\n\n")
    df = tracks.read_state_directory(spark, str(tmp_path))
    rows = df.where("chr = 'chr2'").orderBy("start").collect()
    assert [(r.start, r.end) for r in rows] == [(i * 200, i * 200 + 200) for i in range(30_000)]
    assert np.array_equal(np.array([r.p for r in rows]), p)
    assert [tuple(r) for r in df.where("chr = 'chr10'").collect()] == [("chr10", 0, 200, [0.5, 0.5, 0.0])]
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 4


def test_ids_from_one(spark, tmp_path):
    (tmp_path / "one.bed").write_text("chr\tstart\tend\tposterior1\tposterior2\nchr1\t0\t200\t0.25\t0.75\n")
    (tmp_path / "zero.bed").write_text("chr\tstart\tend\tposterior0\tposterior1\nchr1\t0\t200\t0.5\t0.5\n")
    a, b, names = tracks.read_pair(spark, str(tmp_path / "one.bed"), str(tmp_path / "zero.bed"))
    assert names == ["posterior0", "posterior1"] and a.first().p == [0.25, 0.75] and b.first().p == [0.5, 0.5]
    assert tracks.read_pair(spark, *[str(tmp_path / "one.bed")] * 2)[2] == ["posterior1", "posterior2"]
    (tmp_path / "three.bed").write_text("chr\tstart\tend\tposterior0\tposterior1\tposterior2\nchr1\t0\t200\t0.5\t0.3\t0.2\n")
    a, b, names = tracks.read_pair(spark, str(tmp_path / "three.bed"), str(tmp_path / "zero.bed"))
    assert names == ["posterior0", "posterior1"] and a.first().p == [0.5, 0.3]
    assert tracks.ids_from_zero(["Promoter", "posterior3"]) == ["Promoter", "posterior3"] and tracks.ids_from_zero([]) == []


def test_csv_posteriors(spark, tmp_path):
    (tmp_path / "p.csv").write_text(",chrom,start,end,posterior0,posterior1\n0,chr1_1,0,200,0.5,\n1,chr1_2,200,400,NaN,1\n")
    df, names = tracks.read_posterior(spark, str(tmp_path / "p.csv"), "csv")
    assert names == ["posterior0", "posterior1"]
    assert [tuple(r) for r in df.orderBy("start").collect()] == [("chr1", 0, 200, [0.5, None]), ("chr1", 200, 400, [None, 1.0])]


def test_state_parameters(spark, tmp_path):
    (tmp_path / "g.csv").write_text(",mean_a,cov_a\n0,1.5,2\n1,x,4\n")
    named = {(r.state, r.parameter): r.value for r in annotations.read_state_parameters(spark, str(tmp_path / "g.csv")).collect()}
    assert named == {(0, "mean_a"): 1.5, (0, "cov_a"): 2.0, (1, "mean_a"): None, (1, "cov_a"): 4.0}
    (tmp_path / "h.csv").write_text("mean_a,cov_a\n1,2\n3,4\n")
    plain = annotations.read_state_parameters(spark, str(tmp_path / "h.csv"))
    assert {(r.state, r.parameter): r.value for r in plain.collect()} == {(0, "mean_a"): 1.0, (0, "cov_a"): 2.0, (1, "mean_a"): 3.0, (1, "cov_a"): 4.0}
    lengths = spark.createDataFrame([(0, 100.0, 7.0), (1, 300.0, 7.0)], "state int, mean double, stdev double")
    both = {(r.state, r.at): r.x for r in annotations.state_features(lengths, plain).collect()}
    assert both[0, "length:mean"] == 0 and both[1, "length:mean"] == 1 and both[1, "length:stdev"] == 0 and both[1, "cov_a"] == 4 and len(both) == 8
    assert {r.x for r in annotations.state_features(lengths, plain, scale=False).where("at = 'length:mean'").collect()} == {100.0, 300.0}


def test_run_summaries(spark, tmp_path):
    for cell, track, assay in (("K1", "t1", "H3K4me3"), ("K1", "t2", "CTCF"), ("K2", "t1", "H3K4me3")):
        folder = tmp_path / cell / track
        folder.mkdir(parents=True)
        (folder / "track_files_metadata.csv").write_text(f",rep1_alig,rep1_fcoc,rep2_alig,rep2_fcoc\nassay,{assay},{assay},{assay},{assay}\nbiosample,B1,B1,B2,B2\naccession,{cell}a,{cell}b,{cell}c,{cell}d\n")
    got = {tuple(r) for r in annotations.track_summary(spark, str(tmp_path)).collect()}
    assert len(got) == 6 and ("K1", "CTCF", "B1 (rep. 1)", "K1a, K1b") in got and ("K2", "H3K4me3", "B2 (rep. 2)", "K2c, K2d") in got
    assert {tuple(r) for r in annotations.track_assays(spark, str(tmp_path / "K1")).collect()} == {("t1", "H3K4me3"), ("t2", "CTCF")}


def test_metrics_of_runs(spark, tmp_path):
    for s, m, c, text in (("concat", "chmm", "K1", "Prom|zp_val=0.25\nProm|conf_nonconf_ratio=nan\nodd line\nQuie|zp_val=x\n"), ("r1vsr2", "segway", "K2", "Enha low|Pearson_r = -0.5\nEnha low|Spearman's rho = 1e-3\n")):
        folder = tmp_path / s / m / c
        folder.mkdir(parents=True)
        (folder / "metrics.txt").write_text(text)
    got = annotations.read_metrics(spark, str(tmp_path), "metrics.txt").where(~F.isnan("value")).collect()
    assert {tuple(r) for r in got} == {("concat", "chmm", "K1", "Prom", "zp_val", 0.25), ("r1vsr2", "segway", "K2", "Enha low", "Pearson_r", -0.5), ("r1vsr2", "segway", "K2", "Enha low", "Spearman's rho", 0.001)}
