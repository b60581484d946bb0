"""Readers and writers of annotations against files written by the tests."""

import pytest
from locusweave.operators import core
from locusweave.sources import annotations, tracks
from pyspark.sql import functions as F


def rows(df, *order):
    return [tuple(x) for x in (df.orderBy(*order) if order else df).collect()]


def test_plain_tables(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert rows(annotations.read_sizes(spark, put("s.txt", "chr1\t500\nchr2\t40\n")), "chr") == [("chr1", 500), ("chr2", 40)]
    assert rows(annotations.read_include(spark, put("i.bed", "track x\nchr1\t0\t9\textra\n")), "chr") == [("chr1", 0, 9)]
    assert rows(annotations.read_regions(spark, put("r.tsv", "seqname\tstart\tend\nchr1\t5\t9\n")), "chr") == [("chr1", 5, 9)]
    assert rows(annotations.read_tss(spark, put("t.txt", "chr1\t77\t+\nchr2\t5\t-\n")), "chr") == [("chr1", 77, "+"), ("chr2", 5, "-")]
    bed = put("a.bed", "browser position\ntrack name=x\nchr1\t0\t200\t3\t1000\t.\t0\t200\t1,2,3\n")
    assert rows(annotations.read_segmentation(spark, bed)) == [("chr1", 0, 200, "3", "1,2,3")]
    put("by/posterior0.bedGraph", "chr1\t0\t3\t50\nchr2\t0\t2\t10\n")
    put("by/posterior12.bedGraph", "track\nchr1\t0\t3\t25\n")
    states = annotations.read_by_state(spark, str(tmp_path / "by"))
    assert rows(states, "state", "chr") == [(0, "chr1", 0, 3, 0.5), (0, "chr2", 0, 2, 0.1), (12, "chr1", 0, 3, 0.25)]
    assert rows(annotations.base_pairs(states.where("state = 0"), "chr1"), "position") == [("chr1", i, 0.5) for i in range(3)]
    assert rows(annotations.read_signal_distribution(spark, put("d.tab", "label\ttrackname\tmean\tsd\tn\n0\tH3\t1.5\t0.5\t9\n"))) == [("0", "H3", 1.5, 0.5)]
    assert rows(annotations.read_matrix(spark, put("e.txt", "state\tA\tB.x\n1\t0.1\t0.2\n2\t0.3\tno\n")), "row", "column") == [("1", "A", 0.1), ("1", "B.x", 0.2), ("2", "A", 0.3), ("2", "B.x", None)]
    assert rows(annotations.read_lengths(spark, put("l.tab", "label\tnum.segs\tmean.len\tstdev.len\tnum.bp\tfrac.bp\nall\t9\t2\t1\t18\t1\n0\t4\t2.5\t1\t10\t0.5\n"))) == [("0", 4, 2.5, 10)]
    put("runs/one/metadata.tsv", "assay\tchip\n")
    assert rows(annotations.read_metadata(spark, str(tmp_path / "runs"))) == [("one", "assay", "chip")]
    put("res/s/m/c/r.txt", "label\tx\na\t1\n")
    assert rows(annotations.read_results(spark, str(tmp_path / "res"), "r.txt")) == [("s", "m", "c", "a", "1")]


def test_aggregation(spark, tmp_path):
    (tmp_path / "agg.tab").write_text("# 0=100 1=300 num_features=5 spacers=2\ngroup\tcomponent\toffset\t0\t1\ng\tup\t-2\t5\t6\ng\tup\t-1\t7\t8\ng\tbody\t0\t1\t2\n")
    raw, bases = annotations.read_aggregation(spark, str(tmp_path / "agg.tab"))
    assert rows(bases, "label") == [("0", 100), ("1", 300)]
    assert rows(raw, "component", "offset", "label") == [("0", "body", 0, 1), ("1", "body", 0, 2), ("0", "up", 0, 5), ("1", "up", 0, 6), ("0", "up", 1, 7), ("1", "up", 1, 8)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), (None, 2, 0.25)], "map string, n int, r double")
    path = str(tmp_path / "report")
    assert annotations.write_once(df, path) and not annotations.write_once(df.limit(0), path) and annotations.exists(spark, path)
    assert spark.read.csv(path, sep="\t", header=True).count() == 2
    assert sorted(x.value for x in annotations.report_lines(df, "map", ["n", "r"]).collect()) == ["a: n = 1, r = 0.5", "all: n = 2, r = 0.25"]
    matrix = spark.createDataFrame([("b", "a", 3.0), ("a", "a", 1.0), ("a", "b", 2.0), ("b", "b", 4.0)], "k string, j string, value double")
    annotations.write_matrix(matrix, str(tmp_path / "m"), ["b", "a"])
    assert [tuple(x) for x in spark.read.csv(str(tmp_path / "m"), header=True).collect()] == [("b", "4.0", "3.0"), ("a", "2.0", "1.0")]
    pairs = spark.createDataFrame([("chr1", 0, 200, [0.25, 0.75])], "chr string, start long, end long, p1 array<double>")
    annotations.write_merged(pairs, str(tmp_path / "p"), ["a", "b+c"])
    back, labels = tracks.read_posterior(spark, str(tmp_path / "p"))
    assert labels == ["a", "b+c"] and rows(back) == [("chr1", 0, 200, [0.25, 0.75])]
    one, two = spark.createDataFrame([("s", 1)], "run string, x int"), spark.createDataFrame([("s", 5), ("t", 6)], "run string, y int")
    assert rows(annotations.integrated({"one": one, "two": two}, ["run"]), "run") == [("s", 1, 5), ("t", None, 6)]


def test_bins_and_writers(spark, tmp_path):
    regions = spark.createDataFrame([("chr1", 100, 450)], "chr string, start long, end long")
    assert rows(tracks.bins_of_regions(regions, 200), "start") == [("chr1", 100, 300), ("chr1", 300, 500)]
    bins = spark.createDataFrame([("chr1", 0, 10), ("chr1", 10, 20)], "chr string, start long, end long")
    track = spark.createDataFrame([("chr1", 5, 15, 2.0), ("chr1", 15, 17, 10.0)], "chr string, start long, end long, value double")
    assert rows(tracks.weighted_bins(bins, track), "start") == [("chr1", 0, 10, 1.0), ("chr1", 10, 20, 3.0)]
    long = spark.createDataFrame([("chr1", 0, 10, 0.25, "a"), ("chr1", 0, 10, 0.75, "b")], "chr string, start long, end long, value double, file string")
    assert rows(tracks.combine_labels(long, "file", ["a", "b", "c"])) == [("chr1", 0, 10, [0.25, 0.75, None])]
    (tmp_path / "genes.csv").write_text(",chr,start,end,strand,gene_id\n0,chr1,0,100,+,g1\n1,chr1,50,70,+,g2\n2,chr1,200,300,-,g3\n3,chr1,400,500,+,g4\n")
    assert [x.gene_id for x in tracks.read_genes(spark, str(tmp_path / "genes.csv")).orderBy("start").collect()] == ["g1", "g4"]
    (tmp_path / "e.tsv").write_text("gene_id\tTPM\ng1.4\t2.5\ng1.7\t9\ng2\t0\n")
    assert rows(tracks.read_expression(spark, str(tmp_path / "e.tsv")), "gene_id") == [("g1", 2.5), ("g2", 0.0)]
    segments = spark.createDataFrame([("chr1", 0, 10, "Tss"), ("chr1", 10, 30, "zzz")], "chr string, start long, end long, label string")
    found = rows(tracks.browser_rows(segments, {"TSS": (1.0, 0.0, 0.5)}), "chromStart")
    assert [(x[3], x[8]) for x in found] == [("Tss", "255,0,127"), ("zzz", "0,0,0")]
    tracks.write_track(segments, str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w"), sep="\t", header=True).count() == 2


def test_pairing_and_posterior_columns(spark):
    one = spark.createDataFrame([("chr2", 0, 10, [0.5, 0.5]), ("chr1", 10, 20, [1.0, 0.0]), ("chr1", 0, 10, [0.25, 0.75])], "chr string, start long, end long, p array<double>")
    two = one.where("chr = 'chr1'")
    assert [(x.idx, x.chr, x.start) for x in core.pair(one, two).orderBy("idx").collect()] == [(0, "chr1", 0), (1, "chr1", 10)]
    merged, names = core.merge_labels("p", ["a", "b"], "a", "b")
    got = one.select(merged.alias("m"), core.normalise(F.transform("p", lambda x: x * 4)).alias("n"), core.sigmoid(core.logit("p")).alias("s"), "p").collect()
    assert names == ["a+b"] and all(x.m == [1.0] and x.n == pytest.approx(x.p) and x.s == pytest.approx(x.p, abs=1e-9) for x in got)
    nan = spark.createDataFrame([([float("nan"), 0.5],)], "p array<double>")
    assert nan.select(core.map_label(core.clean("p"), ["a", "b"])).first()[0] == "b"
