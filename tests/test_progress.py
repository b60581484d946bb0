"""Merging with calibration, grids of information, contiguous windows, roll-ups, clusters, single points, against plain loops."""

import math

import numpy as np
import pytest
from locusweave.operators import calibrate, core, edges, enrich, match, merging, overlap, progress, rollups, spatial, statistics, sweeps
from pyspark.sql import functions as F

LABELS = ["a", "b", "c", "d"]
N = 400


@pytest.fixture(scope="module")
def pairs(spark):
    r = np.random.default_rng(9)
    base = np.cumsum(r.standard_normal((N, 4)), 0) / 9
    soft = lambda z: np.exp(z) / np.exp(z).sum(1, keepdims=True)
    p1, p2 = soft(base), soft(base + r.standard_normal((N, 4)) * 0.8)
    rows = [(i, f"chr{1 + i // 150}", i % 150 * 200, i % 150 * 200 + 200, p1[i].tolist(), p2[i].tolist()) for i in range(N)]
    return core.with_map(spark.createDataFrame(rows, "idx long, chr string, start long, end long, p1 array<double>, p2 array<double>").repartition(3), LABELS).cache()


def test_calibrated_progress(pairs):
    """Each step against a calibration of its own from the start."""
    got = progress.calibrated_progress(pairs, LABELS, w=2, threshold=0.5, bins=20, robust=0.7)
    plain, one, two = merging.merge_progress(pairs, LABELS)
    assert [g[:5] for g in got] == [pytest.approx(x) for x in plain] and [g[0] for g in got] == [4, 3, 2]
    groups = [[i] for i in range(4)], [[i] for i in range(4)]
    for step in got:
        rows = merging.grouped(pairs, LABELS, *groups)
        names, others = (merging.group_names(g, LABELS) for g in groups)
        found = progress.two_way_matches(rows, names, others, 2, 0.5)
        r = calibrate.r_values(rows, names, 2, 0.5, 20, found).toPandas().r_value
        assert step[5:] == pytest.approx(((r >= 0.7).mean(), r.mean()))
        joint = merging.cells(rows, names, others)
        groups = merging.merged(groups[0], merging.best_pair(match.merging_gain(joint))), merging.merged(groups[1], merging.best_pair(match.merging_gain(joint.T)))
    assert progress.two_way_matches(pairs, LABELS, LABELS, 2, 0.5) == {k: sorted(v) for k, v in calibrate.matches_of(pairs, LABELS, 2, 0.5).items()}


@pytest.mark.parametrize("step", [1, 7, 64, 900])
def test_edges_of_strata(spark, step, monkeypatch):
    """Against ranks of all rows: values shared by many rows, missing ones, NaN, and values of one row each."""
    monkeypatch.setattr(edges, "LEAST", 5)
    r = np.random.default_rng(4)
    n = 700
    p = np.stack([r.integers(0, 3, n) / 2, r.random(n), np.where(np.arange(n) < 650, 0.25, r.random(n))], 1)
    cells = [[None if (i * 7 + k) % 11 == 0 and k < 2 else math.nan if (i + k) % 13 == 0 and k == 0 else float(p[i, k]) for k in range(3)] for i in range(n)]
    rows = spark.createDataFrame([(i, cells[i], i % 3 == 0) for i in range(n)], "idx long, p1 array<double>, s boolean").repartition(5)
    found = edges.edges(rows, range(3), step, n)
    counted = edges.hits(rows, found, {k: F.col("s") for k in range(3)}, n)
    for k, e in found.items():
        value = [-math.inf if c[k] is None else math.inf if math.isnan(c[k]) else c[k] for c in cells]
        order = sorted(range(n), key=lambda i: (value[i], i))  # noqa: B023
        want = np.empty(n, int)
        want[order] = np.arange(n) // step
        assert (edges.stratum(e, np.array(value), np.arange(n), n) == want).all()
        assert e.n.tolist() == np.bincount(want).tolist()
        assert counted[k].tolist() == np.bincount(want, weights=np.arange(n) % 3 == 0).astype(int).tolist()
        for b in range(len(e.n)):
            own = [cells[i][k] for i in order[b * step : (b + 1) * step] if cells[i][k] is not None] or [math.nan]
            assert e.low[b] == pytest.approx(own[0], nan_ok=True) and e.high[b] == pytest.approx(own[-1], nan_ok=True)


def test_windows_of_many_labels(spark):
    names = [f"s{i}" for i in range(140)]
    rows = spark.createDataFrame([(i, names[i * 53 % 140] if i % 9 else None) for i in range(300)], "idx long, m2 string").repartition(3)
    for w in (0, 4):
        plain = {r.idx: set(r.seen) for r in core.shown(rows, "m2", w).collect()}
        bits = core.shown_bits(rows, "m2", names, w).select("idx", F.array_compact(F.array(*[F.when(core.shows(i), F.lit(x)) for i, x in enumerate(names)])).alias("seen"))
        assert {r.idx: set(r.seen) for r in bits.collect()} == plain


def test_calibration_ranks_no_rows(spark, monkeypatch):
    """What is dealt to cells and sorted are the different posteriors, not the rows."""
    n = 3000
    shares = [(i * i % 7 / 6, i % 5 / 6) for i in range(n)]
    rows = [(i, "c", i * 200, i * 200 + 200, [a, 1 - a], [b, 1 - b]) for i, (a, b) in enumerate(shares)]
    table = core.with_map(spark.createDataFrame(rows, "idx long, chr string, start long, end long, p1 array<double>, p2 array<double>"), ["a", "b"]).cache()
    placed, real = [], core.celled

    def watched(basis, *rest):
        placed.append(basis.count())
        return real(basis, *rest)

    for module in (core, edges):
        monkeypatch.setattr(module, "celled", watched, raising=False)
    progress.calibrated_progress(table, ["a", "b"], 2, 0.5, 20)
    calibrate.r_values(table, ["a", "b"], 2, 0.5, 20).collect()
    assert placed and max(placed) <= 14


def test_labels_without_rows_merge_too(pairs):
    lone = pairs.withColumn("p1", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))).withColumn("m1", F.lit("a"))
    facts, one, two = merging.merge_progress(lone, LABELS)
    assert [x[0] for x in facts] == [4, 3, 2]
    assert sorted(sum(one, [])) == sorted(sum(two, [])) == [0, 1, 2, 3]


def test_grid_of_information(pairs):
    got = {(r.w, r.t): r for r in sweeps.nmi_grid(pairs, LABELS, [0.7, 0.2, 0.5], [0, 3, 1, 1]).collect()}
    assert len(got) == 9
    for (w, t), r in got.items():
        one = sweeps.nmi_after(pairs, LABELS, w, t).first()
        assert (r.kept, r.before) == (pytest.approx(one.kept), pytest.approx(one.before))
        assert r.after == pytest.approx(one.after)


def test_grid_of_r_values(pairs):
    back = pairs.select("idx", "chr", "start", "end", F.col("p2").alias("p1"), F.col("p1").alias("p2"), F.col("m2").alias("m1"), F.col("m1").alias("m2"))
    r = [calibrate.r_values(x, LABELS, 2, 0.5, 20).toPandas().set_index("idx") for x in (pairs, back)]
    for row in sweeps.nmi_grid_calibrated(pairs, LABELS, [0.6, 0.9], [2], 0.5, 20).collect():
        kept = (r[0].r_value.round(9) >= row.t) & (r[1].r_value.round(9) >= row.t)
        assert row.kept == pytest.approx(kept.mean())
        joint = np.zeros((4, 4))
        for a, b in zip(r[0]["map"][kept], r[1]["map"][kept], strict=True):
            joint[LABELS.index(a), LABELS.index(b)] += 1
        assert row.after == pytest.approx(merging.facts(joint / joint.sum())[2])


@pytest.mark.parametrize("together", [False, True])
@pytest.mark.parametrize("w", [0, 1, 6])
def test_contiguous_windows(pairs, spark, together, w, monkeypatch):
    """By the rule itself, on rows with gaps that are numbered anew; blocks of few positions."""
    gone = {*range(40, 55), 61, 148, 149, 151, 299, 302, *range(390, 396)}
    table = sorted((r for r in pairs.collect() if r.idx not in gone), key=lambda r: r.idx)
    rows = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(table)], pairs.schema)
    real = core.halo
    monkeypatch.setattr(enrich, "halo", lambda df, reach: real(df, reach, 32))
    got = {(r.k, r.j): r.joint for r in enrich.contiguous_overlap(rows, LABELS, w, together).collect()}
    n, want = len(table), {}
    chrom, start = [r.chr for r in table], [r.start for r in table]
    for i in range(n):
        up = max(d for d in range(w + 1) if i >= d and chrom[i - d] == chrom[i] and start[i] - start[i - d] == 200 * d)
        down = max(d for d in range(w + 1) if i + d < n and chrom[i + d] == chrom[i] and start[i + d] - start[i] == 200 * d)
        if together:
            both = max(d for d in range(w + 1) if chrom[max(0, i - d)] == chrom[i] == chrom[min(n - 1, i + d)])
            up, down = min(up, both), min(down, both)
        for j in {table[x].m2 for x in range(i - up, i + down)} if w else {table[i].m2}:
            want[table[i].m1, j] = want.get((table[i].m1, j), 0) + 1 / n
    assert got == pytest.approx(want)


def test_rollups(spark):
    rows = [("s1", "m", "c1", "x", 0.5, 2.0), ("s1", "m", "c1", "y", 0.5, 4.0), ("s1", "m", "c2", "x", 1.0, 6.0), ("s2", "m", "c1", "x", 1.0, 1.0)]
    runs = rollups.run_totals(spark.createDataFrame(rows, "setting string, model string, cell string, state string, coverage double, auc double"), ["auc"], "coverage")
    found = rollups.levels(runs, [["setting", "model", "cell"], ["setting"], []], {"mean": F.avg("auc")})
    assert {(r.level, r.setting, r.cell): (r.n, r["mean"]) for r in found.collect()} == {(0, "s1", "c1"): (1, 3.0), (0, "s1", "c2"): (1, 6.0), (0, "s2", "c1"): (1, 1.0), (1, "s1", None): (2, 4.5), (1, "s2", None): (1, 1.0), (2, None, None): (3, pytest.approx(10 / 3))}
    long = [("s", "m", "c", k, m, v) for k in ("x", "y") for m, v in (("zp_val", 0.0), ("R2", 0.5))] + [("s", "m", "d", "x", "zp_val", 0.1), ("s", "m", "d", "x", "R2", 0.1), ("s", "m", "d", "y", "R2", 0.1), ("s", "m", "c", "x", "R2", 0.4), ("s", "m", "c", "x", "other", 9.0)]
    wide = rollups.state_metrics(spark.createDataFrame(long, "setting string, model string, cell string, state string, metric string, value double"), {"zp_val": "p", "R2": "r2"})
    assert {(r.cell, r.state, r.r2): r.l for r in wide.withColumn("l", rollups.minus_log_p("p")).collect()} == {("c", "x", 0.5): pytest.approx(-math.log(1e-19)), ("c", "y", 0.5): pytest.approx(-math.log(1e-19))}
    names = spark.createDataFrame([("b",), ("z",), ("a",), (None,), ("a",), ("q",)], "s string")
    assert sorted((r.s or "", r.place) for r in rollups.in_order(names, "s", ["z", "b"]).collect()) == [("", None), ("a", 2), ("a", 2), ("b", 1), ("q", 3), ("z", 0)]
    assert {r.place for r in rollups.in_order(names, "s", []).collect()} == {None, 0, 1, 2, 3}


def test_k_means(spark):
    r = np.random.default_rng(2)
    centres = np.array([[0, 0], [9, 0], [0, 9], [9, 9.0]])
    points = centres[np.arange(40) % 4] + r.standard_normal((40, 2))
    assert merging.k_means(points, 4).tolist() == [i % 4 for i in range(40)]
    own = merging.k_means(points, 3)
    mean = np.stack([points[own == c].mean(0) for c in range(3)])
    assert (((points[:, None] - mean) ** 2).sum(2).argmin(1) == own).all() and own[0] == 0
    assert merging.k_means(np.ones((5, 2)), 3).tolist() == [0] * 5 and merging.k_means(np.zeros((0, 2)), 3).tolist() == []
    assert sorted(merging.k_means(np.array([[0.0], [0.0], [1.0], [5.0]]), 9).tolist()) == [0, 0, 1, 2]
    features = spark.createDataFrame([(f"s{i}", at, float(x)) for i, p in enumerate(points) for at, x in enumerate(p)], "label string, at int, x double")
    for method in ("kmeans", "average", "complete", "ward"):
        groups: dict[int, set[int]] = {}
        for q in merging.clusters(features, 4, method).collect():
            groups.setdefault(q.cluster, set()).add(int(q.label[1:]) % 4)
        assert sorted(map(sorted, groups.values())) == [[0], [1], [2], [3]]


def test_single_point(pairs):
    r = calibrate.r_values(pairs, LABELS, 2, 0.5, 20).toPandas().set_index("idx").r_value
    for q in calibrate.single_point(pairs, LABELS, True, 2, 0.5, 0.7, 20).collect():
        assert q.is_repr == (round(r[q.idx], 9) >= 0.7) and q.r_value == pytest.approx(r[q.idx])
    matches = calibrate.matches_of(pairs, LABELS, 2, 0.5)
    plain = {q.idx: q.is_repr for q in spatial.reproduced(pairs, matches, 2, hide_last=True).collect()}
    prior = {q.idx: q.is_repr for q in calibrate.single_point(pairs, LABELS, False, 2, 0.5, prior=F.col("idx") % 3 == 0).collect()}
    assert prior == {i: v or i % 3 == 0 for i, v in plain.items()}
    m1, m2 = zip(*[(q.m1, q.m2) for q in pairs.orderBy("idx").collect()], strict=True)
    own = calibrate.matches_of(pairs, LABELS, 4, 0.3)
    for q in calibrate.reproduced_by_map(pairs, LABELS, 4, 0.3).collect():
        assert q.is_repr == bool(set(m2[max(0, q.idx - 4) : q.idx + 4]) & set(own[m1[q.idx]]))


def test_label_agreement(pairs):
    m1, m2 = zip(*[(q.m1, q.m2) for q in pairs.collect()], strict=True)
    for other in (None, "b"):
        for q in overlap.label_agreement(pairs, [*LABELS, "none"], other).collect():
            own = [y for x, y in zip(m1, m2, strict=True) if x == q.k]
            assert (q.agreed, q.rows) == (sum(y == (other or q.k) for y in own), len(own))
            assert q.agreement == (q.agreed / q.rows if own else None)


def test_binned_overlap_on_own_cells(pairs):
    got = {(r.k, r.b1, r.j, r.b2): r.overlap for r in enrich.binned_overlap(pairs, LABELS, 4, own_cells=True).collect()}
    p1, p2 = (np.stack([r[p] for r in pairs.collect()]) for p in ("p1", "p2"))
    want = {}
    cell = [np.where(p < p.max(), np.floor((p - p.min()) / (p.max() - p.min()) * 4), -1).astype(int) for p in (p1, p2)]
    for x, y in zip(*cell, strict=True):
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                if a >= 0 and b >= 0:
                    want[LABELS[i], a, LABELS[j], b] = want.get((LABELS[i], a, LABELS[j], b), 0) + 1 / N
    assert got == pytest.approx(want)


def test_contrasts(spark):
    r = np.random.default_rng(3)
    rows = [("a", i, float(np.round(r.standard_normal(), 1)), i % 2 == 0) for i in range(60)] + [("b", i, float(i), i < 30) for i in range(40)] + [("c", 1, 2.0, True), ("d", 1, 1.0, True), ("d", 2, 1.0, False), ("a", 99, None, True)]
    got = {q.k: q for q in statistics.contrasts(spark.createDataFrame(rows, "k string, o long, v double, s boolean").repartition(3), "k", "v", F.col("s"), "o").collect()}
    for k in "ab":
        one, two = ([v for a, _, v, s in rows if a == k and s == t and v is not None] for t in (True, False))
        n1, n0 = len(one), len(two)
        q, every = got[k], np.array(one + two)
        pooled = (np.var(one, ddof=1) * (n1 - 1) + np.var(two, ddof=1) * (n0 - 1)) / (n1 + n0 - 2)
        assert (q.n1, q.n0, q.ratio) == (n1, n0, n1 / n0)
        assert q.t == pytest.approx((np.mean(one) - np.mean(two)) / np.sqrt(pooled * (1 / n1 + 1 / n0)))
        rank = np.array([(every < v).sum() + ((every == v).sum() + 1) / 2 for v in one]).sum()
        counts = np.unique(every, return_counts=True)[1]
        off = rank - n1 * (n1 + n0 + 1) / 2
        spread = np.sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - (counts**3 - counts).sum() / ((n1 + n0) * (n1 + n0 - 1))))
        assert q.z_rank == pytest.approx(np.sign(off) * max(abs(off) - 0.5, 0) / spread)
        assert (q.z_paired is None) == (n1 != n0)
    d = np.array([rows[i][2] - rows[i + 1][2] for i in range(0, 60, 2)])
    d = d[np.round(d, 9) != 0]
    ranks = np.array([(np.round(abs(d), 9) < np.round(abs(x), 9)).sum() + ((np.round(abs(d), 9) == np.round(abs(x), 9)).sum() + 1) / 2 for x in d])
    m = len(d)
    assert got["a"].z_paired == pytest.approx((ranks[d > 0].sum() - m * (m + 1) / 4) / np.sqrt(m * (m + 1) * (2 * m + 1) / 24))
    assert got["c"].t is None and got["c"].ratio is None and got["d"].mean_diff == 0 and got["d"].z_rank is None


def test_student_p():
    """Against the density's integral."""
    for t, df in ((0.0, 3), (0.5, 1), (2.1, 7), (-1.3, 40), (4.0, 200)):
        x = np.linspace(-abs(t), abs(t), 200_001)
        y = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        assert statistics.student_p(t, df) == pytest.approx(1 - np.trapezoid(y, x), abs=1e-8)
