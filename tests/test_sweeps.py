"""Threshold and window sweeps against plain loops."""

import numpy as np
import pytest
from locusweave.operators import calibrate, core, match, overlap, sweeps

LABELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def track(spark):
    r = np.random.default_rng(21)
    p1 = np.round(r.dirichlet([1, 1, 1], 150), 2)
    p2 = np.round(0.6 * p1 + 0.4 * r.dirichlet([1, 1, 1], 150), 2)
    rows = [(i, "chr1", i * 200, i * 200 + 200, p1[i].tolist(), p2[i].tolist()) for i in range(150)]
    df = core.with_map(spark.createDataFrame(rows, "idx long, chr string, start long, end long, p1 array<double>, p2 array<double>"), LABELS).cache()
    return df, [LABELS[int(np.argmax(x))] for x in p1], [LABELS[int(np.argmax(x))] for x in p2]


def test_overlap_contour(track):
    df, m1, m2 = track
    got = {(r.w, r.t, r.label): r.share for r in sweeps.overlap_contour(df, LABELS, [0.2, 0.5], [0, 3]).collect()}
    for w in (0, 3):
        iou = {(r.k, r.j): r.value for r in overlap.overlap(df, LABELS, "iou", w).collect()}
        sees = [m2[max(0, i - w) : min(i + w, 149)] if w else [m2[i]] for i in range(150)]
        for t in (0.2, 0.5):
            flag = [any(iou[m1[i], j] > t for j in sees[i]) for i in range(150)]
            assert got[w, t, "all"] == pytest.approx(np.mean(flag))
            for k in LABELS:
                assert got[w, t, k] == pytest.approx(np.mean([f for f, x in zip(flag, m1, strict=True) if x == k]))


def test_r_contour(track):
    df, m1, _ = track
    r = np.array([x.r_value for x in calibrate.r_values(df, LABELS, 3, 0.75, 10).orderBy("idx").collect()])
    for x in sweeps.r_contour(df, LABELS, [0.3, 0.9], [3], bins=10).collect():
        own = r if x.label == "all" else r[[m == x.label for m in m1]]
        assert x.share == pytest.approx(np.mean(np.round(own, 9) >= x.t))


def _nmi(a, b):
    n, mi = len(a), 0.0
    for k in set(a):
        for j in set(b):
            o = sum(x == k and y == j for x, y in zip(a, b, strict=True)) / n
            mi += o * np.log2(o / (a.count(k) / n * b.count(j) / n)) if o else 0.0
    return mi / -sum(b.count(j) / n * np.log2(b.count(j) / n) for j in set(b))


def test_nmi_after(track):
    df, m1, m2 = track
    swapped = df.selectExpr("idx", "chr", "start", "end", "p2 as p1", "p1 as p2", "m2 as m1", "m1 as m2")
    kept = range(150)
    for x, one, two in ((df, m1, m2), (swapped, m2, m1)):
        found = {}
        for r in match.match_static(overlap.overlap(x, LABELS, "iou", 2), LABELS, 0.5).collect():
            found.setdefault(r.k, set()).add(r.j)
        kept = [i for i in kept if found[one[i]] & set(two[max(0, i - 2) : i + 2])]
    got = sweeps.nmi_after(df, LABELS, 2, 0.5).first()
    assert got.kept == pytest.approx(len(kept) / 150)
    assert got.before == pytest.approx(_nmi(m1, m2))
    assert got.after == pytest.approx(_nmi([m1[i] for i in kept], [m2[i] for i in kept]))
