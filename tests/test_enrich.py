"""Stratified enrichments, windows and matches against plain loops."""

from itertools import permutations

import numpy as np
import pytest
from locusweave.operators import core, enrich, profiles
from pyspark.sql import functions as F

LABELS = ["a", "b", "c"]
SCHEMA = "idx long, chr string, start long, end long, p1 array<double>, p2 array<double>"


@pytest.fixture(scope="module")
def track(spark):
    r = np.random.default_rng(12)
    p1 = np.round(r.dirichlet([1, 1, 1], 200), 2)
    p2 = np.round(0.5 * p1 + 0.5 * r.dirichlet([1, 1, 1], 200), 2)
    rows = [(i, f"chr{1 + i // 120}", (i % 120) * 200, (i % 120) * 200 + 200, p1[i].tolist(), p2[i].tolist()) for i in range(200)]
    df = core.with_map(spark.createDataFrame(rows, SCHEMA), LABELS).cache()
    return df, p1, p2, [LABELS[int(np.argmax(x))] for x in p1], [LABELS[int(np.argmax(x))] for x in p2]


@pytest.mark.parametrize("by_chosen", [False, True])
def test_stratified(spark, track, by_chosen):
    df, p1, _, m1, _ = track
    chosen = [i for i in range(200) if i % 3 == 0]
    ch = spark.createDataFrame([(i, float(i)) for i in chosen], "idx long, tpm double")
    got = {(r.k, r.b): r for r in enrich.stratified(profiles.by_label(df, LABELS, "idx", "m1"), ch, 7, by_chosen).collect()}
    count = 0
    for at, k in enumerate(LABELS):
        x = p1[:, at]
        own = sorted(x[chosen] if by_chosen else x)
        step = len(own) // 7
        for b in range(0, len(own), step):
            low, high = own[b], own[min(b + step, len(own)) - 1]
            e = [i for i in range(200) if low <= x[i] <= high]
            t = [i for i in e if i in set(chosen)]
            if not t:
                continue
            count += 1
            r = got[k, b // step]
            assert (r.low, r.high) == (low, high)
            assert r.enrichment == pytest.approx(np.log((len(t) / len(chosen)) / (len(e) / 200)))
            assert r.map_share == pytest.approx(np.mean([m1[i] == k for i in e]))
            assert r.mean_tpm == pytest.approx(np.mean(t))
    assert len(got) == count


def test_contiguous_overlap(track):
    df, _, _, m1, m2 = track
    kept = [i for i in range(200) if i % 17 not in (0, 1) and not 40 <= i < 55]
    got = {(r.k, r.j): (r.joint, r.iou) for r in enrich.contiguous_overlap(df.where(F.col("idx").isin(kept)), LABELS, 4).collect()}
    held, count = set(kept), {}
    for i in kept:
        low = high = i
        while low - 1 in held and (low - 1) // 120 == i // 120 and i - low < 4:
            low -= 1
        while high + 1 in held and (high + 1) // 120 == i // 120 and high - i < 4:
            high += 1
        for j in {m2[x] for x in range(low, high)}:
            count[m1[i], j] = count.get((m1[i], j), 0) + 1
    n = len(kept)
    assert got.keys() == count.keys()
    for (k, j), c in count.items():
        a, b = sum(m1[i] == k for i in kept) / n, sum(m2[i] == j for i in kept) / n
        assert got[k, j] == pytest.approx((c / n, c / n / (a + b - c / n)))


def test_matched_bins(track):
    df, _, _, m1, m2 = track
    gain = {(k, j): np.log((sum(x == k and y == j for x, y in zip(m1, m2, strict=True)) + 1e-3) / (m1.count(k) * m2.count(j) / 200 + 1e-3)) for k in LABELS for j in LABELS}
    best = max(permutations(LABELS), key=lambda p: sum(gain[k, j] for k, j in zip(LABELS, p, strict=True)))
    to = dict(zip(LABELS, best, strict=True))
    for r in enrich.matched_bins(df, LABELS).collect():
        assert (r.matched, r.reproduced) == (to[m1[r.idx]], to[m1[r.idx]] == m2[r.idx])


def test_binned_overlap(track):
    df, p1, p2, _, _ = track
    low, high = p1.min(), p1.max()
    cell = lambda v: int(np.floor((v - low) / (high - low) * 4)) if low <= v < high else None
    one = [{(k, cell(v)) for k, v in zip(LABELS, x, strict=True) if cell(v) is not None} for x in p1]
    two = [{(k, cell(v)) for k, v in zip(LABELS, x, strict=True) if cell(v) is not None} for x in p2]
    rows = enrich.binned_overlap(df, LABELS, 4).collect()
    assert rows
    for r in rows:
        x, y = [(r.k, r.b1) in s for s in one], [(r.j, r.b2) in s for s in two]
        o = sum(a and b for a, b in zip(x, y, strict=True))
        assert (r.overlap, r.iou) == pytest.approx((o / 200, o / (sum(x) + sum(y) - o)))


def test_feature_enrichment(spark):
    raw = spark.createDataFrame([("a", "up", -1, 3), ("b", "up", -1, 1), ("a", "up", -2, 2), ("b", "down", 0, 4)], "label string, component string, offset int, n long")
    bases = spark.createDataFrame([("a", 300), ("b", 100)], "label string, bases long")
    got = {(r.label, r.component): r.enrichment for r in enrich.feature_enrichment(raw, bases, ["a", "b"]).collect()}
    assert got["a", "up"] == pytest.approx((np.log2(4 / 4 / 0.75) + np.log2(3 / 2 / 0.75)) / 2)
    assert got["b", "up"] == pytest.approx((np.log2(2 / 4 / 0.25) + np.log2(1 / 2 / 0.25)) / 2)
    assert got["a", "down"] == pytest.approx(np.log2(1 / 4 / 0.75))
    assert got["b", "down"] == pytest.approx(np.log2(5 / 4 / 0.25))


def test_empty(spark):
    empty = core.with_map(spark.createDataFrame([], SCHEMA), LABELS)
    assert enrich.binned_overlap(empty, LABELS).count() == 0
    assert enrich.contiguous_overlap(empty, LABELS, 4).count() == 0
    chosen = spark.createDataFrame([], "idx long, tpm double")
    assert enrich.stratified(profiles.by_label(empty, LABELS, "idx", "m1"), chosen, 5, True).count() == 0
