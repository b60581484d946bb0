"""Fits, calibrations and rank concordance against numpy."""

import numpy as np
import pandas as pd
import pytest
from locusweave.operators import concordance, core, fits, match, overlap
from pyspark.sql import functions as F

LABELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def pairs(spark):
    r = np.random.default_rng(4)
    base = np.cumsum(r.standard_normal((900, 3)), 0) / 6
    soft = lambda z: np.exp(z) / np.exp(z).sum(1, keepdims=True)
    p1, p2 = soft(base), soft(base + r.standard_normal((900, 3)) * 0.7)
    rows = [(i, "chr1", i * 200, i * 200 + 200, p1[i].tolist(), p2[i].tolist()) for i in range(900)]
    return core.with_map(spark.createDataFrame(rows, "idx long, chr string, start long, end long, p1 array<double>, p2 array<double>").repartition(3), LABELS)


def test_polynomials(spark):
    r = np.random.default_rng(2)
    rows = [("a", float(x), float(np.sin(x / 40) + r.standard_normal() / 50)) for x in r.uniform(1e5, 1e5 + 200, 400)]
    rows += [("b", 1.0, 2.0), ("b", 1.0, 4.0), ("c", None, 1.0), (None, 0.0, 1.0), (None, 1.0, 3.0)] + [("d", float(x), 3.0 - 2.0 * x) for x in range(7)] * 40
    df = spark.createDataFrame(rows, "k string, t double, v double").repartition(3)
    got = fits.fitted_slope(df, "k", "t", "v", 5).toPandas()
    own = got[got.k == "a"]
    middle = own.t - 1e5 - 100
    want = np.polynomial.Polynomial.fit(middle, own.v, 5)
    assert np.allclose(own.fitted, want(middle), atol=1e-9) and np.allclose(own.slope, want.deriv()(middle), atol=1e-9)
    assert np.allclose(got[got.k == "d"].slope, -2) and np.allclose(got[got.k == "d"].fitted, got[got.k == "d"].v)
    same = got[got.k == "b"]
    assert np.allclose(same.fitted, 3) and same.slope.isna().all() and "c" not in set(got.k)
    assert fits.fitted_slope(df.limit(0), "k", "t", "v").count() == 0


def test_spline_is_the_smoothest_within_its_bound():
    r = np.random.default_rng(3)
    x = np.sort(r.uniform(0, 1, 200))
    y = np.sin(9 * x) + r.standard_normal(200) / 10
    cubic = np.polyval(np.polyfit(x, y, 3), x)
    assert np.allclose(fits.smoothing_spline(x, y)(x), cubic)  # the default bound is loose
    worst = ((y - cubic) ** 2).sum()
    rough = []
    for bound in (worst * 0.9, 4.0, 2.2):
        f = fits.smoothing_spline(x, y, bound)
        assert ((y - f(x)) ** 2).sum() == pytest.approx(bound, rel=1e-3)
        rough.append(((f(x) - cubic) ** 2).sum())  # the tighter the bound, the farther from the smoothest curve
        assert np.ptp(f(np.array([-5.0, x[0]]))) == pytest.approx(0)
    assert rough == sorted(rough)
    tight = fits.smoothing_spline(x, y, 0.0)
    assert ((y - tight(x)) ** 2).sum() < 2.0
    assert np.allclose(fits.smoothing_spline(np.ones(4), np.arange(4.0))(np.array([1.0, 7.0])), 1.5)
    basis = fits.cubic_basis(np.linspace(0, 1, 50), 7)
    assert basis.shape == (50, 10) and np.allclose(basis.sum(1), 1) and (basis >= 0).all()


@pytest.mark.parametrize("log_odds", [True, False])
@pytest.mark.parametrize("w", [0, 2])
@pytest.mark.parametrize(("method", "scale"), [("isotonic", "all"), ("spline", "column"), ("polynomial", None)])
def test_calibrated(pairs, method, scale, w, log_odds):
    partner = {r["k"]: r["j"] for r in match.best_match(overlap.overlap(pairs, LABELS, "iou"), LABELS).collect()}
    got = fits.calibrated(pairs, LABELS, partner, method, w, bins=30, log_odds=log_odds, scale=scale).toPandas().sort_values("idx")
    table = pairs.toPandas().sort_values("idx")
    m2, p1 = table.m2.to_numpy(), np.stack(table.p1)
    out = np.zeros_like(p1)
    for i, k in enumerate(LABELS):
        hit = np.array([partner[k] in (m2[max(0, x - w) : x + w] if w else m2[x : x + 1]) for x in range(900)])
        order = np.lexsort((np.arange(900), p1[:, i]))
        x, y = [], []
        for low in range(0, 900, 30):
            part = order[low : low + 30]
            seen, expected = hit[part].sum(), (m2 == partner[k]).mean() * 30
            x.append((p1[part[0], i] + p1[part[-1], i]) / 2)
            y.append((np.log(seen / expected) if seen else np.log(1 / (expected + 1))) if log_odds else seen / 30)
        out[:, i] = fits.fit_curve(np.array(x), np.array(y), method)(p1[:, i])
        if method == "polynomial":
            assert np.allclose(out[:, i], np.polyval(np.polyfit(x, y, 3), p1[:, i]))
    if scale == "all":
        out = (out - out.min()) / (out.max() - out.min())
    elif scale == "column":
        out = (out - out.min(0)) / np.where(np.ptp(out, 0) > 0, np.ptp(out, 0), 1)
    assert np.allclose(np.stack(got.p), out, atol=1e-9)


def test_unknown_method():
    with pytest.raises(ValueError, match="isotonic"):
        fits.fit_curve(np.arange(3.0), np.arange(3.0), "cubic")


@pytest.mark.parametrize("blocks", [256, 7, 2])
def test_kendall(spark, blocks):
    """Ties on both sides, a value that a third of the rows share, repeated rows, nulls, and keys with nothing to compare."""
    r = np.random.default_rng(5)
    x = np.where(r.random(600) < 0.3, 0.5, np.round(r.uniform(0, 1, 600), 2))
    y = np.where(r.random(600) < 0.3, 2.0, np.round(x * 3 + r.standard_normal(600), 1))
    rows = [("a", float(u), float(v)) for u, v in zip(x, y, strict=True)] + [("b", float(i), float(-i)) for i in range(40)] + [("c", 1.0, float(i)) for i in range(5)]
    rows += [("d", 1.0, 1.0), ("e", None, 1.0), ("e", float("nan"), 2.0), (None, 1.0, 5.0), (None, 2.0, 6.0), rows[0], rows[0]]
    got = {q["k"]: q for q in concordance.kendall(spark.createDataFrame(rows, "k string, x double, y double").repartition(3), "k", "x", "y", blocks).collect()}
    table = pd.DataFrame(rows, columns=["k", "x", "y"]).dropna(subset=["x", "y"])
    for k in ("a", "b", "c", "d", None):
        own = table[table.k.isna()] if k is None else table[table.k == k]
        u, v = own.x.to_numpy(), own.y.to_numpy()
        s = np.sign(np.subtract.outer(u, u)) * np.sign(np.subtract.outer(v, v))
        scale = np.sqrt(float((np.subtract.outer(u, u) != 0).sum())) * np.sqrt(float((np.subtract.outer(v, v) != 0).sum()))
        assert (got[k]["n"], got[k]["discordant"]) == (len(own), (s < 0).sum() // 2)
        assert got[k]["tau"] == (pytest.approx(s.sum() / scale) if scale else None)
    assert set(got) == {"a", "b", "c", "d", None}


def test_discordant_pairs_by_merging():
    r = np.random.default_rng(6)
    for n in (1, 2, 3, 50, 257):
        x, y, w = r.integers(0, 9, n), r.integers(0, 9, n), r.integers(1, 5, n)
        against = (np.subtract.outer(x, x) * np.subtract.outer(y, y) < 0) * np.outer(w, w)
        assert concordance.discordant(x, y, w) == against.sum() // 2
        apart = (np.subtract.outer(x, x) > 0) & (np.subtract.outer(y, y) < 0)
        assert concordance.between(x, y, w) == (apart * np.outer(w, w)).sum()


def test_large_blocks_are_only_of_one_value(spark):
    """With one x on nine tenths of the rows the grid and the other side's blocks do the work; no block of x has those rows."""
    rows = [("a", 0.0 if i % 10 else float(i), float((i * 7919) % 4001)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = concordance.kendall(df, "k", "x", "y", 16).first()
    u, v = df.toPandas().x.to_numpy(), df.toPandas().y.to_numpy()
    assert got["discordant"] == ((np.subtract.outer(u, u) * np.subtract.outer(v, v)) < 0).sum() // 2
    assert df.agg(F.max("x")).first()[0] == 3990
