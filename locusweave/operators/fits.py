"""Fits of curves: polynomials from one aggregation, smoothing splines on strata, and the calibrations that use them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from numpy.polynomial import chebyshev
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibrate import isotonic, strata_count
from .core import ranked, shown, size
from .statistics import log_odds_strata

Curve = Callable[[np.ndarray], np.ndarray]


def polynomial_fit(rows: DataFrame, key: str, x: str, y: str, degree: int) -> DataFrame:
    """(key, low, high, n, coefficients): least-squares polynomials of ``y`` by ``x``, one for each of a few keys.

    Coefficients are of powers of ``u = (2 x - low - high) / (high - low)``. One aggregation sums Chebyshev polynomials of u up to twice the
    degree and their products with y: those sums are the normal equations in a basis that stays well conditioned. Rows with a null
    are left out; where fewer than degree + 1 different x are left, the smallest coefficients that fit are taken.
    """
    own = rows.select(key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    edges = own.groupBy(key).agg(F.min("_x").alias("low"), F.max("_x").alias("high"))
    u = F.coalesce(F.try_divide(2 * F.col("_x") - F.col("low") - F.col("high"), F.col("high") - F.col("low")), F.lit(0.0))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), u)))
    at = own.join(F.broadcast(edges), key).select(key, "low", "high", "_y", angle.alias("_a"))
    t = [F.cos(F.col("_a") * i) for i in range(2 * degree + 1)]
    sums = at.groupBy(key, "low", "high").agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in t]).alias("t"), F.array(*[F.sum(c * F.col("_y")) for c in t[: degree + 1]]).alias("ty"))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i = np.arange(degree + 1)
        for part in parts:
            out = []
            for s, v in zip(part["t"], part["ty"], strict=True):
                gram = (np.asarray(s)[i[:, None] + i] + np.asarray(s)[np.abs(i[:, None] - i)]) / 2
                c = chebyshev.cheb2poly(np.linalg.lstsq(gram, np.asarray(v), rcond=1e-13)[0])
                out.append(np.pad(c, (0, degree + 1 - len(c))).tolist())
            yield part[[key, "low", "high", "n"]].assign(coefficients=out)

    kind = own.schema[key].dataType.simpleString()
    return sums.mapInPandas(solve, f"`{key}` {kind}, low double, high double, n long, coefficients array<double>")


def polynomial(coefficients: str | Column, u: Column) -> Column:
    """A polynomial's value by Horner's rule."""
    c = F.col(coefficients) if isinstance(coefficients, str) else coefficients
    return F.aggregate(F.reverse(c), F.lit(0.0), lambda a, b: a * u + b)


def derivative(coefficients: str) -> Column:
    """Coefficients of a polynomial's derivative."""
    return F.expr(f"transform(slice({coefficients}, 2, greatest(size({coefficients}) - 1, 1)), (c, i) -> c * (i + 1))")


def fitted_slope(curve: DataFrame, key: str, x: str, y: str, degree: int = 5) -> DataFrame:
    """Add ``fitted`` and ``slope``: the curve's polynomial and that polynomial's derivative."""
    met = curve.join(F.broadcast(polynomial_fit(curve, key, x, y, degree)), key)
    width = F.col("high") - F.col("low")
    u = F.coalesce(F.try_divide(2 * F.col(x) - F.col("low") - F.col("high"), width), F.lit(0.0))
    slope = F.try_divide(2 * polynomial(derivative("coefficients"), u), width)
    return met.withColumns({"fitted": polynomial("coefficients", u), "slope": slope}).drop("low", "high", "n", "coefficients")


def cubic_basis(u: np.ndarray, pieces: int) -> np.ndarray:
    """Cubic B-splines with equally spaced knots on 0 .. 1, one column each; rows sum to one."""
    at = np.clip(u, 0, 1) * pieces
    piece = np.minimum(at.astype(int), pieces - 1)
    t = at - piece
    parts = np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3], 1) / 6
    out = np.zeros((len(u), pieces + 3))
    np.put_along_axis(out, piece[:, None] + np.arange(4), parts, 1)
    return out


def smoothing_spline(x: np.ndarray, y: np.ndarray, smoothing: float | None = None, pieces: int = 40) -> Curve:
    """The smoothest cubic spline whose sum of squared residuals is at most ``smoothing`` (default: the number of points).

    Fourth differences of the B-splines' weights are penalised, so that the smoothest spline of all is the least-squares cubic;
    it is taken where it meets the bound. Else the penalty is lowered until the sum is at the bound, or as low as the knots allow. Beyond the first and last x
    the curve keeps its value there.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    low, high = float(x.min()), float(x.max())
    width = high - low or 1.0  # at a single x the curve is its mean everywhere
    bound = len(x) if smoothing is None else smoothing
    u = (x - low) / width
    basis = cubic_basis(u, pieces)
    rough = np.diff(np.eye(pieces + 3), 4, axis=0)

    def weights(penalty: float) -> np.ndarray:
        return np.linalg.lstsq(np.vstack((basis, np.sqrt(penalty) * rough)), np.r_[y, np.zeros(len(rough))], rcond=None)[0]

    def misfit(c: np.ndarray) -> float:
        return float(((y - basis @ c) ** 2).sum())

    power = np.linalg.lstsq(np.vander(2 * u - 1, 4), y, rcond=None)[0]
    if float(((y - np.vander(2 * u - 1, 4) @ power) ** 2).sum()) <= bound:
        return lambda v: np.polyval(power, 2 * (np.clip(np.asarray(v, float), low, high) - low) / width - 1)
    least, most = -12.0, 12.0
    for _ in range(60):
        middle = (least + most) / 2
        least, most = (middle, most) if misfit(weights(10**middle)) <= bound else (least, middle)
    c = weights(10**least)
    return lambda v: cubic_basis((np.clip(np.asarray(v, float), low, high) - low) / width, pieces) @ c


def fit_curve(x: np.ndarray, y: np.ndarray, method: str, smoothing: float | None = None, degree: int = 3) -> Curve:
    """A calibration curve by ``isotonic`` (flat beyond its ends), ``spline`` (the same) or ``polynomial`` (which goes on)."""
    if method == "isotonic":
        u, f = isotonic(x, y)
        return lambda v: np.interp(v, u, f)
    if method == "spline":
        return smoothing_spline(x, y, smoothing)
    if method == "polynomial":
        low, width = float(x.min()), float(np.ptp(x)) or 1.0
        power = np.linalg.lstsq(np.vander(2 * (x - low) / width - 1, degree + 1), y, rcond=None)[0]
        return lambda v: np.polyval(power, 2 * (np.asarray(v, float) - low) / width - 1)
    raise ValueError(f"method is isotonic, spline or polynomial, not {method}")


def partner_strata(pairs: DataFrame, labels: Sequence[str], partner: dict[str, str], w: int, bins: int, log_odds: bool = True) -> DataFrame:
    """(k, b, x, y) of each label's strata by posterior: their middle, and how far its one partner is seen in the other track.

    ``y`` is ln of observed over expected rows (see ``log_odds_strata``), or the share of rows that see it. With ``w`` a row sees
    the labels at offsets -w to w - 1.
    """
    near = shown(pairs, "m2", w, "p1", hide_last=False)
    seen = lambda k: F.coalesce(F.array_contains("seen", partner[k]), F.lit(False)).alias("hit")
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("p1")[i].alias("p"), seen(k)) for i, k in enumerate(labels)])).alias("c")
    placed = ranked(near.select("idx", cells).select("idx", "c.*"), "k", "p", "idx")
    step = strata_count(size(pairs), bins)
    if not log_odds:
        return placed.groupBy("k", F.floor(F.col("pos") / step).alias("b")).agg(((F.min("p") + F.max("p")) / 2).alias("x"), F.avg(F.col("hit").cast("double")).alias("y"))
    counts = {r["m2"]: r["n"] for r in pairs.groupBy("m2").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    expected = pairs.sparkSession.createDataFrame([(k, counts.get(j, 0) / total) for k, j in partner.items()], "k string, share double")
    return log_odds_strata(placed, expected, step).withColumnRenamed("oe", "y")


def calibrated(pairs: DataFrame, labels: Sequence[str], partner: dict[str, str], method: str = "isotonic", w: int = 0, bins: int = 500, log_odds: bool = True, scale: str | None = "all", smoothing: float | None = None) -> DataFrame:
    """(idx, p): every posterior on its label's calibration curve, moved to 0 .. 1 over the whole matrix or by ``column``.

    Only the curves' points (``bins`` a label) and the extremes come to the driver. ``scale``: all, column or None; equal values
    scale to zero.
    """
    points = partner_strata(pairs, labels, partner, w, bins, log_odds).toPandas().sort_values(["k", "x", "b"])
    curve = {k: fit_curve(own["x"].to_numpy(), own["y"].to_numpy(), method, smoothing) for k, own in points.groupby("k")}

    @F.pandas_udf("array<double>")
    def at_curves(p: pd.Series) -> pd.Series:
        values = np.stack(p.to_numpy()).astype(float) if len(p) else np.zeros((0, len(labels)))
        return pd.Series(list(np.stack([curve[k](values[:, i]) for i, k in enumerate(labels)], 1)))

    out = pairs.select("idx", at_curves("p1").alias("p"))
    if scale is None:
        return out
    each = range(len(labels))
    ends = out.agg(*[F.min(F.col("p")[i]).alias(f"a{i}") for i in each], *[F.max(F.col("p")[i]).alias(f"b{i}") for i in each]).first()
    low, high = ([ends[f"{c}{i}"] for i in each] for c in "ab")
    if scale == "all":
        low, high = [min(low)] * len(labels), [max(high)] * len(labels)
    moved = [(F.col("p")[i] - low[i]) / (high[i] - low[i]) if high[i] > low[i] else F.lit(0.0) for i in each]
    return out.select("idx", F.array(*moved).alias("p"))
