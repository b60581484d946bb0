"""Calibrated reproducibility: strata of posteriors, isotonic curves, r-values."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .core import shown_bits, shows, size
from .edges import Edges, edges, hits


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Increasing least-squares fit; equal x are pooled first. Points come in order of x."""
    u, at, count = np.unique(x, return_inverse=True, return_counts=True)
    level = [[s / c, c, 1] for s, c in zip(np.bincount(at, weights=y).tolist(), count.tolist(), strict=True)]
    out: list[list[float]] = []
    for block in level:
        out.append(block)
        while len(out) > 1 and out[-2][0] >= out[-1][0]:
            (a, wa, na), (b, wb, nb) = out[-2], out.pop()
            out[-1] = [(a * wa + b * wb) / (wa + wb), wa + wb, na + nb]
    return u, np.repeat([b[0] for b in out], [int(b[2]) for b in out])


def strata_count(n: int, bins: int) -> int:
    """Rows of a stratum; a table of fewer rows than strata has strata of one row."""
    return max(1, n // bins)


def strata(pairs: DataFrame, labels: Sequence[str], matches: dict[str, list[str]], w: int, bins: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(x, y) of each label's strata by posterior: the middle and the share of rows that show a match."""
    n = size(pairs)
    others = sorted({j for js in matches.values() for j in js}) or list(labels)
    found = edges(pairs, range(len(labels)), strata_count(n, bins), n)
    return points(shown_bits(pairs, "m2", others, w, "p1", n=n), labels, others, found, matches, n)


def points(seen: DataFrame, labels: Sequence[str], others: Sequence[str], found: dict[int, Edges], matches: dict[str, list[str]], n: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(x, y) of strata whose edges are known; ``seen`` has the windows' labels as bits by ``others``."""
    hit = {i: reduce(or_, [shows(others.index(j)) for j in matches[labels[i]]]) for i in found if matches.get(labels[i])}
    counted = hits(seen, found, hit, n)
    return {labels[i]: ((e.low + e.high) / 2, counted[i] / e.n) for i, e in found.items()}


def curves(found: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(x, f): isotonic curves of strata; each label has as many points as strata."""
    return {k: isotonic(x[order := np.argsort(x, kind="stable")], y[order]) for k, (x, y) in found.items()}


def interpolation(fitted: dict[str, tuple[np.ndarray, np.ndarray]]):
    """A column function of (label, posterior): the value there of the label's curve; null without a curve."""

    @F.pandas_udf("double")
    def at_curve(label: pd.Series, p: pd.Series) -> pd.Series:
        out = np.full(len(p), np.nan)
        values = p.to_numpy(float)
        for k, (x, f) in fitted.items():
            own = (label == k).to_numpy()
            out[own] = np.interp(values[own], x, f)
        return pd.Series(out)

    return at_curve


def counted(seen: DataFrame, others: Sequence[str]) -> list[Row]:
    """(m1, m2, n, s0, s1, ...): rows by both labels, and how many of them see each of ``others``; one pass."""
    return seen.groupBy("m1", "m2").agg(F.count("*").alias("n"), *[F.count_if(shows(j)).alias(f"s{j}") for j in range(len(others))]).collect()


def matched(counts: Sequence[Row], names: Sequence[str], others: Sequence[str], n: int, threshold: float) -> dict[str, list[str]]:
    """Each label's partners by what is counted: those with an IoU above the threshold, else the best."""
    c1, c2, o = Counter(), Counter(), Counter()
    for r in counts:
        c1[r["m1"]] += r["n"]
        c2[r["m2"]] += r["n"]
        for i, j in enumerate(others):
            o[r["m1"], j] += r[f"s{i}"]
    out = {}
    for k in names:
        iou = {}
        for j in others:
            both = o[k, j] / n
            union = c1[k] / n + c2[j] / n - both
            iou[j] = both / union if union else -1.0
        above = [j for j in others if iou[j] > threshold]
        out[k] = above or [max(others, key=lambda j: iou[j])]
    return out


def matches_of(pairs: DataFrame, labels: Sequence[str], w: int, threshold: float) -> dict[str, list[str]]:
    """The correspondence on the driver, as ``match_static`` gives it: at most K x K labels, from one pass."""
    return matched(counted(shown_bits(pairs, "m2", labels, w, "m1", "m2"), labels), labels, labels, size(pairs), threshold)


def calibration(pairs: DataFrame, labels: Sequence[str], w: int = 5, threshold: float = 0.75, bins: int = 500, matches: dict[str, list[str]] | None = None):
    """The column function of (label, posterior) that ``r_values`` puts on every row, for some of them."""
    matches = matches_of(pairs, labels, w, threshold) if matches is None else matches
    return interpolation(curves(strata(pairs, labels, matches, w, bins)))


def r_values(pairs: DataFrame, labels: Sequence[str], w: int = 5, threshold: float = 0.75, bins: int = 500, matches: dict[str, list[str]] | None = None) -> DataFrame:
    """(idx, chr, start, end, map, r_value): the calibrated chance that a row's label is reproduced.

    Curves (at most ``bins`` points or a few more for each label) are the only thing that comes to the driver.
    """
    at_curve = calibration(pairs, labels, w, threshold, bins, matches)
    return pairs.select("idx", "chr", "start", "end", F.col("m1").alias("map"), at_curve("m1", F.array_max("p1")).alias("r_value"))


def single_point(pairs: DataFrame, labels: Sequence[str], posterior: bool = True, w: int = 5, threshold: float = 0.75, robust: float = 0.9, bins: int = 500, matches: dict[str, list[str]] | None = None, prior: Column | None = None) -> DataFrame:
    """(idx, m1, r_value, is_repr): which rows are reproduced at one setting, by calibrated posteriors or by MAP labels alone.

    With ``posterior`` a row is reproduced whose r-value is ``robust`` or more. Without, one whose window shows a match of its label, or for which ``prior`` holds
    already; ``r_value`` is null then. ``matches`` stands for those of the threshold, such as two-way ones.
    """
    from .spatial import reproduced

    matches = matches_of(pairs, labels, w, threshold) if matches is None else matches
    if posterior:
        r = r_values(pairs, labels, w, threshold, bins, matches)
        return r.select("idx", F.col("map").alias("m1"), "r_value", (F.round("r_value", 9) >= robust).alias("is_repr"))
    found = reproduced(pairs, matches, w, hide_last=True, prior=prior)
    return found.select("idx", "m1", F.lit(None).cast("double").alias("r_value"), "is_repr")


def reproduced_by_map(pairs: DataFrame, labels: Sequence[str], w: int, threshold: float) -> DataFrame:
    """(idx, m1, is_repr) by matches and windows of one width of its own: the best label by IoU at ``w``, or any above the threshold.

    The window shows the table's last row too, as no joint matrix is compared with it.
    """
    from .spatial import reproduced

    return reproduced(pairs, matches_of(pairs, labels, w, threshold), w)
