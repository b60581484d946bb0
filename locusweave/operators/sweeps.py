"""Reproducibility over grids of thresholds and windows. A window costs one pass; its thresholds are read from that pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import calibrate
from .core import by_block, halo, shown, size
from .merging import facts
from .overlap import information, overlap
from .spatial import reproduced


def _thresholds(counted: DataFrame, thresholds: Sequence[float], reached) -> DataFrame:
    """(t, label, share) from (label, value, n); the label 'all' sums over labels."""
    every = counted.select(F.lit("all").alias("label"), "value", "n").unionByName(counted)
    long = every.select("label", "value", "n", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("t"))
    return long.groupBy("t", "label").agg((F.sum(F.when(reached(F.col("value"), F.col("t")), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))


def overlap_contour(pairs: DataFrame, labels: Sequence[str], thresholds: Sequence[float], windows: Sequence[int]) -> DataFrame:
    """(w, t, label, share): share of rows whose window shows a label of an IoU above t with their own.

    A row is reproduced at every t below the best IoU among the labels that it sees, so rows are counted by that best value
    (a cell of the label-by-label matrix) and thresholds need no pass of their own. Rows that see nothing count as not reproduced.
    """
    out = []
    for w in windows:
        cells = [x for r in overlap(pairs, labels, "iou", w).collect() for x in (F.lit(f"{r['k']}\0{r['j']}"), F.lit(r["value"]).cast("double"))]
        values = F.create_map(*cells)
        best = shown(pairs, "m2", w, "m1").select(F.col("m1").alias("k"), F.array_max(F.transform("seen", lambda j: values[F.concat_ws("\0", "m1", j)])).alias("value"))  # noqa: B023
        counted = best.groupBy(F.col("k").alias("label"), "value").agg(F.count("*").alias("n"))
        out.append(_thresholds(counted, thresholds, lambda v, t: v > t).select(F.lit(w).alias("w"), "t", "label", "share"))
    return reduce(DataFrame.unionByName, out)


def r_contour(pairs: DataFrame, labels: Sequence[str], thresholds: Sequence[float], windows: Sequence[int], overlap_threshold: float = 0.75, bins: int = 500) -> DataFrame:
    """(w, t, label, share): share of rows with an r-value of t (to 6 digits) or more; one calibration for each window."""
    out = []
    for w in windows:
        r = calibrate.r_values(pairs, labels, w, overlap_threshold, bins).select("map", F.floor(F.round(F.col("r_value"), 9) * 1_000_000).alias("value"))
        counted = r.groupBy(F.col("map").alias("label"), "value").agg(F.count("*").alias("n"))
        found = _thresholds(counted, thresholds, lambda v, t: v >= F.round(t * 1_000_000))
        out.append(found.select(F.lit(w).alias("w"), "t", "label", "share"))
    return reduce(DataFrame.unionByName, out)


def _nmi(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy(F.col("m1").alias("k"), F.col("m2").alias("j")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    return information(counts.join(F.broadcast(total)).select("k", "j", (F.col("c") / F.col("total")).alias("joint"))).select("nmi")


def nmi_after(pairs: DataFrame, labels: Sequence[str], w: int, threshold: float) -> DataFrame:
    """(kept, before, after): mutual information of the tracks, and of the rows that each track reproduces of the other."""
    swapped = pairs.select("idx", "chr", "start", "end", F.col("p2").alias("p1"), F.col("p1").alias("p2"), F.col("m2").alias("m1"), F.col("m1").alias("m2"))
    flags = [reproduced(x, calibrate.matches_of(x, labels, w, threshold), w).where("is_repr").select("idx") for x in (pairs, swapped)]
    kept = pairs.join(flags[0], "idx", "left_semi").join(flags[1], "idx", "left_semi")
    share = kept.agg(F.count("*").alias("c")).join(pairs.agg(F.count("*").alias("n"))).select(F.try_divide("c", "n").alias("kept"))
    return share.join(_nmi(pairs).withColumnRenamed("nmi", "before")).join(_nmi(kept).withColumnRenamed("nmi", "after"))


def _least_windows(pairs: DataFrame, labels: Sequence[str], reach: int, hide_last: bool) -> DataFrame:
    """(idx, m1, m2, near1, near2): maps from the labels of m2, and of m1, to the least w >= 1 whose window (-w to w - 1) shows them."""
    n = size(pairs)
    dealt = halo(pairs.select("idx", "m1", "m2"), reach)
    before = by_block().rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_b").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    each = {}
    for m in ("m2", "m1"):
        for i, j in enumerate(labels):
            there = F.when((F.col(m) == j) & (F.col("idx") < (n - 1 if hide_last else n)), F.col("idx"))
            each[f"_{m}{i}"] = F.least(F.col("idx") - F.max(there).over(before), F.min(there).over(after) - F.col("idx") + 1).cast("int")
    known = lambda m: F.map_filter(F.map_from_arrays(F.array(*[F.lit(j) for j in labels]), F.array(*[F.col(f"_{m}{i}") for i in range(len(labels))])), lambda _, v: v <= reach)
    return dealt.withColumns(each).where("_own").select("idx", "m1", "m2", known("m2").alias("near1"), known("m1").alias("near2"))


def _ious(seen: dict[tuple[str, str], int], own: dict[str, int], other: dict[str, int], labels: Sequence[str]) -> dict[str, dict[str, float]]:
    """IoU of every pair of labels, from the rows of one that show the other; -1 where neither occurs."""
    cell = lambda k, j: seen.get((k, j), 0) / u if (u := own.get(k, 0) + other.get(j, 0) - seen.get((k, j), 0)) else -1.0
    return {k: {j: cell(k, j) for j in labels} for k in labels}


def _levels(pairs: DataFrame, labels: Sequence[str], steps: Sequence[float], windows: Sequence[int]) -> dict[tuple[int, str], dict[str, dict[str, int]]]:
    """By window and side: how many of the thresholds each pair of labels is a match at; the best of a label is one at all of them.

    Rows are counted once, by pair of labels and least window; a window's counts are those of all windows up to it.
    """
    counts = pairs.groupBy("m1", "m2").agg(F.count("*").alias("n")).collect()
    cover: dict[str, dict[str, int]] = {"m1": {}, "m2": {}}
    for r in counts:
        for m in cover:
            cover[m][r[m]] = cover[m].get(r[m], 0) + r["n"]
    hidden = _least_windows(pairs, labels, max(1, *windows), True)
    side = lambda s, m, near: F.transform(F.map_entries(near), lambda e: F.struct(F.lit(s).alias("side"), F.col(m).alias("k"), e["key"].alias("j"), e["value"].alias("w")))
    least = hidden.select(F.explode(F.concat(side("m1", "m1", "near1"), side("m2", "m2", "near2"))).alias("c")).groupBy("c.side", "c.k", "c.j", "c.w").agg(F.count("*").alias("n")).collect()
    out = {}
    for s, o in (("m1", "m2"), ("m2", "m1")):
        for w in windows:
            seen: dict[tuple[str, str], int] = {}
            for r in least if w else counts:
                if not w or r["side"] == s and r["w"] <= w:
                    k = (r["k"], r["j"]) if w else (r[s], r[o])
                    seen[k] = seen.get(k, 0) + r["n"]
            iou = _ious(seen, cover[s], cover[o], labels)
            best = {k: max(labels, key=row.get) for k, row in iou.items()}
            out[w, s] = {k: {j: len(steps) if j == best[k] else sum(v > t for t in steps) for j, v in row.items()} for k, row in iou.items()}
    return out


def _grid(pairs: DataFrame, labels: Sequence[str], counts, w: int, steps: Sequence[float]) -> list[tuple]:
    """(w, t, kept, before, after) of one window, from counts by level and labels; a row is kept at the thresholds below its level."""
    n, at = size(pairs), {k: i for i, k in enumerate(labels)}
    joint = np.zeros((len(steps) + 1, len(labels), len(labels)))
    np.add.at(joint, (counts["level"].to_numpy(int), counts["m1"].map(at).to_numpy(int), counts["m2"].map(at).to_numpy(int)), counts["n"].to_numpy(float))
    upto = np.cumsum(joint[::-1], axis=0)[::-1]
    return [(w, float(t), float(upto[i + 1].sum() / n), facts(upto[0] / n)[2], facts(upto[i + 1] / upto[i + 1].sum())[2] if upto[i + 1].any() else None) for i, t in enumerate(steps)]


_GRID = "w int, t double, kept double, before double, after double"


def nmi_grid(pairs: DataFrame, labels: Sequence[str], thresholds: Sequence[float], windows: Sequence[int]) -> DataFrame:
    """(w, t, kept, before, after): information of the rows that both tracks reproduce of each other, at every threshold and window.

    One pass tells each row the least window that shows each label of the other track. A label counts as a match below its IoU at
    that window, the best label at every threshold, so each window has a largest threshold up to which a row is kept, on both
    sides. Rows are counted by window, that threshold and both labels; sums from the largest threshold down give the joint counts
    of every cell of the grid. What comes to the driver are counts by labels and levels.
    """
    steps, windows = sorted(thresholds), sorted(set(windows))
    level = _levels(pairs, labels, steps, windows)

    def reached(own: str, other: str, near: str, w: int):
        rows = F.create_map(*[x for k, row in level[w, own].items() for x in (F.lit(k), F.create_map(*[y for j, v in row.items() for y in (F.lit(j), F.lit(v))]))])
        mine = rows[F.col(own)]
        if not w:
            return mine[F.col(other)]
        return F.coalesce(F.array_max(F.transform(F.map_keys(F.map_filter(near, lambda _, v: v <= w)), lambda j: mine[j])), F.lit(0))

    each = [F.struct(F.lit(w).alias("w"), F.least(reached("m1", "m2", "near1", w), reached("m2", "m1", "near2", w)).alias("level")) for w in windows]
    seen = _least_windows(pairs, labels, max(1, *windows), False).select("m1", "m2", F.explode(F.array(*each)).alias("c"))
    counts = seen.groupBy("c.w", "c.level", "m1", "m2").agg(F.count("*").alias("n")).toPandas()
    out = [x for w in windows for x in _grid(pairs, labels, counts[counts["w"] == w], w, steps)]
    return pairs.sparkSession.createDataFrame(out, _GRID)


def nmi_grid_calibrated(pairs: DataFrame, labels: Sequence[str], robust: Sequence[float], windows: Sequence[int], threshold: float = 0.75, bins: int = 500) -> DataFrame:
    """The same grid over least r-values: rows are kept whose r-value reaches t in both directions. Two calibrations for each window."""
    steps, out = sorted(robust), []
    back = pairs.select("idx", "chr", "start", "end", F.col("p2").alias("p1"), F.col("p1").alias("p2"), F.col("m2").alias("m1"), F.col("m1").alias("m2"))
    for w in sorted(set(windows)):
        one, two = (calibrate.r_values(x, labels, w, threshold, bins).select("idx", F.col("map").alias(m), F.col("r_value").alias(f"r{m}")) for x, m in ((pairs, "m1"), (back, "m2")))
        r = F.round(F.least("rm1", "rm2"), 9)
        level = sum((F.when(r >= t, 1).otherwise(0) for t in steps), F.lit(0))
        counts = one.join(two, "idx").groupBy("m1", "m2", level.alias("level")).agg(F.count("*").alias("n")).toPandas()
        out += _grid(pairs, labels, counts, w, steps)
    return pairs.sparkSession.createDataFrame(out, _GRID)
