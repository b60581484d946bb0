"""Merging step by step with calibration: how robust the annotation is at every number of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calibrate
from .calibrate import counted, matched
from .core import shown_bits, size
from .edges import Edges, edges
from .match import merging_gain
from .merging import best_pair, facts, group_names, grouped, merged, shares


def calibrated_progress(pairs: DataFrame, labels: Sequence[str], w: int = 5, threshold: float = 0.75, bins: int = 500, robust: float = 0.9, down_to: int = 2) -> list[tuple]:
    """(labels, entropy, mi, nmi, naive, robust, mean_r) for each number of labels down to ``down_to``.

    Both tracks merge their best pair at each step, as in ``merge_progress``. ``robust`` is the share of rows with an r-value of that much or
    more. A merge changes one posterior of a row, so only the merged label's strata are found anew; the other labels keep the edges of
    theirs, and what is counted in them again is which rows see a match. Edges, curves and label-by-label cells come to the driver; no
    row's stratum is kept.
    """
    n = size(pairs)
    step = calibrate.strata_count(n, bins)
    one = two = [[i] for i in range(len(labels))]
    out: list[tuple] = []
    known: dict[str, Edges] = {}
    while True:
        names, others = group_names(one, labels), group_names(two, labels)
        rows = shown_bits(grouped(pairs, labels, one, two), "m2", others, w, "p1", "m1", "m2", n=n).persist(StorageLevel.MEMORY_AND_DISK)
        counts = counted(rows, others)
        fresh = edges(rows, [i for i, k in enumerate(names) if k not in known], step, n)
        known = {k: e for k, e in known.items() if k in names} | {names[i]: e for i, e in fresh.items()}
        found = calibrate.points(rows, names, others, {i: known[k] for i, k in enumerate(names)}, matched(counts, names, others, n, threshold), n)
        at_curve = calibrate.interpolation(calibrate.curves(found))
        values = rows.groupBy("m1", F.array_max("p1").alias("p")).agg(F.count("*").alias("n")).select("n", at_curve("m1", "p").alias("r"))
        total = values.agg((F.sum(F.when(F.col("r") >= robust, F.col("n")).otherwise(0)) / F.sum("n")).alias("robust"), (F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("mean_r")).first()
        joint = shares(counts, names, others)
        out.append((len(one), *facts(joint), total["robust"], total["mean_r"]))
        rows.unpersist()
        if len(one) <= max(2, down_to):
            return out
        one, two = merged(one, best_pair(merging_gain(joint))), merged(two, best_pair(merging_gain(joint.T)))


def two_way_matches(rows: DataFrame, names: Sequence[str], others: Sequence[str], w: int, threshold: float) -> dict[str, list[str]]:
    """Each label's partners in a track with other labels: those with an IoU above the threshold, else the best; one pass."""
    return matched(counted(shown_bits(rows, "m2", others, w, "m1", "m2"), others), names, others, size(rows), threshold)
