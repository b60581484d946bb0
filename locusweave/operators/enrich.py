"""Enrichment by strata of posteriors, binned overlaps, contiguous windows, one-to-one matches of every bin."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import by_block, halo, ranked, size
from .match import assignment, to_array
from .overlap import coverage, label_frame, overlap


def strata_ranges(rows: DataFrame, n: int, bins: int) -> DataFrame:
    """(k, b, low, high): least and largest p of each stratum of n // bins rows by (p, idx); under two for each of ``bins``."""
    placed = ranked(rows, "k", "p", "idx").withColumn("b", F.floor(F.col("pos") / max(1, n // bins)))
    return placed.groupBy("k", "b").agg(F.min("p").alias("low"), F.max("p").alias("high"))


def stratified(rows: DataFrame, chosen: DataFrame, bins: int, by_chosen: bool) -> DataFrame:
    """(k, b, low, high, enrichment, map_share, mean_tpm) of strata of each label's posteriors.

    ``rows``: (idx, k, p, m1) of all bins, ``chosen``: (idx, tpm) of annotated ones. Strata are of the chosen bins' posteriors
    (``by_chosen``) or of all. A stratum's closed range counts every bin with a posterior in it: enrichment is ln of the range's
    share of chosen bins over its share of all; strata without chosen bins are left out. Rows are summed by distinct posterior
    first, so that what meets the (few) ranges doesn't grow with the table. Every bin has one row for each label.
    """
    marked = rows.join(chosen.select("idx", "tpm", F.lit(1).alias("own")), "idx", "left")
    own = marked.where("own = 1") if by_chosen else marked
    n, m = rows.groupBy("k").count().agg(F.max("count")).first()[0] or 0, chosen.count()
    ranges = strata_ranges(own.select("idx", "k", "p"), m if by_chosen else n, bins)
    hit = F.coalesce("own", F.lit(0))
    sums = marked.groupBy("k", "p").agg(F.count("*").alias("e"), F.sum(hit).alias("t"), F.sum((F.col("m1") == F.col("k")).cast("long")).alias("c"), F.sum("tpm").alias("s"))
    met = sums.join(F.broadcast(ranges), "k").where("p >= low and p <= high")
    total = met.groupBy("k", "b", "low", "high").agg(F.sum("e").alias("e"), F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum("s").alias("s")).where("t > 0")
    return total.select("k", "b", "low", "high", F.ln((F.col("t") / m) / (F.col("e") / n)).alias("enrichment"), (F.col("c") / F.col("e")).alias("map_share"), (F.col("s") / F.col("t")).alias("mean_tpm"))


def binned_overlap(pairs: DataFrame, labels: Sequence[str], bins: int = 10, own_cells: bool = False) -> DataFrame:
    """(k, b1, j, b2, overlap, iou): shares of rows with label k's posterior in cell b1 and label j's in b2 of the other track.

    Cells are half-open and of equal width over the base track's range, or, with ``own_cells``, over each track's own; values outside take
    no part. Empty cells are left out.
    """
    edge = pairs.agg(*[f(g(p)) for p in ("p1", "p2") for f, g in ((F.min, F.array_min), (F.max, F.array_max))]).first()
    edges = {"p1": edge[:2], "p2": edge[2:] if own_cells else edge[:2]}
    n = pairs.count()

    def cells(p: str):
        low, high = (0.0, 0.0) if edges[p][0] is None else edges[p]
        at = [F.struct(F.lit(x).alias("k"), F.when((F.col(p)[i] >= low) & (F.col(p)[i] < high), F.floor((F.col(p)[i] - low) / (high - low) * bins)).alias("b")) for i, x in enumerate(labels)]
        return F.filter(F.array(*at), lambda c: c["b"].isNotNull())

    both = pairs.select(cells("p1").alias("one"), cells("p2").alias("two"))
    joint = both.select(F.explode("one").alias("x"), "two").select("x", F.explode("two").alias("y")).groupBy("x", "y").agg(F.count("*").alias("o"))
    one = both.select(F.explode("one").alias("x")).groupBy("x").agg(F.count("*").alias("n1"))
    two = both.select(F.explode("two").alias("y")).groupBy("y").agg(F.count("*").alias("n2"))
    met = joint.join(one, "x").join(two, "y")
    return met.select(F.col("x.k").alias("k"), F.col("x.b").alias("b1"), F.col("y.k").alias("j"), F.col("y.b").alias("b2"), (F.col("o") / n).alias("overlap"), (F.col("o") / (F.col("n1") + F.col("n2") - F.col("o"))).alias("iou"))


def contiguous_overlap(pairs: DataFrame, labels: Sequence[str], w: int, together: bool = False) -> DataFrame:
    """(k, j, joint, iou) where a row's window (offsets -w to w - 1) ends at gaps of coordinates and at ends of chromosomes.

    Each side shrinks by itself, down to the rows next to the gap; with ``together`` a chromosome that ends within w rows (but for the table's own ends) on either side
    shrinks both. The last row of a contiguous stretch is in no window, as the table's last row elsewhere. Blocks with a halo carry
    the beginnings of stretches and each label's last and next place along, so no row is copied for its window. Cells that
    nothing shows are left out. With ``together`` positions must be without gaps, as rows are counted across stretches.
    """
    at, back = F.col("idx"), Window.partitionBy("_b").orderBy(F.col("idx").desc())
    upto, earlier, ahead = by_block().rowsBetween(Window.unboundedPreceding, 0), by_block().rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, 0)
    dealt = halo(pairs.select("idx", "chr", "start", "end", "m1", "m2"), w + 1)
    was, then = ({c: f(c).over(by_block()) for c in ("idx", "chr", "start", "end")} for f in (F.lag, F.lead))
    joined = lambda a, b: (a["idx"] + 1 == b["idx"]) & (a["chr"] == b["chr"]) & (a["end"] == b["start"])
    own = {c: F.col(c) for c in ("idx", "chr", "start", "end")}
    ends = {"_first": ~F.coalesce(joined(was, own), F.lit(False)), "_last": ~F.coalesce(joined(own, then), F.lit(False)), "_left": was["chr"] != F.col("chr"), "_right": then["chr"] != F.col("chr")}
    marks = dealt.withColumns(ends)
    behind = lambda mark: F.coalesce(F.least(at - F.max(F.when(F.col(mark), at)).over(upto), F.lit(w)), F.lit(w))
    before = lambda mark: F.coalesce(F.least(F.min(F.when(F.col(mark), at)).over(ahead) - at, F.lit(w)), F.lit(w))
    reach = {"_up": behind("_first"), "_down": before("_last")}
    if together:
        reach = {c: F.least(v, behind("_left"), before("_right")) for c, v in reach.items()}
    near = {}
    for i, j in enumerate(labels):
        place = F.when(F.col("m2") == j, at)
        near[f"_l{i}"], near[f"_r{i}"] = at - F.max(place).over(earlier), F.min(place).over(ahead) - at
    if w:
        sees = [F.when((F.col(f"_l{i}") <= F.col("_up")) | (F.col(f"_r{i}") < F.col("_down")), F.lit(j)) for i, j in enumerate(labels)]
    else:
        sees = [F.when(F.col("m2") == j, F.lit(j)) for j in labels]
    seen = marks.withColumns(reach | near).where("_own").select(F.col("m1").alias("k"), F.explode(F.array_compact(F.array(*sees))).alias("j"))
    rows = pairs.count()
    c1 = pairs.groupBy(F.col("m1").alias("k")).agg((F.count("*") / rows).alias("c1"))
    c2 = pairs.groupBy(F.col("m2").alias("j")).agg((F.count("*") / rows).alias("c2"))
    met = seen.groupBy("k", "j").agg((F.count("*") / rows).alias("joint"))
    known = met.join(F.broadcast(c1), "k").join(F.broadcast(c2), "j").where(F.col("k").isin(list(labels)))
    return known.select("k", "j", "joint", F.try_divide(F.col("joint"), F.col("c1") + F.col("c2") - F.col("joint")).alias("iou"))


def matched_bins(pairs: DataFrame, labels: Sequence[str], epsilon: float = 1e-3) -> DataFrame:
    """(idx, m1, m2, matched, reproduced): the one-to-one match by ln of observed over expected counts, held against each row.

    Only label-by-label cells reach the driver.
    """
    n = size(pairs)
    observed = to_array(overlap(pairs, labels, "joint"), labels) * n
    share = [{r["k"]: r["coverage"] for r in coverage(pairs, labels, m).collect()} for m in ("m1", "m2")]
    gain = observed.copy()
    for i, a in enumerate(labels):
        for j, b in enumerate(labels):
            gain[i, j] = math.log((observed[i, j] + epsilon) / (share[0][a] * share[1][b] * n + epsilon))
    found = {labels[i]: labels[j] for i, j in assignment(gain)}
    to = F.create_map(*[F.lit(x) for kj in found.items() for x in kj])
    return pairs.select("idx", "m1", "m2", to[F.col("m1")].alias("matched")).withColumn("reproduced", F.coalesce(F.col("matched") == F.col("m2"), F.lit(False)))


def feature_enrichment(raw: DataFrame, bases: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, component, enrichment): mean over offsets of log2 of ((raw + 1) / all labels' raw) over the label's share of bases.

    ``raw``: (label, component, offset, n), absent labels as zero; ``bases``: (label, bases). Offsets without any count are left
    out. Labels and offsets are few.
    """
    total = raw.groupBy("component", "offset").agg(F.sum("n").alias("total")).where("total > 0")
    every = label_frame(raw.sparkSession, labels, "label").select("label").crossJoin(F.broadcast(total))
    share = bases.join(F.broadcast(bases.agg(F.sum("bases").alias("all")))).select("label", (F.col("bases") / F.col("all")).alias("share"))
    own = every.join(raw.select("label", "component", "offset", "n"), ["label", "component", "offset"], "left").join(F.broadcast(share), "label")
    value = F.log2((F.coalesce("n", F.lit(0)) + 1) / F.col("total") / F.col("share"))
    return own.groupBy("label", "component").agg(F.avg(value).alias("enrichment"))


def around_points(bins: DataFrame, points: DataFrame, resolution: int, reach: int) -> DataFrame:
    """(label, component, offset, n): counts of labels in the bins at -reach to reach - 1 from a point's own."""
    at = points.select("chr", F.explode(F.sequence(F.lit(-reach), F.lit(reach - 1))).alias("offset"), "coord")
    at = at.select("chr", "offset", ((F.floor(F.col("coord") / resolution) + F.col("offset")) * resolution).alias("start"))
    side = F.when(F.col("offset") < 0, "upstream").otherwise("downstream").alias("component")
    return bins.join(at, ["chr", "start"]).groupBy(F.col("m1").alias("label"), side, "offset").agg(F.count("*").alias("n"))
