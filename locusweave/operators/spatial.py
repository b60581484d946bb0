"""How far the other track's corresponding label lies: boundary sweeps, signed distances, offsets, local scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import by_block, halo, islands, previous, ranked, size


def matched(matches: dict[str, list[str]], label: Column) -> Column:
    """The labels that a label's matches are, as an array; null without any."""
    known = [x for k, js in matches.items() if js for x in (F.lit(k), F.array(*[F.lit(j) for j in js]))]
    return F.create_map(*known)[label] if known else F.lit(None).cast("array<string>")


def sides(pairs: DataFrame, matches: dict[str, list[str]], reach: int, *keep: str) -> DataFrame:
    """(idx, m1, left, right, keep): how far the nearest match lies before a row, and from the row on; null beyond ``reach``.

    Blocks with a halo of ``reach`` rows carry each label's last and next place along.
    """
    dealt = halo(pairs.select("idx", "m1", "m2", *keep), reach).withColumn("_wanted", matched(matches, F.col("m1")))
    before = by_block().rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_b").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(None).cast("long")
    lefts, rights = [none, none], [none, none]
    for j in sorted({j for js in matches.values() for j in js}):
        at, own = F.when(F.col("m2") == j, F.col("idx")), F.array_contains("_wanted", j)
        lefts.append(F.when(own, F.max(at).over(before)))
        rights.append(F.when(own, F.min(at).over(after)))
    left, right = F.col("idx") - F.greatest(*lefts), F.least(*rights) - F.col("idx")
    found = dealt.withColumns({"left": left.cast("int"), "right": right.cast("int")}).where("_own")
    return found.select("idx", "m1", *keep, *[F.when(F.col(c) <= reach, F.col(c)).alias(c) for c in ("left", "right")])


def nearest(pairs: DataFrame, matches: dict[str, list[str]], reach: int) -> DataFrame:
    """(idx, m1, distance): signed offset of the nearest match within reach; the right side wins ties; null if none."""
    left, right = F.col("left"), F.col("right")
    return sides(pairs, matches, reach).select("idx", "m1", F.when(left.isNull() | (right <= left), right).otherwise(-left).alias("distance"))


def distance_profile(pairs: DataFrame, matches: dict[str, list[str]], reach: int) -> DataFrame:
    """(m1, distance, n): counts by label and signed distance."""
    return nearest(pairs, matches, reach).groupBy("m1", "distance").agg(F.count("*").alias("n"))


def boundary_cdf(pairs: DataFrame, matches: dict[str, list[str]], reach: int) -> DataFrame:
    """(m1, d, share): of each label's rows (but the table's last), the share with a match within d = 0 .. reach - 1."""
    n = size(pairs)
    near = nearest(pairs, matches, reach - 1).where(F.col("idx") < n - 1).select("m1", F.abs("distance").alias("d"))
    total = near.groupBy("m1").agg(F.count("*").alias("total"))
    counts = near.where("d is not null").groupBy("m1", "d").agg(F.count("*").alias("c"))
    steps = total.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(reach - 1)))).join(counts, ["m1", "d"], "left")
    upto = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy("m1").orderBy("d"))
    return steps.select("m1", "d", (upto / F.col("total")).alias("share"))


def overall_boundary(pairs: DataFrame, matches: dict[str, list[str]], reach: int) -> DataFrame:
    """(w, share): share of rows whose window of each half-width w = 0 .. reach shows a match, in one pass.

    A hit at offset d is first shown by w = d + 1 to the right and w = -d to the left; the last row is never shown by w > 0.
    """
    n = size(pairs)
    left, right = F.col("left"), F.when(F.col("idx") + F.col("right") < n - 1, F.col("right") + 1)
    found = sides(pairs, matches, reach).select(F.array(F.when(F.col("right") == 0, F.lit(0)), F.least(left, right)).alias("w"))
    counts = found.select(F.explode("w").alias("w")).where(F.col("w") <= reach).groupBy("w").agg(F.count("*").alias("c"))
    steps = pairs.sparkSession.range(reach + 1).select(F.col("id").cast("int").alias("w")).join(F.broadcast(counts), "w", "left")
    inner = F.sum(F.when(F.col("w") > 0, F.coalesce("c", F.lit(0))).otherwise(0)).over(Window.orderBy("w"))  # reach + 1 rows
    return steps.select("w", (F.when(F.col("w") == 0, F.coalesce("c", F.lit(0))).otherwise(inner) / n).alias("share"))


def beside(value: str, d: int) -> Column:
    """A column's value ``d`` rows further on in a block."""
    return (F.lead(value, d) if d >= 0 else F.lag(value, -d)).over(by_block())


def correspondence_by_offset(pairs: DataFrame, matches: dict[str, list[str]], reach: int, both: bool = False) -> DataFrame:
    """(m1, d, share): share of a label's rows with a match exactly d away on either side, or on both; positions clamped to the table."""
    n = size(pairs)
    ends = {r["idx"]: r["m2"] for r in pairs.where(F.col("idx").isin(0, n - 1)).select("idx", "m2").collect()}
    dealt = halo(pairs.select("idx", "m1", "m2"), reach).withColumn("_wanted", matched(matches, F.col("m1")))
    hit = {}
    for d in range(reach + 1):
        one, two = F.when(F.col("idx") + d > n - 1, F.lit(ends[n - 1])).otherwise(beside("m2", d)), F.when(F.col("idx") - d < 0, F.lit(ends[0])).otherwise(beside("m2", -d))
        one, two = (F.coalesce(F.array_contains("_wanted", x), F.lit(False)) for x in (one, two))
        hit[f"_h{d}"] = one & two if both else one | two
    means = dealt.withColumns(hit).where("_own").groupBy("m1").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in hit])
    return means.select("m1", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"_h{d}").alias("share")) for d in range(reach + 1)])).alias("r")).select("m1", "r.*")


def local_scores(pairs: DataFrame, matrix: DataFrame, w: int) -> DataFrame:
    """(idx, score): the best IoU of the row's label at offsets for which both sides exist, over its distance plus one."""
    n = size(pairs)
    rows: dict[str, list[Column]] = {}
    for r in matrix.select("k", "j", "value").collect():
        rows.setdefault(r["k"], []).extend([F.lit(r["j"]), F.lit(r["value"]).cast("double")])
    values = F.create_map(*[x for k, row in rows.items() for x in (F.lit(k), F.create_map(*row))])
    dealt = halo(pairs.select("idx", "m1", "m2"), w).withColumn("_row", values[F.col("m1")])
    dealt = dealt.withColumns({f"_j{d + w}": beside("m2", d) for d in range(-w, w + 1)}).where("_own")
    found = []
    for d in range(-w, w + 1):
        inside = (F.col("idx") - abs(d) >= 0) & (F.col("idx") + abs(d) <= n - 1)
        found.append(F.when(inside, F.struct(F.col("_row")[F.col(f"_j{d + w}")].alias("value"), F.lit(-(abs(d) * 2 + (d > 0))).alias("o"))))
    best = dealt.select("idx", F.array_max(F.array(*found)).alias("b"))
    return best.select("idx", (F.col("b.value") / (F.floor(-F.col("b.o") / 2) + 1)).alias("score"))


def reproduced(pairs: DataFrame, matches: dict[str, list[str]], w: int, hide_last: bool = False, prior: Column | None = None) -> DataFrame:
    """(idx, m1, is_repr): whether the window (-w to w - 1) shows a match, or ``prior`` holds.

    With ``hide_last`` the table's last position is never shown by a window of any width but 0.
    """
    right = F.col("right") < max(1, w)
    if hide_last and w:
        right = right & (F.col("idx") + F.col("right") < size(pairs) - 1)
    hit = F.coalesce(right, F.lit(False)) | F.coalesce(F.col("left") <= w, F.lit(False))
    if prior is None:
        return sides(pairs, matches, w).select("idx", "m1", hit.alias("is_repr"))
    known = F.coalesce("_prior", F.lit(False))
    return sides(pairs.withColumn("_prior", prior), matches, w, "_prior").select("idx", "m1", (hit | known).alias("is_repr"))


def segments(rows: DataFrame, label: str = "m1", chrom: bool = True, gap_aware: bool = False) -> DataFrame:
    """(chr, start, end, label, n): runs of equal labels; with ``gap_aware`` a gap of coordinates ends a run."""
    before = previous(rows.select("idx", "chr", "start", "end", label), label, "chr", "end")
    new = F.col(f"prev_{label}").isNull() | (F.col(f"prev_{label}") != F.col(label))
    if chrom:
        new = new | (F.col("prev_chr") != F.col("chr"))
    if gap_aware:
        new = new | (F.col("prev_end") != F.col("start"))
    runs = islands(before, new)
    return runs.groupBy("island").agg(F.first("chr").alias("chr"), F.min("start").alias("start"), F.max("end").alias("end"), F.first(label).alias("label"), F.count("*").alias("n")).drop("island")


def granularity(matrix: DataFrame, cells: DataFrame, c1: DataFrame, c2: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(k, step, coverage, agreement): labels of the other track joined by falling IoU, cumulative; step 0 is the origin."""
    from .overlap import grid

    m = matrix.join(cells, ["k", "j"]).join(F.broadcast(grid(matrix.sparkSession, labels)), ["k", "j"])
    m = m.join(F.broadcast(c1.withColumnRenamed("coverage", "c1")), "k").join(F.broadcast(c2.select(F.col("k").alias("j"), F.col("coverage").alias("c2"))), "j")
    order = Window.partitionBy("k").orderBy(F.col("value").desc_nulls_last(), "j_at")
    m = m.select("k", F.row_number().over(order).alias("step"), F.sum("c2").over(order).alias("coverage"), F.sum(F.try_divide("joint", "c1")).over(order).alias("agreement"))
    start = m.select("k").distinct().select("k", F.lit(0).alias("step"), F.lit(0.0).alias("coverage"), F.lit(0.0).alias("agreement"))
    return m.unionByName(start)


def area(curve: DataFrame) -> DataFrame:
    """(k, auc, max_auc): trapezoid areas of a granularity curve, and of one that is 1 from its first step."""
    order = Window.partitionBy("k").orderBy("step")
    dx = F.col("coverage") - F.lag("coverage").over(order)
    top = F.when(F.col("step") == 0, 0.0).otherwise(1.0)
    parts = curve.select("k", (dx * (F.col("agreement") + F.lag("agreement").over(order)) / 2).alias("a"), (dx * (top + F.lag(top).over(order)) / 2).alias("m"))
    return parts.groupBy("k").agg(F.sum("a").alias("auc"), F.sum("m").alias("max_auc"))


def correspondence_curve(pairs: DataFrame, labels: Sequence[str], steps: int = 100) -> DataFrame:
    """(k, t, psi): share of rows in the top int(t n) + 1 of both tracks, by each label's posterior, for all t in one pass."""
    n = size(pairs)

    def ranks(p: str, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(x).alias("k"), (-F.col(p)[i]).alias("p")) for i, x in enumerate(labels)])
        return ranked(pairs.select("idx", F.explode(cells).alias("c")).select("idx", "c.*"), "k", "p", "idx").select("k", "idx", F.col("pos").alias(name))

    last = ranks("p1", "r1").join(ranks("p2", "r2"), ["k", "idx"]).select("k", F.greatest("r1", "r2").alias("r"))
    # the first step whose top holds a row
    step = last.select("k", F.least(F.lit(steps + 1), F.ceil(F.col("r") * steps / n)).cast("int").alias("t")).groupBy("k", "t").agg(F.count("*").alias("c"))
    every = pairs.sparkSession.createDataFrame([(k, t) for k in labels for t in range(steps + 1)], "k string, t int").join(F.broadcast(step), ["k", "t"], "left")
    upto = Window.partitionBy("k").orderBy("t")
    return every.select("k", (F.col("t") / steps).alias("t"), (F.sum(F.coalesce("c", F.lit(0))).over(upto) / n).alias("psi"))


def slope(curve: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Add ``slope``: central differences within each curve, one-sided at its ends."""
    order = Window.partitionBy(key).orderBy(x)
    before, after = (F.coalesce(f(c).over(order), F.col(c)) for f, c in ((F.lag, x), (F.lead, x)))
    low, high = (F.coalesce(f(y).over(order), F.col(y)) for f in (F.lag, F.lead))
    return curve.withColumn("slope", F.try_divide(high - low, after - before))
