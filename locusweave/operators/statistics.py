"""Rank statistics, p-values, soft information, roll-ups of runs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import ranked
from .overlap import soft_coverage, soft_joint
from .profiles import average_ranks


def two_sided_p(z: Column) -> Column:
    """The normal two-sided p-value, by a polynomial in 1 / (1 + 0.2316419 z) with an error below 1e-7."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    # fixed values of the approximation (Abramowitz and Stegun, 26.2.17)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 2 * F.exp(-x * x / 2) / 2.5066282746310002 * series


def spearman(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, n, spearman): correlation of mean ranks within each key."""
    both = average_ranks(average_ranks(rows, key, x, "_x"), key, y, "_y")
    return both.groupBy(key).agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("spearman"))


def signed_rank(rows: DataFrame, key: str, difference: str) -> DataFrame:
    """(key, n, w, z, p): Wilcoxon's test of paired differences (to 9 digits) other than zero."""
    d = F.round(difference, 9)
    own = rows.select(key, d.alias("_d"), F.abs(d).alias("_a")).where("_d <> 0")
    n = F.col("n").cast("double")
    sums = average_ranks(own, key, "_a", "_r").groupBy(key).agg(F.count("*").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w"))
    z = F.try_divide(F.col("w") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    return sums.withColumn("z", z).withColumn("p", two_sided_p(F.col("z")))


def contrasts(rows: DataFrame, key: str, value: str, sure: Column, order: str) -> DataFrame:
    """(key, n1, n0, ratio, mean_diff, t, z_mean, p_mean, z_rank, p_rank, z_paired, p_paired): sure rows against the others, of each key.

    ``t`` is Student's with one variance for both, ``z_mean`` the same held against the normal curve; ``z_rank`` is the rank-sum test with ties and
    a continuity correction; ``z_paired`` is Wilcoxon's test of the i-th sure row against the i-th other one by ``order`` (a unique integer), for keys with as many
    of both. What a key has no rows for is null.
    """
    own = rows.select(F.col(key), F.col(value).alias("_x"), sure.alias("_s"), F.col(order).alias("_o")).where("_x is not null and _s is not null")
    of = lambda c, s: F.when(F.col("_s") == s, F.col(c))
    sums = [f(of(c, s)).alias(f"{n}{int(s)}") for s in (True, False) for n, f, c in (("n", F.count, "_x"), ("mean", F.avg, "_x"), ("var", F.variance, "_x"))]
    facts = average_ranks(own, key, "_x", "_r").groupBy(key).agg(*sums, F.sum(of("_r", True)).alias("ranks"))
    tie = own.groupBy(key, "_x").agg(F.count("*").cast("double").alias("c")).groupBy(key).agg(F.sum(F.col("c") * (F.col("c") * F.col("c") - 1)).alias("ties"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n, diff = n1 + n0, F.col("mean1") - F.col("mean0")
    # a side of one row has no variance of its own
    inside = F.coalesce("var1", F.lit(0.0)) * (n1 - 1) + F.coalesce("var0", F.lit(0.0)) * (n0 - 1)
    t = F.try_divide(diff, F.sqrt(F.try_divide(inside, n - 2) * (1 / F.nullif(n1, F.lit(0.0)) + 1 / F.nullif(n0, F.lit(0.0)))))
    off = F.col("ranks") - n1 * (n + 1) / 2
    spread = F.sqrt(n1 * n0 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)), spread)
    tested = facts.join(F.broadcast(tie), key).withColumns({"t": t, "z_rank": z})
    placed = ranked(own.withColumn("_k", F.struct(key, "_s")), "_k", "_o", "_o").select(key, "_s", "_x", "pos")
    both = placed.where("_s").select(key, "pos", F.col("_x").alias("_a")).join(placed.where("not _s").select(key, "pos", F.col("_x").alias("_b")), [key, "pos"])
    even = facts.where("n1 = n0").select(key)
    paired = signed_rank(both.join(F.broadcast(even), key).withColumn("_d", F.col("_a") - F.col("_b")), key, "_d").select(key, F.col("z").alias("z_paired"), F.col("p").alias("p_paired"))
    return tested.join(F.broadcast(paired), key, "left").select(
        key, "n1", "n0", F.try_divide(n1, n0).alias("ratio"), diff.alias("mean_diff"), "t", F.col("t").alias("z_mean"), two_sided_p(F.col("t")).alias("p_mean"), "z_rank", two_sided_p(F.col("z_rank")).alias("p_rank"), "z_paired", "p_paired"
    )


def student_p(t: float, df: float) -> float:
    """Student's two-sided p-value, by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d)
        c = 1 + step / c
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    part = front * (f - 1)
    return 1 - part if swap else part


def soft_information(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row (mi, nmi) from posteriors: mutual information, and its share of the other track's entropy."""
    cells = soft_joint(pairs, labels)
    one, two = soft_coverage(pairs, labels, "p1").withColumnRenamed("coverage", "c1"), soft_coverage(pairs, labels, "p2").select(F.col("k").alias("j"), F.col("coverage").alias("c2"))
    met = cells.join(F.broadcast(one), "k").join(F.broadcast(two), "j")
    mi = met.agg(F.sum(F.when(F.col("joint") > 0, F.col("joint") * F.log2(F.col("joint") / (F.col("c1") * F.col("c2")))).otherwise(0.0)).alias("mi"))
    h = two.agg((-F.sum(F.when(F.col("c2") > 0, F.col("c2") * F.log2("c2")).otherwise(0.0))).alias("h"))
    return mi.crossJoin(h).select("mi", F.try_divide("mi", "h").alias("nmi"))  # one row each


def frequent_pair(rows: DataFrame, items: str) -> DataFrame:
    """(a, b, n): the two members that occur together in most rows' arrays; the least pair among equals."""
    own = rows.select(F.array_sort(F.array_distinct(items)).alias("x"))
    ones = own.select(F.posexplode("x").alias("i", "a"), "x")
    both = ones.select("a", F.explode(F.slice("x", F.col("i") + 2, F.greatest(F.lit(0), F.size("x")))).alias("b"))
    return both.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "a", "b").limit(1)


def log_odds_strata(placed: DataFrame, expected: DataFrame, size: int) -> DataFrame:
    """(k, b, x, oe): of each label's strata the middle, and ln of how often its partner is seen over how often by chance.

    ``placed``: (k, pos, p, hit); ``expected``: (k, share). A stratum that never sees it counts as one over one more than expected.
    """
    own = placed.groupBy("k", F.floor(F.col("pos") / size).alias("b")).agg(((F.min("p") + F.max("p")) / 2).alias("x"), F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("o"))
    e = F.col("share") * F.col("n")
    return own.join(F.broadcast(expected), "k").select("k", "b", "x", F.when(F.col("o") == 0, F.ln(1 / (e + 1))).otherwise(F.ln(F.col("o") / e)).alias("oe"))


def window_max(rows: DataFrame, value: str, w: int) -> DataFrame:
    """(idx, value): the largest value that each row's window shows, offsets -w to w - 1."""
    from .core import by_block, halo

    return halo(rows.select("idx", value), w).withColumn("_m", F.max(value).over(by_block().rowsBetween(-w, w - 1))).where("_own").select("idx", F.col("_m").alias(value))


def flank_parts(raw: DataFrame, share: float = 0.1) -> DataFrame:
    """Raw counts whose components' first and last ``share`` of offsets are components of their own (``:start``, ``:end``)."""
    order = Window.partitionBy("component")
    least, most = F.min("offset").over(order), F.max("offset").over(order)
    place = F.try_divide(F.col("offset") - least, most - least + 1)
    part = F.when(place < share, ":start").when(place >= 1 - share, ":end").otherwise("")
    return raw.withColumn("component", F.concat("component", part))
