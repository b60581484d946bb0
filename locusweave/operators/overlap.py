"""Coverage, joint and overlap matrices (long form: k, j, value) and agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import by_block, halo, shown_bits, shows, size, small


def label_frame(spark: SparkSession, labels: Sequence[str], name: str = "k") -> DataFrame:
    return spark.createDataFrame([(x, i) for i, x in enumerate(labels)], f"{name} string, {name}_at int")


def grid(spark: SparkSession, labels: Sequence[str]) -> DataFrame:
    """All pairs of labels: K x K rows."""
    return spark.createDataFrame([(a, b, i, j) for i, a in enumerate(labels) for j, b in enumerate(labels)], "k string, j string, k_at int, j_at int")


def coverage(pairs: DataFrame, labels: Sequence[str], column: str = "m1") -> DataFrame:
    """(k, coverage): share of rows with each label, 0 for absent ones."""
    n = size(pairs)
    counts = pairs.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("c"))
    return label_frame(pairs.sparkSession, labels).join(counts, "k", "left").select("k", (F.coalesce("c", F.lit(0)) / n).alias("coverage"))


def soft_coverage(pairs: DataFrame, labels: Sequence[str], column: str = "p1") -> DataFrame:
    means = pairs.agg(*[F.avg(F.col(column)[i]).alias(f"c{i}") for i in range(len(labels))])
    return means.select(F.explode(F.array(*[F.struct(F.lit(x).alias("k"), F.col(f"c{i}").alias("coverage")) for i, x in enumerate(labels)])).alias("r")).select("r.*")


def joint(pairs: DataFrame, labels: Sequence[str], w: int = 0, symmetric: bool = False) -> DataFrame:
    """(k, j, joint) for every pair of labels.

    w = 0: share of rows with both labels. Otherwise, not symmetric: share of rows with label k whose window shows label j;
    symmetric: mean product of the label's shares in both windows.
    """
    n = size(pairs)
    if w == 0:
        counts = pairs.groupBy(F.col("m1").alias("k"), F.col("m2").alias("j")).agg(F.count("*").cast("double").alias("c"))
    elif not symmetric:
        sums = shown_bits(pairs, "m2", labels, w, "m1").groupBy(F.col("m1").alias("k")).agg(*[F.count_if(shows(i)).cast("double").alias(f"c{i}") for i in range(len(labels))])
        counts = sums.select("k", F.inline(F.array(*[F.struct(F.lit(x).alias("j"), F.col(f"c{i}").alias("c")) for i, x in enumerate(labels)])))
    else:
        window = by_block().rowsBetween(-w, w - 1)
        own = {f"_{m}_{i}": F.count(F.when((F.col(m) == x) & (F.col("idx") < n - 1), 1)).over(window) for m in ("m1", "m2") for i, x in enumerate(labels)}
        dealt = halo(pairs.select("idx", "m1", "m2"), w).withColumns(own).where("_own")
        size_ = F.least(F.col("idx") + w, F.lit(n - 1)) - F.greatest(F.lit(0), F.col("idx") - w)
        cells = [(i, j) for i in range(len(labels)) for j in range(len(labels))]
        sums = dealt.agg(*[F.sum(F.try_divide(F.col(f"_m1_{i}") * F.col(f"_m2_{j}"), size_ * size_)).alias(f"c{i}_{j}") for i, j in cells])
        counts = sums.select(F.explode(F.array(*[F.struct(F.lit(labels[i]).alias("k"), F.lit(labels[j]).alias("j"), F.col(f"c{i}_{j}").alias("c")) for i, j in cells])).alias("r")).select("r.*")
    return grid(pairs.sparkSession, labels).join(counts, ["k", "j"], "left").select("k", "j", (F.coalesce("c", F.lit(0.0)) / n).alias("joint"))


def soft_joint(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Mean products of posteriors, K x K averages of one pass."""
    cells = [(i, j) for i in range(len(labels)) for j in range(len(labels))]
    means = pairs.agg(*[F.avg(F.col("p1")[i] * F.col("p2")[j]).alias(f"c{i}_{j}") for i, j in cells])
    return means.select(F.explode(F.array(*[F.struct(F.lit(labels[i]).alias("k"), F.lit(labels[j]).alias("j"), F.col(f"c{i}_{j}").alias("joint")) for i, j in cells])).alias("r")).select("r.*")


def overlap(pairs: DataFrame, labels: Sequence[str], kind: str = "iou", w: int = 0, symmetric: bool = False, soft: bool = False, cells: DataFrame | None = None) -> DataFrame:
    """(k, j, value): iou, coefficient, f1, kappa, enrichment, conditional or joint; ``cells``: the joint matrix, if it is known."""
    if cells is not None:
        m, c1, c2 = cells, coverage(pairs, labels, "m1"), coverage(pairs, labels, "m2")
    elif soft and w == 0:
        m, c1, c2 = soft_joint(pairs, labels), soft_coverage(pairs, labels, "p1"), soft_coverage(pairs, labels, "p2")
    else:
        m, c1, c2 = joint(pairs, labels, w, symmetric), coverage(pairs, labels, "m1"), coverage(pairs, labels, "m2")
    m = m.join(F.broadcast(c1.withColumnRenamed("coverage", "c1")), "k").join(F.broadcast(c2.select(F.col("k").alias("j"), F.col("coverage").alias("c2"))), "j")
    n = float(size(pairs))
    o, a, b = F.col("joint"), F.col("c1"), F.col("c2")
    chance = a * b + (1 - a) * (1 - b)
    value = {
        "iou": F.try_divide(o, a + b - o),
        "coefficient": F.try_divide(o, F.least(a, b)),
        "f1": F.try_divide(2 * o, a + b),
        "kappa": F.try_divide(1 - a - b + 2 * o - chance, 1 - chance),
        "enrichment": F.ln((o * n + 1e-3) / (a * b * n + 1e-3)),
        "conditional": F.try_divide(o, a),
        "joint": o,
    }[kind]
    return m.select("k", "j", value.alias("value"))


def naive_overlap(pairs: DataFrame, labels: Sequence[str], w: int = 0) -> DataFrame:
    return joint(pairs, labels, w).groupBy("k").agg(F.max("joint").alias("best")).agg(F.sum("best").alias("overlap"))


def symmetrised(matrix: DataFrame, value: str = "value") -> DataFrame:
    """Off-diagonal cells plus their mirror images."""
    mirror = matrix.select(F.col("j").alias("k"), F.col("k").alias("j"), F.col(value).alias("other"))
    return matrix.join(mirror, ["k", "j"]).select("k", "j", F.when(F.col("k") == F.col("j"), F.col(value)).otherwise(F.col(value) + F.col("other")).alias(value))


def agreement(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Per label: agreement, coverage, log of observed over expected, kappa."""
    n = size(pairs)
    own = pairs.groupBy(F.col("m1").alias("k")).agg(F.avg((F.col("m1") == F.col("m2")).cast("double")).alias("a"), F.count("*").alias("c"))
    a, e = F.coalesce("a", F.lit(0.0)), F.lit(1.0 / len(labels))
    return label_frame(pairs.sparkSession, labels).join(own, "k", "left").select(
        "k", a.alias("agreement"), (F.coalesce("c", F.lit(0)) / n).alias("coverage"), F.when(a > 0, F.ln(a / (e + 1e-3))).alias("log_oe"), ((a - (e + 1e-3)) / (1 - (e + 1e-3))).alias("kappa")
    )


def label_agreement(pairs: DataFrame, labels: Sequence[str], other: str | None = None) -> DataFrame:
    """(k, agreed, rows, agreement): of each label's rows, those on which the other track says the same, or says ``other``.

    A label without rows agrees in none of none, and its agreement is null.
    """
    same = F.col("m1") == F.col("m2") if other is None else F.col("m2") == other
    own = pairs.groupBy(F.col("m1").alias("k")).agg(F.count_if(same).alias("agreed"), F.count("*").alias("rows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return label_frame(pairs.sparkSession, labels).join(own, "k", "left").select("k", zero("agreed"), zero("rows"), F.try_divide("agreed", "rows").alias("agreement"))


def general_agreement(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    e = 1.0 / len(labels) + 1e-3
    return pairs.agg(F.avg((F.col("m1") == F.col("m2")).cast("double")).alias("agreement")).select("agreement", F.ln(F.col("agreement") / e).alias("log_oe"), ((F.col("agreement") - e) / (1 - e)).alias("kappa"))


def information(matrix: DataFrame, value: str = "joint") -> DataFrame:
    """One row: row and column entropies, conditional entropy, mutual information, and its share of the column entropy."""
    matrix, v = small(matrix), F.col(value)
    log = lambda x: F.when(x > 0, F.log2(x)).otherwise(F.lit(0.0))
    rows, cols = matrix.groupBy("k").agg(F.sum(v).alias("r")), matrix.groupBy("j").agg(F.sum(v).alias("c"))
    cells = matrix.join(F.broadcast(rows), "k").join(F.broadcast(cols), "j")
    mi = cells.agg(F.sum(F.when(v > 0, v * F.log2(v / (F.col("r") * F.col("c")))).otherwise(0.0)).alias("mi"), (-F.sum(F.when(v > 0, v * F.log2(v / F.col("c"))).otherwise(0.0))).alias("h_cond"))
    h1 = rows.agg((-F.sum(F.col("r") * log(F.col("r")))).alias("h_rows"))
    h2 = cols.agg((-F.sum(F.col("c") * log(F.col("c")))).alias("h_cols"))
    return mi.join(F.broadcast(h1)).join(F.broadcast(h2)).select("h_rows", "h_cols", "h_cond", "mi", F.try_divide("mi", "h_cols").alias("nmi"))
