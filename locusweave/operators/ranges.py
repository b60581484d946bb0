"""Interval joins by coordinate cells, and statistics over annotated bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a join cell in base pairs: wider than most intervals, so that few span several.
CELL = 16_384


def _cells(df: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    low = F.floor(start / width)
    return df.withColumn("_low", low).withColumn("_cell", F.explode(F.sequence(low, F.greatest(low, F.floor((end - 1) / width)))))


def overlap_join(a: DataFrame, b: DataFrame, how: str = "inner", width: int = CELL) -> DataFrame:
    """Rows of ``a`` with each overlapping row of ``b`` (half-open; b's columns with the prefix b_); or left_anti / left_semi.

    An equi-join on chromosome and cell; a pair that shares several cells counts in the first only.
    """
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    one, two = _cells(a, F.col("start"), F.col("end"), width), _cells(right, F.col("b_start"), F.col("b_end"), width).withColumnsRenamed({"_low": "_blow", "_cell": "_bcell"})
    on = (F.col("chr") == F.col("b_chr")) & (F.col("_cell") == F.col("_bcell")) & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    if how in ("left_semi", "left_anti"):
        keys = one.join(two, on, "left_semi").select("chr", "start", "end").distinct()
        return a.join(keys, ["chr", "start", "end"], how)
    met = one.join(two, on).where(F.col("_cell") == F.greatest("_low", "_blow"))
    return met.drop("_low", "_cell", "_blow", "_bcell")


def overlap_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def near(bins: DataFrame, genes: DataFrame, width: int = CELL) -> DataFrame:
    """The bins of which the start or end lies in a cell that a gene's closed interval touches.

    There are no more cells than the genome has, so they are broadcast and bins far from every gene are never moved.
    """
    low, high = (F.floor(F.col(c) / width) for c in ("start", "end"))
    cells = genes.select("chr", F.explode(F.sequence(low, high)).alias("_near")).distinct()
    found = bins
    for c in ("start", "end"):
        touched = cells.select("chr", F.col("_near").alias(f"_{c}"), F.lit(True).alias(f"_by_{c}"))
        found = found.withColumn(f"_{c}", F.floor(F.col(c) / width)).join(F.broadcast(touched), ["chr", f"_{c}"], "left")
    return found.where("_by_start or _by_end").select(*bins.columns)


def endpoint_join(bins: DataFrame, genes: DataFrame, width: int = CELL, keep: Sequence[str] = ()) -> DataFrame:
    """Bins whose start or end lies in a gene's closed interval, with the last such gene's tpm (by gene_id); ``keep``: more of a bin's columns."""
    right = genes.select(F.col("chr").alias("g_chr"), F.col("start").alias("g0"), F.col("end").alias("g1"), "gene_id", "tpm")
    right = right.withColumn("_bcell", F.explode(F.sequence(F.floor(F.col("g0") / width), F.floor(F.col("g1") / width))))
    ends = near(bins, genes).withColumn("_point", F.explode(F.array("start", "end"))).withColumn("_cell", F.floor(F.col("_point") / width))
    met = ends.join(right, (F.col("chr") == F.col("g_chr")) & (F.col("_cell") == F.col("_bcell")) & (F.col("_point") >= F.col("g0")) & (F.col("_point") <= F.col("g1")))
    # strings are keys, not aggregates: these would sort every pair
    return met.groupBy("idx", "chr", "start", "end", "m1", *keep).agg(F.max_by("tpm", "gene_id").alias("tpm"))


def point_join(bins: DataFrame, points: DataFrame, width: int = CELL) -> DataFrame:
    """Distinct bins that strictly contain a point."""
    right = points.select(F.col("chr").alias("p_chr"), "coord").withColumn("_bcell", F.floor(F.col("coord") / width))
    left = bins.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    return left.join(right, (F.col("chr") == F.col("p_chr")) & (F.col("_cell") == F.col("_bcell")) & (F.col("start") < F.col("coord")) & (F.col("coord") < F.col("end")), "left_semi").drop("_cell").distinct()


def enrichment_at(bins: DataFrame, chosen: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, enrichment): ln of a label's share among chosen bins over its share among all; a missing share is 1 / chosen."""
    totals = bins.agg(F.count("*").alias("n")).join(F.broadcast(chosen.agg(F.count("*").alias("m"))))
    every = bins.groupBy(F.col("m1").alias("k")).agg(F.count("*").alias("c"))
    own = chosen.groupBy(F.col("m1").alias("k")).agg(F.count("*").alias("h"))
    joined = labels.join(every, "k").join(own, "k", "left").join(F.broadcast(totals))
    share = F.when(F.coalesce("h", F.lit(0)) > 0, F.col("h") / F.col("m")).otherwise(F.try_divide(F.lit(1.0), F.col("m")))
    return joined.select("k", F.ln(share / (F.col("c") / F.col("n"))).alias("enrichment"))


def body_share(segments: DataFrame, genes: DataFrame) -> DataFrame:
    """(label, gene_type, share): overlap with genes of each type over the label's total length."""
    total = segments.groupBy("label").agg(F.sum(F.col("end") - F.col("start")).alias("length"))
    met = overlap_join(segments, genes).groupBy("label", F.col("b_gene_type").alias("gene_type")).agg(F.sum(overlap_length(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end"))).alias("bp"))
    return met.join(F.broadcast(total), "label").select("label", "gene_type", (F.col("bp") / F.col("length")).alias("share"))


def first_of(rows: DataFrame, facts: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value): of each row's facts the first by ``order``; rows without any are left out."""
    first = facts.groupBy(key).agg(F.min_by(value, order).alias(value))
    return rows.join(first, key).select(key, value)
