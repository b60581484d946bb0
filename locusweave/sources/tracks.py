"""Readers of track files, and the binning of what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_posterior(spark: SparkSession, path: str, format: str = "bed") -> tuple[DataFrame, list[str]]:
    """(chr, start, end, p) and labels, from a table with a header: tab-separated, or comma-separated with an index column."""
    df = spark.read.csv(path, sep="\t" if format == "bed" else ",", header=True, mode="DROPMALFORMED", inferSchema=False)
    if format != "bed":
        df = df.drop(df.columns[0])
    df = df.withColumnRenamed("chrom", "chr")
    labels = df.columns[3:]
    return df.select(F.regexp_replace("chr", "_[12]$", "").alias("chr"), F.col("start").cast("long"), F.col("end").cast("long"), F.array(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in labels]).alias("p")), labels


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line): the lines of text files with their 0-based number in the file; large files are read by many tasks.

    A task reads byte ranges of files from their first line to their last, one after the other. The ranges' numbers of lines give where each begins;
    a line's place in its range is its place among the task's lines less that of the range's first line. Only ranges are summed
    up, about one for each 128 MB.
    """
    found = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_from")
    lines = spark.read.text(path).select("value", *found).withColumn("_id", F.monotonically_increasing_id())
    ranges = lines.groupBy("file", "_from").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(ranges, ["file", "_from"]).select("value", "file", (F.col("_offset") + F.col("_id") - F.col("_first")).alias("line"))


def read_state_directory(spark: SparkSession, path: str, resolution: int = 200) -> DataFrame:
    """(chr, start, end, p) of files ``..._<chr>_posterior.txt``: a line of names, a header, then a row for each bin.

    A bin's place is its line's number (see ``numbered_lines``); an empty line has a place and gives no bin.
    """
    lines = numbered_lines(spark, f"{path}/*_posterior.txt").where(F.col("line") >= 2).where(F.trim("value") != "")
    start = (F.col("line") - 2) * resolution
    p = F.transform(F.split("value", "\t"), lambda x: x.cast("double"))
    return lines.select(F.element_at(F.split("file", "_"), -2).alias("chr"), start.alias("start"), (start + resolution).alias("end"), p.alias("p"))


def ids_from_zero(labels: list[str]) -> list[str]:
    """State names ``posterior<i>`` whose ids start at 1 (or later) moved down to start at 0; other names stay."""
    ids = [int(x.removeprefix("posterior")) for x in labels if x.removeprefix("posterior").isdigit() and x.startswith("posterior")]
    if len(ids) != len(labels) or not ids:
        return labels
    return [f"posterior{i - min(ids)}" for i in ids]


def read_pair(spark: SparkSession, one: str, two: str, format: str = "bed") -> tuple[DataFrame, DataFrame, list[str]]:
    """Two posterior tables and their common labels; where only one of them counts states from 1, it is counted from 0 as the other."""
    (a, la), (b, lb) = (read_posterior(spark, path, format) for path in (one, two))
    if la != lb and ids_from_zero(la) == ids_from_zero(lb):
        la = lb = ids_from_zero(la)
    names = [x for x in la if x in lb]
    pick = lambda df, own: df.withColumn("p", F.array(*[F.col("p")[own.index(x)] for x in names]))
    return pick(a, la), pick(b, lb), names


def read_bedgraph(spark: SparkSession, path: str, scale: float = 100.0) -> DataFrame:
    """(chr, start, end, value, file): percentages become shares; header lines (of other than four numbers) are dropped."""
    df = spark.read.csv(path, sep="\t", schema="chr string, start long, end long, value double", mode="DROPMALFORMED")
    return df.where("start is not null").select("chr", "start", "end", (F.col("value") / scale).alias("value"), F.col("_metadata.file_name").alias("file"))


def split_bins(track: DataFrame, resolution: int) -> DataFrame:
    """Rows longer than ``resolution`` cut into bins, the last one at the row's end."""
    cut = track.withColumn("_s", F.explode(F.sequence(F.col("start"), F.greatest(F.col("start"), F.col("end") - 1), F.lit(resolution))))
    return cut.withColumn("end", F.least("end", F.col("_s") + resolution)).withColumn("start", F.col("_s")).drop("_s")


def combine_labels(track: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """(chr, start, end, p) from one row for each label; joined by coordinates, so misaligned files show as nulls."""
    return track.groupBy("chr", "start", "end").agg(F.array(*[F.max(F.when(F.col(key) == x, F.col("value"))) for x in labels]).alias("p"))


def bins_of_sizes(sizes: DataFrame, resolution: int) -> DataFrame:
    """Empty bins of chromosomes (chr, size); the last one ends with its chromosome."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(resolution).cast("long")))
    return sizes.select("chr", "size", start.alias("start")).select("chr", "start", F.least("size", F.col("start") + resolution).alias("end"))


def bins_of_regions(regions: DataFrame, resolution: int) -> DataFrame:
    """Empty bins of regions (chr, start, end); the last one is whole."""
    return regions.select("chr", F.explode(F.sequence("start", F.col("end") - 1, F.lit(resolution).cast("long"))).alias("start")).withColumn("end", F.col("start") + resolution)


def weighted_bins(bins: DataFrame, track: DataFrame) -> DataFrame:
    """(chr, start, end, value): the track's mean over each bin, weighted by length."""
    from ..operators.ranges import overlap_join, overlap_length

    met = overlap_join(bins, track)
    part = F.col("b_value") * overlap_length(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end")) / (F.col("end") - F.col("start"))
    return met.groupBy("chr", "start", "end").agg(F.sum(part).alias("value"))


def read_mnemonics(spark: SparkSession, path: str) -> dict[int, str]:
    """State names by 0-based id; ids that start at 1 move down by one."""
    rows = [(int(r[0]), r[1]) for r in spark.read.csv(path, sep="\t", header=True).collect()]
    return {i - (rows[0][0] == 1): name for i, name in rows} if rows and rows[0][0] in (0, 1) else {}


def read_genes(spark: SparkSession, path: str, plus_only: bool = True, drop_overlapping: bool = True) -> DataFrame:
    """(chr, start, end, strand, gene_id ...); of consecutive genes that overlap the shorter goes."""
    df = spark.read.csv(path, header=True)
    df = df.drop(df.columns[0]).withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})
    if plus_only:
        df = df.where("strand = '+'")
    if drop_overlapping:
        order = Window.partitionBy("chr").orderBy("start", "end")
        size = F.col("end") - F.col("start")
        after, before = F.lead("start").over(order), F.lag("end").over(order)
        df = df.withColumns({"_a": (after < F.col("end")) & (size <= F.lead(size).over(order)), "_b": (before > F.col("start")) & (size < F.lag(size).over(order))}).where("not coalesce(_a, false) and not coalesce(_b, false)").drop("_a", "_b")
    return df


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, tpm): versions are cut off; the first row of a gene counts."""
    df = spark.read.csv(path, sep="\t", header=True).withColumn("_at", F.monotonically_increasing_id())
    return df.groupBy(F.split_part("gene_id", F.lit("."), F.lit(1)).alias("gene_id")).agg(F.min_by(F.col("TPM").cast("double"), "_at").alias("tpm"))


def write_track(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=header)


def browser_rows(segments: DataFrame, colours: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Nine-column rows for genome browsers; labels without a colour are black."""
    spark = segments.sparkSession
    table = spark.createDataFrame([(k.lower(), ",".join(str(int(c * 255)) for c in v)) for k, v in colours.items()] or [("", "0,0,0")], "_key string, itemRgb string")
    joined = segments.withColumn("_key", F.lower("label")).join(F.broadcast(table), "_key", "left")
    return joined.select(F.col("chr").alias("chrom"), F.col("start").alias("chromStart"), F.col("end").alias("chromEnd"), F.col("label").alias("name"), F.lit(0).alias("score"), F.lit(".").alias("strand"), F.col("start").alias("thickStart"), F.col("end").alias("thickEnd"), F.coalesce("itemRgb", F.lit("0,0,0")).alias("itemRgb"))
