"""Readers of annotations, parameters and earlier results, and writers of reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _tab(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, comment="#", mode="PERMISSIVE")


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(chr, size) of a file of chromosome sizes."""
    return _tab(spark, path, "chr string, size long").where("size is not null")


def read_include(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end) of a file of regions to include; more columns are left out, headers too."""
    return _tab(spark, path, "chr string, start long, end long").where("start is not null and end is not null")


#: Region files of regulatory elements and accessible sites have the same first three columns.
read_regions = read_include


def read_tss(spark: SparkSession, path: str) -> DataFrame:
    """(chr, coord, strand) of a headerless table of transcription start sites."""
    return _tab(spark, path, "chr string, coord long, strand string").where("coord is not null")


def read_segmentation(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, label, colour) of a nine-column annotation file; browser and track lines are dropped."""
    schema = "chr string, start long, end long, label string, score string, strand string, thick_start long, thick_end long, colour string"
    return _tab(spark, path, schema).where("start is not null and end is not null").select("chr", "start", "end", "label", "colour")


def base_pairs(track: DataFrame, chromosome: str) -> DataFrame:
    """(chr, position, value): a chromosome's track, one row for each base pair."""
    own = track.where(F.col("chr") == chromosome).where("end > start")
    return own.select("chr", F.explode(F.sequence("start", F.col("end") - 1)).alias("position"), "value")


def read_by_state(spark: SparkSession, path: str, scale: float = 100.0) -> DataFrame:
    """(state, chr, start, end, value) of a directory of files ``posterior<state>.bedGraph``; the state comes from the name."""
    rows = _tab(spark, f"{path}/posterior*.bedGraph", "chr string, start long, end long, value double").where("value is not null")
    state = F.regexp_extract(F.col("_metadata.file_name"), r"posterior(\d+)\.", 1).cast("int")
    return rows.select(state.alias("state"), "chr", "start", "end", (F.col("value") / scale).alias("value"))


def read_signal_distribution(spark: SparkSession, path: str) -> DataFrame:
    """(label, trackname, mean, sd) of a table with a header; other columns are left out."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.select("label", "trackname", F.col("mean").cast("double").alias("mean"), F.col("sd").cast("double").alias("sd"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, column, value) of a table of numbers with names in its header and first column, such as emission parameters."""
    df = spark.read.csv(path, sep="\t", header=True)
    first, *rest = df.columns
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").try_cast("double").alias("value")) for c in rest])
    return df.select(F.col(f"`{first}`").alias("row"), F.explode(cells).alias("c")).select("row", "c.*")


def read_state_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(state, parameter, value) of a comma-separated block of a learned model's parameters, states down, numbers from 0.

    A first column without a name is the states' own; without one they count from 0 in the file's order.
    """
    df = spark.read.csv(path, header=True, inferSchema=False)
    first, *rest = df.columns
    if first not in ("_c0", "Unnamed: 0"):
        rest, df = df.columns, df.withColumn("_state", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1)  # a model has tens of states
        first = "_state"
    cells = F.array(*[F.struct(F.lit(c).alias("parameter"), F.col(f"`{c}`").try_cast("double").alias("value")) for c in rest])
    return df.select(F.col(f"`{first}`").cast("int").alias("state"), F.explode(cells).alias("c")).select("state", "c.*")


def state_features(lengths: DataFrame, parameters: DataFrame, scale: bool = True) -> DataFrame:
    """(state, at, x): each state's length statistics (moved to 0 .. 1 over the states with ``scale``) beside its parameters.

    ``lengths``: (state, mean, stdev); ``parameters``: (state, parameter, value).
    """
    long = lengths.select("state", F.explode(F.array(*[F.struct(F.lit(f"length:{c}").alias("at"), F.col(c).cast("double").alias("x")) for c in ("mean", "stdev")])).alias("c")).select("state", "c.*")
    if scale:
        edges = long.groupBy("at").agg(F.min("x").alias("_a"), F.max("x").alias("_b"))
        long = long.join(F.broadcast(edges), "at").select("state", "at", F.coalesce(F.try_divide(F.col("x") - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0)).alias("x"))
    return long.unionByName(parameters.select("state", F.col("parameter").alias("at"), F.col("value").alias("x")))


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(label, segments, mean, bases) of a table of segment sizes with a header."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.select("label", F.col("`num.segs`").cast("long").alias("segments"), F.col("`mean.len`").cast("double").alias("mean"), F.col("`num.bp`").cast("long").alias("bases")).where("label <> 'all'")


def read_aggregation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((label, component, offset, n), (label, bases)) of a feature aggregation: ``# label=bases ...``, names, counts.

    ``offset`` is the place of the line in its component.
    """
    head = spark.read.text(path).limit(2).collect()
    pairs = [x.split("=") for x in head[0]["value"].split()[1:]]
    bases = spark.createDataFrame([(k, int(v)) for k, v in pairs if k not in ("num_features", "spacers")], "label string, bases long")
    first, second, _, *names = head[1]["value"].split("\t")
    schema = "grp string, component string, place string, " + ", ".join(f"c{i} long" for i in range(len(names)))
    lines = spark.read.csv(path, sep="\t", schema=schema, comment="#").where((F.col("grp") != first) | (F.col("component") != second)).withColumn("at", F.monotonically_increasing_id())
    offset = F.row_number().over(Window.partitionBy("component").orderBy("at")) - 1  # a component has some hundred lines
    cells = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"c{i}").alias("n")) for i, x in enumerate(names)])
    placed = lines.withColumn("offset", offset)
    return placed.select("component", "offset", F.explode(cells).alias("c")).select("c.label", "component", "offset", "c.n"), bases


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(run, key, value) of files ``<run>/metadata.tsv`` of two columns below a folder."""
    rows = _tab(spark, f"{path}/*/metadata.tsv", "key string, value string")
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run"), "key", "value")


def track_summary(spark: SparkSession, path: str) -> DataFrame:
    """(cell, experiment, biosample, files): two rows for each track of files ``<cell>/<track>/track_files_metadata.csv``.

    Those tables have a property in each row and a column for each file; ``files`` joins a replicate's alignment and signal.
    """
    df = spark.read.csv(f"{path}/*/*/track_files_metadata.csv", header=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = df.select(F.element_at(parts, -3).alias("cell"), F.element_at(parts, -2).alias("track"), F.col(f"`{df.columns[0]}`").alias("property"), *[F.col(f"`{c}`") for c in df.columns[1:]])
    of = lambda name, c: F.max(F.when(F.col("property") == name, F.col(c)))
    out = []
    for i in (1, 2):
        files = F.concat_ws(", ", of("accession", f"rep{i}_alig"), of("accession", f"rep{i}_fcoc"))
        out.append(rows.groupBy("cell", "track").agg(of("assay", f"rep{i}_alig").alias("experiment"), F.concat(of("biosample", f"rep{i}_alig"), F.lit(f" (rep. {i})")).alias("biosample"), files.alias("files")))
    return out[0].unionByName(out[1]).select("cell", "experiment", "biosample", "files")


def track_assays(spark: SparkSession, path: str) -> DataFrame:
    """(track, assay) of the same tables, as the file that names a run's tracks lists them."""
    df = spark.read.csv(f"{path}/*/track_files_metadata.csv", header=True)
    first, second = df.columns[0], df.columns[1]
    return df.where(F.col(f"`{first}`") == "assay").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("track"), F.col(f"`{second}`").alias("assay"))


def read_metrics(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(setting, model, cell, state, metric, value) of lines ``state|metric = value`` of every run's file of that name.

    Files lie in ``<setting>/<model>/<cell>/``; lines that don't read so, or hold no number, are left out.
    """
    parts = F.split(F.col("_metadata.file_path"), "/")
    places = [F.element_at(parts, at).alias(c) for c, at in (("setting", -4), ("model", -3), ("cell", -2))]
    lines = spark.read.text(f"{path}/*/*/*/{name}").select(*places, F.regexp_extract("value", r"^([^|=]+)\|([^=|]+?)\s*=\s*(\S+)\s*$", 0).alias("all"), *[F.regexp_extract("value", r"^([^|=]+)\|([^=|]+?)\s*=\s*(\S+)\s*$", i).alias(c) for i, c in ((1, "state"), (2, "metric"), (3, "value"))])
    return lines.where(F.col("all") != "").withColumn("value", F.col("value").try_cast("double")).where("value is not null").drop("all")


def read_results(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One report of every run: files ``<setting>/<model>/<cell>/<name>`` below a folder, with those three as columns."""
    df = spark.read.csv(f"{path}/*/*/*/{name}", sep="\t", header=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    places = [F.element_at(parts, at).alias(c) for c, at in (("setting", -4), ("model", -3), ("cell", -2))]
    # the last folder is the file's own where Spark has written it
    return df.select(*places, *[F.col(f"`{c}`") for c in df.columns])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a report is there already, in any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def write_once(df: DataFrame, path: str, header: bool = True) -> bool:
    """Write a report as a tab-separated table unless it is there; whether it was written."""
    if exists(df.sparkSession, path):
        return False
    df.write.csv(path, sep="\t", header=header)
    return True


def write_matrix(matrix: DataFrame, path: str, labels: Sequence[str], value: str = "value") -> None:
    """A label-by-label matrix as one comma-separated table with row names, in the labels' order."""
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("k"))
    wide = matrix.groupBy("k").agg(*[F.max(F.when(F.col("j") == x, F.col(value))).alias(x) for x in labels]).orderBy(at)
    wide.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_merged(pairs: DataFrame, path: str, names: Sequence[str], p: str = "p1") -> None:
    """(chr, start, end, a column for each merged state): posteriors after merging."""
    pairs.select("chr", "start", "end", *[F.col(p)[i].alias(x) for i, x in enumerate(names)]).write.mode("overwrite").csv(path, sep="\t", header=True)


def report_lines(report: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(value): ``key: a, b, ...`` of each row of a report, for a text file."""
    cells = F.concat_ws(", ", *[F.format_string(f"{c} = %s", F.col(c).cast("string")) for c in columns])
    return report.select(F.concat_ws(": ", F.coalesce(F.col(key).cast("string"), F.lit("all")), cells).alias("value"))


def integrated(reports: dict[str, DataFrame], on: Sequence[str]) -> DataFrame:
    """One table of several reports of runs (or of runs and labels), joined on what names them; what a run lacks is null."""
    (_, whole), *rest = reports.items()
    for _, df in rest:
        whole = whole.join(df, list(on), "full")
    return whole
