"""Rows and neighbourhoods: MAP labels, position index, offset joins, distributed ranks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 36.84136
#: Positions of a block, rows of a part of a rank, and cells of a key's range.
BLOCK, PART, CELLS = 8192, 1 << 16, 4096


def map_label(p: str | Column, labels: Sequence[str]) -> Column:
    """The label of the largest posterior; the first among equals; nulls never win."""
    p = F.col(p) if isinstance(p, str) else p
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(p, F.array_max(p)).cast("int"))


def with_map(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    return pairs.withColumn("m1", map_label("p1", labels)).withColumn("m2", map_label("p2", labels))


def clean(p: str | Column) -> Column:
    """NaN posteriors become null, as an arg-max must pass over them."""
    return F.transform(F.col(p) if isinstance(p, str) else p, lambda x: F.when(~F.isnan(x), x))


def logit(p: str | Column) -> Column:
    x = lambda v: F.when(v < 1e-16, F.lit(-EPS)).when(v > 1 - 1e-16, F.lit(EPS)).otherwise(F.ln(v / F.nullif(1 - v, F.lit(0.0))))
    return F.transform(F.col(p) if isinstance(p, str) else p, x)


def sigmoid(p: str | Column) -> Column:
    return F.transform(F.col(p) if isinstance(p, str) else p, lambda v: 1 / (1 + F.exp(-v)))


def normalise(p: str | Column) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.transform(p, lambda x: F.try_divide(x, total))


def merge_labels(p: str | Column, labels: Sequence[str], a: str, b: str) -> tuple[Column, list[str]]:
    """Posteriors in which two labels' are summed into one at the end, and the new labels."""
    p = F.col(p) if isinstance(p, str) else p
    rest = [i for i, x in enumerate(labels) if x not in (a, b)]
    i, j = labels.index(a), labels.index(b)
    return F.array(*[p[r] for r in rest], p[i] + p[j]), [labels[r] for r in rest] + [f"{a}+{b}"]


def position_index(loci: DataFrame, block: int = 1 << 24) -> DataFrame:
    """Add ``idx``: the row's place by chromosome name and start, over the whole table.

    Rows are ranked within stretches of ``block`` base pairs; the stretches' counts give their offsets.
    """
    blocks = loci.withColumn("_block", F.floor(F.col("start") / block))
    counts = blocks.groupBy("chr", "_block").agg(F.count("*").alias("_n"))
    offsets = counts.select("chr", "_block", (F.sum("_n").over(Window.orderBy("chr", "_block")) - F.col("_n")).alias("_offset"))
    inner = F.row_number().over(Window.partitionBy("chr", "_block").orderBy("start", "end")) - 1
    return blocks.withColumn("_in", inner).join(F.broadcast(offsets), ["chr", "_block"]).withColumn("idx", F.col("_offset") + F.col("_in")).drop("_block", "_in", "_offset")


def pair(base: DataFrame, verification: DataFrame) -> DataFrame:
    """Join two posterior tables (chr, start, end, p) on their coordinates and index the rows."""
    both = base.select("chr", "start", "end", F.col("p").alias("p1")).join(verification.select("chr", "start", "end", F.col("p").alias("p2")), ["chr", "start", "end"])
    return position_index(both)


_SIZES: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def size(pairs: DataFrame) -> int:
    """The number of positions; one job for each frame, however many operators ask."""
    if pairs not in _SIZES:
        _SIZES[pairs] = int(pairs.agg(F.max("idx")).first()[0]) + 1
    return _SIZES[pairs]


def small(df: DataFrame) -> DataFrame:
    """The same rows, held by the driver: for frames of label pairs, which are used several times."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def halo(rows: DataFrame, reach: int, block: int = BLOCK) -> DataFrame:
    """Rows dealt to blocks of positions (``_b``), with those of up to ``reach`` positions around each block.

    A window over a block then sees what a row's neighbourhood holds, and one copy of the table moves, but for the edges. Results
    are those of rows with ``_own``.
    """
    at = F.col("idx")
    spread = rows.withColumn("_b", F.explode(F.sequence(F.floor((at - reach) / block), F.floor((at + reach) / block))))
    return spread.withColumn("_own", F.col("_b") == F.floor(at / block))


def by_block() -> WindowSpec:
    return Window.partitionBy("_b").orderBy("idx")


def shown(pairs: DataFrame, value: str, w: int, *keep: str, hide_last: bool = True, n: int | None = None) -> DataFrame:
    """(idx, keep, seen): the distinct values that each row's window shows, offsets -w to w - 1, clipped to the table.

    With ``hide_last`` the table's last position is never shown by a window of any width but 0.
    """
    if w == 0:
        return pairs.select("idx", *keep, F.array_compact(F.array(value)).alias("seen"))
    n = size(pairs) if n is None else n
    dealt = halo(pairs.select("idx", *dict.fromkeys([*keep, value])), w)
    seen = F.when(F.col("idx") < n - 1, F.col(value)) if hide_last else F.col(value)
    found = dealt.withColumn("seen", F.collect_set(seen).over(by_block().rowsBetween(-w, w - 1)))
    return found.where("_own").select("idx", *keep, "seen")


#: Labels that a long holds as bits.
BITS = 62


def shown_bits(pairs: DataFrame, value: str, names: Sequence[str], w: int, *keep: str, hide_last: bool = True, n: int | None = None) -> DataFrame:
    """(idx, keep, seen): as ``shown``, with the values as bits of longs, in the order of ``names`` (see ``shows``); other values have none."""
    at = F.array_position(F.array(*[F.lit(x) for x in names]), F.col(value)).cast("int") - 1
    parts = range(-(-len(names) // BITS))
    numbered = pairs.select("idx", *dict.fromkeys(keep), at.alias("_at"))
    bit = {c: F.when((F.col("_at") >= c * BITS) & (F.col("_at") < (c + 1) * BITS), F.expr(f"shiftleft(1L, _at - {c * BITS})")) for c in parts}
    if w == 0:
        return numbered.select("idx", *keep, F.array(*[F.coalesce(b, F.lit(0).cast("long")) for b in bit.values()]).alias("seen"))
    n = size(pairs) if n is None else n
    here = (F.col("idx") < n - 1) if hide_last else F.lit(True)
    window = by_block().rowsBetween(-w, w - 1)
    found = halo(numbered, w).withColumns({f"_s{c}": F.coalesce(F.bit_or(F.when(here, b)).over(window), F.lit(0).cast("long")) for c, b in bit.items()})
    return found.where("_own").select("idx", *keep, F.array(*[f"_s{c}" for c in parts]).alias("seen"))


def shows(i: int) -> Column:
    """Whether ``seen`` of ``shown_bits`` has the name numbered ``i``."""
    return F.shiftright(F.col("seen")[i // BITS], i % BITS).bitwiseAND(1) == 1


def celled(basis: DataFrame, key: str, by: str, tie: str | None, part: int = PART, cells: int = CELLS) -> tuple[Callable[[DataFrame], DataFrame], list[str]]:
    """A function that adds cells, in order of ``by`` within ``key``, none of them with much more than ``part`` rows; and their names.

    Each key's range is cut into cells of equal width; cells with more rows are cut again by their own range, as often as it takes;
    and a cell of one value is cut into ``part`` positions of ``tie`` each, where there is one. Only facts of cells with more than
    ``part`` rows come to the driver.
    """
    spark = basis.sparkSession
    steps = [basis.groupBy(key).agg(F.min(by).alias("_low"), F.max(by).alias("_high"))]
    steps[0] = spark.createDataFrame(steps[0].collect(), steps[0].schema)
    points: DataFrame | None = None

    def names() -> list[str]:
        return [f"_c{i}" for i in range(len(steps))]

    def place(df: DataFrame) -> DataFrame:
        for i, edges in enumerate(steps):
            df = df.join(F.broadcast(edges), [key, *names()[:i]], "left")
            low, high = F.col("_low").cast("double"), F.col("_high").cast("double")
            at = F.floor(F.try_divide((F.col(by).cast("double") - low) * cells, high - low))
            df = df.withColumn(f"_c{i}", F.when(F.col(by).isNull(), -1).otherwise(F.coalesce(F.least(F.lit(cells - 1), at), F.lit(0))).cast("int")).drop("_low", "_high")
        if points is None:
            return df.withColumn("_sub", F.lit(0).cast("long"))
        return df.join(F.broadcast(points), [key, *names()], "left").withColumn("_sub", F.when(F.col("_point"), F.floor(F.col(tie) / part)).otherwise(0)).drop("_point")

    while True:
        counts = place(basis).groupBy(key, *names()).agg(F.count("*").alias("_n"), F.min(by).alias("_low"), F.max(by).alias("_high"))
        heavy = counts.where(F.col("_n") > part).drop("_n").collect()
        wide = [r for r in heavy if r["_low"] is not None and r["_low"] < r["_high"]]
        if not wide or len(steps) == 12:
            break
        steps.append(spark.createDataFrame(wide, counts.drop("_n").schema))
    single = [r for r in heavy if r["_low"] is None or r["_low"] == r["_high"]]
    if single and tie is not None:
        points = spark.createDataFrame(single, counts.drop("_n").schema).select(key, *names(), F.lit(True).alias("_point"))
    return place, [*names(), "_sub"]


def ranked(rows: DataFrame, key: str, by: str, tie: str, part: int = PART, basis: DataFrame | None = None) -> DataFrame:
    """Add ``pos``: the 0-based rank by (by, tie) within ``key``, without one task for each key, or for each value.

    A row's rank is its cell's offset and its rank within the cell (see ``celled``). ``basis``: the same keys, values and positions
    where they are cheaper to have than ``rows``.
    """
    basis = (rows if basis is None else basis).select(*dict.fromkeys([key, by, tie]))
    place, names = celled(basis, key, by, tie, part)
    counts = place(basis).groupBy(key, *names).agg(F.count("*").alias("_n"))
    offsets = counts.select(key, *names, (F.sum("_n").over(Window.partitionBy(key).orderBy(*names)) - F.col("_n")).alias("_offset"))
    inner = F.row_number().over(Window.partitionBy(key, *names).orderBy(by, tie)) - 1
    return place(rows).withColumn("_in", inner).join(offsets, [key, *names]).withColumn("pos", F.col("_offset") + F.col("_in")).drop(*names, "_in", "_offset")


def islands(rows: DataFrame, new: Column) -> DataFrame:
    """Add ``island``: the number of rows up to here, by idx, at which ``new`` holds; two-level so that blocks run apart.

    ``new`` is a boolean column of each row. Blocks of 65536 positions are summed first; their offsets are few.
    """
    blocks = rows.withColumn("_new", new.cast("long")).withColumn("_block", F.shiftright("idx", 16))
    sums = blocks.groupBy("_block").agg(F.sum("_new").alias("_s"))
    offsets = sums.select("_block", (F.sum("_s").over(Window.orderBy("_block")) - F.col("_s")).alias("_offset"))
    inner = F.sum("_new").over(Window.partitionBy("_block").orderBy("idx"))
    return blocks.withColumn("_in", inner).join(offsets, "_block").withColumn("island", F.col("_offset") + F.col("_in")).drop("_new", "_block", "_in", "_offset")


def previous(rows: DataFrame, *columns: str) -> DataFrame:
    """Add ``prev_<column>`` from the row of the position before, null where there is none."""
    there = F.lag("idx").over(by_block()) == F.col("idx") - 1
    dealt = halo(rows, 1).withColumns({f"prev_{c}": F.when(there, F.lag(c).over(by_block())) for c in columns})
    return dealt.where("_own").drop("_b", "_own")


def position_index_by(rows: DataFrame, order: str, block: int = 65536) -> DataFrame:
    """Add ``idx``: 0-based ranks by a dense integer column of which some values are missing; blocks of it run apart."""
    blocks = rows.withColumn("_block", F.floor(F.col(order) / block))
    counts = blocks.groupBy("_block").agg(F.count("*").alias("_n"))
    offsets = counts.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_offset"))
    inner = F.row_number().over(Window.partitionBy("_block").orderBy(order)) - 1
    return blocks.withColumn("_in", inner).join(offsets, "_block").withColumn("idx", F.col("_offset") + F.col("_in")).drop("_block", "_in", "_offset")
