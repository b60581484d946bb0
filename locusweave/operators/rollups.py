"""Roll-ups over a tree of runs (setting, model, cell) and their states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = ("setting", "model", "cell")


def run_totals(states: DataFrame, values: Sequence[str], weight: str) -> DataFrame:
    """(setting, model, cell, values): of each run the sum over its states of every value times the state's weight.

    With coverages as weights, areas under granularity curves become the run's one area.
    """
    return states.groupBy(*RUN).agg(*[F.sum(F.col(v) * F.col(weight)).alias(v) for v in values])


def levels(rows: DataFrame, sets: Sequence[Sequence[str]], values: dict[str, Column]) -> DataFrame:
    """Aggregates at several levels from one pass: grouping sets over the columns that occur in them; ``n`` counts rows.

    A level's columns that it doesn't group by are null, and ``level`` is its number in ``sets``.
    """
    names = list(dict.fromkeys(c for s in sets for c in s))
    masks = [sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in s) for s in sets]
    found = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(F.grouping_id(*names).alias("_mask"), F.count("*").alias("n"), *[v.alias(c) for c, v in values.items()])
    number = F.create_map(*[F.lit(x) for i, m in enumerate(masks) for x in (m, i)])[F.col("_mask").cast("int")]
    return found.select(number.alias("level"), *names, "n", *values)


def state_metrics(metrics: DataFrame, names: dict[str, str]) -> DataFrame:
    """(setting, model, cell, state, a column for each metric) from (..., state, metric, value) rows.

    ``names`` gives each metric's column. Runs whose metrics aren't there for the same states are left out, as their files don't
    belong together. Of repeated lines the largest value counts.
    """
    wide = metrics.where(F.col("metric").isin(list(names))).groupBy(*RUN, "state").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(c) for m, c in names.items()])
    whole = F.min(sum((F.col(c).isNotNull().cast("int") for c in names.values()), F.lit(0))).over(Window.partitionBy(*RUN))  # a run has tens of states
    return wide.withColumn("_whole", whole).where(F.col("_whole") == len(names)).drop("_whole")


def minus_log_p(p: str | Column) -> Column:
    """-ln(p + 1e-19): zero p-values stay finite."""
    return -F.ln((F.col(p) if isinstance(p, str) else p) + 1e-19)


def in_order(rows: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Add ``place``: where a name stands in a report's order of settings; names that aren't in it come after, by alphabet.

    The distinct names are few; the rows keep their places in whatever partitions they lie.
    """
    known = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)]) if names else F.create_map().cast("map<string,int>")
    rest = rows.select(F.col(column).alias("_n")).where(F.col(column).isNotNull()).distinct().where(known[F.col("_n")].isNull())
    rest = rest.select("_n", (F.row_number().over(Window.orderBy("_n")) - 1 + len(names)).alias("_p"))
    return rows.join(F.broadcast(rest), F.col(column) == F.col("_n"), "left").withColumn("place", F.coalesce(known[F.col(column)], "_p")).drop("_n", "_p")
