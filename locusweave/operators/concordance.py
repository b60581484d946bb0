"""Kendall's rank correlation without any pair of rows: inversions within blocks and between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def discordant(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Summed products of weights of the pairs with x and y strictly in opposite order, by merging halves."""
    order = np.lexsort((y, x))
    value, w = np.unique(y[order], return_inverse=True)[1].astype(np.int64), w[order].astype(np.int64)
    n, top, at, total, half = len(w), len(w) + 1, np.arange(len(w)), 0, 1
    while half < n:
        block, right = at // (2 * half), at // half % 2 == 1
        key = block * top + value
        left = np.argsort(key[~right], kind="stable")
        keys, upto = key[~right][left], np.concatenate(([0], np.cumsum(w[~right][left])))
        above = upto[np.searchsorted(keys, (block[right] + 1) * top)] - upto[np.searchsorted(keys, key[right], "right")]
        total += int(np.dot(w[right], above)) if w.sum() ** 2 < 2**62 else int(np.dot(w[right].astype(float), above.astype(float)))
        half *= 2
    return total


def between(bx: np.ndarray, by: np.ndarray, w: np.ndarray) -> float:
    """The same for cells of a grid, of pairs in different rows and different columns of it."""
    grid = np.zeros((bx.max() + 1, by.max() + 1))
    np.add.at(grid, (bx, by), w)
    below = np.zeros_like(grid)  # what lies in later rows and earlier columns
    later = np.cumsum(grid[::-1], axis=0)[::-1]
    below[:-1, 1:] = np.cumsum(later[1:, :-1], axis=1)
    return float((grid * below).sum())


def kendall(rows: DataFrame, key: str, x: str, y: str, blocks: int = 256) -> DataFrame:
    """(key, n, discordant, tau): Kendall's tau-b of each of a few keys; null where one side has no two values.

    Equal rows are counted first. Quantiles cut each side into about ``blocks`` ranges, and every value that is an edge is a block of its own, so
    a value that many rows share makes no block large. A discordant pair lies in one block of x, or in one of y and two of x, or
    is told by the grid of blocks: the first two are counted block by block (a block holds about a ``blocks``-th of a key's different
    points), the last from the grid's counts. Rows with a null or NaN on either side are left out.
    """
    number = lambda c: F.col(c).cast("double")
    own = rows.select(key, number(x).alias("x"), number(y).alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    at = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    cuts = own.groupBy(key).agg(F.percentile_approx("x", at, 8 * blocks).alias("x"), F.percentile_approx("y", at, 8 * blocks).alias("y"))
    edges = {r[key]: (np.unique(r["x"]), np.unique(r["y"])) for r in cuts.collect()}
    kind = own.schema[key].dataType.simpleString()

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k, group in part.groupby(key, dropna=False):
                cut = edges[None if pd.isna(k) else k]
                found = {}
                for name, edge in zip("xy", cut, strict=True):
                    v = group[name].to_numpy()
                    low = np.searchsorted(edge, v)
                    found[f"b{name}"] = 2 * low + (edge[np.minimum(low, len(edge) - 1)] == v)
                yield group.assign(**found)

    points = own.groupBy(key, "x", "y").agg(F.count("*").alias("w"))
    placed = points.mapInPandas(place, f"`{key}` {kind}, x double, y double, w long, bx int, by int")

    def counted(one: str, two: str, block: str):
        def count(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({key: [part[key].iloc[0]], "d": [float(discordant(part[one].to_numpy(), part[two].to_numpy(), part["w"].to_numpy()))]})

        return placed.where(F.col(block) % 2 == 0).groupBy(key, block).applyInPandas(count, f"`{key}` {kind}, d double")

    def of_grid(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [part[key].iloc[0]], "d": [between(part["bx"].to_numpy(), part["by"].to_numpy(), part["w"].to_numpy())]})

    grid = placed.groupBy(key, "bx", "by").agg(F.sum("w").alias("w")).groupBy(key).applyInPandas(of_grid, f"`{key}` {kind}, d double")
    against = counted("x", "y", "bx").unionByName(counted("bx", "y", "by")).unionByName(grid).groupBy(key).agg(F.sum("d").alias("discordant"))
    couples = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    ties = [points.groupBy(key, c).agg(F.sum("w").alias("w")).groupBy(key).agg(couples("w").alias(f"t{c}")) for c in "xy"]
    facts = points.groupBy(key).agg(F.sum("w").alias("n"), couples("w").alias("both"))
    for other in (*ties, against):
        facts = facts.withColumnRenamed(key, "_k").join(F.broadcast(other), F.col("_k").eqNullSafe(F.col(key))).drop("_k")
    every = F.col("n").cast("double") * (F.col("n") - 1) / 2
    apart = every - F.col("tx") - F.col("ty") + F.col("both") - 2 * F.col("discordant")
    tau = F.try_divide(apart, F.sqrt(every - F.col("tx")) * F.sqrt(every - F.col("ty")))
    return facts.select(key, "n", F.col("discordant").cast("long").alias("discordant"), tau.alias("tau"))
