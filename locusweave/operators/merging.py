"""Merging labels: the best pair, the loop over numbers of labels, linkage, two-way correspondence, likeness of rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .core import map_label
from .labels import group_sums
from .match import merging_gain


def best_pair(gain: np.ndarray) -> tuple[int, int]:
    """The two rows of the largest gain, the first in row-major order among equals; the first two where no pair has a gain.

    Labels without rows have none, as merging them loses nothing.
    """
    i, j = divmod(int(np.argmax(gain)), gain.shape[1])
    return (min(i, j), max(i, j)) if i != j else (0, 1)


def merged(groups: Sequence[Sequence[int]], pair: tuple[int, int]) -> list[list[int]]:
    """Groups of label numbers with two of them as one, at the end."""
    rest = [list(g) for i, g in enumerate(groups) if i not in pair]
    return [*rest, [*groups[pair[0]], *groups[pair[1]]]]


def group_names(groups: Sequence[Sequence[int]], labels: Sequence[str]) -> list[str]:
    return ["+".join(labels[i] for i in g) for g in groups]


def grouped(pairs: DataFrame, labels: Sequence[str], one: Sequence[Sequence[int]], two: Sequence[Sequence[int]]) -> DataFrame:
    """The rows with posteriors summed by groups of labels, and MAP labels of those."""
    summed = pairs.withColumns({"p1": group_sums("p1", one), "p2": group_sums("p2", two)})
    return summed.withColumns({"m1": map_label("p1", group_names(one, labels)), "m2": map_label("p2", group_names(two, labels))})


def cells(pairs: DataFrame, one: Sequence[str], two: Sequence[str]) -> np.ndarray:
    """Shares of rows by both tracks' labels, on the driver: as many cells as pairs of labels."""
    return shares(pairs.groupBy("m1", "m2").agg(F.count("*").alias("n")).collect(), one, two)


def shares(counts: Sequence[Row], one: Sequence[str], two: Sequence[str]) -> np.ndarray:
    """Cells of counts (m1, m2, n)."""
    at, to = ({x: i for i, x in enumerate(names)} for names in (one, two))
    out = np.zeros((len(one), len(two)))
    for r in counts:
        if r["m1"] in at and r["m2"] in to:
            out[at[r["m1"]], to[r["m2"]]] = r["n"]
    return out / max(1.0, out.sum())


def facts(joint: np.ndarray) -> tuple[float, float, float, float]:
    """Entropy of rows, mutual information, its share of the entropy of columns, and the sum of each row's largest cell."""
    r, c = joint.sum(1), joint.sum(0)
    entropy = lambda x: float(-(x[x > 0] * np.log2(x[x > 0])).sum())
    seen = joint > 0
    mi = float((joint[seen] * np.log2(joint[seen] / np.outer(r, c)[seen])).sum())
    return entropy(r), mi, mi / entropy(c) if entropy(c) else 0.0, float(joint.max(1).sum())


def merge_progress(pairs: DataFrame, labels: Sequence[str], down_to: int = 2) -> tuple[list[tuple], list[list[int]], list[list[int]]]:
    """(labels, entropy, mi, nmi, naive) for each number of labels down to ``down_to``, and the groups of both tracks in the end.

    Each step merges the best pair of the base track, and that of the other by the same joint matrix. A step is one aggregation of
    the table to label-by-label counts.
    """
    one = two = [[i] for i in range(len(labels))]
    progress = []
    while True:
        joint = cells(grouped(pairs, labels, one, two), group_names(one, labels), group_names(two, labels))
        progress.append((len(one), *facts(joint)))
        if len(one) <= max(2, down_to):
            return progress, one, two
        one, two = merged(one, best_pair(merging_gain(joint))), merged(two, best_pair(merging_gain(joint.T)))


def keep_states(pairs: DataFrame, labels: Sequence[str], k: int) -> DataFrame:
    """The rows with labels merged, in both tracks, until ``k`` are left."""
    _, one, two = merge_progress(pairs, labels, k)
    return grouped(pairs, labels, one, two)


def linkage(distance: np.ndarray, method: str = "average") -> list[tuple[int, int, float]]:
    """Merges (cluster, cluster, distance) in order by average, complete or Ward's linkage; new clusters are numbered from K on."""
    d = np.array(distance, float)
    np.fill_diagonal(d, np.inf)
    ids, sizes, out = list(range(len(d))), [1] * len(d), []
    while len(ids) > 1:
        i, j = sorted(divmod(int(np.argmin(d)), len(ids)))
        near, a, b = float(d[i, j]), sizes[i], sizes[j]
        out.append((ids[i], ids[j], near))
        c = np.asarray(sizes, float)
        if method == "complete":
            row = np.maximum(d[i], d[j])
        elif method == "ward":
            row = np.sqrt(((a + c) * d[i] ** 2 + (b + c) * d[j] ** 2 - c * near**2) / (a + b + c))
        else:
            row = (a * d[i] + b * d[j]) / (a + b)
        keep = [x for x in range(len(ids)) if x not in (i, j)]
        d = np.pad(d[np.ix_(keep, keep)], (0, 1), constant_values=np.inf)
        d[-1, :-1] = d[:-1, -1] = row[keep]
        ids, sizes = [*(ids[x] for x in keep), len(distance) + len(out) - 1], [*(sizes[x] for x in keep), a + b]
    return out


def cut(merges: Sequence[tuple[int, int, float]], count: int, k: int) -> list[list[int]]:
    """Groups of ``count`` labels after all but the last ``k - 1`` merges."""
    groups = {i: [i] for i in range(count)}
    for n, (a, b, _) in enumerate(merges[: max(0, count - k)]):
        groups[count + n] = groups.pop(a) + groups.pop(b)
    return list(groups.values())


def k_means(points: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Cluster numbers of a few points (states by their parameters) by Lloyd's steps, until none moves.

    The first centre is the point farthest from the mean, each next one the point farthest from its nearest centre, the first among equals; clusters
    are numbered by their first points. A centre that loses all its points takes the point farthest from its own. The fewest of k and the different points are made.
    """
    x = np.asarray(points, float)
    k = min(k, len(np.unique(x, axis=0)))
    if not k:
        return np.zeros(0, int)
    apart = lambda c: ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
    chosen = [int(apart(x.mean(0, keepdims=True))[:, 0].argmax())]
    while len(chosen) < k:
        chosen.append(int(apart(x[chosen]).min(1).argmax()))
    centres, own = x[chosen], np.full(len(x), -1)
    for _ in range(rounds):
        d = apart(centres)
        nearest = d.argmin(1)
        for c in range(k):
            if not (nearest == c).any():
                nearest[int(np.where(np.bincount(nearest, minlength=k)[nearest] > 1, d[np.arange(len(x)), nearest], -1.0).argmax())] = c
        if (nearest == own).all():
            break
        own = nearest
        centres = np.stack([x[own == c].mean(0) for c in range(k)])
    order = np.unique(own, return_index=True)
    rank = np.empty(k, int)
    rank[order[0][np.argsort(order[1])]] = np.arange(k)
    return rank[own]


def clusters(features: DataFrame, k: int, method: str = "kmeans") -> DataFrame:
    """(label, cluster) of states by their (label, at, x) parameters: k-means, or hierarchical by ``average``, ``complete`` or ``ward``.

    One row a state comes to the driver. Parameters that a state lacks count as zero.
    """
    table = features.groupBy("label").pivot("at").agg(F.first("x")).na.fill(0.0).toPandas().sort_values("label")
    points = table.drop(columns="label").to_numpy(float)
    if method == "kmeans":
        found = k_means(points, k).tolist()
    else:
        groups = sorted(cut(linkage(np.sqrt(((points[:, None] - points[None]) ** 2).sum(2)), method), len(points), k), key=min)
        found = [next(c for c, g in enumerate(groups) if i in g) for i in range(len(points))]
    rows = [(label, int(c)) for label, c in zip(table["label"].tolist(), found, strict=True)]
    return features.sparkSession.createDataFrame(rows, f"label {features.schema['label'].dataType.simpleString()}, cluster int")


def row_similarity(iou: np.ndarray) -> np.ndarray:
    """How much two labels share a partner: sqrt of the largest product of their cells; 1 on the diagonal."""
    out = np.sqrt((np.nan_to_num(iou)[:, None, :] * np.nan_to_num(iou)[None, :, :]).max(2))
    np.fill_diagonal(out, 1)
    return out


def dynamic_matches(forward: dict[str, list[str]], backward: dict[str, list[str]]) -> dict[str, list[str]]:
    """Each label's partners by both directions' matches: those that agree both ways, else those of either way."""
    out = {}
    for k, js in forward.items():
        other = [j for j, ks in backward.items() if k in ks]
        out[k] = [j for j in js if j in other] or [*js, *(j for j in other if j not in js)]
    return out


def scaled_features(means: DataFrame) -> DataFrame:
    """(label, at, x): each component moved to 0 .. 1 over the labels; null where they are all equal."""
    edges = means.groupBy("at").agg(F.min("x").alias("_low"), F.max("x").alias("_high"))
    return means.join(F.broadcast(edges), "at").select("label", "at", F.try_divide(F.col("x") - F.col("_low"), F.col("_high") - F.col("_low")).alias("x"))
