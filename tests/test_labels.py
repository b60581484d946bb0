"""Labels, merging and rank statistics against plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from locusweave.operators import labels, match, merging, statistics
from pyspark.sql import functions as F

LABELS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def pairs(spark):
    r = np.random.default_rng(11)
    base = r.dirichlet(np.ones(4), 300)
    other = 0.6 * base + 0.4 * r.dirichlet(np.ones(4), 300)
    name = lambda p: LABELS[int(np.argmax(p))]
    rows = [(i, [float(x) for x in p], [float(x) for x in q], name(p), name(q)) for i, (p, q) in enumerate(zip(base, other, strict=True))]
    return spark.createDataFrame(rows, "idx long, p1 array<double>, p2 array<double>, m1 string, m2 string"), base, other


def test_names():
    assert labels.mnemonic_names(4, ["0_Promoter_Low_x", "1_Enhancer", "2_Quies_Lowest", "7"]) == ["0_Unkn", "1_Enha", "2_Quie_Low", "3_Unkn"]
    assert labels.ordered(["0_Quie", "1_Prom", "2_Prom"], ["Prom", "Quie"]) == ["1_Prom", "2_Prom", "0_Quie"]
    assert labels.ordered(["0_Quie", "1_Else"], ["Prom", "Quie"]) == ["0_Quie", "1_Else"]
    assert labels.paired_names([("a", "x"), ("b", "y")]) == ({"a": "a|x", "b": "b|y"}, {"x": "a|x", "y": "b|y"})
    assert labels.term_of("3_EnhWk+1_Enh", ["Enh", "EnhWk", "Tss"]) == "EnhWk+Enh" and labels.term_of("None", ["Enh"]) == "None"


def test_posterior_forms(spark):
    df = spark.createDataFrame([(0, "chr1", [0.5, 0.5, 0.0]), (150, "chrM", [0.0, 1.0, None]), (200, "chr2_random", [0.2, float("nan"), 0.8])], "idx long, chr string, p1 array<double>")
    got = df.select(labels.hardened("p1")[0], labels.hardened("p1")[1], labels.group_sums("p1", [[2, 0], [1]])[0], labels.arranged("p1", ["a", "b", "c"], ["c", "a", "b"])[0]).collect()
    assert tuple(got[0]) == (1.0, 0.0, 0.5, 0.0)
    assert [x.idx for x in labels.clean_contigs(df).collect()] == [0] and [x.idx for x in labels.each_hundredth(df).collect()] == [0, 200]
    both = df.withColumn("p2", F.col("p1"))
    assert [x.idx for x in labels.complete(both).collect()] == [0] and [x.idx for x in labels.without_overconfident(both.limit(2)).collect()] == [0]
    assert sorted(x.chr for x in labels.concatenated(df, df).collect()) == sorted(x + s for x in ("chr1", "chrM", "chr2_random") for s in ("_1", "_2"))
    assert df.limit(1).select(labels.capped("p1", 0.1).alias("p")).first().p == [0.5, 0.5, 0.1]


def test_merge_loop(pairs):
    """Every step against posteriors summed in numpy, and merging gains computed pair by pair."""
    df, base, other = pairs
    one, two = [[i] for i in range(4)], [[i] for i in range(4)]
    progress, last1, last2 = merging.merge_progress(df, LABELS)
    for count, entropy, mi, nmi, naive in progress:
        assert count == len(one) == len(two)
        a, b = (np.argmax(np.stack([p[:, g].sum(1) for g in groups], 1), 1) for p, groups in ((base, one), (other, two)))
        joint = np.zeros((count, count))
        np.add.at(joint, (a, b), 1 / 300)
        h = lambda x: -sum(v * math.log2(v) for v in x if v > 0)
        assert entropy == pytest.approx(h(joint.sum(1))) and naive == pytest.approx(joint.max(1).sum())
        assert mi == pytest.approx(h(joint.sum(1)) + h(joint.sum(0)) - h(joint.ravel())) and nmi == pytest.approx(mi / h(joint.sum(0)))
        if count > 2:
            best = [merging.best_pair(match.merging_gain(m)) for m in (joint, joint.T)]
            one, two = merging.merged(one, best[0]), merging.merged(two, best[1])
    assert (one, two) == (last1, last2) and [p[0] for p in progress] == [4, 3, 2]
    kept = merging.keep_states(df, LABELS, 3)
    assert {len(x.p1) for x in kept.collect()} == {3}


def test_merging_gain_pairwise():
    r = np.random.default_rng(5)
    joint = r.random((4, 4))
    joint /= joint.sum()

    def facts(m):
        row, col = m.sum(1), m.sum(0)
        return sum(m[i, j] * math.log2(m[i, j] / (row[i] * col[j])) for i in range(len(m)) for j in range(4)), -sum(x * math.log2(x + 1e-9) for x in row)

    mi0, h0 = facts(joint)
    gain = match.merging_gain(joint)
    for a in range(4):
        for b in range(4):
            if a != b:
                mi1, h1 = facts(np.vstack([joint[[i for i in range(4) if i not in (a, b)]], joint[a] + joint[b]]))
                assert gain[a, b] == pytest.approx(1 - (mi1 - mi0) / (h1 - h0))
    assert merging.best_pair(np.array([[-1.0, 2.0, 0.0], [2.0, -1.0, 2.0], [0.0, 2.0, -1.0]])) == (0, 1)


@pytest.mark.parametrize("method", ["average", "complete", "ward"])
def test_linkage(method):
    """Distances of clusters from their points, in every merge."""
    x = np.random.default_rng(2).normal(size=(7, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    members = {i: [i] for i in range(7)}

    def between(a, b):
        p, q = members[a], members[b]
        if method == "ward":
            return math.sqrt(2 * len(p) * len(q) / (len(p) + len(q))) * float(np.linalg.norm(x[p].mean(0) - x[q].mean(0)))
        cells = d[np.ix_(p, q)]
        return float(cells.max() if method == "complete" else cells.mean())

    merges = merging.linkage(d, method)
    for n, (a, b, near) in enumerate(merges):
        assert near == pytest.approx(between(a, b)) == pytest.approx(min(between(p, q) for p in members for q in members if p < q))
        members[7 + n] = members.pop(a) + members.pop(b)
    assert sorted(map(len, merging.cut(merges, 7, 7))) == [1] * 7 and len(merging.cut(merges, 7, 3)) == 3
    assert sorted(i for g in merging.cut(merges, 7, 2) for i in g) == list(range(7))


def test_matches_and_likeness():
    assert merging.dynamic_matches({"a": ["x", "y"], "b": ["z"]}, {"x": ["a"], "y": ["b"], "z": []}) == {"a": ["x"], "b": ["z", "y"]}
    iou = np.array([[0.5, 0.1], [0.2, 0.4]])
    assert np.allclose(merging.row_similarity(iou), [[1, math.sqrt(0.1)], [math.sqrt(0.1), 1]])


def test_rank_statistics(spark):
    r = np.random.default_rng(3)
    rows = [(i % 2, float(r.integers(0, 9)), float(r.integers(0, 9)), float(r.integers(-4, 5))) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, x double, y double, d double")
    rank = lambda v: np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
    for row in statistics.spearman(df, "k", "x", "y").collect():
        own = [x for x in rows if x[0] == row.k]
        assert row.n == 100 and row.spearman == pytest.approx(np.corrcoef(rank(np.array([x[1] for x in own])), rank(np.array([x[2] for x in own])))[0, 1])
    for row in statistics.signed_rank(df, "k", "d").collect():
        d = np.array([x[3] for x in rows if x[0] == row.k and x[3]])
        w, n = rank(np.abs(d))[d > 0].sum(), len(d)
        z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
        assert (row.n, row.w) == (n, w) and row.z == pytest.approx(z) and row.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6)


def test_pairs_and_windows(spark):
    sets = [["x", "y", "x"], ["y", "x", "z"], ["z"], [], ["z", "y"], ["y", "z"]]
    top = statistics.frequent_pair(spark.createDataFrame([(s,) for s in sets], "items array<string>"), "items").first()
    counts = Counter(p for s in sets for p in {(a, b) for a in s for b in s if a < b})
    assert (top.a, top.b, top.n) == min(((*p, n) for p, n in counts.items()), key=lambda x: (-x[2], x[0], x[1]))
    raw = spark.createDataFrame([("l", "up", i, 1) for i in range(10)], "label string, component string, offset int, n int")
    assert [x.component for x in statistics.flank_parts(raw).orderBy("offset").collect()] == ["up:start", *["up"] * 8, "up:end"]
