"""Small fixtures against plain loops."""

import numpy as np
import pytest
from locusweave.operators import calibrate, core, match, overlap, ranges, spatial
from locusweave.sources import tracks
from pyspark.sql import functions as F

LABELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def track(spark):
    r = np.random.default_rng(1)
    p1 = np.round(r.dirichlet([1, 1, 1], 300), 2)
    p2 = np.round(0.6 * p1 + 0.4 * r.dirichlet([1, 1, 1], 300), 2)
    rows = [(i, f"chr{1 + i // 200}", (i % 200) * 200, (i % 200) * 200 + 200, p1[i].tolist(), p2[i].tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "idx long, chr string, start long, end long, p1 array<double>, p2 array<double>")
    m1, m2 = [[LABELS[int(np.argmax(x))] for x in p] for p in (p1, p2)]
    return core.with_map(df, LABELS).cache(), p1, p2, m1, m2


def window(m, i, w):
    n = len(m)
    return m[max(0, i - w) : min(i + w, n - 1)] if w else [m[i]]


def test_map_takes_the_first_of_equals_and_passes_over_nan(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0],), ([float("nan"), 0.2, 0.1],), ([None, 0.1, 0.3],)], "p array<double>")
    assert [r[0] for r in df.select(core.map_label(core.clean("p"), LABELS)).collect()] == ["a", "b", "c"]


@pytest.mark.parametrize("w", [0, 1, 4])
@pytest.mark.parametrize("symmetric", [False, True])
def test_joint(track, w, symmetric):
    df, _, _, m1, m2 = track
    n, want = len(m1), {}
    for i in range(n):
        if w == 0 or not symmetric:
            for j in set(window(m2, i, w)):
                want[m1[i], j] = want.get((m1[i], j), 0) + 1 / n
        else:
            a, b = window(m1, i, w), window(m2, i, w)
            for x in a:
                for y in b:
                    want[x, y] = want.get((x, y), 0) + 1 / (len(a) * len(b) * n)
    got = {(r.k, r.j): r.joint for r in overlap.joint(df, LABELS, w, symmetric).collect()}
    assert len(got) == 9
    for cell, v in got.items():
        assert v == pytest.approx(want.get(cell, 0), abs=1e-12)


def test_identical_tracks(track):
    df = track[0].withColumn("m2", F.col("m1"))
    cells = {(r.k, r.j): r.value for r in overlap.overlap(df, LABELS).collect()}
    assert all(v == pytest.approx(float(k == j)) for (k, j), v in cells.items())
    assert overlap.information(overlap.joint(df, LABELS)).first().nmi == pytest.approx(1)


def test_r_values(track):
    df, p1, _, m1, m2 = track
    w, bins, n = 3, 20, len(m1)
    matches = calibrate.matches_of(df, LABELS, w, 0.5)
    want = np.zeros(n)
    for k, label in enumerate(LABELS):
        hit = np.array([bool(set(window(m2, i, w)) & set(matches[label])) for i in range(n)], float)
        order = sorted(range(n), key=lambda i: (p1[i, k], i))
        s = max(1, n // bins)
        x, y = zip(*[((p1[c[0], k] + p1[c[-1], k]) / 2, hit[c].mean()) for c in (order[b : b + s] for b in range(0, n, s))], strict=True)
        u = sorted(set(x))
        mean = [np.mean([b for a, b in zip(x, y, strict=True) if a == v]) for v in u]
        weight = [sum(a == v for a in x) for v in u]
        f = [max(min(np.average(mean[a : b + 1], weights=weight[a : b + 1]) for b in range(i, len(u))) for a in range(i + 1)) for i in range(len(u))]
        own = [i for i in range(n) if m1[i] == label]
        want[own] = np.interp(p1[own, k], u, f)
    got = {r.idx: r.r_value for r in calibrate.r_values(df, LABELS, w, 0.5, bins).collect()}
    assert np.allclose([got[i] for i in range(n)], want, atol=1e-9)


def test_segments_cover_the_track(track):
    df, _, _, m1, _ = track
    rows = spatial.segments(df).orderBy("chr", "start").collect()
    again = [r.label for r in rows for _ in range((r.end - r.start) // 200)]
    assert again == m1 and sum(r.n for r in rows) == len(m1)


def test_nearest(track):
    df, _, _, m1, m2 = track
    matches = {"a": ["a"], "b": ["b", "c"], "c": []}
    got = {r.idx: r.distance for r in spatial.nearest(df, matches, 6).collect()}
    for i in range(len(m1)):
        found = None
        for d in range(7):
            if i + d < len(m2) and m2[i + d] in matches[m1[i]]:
                found = d
            elif i - d >= 0 and m2[i - d] in matches[m1[i]]:
                found = -d
            if found is not None:
                break
        assert got[i] == found


def test_ranks_with_ties(spark):
    rows = [(i % 2, (i * 7 % 5) / 4, i) for i in range(100)]
    got = {r.i: r.pos for r in core.ranked(spark.createDataFrame(rows, "k int, p double, i int"), "k", "p", "i", part=3).collect()}
    for k in (0, 1):
        for at, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))):
            assert got[i] == at


@pytest.mark.parametrize("kind", ["ties", "piled", "nulls"])
def test_ranks_of_piled_values(spark, kind):
    """Nine tenths of the rows at one value, or within a millionth of the range: no cell holds more than an eighth of the rows."""
    r = np.random.default_rng(6)
    values = {"ties": lambda i: 1.0 if i % 10 else float(r.random()), "piled": lambda i: float(r.random()) * (1e-6 if i % 10 else 1.0), "nulls": lambda i: None if i % 10 else float(r.random())}[kind]
    rows = [(0, values(i), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, p double, i long")
    place, names = core.celled(df, "k", "p", "i", part=500)
    assert place(df).groupBy(*names).count().agg({"count": "max"}).first()[0] <= 500
    got = {x.i: x.pos for x in core.ranked(df, "k", "p", "i", part=500).collect()}
    assert [got[i] for _, _, i in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0.0, x[2]))] == list(range(4000))


def test_position_index_over_blocks(spark):
    rows = sorted({(f"chr{1 + i % 3}", i * 7919 % 100_000, i * 7919 % 100_000 + 5) for i in range(500)})
    got = core.position_index(spark.createDataFrame(rows[::-1], "chr string, start long, end long"), block=4096).orderBy("idx").collect()
    assert [(x.idx, x.chr, x.start, x.end) for x in got] == [(i, *x) for i, x in enumerate(rows)]


def test_windows_across_blocks(spark, monkeypatch):
    """Blocks with halos against plain slices, with blocks of a few rows."""
    monkeypatch.setattr(core.halo, "__defaults__", (4,))
    r = np.random.default_rng(8)
    m1, m2 = (["abc"[i] for i in r.integers(0, 3, 50)] for _ in range(2))
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(m1, m2, strict=True))], "idx long, m1 string, m2 string")
    for w in (0, 1, 3, 9):
        got = {x.idx: set(x.seen) for x in core.shown(df, "m2", w).collect()}
        assert got == {i: set(m2[max(0, i - w) : min(i + w, 49)]) if w else {m2[i]} for i in range(50)}
    matches = {"a": ["a"], "b": ["b", "c"], "c": []}
    for x in spatial.sides(df, matches, 6).collect():
        left = next((d for d in range(1, 7) if x.idx - d >= 0 and m2[x.idx - d] in matches[x.m1]), None)
        right = next((d for d in range(7) if x.idx + d < 50 and m2[x.idx + d] in matches[x.m1]), None)
        assert (x.left, x.right) == (left, right)
    for both in (False, True):
        got = {(x.m1, x.d): x.share for x in spatial.correspondence_by_offset(df, matches, 5, both).collect()}
        for k in "abc":
            for d in range(6):
                hit = [(all if both else any)(m2[min(49, max(0, i + s * d))] in matches[k] for s in (-1, 1)) for i in range(50) if m1[i] == k]
                assert got[k, d] == pytest.approx(np.mean(hit))
    before = {x.idx: x.prev_m1 for x in core.previous(df, "m1").collect()}
    assert before == {i: m1[i - 1] if i else None for i in range(50)}


def test_interval_joins(spark):
    r = np.random.default_rng(2)
    def make(n):
        return [("c" + str(r.integers(2)), int(s), int(s + r.integers(1, 40))) for s in r.integers(0, 300, n)]
    a, b = sorted(set(make(80))), sorted(set(make(40)))
    one, two = spark.createDataFrame(a, "chr string, start long, end long"), spark.createDataFrame(b, "chr string, start long, end long")
    want = sorted((x, y) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    got = sorted(((x.chr, x.start, x.end), (x.b_chr, x.b_start, x.b_end)) for x in ranges.overlap_join(one, two, width=16).collect())
    assert got == want
    left = sorted(tuple(x) for x in ranges.overlap_join(one, two, "left_anti", width=16).collect())
    assert left == sorted(set(a) - {x for x, _ in want})


def test_assignment_is_optimal():
    from itertools import permutations

    r = np.random.default_rng(3)
    for _ in range(20):
        m = r.random((4, 5))
        best = max(sum(m[i, p[i]] for i in range(4)) for p in permutations(range(5), 4))
        assert sum(m[i, j] for i, j in match.assignment(m)) == pytest.approx(best)


def test_isotonic_is_monotone_and_keeps_the_mean():
    r = np.random.default_rng(4)
    x = r.integers(0, 30, 200).astype(float)
    y = r.random(200)
    u, f = calibrate.isotonic(np.sort(x), y)
    assert (np.diff(f) >= -1e-12).all() and len(u) == len(f)


def test_readers(spark, tmp_path):
    (tmp_path / "x.bed").write_text("chr\tstart\tend\tposterior0\tposterior1\nchr1_1\t0\t200\t0.25\t0.75\n")
    df, labels = tracks.read_posterior(spark, str(tmp_path / "x.bed"))
    assert labels == ["posterior0", "posterior1"] and [tuple(r) for r in df.collect()] == [("chr1", 0, 200, [0.25, 0.75])]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "cell_2_chr7_posterior.txt").write_text("cell\tchr7\nE1\tE2\n0.5\t0.5\n1\t0\n")
    assert [tuple(r) for r in tracks.read_state_directory(spark, str(tmp_path / "d")).orderBy("start").collect()] == [("chr7", 0, 200, [0.5, 0.5]), ("chr7", 200, 400, [1.0, 0.0])]
    (tmp_path / "posterior0.bedGraph").write_text("track name\nchr1\t0\t500\t50\n")
    cut = tracks.split_bins(tracks.read_bedgraph(spark, str(tmp_path / "posterior0.bedGraph")), 200).orderBy("start").collect()
    assert [(r.start, r.end, r.value) for r in cut] == [(0, 200, 0.5), (200, 400, 0.5), (400, 500, 0.5)]
    sizes = spark.createDataFrame([("chr1", 450)], "chr string, size long")
    assert [(r.start, r.end) for r in tracks.bins_of_sizes(sizes, 200).orderBy("start").collect()] == [(0, 200), (200, 400), (400, 450)]
    (tmp_path / "m.txt").write_text("old\tnew\n1\tPromoter_flanking\n2\tQuiescent\n")
    assert tracks.read_mnemonics(spark, str(tmp_path / "m.txt")) == {0: "Promoter_flanking", 1: "Quiescent"}


def test_every_order_is_an_interval(spark, tmp_path):
    from locusweave.plans.adapters import intervals

    spark.range(1, 41).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    got = {(x.rid, x.chr, x.start, x.end) for x in intervals(spark, str(tmp_path)).collect()}
    assert got == {(k, f"chr{1 + k % 3}", k * 7919 % 780000, k * 7919 % 780000 + 100 + k % 17 * 90) for k in range(1, 41)}


@pytest.mark.parametrize("name", ["logit_posterior", "corr_curve"])
def test_every_label_as_in_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from locusweave import queries

    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    want = sorted(db.execute(queries.SQL[name]).fetchall())
    got = sorted(map(tuple, queries.Q[name](spark, d).collect()))
    assert len({k for row in got for k in row if isinstance(k, str)}) == 5 and got == want
