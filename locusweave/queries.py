"""Queries over the adapter tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import calibrate, core, match, overlap, ranges, spatial
from .plans.adapters import LABELS, genes, intervals, paired, tss

W, TO, BINS, REACH = 5, 0.75, 500, 25
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, plain: bool = False):
    def add(f: Callable) -> Callable:
        Q[name] = f
        if sql is not None:
            SQL[name] = sql if plain else WITH + sql
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_K = range(5)
_LIST = "['" + "', '".join(LABELS) + "']"
WITH = (
    "WITH f AS (SELECT event_id AS idx, "
    + ", ".join(f"CAST(count(*) FILTER (event_type = '{x}') OVER a AS DOUBLE) / count(*) OVER a AS a{k}, CAST(count(*) FILTER (event_type = '{x}' AND user_id % 5 <> 0) OVER b AS DOUBLE) / count(*) OVER b AS b{k}" for k, x in enumerate(LABELS))
    + " FROM events WINDOW a AS (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), b AS (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING)),"
    + " g AS (SELECT idx, [" + ", ".join(f"a{k}" for k in _K) + "] AS p1, [" + ", ".join(f"b{k}" for k in _K) + "] AS p2 FROM f),"
    + f" t AS MATERIALIZED (SELECT idx, 'chr' || (1 + idx // 4000) AS chr, (idx % 4000) * 200 AS s, (idx % 4000) * 200 + 200 AS e, p1, p2, ({_LIST})[list_position(p1, list_max(p1))] AS m1, ({_LIST})[list_position(p2, list_max(p2))] AS m2 FROM g),"
    + " n AS (SELECT count(*) AS n FROM t),"
    + f" l AS (SELECT unnest({_LIST}) AS k, unnest([0, 1, 2, 3, 4]) AS la),"
    + " kj AS (SELECT a.k, b.k AS j, a.la AS ka, b.la AS ja FROM l a, l b),"
    + " c1 AS (SELECT k, count(idx) / (SELECT CAST(n AS DOUBLE) FROM n) AS c1 FROM l LEFT JOIN t ON m1 = k GROUP BY k),"
    + " c2 AS (SELECT k AS j, count(idx) / (SELECT CAST(n AS DOUBLE) FROM n) AS c2 FROM l LEFT JOIN t ON m2 = k GROUP BY k),"
    + " h0 AS (SELECT kj.k, kj.j, count(idx) / (SELECT CAST(n AS DOUBLE) FROM n) AS o FROM kj LEFT JOIN t ON m1 = k AND m2 = j GROUP BY ALL),"
    + f" v AS MATERIALIZED (SELECT t.idx, t.m1, u.m2 AS j, count(*) AS c FROM t JOIN t u ON u.idx BETWEEN t.idx - {W} AND t.idx + {W - 1} AND u.idx < (SELECT n - 1 FROM n) GROUP BY ALL),"
    + " h5 AS (SELECT kj.k, kj.j, count(v.idx) / (SELECT CAST(n AS DOUBLE) FROM n) AS o FROM kj LEFT JOIN v ON v.m1 = kj.k AND v.j = kj.j GROUP BY ALL),"
    + " i0 AS (SELECT k, j, ka, ja, o, c1, c2, o / nullif(c1 + c2 - o, 0) AS iou FROM h0 JOIN kj USING (k, j) JOIN c1 USING (k) JOIN c2 USING (j)),"
    + " i5 AS (SELECT k, j, ka, ja, o, c1, c2, o / nullif(c1 + c2 - o, 0) AS iou FROM h5 JOIN kj USING (k, j) JOIN c1 USING (k) JOIN c2 USING (j)),"
    + f" q AS MATERIALIZED (SELECT k, j FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY iou DESC NULLS LAST, ja) AS rn, max(iou) OVER (PARTITION BY k) AS best FROM i5) WHERE iou > {TO} OR (rn = 1 AND NOT coalesce(best > {TO}, false))) "
)


def matches(pairs: DataFrame) -> dict[str, list[str]]:
    return calibrate.matches_of(pairs, LABELS, W, TO)


@query("map_track", "SELECT idx, chr, s AS start, e AS \"end\", m1, m2 FROM t")
def _(spark, d):
    return paired(spark, d).select("idx", "chr", "start", "end", "m1", "m2")


@query("logit_posterior", "SELECT idx, k, round(CASE WHEN p1[la + 1] < 1e-16 THEN -36.84136 WHEN p1[la + 1] > 1 - 1e-16 THEN 36.84136 ELSE ln(p1[la + 1] / nullif(1 - p1[la + 1], 0)) END, 6) AS logit FROM t, l")
def _(spark, d):
    p = paired(spark, d).withColumn("l", core.logit("p1"))
    return r6(p.select("idx", F.explode(F.array(*[F.struct(F.lit(x).alias("k"), F.col("l")[i].alias("logit")) for i, x in enumerate(LABELS)])).alias("c")).select("idx", "c.*"), "logit")


@query("coverage", "SELECT k, round(c1, 6) AS coverage1, round(c2, 6) AS coverage2 FROM c1 JOIN c2 ON k = j")
def _(spark, d):
    p = paired(spark, d)
    a, b = overlap.coverage(p, LABELS, "m1"), overlap.coverage(p, LABELS, "m2")
    return r6(a.withColumnRenamed("coverage", "coverage1").join(b.withColumnRenamed("coverage", "coverage2"), "k"), "coverage1", "coverage2")


@query("soft_coverage", "SELECT k, round(avg(p1[la + 1]), 6) AS coverage FROM t, l GROUP BY k")
def _(spark, d):
    return r6(overlap.soft_coverage(paired(spark, d), LABELS), "coverage")


@query("soft_joint", "SELECT k, j, round(avg(p1[ka + 1] * p2[ja + 1]), 6) AS joint FROM t, kj GROUP BY k, j")
def _(spark, d):
    return r6(overlap.soft_joint(paired(spark, d), LABELS), "joint")


@query("soft_iou", "SELECT k, j, round(o / (a + b - o), 6) AS value FROM (SELECT k, j, avg(p1[ka + 1] * p2[ja + 1]) AS o, avg(p1[ka + 1]) AS a, avg(p2[ja + 1]) AS b FROM t, kj GROUP BY k, j)")
def _(spark, d):
    return r6(overlap.overlap(paired(spark, d), LABELS, "iou", soft=True), "value")


@query("joint_w0", "SELECT k, j, round(o, 6) AS joint FROM h0")
def _(spark, d):
    return r6(overlap.joint(paired(spark, d), LABELS), "joint")


@query("joint_w5_nonsym", "SELECT k, j, round(o, 6) AS joint FROM h5")
def _(spark, d):
    return r6(overlap.joint(paired(spark, d), LABELS, W), "joint")


_SYM = (
    f", w1 AS (SELECT t.idx, u.m1 AS k, count(*) AS c FROM t JOIN t u ON u.idx BETWEEN t.idx - {W} AND t.idx + {W - 1} AND u.idx < (SELECT n - 1 FROM n) GROUP BY ALL)"
    f", w2 AS (SELECT t.idx, u.m2 AS j, count(*) AS c FROM t JOIN t u ON u.idx BETWEEN t.idx - {W} AND t.idx + {W - 1} AND u.idx < (SELECT n - 1 FROM n) GROUP BY ALL)"
    ", sz AS (SELECT idx, sum(c) AS sz FROM w1 GROUP BY idx)"
    ", hs AS (SELECT k, j, sum(w1.c * w2.c / CAST(sz * sz AS DOUBLE)) / (SELECT n FROM n) AS o FROM w1 JOIN w2 USING (idx) JOIN sz USING (idx) GROUP BY k, j) "
)


@query("joint_w5_sym", _SYM + "SELECT kj.k, kj.j, round(coalesce(o, 0), 6) AS joint FROM kj LEFT JOIN hs USING (k, j)")
def _(spark, d):
    return r6(overlap.joint(paired(spark, d), LABELS, W, symmetric=True), "joint")


for _name, _kind, _w, _expr in (
    ("iou_w0", "iou", 0, "iou"), ("iou_w5", "iou", W, "iou"), ("overlap_coeff", "coefficient", 0, "o / nullif(least(c1, c2), 0)"), ("f1", "f1", 0, "2 * o / nullif(c1 + c2, 0)"),
    ("kappa_matrix", "kappa", 0, "(1 - c1 - c2 + 2 * o - (c1 * c2 + (1 - c1) * (1 - c2))) / nullif(1 - (c1 * c2 + (1 - c1) * (1 - c2)), 0)"),
    ("enrichment", "enrichment", 0, "ln((o * (SELECT n FROM n) + 1e-3) / (c1 * c2 * (SELECT n FROM n) + 1e-3))"), ("conditional", "conditional", 0, "o / nullif(c1, 0)"),
):
    @query(_name, f"SELECT k, j, round({_expr}, 6) AS value FROM i{_w}")
    def _(spark, d, kind=_kind, w=_w):
        return r6(overlap.overlap(paired(spark, d), LABELS, kind, w), "value")


@query("cooccurrence", "SELECT m1, m2, count(*) AS n FROM t GROUP BY m1, m2")
def _(spark, d):
    return paired(spark, d).groupBy("m1", "m2").agg(F.count("*").alias("n"))


@query("naive_overlap", "SELECT round(sum(b), 6) AS overlap FROM (SELECT max(o) AS b FROM h5 GROUP BY k)")
def _(spark, d):
    return r6(overlap.naive_overlap(paired(spark, d), LABELS, W), "overlap")


@query("symmetric_matrix", "SELECT a.k, a.j, round(CASE WHEN a.k = a.j THEN a.o ELSE a.o + b.o END, 6) AS value FROM h0 a JOIN h0 b ON a.k = b.j AND a.j = b.k")
def _(spark, d):
    return r6(overlap.symmetrised(overlap.overlap(paired(spark, d), LABELS, "joint")), "value")


@query("agreement", "SELECT k, round(a, 6) AS agreement, round(c1, 6) AS coverage, round(CASE WHEN a > 0 THEN ln(a / 0.201) END, 6) AS log_oe, round((a - 0.201) / 0.799, 6) AS kappa FROM (SELECT k, coalesce(avg(CASE WHEN m1 = m2 THEN 1.0 WHEN m1 <> m2 THEN 0.0 END), 0) AS a FROM l LEFT JOIN t ON m1 = k GROUP BY k) JOIN c1 USING (k)")
def _(spark, d):
    return r6(overlap.agreement(paired(spark, d), LABELS), "agreement", "coverage", "log_oe", "kappa")


@query("general_agreement", "SELECT round(a, 6) AS agreement, round(ln(a / 0.201), 6) AS log_oe, round((a - 0.201) / 0.799, 6) AS kappa FROM (SELECT avg(CASE WHEN m1 = m2 THEN 1.0 ELSE 0.0 END) AS a FROM t)")
def _(spark, d):
    return r6(overlap.general_agreement(paired(spark, d), LABELS), "agreement", "log_oe", "kappa")


_INFO = ", r AS (SELECT k, sum(o) AS r FROM {h} GROUP BY k), c AS (SELECT j, sum(o) AS c FROM {h} GROUP BY j) SELECT round(hr, 6) AS h_rows, round(hc, 6) AS h_cols, round(hx, 6) AS h_cond, round(mi, 6) AS mi, round(mi / hc, 6) AS nmi FROM (SELECT sum(CASE WHEN o > 0 THEN o * log2(o / (r * c)) ELSE 0 END) AS mi, -sum(CASE WHEN o > 0 THEN o * log2(o / c) ELSE 0 END) AS hx FROM {h} JOIN r USING (k) JOIN c USING (j)), (SELECT -sum(CASE WHEN r > 0 THEN r * log2(r) ELSE 0 END) AS hr FROM r), (SELECT -sum(CASE WHEN c > 0 THEN c * log2(c) ELSE 0 END) AS hc FROM c)"


@query("nmi", _INFO.format(h="h0"))
def _(spark, d):
    return r6(overlap.information(overlap.joint(paired(spark, d), LABELS)), "h_rows", "h_cols", "h_cond", "mi", "nmi")


@query("best_match", "SELECT k, j, round(iou, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY iou DESC NULLS LAST, ja) AS rn FROM i5) WHERE rn = 1")
def _(spark, d):
    return r6(match.best_match(overlap.overlap(paired(spark, d), LABELS, "iou", W), LABELS), "value")


@query("match_static", "SELECT k, j FROM q")
def _(spark, d):
    return match.match_static(overlap.overlap(paired(spark, d), LABELS, "iou", W), LABELS, TO)


@query("match_greedy", _SYM + """, x AS (SELECT kj.k, kj.j, ka, ja, coalesce(o, 0) AS o, c1, c2, coalesce(o, 0) / nullif(c1 + c2 - coalesce(o, 0), 0) AS iou FROM kj LEFT JOIN hs USING (k, j) JOIN c1 USING (k) JOIN c2 USING (j))
, y AS (SELECT k, j, c1, row_number() OVER z AS rank, sum(o) OVER z AS sj, sum(c2) OVER z AS sc FROM x WINDOW z AS (PARTITION BY k ORDER BY iou DESC NULLS LAST, ja))
, m AS (SELECT k, j, rank, sj / nullif(c1 + sc - sj, 0) AS merged FROM y WHERE rank < 5), b AS (SELECT k, arg_max(rank, merged) AS last FROM m GROUP BY k)
SELECT k, j, CAST(rank AS INTEGER) AS rank, round(merged, 6) AS merged FROM m JOIN b USING (k) WHERE rank <= last""")
def _(spark, d):
    return r6(match.match_greedy(paired(spark, d), LABELS, W), "merged")


_HIT = ", hit AS (SELECT DISTINCT t.idx, qa.k FROM t JOIN v ON v.idx = t.idx JOIN q qa ON qa.j = v.j)"
_CURVE = _HIT + f""", st AS (SELECT t.idx, l.k, t.p1[la + 1] AS p, CASE WHEN hit.k IS NULL THEN 0.0 ELSE 1.0 END AS y FROM t CROSS JOIN l LEFT JOIN hit ON hit.idx = t.idx AND hit.k = l.k)
, bn AS (SELECT k, p, y, (row_number() OVER (PARTITION BY k ORDER BY p, idx) - 1) // greatest(1, (SELECT n // {BINS} FROM n)) AS b FROM st)
, pt0 AS (SELECT k, b, (min(p) + max(p)) / 2 AS x, avg(y) AS y FROM bn GROUP BY k, b)
, pt AS (SELECT k, x, avg(y) AS y, count(*) AS w, row_number() OVER (PARTITION BY k ORDER BY x) AS r FROM pt0 GROUP BY k, x)
, cu AS (SELECT k, r, sum(y * w) OVER z AS sy, sum(w) OVER z AS sw FROM pt WINDOW z AS (PARTITION BY k ORDER BY r))
, iso AS (SELECT k, r, max(mn) AS f FROM (SELECT a.k, a.r, c.r AS r0, min((b.sy - coalesce(p.sy, 0)) / (b.sw - coalesce(p.sw, 0))) AS mn FROM cu a JOIN cu b ON a.k = b.k AND b.r >= a.r JOIN cu c ON a.k = c.k AND c.r <= a.r LEFT JOIN cu p ON p.k = a.k AND p.r = c.r - 1 GROUP BY a.k, a.r, c.r) GROUP BY k, r)
, cv AS (SELECT k, x, f, lead(x) OVER z AS x1, lead(f) OVER z AS f1, lag(x) OVER z AS x0 FROM iso JOIN pt USING (k, r) WINDOW z AS (PARTITION BY k ORDER BY x))
, rv AS MATERIALIZED (SELECT idx, chr, s AS start, e AS "end", m1 AS map, CASE WHEN pm <= x OR x1 IS NULL THEN f ELSE f + (f1 - f) * (pm - x) / (x1 - x) END AS r FROM (SELECT *, list_max(p1) AS pm FROM t) JOIN cv ON k = m1 AND (pm >= x OR x0 IS NULL) AND (pm < x1 OR x1 IS NULL))
"""


@query("r_values", _CURVE + 'SELECT idx, chr, start, "end", map, round(r, 6) AS r_value FROM rv')
def _(spark, d):
    return r6(calibrate.r_values(paired(spark, d), LABELS, W, TO, BINS), "r_value")


@query("r_report", _CURVE + "SELECT map, round(avg(r), 6) AS mean_r, round(avg(CASE WHEN r >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS ratio_robust, count(*) AS n FROM rv GROUP BY ROLLUP (map)")
def _(spark, d):
    r = calibrate.r_values(paired(spark, d), LABELS, W, TO, BINS)
    return r6(r.rollup("map").agg(F.avg("r_value").alias("mean_r"), F.avg((F.col("r_value") >= 0.8).cast("double")).alias("ratio_robust"), F.count("*").alias("n")), "mean_r", "ratio_robust")


_ISLES = "SELECT chr, min(start) AS start, max(\"end\") AS \"end\", label, count(*) AS n FROM (SELECT *, sum(CASE WHEN pl IS NULL OR pl <> label OR pc <> chr THEN 1 ELSE 0 END) OVER (ORDER BY idx) AS g FROM (SELECT *, lag(label) OVER (ORDER BY idx) AS pl, lag(chr) OVER (ORDER BY idx) AS pc FROM {src})) GROUP BY g, chr, label"


@query("confident_segments", _CURVE + ", cs AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, chr, start, \"end\", map AS label FROM rv WHERE r >= 0.8) " + _ISLES.format(src="cs"))
def _(spark, d):
    r = calibrate.r_values(paired(spark, d), LABELS, W, TO, BINS).where("r_value >= 0.8").select("chr", "start", "end", F.col("map").alias("m1"), F.col("idx").alias("was"))
    # positions are renumbered over what is kept, so a dropped bin does not end a segment
    return spatial.segments(core.position_index_by(r, "was"))


@query("dense_segments", ", cs AS (SELECT idx, chr, s AS start, e AS \"end\", m1 AS label FROM t) " + _ISLES.format(src="cs"))
def _(spark, d):
    return spatial.segments(paired(spark, d))


@query("run_lengths", ", cs AS (SELECT idx, chr, s AS start, e AS \"end\", m1 AS label FROM t), sg AS (" + _ISLES.format(src="cs") + ") SELECT label, n AS length, count(*) AS segments FROM sg GROUP BY label, n")
def _(spark, d):
    return spatial.segments(paired(spark, d)).groupBy("label", F.col("n").alias("length")).agg(F.count("*").alias("segments"))


_NEAR = ", nr AS (SELECT t.idx, t.m1, u.idx - t.idx AS d FROM t JOIN q ON q.k = t.m1 JOIN t u ON u.m2 = q.j AND u.idx BETWEEN t.idx - {0} AND t.idx + {0}), ne AS (SELECT t.idx, t.m1, x.d FROM t LEFT JOIN (SELECT idx, arg_min(d, abs(d) * 2 + CASE WHEN d < 0 THEN 1 ELSE 0 END) AS d FROM nr GROUP BY idx) x USING (idx)) "


@query("signed_distance", _NEAR.format(REACH - 1) + "SELECT m1, CAST(d AS INTEGER) AS distance, count(*) AS n FROM ne GROUP BY m1, d")
def _(spark, d):
    p = paired(spark, d)
    return spatial.distance_profile(p, matches(p), REACH - 1)


@query("boundary_cdf", _NEAR.format(REACH - 1) + f", z AS (SELECT m1, abs(d) AS d FROM ne WHERE idx < (SELECT n - 1 FROM n)) SELECT a.m1, CAST(g AS INTEGER) AS d, round(count(*) FILTER (z.d <= g) / CAST(count(*) AS DOUBLE), 6) AS share FROM (SELECT DISTINCT m1 FROM z) a, range(0, {REACH}) r(g) JOIN z ON z.m1 = a.m1 GROUP BY a.m1, g")
def _(spark, d):
    p = paired(spark, d)
    return r6(spatial.boundary_cdf(p, matches(p), REACH), "share")


@query("overall_boundary", _NEAR.format(REACH) + f", z AS (SELECT idx, d, CASE WHEN d >= 0 THEN d + 1 ELSE -d END AS w FROM nr WHERE idx + d < (SELECT n - 1 FROM n)) SELECT CAST(g AS INTEGER) AS w, round(CASE WHEN g = 0 THEN (SELECT count(DISTINCT idx) FROM nr WHERE d = 0) ELSE (SELECT count(DISTINCT idx) FROM z WHERE z.w <= g) END / (SELECT CAST(n AS DOUBLE) FROM n), 6) AS share FROM range(0, {REACH + 1}) r(g)")
def _(spark, d):
    p = paired(spark, d)
    return r6(spatial.overall_boundary(p, matches(p), REACH), "share")


@query("corr_by_offset", ", z AS (SELECT t.idx, t.m1, g, max(CASE WHEN q.j IS NULL THEN 0.0 ELSE 1.0 END) AS h FROM t, range(0, 11) r(g), (SELECT unnest([-1, 1]) AS sd) JOIN t u ON u.idx = greatest(0, least((SELECT n - 1 FROM n), t.idx + sd * g)) LEFT JOIN q ON q.k = t.m1 AND q.j = u.m2 GROUP BY t.idx, t.m1, g) SELECT m1, CAST(g AS INTEGER) AS d, round(avg(h), 6) AS share FROM z GROUP BY m1, g")
def _(spark, d):
    p = paired(spark, d)
    return r6(spatial.correspondence_by_offset(p, matches(p), 10), "share")


@query("repr_score", f", z AS (SELECT t.idx, u.idx - t.idx AS d, iou FROM t JOIN t u ON u.idx BETWEEN t.idx - {W} AND t.idx + {W} AND t.idx - abs(u.idx - t.idx) >= 0 AND t.idx + abs(u.idx - t.idx) <= (SELECT n - 1 FROM n) JOIN i5 ON i5.k = t.m1 AND i5.j = u.m2) SELECT idx, round(iou / (abs(d) + 1), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY iou DESC, abs(d) * 2 + CASE WHEN d > 0 THEN 1 ELSE 0 END) AS rn FROM z) WHERE rn = 1")
def _(spark, d):
    p = paired(spark, d)
    return r6(spatial.local_scores(p, overlap.overlap(p, LABELS, "iou", W), W), "score")


@query("is_reproduced", f", z AS (SELECT DISTINCT t.idx FROM t JOIN q ON q.k = t.m1 JOIN t u ON u.m2 = q.j AND u.idx BETWEEN t.idx - {W} AND t.idx + {W - 1}) SELECT m1, count(z.idx) AS reproduced, count(*) AS n FROM t LEFT JOIN z USING (idx) GROUP BY m1")
def _(spark, d):
    p = paired(spark, d)
    return spatial.reproduced(p, matches(p), W).groupBy("m1").agg(F.count_if("is_repr").alias("reproduced"), F.count("*").alias("n"))


_GRAN = ", gr AS (SELECT k, row_number() OVER z AS step, sum(c2) OVER z AS cr, sum(o / nullif(c1, 0)) OVER z AS ar FROM i0 WINDOW z AS (PARTITION BY k ORDER BY iou DESC NULLS LAST, ja)), ga AS (SELECT * FROM gr UNION ALL SELECT k, 0, 0.0, 0.0 FROM l) "


def _granularity(spark, d):
    p = paired(spark, d)
    return spatial.granularity(overlap.overlap(p, LABELS, "iou"), overlap.joint(p, LABELS), overlap.coverage(p, LABELS, "m1"), overlap.coverage(p, LABELS, "m2"), LABELS)


@query("granularity_curve", _GRAN + "SELECT k, CAST(step AS INTEGER) AS step, round(cr, 6) AS coverage, round(ar, 6) AS agreement FROM ga")
def _(spark, d):
    return r6(_granularity(spark, d), "coverage", "agreement")


@query("granularity_auc", _GRAN + "SELECT k, round(sum((cr - c0) * (ar + a0) / 2), 6) AS auc, round(sum((cr - c0) * (1 + CASE WHEN step = 1 THEN 0 ELSE 1 END) / 2), 6) AS max_auc FROM (SELECT *, lag(cr) OVER z AS c0, lag(ar) OVER z AS a0 FROM ga WINDOW z AS (PARTITION BY k ORDER BY step)) WHERE step > 0 GROUP BY k")
def _(spark, d):
    return r6(spatial.area(_granularity(spark, d)), "auc", "max_auc")


@query("corr_curve", ", rk AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY p1[la + 1] DESC, idx) - 1 AS r1, row_number() OVER (PARTITION BY k ORDER BY p2[la + 1] DESC, idx) - 1 AS r2 FROM t, l) SELECT k, g / 100.0::DOUBLE AS t, round(count(*) FILTER (greatest(r1, r2) <= g * (SELECT n FROM n) // 100) / (SELECT CAST(n AS DOUBLE) FROM n), 6) AS psi FROM rk, range(0, 101) r(g) GROUP BY k, g")
def _(spark, d):
    return r6(spatial.correspondence_curve(paired(spark, d), LABELS), "psi")


_STRATA = ", sj AS (SELECT l.k, (row_number() OVER (PARTITION BY l.k ORDER BY p1[la + 1], idx) - 1) // greatest(1, (SELECT n // 50 FROM n)) AS b, m2 FROM t, l) "


@query("strat_joint", _STRATA + "SELECT k, b, m2, count(*) AS n FROM sj GROUP BY k, b, m2")
def _(spark, d):
    p = paired(spark, d)
    n = core.size(p)
    long = p.select("idx", "m2", F.explode(F.array(*[F.struct(F.lit(x).alias("k"), F.col("p1")[i].alias("p")) for i, x in enumerate(LABELS)])).alias("c")).select("idx", "m2", "c.*")
    return core.ranked(long, "k", "p", "idx").groupBy("k", F.floor(F.col("pos") / calibrate.strata_count(n, 50)).alias("b"), "m2").agg(F.count("*").alias("n"))


_IV = ", iv AS (SELECT o_orderkey AS rid, 'chr' || (1 + o_orderkey % 3) AS chr, (o_orderkey * 7919) % 780000 AS s, (o_orderkey * 7919) % 780000 + 100 + (o_orderkey % 17) * 90 AS e FROM orders)"
_GE = ", ge AS (SELECT p_partkey AS gene_id, 'chr' || (1 + p_partkey % 3) AS chr, (p_partkey * 3571) % 790000 AS s, (p_partkey * 3571) % 790000 + p_size * 60 AS e, p_retailprice AS tpm, 't' || (p_partkey % 3) AS gene_type FROM part)"
_TS = ", ts AS (SELECT s_suppkey AS tss_id, 'chr' || (1 + s_suppkey % 3) AS chr, (s_suppkey * 7877 + 57) % 790000 AS coord FROM supplier)"


@query("interval_overlap", _IV + " SELECT t.idx, iv.rid FROM t JOIN iv ON t.chr = iv.chr AND t.s < iv.e AND iv.s < t.e")
def _(spark, d):
    return ranges.overlap_join(paired(spark, d).select("idx", "chr", "start", "end"), intervals(spark, d)).select("idx", F.col("b_rid").alias("rid"))


@query("interval_anti", _IV + " SELECT t.idx FROM t WHERE NOT EXISTS (SELECT 1 FROM iv WHERE t.chr = iv.chr AND t.s < iv.e AND iv.s < t.e)")
def _(spark, d):
    return ranges.overlap_join(paired(spark, d).select("idx", "chr", "start", "end"), intervals(spark, d), "left_anti").select("idx")


@query("bin_gene_endpoint", _GE + " SELECT idx, m1, round(arg_max(tpm, gene_id), 6) AS tpm FROM t JOIN ge ON t.chr = ge.chr AND ((t.s BETWEEN ge.s AND ge.e) OR (t.e BETWEEN ge.s AND ge.e)) GROUP BY idx, m1")
def _(spark, d):
    return r6(ranges.endpoint_join(paired(spark, d), genes(spark, d)).select("idx", "m1", "tpm"), "tpm")


@query("tss_enrichment", _TS + ", ch AS (SELECT DISTINCT idx, m1 FROM t JOIN ts ON t.chr = ts.chr AND t.s < coord AND coord < t.e) SELECT k, round(ln((CASE WHEN h > 0 THEN h / m ELSE 1 / m END) / (c / nn)), 6) AS enrichment FROM (SELECT m1 AS k, CAST(count(*) AS DOUBLE) AS c FROM t GROUP BY m1) LEFT JOIN (SELECT m1 AS k, CAST(count(*) AS DOUBLE) AS h FROM ch GROUP BY m1) USING (k), (SELECT CAST(count(*) AS DOUBLE) AS m FROM ch), (SELECT CAST(n AS DOUBLE) AS nn FROM n)")
def _(spark, d):
    p = paired(spark, d).select("idx", "chr", "start", "end", "m1")
    return r6(ranges.enrichment_at(p, ranges.point_join(p, tss(spark, d)), overlap.label_frame(spark, LABELS)), "enrichment")


@query("gene_overlap", _GE + ", cs AS (SELECT idx, chr, s AS start, e AS \"end\", m1 AS label FROM t), sg AS (" + _ISLES.format(src="cs") + ") SELECT label, gene_type, round(sum(least(sg.\"end\", ge.e) - greatest(sg.start, ge.s)) / CAST(max(len) AS DOUBLE), 6) AS share FROM sg JOIN ge ON sg.chr = ge.chr AND sg.start < ge.e AND ge.s < sg.\"end\" JOIN (SELECT label, sum(\"end\" - start) AS len FROM sg GROUP BY label) USING (label) GROUP BY label, gene_type")
def _(spark, d):
    return r6(ranges.body_share(spatial.segments(paired(spark, d)), genes(spark, d)), "share")


@query("posterior_tpm_corr", _GE + ", bg AS (SELECT idx, arg_max(tpm, gene_id) AS tpm FROM t JOIN ge ON t.chr = ge.chr AND ((t.s BETWEEN ge.s AND ge.e) OR (t.e BETWEEN ge.s AND ge.e)) GROUP BY idx) SELECT k, round(corr(p1[la + 1], tpm), 6) AS pearson FROM bg JOIN t USING (idx), l GROUP BY k")
def _(spark, d):
    p = paired(spark, d)
    both = ranges.endpoint_join(p, genes(spark, d)).select("idx", "tpm").join(p.select("idx", "p1"), "idx")
    means = both.agg(*[F.corr(F.col("p1")[i], F.col("tpm")).alias(f"c{i}") for i in range(5)])
    return r6(means.select(F.explode(F.array(*[F.struct(F.lit(x).alias("k"), F.col(f"c{i}").alias("pearson")) for i, x in enumerate(LABELS)])).alias("r")).select("r.*"), "pearson")


@query("hungarian")
def _(spark, d):
    cells = match.to_array(overlap.overlap(paired(spark, d), LABELS, "iou"), LABELS)
    return spark.createDataFrame([(LABELS[i], LABELS[j], round(float(cells[i, j]), 6)) for i, j in match.assignment(cells)], "k string, j string, value double")


@query("merge_gain")
def _(spark, d):
    gain = match.merging_gain(match.to_array(overlap.joint(paired(spark, d), LABELS), LABELS, "joint"))
    return spark.createDataFrame([(LABELS[i], LABELS[j], round(float(gain[i, j]), 6)) for i in range(5) for j in range(5) if i != j], "k string, j string, gain double")
