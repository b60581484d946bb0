"""Queries of fits, rank concordance, grids and roll-ups, registered beside the others, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries as base
from . import queries_enrich as more
from . import queries_labels as labels
from . import queries_profiles as profile_queries
from .operators import calibrate, concordance, core, enrich, fits, match, merging, overlap, profiles, progress, ranges, rollups, statistics, sweeps
from .plans.adapters import LABELS, intervals, paired, read, run_states
from .queries import BINS, TO, W, matches, query, r6


def _orthogonal(source: str, degree: int, key: str = "k") -> str:
    """CTEs that fit polynomials of ``y`` by ``x`` on the rows of ``source`` (key, x, y, wt, ...) by orthogonal ones, one degree after the other.

    The last one, ``of``, has ``fit`` and ``sl`` (its derivative) on all rows, those of weight 0 too.
    """
    out = f", f0 AS (SELECT *, 0.0::DOUBLE AS fit, 0.0::DOUBLE AS sl, 1.0::DOUBLE AS p, 0.0::DOUBLE AS pm, 0.0::DOUBLE AS d, 0.0::DOUBLE AS dm, 1.0::DOUBLE AS nm FROM {source})"
    for i in range(degree + 1):
        out += f", a{i} AS (SELECT {key}, sum(wt * x * p * p) / sum(wt * p * p) AS al, sum(wt * p * p) AS nn, sum(wt * y * p) / sum(wt * p * p) AS c FROM f{i} GROUP BY {key})"
        out += f", f{i + 1} AS (SELECT f{i}.* REPLACE (fit + c * p AS fit, sl + c * d AS sl, (x - al) * p - nn / nm * pm AS p, p AS pm, p + (x - al) * d - nn / nm * dm AS d, d AS dm, nn AS nm) FROM f{i} JOIN a{i} USING ({key}))"
    return out + f", of AS (SELECT * FROM f{degree + 1})"


base.SQL["corr_slope_fit"] = base.SQL["corr_curve"].replace(", rk AS (", ", cc AS (WITH rk AS (").replace("round(count(*) FILTER", "(count(*) FILTER").replace("FROM n), 6) AS psi", "FROM n)) AS psi") + "), sr AS (SELECT k, t AS x, psi AS y, 1.0 AS wt FROM cc)" + _orthogonal("sr", 5) + " SELECT k, x AS t, round(y, 6) AS psi, round(fit, 6) AS fitted, round(sl, 5) AS slope FROM of"


@query("corr_slope_fit")
def _(spark, d):
    from .operators import spatial

    found = fits.fitted_slope(spatial.correspondence_curve(paired(spark, d), LABELS), "k", "t", "psi")
    return r6(found, "psi", "fitted").withColumn("slope", F.round("slope", 5))


_STRATA = ", bj AS (SELECT k, j, c2 FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY iou DESC NULLS LAST, ja) AS rn FROM i0) WHERE rn = 1), lp AS (SELECT l.k, t.idx, p1[la + 1] AS p, m2 = bj.j AS hit, c2 FROM t, l JOIN bj USING (k)), sb AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY p, idx) - 1) // greatest(1, (SELECT n // 50 FROM n)) AS b FROM lp)"
_ODDS = _STRATA + ", pt AS (SELECT k, (min(p) + max(p)) / 2 AS x, CASE WHEN count(*) FILTER (hit) = 0 THEN ln(1 / (max(c2) * count(*) + 1)) ELSE ln(count(*) FILTER (hit) / (max(c2) * count(*))) END AS y FROM sb GROUP BY k, b)"
_ENDS = ", en AS (SELECT k, min(x) AS x0, max(x) AS x1 FROM pt GROUP BY k)"
_AT = ", sr AS (SELECT k, x, y, 1.0 AS wt, NULL AS idx FROM pt UNION ALL SELECT k, {x} AS x, 0.0 AS y, 0.0 AS wt, idx FROM lp JOIN en USING (k))"
_SCALED = ", cm AS (SELECT idx, k, fit FROM of WHERE wt = 0) SELECT idx, k, round((fit - {low}) / ({high} - {low}), 6) AS value FROM cm"


def _calibrated(spark, d, method: str, scale: str):
    p = paired(spark, d)
    best = {r["k"]: r["j"] for r in match.best_match(overlap.overlap(p, LABELS, "iou"), LABELS).collect()}
    out = fits.calibrated(p, LABELS, best, method, bins=50, scale=scale)
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col("p")[i].alias("value")) for i, k in enumerate(LABELS)])
    return r6(out.select("idx", F.explode(cells).alias("c")).select("idx", "c.*"), "value")


@query("calibrated_polynomial", _ODDS + _ENDS + _AT.format(x="p") + _orthogonal("sr", 3) + _SCALED.format(low="(SELECT min(fit) FROM cm)", high="(SELECT max(fit) FROM cm)"))
def _(spark, d):
    return _calibrated(spark, d, "polynomial", "all")


# at the default bound on the residuals the smoothing spline of these strata is the least-squares cubic, flat beyond its ends
@query("calibrated_spline", _ODDS + _ENDS + _AT.format(x="greatest(x0, least(x1, p))") + _orthogonal("sr", 3) + _SCALED.format(low="min(fit) OVER (PARTITION BY k)", high="max(fit) OVER (PARTITION BY k)"))
def _(spark, d):
    return _calibrated(spark, d, "spline", "column")


@query("expression_kendall", profile_queries._RX + ", rr AS (SELECT map, round(r, 9) AS r, tpm, count(*) AS w FROM rx GROUP BY ALL), rn AS (SELECT map, sum(w) AS n FROM rr GROUP BY map), pr AS (SELECT a.map, sum(a.w * b.w) FILTER ((a.r - b.r) * (a.tpm - b.tpm) < 0) AS dis, sum(a.w * b.w) FILTER ((a.r - b.r) * (a.tpm - b.tpm) > 0) AS con, sum(a.w * b.w) FILTER (a.r <> b.r) AS dx, sum(a.w * b.w) FILTER (a.tpm <> b.tpm) AS dy FROM rr a JOIN rr b USING (map) GROUP BY a.map) SELECT map, CAST(n AS BIGINT) AS n, CAST(coalesce(dis, 0) // 2 AS BIGINT) AS discordant, round((coalesce(con, 0) - coalesce(dis, 0)) / nullif(sqrt(dx::DOUBLE) * sqrt(dy::DOUBLE), 0), 6) AS tau FROM rn LEFT JOIN pr USING (map)")
def _(spark, d):
    rows = profile_queries._rx(spark, d).withColumn("r_value", F.round("r_value", 9))
    return r6(concordance.kendall(rows, "map", "r_value", "tpm"), "tau")


_SIDE = """, vi{a} AS (SELECT w, t.idx, t.m{a} AS k, u.m{b} AS j, bool_or(w = 0 OR u.idx < (SELECT n - 1 FROM n)) AS counts FROM wn, t JOIN t u ON u.idx BETWEEN t.idx - w AND t.idx + greatest(w - 1, 0) GROUP BY ALL)
, jo{a} AS (SELECT wn.w, kj.k, kj.j, ja, count(x.idx) AS o FROM wn, kj LEFT JOIN vi{a} x ON x.w = wn.w AND x.k = kj.k AND x.j = kj.j AND x.counts GROUP BY wn.w, kj.k, kj.j, ja)
, ma{a} AS (SELECT w, k, j, o / nullif(n1 + n2 - o, 0) AS iou, row_number() OVER (PARTITION BY w, k ORDER BY o / nullif(n1 + n2 - o, 0) DESC NULLS LAST, ja) AS rn FROM jo{a} JOIN (SELECT m{a} AS k, CAST(count(*) AS DOUBLE) AS n1 FROM t GROUP BY 1) USING (k) JOIN (SELECT m{b} AS j, CAST(count(*) AS DOUBLE) AS n2 FROM t GROUP BY 1) USING (j))
, re{a} AS (SELECT w, idx, max(CASE WHEN rn = 1 THEN 2 ELSE iou END) AS top FROM vi{a} JOIN ma{a} USING (w, k, j) GROUP BY w, idx)"""
_GRID_SQL = ", wn AS (SELECT CAST(unnest([0, 1, 2, 5, 8]) AS INTEGER) AS w), th AS (SELECT unnest([0.3, 0.5, 0.7, 0.75, 0.8, 0.9])::DOUBLE AS t)" + _SIDE.format(a=1, b=2) + _SIDE.format(a=2, b=1) + """, kp AS (SELECT w, th.t AS t, m1 AS k, m2 AS j, count(*) AS o FROM re1 JOIN re2 USING (w, idx) JOIN t ON t.idx = re1.idx, th WHERE least(re1.top, re2.top) > th.t GROUP BY ALL)
, kn AS (SELECT w, t, sum(o) AS m FROM kp GROUP BY w, t)
, ki AS (SELECT w, t, sum(o / m * log2(o / m / (r / m * (c / m)))) AS mi FROM (SELECT *, sum(o) OVER (PARTITION BY w, t, k) AS r, sum(o) OVER (PARTITION BY w, t, j) AS c FROM kp) JOIN kn USING (w, t) GROUP BY w, t)
, kh AS (SELECT w, t, -sum(c / m * log2(c / m)) AS h FROM (SELECT w, t, j, sum(o) AS c FROM kp GROUP BY ALL) JOIN kn USING (w, t) GROUP BY w, t)
, ha AS (SELECT k, j, o FROM h0 WHERE o > 0)
SELECT wn.w, th.t, round(coalesce(m, 0) / CAST(n AS DOUBLE), 6) AS kept, round(""" + more._NMI.format(h="ha") + """, 6) AS before, round(CASE WHEN h > 0 THEN mi / h ELSE CASE WHEN m IS NOT NULL THEN 0 END END, 6) AS after FROM n, wn CROSS JOIN th LEFT JOIN kn ON kn.w = wn.w AND kn.t = th.t LEFT JOIN ki ON ki.w = wn.w AND ki.t = th.t LEFT JOIN kh ON kh.w = wn.w AND kh.t = th.t"""


@query("nmi_grid", _GRID_SQL)
def _(spark, d):
    return r6(sweeps.nmi_grid(paired(spark, d), LABELS, [0.3, 0.5, 0.7, 0.75, 0.8, 0.9], [0, 1, 2, 5, 8]), "kept", "before", "after")


def _merge_steps(steps: int, curve: bool) -> str:
    """CTEs z1, z2, ...: each has the facts of one number of labels and the groups of labels (a1, a2) after the next merges.

    A step names its own groups' rows ``t`` and reads the tables of every query again, over those.
    """
    groups = "list_transform(a{0}, lambda g: list_sum(list_transform(g, lambda i: p{0}[i]))) AS p{0}"
    names = f"list_transform(a{{0}}, lambda g: array_to_string(list_transform(g, lambda i: ({base._LIST})[i]), '+')) AS n{{0}}"
    tables = base.WITH[base.WITH.index(" n AS (SELECT count") :]
    tables = tables.replace(f" l AS (SELECT unnest({base._LIST}) AS k, unnest([0, 1, 2, 3, 4]) AS la),", " l AS (SELECT unnest(n1) AS k, unnest(range(len(n1))) AS la FROM nm), l2 AS (SELECT unnest(n2) AS k, unnest(range(len(n2))) AS la FROM nm),")
    tables = tables.replace("FROM l a, l b", "FROM l a, l2 b").replace("FROM l LEFT JOIN t ON m2 = k", "FROM l2 LEFT JOIN t ON m2 = k")
    gain = "(WITH " + labels._GAIN[2:] + " SELECT xa, ya FROM gn ORDER BY g DESC, xa, ya LIMIT 1)"
    mirror = gain.replace("FROM h0", "FROM ht").replace("mg, h0 GROUP", "mg, ht GROUP").replace("h0.k", "ht.k").replace("FROM l x, l y", "FROM l2 x, l2 y")
    after = "list_concat(list_filter(a{0}, lambda g, i: i <> b{0}.xa + 1 AND i <> b{0}.ya + 1), [list_concat(a{0}[b{0}.xa + 1], a{0}[b{0}.ya + 1])]) AS a{0}"
    info = "(SELECT sum(o * log2(o / (r * c))) FROM (SELECT o, sum(o) OVER (PARTITION BY k) AS r, sum(o) OVER (PARTITION BY j) AS c FROM h0) WHERE o > 0)"
    entropy = "(SELECT -sum(x * log2(x)) FROM (SELECT sum(o) AS x FROM h0 GROUP BY {0}) WHERE x > 0)"
    shares = ", (SELECT avg(CASE WHEN r >= 0.9 THEN 1.0 ELSE 0.0 END) FROM rv) AS robust, (SELECT avg(r) FROM rv) AS mean_r" if curve else ""
    out = ", z0 AS (SELECT [[1], [2], [3], [4], [5]] AS a1, [[1], [2], [3], [4], [5]] AS a2)"
    for i in range(1, steps + 1):
        out += f", z{i} AS MATERIALIZED (WITH nm AS (SELECT {names.format(1)}, {names.format(2)}, a1, a2 FROM z{i - 1}), tp AS (SELECT idx, chr, s, e, {groups.format(1)}, {groups.format(2)} FROM t, nm), t AS MATERIALIZED (SELECT tp.*, n1[list_position(p1, list_max(p1))] AS m1, n2[list_position(p2, list_max(p2))] AS m2 FROM tp, nm),"
        out += tables + (base._CURVE if curve else "") + f", ht AS (SELECT j AS k, k AS j, o FROM h0), b1 AS {gain}, b2 AS {mirror}"
        out += f" SELECT CAST(len(n1) AS INTEGER) AS labels, {entropy.format('k')} AS entropy, {info} AS mi, {info} / {entropy.format('j')} AS nmi, (SELECT sum(x) FROM (SELECT max(o) AS x FROM h0 GROUP BY k)) AS naive{shares}, {after.format(1)}, {after.format(2)} FROM nm, b1, b2)"
    return out


def _progress(curve: bool) -> str:
    columns = ["entropy", "mi", "nmi", "naive", *(["robust", "mean_r"] if curve else [])]
    rows = " UNION ALL ".join(f"SELECT * EXCLUDE (a1, a2) FROM z{i}" for i in range(1, 5))
    return _merge_steps(4, curve) + " SELECT labels, " + ", ".join(f"round({c}, 6) AS {c}" for c in columns) + f" FROM ({rows})"


base.SQL["merge_progress"] = base.WITH + _progress(False)
base.SQL["keep_states"] = base.WITH + _merge_steps(2, False) + f", ks AS (SELECT {', '.join(f'list_transform(a{i}, lambda g: list_sum(list_transform(g, lambda i: p{i}[i]))) AS p{i}, list_transform(a{i}, lambda g: array_to_string(list_transform(g, lambda i: ({base._LIST})[i]), chr(43))) AS n{i}' for i in (1, 2))} FROM t, z2) SELECT n1[list_position(p1, list_max(p1))] AS m1, n2[list_position(p2, list_max(p2))] AS m2, count(*) AS n FROM ks GROUP BY ALL"


@query("calibrated_progress", _progress(True))
def _(spark, d):
    found = progress.calibrated_progress(paired(spark, d), LABELS, W, TO, BINS)
    return spark.createDataFrame([(n, *(round(x, 6) for x in rest)) for n, *rest in found], "labels int, entropy double, mi double, nmi double, naive double, robust double, mean_r double")


_TOGETHER = base._IV + f""", a AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS i, chr, s, e, m1, m2 FROM t WHERE EXISTS (SELECT 1 FROM iv WHERE iv.chr = t.chr AND iv.s < t.e AND t.s < iv.e))
, na AS (SELECT count(*) AS n FROM a)
, wd AS (SELECT CAST(unnest(range(0, {W} + 1)) AS BIGINT) AS d)
, rc AS (SELECT a.i, max(d) FILTER (a.chr = lo.chr AND a.chr = hi.chr) AS c FROM a, na, wd JOIN a lo ON lo.i = greatest(0, a.i - d) JOIN a hi ON hi.i = least(n - 1, a.i + d) GROUP BY a.i)
, ru AS (SELECT a.i, max(d) FILTER (a.s - lo.s = d * 200 AND a.chr = lo.chr) AS u FROM a, wd JOIN a lo ON lo.i = greatest(0, a.i - d) GROUP BY a.i)
, rd AS (SELECT a.i, max(d) FILTER (hi.s - a.s = d * 200 AND a.chr = hi.chr) AS v FROM a, na, wd JOIN a hi ON hi.i = least(n - 1, a.i + d) GROUP BY a.i)
, re AS (SELECT i, least(c, u) AS u, least(c, v) AS v FROM rc JOIN ru USING (i) JOIN rd USING (i))
, ob AS (SELECT a.m1 AS k, b.m2 AS j, count(DISTINCT a.i) AS o FROM a JOIN re USING (i) JOIN a b ON b.i BETWEEN a.i - u AND a.i + v - 1 GROUP BY ALL)
, ca AS (SELECT m1 AS k, count(*) / (SELECT CAST(n AS DOUBLE) FROM na) AS ca FROM a GROUP BY m1), cb AS (SELECT m2 AS j, count(*) / (SELECT CAST(n AS DOUBLE) FROM na) AS cb FROM a GROUP BY m2)
SELECT k, j, round(o / n::DOUBLE, 6) AS joint, round(o / n::DOUBLE / (ca + cb - o / n::DOUBLE), 6) AS iou FROM ob JOIN ca USING (k) JOIN cb USING (j), na"""


@query("contiguous_iou_together", _TOGETHER)
def _(spark, d):
    active = core.position_index_by(ranges.overlap_join(paired(spark, d), intervals(spark, d), "left_semi").withColumnRenamed("idx", "was"), "was")
    return r6(enrich.contiguous_overlap(active, LABELS, W, together=True), "joint", "iou")


_RUNS = "WITH w AS (SELECT c_custkey, c_mktsegment AS model, n_name AS cell FROM customer JOIN nation ON c_nationkey = n_nationkey), rs AS (SELECT o_orderpriority AS setting, model, cell, o_orderstatus AS state, count(*) AS n, avg(o_totalprice) / 500000 AS auc, max(o_totalprice) / 500000 AS max_auc, min(o_totalprice) / 1000000 AS p, avg(o_totalprice) / max(o_totalprice) AS r2 FROM orders JOIN w ON o_custkey = c_custkey GROUP BY ALL), st AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY setting, model, cell) AS DOUBLE) AS coverage FROM rs)"


@query("run_areas", _RUNS + ", rt AS (SELECT setting, model, cell, sum(auc * coverage) AS auc, sum(max_auc * coverage) AS max_auc FROM st GROUP BY ALL) SELECT CASE grouping_id(setting, model, cell) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS level, setting, model, cell, count(*) AS n, round(avg(auc), 6) AS auc, round(avg(auc / max_auc), 6) AS ratio FROM rt GROUP BY GROUPING SETS ((setting, model, cell), (setting, model), (setting))", plain=True)
def _(spark, d):
    runs = rollups.run_totals(run_states(spark, d), ["auc", "max_auc"], "coverage")
    found = rollups.levels(runs, [["setting", "model", "cell"], ["setting", "model"], ["setting"]], {"auc": F.avg("auc"), "ratio": F.avg(F.col("auc") / F.col("max_auc"))})
    return r6(found, "auc", "ratio")


@query("run_states", _RUNS + " SELECT CASE grouping_id(model, setting, state) WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS level, model, setting, state, count(*) AS n, round(avg(-ln(p + 1e-19)), 6) AS minus_log_p, round(max(-ln(p + 1e-19)), 6) AS most, round(sum(r2 * coverage) / sum(coverage), 6) AS r2 FROM st GROUP BY GROUPING SETS ((model, setting, state), (model, state), (state))", plain=True)
def _(spark, d):
    states = run_states(spark, d)
    long = states.select(*rollups.RUN, "state", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("p", "r2", "coverage")])).alias("c")).select(*rollups.RUN, "state", "c.*")
    wide = rollups.state_metrics(long, {"p": "p", "r2": "r2", "coverage": "coverage"}).withColumn("l", rollups.minus_log_p("p"))
    weighted = F.sum(F.col("r2") * F.col("coverage")) / F.sum("coverage")
    found = rollups.levels(wide, [["model", "setting", "state"], ["model", "state"], ["state"]], {"minus_log_p": F.avg("l"), "most": F.max("l"), "r2": weighted})
    return r6(found, "minus_log_p", "most", "r2")


def _lloyd(k: int, rounds: int) -> str:
    """CTEs of k-means on lists ``e`` by label: farthest-first centres, then rounds of means (more than it takes change nothing)."""
    out = "WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM u GROUP BY ALL), p AS (SELECT label, list(x ORDER BY i) AS e FROM c GROUP BY label), mn AS (SELECT list(x ORDER BY i) AS e FROM (SELECT i, avg(x) AS x FROM c GROUP BY i))"
    out += ", s0 AS (SELECT p.e FROM p, mn ORDER BY list_distance(p.e, mn.e) DESC, label LIMIT 1)"
    for i in range(1, k):
        near = "least(" + ", ".join(f"list_distance(p.e, s{j}.e)" for j in range(i)) + ")"
        out += f", s{i} AS (SELECT p.e FROM p, {', '.join(f's{j}' for j in range(i))} ORDER BY {near} DESC, label LIMIT 1)"
    out += ", z0 AS (" + " UNION ALL ".join(f"SELECT {i} AS g, e FROM s{i}" for i in range(k)) + ")"
    for i in range(rounds):
        out += f", a{i} AS (SELECT label, g FROM (SELECT label, g, row_number() OVER (PARTITION BY label ORDER BY list_distance(p.e, z{i}.e), g) AS r FROM p, z{i}) WHERE r = 1), z{i + 1} AS (SELECT g, list(x ORDER BY i) AS e FROM (SELECT g, i, avg(x) AS x FROM a{i} JOIN c USING (label) GROUP BY g, i) GROUP BY g)"
    return out + f" SELECT label, CAST(dense_rank() OVER (ORDER BY first) - 1 AS INTEGER) AS cluster FROM (SELECT label, min(label) OVER (PARTITION BY g) AS first FROM a{rounds - 1})"


@query("state_clusters", _lloyd(3, 8), plain=True)
def _(spark, d):
    return merging.clusters(profiles.centroids(read(spark, d, "embeddings"), "label", "embedding"), 3)


@query("binned_overlap_own", more.base.SQL["binned_overlap"].removeprefix(base.WITH).replace("SELECT min(list_min(p1)) AS lo, max(list_max(p1)) AS hi FROM t", "SELECT min(list_min(p1)) AS lo, max(list_max(p1)) AS hi, min(list_min(p2)) AS lo2, max(list_max(p2)) AS hi2 FROM t").replace("floor((p2[la + 1] - lo) / (hi - lo) * 10)", "floor((p2[la + 1] - lo2) / (hi2 - lo2) * 10)").replace("p2[la + 1] >= lo AND p2[la + 1] < hi)", "p2[la + 1] >= lo2 AND p2[la + 1] < hi2)"))
def _(spark, d):
    return r6(enrich.binned_overlap(paired(spark, d), LABELS, own_cells=True), "overlap", "iou")


@query("label_agreement", "SELECT k, count(*) FILTER (m1 = m2) AS agreed, count(idx) AS rows, round(count(*) FILTER (m1 = m2) / CAST(nullif(count(idx), 0) AS DOUBLE), 6) AS agreement FROM l LEFT JOIN t ON m1 = k GROUP BY k")
def _(spark, d):
    return r6(overlap.label_agreement(paired(spark, d), LABELS), "agreement")


_P = labels._NORMAL
_CONTRASTS = profile_queries._RX + """, rk AS (SELECT map, r >= 0.9 AS sure, idx, ln(tpm + 1e-19) AS v, rank() OVER (PARTITION BY map ORDER BY ln(tpm + 1e-19)) + (count(*) OVER (PARTITION BY map, ln(tpm + 1e-19)) - 1) / 2.0::DOUBLE AS g FROM rx)
, ag AS (SELECT map, count(*) FILTER (sure)::DOUBLE AS n1, count(*) FILTER (NOT sure)::DOUBLE AS n0, avg(v) FILTER (sure) - avg(v) FILTER (NOT sure) AS diff, coalesce(var_samp(v) FILTER (sure), 0) AS v1, coalesce(var_samp(v) FILTER (NOT sure), 0) AS v0, sum(g) FILTER (sure) AS rs FROM rk GROUP BY map)
, ti AS (SELECT map, sum(c * (c * c - 1)) AS ties FROM (SELECT map, v, count(*)::DOUBLE AS c FROM rk GROUP BY ALL) GROUP BY map)
, zt AS (SELECT *, rs - n1 * (n1 + n0 + 1) / 2 AS off, diff / nullif(sqrt((v1 * (n1 - 1) + v0 * (n0 - 1)) / nullif(n1 + n0 - 2, 0) * (1 / nullif(n1, 0) + 1 / nullif(n0, 0))), 0) AS t FROM ag JOIN ti USING (map))
, zr AS (SELECT *, sign(off) * greatest(abs(off) - 0.5, 0) / nullif(sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))), 0) AS z FROM zt)
SELECT map, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, round(n1 / nullif(n0, 0), 6) AS ratio, round(diff, 6) AS mean_diff, round(t, 6) AS t, round(z, 6) AS z_rank, round(pr, 6) AS p_rank FROM (SELECT *, """ + _P + " AS pr FROM (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS u FROM zr))"


@query("confident_contrasts", _CONTRASTS)
def _(spark, d):
    rows = profile_queries._rx(spark, d)
    rows = rows.withColumns({"v": F.ln(F.col("tpm") + 1e-19), "sure": F.col("r_value") >= 0.9})
    found = statistics.contrasts(rows, "map", "v", F.col("sure"), "idx")
    return r6(found.select("map", "n1", "n0", "ratio", "mean_diff", "t", "z_rank", "p_rank"), "ratio", "mean_diff", "t", "z_rank", "p_rank")


_W3 = ", v3 AS (SELECT t.idx, t.m1, u.m2 AS j FROM t JOIN t u ON u.idx BETWEEN t.idx - 3 AND t.idx + 2 AND u.idx < (SELECT n - 1 FROM n) GROUP BY ALL), i3 AS (SELECT kj.k, kj.j, kj.ja, o, o / nullif(c1.c1 + c2.c2 - o, 0) AS iou FROM (SELECT kj.k, kj.j, count(v3.idx) / (SELECT CAST(n AS DOUBLE) FROM n) AS o FROM kj LEFT JOIN v3 ON v3.m1 = kj.k AND v3.j = kj.j GROUP BY ALL) JOIN kj USING (k, j) JOIN c1 USING (k) JOIN c2 USING (j)), q3 AS (SELECT k, j FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY iou DESC NULLS LAST, ja) AS rn FROM i3) WHERE iou > 0.6 OR rn = 1)"


@query("reproduced_by_map", _W3 + ", z AS (SELECT DISTINCT t.idx FROM t JOIN q3 ON q3.k = t.m1 JOIN t u ON u.m2 = q3.j AND u.idx BETWEEN t.idx - 3 AND t.idx + 2) SELECT m1, count(z.idx) AS reproduced, count(*) AS n FROM t LEFT JOIN z USING (idx) GROUP BY m1")
def _(spark, d):
    return calibrate.reproduced_by_map(paired(spark, d), LABELS, 3, 0.6).groupBy("m1").agg(F.count_if("is_repr").alias("reproduced"), F.count("*").alias("n"))


_ONE = ", z AS (SELECT DISTINCT t.idx FROM t JOIN q ON q.k = t.m1 JOIN v ON v.idx = t.idx AND v.j = q.j), sp AS (SELECT true AS posterior, map AS m1, r, round(r, 9) >= 0.9 AS ok FROM rv UNION ALL SELECT false, m1, NULL, z.idx IS NOT NULL FROM t LEFT JOIN z USING (idx))"


@query("single_point", base._CURVE + _ONE + " SELECT posterior, m1, count(*) FILTER (ok) AS reproduced, count(*) AS n, round(avg(r), 6) AS mean_r FROM sp GROUP BY posterior, m1")
def _(spark, d):
    p = paired(spark, d)
    own = matches(p)
    both = [calibrate.single_point(p, LABELS, kind, W, TO, 0.9, BINS, own).withColumn("posterior", F.lit(kind)) for kind in (True, False)]
    counted = both[0].unionByName(both[1]).groupBy("posterior", "m1").agg(F.count_if("is_repr").alias("reproduced"), F.count("*").alias("n"), F.avg("r_value").alias("mean_r"))
    return r6(counted, "mean_r")


@query("runs_in_order", _RUNS + ", d AS (SELECT DISTINCT model, setting FROM st), o AS (SELECT *, CASE setting WHEN '2-HIGH' THEN 0 WHEN '1-URGENT' THEN 1 END AS p FROM d) SELECT model, setting, CAST(CASE WHEN p IS NULL THEN 1 + dense_rank() OVER (PARTITION BY p IS NULL ORDER BY setting) ELSE p END AS INTEGER) AS place FROM o", plain=True)
def _(spark, d):
    return rollups.in_order(run_states(spark, d).select("model", "setting").distinct(), "setting", ["2-HIGH", "1-URGENT"])
