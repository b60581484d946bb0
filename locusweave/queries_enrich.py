"""Queries of the enrichments and sweeps, registered beside those of the tracks, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries as base
from .operators import enrich, profiles, ranges, sweeps
from .plans.adapters import LABELS, genes, intervals, paired, tss
from .queries import TO, W, query, r6

_LG = ", lg AS (SELECT t.idx, l.k, t.p1[la + 1] AS p, t.m1 FROM t, l)"
_GB = base._GE + _LG + ", ch AS (SELECT idx, arg_max(tpm, gene_id) AS tpm FROM t JOIN ge ON t.chr = ge.chr AND ((t.s BETWEEN ge.s AND ge.e) OR (t.e BETWEEN ge.s AND ge.e)) GROUP BY idx)"
_TB = base._TS + _LG + ", ch AS (SELECT DISTINCT idx, 0.0 AS tpm FROM t JOIN ts ON t.chr = ts.chr AND t.s < coord AND coord < t.e)"


def _sql(chosen: str, bins: int, by_chosen: bool, columns: str) -> str:
    of, n = ("JOIN ch USING (idx)", "(SELECT count(*) FROM ch)") if by_chosen else ("", "(SELECT n FROM n)")
    return chosen + f", mk AS (SELECT lg.*, ch.tpm, ch.idx IS NOT NULL AS own FROM lg LEFT JOIN ch USING (idx)), rg AS (SELECT k, b, min(p) AS low, max(p) AS high FROM (SELECT k, p, (row_number() OVER (PARTITION BY k ORDER BY p, idx) - 1) // greatest(1, {n} // {bins}) AS b FROM lg {of}) GROUP BY k, b) SELECT rg.k, b, round(low, 6) AS low, round(high, 6) AS high, {columns} FROM rg JOIN mk ON mk.k = rg.k AND mk.p BETWEEN low AND high GROUP BY rg.k, b, low, high HAVING count_if(own) > 0"


_ENR = "round(ln((count_if(own) / CAST((SELECT count(*) FROM ch) AS DOUBLE)) / (count(*) / CAST((SELECT n FROM n) AS DOUBLE))), 6) AS enrichment"
_MAP = "round(avg(CASE WHEN m1 = rg.k THEN 1.0 ELSE 0.0 END), 6) AS map_share"
_TPM = "round(avg(tpm), 6) AS mean_tpm"


def _stratified(spark, d, chosen, bins, by_chosen, *columns):
    p = paired(spark, d)
    found = enrich.stratified(profiles.by_label(p, LABELS, "idx", "m1"), chosen(p), bins, by_chosen)
    return r6(found, "low", "high", *columns).select("k", "b", "low", "high", *columns)


@query("gene_enrichment_by_posterior", _sql(_GB, 40, False, _ENR))
def _(spark, d):
    return _stratified(spark, d, lambda p: ranges.endpoint_join(p, genes(spark, d)).select("idx", "tpm"), 40, False, "enrichment")


@query("tss_enrichment_by_posterior", _sql(_TB, 30, True, f"{_ENR}, {_MAP}"))
def _(spark, d):
    return _stratified(spark, d, lambda p: ranges.point_join(p.select("idx", "chr", "start", "end"), tss(spark, d)).select("idx", F.lit(0.0).alias("tpm")), 30, True, "enrichment", "map_share")


@query("tpm_by_posterior", _sql(_GB, 30, True, f"{_TPM}, {_MAP}"))
def _(spark, d):
    return _stratified(spark, d, lambda p: ranges.endpoint_join(p, genes(spark, d)).select("idx", "tpm"), 30, True, "mean_tpm", "map_share")


@query("binned_overlap", ", ed AS (SELECT min(list_min(p1)) AS lo, max(list_max(p1)) AS hi FROM t), x AS (SELECT idx, k, CAST(floor((p1[la + 1] - lo) / (hi - lo) * 10) AS BIGINT) AS b1 FROM t, l, ed WHERE p1[la + 1] >= lo AND p1[la + 1] < hi), y AS (SELECT idx, k AS j, CAST(floor((p2[la + 1] - lo) / (hi - lo) * 10) AS BIGINT) AS b2 FROM t, l, ed WHERE p2[la + 1] >= lo AND p2[la + 1] < hi), xn AS (SELECT k, b1, count(*) AS n1 FROM x GROUP BY ALL), yn AS (SELECT j, b2, count(*) AS n2 FROM y GROUP BY ALL), o AS (SELECT k, b1, j, b2, count(*) AS o FROM x JOIN y USING (idx) GROUP BY ALL) SELECT k, b1, j, b2, round(o / CAST((SELECT n FROM n) AS DOUBLE), 6) AS overlap, round(o / CAST(n1 + n2 - o AS DOUBLE), 6) AS iou FROM o JOIN xn USING (k, b1) JOIN yn USING (j, b2)")
def _(spark, d):
    return r6(enrich.binned_overlap(paired(spark, d), LABELS), "overlap", "iou")


@query("contiguous_iou", base._IV + f", a AS (SELECT idx, chr, m1, m2 FROM t WHERE EXISTS (SELECT 1 FROM iv WHERE iv.chr = t.chr AND iv.s < t.e AND t.s < iv.e)), a1 AS (SELECT *, idx - row_number() OVER (PARTITION BY chr ORDER BY idx) AS g FROM a), xs AS (SELECT *, max(idx) OVER (PARTITION BY chr, g) AS z FROM a1), na AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM a), ob AS (SELECT x.m1 AS k, u.m2 AS j, count(DISTINCT x.idx) AS o FROM xs x JOIN xs u ON x.chr = u.chr AND x.g = u.g AND u.idx BETWEEN x.idx - {W} AND least(x.idx + {W}, x.z) - 1 GROUP BY ALL), ca AS (SELECT m1 AS k, count(*) / (SELECT n FROM na) AS c1 FROM a GROUP BY m1), cb AS (SELECT m2 AS j, count(*) / (SELECT n FROM na) AS c2 FROM a GROUP BY m2) SELECT k, j, round(o / n, 6) AS joint, round(o / n / (ca.c1 + cb.c2 - o / n), 6) AS iou FROM ob JOIN ca USING (k) JOIN cb USING (j), na")
def _(spark, d):
    active = ranges.overlap_join(paired(spark, d), intervals(spark, d), "left_semi")
    return r6(enrich.contiguous_overlap(active, LABELS, W), "joint", "iou")


_PERMUTED = " AND ".join(f"o{a}.ja <> o{b}.ja" for a in range(5) for b in range(a))


@query("matched_bins", ", oe AS (SELECT k, j, ka, ja, ln((o * n + 1e-3) / (c1 * c2 * n + 1e-3)) AS v FROM i0, n), pm AS (SELECT [" + ", ".join(f"o{i}.j" for i in range(5)) + "] AS js, " + " + ".join(f"o{i}.v" for i in range(5)) + " AS v FROM " + ", ".join(f"(SELECT * FROM oe WHERE ka = {i}) o{i}" for i in range(5)) + f" WHERE {_PERMUTED}), bm AS (SELECT arg_max(js, v) AS js FROM pm) SELECT idx, m1, m2, js[la + 1] AS matched, js[la + 1] = m2 AS reproduced FROM t JOIN l ON k = m1, bm")
def _(spark, d):
    return enrich.matched_bins(paired(spark, d), LABELS)


@query("feature_enrichment", base._TS + ", rw AS (SELECT m1 AS label, off, count(*) AS n FROM t JOIN (SELECT chr, coord, unnest(range(-5, 5)) AS off FROM ts) x ON t.chr = x.chr AND t.s = (coord // 200 + off) * 200 GROUP BY ALL), tt AS (SELECT off, sum(n) AS total FROM rw GROUP BY off), bs AS (SELECT m1 AS label, sum(e - s) / CAST((SELECT sum(e - s) FROM t) AS DOUBLE) AS share FROM t GROUP BY m1) SELECT label, CASE WHEN off < 0 THEN 'upstream' ELSE 'downstream' END AS component, round(avg(log2((coalesce(n, 0) + 1) / CAST(total AS DOUBLE) / share)), 6) AS enrichment FROM tt CROSS JOIN bs LEFT JOIN rw USING (label, off) GROUP BY ALL")
def _(spark, d):
    p = paired(spark, d)
    bases = p.groupBy(F.col("m1").alias("label")).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    return r6(enrich.feature_enrichment(enrich.around_points(p, tss(spark, d), 200, 5), bases, LABELS), "enrichment")


_TH = [i / 10 for i in range(10)]
_SHARES = ", th AS (SELECT unnest(range(0, 10)) / 10.0::DOUBLE AS t), lb AS (SELECT w, m1 AS label, best FROM bs UNION ALL SELECT w, 'all', best FROM bs) SELECT w, t, label, round(avg(CASE WHEN best {op} t THEN 1.0 ELSE 0.0 END), 6) AS share FROM lb, th GROUP BY ALL"


@query("overlap_contour", f", bs AS (SELECT 0 AS w, t.idx, t.m1, iou AS best FROM t JOIN i0 ON k = m1 AND j = m2 UNION ALL SELECT {W}, t.idx, t.m1, max(iou) FROM t LEFT JOIN v ON v.idx = t.idx LEFT JOIN i5 ON i5.k = t.m1 AND i5.j = v.j GROUP BY t.idx, t.m1)" + _SHARES.format(op=">"))
def _(spark, d):
    return r6(sweeps.overlap_contour(paired(spark, d), LABELS, _TH, [0, W]), "share")


@query("r_contour", base._CURVE + f", bs AS (SELECT {W} AS w, idx, map AS m1, round(r, 9) AS best FROM rv)" + _SHARES.format(op=">="))
def _(spark, d):
    return r6(sweeps.r_contour(paired(spark, d), LABELS, _TH, [W]), "share")


_BACK = f", vb AS (SELECT t.idx, t.m2, u.m1 AS j FROM t JOIN t u ON u.idx BETWEEN t.idx - {W} AND t.idx + {W - 1} AND u.idx < (SELECT n - 1 FROM n) GROUP BY ALL), hb AS (SELECT m2 AS k, j, count(*) / (SELECT CAST(n AS DOUBLE) FROM n) AS o FROM vb GROUP BY ALL), ib AS (SELECT kj.k, kj.j, ja, coalesce(o, 0) / nullif(c2 + c1 - coalesce(o, 0), 0) AS iou FROM kj LEFT JOIN hb USING (k, j) JOIN c2 ON c2.j = kj.k JOIN c1 ON c1.k = kj.j), qb AS (SELECT k, j FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY iou DESC NULLS LAST, ja) AS rn, max(iou) OVER (PARTITION BY k) AS best FROM ib) WHERE iou > {TO} OR (rn = 1 AND NOT coalesce(best > {TO}, false)))"
#: As windows of the flags show the table's last row, too.
_FLAGS = f", fa AS (SELECT DISTINCT t.idx FROM t JOIN q ON q.k = t.m1 JOIN t u ON u.m2 = q.j AND u.idx BETWEEN t.idx - {W} AND t.idx + {W - 1}), fb AS (SELECT DISTINCT t.idx FROM t JOIN qb ON qb.k = t.m2 JOIN t u ON u.m1 = qb.j AND u.idx BETWEEN t.idx - {W} AND t.idx + {W - 1}), kp AS (SELECT * FROM t JOIN fa USING (idx) JOIN fb USING (idx))"
_NMI = "(SELECT mi / hc FROM (SELECT sum(o * log2(o / (r * c))) AS mi FROM (SELECT o, sum(o) OVER (PARTITION BY k) AS r, sum(o) OVER (PARTITION BY j) AS c FROM {h})), (SELECT -sum(c * log2(c)) AS hc FROM (SELECT sum(o) AS c FROM {h} GROUP BY j)))"


@query("nmi_after", _BACK + _FLAGS + ", ha AS (SELECT k, j, o FROM h0 WHERE o > 0), hk AS (SELECT m1 AS k, m2 AS j, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM kp) AS o FROM kp GROUP BY ALL) SELECT round((SELECT count(*) FROM kp) / CAST(n AS DOUBLE), 6) AS kept, round(" + _NMI.format(h="ha") + ", 6) AS before, round(" + _NMI.format(h="hk") + ", 6) AS after FROM n")
def _(spark, d):
    return r6(sweeps.nmi_after(paired(spark, d), LABELS, W, TO), "kept", "before", "after")
