"""Queries of labels, merging and rank statistics, registered beside those of the tracks, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries as base
from . import queries_enrich as more
from . import queries_profiles as profile_queries
from .operators import calibrate, core, enrich, labels, match, merging, overlap, profiles, ranges, spatial, statistics
from .plans.adapters import LABELS, genes, intervals, paired, read, tss
from .queries import _LIST, TO, W, matches, query, r6

_LONG = profile_queries._LONG
_BEST = ", oe AS (SELECT k, j, ka, ja, coalesce(iou, 0) AS v FROM i0), pm AS (SELECT [" + ", ".join(f"o{i}.j" for i in range(5)) + "] AS js FROM " + ", ".join(f"(SELECT * FROM oe WHERE ka = {i}) o{i}" for i in range(5)) + f" WHERE {more._PERMUTED} ORDER BY " + " + ".join(f"o{i}.v" for i in range(5)) + " DESC LIMIT 1), hg AS (SELECT k, j, v FROM oe JOIN pm ON j = js[ka + 1])"
base.SQL["hungarian"] = base.WITH + _BEST + "SELECT k, j, round(v, 6) AS value FROM hg"
_GAIN = """, mg AS (SELECT x.k AS a, y.k AS b, x.la AS xa, y.la AS ya FROM l x, l y WHERE x.la < y.la)
, mr AS (SELECT a, b, CASE WHEN h0.k IN (a, b) THEN 'merged' ELSE h0.k END AS r, j, sum(o) AS o FROM mg, h0 GROUP BY ALL)
, ma AS (SELECT a, b, sum(CASE WHEN o > 0 THEN o * log2(o / (rs * cs)) ELSE 0 END) AS mi FROM (SELECT *, sum(o) OVER (PARTITION BY a, b, r) AS rs, sum(o) OVER (PARTITION BY a, b, j) AS cs FROM mr) GROUP BY a, b)
, mh AS (SELECT a, b, -sum(rs * log2(rs + 1e-9)) AS h FROM (SELECT a, b, r, sum(o) AS rs FROM mr GROUP BY ALL) GROUP BY a, b)
, m0 AS (SELECT sum(CASE WHEN o > 0 THEN o * log2(o / (rs * cs)) ELSE 0 END) AS mi0, (SELECT -sum(rs * log2(rs + 1e-9)) FROM (SELECT sum(o) AS rs FROM h0 GROUP BY k)) AS h0 FROM (SELECT *, sum(o) OVER (PARTITION BY k) AS rs, sum(o) OVER (PARTITION BY j) AS cs FROM h0))
, gn AS (SELECT a, b, xa, ya, 1 - (mi - mi0) / (h - m0.h0) AS g FROM mg JOIN ma USING (a, b) JOIN mh USING (a, b), m0)
"""
base.SQL["merge_gain"] = base.WITH + _GAIN + "SELECT a AS k, b AS j, round(g, 6) AS gain FROM gn UNION ALL SELECT b, a, round(g, 6) FROM gn"


def _cells(p):
    return match.to_array(overlap.joint(p, LABELS), LABELS, "joint")


def _long(p, column: str):
    return p.select("idx", F.explode(F.array(*[F.struct(F.lit(x).alias("k"), F.col(column)[i].alias("p")) for i, x in enumerate(LABELS)])).alias("c")).select("idx", "c.*")


@query("best_merge", _GAIN + "SELECT a, b, round(g, 6) AS gain FROM gn ORDER BY g DESC, xa, ya LIMIT 1")
def _(spark, d):
    gain = match.merging_gain(_cells(paired(spark, d)))
    i, j = merging.best_pair(gain)
    return spark.createDataFrame([(LABELS[i], LABELS[j], round(float(gain[i, j]), 6))], "a string, b string, gain double")


@query("merged_track", _GAIN + f", bs AS (SELECT a, b, xa + 1 AS ia, ya + 1 AS ib FROM gn ORDER BY g DESC, xa, ya LIMIT 1), rp AS (SELECT t.p1, a, b, p1[ia] + p1[ib] AS pab, list_filter(range(1, 6), lambda i: i <> ia AND i <> ib) AS ri FROM t, bs), rq AS (SELECT *, list_transform(ri, lambda i: p1[i]) AS rest FROM rp) SELECT CASE WHEN pab > list_max(rest) THEN a || '+' || b ELSE ({_LIST})[ri[list_position(rest, list_max(rest))]] END AS label, count(*) AS n FROM rq GROUP BY 1")
def _(spark, d):
    p = paired(spark, d)
    one = merging.merged([[i] for i in range(5)], merging.best_pair(match.merging_gain(_cells(p))))
    return merging.grouped(p, LABELS, one, [[i] for i in range(5)]).groupBy(F.col("m1").alias("label")).agg(F.count("*").alias("n"))


@query("merge_progress")
def _(spark, d):
    progress, _, _ = merging.merge_progress(paired(spark, d), LABELS)
    return spark.createDataFrame([(n, *(round(x, 6) for x in rest)) for n, *rest in progress], "labels int, entropy double, mi double, nmi double, naive double")


@query("keep_states")
def _(spark, d):
    return merging.keep_states(paired(spark, d), LABELS, 3).groupBy("m1", "m2").agg(F.count("*").alias("n"))


@query("row_similarity", "SELECT a.k, b.k AS j, CASE WHEN a.k = b.k THEN 1.0::DOUBLE ELSE round(sqrt(max(coalesce(a.iou, 0) * coalesce(b.iou, 0))), 6) END AS value FROM i0 a JOIN i0 b ON a.j = b.j GROUP BY a.k, b.k")
def _(spark, d):
    found = merging.row_similarity(match.to_array(overlap.overlap(paired(spark, d), LABELS, "iou"), LABELS))
    return spark.createDataFrame([(a, b, round(float(found[i, j]), 6)) for i, a in enumerate(LABELS) for j, b in enumerate(LABELS)], "k string, j string, value double")


_TWO_WAY = more._BACK + ", bd AS (SELECT k, j, count(*) AS c FROM (SELECT k, j FROM q UNION ALL SELECT j AS k, k AS j FROM qb) GROUP BY k, j), dm AS (SELECT k, j FROM (SELECT *, max(c) OVER (PARTITION BY k) AS m FROM bd WHERE k IN (SELECT k FROM q)) WHERE c = m)"


def _dynamic(p):
    back = p.select("idx", F.col("p2").alias("p1"), F.col("p1").alias("p2"), F.col("m2").alias("m1"), F.col("m1").alias("m2"))
    return merging.dynamic_matches(matches(p), matches(back))


@query("dynamic_matches", _TWO_WAY + "SELECT k, j FROM dm")
def _(spark, d):
    return spark.createDataFrame([(k, j) for k, js in _dynamic(paired(spark, d)).items() for j in js], "k string, j string")


@query("reproduced_with_prior", _TWO_WAY + f", z AS (SELECT DISTINCT t.idx FROM t JOIN dm ON dm.k = t.m1 JOIN t u ON u.m2 = dm.j AND u.idx BETWEEN t.idx - {W} AND t.idx + {W - 1} AND u.idx < (SELECT n - 1 FROM n)) SELECT m1, count(*) FILTER (list_max(p1) >= 0.6 OR z.idx IS NOT NULL) AS reproduced, count(*) AS n FROM t LEFT JOIN z USING (idx) GROUP BY m1")
def _(spark, d):
    p = paired(spark, d)
    found = spatial.reproduced(p, _dynamic(p), W, hide_last=True, prior=F.array_max("p1") >= 0.6)
    return found.groupBy("m1").agg(F.count_if("is_repr").alias("reproduced"), F.count("*").alias("n"))


@query("window_max", f"SELECT idx, round(max(list_max(p1)) OVER (ORDER BY idx ROWS BETWEEN {W} PRECEDING AND {W - 1} FOLLOWING), 6) AS top FROM t")
def _(spark, d):
    return r6(statistics.window_max(paired(spark, d).select("idx", F.array_max("p1").alias("top")), "top", W), "top")


@query("corr_by_offset_both", ", z AS (SELECT t.idx, t.m1, g, min(h) AS h FROM (SELECT t.idx, t.m1, g, sd, max(CASE WHEN q.j IS NULL THEN 0.0 ELSE 1.0 END) AS h FROM t, range(0, 11) r(g), (SELECT unnest([-1, 1]) AS sd) JOIN t u ON u.idx = greatest(0, least((SELECT n - 1 FROM n), t.idx + sd * g)) LEFT JOIN q ON q.k = t.m1 AND q.j = u.m2 GROUP BY ALL) t GROUP BY ALL) SELECT m1, CAST(g AS INTEGER) AS d, round(avg(h), 6) AS share FROM z GROUP BY m1, g")
def _(spark, d):
    p = paired(spark, d)
    return r6(spatial.correspondence_by_offset(p, matches(p), 10, both=True), "share")


@query("corr_slope")
def _(spark, d):
    return r6(spatial.slope(base.Q["corr_curve"](spark, d), "k", "t", "psi"), "slope")


base.SQL["corr_slope"] = "SELECT k, t, psi, round((coalesce(lead(psi) OVER o, psi) - coalesce(lag(psi) OVER o, psi)) / (coalesce(lead(t) OVER o, t) - coalesce(lag(t) OVER o, t)), 6) AS slope FROM (" + base.SQL["corr_curve"] + ") WINDOW o AS (PARTITION BY k ORDER BY t)"


@query("contiguous_segments", base._IV + ", a AS (SELECT idx, chr, s, e, m1 FROM t WHERE EXISTS (SELECT 1 FROM iv WHERE iv.chr = t.chr AND iv.s < t.e AND t.s < iv.e)), b AS (SELECT *, sum(CASE WHEN pi = idx - 1 AND pm = m1 AND pc = chr AND pe = s THEN 0 ELSE 1 END) OVER (ORDER BY idx) AS g FROM (SELECT *, lag(idx) OVER w AS pi, lag(m1) OVER w AS pm, lag(chr) OVER w AS pc, lag(e) OVER w AS pe FROM a WINDOW w AS (ORDER BY idx))) SELECT chr, min(s) AS start, max(e) AS \"end\", m1 AS label, count(*) AS n FROM b GROUP BY g, chr, m1")
def _(spark, d):
    active = ranges.overlap_join(paired(spark, d), intervals(spark, d), "left_semi")
    return spatial.segments(active, gap_aware=True)


@query("soft_nmi", ", sj AS (SELECT k, j, avg(p1[ka + 1] * p2[ja + 1]) AS o, avg(p1[ka + 1]) AS a, avg(p2[ja + 1]) AS b FROM t, kj GROUP BY k, j) SELECT round(mi, 6) AS mi, round(mi / h, 6) AS nmi FROM (SELECT sum(CASE WHEN o > 0 THEN o * log2(o / (a * b)) ELSE 0 END) AS mi FROM sj), (SELECT -sum(b * log2(b)) AS h FROM (SELECT DISTINCT j, b FROM sj) WHERE b > 0)")
def _(spark, d):
    return r6(statistics.soft_information(paired(spark, d), LABELS), "mi", "nmi")


_RANK = "rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0::DOUBLE"
_NORMAL = "2 * exp(-z * z / 2) / 2.5066282746310002 * (u * (0.319381530 + u * (-0.356563782 + u * (1.781477937 + u * (-1.821255978 + u * 1.330274429)))))"


@query("expression_spearman", profile_queries._RX + ", rr AS (SELECT map, round(r, 9) AS r, tpm FROM rx) SELECT map, count(*) AS n, round(corr(a, b), 6) AS spearman FROM (SELECT map, " + _RANK.format(k="map", v="r") + " AS a, " + _RANK.format(k="map", v="tpm") + " AS b FROM rr) GROUP BY map")
def _(spark, d):
    rows = profile_queries._rx(spark, d).withColumn("r_value", F.round("r_value", 9))
    return r6(statistics.spearman(rows, "map", "r_value", "tpm"), "spearman")


@query("posterior_wilcoxon", ", df AS (SELECT k, round(p1[la + 1] - p2[la + 1], 9) AS d FROM t, l WHERE round(p1[la + 1] - p2[la + 1], 9) <> 0), rk AS (SELECT k, d, " + _RANK.format(k="k", v="abs(d)") + " AS r FROM df), ag AS (SELECT k, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0.0 END) AS w FROM rk GROUP BY k), zz AS (SELECT *, (w - n * (n + 1) / 4.0::DOUBLE) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24) AS z FROM ag) SELECT k, n, round(w, 6) AS w, round(z, 6) AS z, round(" + _NORMAL + ", 6) AS p FROM (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS u FROM zz)")
def _(spark, d):
    rows = paired(spark, d).select(F.explode(F.array(*[F.struct(F.lit(x).alias("k"), (F.col("p1")[i] - F.col("p2")[i]).alias("d")) for i, x in enumerate(LABELS)])).alias("c")).select("c.*")
    return r6(statistics.signed_rank(rows, "k", "d"), "w", "z", "p")


@query("confident_contrast_p")
def _(spark, d):
    return r6(base.Q["confident_contrast"](spark, d).select("z", statistics.two_sided_p(F.col("z")).alias("p"), statistics.two_sided_p(F.col("t")).alias("p_t")), "p", "p_t")


base.SQL["confident_contrast_p"] = "SELECT z, round(" + _NORMAL + ", 6) AS p, round(" + _NORMAL.replace("-z * z", "-t * t").replace("u * ", "v * ") + ", 6) AS p_t FROM (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS u, 1 / (1 + 0.2316419 * abs(t)) AS v FROM (" + base.SQL["confident_contrast"] + "))"


@query("r_coverage", base._CURVE + "SELECT map, round(count(*) / CAST((SELECT n FROM n) AS DOUBLE), 6) AS share FROM rv GROUP BY map")
def _(spark, d):
    p = paired(spark, d)
    r = calibrate.r_values(p, LABELS, W, TO, base.BINS)
    return r6(r.groupBy("map").agg((F.count("*") / core.size(p)).alias("share")), "share")


@query("agreement_expected", "SELECT k, round(a, 6) AS agreement, round(CASE WHEN a > 0 THEN ln(a / (c2 + 1e-3)) END, 6) AS log_oe FROM (SELECT k, coalesce(avg(CASE WHEN m1 = m2 THEN 1.0 WHEN m1 <> m2 THEN 0.0 END), 0) AS a FROM l LEFT JOIN t ON m1 = k GROUP BY k) JOIN c2 ON j = k")
def _(spark, d):
    p = paired(spark, d)
    chance = overlap.coverage(p, LABELS, "m2").withColumnRenamed("coverage", "e")
    own = overlap.agreement(p, LABELS).join(F.broadcast(chance), "k")
    return r6(own.select("k", "agreement", F.when(F.col("agreement") > 0, F.ln(F.col("agreement") / (F.col("e") + 1e-3))).alias("log_oe")), "agreement", "log_oe")


@query("match_quality", _BEST + "SELECT k, round(v / ((SELECT sum(x.v) FROM oe x WHERE x.k = hg.k) + 1e-3), 6) AS own, round((SELECT sum(v) FROM hg) / (SELECT sum(v) FROM oe), 6) AS every FROM hg")
def _(spark, d):
    cells = match.to_array(overlap.overlap(paired(spark, d), LABELS, "iou"), LABELS)
    own, every = match.match_quality(cells, match.assignment(cells))
    return spark.createDataFrame([(x, round(float(own[i]), 6), round(every, 6)) for i, x in enumerate(LABELS)], "k string, own double, every double")


@query("matched_names", _BEST + "SELECT idx, a.k || '|' || a.j AS name1, b.k || '|' || b.j AS name2 FROM t JOIN hg a ON a.k = m1 JOIN hg b ON b.j = m2")
def _(spark, d):
    p = paired(spark, d)
    cells = match.to_array(overlap.overlap(p, LABELS, "iou"), LABELS)
    one, two = labels.paired_names([(LABELS[i], LABELS[j]) for i, j in match.assignment(cells)])
    return p.select("idx", labels.renamed("m1", one).alias("name1"), labels.renamed("m2", two).alias("name2"))


_MNEMONICS = ["0_Clicked_Lowest", "1_Errors", "3_Signups_High_Odd", "4_View"]


@query("mnemonic_labels", f"SELECT idx, ['0_Clic_Low', '1_Erro', '2_Unkn', '3_Unkn', '4_View'][list_position({_LIST}, m1)] AS label FROM t")
def _(spark, d):
    names = dict(zip(LABELS, labels.mnemonic_names(5, _MNEMONICS), strict=True))
    return paired(spark, d).select("idx", labels.renamed("m1", names).alias("label"))


@query("interpreted_labels", "SELECT CASE m1 WHEN 'click' THEN 'click' WHEN 'error' THEN 'err' WHEN 'purchase' THEN 'purchase' WHEN 'signup' THEN 'sign' ELSE 'view' END AS term, count(*) AS n FROM t GROUP BY 1")
def _(spark, d):
    terms = {x: labels.term_of(x, ["click", "err", "purch", "purchase", "sign", "up"]) for x in LABELS}
    return paired(spark, d).groupBy(labels.renamed("m1", terms).alias("term")).agg(F.count("*").alias("n"))


@query("arranged_posterior", "SELECT idx, round(p1[5], 6) AS first, round(p1[1], 6) AS last FROM t")
def _(spark, d):
    order = labels.ordered([f"{i}_{x}" for i, x in enumerate(LABELS)], ["view", "signup", "purchase", "error", "click"])
    p = labels.arranged("p1", LABELS, [x.split("_")[1] for x in order])
    return r6(paired(spark, d).select("idx", p[0].alias("first"), p[4].alias("last")), "first", "last")


@query("hardened_posterior", _LONG + "SELECT idx, k, CASE WHEN m1 = k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM lg")
def _(spark, d):
    return _long(paired(spark, d).select("idx", labels.hardened("p1").alias("p1")), "p1")


@query("grouped_posterior", "SELECT idx, round(p1[1] + p1[5], 6) AS seen, round(p1[2], 6) AS failed, round(p1[3] + p1[4], 6) AS won FROM t")
def _(spark, d):
    sums = labels.group_sums("p1", [[0, 4], [1], [2, 3]])
    return r6(paired(spark, d).select("idx", *[sums[i].alias(x) for i, x in enumerate(("seen", "failed", "won"))]), "seen", "failed", "won")


@query("merged_posterior", "SELECT idx, round(p1[1], 6) AS click, round(p1[3], 6) AS purchase, round(p1[4], 6) AS signup, round(p1[2] + p1[5], 6) AS both FROM t")
def _(spark, d):
    p, names = core.merge_labels("p1", LABELS, "error", "view")
    assert names == ["click", "purchase", "signup", "error+view"]
    return r6(paired(spark, d).select("idx", *[p[i].alias(x) for i, x in enumerate(("click", "purchase", "signup", "both"))]), "click", "purchase", "signup", "both")


@query("normalised_posterior", ", x AS (SELECT idx, list_transform(p1, lambda v: v * 3) AS p FROM t) SELECT idx, k, round(p[la + 1] / list_sum(p), 6) AS p FROM x, l")
def _(spark, d):
    tripled = paired(spark, d).select("idx", F.transform("p1", lambda v: v * 3).alias("p"))
    return r6(_long(tripled.select("idx", core.normalise("p").alias("p1")), "p1"), "p")


@query("sigmoid_of_logit", _LONG + "SELECT idx, k, round(p, 6) AS p FROM lg")
def _(spark, d):
    return r6(_long(paired(spark, d).select("idx", core.sigmoid(core.logit("p1")).alias("p1")), "p1"), "p")


def _both(rows, one, two):
    """(idx, k, one, two): two arrays by label, one row for each label."""
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("k"), F.col(one)[i].alias(one), F.col(two)[i].alias(two)) for i, x in enumerate(LABELS)]))
    return rows.select("idx", cells.alias("c")).select("idx", "c.*")


@query("capped_minus_log", _LONG + "SELECT idx, k, round(-ln(greatest(least(p, 1 - 1e-6), 1e-6)), 6) AS p, round(-ln(1 - greatest(least(p, 1 - 1e-6), 1e-6)), 6) AS q FROM lg")
def _(spark, d):
    safe = paired(spark, d).select("idx", labels.capped("p1", 1e-6).alias("p1"))
    p, q = labels.minus_log("p1"), labels.minus_log("p1", complement=True)
    return r6(_both(safe.select("idx", p.alias("p"), q.alias("q")), "p", "q"), "p", "q")


@query("rescaled_posterior", _LONG + "SELECT idx, k, round((p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER ()), 6) AS whole, round((p - min(p) OVER (PARTITION BY k)) / nullif(max(p) OVER (PARTITION BY k) - min(p) OVER (PARTITION BY k), 0), 6) AS own FROM lg")
def _(spark, d):
    p = paired(spark, d).select("idx", F.col("p1").alias("whole"), F.col("p1").alias("own"))
    scaled = labels.rescaled(labels.rescaled(p, "whole", LABELS, False), "own", LABELS, True)
    return r6(_both(scaled, "whole", "own"), "whole", "own")


@query("not_overconfident", "SELECT idx, m1 FROM t WHERE list_max(p1) < 1 AND list_max(p2) < 1")
def _(spark, d):
    return labels.without_overconfident(labels.complete(paired(spark, d))).select("idx", "m1")


@query("one_chromosome", "SELECT idx, m1, m2 FROM t WHERE chr = 'chr1'")
def _(spark, d):
    return paired(spark, d).where(F.col("chr") == "chr1").select("idx", "m1", "m2")


@query("each_hundredth", "SELECT idx, m1 FROM t WHERE idx % 100 = 0")
def _(spark, d):
    return labels.each_hundredth(paired(spark, d)).select("idx", "m1")


@query("concatenated_tracks", "SELECT chr || '_1' AS chr, m1 AS label, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT chr || '_2', m2, count(*) FROM t GROUP BY ALL")
def _(spark, d):
    p = paired(spark, d)
    both = labels.concatenated(p.select("chr", F.col("m1").alias("label")), p.select("chr", F.col("m2").alias("label")))
    return both.groupBy("chr", "label").agg(F.count("*").alias("n"))


@query("clean_contigs", base._IV.replace("'chr' || (1 + o_orderkey % 3)", "CASE o_orderkey % 5 WHEN 0 THEN 'chrUn_7' WHEN 1 THEN 'chrM' WHEN 2 THEN 'chr1_random' ELSE 'chr2' END") + " SELECT rid, chr FROM iv WHERE chr = 'chr2'")
def _(spark, d):
    key = F.col("rid") % 5
    named = intervals(spark, d).withColumn("chr", F.when(key == 0, "chrUn_7").when(key == 1, "chrM").when(key == 2, "chr1_random").otherwise("chr2"))
    return labels.clean_contigs(named).select("rid", "chr")


@query("labels_in_order", "SELECT m1 AS label, min(idx) AS first FROM t GROUP BY m1")
def _(spark, d):
    return labels.in_order(paired(spark, d), "m1")


@query("paired_by_position", "SELECT row_number() OVER (ORDER BY chr, s) - 1 AS idx, chr, s AS start, e AS \"end\", round(p1[1], 6) AS a, round(p2[1], 6) AS b FROM t")
def _(spark, d):
    p = paired(spark, d)
    both = core.pair(p.select("chr", "start", "end", F.col("p1").alias("p")), p.select("chr", "start", "end", F.col("p2").alias("p")))
    return r6(both.select("idx", "chr", "start", "end", F.col("p1")[0].alias("a"), F.col("p2")[0].alias("b")), "a", "b")


@query("bin_gene_filled", base._GE + " SELECT idx, round(coalesce(arg_max(tpm, gene_id), 0), 6) AS tpm FROM t LEFT JOIN ge ON t.chr = ge.chr AND ((t.s BETWEEN ge.s AND ge.e) OR (t.e BETWEEN ge.s AND ge.e)) GROUP BY idx")
def _(spark, d):
    p = paired(spark, d)
    met = ranges.endpoint_join(p, genes(spark, d)).select("idx", "tpm")
    return r6(p.select("idx").join(met, "idx", "left").select("idx", F.coalesce("tpm", F.lit(0.0)).alias("tpm")), "tpm")


@query("gene_expression", base._GE + " SELECT gene_id, round(arg_min(l_extendedprice, l_orderkey * 100 + l_linenumber), 6) AS tpm FROM ge JOIN lineitem ON l_partkey = gene_id GROUP BY gene_id")
def _(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("gene_id"), F.col("l_extendedprice").alias("tpm"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at"))
    return r6(ranges.first_of(genes(spark, d).select("gene_id"), rows, "gene_id", "at", "tpm"), "tpm")


@query("legacy_strata", f", bj AS (SELECT k, j, c2 FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY iou DESC NULLS LAST, ja) AS rn FROM i0) WHERE rn = 1), lp AS (SELECT l.k, t.idx, p1[la + 1] AS p, m2 = bj.j AS hit, c2 FROM t, l JOIN bj USING (k)), sb AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY p, idx) - 1) // greatest(1, (SELECT n // 50 FROM n)) AS b FROM lp) SELECT k, b, round((min(p) + max(p)) / 2, 6) AS x, round(CASE WHEN count(*) FILTER (hit) = 0 THEN ln(1 / (max(c2) * count(*) + 1)) ELSE ln(count(*) FILTER (hit) / (max(c2) * count(*))) END, 6) AS oe FROM sb GROUP BY k, b")
def _(spark, d):
    p = paired(spark, d)
    best = {r["k"]: r["j"] for r in match.best_match(overlap.overlap(p, LABELS, "iou"), LABELS).collect()}
    share = {r["k"]: r["coverage"] for r in overlap.coverage(p, LABELS, "m2").collect()}
    cells = F.array(*[F.struct(F.lit(x).alias("k"), F.col("p1")[i].alias("p"), (F.col("m2") == best[x]).alias("hit")) for i, x in enumerate(LABELS)])
    placed = core.ranked(p.select("idx", F.explode(cells).alias("c")).select("idx", "c.*"), "k", "p", "idx")
    expected = spark.createDataFrame([(k, share[j]) for k, j in best.items()], "k string, share double")
    return r6(statistics.log_odds_strata(placed, expected, calibrate.strata_count(core.size(p), 50)), "x", "oe")


@query("frequent_pair", "SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) a JOIN (SELECT DISTINCT user_id, event_type FROM events) b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL ORDER BY n DESC, a, b LIMIT 1", plain=True)
def _(spark, d):
    sets = read(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    return statistics.frequent_pair(sets, "types")


@query("scaled_similarity")
def _(spark, d):
    means = merging.scaled_features(profiles.centroids(read(spark, d, "embeddings"), "label", "embedding"))
    return r6(profiles.centroid_similarity(means).select("a", "b", "distance", "cosine"), "distance", "cosine")


base.SQL["scaled_similarity"] = "WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM u GROUP BY ALL), c AS (SELECT label, i, (x - min(x) OVER (PARTITION BY i)) / nullif(max(x) OVER (PARTITION BY i) - min(x) OVER (PARTITION BY i), 0) AS x FROM m) SELECT a.label AS a, b.label AS b, round(sqrt(sum((a.x - b.x) ** 2)), 6) AS distance, round(sum(a.x * b.x) / sqrt(sum(a.x ** 2) * sum(b.x ** 2)), 6) AS cosine FROM c a JOIN c b USING (i) GROUP BY ALL"


@query("feature_enrichment_flanks", base._TS + ", rw AS (SELECT m1 AS label, off, CASE WHEN off < 0 THEN 'upstream' ELSE 'downstream' END || CASE WHEN off IN (-10, 0) THEN ':start' WHEN off IN (-1, 9) THEN ':end' ELSE '' END AS component, count(*) AS n FROM t JOIN (SELECT chr, coord, unnest(range(-10, 10)) AS off FROM ts) x ON t.chr = x.chr AND t.s = (coord // 200 + off) * 200 GROUP BY ALL), tt AS (SELECT off, component, sum(n) AS total FROM rw GROUP BY ALL), bs AS (SELECT m1 AS label, sum(e - s) / CAST((SELECT sum(e - s) FROM t) AS DOUBLE) AS share FROM t GROUP BY m1) SELECT label, component, round(avg(log2((coalesce(n, 0) + 1) / CAST(total AS DOUBLE) / share)), 6) AS enrichment FROM (SELECT k AS label, tt.* FROM l, tt) z LEFT JOIN rw USING (label, off, component) JOIN bs USING (label) GROUP BY ALL")
def _(spark, d):
    p = paired(spark, d)
    bases = p.groupBy(F.col("m1").alias("label")).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    raw = statistics.flank_parts(enrich.around_points(p, tss(spark, d), 200, 10))
    return r6(enrich.feature_enrichment(raw, bases, LABELS), "enrichment")
