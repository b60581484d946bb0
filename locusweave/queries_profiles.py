"""Queries of the profiles, registered beside those of the tracks, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries as base
from .operators import calibrate, core, overlap, profiles, ranges, spatial
from .plans.adapters import LABELS, genes, hold, paired, read, tss
from .queries import BINS, TO, W, query, r6

_LONG = ", lg AS (SELECT t.idx, l.k, t.p1[la + 1] AS p, t.m1, t.m2, t.s, t.e FROM t, l)"
_BG = base._GE + ", bg AS (SELECT idx, arg_max(tpm, gene_id) AS tpm FROM t JOIN ge ON t.chr = ge.chr AND ((t.s BETWEEN ge.s AND ge.e) OR (t.e BETWEEN ge.s AND ge.e)) GROUP BY idx)"
_RX = base._CURVE + _BG + ", rx AS (SELECT rv.idx, map, r, tpm FROM rv JOIN bg USING (idx))"
_SEG = ", cs AS (SELECT idx, chr, s AS start, e AS \"end\", m1 AS label FROM t), sg AS (" + base._ISLES.format(src="cs") + ")"


def _rx(spark, d):
    """(idx, map, r_value, tpm) of bins at a gene."""
    p = paired(spark, d)
    at_curve = calibrate.calibration(p, LABELS, W, TO, BINS)
    # the curves are those of all bins; only bins at a gene are put on them
    met = ranges.endpoint_join(p.withColumn("p", F.array_max("p1")), genes(spark, d), keep=["p"])
    return hold(met.select("idx", F.col("m1").alias("map"), at_curve("m1", "p").alias("r_value"), "tpm"), "expression")


@query("granularity_symmetric", ", rk AS (SELECT k, j AS a, CASE WHEN k = j THEN 0 ELSE row_number() OVER (PARTITION BY k, k = j ORDER BY iou DESC NULLS LAST, ja) END AS r FROM i0), jj AS (SELECT x.k, greatest(x.r, y.r) AS step, sum(h0.o) AS o FROM rk x JOIN rk y ON x.k = y.k JOIN h0 ON h0.k = x.a AND h0.j = y.a GROUP BY ALL), cc AS (SELECT rk.k, rk.r AS step, c1.c1 AS c FROM rk JOIN c1 ON c1.k = rk.a) SELECT k, CAST(step AS INTEGER) AS step, round(sum(c) OVER z, 6) AS coverage, round(sum(o) OVER z / nullif(sum(c) OVER z, 0), 6) AS agreement FROM jj JOIN cc USING (k, step) WINDOW z AS (PARTITION BY k ORDER BY step)")
def _(spark, d):
    p = paired(spark, d)
    return r6(profiles.granularity_symmetric(overlap.overlap(p, LABELS, "iou"), overlap.joint(p, LABELS), overlap.coverage(p, LABELS, "m1"), LABELS), "coverage", "agreement")


@query("equal_width_joint", _LONG + ", ed AS (SELECT min(p) AS lo, max(p) AS hi FROM lg) SELECT k, CAST(floor((p - lo) / (hi - lo) * 50) AS BIGINT) AS b, m2, count(*) AS n FROM lg, ed WHERE p < hi GROUP BY ALL")
def _(spark, d):
    return profiles.equal_width(profiles.by_label(paired(spark, d), LABELS, "m2"), 50).groupBy("k", "b", "m2").agg(F.count("*").alias("n"))


_STRATA = _LONG + ", sx AS (SELECT k, least(199, (row_number() OVER (PARTITION BY k ORDER BY p, idx) - 1) // greatest(1, (SELECT n // 200 FROM n))) AS b, m1, m2 FROM lg)"


def _map_strata(spark, d):
    p = paired(spark, d)
    return profiles.strata(profiles.by_label(p, LABELS, "idx", "m1", "m2"), core.size(p), 200).where("m1 = k").groupBy("k", "b", "m2").agg(F.count("*").alias("n"))


@query("strat_joint_map", _STRATA + " SELECT k, b, m2, count(*) AS n FROM sx WHERE m1 = k GROUP BY ALL")
def _(spark, d):
    return _map_strata(spark, d)


@query("posterior_nmi", _STRATA + ", hh AS (SELECT k || ':' || b AS k, m2 AS j, count(*) / (SELECT CAST(n AS DOUBLE) FROM n) AS o FROM sx WHERE m1 = k GROUP BY ALL)" + base._INFO.format(h="hh"))
def _(spark, d):
    n = core.size(paired(spark, d))
    cells = _map_strata(spark, d).select(F.concat_ws(":", "k", "b").alias("k"), F.col("m2").alias("j"), (F.col("n") / n).alias("joint"))
    return r6(overlap.information(cells), "h_rows", "h_cols", "h_cond", "mi", "nmi")


@query("agreement_2x2", base._CURVE + f", z AS (SELECT DISTINCT t.idx FROM t JOIN q ON q.k = t.m1 JOIN t u ON u.m2 = q.j AND u.idx BETWEEN t.idx - {W} AND t.idx + {W - 1}) SELECT r >= 0.8 AS is1, z.idx IS NOT NULL AS is2, count(*) AS n FROM rv LEFT JOIN z USING (idx) GROUP BY ALL")
def _(spark, d):
    p = paired(spark, d)
    one = calibrate.r_values(p, LABELS, W, TO, BINS).select("idx", (F.col("r_value") >= 0.8).alias("flag"))
    return profiles.two_by_two(one, spatial.reproduced(p, base.matches(p), W).select("idx", F.col("is_repr").alias("flag")))


@query("posterior_ratios", _LONG + " SELECT k, round(avg(CASE WHEN p = 1 THEN 1.0 ELSE 0 END), 6) AS ones, round(avg(CASE WHEN p = 0 THEN 1.0 ELSE 0 END), 6) AS zeros, round(avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0 END), 6) AS half FROM lg GROUP BY k")
def _(spark, d):
    return r6(profiles.posterior_ratios(profiles.by_label(paired(spark, d), LABELS)), "ones", "zeros", "half")


@query("posterior_qc", _LONG + " SELECT round(1 - sum(CASE WHEN p = 1 THEN e - s ELSE 0 END) / (sum(e - s) / 5.0), 6) AS qc FROM lg")
def _(spark, d):
    return r6(profiles.saturation(profiles.by_label(paired(spark, d), LABELS, "start", "end"), len(LABELS)), "qc")


@query("posterior_tpm_spearman", _BG + ", rs AS (SELECT l.k, p1[la + 1] AS p, tpm FROM bg JOIN t USING (idx), l) SELECT k, round(corr(a, b), 6) AS spearman FROM (SELECT k, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY k ORDER BY tpm) + (count(*) OVER (PARTITION BY k, tpm) - 1) / 2.0::DOUBLE AS b FROM rs) GROUP BY k")
def _(spark, d):
    p = paired(spark, d)
    both = ranges.endpoint_join(p, genes(spark, d)).select("idx", "tpm", F.lit(0).alias("all"))
    x = profiles.average_ranks(profiles.by_label(p.join(both.select("idx"), "idx"), LABELS, "idx"), "k", "p", "rank_p")
    y = profiles.average_ranks(both, "all", "tpm", "rank_t")
    return r6(x.join(y, "idx").groupBy("k").agg(F.corr("rank_p", "rank_t").alias("spearman")), "spearman")


@query("posterior_score_corr", f", z AS (SELECT t.idx, u.idx - t.idx AS d, iou FROM t JOIN t u ON u.idx BETWEEN t.idx - {W} AND t.idx + {W} AND t.idx - abs(u.idx - t.idx) >= 0 AND t.idx + abs(u.idx - t.idx) <= (SELECT n - 1 FROM n) JOIN i5 ON i5.k = t.m1 AND i5.j = u.m2), sc AS (SELECT idx, iou / (abs(d) + 1) AS score FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY iou DESC, abs(d) * 2 + CASE WHEN d > 0 THEN 1 ELSE 0 END) AS rn FROM z) WHERE rn = 1) SELECT m1, round(corr(list_max(p1), score), 6) AS pearson FROM sc JOIN t USING (idx) GROUP BY m1")
def _(spark, d):
    p = paired(spark, d)
    scores = spatial.local_scores(p, overlap.overlap(p, LABELS, "iou", W), W)
    return r6(p.select("idx", "m1", F.array_max("p1").alias("top")).join(scores, "idx").groupBy("m1").agg(F.corr("top", "score").alias("pearson")), "pearson")


@query("expression_by_r", _RX + " SELECT CAST(floor(x) AS BIGINT) AS bin, map, count(*) AS n, round(avg(r), 6) AS mean_r, round(avg(tpm), 6) AS mean_tpm, round(avg(CASE WHEN tpm > 0 THEN 1.0 ELSE 0.0 END), 6) AS expressed FROM (SELECT *, round(r, 9) * 20 AS x FROM rx) WHERE x <> floor(x) GROUP BY ALL")
def _(spark, d):
    return r6(profiles.expression_by_r(_rx(spark, d)), "mean_r", "mean_tpm", "expressed")


@query("expression_fit", _RX + " SELECT map, count(*) AS n, round(corr(r, tpm), 6) AS pearson, round(regr_r2(tpm, r), 6) AS r2 FROM rx GROUP BY map")
def _(spark, d):
    return r6(profiles.expression_fit(_rx(spark, d)), "pearson", "r2")


@query("confident_contrast", _RX + ", rk AS (SELECT r >= 0.9 AS sure, ln(tpm + 1e-19) AS v, rank() OVER (ORDER BY ln(tpm + 1e-19)) + (count(*) OVER (PARTITION BY ln(tpm + 1e-19)) - 1) / 2.0::DOUBLE AS g FROM rx), ag AS (SELECT count(*) FILTER (sure) AS n1, count(*) FILTER (NOT sure) AS n0, avg(v) FILTER (sure) AS a1, avg(v) FILTER (NOT sure) AS a0, var_samp(v) FILTER (sure) AS v1, var_samp(v) FILTER (NOT sure) AS v0, sum(g) FILTER (sure) AS rs FROM rk) SELECT n1, n0, round(a1 - a0, 6) AS mean_diff, round((a1 - a0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round((rs - n1 * (n1 + 1) / 2.0 - n1 * n0 / 2.0) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12.0), 6) AS z FROM ag")
def _(spark, d):
    return r6(profiles.confident_contrast(_rx(spark, d)), "mean_diff", "t", "z")


@query("posterior_heatmap", ", xy AS (SELECT p1[1] AS x, p2[1] AS y FROM t), ed AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM xy), ct AS (SELECT CAST(least(49, floor((x - lx) / (hx - lx) * 50)) AS BIGINT) AS x_bin, CAST(least(49, floor((y - ly) / (hy - ly) * 50)) AS BIGINT) AS y_bin, count(*) AS n FROM xy, ed GROUP BY ALL) SELECT x_bin, y_bin, round(n / CAST(sum(n) OVER (PARTITION BY x_bin) AS DOUBLE), 6) AS share FROM ct")
def _(spark, d):
    return r6(profiles.heatmap(paired(spark, d).select(F.col("p1")[0].alias("x"), F.col("p2")[0].alias("y"))), "share")


@query("cumulative_signal", ", vs AS (SELECT p1[1] AS v, count(*) AS c FROM t GROUP BY 1) SELECT round(v, 6) AS value, round(sum(v * c) OVER (ORDER BY v) / (SELECT sum(v * c) FROM vs), 6) AS share FROM vs")
def _(spark, d):
    return r6(profiles.running_share(paired(spark, d).select(F.col("p1")[0].alias("x")), "x"), "value", "share")


@query("rising_offsets")
def _(spark, d):
    return profiles.rising(base.Q["corr_by_offset"](spark, d), "m1", "d", "share")


base.SQL["rising_offsets"] = "SELECT m1, d, share FROM (SELECT *, max(share) OVER (PARTITION BY m1 ORDER BY d) AS most FROM (" + base.SQL["corr_by_offset"] + ")) WHERE share >= most"


@query("r_histogram", base._CURVE + ", hb AS (SELECT CAST(least(99, floor(round(r, 9) * 100)) AS BIGINT) AS bin, count(*) AS n FROM rv GROUP BY 1) SELECT bin, n, round(sum(n) OVER (ORDER BY bin) / CAST((SELECT sum(n) FROM hb) AS DOUBLE), 6) AS share FROM hb")
def _(spark, d):
    from pyspark.sql import Window

    r = calibrate.r_values(paired(spark, d), LABELS, W, TO, BINS)
    counts = r.groupBy(F.least(F.lit(99), F.floor(F.round("r_value", 9) * 100)).alias("bin")).agg(F.count("*").alias("n"))
    every = Window.orderBy("bin")  # 100 rows
    total = F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return r6(counts.select("bin", "n", (F.sum("n").over(every) / total).alias("share")), "share")


@query("length_ecdf", _SEG + ", ct AS (SELECT label, n AS length, count(*) AS c FROM (SELECT *, quantile_cont(n, 0.99) OVER (PARTITION BY label) AS cut FROM sg) WHERE n <= cut GROUP BY ALL) SELECT label, length, round(sum(c) OVER (PARTITION BY label ORDER BY length) / CAST(sum(c) OVER (PARTITION BY label) AS DOUBLE), 6) AS share FROM ct")
def _(spark, d):
    return r6(profiles.length_ecdf(spatial.segments(paired(spark, d))), "share")


@query("lengths_by_chromosome", _SEG + " SELECT label, chr, count(*) AS n, round(avg(\"end\" - start), 6) AS mean, round(quantile_cont(\"end\" - start, 0.25), 6) AS q1, round(quantile_cont(\"end\" - start, 0.5), 6) AS median, round(quantile_cont(\"end\" - start, 0.75), 6) AS q3 FROM sg GROUP BY label, chr")
def _(spark, d):
    return r6(profiles.lengths_by_chromosome(spatial.segments(paired(spark, d))), "mean", "q1", "median", "q3")


@query("boundary_profile", base._NEAR.format(base.REACH - 1) + " SELECT ne.m1, CAST(d AS INTEGER) AS distance, count(*) AS n FROM ne JOIN t u ON u.idx = ne.idx + 1 AND u.m1 <> ne.m1 GROUP BY ne.m1, d")
def _(spark, d):
    p = paired(spark, d)
    near = spatial.nearest(p, base.matches(p), base.REACH - 1).select("idx", "distance")
    return profiles.boundary_rows(p).join(near, "idx").groupBy("m1", "distance").agg(F.count("*").alias("n"))


_PLACE = ", ig AS (SELECT *, sum(CASE WHEN pl IS NULL OR pl <> m1 OR pc <> chr THEN 1 ELSE 0 END) OVER (ORDER BY idx) AS g FROM (SELECT *, lag(m1) OVER (ORDER BY idx) AS pl, lag(chr) OVER (ORDER BY idx) AS pc FROM t)), pg AS (SELECT idx, max(e) OVER w - min(s) OVER w AS len, (s - min(s) OVER w + (e - s) / 2.0::DOUBLE) / (max(e) OVER w - min(s) OVER w) AS place FROM ig WINDOW w AS (PARTITION BY g)), cl AS (SELECT CASE WHEN len < 1000 THEN 0 WHEN len < 10000 THEN 1 ELSE 2 END AS kind, CAST(least(4, floor(place * 5)) AS INTEGER) AS bin, count(*) AS n, avg({v}) AS v FROM pg JOIN {src} USING (idx) GROUP BY ALL) SELECT kind, bin, n, round(last_value(CASE WHEN n >= 100 THEN v END IGNORE NULLS) OVER (PARTITION BY kind ORDER BY bin), 6) AS mean FROM cl"


@query("match_in_segments", _PLACE.format(v="CASE WHEN m1 = m2 THEN 1.0 ELSE 0.0 END", src="t"))
def _(spark, d):
    p = paired(spark, d)
    return r6(profiles.profile_in_segments(profiles.within_segments(p), p.select("idx", (F.col("m1") == F.col("m2")).cast("double").alias("value"))), "mean")


@query("r_in_segments", base._CURVE + _PLACE.format(v="r", src="rv"))
def _(spark, d):
    p = paired(spark, d)
    r = calibrate.r_values(p, LABELS, W, TO, BINS).select("idx", F.col("r_value").alias("value"))
    return r6(profiles.profile_in_segments(profiles.within_segments(p), r), "mean")


@query("weighted_auc")
def _(spark, d):
    both = base.Q["granularity_auc"](spark, d).join(base.Q["coverage"](spark, d), "k")
    return r6(both.agg(F.sum(F.col("auc") * F.col("coverage1")).alias("auc"), F.sum(F.col("max_auc") * F.col("coverage1")).alias("max_auc")), "auc", "max_auc")


base.SQL["weighted_auc"] = "SELECT round(sum(auc * coverage1), 6) AS auc, round(sum(max_auc * coverage1), 6) AS max_auc FROM (" + base.SQL["granularity_auc"] + ") JOIN (" + base.SQL["coverage"] + ") USING (k)"


@query("centroid_similarity")
def _(spark, d):
    return r6(profiles.centroid_similarity(profiles.centroids(read(spark, d, "embeddings"), "label", "embedding")), "distance", "near", "cosine", "pearson")


base.SQL["centroid_similarity"] = "WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM u GROUP BY ALL) SELECT a.label AS a, b.label AS b, round(sqrt(sum((a.x - b.x) ** 2)), 6) AS distance, round(exp(-sum((a.x - b.x) ** 2)), 6) AS near, round(sum(a.x * b.x) / sqrt(sum(a.x ** 2) * sum(b.x ** 2)), 6) AS cosine, round(coalesce(corr(a.x, b.x), 0), 6) AS pearson FROM c a JOIN c b USING (i) GROUP BY ALL"


@query("pseudo_replicates", " SELECT idx, CASE WHEN substr(md5('5:' || idx), 1, 1) >= '8' THEN 1 ELSE 0 END AS half FROM t")
def _(spark, d):
    return profiles.halves(paired(spark, d).select("idx"), "idx")


@query("genes_near_tss", base._GE + base._TS + " SELECT gene_id, tss_id, ge.chr, coord - 1000 AS start, coord + 1000 AS \"end\", tpm FROM ge JOIN ts ON ge.chr = ts.chr AND (ge.s BETWEEN coord - 1000 AND coord + 1000 OR ge.e BETWEEN coord - 1000 AND coord + 1000)")
def _(spark, d):
    return profiles.genes_near(genes(spark, d), tss(spark, d))


@query("bins_after_tss", base._TS + " SELECT DISTINCT idx, m1 FROM t JOIN ts ON t.chr = ts.chr AND t.s - coord > 0 AND t.s - coord < 200")
def _(spark, d):
    return profiles.bins_after(paired(spark, d).select("idx", "chr", "start", "end", "m1"), tss(spark, d), 200).select("idx", "m1")


@query("genes_by_r", base._CURVE + base._GE + ", ea AS (SELECT gene_id, tpm, map, avg(CASE WHEN round(r, 9) >= 0.9 THEN 1.0 ELSE 0.0 END) AS c, avg(r) AS r FROM rv JOIN t USING (idx) JOIN ge ON t.chr = ge.chr AND t.s < ge.e AND ge.s < t.e GROUP BY ALL) SELECT CAST(floor(tpm / 100.0) AS BIGINT) AS bin, map, count(*) AS genes, round(avg(c), 6) AS confident, round(avg(r), 6) AS mean_r FROM ea GROUP BY ALL")
def _(spark, d):
    r = calibrate.r_values(paired(spark, d), LABELS, W, TO, BINS)
    return r6(profiles.genes_by_r(r, genes(spark, d), 100.0), "confident", "mean_r")
