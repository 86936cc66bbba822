"""Queries over embeddings read as 64 realizations per location, and over labels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.functions import arrays as A
from lithic.operators import ensemble as E
from lithic.operators import metrics as M
from lithic.plans.drillholes import _rounded, read

CUTS = [round(-1 + 0.2 * i, 1) for i in range(11)]


def _sims(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    sims = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(F.col("vec_id").alias("loc_id"), F.floor(F.col("vec_id") / 8).cast("long").alias("block"), "label", sims.alias("sims")).withColumn("truth", F.col("sims")[0]).withColumn("prediction", A.array_mean(F.col("sims")))


def ensemble_quantiles(spark, sf_dir):
    out = E.with_quantiles(_sims(spark, sf_dir), "sims", [0.1, 0.5, 0.9])
    return out.select("loc_id", *(F.round(F.col(f"`q_{p}`") + 3e-10, 6).alias(n) for p, n in (("0.1", "q10"), ("0.5", "q50"), ("0.9", "q90"))))


def ensemble_cdf(spark, sf_dir):
    out = E.with_probabilities(_sims(spark, sf_dir), "sims", [-0.1, 0.0, 0.1])
    return out.select("loc_id", F.col("`p_-0.1`").alias("p_low"), F.col("p_0").alias("p_zero"), F.col("`p_0.1`").alias("p_high"))


def derived(spark, sf_dir):
    out = E.derive(_sims(spark, sf_dir), "grown", lambda v: F.exp(v), ["sims"])
    return _rounded(out.select("loc_id", F.col("grown")[5].alias("fifth"), "grown_mean"), "fifth", "grown_mean")


def change_of_support(spark, sf_dir):
    out = E.change_of_support(_sims(spark, sf_dir), "block", "sims", [0.05])
    return _rounded(out.select("block", "mean", "dispersion", F.col("`proportion_0.05`").alias("proportion"), F.col("`divided_0.05`").alias("divided")), "mean", "dispersion", "proportion", "divided")


def grade_tonnage(spark, sf_dir):
    return _rounded(E.grade_tonnage(_sims(spark, sf_dir), "sims", CUTS), "tonnage", "metal", "grade").withColumn("grade", F.coalesce("grade", F.lit(-99.0)))


def metrics(spark, sf_dir):
    out = M.compute_metrics(_sims(spark, sf_dir), "truth", "prediction", "sims", 0.1, ["label"])
    return _rounded(out, "rmse", "mae", "bias", "crps", "interval_score", "bias2", "variance")


def coverage(spark, sf_dir):
    return _rounded(M.coverage(_sims(spark, sf_dir), "truth", "sims", [0.2, 0.5, 0.9]), "observed")


def goodness(spark, sf_dir):
    return _rounded(M.goodness(M.coverage(_sims(spark, sf_dir), "truth", "sims", [0.2, 0.5, 0.9])), "goodness")


def confusion_matrix(spark, sf_dir):
    return _rounded(M.confusion(read(spark, sf_dir, "labels"), "quality", "toxic"), "share", "agreement")


def one_vs_rest(spark, sf_dir):
    return _rounded(M.one_vs_rest(read(spark, sf_dir, "labels"), "quality", "toxic"), "balanced_accuracy", "jaccard", "matthews")


def reliability(spark, sf_dir):
    e = _sims(spark, sf_dir).withColumn("claim", A.cdf(F.col("sims"), 0.0)).withColumn("hit", F.col("truth") <= 0)
    return _rounded(M.reliability(e, "claim", "hit", 4), "claimed", "observed", "ece_part")


def spread_check(spark, sf_dir):
    e = _sims(spark, sf_dir).withColumn("v", A.array_var(F.col("sims"))).withColumn("noise", F.lit(0.01))
    return _rounded(M.spread_check(e, "truth", "prediction", "v", "noise", 4), "predicted", "rms", "rms_error", "noise", "spread")


def simplex_projection(spark, sf_dir):
    out = _sims(spark, sf_dir).select("loc_id", A.simplex(F.slice("sims", 1, 4)).alias("w"))
    return _rounded(out.select("loc_id", F.posexplode("w").alias("part", "share")), "share")


def model_combination(spark, sf_dir):
    e = _sims(spark, sf_dir).select("loc_id", F.col("sims")[0].alias("m1"), F.col("sims")[1].alias("m2"), F.abs(F.col("sims")[2]).alias("v1"), F.abs(F.col("sims")[3]).alias("v2"), (F.abs(F.col("sims")[4]) + 0.1).alias("e1"), (F.abs(F.col("sims")[5]) + 0.2).alias("e2"))
    return _rounded(E.combine_models(e, ["m1", "m2"], ["v1", "v2"], ["e1", "e2"]).select("loc_id", "mean", "variance"), "mean", "variance")


_U = """e AS (SELECT vec_id AS loc_id, vec_id // 8 AS block, label, list_transform(embedding, lambda x: x::DOUBLE) AS sims, embedding[1]::DOUBLE AS truth FROM embeddings),
u AS (SELECT loc_id, block, label, truth, unnest(sims) AS v, unnest(range(0, len(sims))) AS sim FROM e)"""
_CUT = ", ".join(f"({c}::DOUBLE)" for c in CUTS)

SQL = {
    "ensemble_quantiles": f"WITH {_U} SELECT loc_id, round(quantile_cont(v, 0.1), 6) AS q10, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.9), 6) AS q90 FROM u GROUP BY loc_id",
    "ensemble_cdf": f"WITH {_U} SELECT loc_id, avg((v <= -0.1)::INT) AS p_low, avg((v <= 0.0)::INT) AS p_zero, avg((v <= 0.1)::INT) AS p_high FROM u GROUP BY loc_id",
    "derived": f"WITH {_U} SELECT loc_id, round(max(CASE WHEN sim = 5 THEN exp(v) END), 6) AS fifth, round(avg(exp(v)), 6) AS grown_mean FROM u GROUP BY loc_id",
    "change_of_support": f"""WITH {_U}, b AS (SELECT block, sim, avg(v) AS m, var_pop(v) AS d, count(*) AS n, sum((v <= 0.05)::INT) AS k FROM u GROUP BY block, sim)
        SELECT block, round(avg(m), 6) AS mean, round(avg(d), 6) AS dispersion, round(sum(k) / sum(n), 6) AS proportion, round(avg((k > 0 AND k < n)::INT), 6) AS divided FROM b GROUP BY block""",
    "grade_tonnage": f"""WITH {_U}, c AS (SELECT c FROM (VALUES {_CUT}) t(c)), s AS (SELECT DISTINCT sim FROM u)
        SELECT sim::INT AS sim, c AS cutoff, round(count(v)::DOUBLE, 6) AS tonnage, round(coalesce(sum(v), 0), 6) AS metal, coalesce(round(sum(v) / count(v), 6), -99) AS grade
        FROM (SELECT s.sim, c.c, u.v FROM s CROSS JOIN c LEFT JOIN u ON u.sim = s.sim AND u.v >= c.c) GROUP BY sim, c""",
    "metrics": f"""WITH {_U}, w AS (SELECT *, row_number() OVER (PARTITION BY loc_id ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY loc_id) AS n FROM u),
        l AS (SELECT loc_id, any_value(label) AS label, any_value(truth) AS y, avg(v) AS p, avg(abs(v - truth)) - sum(v * (2 * i - n + 1)) / any_value(n * n) AS crps, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi, var_pop(v) AS vp FROM w GROUP BY loc_id)
        SELECT label, count(*) AS n, round(sqrt(avg((p - y) ** 2)), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(avg(p - y), 6) AS bias, round(avg(crps), 6) AS crps,
          round(avg(hi - lo + 2 / 0.1 * (greatest(lo - y, 0) + greatest(y - hi, 0))), 6) AS interval_score, round(avg((p - y) ** 2), 6) AS bias2, round(avg(vp), 6) AS variance FROM l GROUP BY label""",
    "coverage": f"""WITH {_U}, l AS (SELECT loc_id, any_value(truth) AS y, p, quantile_cont(v, 0.4) AS a2, quantile_cont(v, 0.6) AS b2, quantile_cont(v, 0.25) AS a5, quantile_cont(v, 0.75) AS b5, quantile_cont(v, 0.05) AS a9, quantile_cont(v, 0.95) AS b9 FROM u, (VALUES (0.2), (0.5), (0.9)) t(p) GROUP BY loc_id, p)
        SELECT p::DOUBLE AS probability, round(avg((CASE p WHEN 0.2 THEN y BETWEEN a2 AND b2 WHEN 0.5 THEN y BETWEEN a5 AND b5 ELSE y BETWEEN a9 AND b9 END)::INT), 6) AS observed FROM l GROUP BY p""",
    "confusion_matrix": """WITH c AS (SELECT quality AS measured, toxic AS predicted, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2)
        SELECT measured, predicted, n, round(n / sum(n) OVER (PARTITION BY measured), 6) AS share, round(sum(CASE WHEN measured = predicted THEN n ELSE 0 END) OVER () / sum(n) OVER (), 6) AS agreement FROM c""",
    "one_vs_rest": """WITH l AS (SELECT unnest([0, 1]) AS label), k AS (SELECT label, sum((quality = label AND toxic = label)::INT)::DOUBLE AS tp, sum((quality <> label AND toxic = label)::INT)::DOUBLE AS fp, sum((quality = label AND toxic <> label)::INT)::DOUBLE AS fn, sum((quality <> label AND toxic <> label)::INT)::DOUBLE AS tn FROM labels, l GROUP BY label)
        SELECT label, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(tp / (tp + fp + fn), 6) AS jaccard, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS matthews FROM k""",
    "reliability": f"""WITH {_U}, r AS (SELECT loc_id, any_value(truth) AS y, avg((v <= 0)::INT) AS claim FROM u GROUP BY loc_id), q AS (SELECT quantile_cont(claim, [0.25, 0.5, 0.75]) AS e FROM r),
        b AS (SELECT *, (e[1] < claim)::INT + (e[2] < claim)::INT + (e[3] < claim)::INT AS bin FROM r, q), g AS (SELECT bin, count(*) AS n, avg(claim) AS claimed, avg((y <= 0)::INT) AS observed FROM b GROUP BY bin)
        SELECT bin, n, round(claimed, 6) AS claimed, round(observed, 6) AS observed, round(n / sum(n) OVER () * abs(claimed - observed), 6) AS ece_part FROM g""",
    "spread_check": f"""WITH {_U}, r AS (SELECT loc_id, any_value(truth) AS y, avg(v) AS p, var_pop(v) AS s FROM u GROUP BY loc_id), q AS (SELECT quantile_cont(p, [0.25, 0.5, 0.75]) AS e FROM r),
        b AS (SELECT *, (e[1] < p)::INT + (e[2] < p)::INT + (e[3] < p)::INT AS bin FROM r, q)
        SELECT bin, count(*) AS n, round(avg(p), 6) AS predicted, round(sqrt(avg((y - p) ** 2)), 6) AS rms, round(sqrt(avg((y - p) ** 2)) / sqrt(2 * count(*)), 6) AS rms_error, round(0.1, 6)::DOUBLE AS noise, round(sqrt(avg(s + 0.01)), 6) AS spread FROM b GROUP BY bin""",
    "simplex_projection": """WITH s AS (SELECT vec_id, unnest(list_transform(embedding[1:4], lambda x: x::DOUBLE)) AS v, unnest(range(0, 4))::INT AS part FROM embeddings), r AS (SELECT *, row_number() OVER w AS k, sum(v) OVER w AS c FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY v DESC ROWS UNBOUNDED PRECEDING)),
        t AS (SELECT vec_id, max_by((c - 1) / k, k) AS tau FROM r WHERE 1 + k * v > c GROUP BY vec_id) SELECT s.vec_id AS loc_id, part, round(greatest(v - tau, 0), 6) AS share FROM s JOIN t USING (vec_id)""",
    "model_combination": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS s FROM embeddings), w AS (SELECT *, (abs(s[5]) + 0.1) / (abs(s[5]) + abs(s[6]) + 0.3) AS w FROM e)
        SELECT vec_id AS loc_id, round(w * s[1] + (1 - w) * s[2], 6) AS mean, round(w * w * abs(s[3]) + (1 - w) * (1 - w) * abs(s[4]), 6) AS variance FROM w""",
}
SQL["goodness"] = f"""WITH c AS ({SQL["coverage"].replace("round(avg(", "(avg(").replace(")::INT), 6)", ")::INT))")}), d AS (SELECT probability AS p, CASE WHEN observed < probability THEN 2 * (probability - observed) ELSE observed - probability END AS d FROM c),
    a AS (SELECT p, (p - lag(p) OVER w) * (d + lag(d) OVER w) / 2 AS a FROM d WINDOW w AS (ORDER BY p)) SELECT round(1 - sum(a) / (max(p) - min(p)), 6) AS goodness FROM a"""
SQL = {k: v.replace("round(", "round(3e-10 + ") for k, v in SQL.items()}

QUERIES = {
    f.__name__: f
    for f in (ensemble_quantiles, ensemble_cdf, derived, change_of_support, grade_tonnage, metrics, coverage, goodness, confusion_matrix, one_vs_rest, reliability, spread_check, simplex_projection, model_combination)
}
