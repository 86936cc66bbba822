"""Queries of summaries for exploration, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.operators import explore
from lithic.plans.drillholes import _rounded, read


def counts_2d(spark, sf_dir):
    return explore.counts_2d(read(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", (0.0, 0.0), (50.0, 0.1), 10)


def padded_range(spark, sf_dir):
    return _rounded(explore.padded_range(read(spark, sf_dir, "orders"), "o_totalprice"), "low", "high")


def density_curve(spark, sf_dir):
    return _rounded(explore.density_curve(read(spark, sf_dir, "part"), "p_size", 0.0, 50.0, 11, 100_000), "density")


def normal_curve(spark, sf_dir):
    return _rounded(explore.normal_curve(read(spark, sf_dir, "part"), "p_size", 0.0, 50.0, 11), "x", "density")


def moving_average(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return _rounded(explore.moving_average(rows, "event_id", "value", 4, ["user_id"]).select("event_id", "average"), "average")


def plotting_positions(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.struct("c_acctbal", "c_custkey").alias("o"))
    return _rounded(explore.plotting_positions(rows, "o", ["c_nationkey"]).select("c_custkey", "position"), "position")


def weighted_quantiles(spark, sf_dir):
    rows = read(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").cast("double").alias("v")).agg(F.count("*").cast("double").alias("w"))
    return _rounded(explore.weighted_quantiles(rows, "v", "w", [0.25, 0.5], ["p_brand"]), "value")


def step_path(spark, sf_dir):
    bins = read(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").cast("double").alias("value"))
    start = F.col("p_size") + F.floor(F.col("p_size") / 10)  # a gap after every ten bins
    return explore.step_path(bins.select(start.cast("double").alias("lo"), (start + 1).cast("double").alias("hi"), "value")).select("k", "x", F.coalesce("y", F.lit(-1.0)).alias("y"))


def principal_components(spark, sf_dir):
    rows, _, share = explore.principal_components(read(spark, sf_dir, "part").withColumn("size", F.col("p_size") * 20.0), ["size", "p_retailprice"])
    return _rounded(rows.select("p_partkey", F.abs("pc_0").alias("first"), F.abs("pc_1").alias("second"), F.lit(float(share[0])).alias("share")), "first", "second", "share")


SQL = {
    "counts_2d": "SELECT least(floor(l_quantity / 5), 9)::INT AS i, least(floor(l_discount / ((0.1::DOUBLE - 0) / 10)), 9)::INT AS j, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_discount BETWEEN 0 AND 0.1::DOUBLE GROUP BY 1, 2",
    "padded_range": "SELECT round(min(o_totalprice) - 0.1 * (max(o_totalprice) - min(o_totalprice)), 6) AS low, round(max(o_totalprice) + 0.1 * (max(o_totalprice) - min(o_totalprice)), 6) AS high FROM orders",
    "density_curve": """WITH s AS (SELECT count(*) AS n, stddev_pop(p_size) * count(*) ** -0.2 AS h FROM part)
        SELECT (g * 5)::DOUBLE AS x, round(sum(exp(-0.5 * pow((g * 5 - p_size) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density FROM part, s, range(0, 11) t(g) GROUP BY g""",
    "normal_curve": "WITH s AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s FROM part) SELECT round((g * 5)::DOUBLE, 6) AS x, round(exp(-0.5 * pow((g * 5 - m) / s, 2)) / (s * sqrt(2 * pi())), 6) AS density FROM s, range(0, 11) t(g)",
    "moving_average": "SELECT event_id, round(a, 6) AS average FROM (SELECT event_id, avg(value) OVER w AS a, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 3 PRECEDING)) WHERE n = 4",
    "plotting_positions": "SELECT c_custkey, round((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 0.5) / count(*) OVER (PARTITION BY c_nationkey), 6) AS position FROM customer",
    "weighted_quantiles": """WITH r AS (SELECT p_brand, p_size::DOUBLE AS v, count(*)::DOUBLE AS w FROM part GROUP BY 1, 2),
        p AS (SELECT p_brand, v, (sum(w) OVER (PARTITION BY p_brand ORDER BY v) - w / 2) / sum(w) OVER (PARTITION BY p_brand) AS p FROM r), b AS (SELECT p_brand, q, max(p) FILTER (p <= q) AS lo, min(p) FILTER (p > q) AS hi, min(p) AS mn FROM p, (VALUES (0.25::DOUBLE), (0.5::DOUBLE)) t(q) GROUP BY p_brand, q)
        SELECT b.p_brand, q AS probability, round(CASE WHEN lo IS NULL THEN y.v WHEN hi IS NULL THEN x.v ELSE x.v + (y.v - x.v) * (q - lo) / (hi - lo) END, 6) AS value FROM b LEFT JOIN p x ON x.p_brand = b.p_brand AND x.p = b.lo LEFT JOIN p y ON y.p_brand = b.p_brand AND y.p = b.hi""",
    "step_path": """WITH b AS (SELECT (p_size + p_size // 10)::DOUBLE AS lo, (p_size + p_size // 10 + 1)::DOUBLE AS hi, count(*)::DOUBLE AS value FROM part GROUP BY p_size), g AS (SELECT *, lag(hi) OVER (ORDER BY lo) AS e FROM b)
        SELECT 0 AS k, lo AS x, -1.0::DOUBLE AS y FROM g WHERE e IS NOT NULL AND abs(e - lo) > 1e-12 UNION ALL SELECT 1, lo, value FROM g UNION ALL SELECT 2, hi, value FROM g""",
    "principal_components": """WITH x AS (SELECT p_partkey, p_size * 20.0::DOUBLE AS x, p_retailprice AS y FROM part), m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, var_pop(y) AS c, covar_pop(x, y) AS b FROM x),
        e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l FROM m), u AS (SELECT *, b / sqrt(b * b + pow(l - a, 2)) AS ux, (l - a) / sqrt(b * b + pow(l - a, 2)) AS uy FROM e)
        SELECT p_partkey, round(abs((x - mx) * ux + (y - my) * uy), 6) AS first, round(abs((y - my) * ux - (x - mx) * uy), 6) AS second, round(l / (a + c), 6) AS share FROM x, u""",
}
SQL = {k: v.replace("round(", "round(3e-10 + ") for k, v in SQL.items()}

QUERIES = {f.__name__: f for f in (counts_2d, padded_range, density_curve, normal_curve, moving_average, plotting_positions, weighted_quantiles, step_path, principal_components)}
