"""Queries over lineitem read as drillhole intervals, each with its SQL.

A hole is an order; depth is the running quantity within it. (l_orderkey, l_linenumber) is not unique,
so the order within a hole also goes by part and supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.functions.core import dealt
from lithic.operators import intervals as I  # noqa: E741
from lithic.operators.desurvey import asof_last

ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hole, f, t, src, grade, density, lith, bench."""
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt(read(spark, sf_dir, "lineitem"), "l_orderkey")
    rows = rows.select("*", F.sum("l_quantity").over(upto).alias("t"), F.row_number().over(w).cast("long").alias("src"))
    return rows.select(
        F.col("l_orderkey").alias("hole"), (F.col("t") - F.col("l_quantity")).alias("f"), "t", "src", "l_linenumber",
        F.col("l_discount").alias("grade"), (F.lit(2.0) + F.col("l_tax")).alias("density"), F.col("l_returnflag").alias("lith"), F.col("l_linestatus").alias("status"),
    )


SQL_INTERVALS = """
iv AS (
  SELECT l_orderkey AS hole, t - l_quantity AS f, t, src, l_linenumber, l_discount AS grade, 2.0 + l_tax AS density, l_returnflag AS lith, l_linestatus AS status
  FROM (SELECT *, sum(l_quantity) OVER w AS t, row_number() OVER w AS src FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag ROWS UNBOUNDED PRECEDING)))"""

SQL_RUNS = (
    SQL_INTERVALS
    + """,
ext AS (SELECT hole, min(f) AS lo, max(t) AS hi FROM iv GROUP BY hole),
cut AS (SELECT hole, lo, hi, greatest(1, floor((hi - lo) / 10.0 + 1e-6))::INT AS k FROM ext),
runs AS (SELECT hole, lo + i * 10.0 AS f, CASE WHEN i = k - 1 THEN hi ELSE lo + (i + 1) * 10.0 END AS t FROM (SELECT *, unnest(range(0, k)) AS i FROM cut)),
pairs AS (
  SELECT r.hole, r.f, r.t, s.grade, s.density, s.lith, s.status, s.src, least(r.t, s.t) - greatest(r.f, s.f) AS o
  FROM runs r LEFT JOIN iv s ON r.hole = s.hole AND r.f < s.t AND s.f < r.t)"""
)

LENGTH = 10.0


def _runs(iv: DataFrame) -> DataFrame:
    return I.fixed_runs(I.hole_extent(iv), LENGTH).select("hole", "f", "t")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """To 6 decimals, a hair above so that exact halves fall alike whatever the order of summing."""
    return df.withColumns({c: F.round(F.col(c) + 3e-10, 6) for c in columns})


def composite_mean(spark, sf_dir):
    iv = lineitem_intervals(spark, sf_dir)
    return _rounded(I.aggregate_onto(_runs(iv), iv, {"grade": "recovery"}), "grade")


def composite_mass(spark, sf_dir):
    iv = lineitem_intervals(spark, sf_dir)
    return _rounded(I.aggregate_onto(_runs(iv), iv, {"grade": "grade", "density": "density"}), "grade", "density")


def composite_majority(spark, sf_dir):
    iv = lineitem_intervals(spark, sf_dir)
    return I.aggregate_onto(_runs(iv), iv, {"lith": "categorical"})


def composite_longest(spark, sf_dir):
    iv = lineitem_intervals(spark, sf_dir)
    return I.aggregate_onto(_runs(iv), iv, {"status": "ignore"})


def composite_bucketed(spark, sf_dir):
    iv = lineitem_intervals(spark, sf_dir)
    return _rounded(I.aggregate_onto(_runs(iv), iv, {"grade": "recovery"}, bucket=50.0), "grade")


def overlap_lengths(spark, sf_dir):
    iv = lineitem_intervals(spark, sf_dir)
    return _rounded(I.overlap_join(_runs(iv), iv.select("hole", "f", "t", "src")).select("hole", "f", "src", "overlap"), "overlap")


def fixed_runs(spark, sf_dir):
    return I.fixed_runs(I.hole_extent(lineitem_intervals(spark, sf_dir)), LENGTH).select("hole", "f", "t")


def merge_runs(spark, sf_dir):
    return I.merge_runs(lineitem_intervals(spark, sf_dir), "lith").select("hole", "f", "t", "lith")


def composite_domain(spark, sf_dir):
    iv = lineitem_intervals(spark, sf_dir)
    return _rounded(I.composite({"a": (iv, {"grade": "recovery"})}, 25.0, ("a", "lith"))["a"], "grade")


def _gappy(spark, sf_dir):
    """All intervals, those of status F ending half way: gaps follow them."""
    return lineitem_intervals(spark, sf_dir).withColumn("t", F.when(F.col("status") == "F", (F.col("f") + F.col("t")) / 2).otherwise(F.col("t")))


def _collar(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hole"), F.lit(150.0).alias("length"))


def validate_intervals(spark, sf_dir):
    return I.validate(_gappy(spark, sf_dir), _collar(spark, sf_dir))


def fill_unlogged(spark, sf_dir):
    rows = _gappy(spark, sf_dir).withColumn("lith", F.when(F.col("lith") != "N", F.col("lith")))
    return I.fill_unlogged(rows, "lith", "waste", _collar(spark, sf_dir)).select("hole", "f", "t", "lith")


def contacts(spark, sf_dir):
    return I.contacts(_gappy(spark, sf_dir), "lith")


def classification_points(spark, sf_dir):
    return I.classification_points(_gappy(spark, sf_dir), "lith", 7.0)


def category_legend(spark, sf_dir):
    return _rounded(I.category_legend(lineitem_intervals(spark, sf_dir), "lith"), "length")


def group_categories(spark, sf_dir):
    rows = read(spark, sf_dir, "part")
    return I.group_categories(rows, "p_brand", {"first": ["Brand#11", "Brand#12"], "second": ["Brand#13"]}, "family", "other").groupBy("family").agg(F.count("*").alias("n"))


def hole_extent(spark, sf_dir):
    return I.hole_extent(lineitem_intervals(spark, sf_dir))


def filter_whole_holes(spark, sf_dir):
    iv = lineitem_intervals(spark, sf_dir)
    return I.filter_intervals(iv, "lith", ["A"], whole_holes=True).select("hole", "f", "t", "lith")


def subset_collars(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hole"), F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    kept = I.subset_collars(orders, [100.0, 50000.0], [900.0, 200000.0], lineitem_intervals(spark, sf_dir))[1]
    return kept.groupBy("hole").agg(F.count("*").alias("n"))


def common_support(spark, sf_dir):
    iv = lineitem_intervals(spark, sf_dir)
    return I.common_support(iv, _gappy(spark, sf_dir))


def asof_last_event(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    late = e.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    return asof_last(e, late.select("user_id", "ts", F.col("event_id").alias("last_id"), F.col("value").alias("last_value")), "user_id", "ts", ["last_id", "last_value"], "last_id").select("event_id", F.coalesce("last_id", F.lit(-1)).alias("last_id"), F.coalesce("last_value", F.lit(-1.0)).alias("last_value"))


_DOMAIN = (
    SQL_INTERVALS
    + """,
brk AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR abs(f - lag(t) OVER w) > 1e-6 OR lith IS DISTINCT FROM lag(lith) OVER w THEN 1 ELSE 0 END AS b FROM {src} WINDOW w AS (PARTITION BY hole ORDER BY f, t)),
isl AS (SELECT *, sum(b) OVER (PARTITION BY hole ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS r FROM brk),
run AS (SELECT hole, min(f) AS f, max(t) AS t, min(lith) AS lith FROM isl GROUP BY hole, r)"""
)
_CUT = "(SELECT * REPLACE (CASE WHEN status = 'F' THEN (f + t) / 2 ELSE t END AS t) FROM iv)"
_ALL, _GAPPY = _DOMAIN.replace("{src}", "iv"), _DOMAIN.replace("{src}", _CUT)
_CONTACTS = """
  SELECT hole, t AS depth, lith AS above, nl AS below FROM (SELECT *, lead(lith) OVER w AS nl, lead(f) OVER w AS nf FROM run WINDOW w AS (PARTITION BY hole ORDER BY f, t))
  WHERE nf IS NOT NULL AND abs(nf - t) <= 1e-6 AND lith IS DISTINCT FROM nl"""
_COLLAR = "col AS (SELECT o_orderkey AS hole, 150.0::DOUBLE AS length FROM orders)"

SQL = {
    "composite_mean": f"WITH {SQL_RUNS} SELECT hole, f, t, round(sum(o * grade) / sum(o), 6) AS grade FROM pairs GROUP BY hole, f, t",
    "composite_mass": f"WITH {SQL_RUNS} SELECT hole, f, t, round(sum(o * density * grade) / sum(o * density), 6) AS grade, round(sum(o * density) / sum(o), 6) AS density FROM pairs GROUP BY hole, f, t",
    "composite_majority": f"""WITH {SQL_RUNS}, v AS (SELECT hole, f, t, lith, round(sum(o), 9) AS len, min(src) AS first FROM pairs GROUP BY hole, f, t, lith)
        SELECT hole, f, t, lith FROM (SELECT *, row_number() OVER (PARTITION BY hole, f, t ORDER BY len DESC, first) AS k FROM v) WHERE k = 1""",
    "composite_longest": f"WITH {SQL_RUNS} SELECT hole, f, t, status FROM (SELECT *, row_number() OVER (PARTITION BY hole, f, t ORDER BY o DESC, src DESC) AS k FROM pairs) WHERE k = 1",
    "composite_bucketed": f"WITH {SQL_RUNS} SELECT hole, f, t, round(sum(o * grade) / sum(o), 6) AS grade FROM pairs GROUP BY hole, f, t",
    "overlap_lengths": f"WITH {SQL_RUNS} SELECT hole, f, src, round(o, 6) AS overlap FROM pairs WHERE src IS NOT NULL",
    "fixed_runs": f"WITH {SQL_RUNS} SELECT hole, f, t FROM runs",
    "merge_runs": f"WITH {_ALL} SELECT hole, f, t, lith FROM run",
    "composite_domain": f"""WITH {_ALL}, cut AS (SELECT *, greatest(1, floor((t - f) / 25.0 + 1e-6))::INT AS k FROM run),
        rr AS (SELECT hole, f + i * 25.0 AS f, CASE WHEN i = k - 1 THEN t ELSE f + (i + 1) * 25.0 END AS t FROM (SELECT *, unnest(range(0, k)) AS i FROM cut))
        SELECT r.hole, r.f, r.t, round(sum((least(r.t, s.t) - greatest(r.f, s.f)) * s.grade) / sum(least(r.t, s.t) - greatest(r.f, s.f)), 6) AS grade
        FROM rr r JOIN iv s ON r.hole = s.hole AND r.f < s.t AND s.f < r.t GROUP BY ALL""",
    "validate_intervals": f"""WITH {SQL_INTERVALS}, {_COLLAR}, g AS (SELECT hole, f, t, lag(t) OVER (PARTITION BY hole ORDER BY f, t) AS e FROM {_CUT})
        SELECT hole, f, t, 'non-positive length' AS issue, 'error' AS severity FROM g WHERE t <= f
        UNION ALL SELECT hole, f, t, 'overlaps the previous interval', 'error' FROM g WHERE f < e - 1e-6
        UNION ALL SELECT hole, f, t, 'gap after the previous interval', 'warning' FROM g WHERE f > e + 1e-6
        UNION ALL SELECT hole, f, t, 'hole is not in the collar table', 'error' FROM g ANTI JOIN col USING (hole)
        UNION ALL SELECT g.hole, f, t, 'interval runs past the end of the hole', 'warning' FROM g JOIN col USING (hole) WHERE t > length + 1e-6""",
    "fill_unlogged": f"""WITH {SQL_INTERVALS}, {_COLLAR}, g AS (SELECT hole, f, t, CASE WHEN lith <> 'N' THEN lith ELSE 'waste' END AS lith, lag(t) OVER (PARTITION BY hole ORDER BY f, t) AS e FROM {_CUT}),
        x AS (SELECT c.hole, length, coalesce(min(f), 0) AS top, coalesce(max(t), 0) AS bottom FROM col c LEFT JOIN g USING (hole) GROUP BY ALL)
        SELECT hole, f, t, lith FROM g UNION ALL SELECT hole, e, f, 'waste' FROM g WHERE f > e + 1e-6
        UNION ALL SELECT hole, 0.0, top, 'waste' FROM x WHERE top > 1e-6 UNION ALL SELECT hole, bottom, length, 'waste' FROM x WHERE length > bottom + 1e-6""",
    "contacts": f"WITH {_GAPPY} {_CONTACTS}",
    "classification_points": f"""WITH {_GAPPY}, cut AS (SELECT *, greatest(1, floor((t - f) / 7.0 + 1e-6))::INT AS k FROM run),
        rr AS (SELECT hole, lith, f + i * 7.0 AS f, CASE WHEN i = k - 1 THEN t ELSE f + (i + 1) * 7.0 END AS t FROM (SELECT *, unnest(range(0, k)) AS i FROM cut))
        SELECT hole, (f + t) * 0.5 AS depth, lith AS a, lith AS b, t - f AS length FROM rr UNION ALL SELECT hole, depth, above, below, 0.0 FROM ({_CONTACTS})""",
    "category_legend": f"WITH {SQL_INTERVALS} SELECT lith AS label, count(*) AS n, round(sum(t - f), 6) AS length, lith AS grouped FROM iv GROUP BY lith",
    "group_categories": "SELECT CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'first' WHEN p_brand = 'Brand#13' THEN 'second' WHEN p_brand IS NOT NULL THEN 'other' END AS family, count(*) AS n FROM part GROUP BY 1",
    "hole_extent": f"WITH {SQL_INTERVALS} SELECT hole, min(f) AS f, max(t) AS t FROM iv GROUP BY hole",
    "filter_whole_holes": f"WITH {SQL_INTERVALS} SELECT hole, f, t, lith FROM iv WHERE hole IN (SELECT hole FROM iv WHERE lith = 'A')",
    "subset_collars": "SELECT l_orderkey AS hole, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 100 AND 900 AND o_totalprice BETWEEN 50000 AND 200000) GROUP BY 1",
    "common_support": f"WITH {SQL_INTERVALS} , a AS (SELECT hole, f, t, count(*) AS n_a FROM iv GROUP BY ALL), b AS (SELECT hole, f, t, count(*) AS n_b FROM {_CUT} GROUP BY ALL) SELECT hole, f, t, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b USING (hole, f, t) WHERE coalesce(n_a, 0) <> coalesce(n_b, 0)",
    "asof_last_event": """SELECT event_id, coalesce(last_id, -1) AS last_id, coalesce(last_value, -1) AS last_value FROM (
        SELECT l.event_id, r.event_id AS last_id, r.value AS last_value, row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts DESC, r.event_id DESC) AS k
        FROM events l LEFT JOIN events r ON l.user_id = r.user_id AND r.ts + INTERVAL 1 HOUR <= l.ts) WHERE k = 1""",
}

SQL = {k: v.replace("round(", "round(3e-10 + ") for k, v in SQL.items()}

QUERIES = {
    f.__name__: f
    for f in (
        composite_mean, composite_mass, composite_majority, composite_longest, composite_bucketed, overlap_lengths, fixed_runs, merge_runs, composite_domain, validate_intervals,
        fill_unlogged, contacts, classification_points, category_legend, group_categories, hole_extent, filter_whole_holes, subset_collars, common_support, asof_last_event,
    )
}
