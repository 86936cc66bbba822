"""Tables that a step copies are not broadcast for being small before, and what one task holds stays bounded."""

import math

import pytest
from pyspark.sql import functions as F

from lithic.functions import core
from lithic.operators import contour, spatial
from lithic.plans import drillholes
from lithic.sources import tables


@pytest.fixture
def plans(spark, monkeypatch):
    """Plans of what was written meanwhile, as they were run."""
    seen = []
    real = contour.cut

    def noted(df):
        out = real(df)
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(contour, "cut", noted)
    return seen


def test_points_are_not_broadcast_for_distances(spark, plans, tmp_path):
    spark.range(400).select(F.col("id").alias("loc_id"), *((F.col("id") % k / 3.0).alias(c) for k, c in ((7, "x"), (11, "y"), (13, "z")))).write.parquet(f"{tmp_path}/points")
    full = spark.createDataFrame([(i, *(float(x + i) for x in (0, 0, 0, 1, 0, 0, 0, 1, 0))) for i in range(3)], "f long, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz"))
    got = contour.face_distances(spark.read.parquet(f"{tmp_path}/points"), full)
    assert got.count() == 400
    plan = plans[0].split("+- == Initial Plan ==")[0]
    side = plan[plan.index("BroadcastExchange") :] if "BroadcastExchange" in plan else ""
    assert "parquet" not in side.split("FileScan")[0] and "FileScan" not in side


def test_right_points_crowd_in_few_places(spark):
    left = spark.range(3000).select((F.col("id") % 2900).alias("loc_id"), (F.col("id") % 97 / 10.0).alias("x"), (F.col("id") % 2 * 1.0).alias("y"))
    right = spark.range(20_000).select((20_000 - F.col("id")).alias("loc_id"), (F.col("id") % 10 / 7.0).alias("x"), F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("y"))
    line = spark.range(5000).select((30_000 + F.col("id")).alias("loc_id"), (5 + F.col("id") / 5000).alias("x"), F.lit(0.25).alias("y"))
    got = {r.l_id: (r.r_id, r.distance) for r in spatial.nearest(left, right.union(line), ["x", "y"], 50.0).collect()}
    places: dict = {}
    for r in right.union(line).collect():
        places[(r.x, abs(r.y))] = min(places.get((r.x, abs(r.y)), 1 << 60), r.loc_id)
    want: dict = {}
    for p in left.collect():
        want[p.loc_id] = min([*([want[p.loc_id]] if p.loc_id in want else []), *((math.sqrt((p.x - x) ** 2 + (p.y - y) ** 2), k) for (x, y), k in places.items())])
    assert got.keys() == want.keys() and all(got[k] == (i, d) or (got[k][0] == i and abs(got[k][1] - d) < 1e-12) for k, (d, i) in want.items())


def test_left_points_meet_few_right_ones_however_many_there_are(spark, monkeypatch):
    met, real = [], spatial.F.broadcast

    def noted(df):
        if "near" in df.columns:
            met.append(df.agg(F.max(F.size("near"))).first()[0])
        return real(df)

    monkeypatch.setattr(spatial.F, "broadcast", noted)
    line = spark.range(4000).select(F.col("id").alias("loc_id"), (F.col("id") / 40.0).alias("x"))
    assert spatial.nearest(line, line.union(line), ["x"], 50.0).where("l_id = r_id AND distance = 0").count() == 4000
    assert len(met) == 1 and met[0] <= 3 * spatial.CROWD + 3


def test_intervals_are_dealt_by_their_number(spark):
    assert core.dealt(spark.range(1000), "id", rows=10).rdd.getNumPartitions() == 100
    plan = drillholes.lineitem_intervals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_drawings_are_split_and_read_by_entity(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "FILE_FACES", 10)
    p = spark.range(50).coalesce(1)
    v = p.select(F.explode(F.array(*(F.struct((F.col("id") * 3 + i).alias("v"), (F.col("id") * 10.0 + x).alias("x"), F.lit(float(y)).alias("y"), F.lit(1.0).alias("z")) for i, (x, y) in enumerate(((0, 0), (4, 0), (0, 3)))))).alias("c")).select("c.*")
    tables.write_dxf(v, p.select(F.col("id").alias("f"), *((F.col("id") * 3 + i).alias(k) for i, k in enumerate("abc"))), f"{tmp_path}/a")
    assert max(len(x.read_text().split("3DFACE")) - 1 for x in (tmp_path / "a").glob("part-*")) <= 10
    assert tables.read_dxf(spark, f"{tmp_path}/a")[1].count() == 50


def test_neither_side_of_near_pairs_is_broadcast(spark, tmp_path):
    spark.range(400).select(F.col("id").alias("loc_id"), (F.col("id") % 20.0).alias("x")).write.parquet(f"{tmp_path}/p")
    pairs = spatial.near_pairs(spark.read.parquet(f"{tmp_path}/p"), ["x"], 1.0)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
