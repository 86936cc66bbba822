"""Hole traces by minimum curvature, and positions along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inclination(dip: Column, positive_down: bool = True) -> Column:
    """Radians from straight down of a dip in degrees."""
    return F.radians(F.lit(90.0) - (dip if positive_down else -dip))


def min_curvature(md0: Column, md1: Column, inc0: Column, inc1: Column, azm0: Column, azm1: Column) -> tuple[Column, Column, Column]:
    """Easting, northing and depth gained along a circular arc between two attitudes."""
    cosine = F.cos(inc1 - inc0) - F.sin(inc0) * F.sin(inc1) * (1 - F.cos(azm1 - azm0))
    bend = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    half = 0.5 * (md1 - md0) * F.when(bend < 1e-9, F.lit(1.0)).otherwise(2 / bend * F.tan(bend / 2))
    return (
        half * (F.sin(inc0) * F.sin(azm0) + F.sin(inc1) * F.sin(azm1)),
        half * (F.sin(inc0) * F.cos(azm0) + F.sin(inc1) * F.cos(azm1)),
        half * (F.cos(inc0) + F.cos(inc1)),
    )


def stations(collar: DataFrame, survey: DataFrame | None = None, positive_down: bool = True) -> DataFrame:
    """Survey stations with their coordinates: hole, depth, inc, azm, x, y, z and the next station's depth and attitude.

    A hole without surveys is straight, by its collar's dip and azimuth or straight down. A trace
    whose first station lies deeper starts at the collar with that station's attitude. Surveys of
    holes without a collar are left out (see `orphan_surveys`).
    """
    held = collar.select("hole", "x", "y", "z", F.col("dip").alias("__cd") if "dip" in collar.columns else F.lit(None).cast("double").alias("__cd"), F.col("azimuth").alias("__ca") if "azimuth" in collar.columns else F.lit(None).cast("double").alias("__ca"))
    down = 90.0 if positive_down else -90.0
    if survey is None:
        rows = held.select("hole", "x", "y", "z", F.lit(0.0).alias("depth"), F.coalesce("__cd", F.lit(down)).alias("dip"), F.coalesce("__ca", F.lit(0.0)).alias("azimuth"))
    else:
        joined = held.join(survey.select("hole", "depth", "dip", "azimuth"), "hole", "left")
        rows = joined.select("hole", "x", "y", "z", F.coalesce("depth", F.lit(0.0)).alias("depth"), F.coalesce("dip", "__cd", F.lit(down)).alias("dip"), F.coalesce("azimuth", "__ca", F.lit(0.0)).alias("azimuth"))
        place = F.row_number().over(Window.partitionBy("hole").orderBy("depth"))
        # A copy of the first station at the collar, where that station lies deeper.
        rows = rows.withColumn("__at", F.when((place == 1) & (F.col("depth") > 0), F.array(F.lit(0.0), F.col("depth"))).otherwise(F.array("depth")))
        rows = rows.withColumn("depth", F.explode("__at")).drop("__at")
    rows = rows.select("hole", "x", "y", "z", "depth", inclination(F.col("dip"), positive_down).alias("inc"), F.radians("azimuth").alias("azm"))
    w = Window.partitionBy("hole").orderBy("depth")
    lag = {c: F.lag(c).over(w) for c in ("depth", "inc", "azm")}
    east, north, vertical = min_curvature(lag["depth"], F.col("depth"), lag["inc"], F.col("inc"), lag["azm"], F.col("azm"))
    rows = rows.withColumns({"__e": F.coalesce(east, F.lit(0.0)), "__n": F.coalesce(north, F.lit(0.0)), "__v": F.coalesce(vertical, F.lit(0.0))})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "hole", "depth", "inc", "azm",
        (F.col("x") + F.sum("__e").over(upto)).alias("x"),
        (F.col("y") + F.sum("__n").over(upto)).alias("y"),
        (F.col("z") - F.sum("__v").over(upto)).alias("z"),
        F.lead("depth").over(w).alias("next_depth"), F.lead("inc").over(w).alias("next_inc"), F.lead("azm").over(w).alias("next_azm"),
    )


def orphan_surveys(collar: DataFrame, survey: DataFrame) -> DataFrame:
    """Surveys of holes that have no collar."""
    return survey.join(collar.select("hole"), "hole", "left_anti")


def asof_last(left: DataFrame, right: DataFrame, key: str, order: str, columns: list[str], tie: str | None = None, or_first: bool = False) -> DataFrame:
    """Each left row with the columns of the last right row of its key at or before `order`, or, if asked, of the first one after it.

    A union tagged by side and one window; no range join and no skew beyond that of the key.
    """
    blank = [F.lit(None).cast(right.schema[c].dataType).alias(f"__r_{c}") for c in columns]
    l = left.withColumn("__side", F.lit(1)).select("*", *blank)  # noqa: E741
    r = right.select(*(F.col(c) if c in (key, order) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.lit(0).alias("__side"), *(F.col(c).alias(f"__r_{c}") for c in columns))
    keyed = F.when(F.col("__side") == 0, F.struct(*(f"__r_{c}" for c in columns)))
    w = Window.partitionBy(key).orderBy(order, "__side", *([f"__r_{tie}"] if tie else []))
    last = F.last(keyed, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if or_first:
        last = F.coalesce(last, F.first(keyed, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    joined = l.unionByName(r).withColumn("__last", last).where("__side = 1")
    return joined.select(*left.columns, *(F.col(f"__last.__r_{c}").alias(c) for c in columns))


def coordinates_at(points: DataFrame, traces: DataFrame) -> DataFrame:
    """Points (hole, depth and others) with x, y, z on their trace: null for unknown holes, straight on past the last station."""
    cols = ["inc", "azm", "x", "y", "z", "next_depth", "next_inc", "next_azm"]
    right = traces.select("hole", "depth", F.col("depth").alias("station"), *cols)
    found = asof_last(points, right, "hole", "depth", ["station", *cols], or_first=True)
    get = {c: F.col(c) for c in ("station", "inc", "azm", "x", "y", "z")}
    following = {c: F.col(c) for c in ("next_depth", "next_inc", "next_azm")}
    span = following["next_depth"] - get["station"]
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(span > 0, (F.col("depth") - get["station"]) / span).otherwise(0.0)))
    inc = get["inc"] + share * F.coalesce(following["next_inc"] - get["inc"], F.lit(0.0))
    half_turn = F.lit(3.141592653589793)
    turn = F.pmod(following["next_azm"] - get["azm"] + half_turn, 2 * half_turn) - half_turn
    azm = get["azm"] + share * F.coalesce(turn, F.lit(0.0))
    east, north, vertical = min_curvature(get["station"], F.col("depth"), get["inc"], inc, get["azm"], azm)
    return found.select(*points.columns, (get["x"] + east).alias("x"), (get["y"] + north).alias("y"), (get["z"] - vertical).alias("z"))
