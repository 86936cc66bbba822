"""Interval algebra along drillholes: every table has hole, f (from) and t (to)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions.core import TOLERANCE, ratio

#: What compositing does with a column: weighted mean (by mass where a density is known, by length
#: otherwise), mean by length, label of greatest length, or value of the longest contributor.
ROLES = ("grade", "density", "recovery", "categorical", "flag", "ignore")

#: Divisors that turn a unit into a fraction of the whole (fixed values).
UNITS = {
    "fraction": 1.0, "ratio": 1.0, "1": 1.0,
    "%": 100.0, "pct": 100.0, "percent": 100.0, "wt%": 100.0,
    "ppm": 1e6, "g/t": 1e6, "mg/kg": 1e6,
    "ppb": 1e9, "ug/kg": 1e9, "mg/t": 1e9,
}


def divisor(unit: str | float) -> float:
    """The divisor of a unit by name, or a positive number as it is."""
    if isinstance(unit, str):
        if unit.strip().lower() not in UNITS:
            raise ValueError(f"unknown unit {unit!r}; known are {sorted(UNITS)}")
        return UNITS[unit.strip().lower()]
    if not unit > 0:
        raise ValueError("a divisor must be positive")
    return float(unit)


def depth_order() -> Window:
    return Window.partitionBy("hole").orderBy("f", "t")


def overlap_join(targets: DataFrame, sources: DataFrame, bucket: float | None = None, how: str = "inner") -> DataFrame:
    """Pairs of intervals of one hole that share a positive length, with that length as `overlap`.

    Source depths come out as sf and st. With `bucket`, both sides are also dealt over depth buckets of
    that size, so that a hole with very many intervals does not meet itself in one task; a pair counts
    in the first bucket that holds both.
    """
    s = sources.withColumnRenamed("f", "sf").withColumnRenamed("t", "st")
    inside = (F.col("f") < F.col("st")) & (F.col("sf") < F.col("t"))
    if bucket is None:
        joined = targets.join(s, (targets["hole"] == s["hole"]) & inside, how).drop(s["hole"])
    else:
        def spread(df, a, b, name):
            return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(a) / bucket), F.greatest(F.floor(F.col(a) / bucket), F.ceil(F.col(b) / bucket) - 1))))

        x, y = spread(targets, "f", "t", "__tb"), spread(s, "sf", "st", "__sb")
        first = F.col("__tb") == F.greatest(F.floor(F.col("f") / bucket), F.floor(F.col("sf") / bucket))
        joined = x.join(y, (x["hole"] == y["hole"]) & (x["__tb"] == y["__sb"]) & inside & first, "inner").drop(y["hole"]).drop("__tb", "__sb")
        if how == "left":
            joined = targets.join(joined, ["hole", "f", "t"], "left")
    return joined.withColumn("overlap", F.least("t", "st") - F.greatest("f", "sf"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Weighted mean of the values that are present; null where their weight is not positive."""
    return ratio(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def longest_contributor(value: Column, overlap: Column, position: Column) -> Column:
    """Value of the single longest piece, the later source row on a tie."""
    return F.max_by(value, F.when(overlap.isNotNull(), F.struct(overlap, position)))


def weighted_majority(pairs: DataFrame, keys: list[str], column: str, position: str = "src") -> DataFrame:
    """Per key the label of greatest summed overlap; on a tie the one seen first. Missing labels don't vote."""
    votes = pairs.where(F.col(column).isNotNull() & F.col("overlap").isNotNull()).groupBy(*keys, column).agg(F.sum("overlap").alias("__len"), F.min(position).alias("__first"))
    return votes.groupBy(*keys).agg(F.max_by(column, F.struct(F.round("__len", 9), -F.col("__first"))).alias(column))


def aggregate_onto(targets: DataFrame, sources: DataFrame, roles: dict[str, str], bucket: float | None = None) -> DataFrame:
    """Composite `sources` (with a row position `src`) onto target intervals by each column's role.

    Every target keeps its row; columns are null where nothing contributes. All columns are reduced
    from one overlap join.
    """
    unknown = {c: r for c, r in roles.items() if r not in ROLES}
    if unknown:
        raise ValueError(f"unknown roles {unknown}; known are {ROLES}")
    keys = ["hole", "f", "t"]
    needed = ["hole", "f", "t", "src", *roles]
    pairs = overlap_join(targets.select(*keys), sources.select(*needed), bucket, "left")
    density = next((c for c, r in roles.items() if r == "density"), None)
    mass = F.col("overlap") * F.coalesce(F.col(density), F.lit(1.0)) if density else F.col("overlap")
    plain = []
    for c, r in roles.items():
        if r == "grade":
            plain.append(weighted_mean(F.col(c), mass).alias(c))
        elif r in ("density", "recovery"):
            plain.append(weighted_mean(F.col(c), F.col("overlap")).alias(c))
        elif r == "ignore":
            plain.append(longest_contributor(F.col(c), F.col("overlap"), F.col("src")).alias(c))
    out = pairs.groupBy(*keys).agg(*plain) if plain else targets.select(*keys)
    for c, r in roles.items():
        if r in ("categorical", "flag"):
            out = out.join(weighted_majority(pairs, keys, c), keys, "left")
    return out.select(*keys, *roles)


def hole_extent(*tables: DataFrame) -> DataFrame:
    """hole, f, t: the depths that the tables cover together."""
    return reduce(DataFrame.union, (x.select("hole", "f", "t") for x in tables)).groupBy("hole").agg(F.min("f").alias("f"), F.max("t").alias("t"))


def fixed_runs(zones: DataFrame, length: float) -> DataFrame:
    """Cut zones (hole, f, t and others) into runs of `length`; the last takes the rest. `run` counts from 0."""
    n = F.greatest(F.lit(1), F.floor((F.col("t") - F.col("f")) / length + TOLERANCE)).cast("int")
    cut = zones.withColumn("__n", n).withColumn("run", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    start = F.col("f") + F.col("run") * F.lit(float(length))
    end = F.when(F.col("run") == F.col("__n") - 1, F.col("t")).otherwise(F.col("f") + (F.col("run") + 1) * F.lit(float(length)))
    return cut.withColumn("__f", start).withColumn("__t", end).drop("f", "t", "__n").withColumnsRenamed({"__f": "f", "__t": "t"})


def merge_runs(intervals: DataFrame, column: str) -> DataFrame:
    """Touching intervals of one label become one run (hole, f, t, label); null is a label too."""
    w = depth_order()
    before, ended = F.lag(column).over(w), F.lag("t").over(w)
    fresh = ended.isNull() | (F.abs(F.col("f") - ended) > TOLERANCE) | ~F.col(column).eqNullSafe(before)
    island = F.sum(F.when(fresh, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = intervals.select("hole", "f", "t", column, island.alias("__run"))
    return marked.groupBy("hole", "__run").agg(F.min("f").alias("f"), F.max("t").alias("t"), F.first(column).alias(column)).drop("__run")


def composite(intervals: dict[str, tuple[DataFrame, dict[str, str]]], length: float = 1.0, domain: tuple[str, str] | None = None) -> dict[str, DataFrame]:
    """Every table on runs of `length` over whole holes, or over runs of one label of `domain` (table, column)."""
    zones = merge_runs(intervals[domain[0]][0], domain[1]).select("hole", "f", "t") if domain else hole_extent(*(d for d, _ in intervals.values()))
    targets = fixed_runs(zones, length).select("hole", "f", "t")
    return {name: aggregate_onto(targets, table, roles) for name, (table, roles) in intervals.items()}


def composite_to(support: DataFrame, tables: dict[str, tuple[DataFrame, dict[str, str]]]) -> dict[str, DataFrame]:
    """Every table on the intervals of `support`."""
    return {name: aggregate_onto(support, table, roles) for name, (table, roles) in tables.items()}


def validate(intervals: DataFrame, collar: DataFrame | None = None) -> DataFrame:
    """A row for each problem: hole, f, t, issue, severity."""
    w = depth_order()
    ended = F.lag("t").over(w)
    rows = intervals.select("hole", "f", "t", ended.alias("__e"))
    issues = [
        (F.col("f").isNull() | F.col("t").isNull(), "missing depth", "error"),
        (F.col("t") <= F.col("f"), "non-positive length", "error"),
        (F.col("f") < F.col("__e") - TOLERANCE, "overlaps the previous interval", "error"),
        (F.col("f") > F.col("__e") + TOLERANCE, "gap after the previous interval", "warning"),
    ]
    if collar is not None:
        ends = collar.select("hole", F.col("length").alias("__l") if "length" in collar.columns else F.lit(None).cast("double").alias("__l"), F.lit(True).alias("__known"))
        rows = rows.join(ends, "hole", "left")
        issues += [(F.col("__known").isNull(), "hole is not in the collar table", "error"), (F.col("t") > F.col("__l") + TOLERANCE, "interval runs past the end of the hole", "warning")]
    found = F.array(*(F.when(test, F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))) for test, issue, severity in issues))
    return rows.withColumn("__p", F.explode(F.filter(found, lambda p: p.isNotNull()))).select("hole", "f", "t", "__p.issue", "__p.severity")


def fill_unlogged(intervals: DataFrame, column: str, label: str, collar: DataFrame | None = None) -> DataFrame:
    """Give ground without a label one: missing labels, gaps, and with `collar` (hole, length) the ends of holes.

    Returns hole, f, t and the column. A hole of the collar with no interval becomes one interval.
    """
    known = intervals.select("hole", "f", "t", F.coalesce(F.col(column), F.lit(label)).alias(column))
    ended = F.lag("t").over(depth_order())
    gaps = intervals.select("hole", ended.alias("__e"), "f").where(F.col("f") > F.col("__e") + TOLERANCE).select("hole", F.col("__e").alias("f"), F.col("f").alias("t"), F.lit(label).alias(column))
    out = known.unionByName(gaps)
    if collar is not None:
        covered = intervals.groupBy("hole").agg(F.min("f").alias("__top"), F.max("t").alias("__bottom"))
        extent = collar.select("hole", F.col("length").alias("__toe")).join(covered, "hole", "left").select("hole", "__toe", F.coalesce("__top", F.lit(0.0)).alias("__top"), F.coalesce("__bottom", F.lit(0.0)).alias("__bottom"))
        ends = F.array(
            F.when(F.col("__top") > TOLERANCE, F.struct(F.lit(0.0).alias("f"), F.col("__top").alias("t"))),
            F.when(F.col("__toe") > F.col("__bottom") + TOLERANCE, F.struct(F.col("__bottom").alias("f"), F.col("__toe").alias("t"))),
        )
        added = extent.withColumn("__x", F.explode(F.filter(ends, lambda x: x.isNotNull()))).select("hole", "__x.f", "__x.t", F.lit(label).alias(column))
        out = out.unionByName(added)
    return out


def contacts(intervals: DataFrame, column: str) -> DataFrame:
    """Depths where one label gives way to another: hole, depth, above, below."""
    runs = merge_runs(intervals, column)
    w = Window.partitionBy("hole").orderBy("f", "t")
    below, start = F.lead(column).over(w), F.lead("f").over(w)
    touching = runs.select("hole", F.col("t").alias("depth"), F.col(column).alias("above"), below.alias("below"), start.alias("__s"))
    differs = ~F.col("above").eqNullSafe(F.col("below"))
    return touching.where((F.abs(F.col("__s") - F.col("depth")) <= TOLERANCE) & differs).drop("__s")


def classification_points(intervals: DataFrame, column: str, length: float = 5.0) -> DataFrame:
    """Points every `length` within runs of a label, and the contacts as points of no length: hole, depth, a, b, length."""
    inside = fixed_runs(merge_runs(intervals, column).where(F.col(column).isNotNull()), length)
    points = inside.select("hole", ((F.col("f") + F.col("t")) * 0.5).alias("depth"), F.col(column).alias("a"), F.col(column).alias("b"), (F.col("t") - F.col("f")).alias("length"))
    return points.unionByName(contacts(intervals, column).select("hole", "depth", F.col("above").alias("a"), F.col("below").alias("b"), F.lit(0.0).alias("length")))


def category_legend(intervals: DataFrame, column: str) -> DataFrame:
    """Number and length of intervals per label, null included, and a copy of the label to regroup by."""
    return intervals.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"), F.sum(F.col("t") - F.col("f")).alias("length")).withColumn("grouped", F.col("label"))


def group_categories(intervals: DataFrame, column: str, groups: dict[str, list[str] | str], new_column: str | None = None, other: str | None = None) -> DataFrame:
    """Labels replaced by their group's name; unclaimed ones stay, or become `other`; null stays null."""
    owner: dict[str, str] = {}
    for name, members in groups.items():
        for m in [members] if isinstance(members, str) else members:
            if owner.setdefault(m, name) != name:
                raise ValueError(f"{m!r} belongs to {owner[m]!r} and {name!r}")
    label = F.col(column)
    mapped = F.element_at(F.create_map(*(F.lit(x) for kv in owner.items() for x in kv)), label) if owner else F.lit(None).cast("string")
    out = F.when(label.isNotNull(), F.coalesce(mapped, F.lit(other) if other is not None else label))
    return intervals.withColumn(new_column or column, out)


def subset_holes(holes: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The rows of each table whose hole is in `holes`."""
    return [x.join(holes.select("hole").distinct(), "hole", "left_semi") for x in tables]


def subset_collars(collar: DataFrame, low: list[float], high: list[float], *tables: DataFrame) -> list[DataFrame]:
    """Whole holes whose collar lies in a closed box over x, y and, with three bounds, z."""
    inside = collar
    for c, a, b in zip(("x", "y", "z"), low, high):
        inside = inside.where(F.col(c).between(a, b))
    return [inside, *subset_holes(inside, *tables)]


def filter_intervals(intervals: DataFrame, column: str, values: list, whole_holes: bool = False) -> DataFrame:
    """Intervals with one of `values`, or all intervals of holes that have one."""
    found = intervals.where(F.col(column).isin(values))
    return subset_holes(found, intervals)[0] if whole_holes else found


def common_support(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intervals that only one of two tables has; empty if they share their support."""
    keys = ["hole", "f", "t"]
    x, y = a.groupBy(*keys).agg(F.count("*").alias("n_a")), b.groupBy(*keys).agg(F.count("*").alias("n_b"))
    both = x.join(y, keys, "full_outer").select(*keys, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return both.where("n_a <> n_b")


def as_points(tables: list[DataFrame], position: float = 0.5) -> DataFrame:
    """Tables that share one support, side by side, with the depth at `position` of each interval and its length."""
    keys = ["hole", "f", "t"]
    joined = reduce(lambda a, b: a.join(b, keys), tables)
    return joined.withColumn("depth", F.col("f") + (F.col("t") - F.col("f")) * position).withColumn("length", F.col("t") - F.col("f"))


def prepare_composition(df: DataFrame, columns: list[str], units: str | float | dict = "fraction", rest: str | None = None) -> DataFrame:
    """Columns as parts of a whole: scaled to fractions, incomplete rows emptied, non-positive parts replaced.

    A part that is not positive becomes half the least positive value of its column. With `rest` the
    remainder to 1 is a further part (rows that leave nothing are scaled down to leave a half of its
    least positive value); without it the parts are closed to 1.
    """
    unit = {c: divisor(units[c] if isinstance(units, dict) else units) for c in columns}
    scaled = {c: F.col(c) / F.lit(unit[c]) for c in columns}
    complete = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    df = df.withColumns({c: F.when(complete, scaled[c]) for c in columns})
    least = df.agg(*(F.min(F.when(F.col(c) > 0, F.col(c))).alias(c) for c in columns)).first()
    df = df.withColumns({c: F.when(F.col(c) <= 0, F.lit((least[c] or 0.0) / 2)).otherwise(F.col(c)) for c in columns})
    whole = reduce(lambda a, b: a + b, (F.col(c) for c in columns))
    if rest is None:
        return df.withColumn("__s", whole).withColumns({c: F.col(c) / F.col("__s") for c in columns}).drop("__s")
    df = df.withColumn(rest, 1 - whole)
    spare = (df.agg(F.min(F.when(F.col(rest) > 0, F.col(rest))).alias("m")).first()["m"] or 2e-6) / 2
    crowded = F.col(rest) <= 0
    df = df.withColumn("__s", 1 - F.col(rest))
    df = df.withColumns({c: F.when(crowded, F.col(c) * (1 - spare) / F.col("__s")).otherwise(F.col(c)) for c in columns})
    return df.withColumn(rest, F.when(crowded, F.lit(spare)).otherwise(F.col(rest))).drop("__s")
