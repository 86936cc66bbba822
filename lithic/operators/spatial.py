"""Pairs of nearby points: declustering, variograms, nearest neighbours and folds."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.functions.core import BROADCAST_ROWS, cut, dealt, small_side

#: Right points that a cell of the first search for the nearest holds on average, and those gathered in one row.
CROWD, CHUNK = 8, 4096


def cell_counts(points: DataFrame, columns: list[str], cell: float | list[float], origins: int = 4, id_col: str = "loc_id") -> DataFrame:
    """id and weight: mean over shifted lattices of one over the points in the point's cell, not yet rescaled."""
    sides = [cell] * len(columns) if isinstance(cell, (int, float)) else list(cell)
    lattices = points.select(id_col, *columns, F.explode(F.sequence(F.lit(0), F.lit(origins - 1))).alias("__k"))
    keys = [F.floor((F.col(c) + F.col("__k") * F.lit(s / origins)) / s).alias(f"__c{i}") for i, (c, s) in enumerate(zip(columns, sides))]
    placed = lattices.select(id_col, "__k", *keys)
    names = ["__k", *(f"__c{i}" for i in range(len(columns)))]
    counts = placed.groupBy(*names).agg(F.count("*").alias("__n"))
    return placed.join(counts, names).groupBy(id_col).agg((F.sum(1 / F.col("__n")) / origins).alias("weight"))


def decluster(points: DataFrame, columns: list[str], values: str | None = None, cell: float | list[float] | None = None, origins: int = 4, n_sizes: int = 24, id_col: str = "loc_id") -> DataFrame:
    """id and declustering weight, weights adding up to the number of points.

    Without `cell`, the size is swept geometrically from about the spacing of points to about their
    extent, and the one whose weighted mean departs furthest from the plain mean is taken.
    """
    if cell is None:
        cell = choose_cell(points, columns, values, origins, n_sizes, id_col)
    raw = cell_counts(points, columns, cell, origins, id_col)
    n, total = raw.agg(F.count("*"), F.sum("weight")).first()
    return raw.withColumn("weight", F.col("weight") * F.lit(n / total if total else 1.0))


def choose_cell(points: DataFrame, columns: list[str], values: str, origins: int = 4, n_sizes: int = 24, id_col: str = "loc_id") -> float:
    """The cell size whose declustered mean is furthest from the plain one. All sizes are swept in one job."""
    row = points.agg(F.count("*"), *(F.max(c) - F.min(c) for c in columns), F.avg(values)).first()
    n, largest, naive = row[0], max(x or 0.0 for x in row[1:-1]), row[-1]
    if n < 2 or largest <= 0:
        return 1.0
    sizes = np.geomspace(max(largest / max(n ** (1 / len(columns)), 1.0), largest * 1e-3), largest, n_sizes).tolist()
    swept = points.select(id_col, *columns, values, F.explode(F.array(*map(F.lit, sizes))).alias("__s"))
    swept = swept.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(origins - 1))))
    keys = [F.floor((F.col(c) + F.col("__s") * F.col("__k") / origins) / F.col("__s")).alias(f"__c{i}") for i, c in enumerate(columns)]
    placed = swept.select("__s", "__k", values, *keys)
    cells = placed.groupBy("__s", "__k", *(f"__c{i}" for i in range(len(columns)))).agg(F.count("*").alias("n"), F.sum(values).alias("v"), F.count(values).alias("m"))
    means = cells.groupBy("__s").agg((F.sum(F.col("v") / F.col("n")) / F.sum(F.col("m") / F.col("n"))).alias("mean")).collect()
    return max(means, key=lambda r: (abs(r["mean"] - naive), -r["__s"]))["__s"]


def near_pairs(points: DataFrame, columns: list[str], reach: float, id_col: str = "loc_id", carry: list[str] = ()) -> DataFrame:
    """Pairs of points (a_*, b_*, a's id below b's) at most `reach` apart, with their lag `h`.

    Points are keyed by cells of side `reach` and one side is copied to neighbouring cells, so the
    self-join is an equi-join and never a cross join. Only half of the neighbours are visited. Neither
    side is broadcast: Spark takes the copied one for as small as it was.
    """
    key = [F.floor(F.col(c) / reach).cast("long") for c in columns]
    base = points.select(id_col, *columns, *carry)
    a = base.select(*(F.col(c).alias(f"a_{c}") for c in base.columns), *(k.alias(f"k{i}") for i, k in enumerate(key)))
    half = [o for o in itertools.product((-1, 0, 1), repeat=len(columns)) if o >= (0,) * len(columns)]
    moves = F.array(*(F.struct(*(F.lit(v).cast("long").alias(f"o{i}") for i, v in enumerate(o)), F.lit(not any(o)).alias("same")) for o in half))
    b = base.select(*(F.col(c).alias(f"b_{c}") for c in base.columns), *(k.alias(f"q{i}") for i, k in enumerate(key)), F.explode(moves).alias("m"))
    b = b.select(*(f"b_{c}" for c in base.columns), "m.same", *((F.col(f"q{i}") - F.col(f"m.o{i}")).alias(f"k{i}") for i in range(len(columns))))
    pairs = a.hint("merge").join(b, [f"k{i}" for i in range(len(columns))]).where(~F.col("same") | (F.col(f"a_{id_col}") < F.col(f"b_{id_col}")))
    h = F.sqrt(sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in columns), F.lit(0.0)))
    return pairs.withColumn("h", h).where(F.col("h") <= reach).drop("same", *(f"k{i}" for i in range(len(columns))))


def along(columns: list[str], direction: list[float], tolerance: float) -> Column:
    """Whether a pair's separation lies within `tolerance` degrees of a direction, either way."""
    size = math.sqrt(sum(d * d for d in direction))
    dot = sum(((F.col(f"b_{c}") - F.col(f"a_{c}")) * (d / size) for c, d in zip(columns, direction)), F.lit(0.0))
    return F.abs(dot) >= F.col("h") * math.cos(math.radians(tolerance)) - 1e-12


def variogram(points: DataFrame, columns: list[str], value: str, n_lags: int = 15, max_lag: float | None = None, direction: list[float] | None = None, tolerance: float = 45.0, weight: str | None = None, id_col: str = "loc_id") -> DataFrame:
    """lag bin, pairs, mean lag and semivariance (half the mean squared difference), pairs weighted by the
    product of their points' weights. The longest lag defaults to half the diagonal of the box."""
    if max_lag is None:
        row = points.agg(*(F.max(c) - F.min(c) for c in columns)).first()
        max_lag = 0.5 * math.sqrt(sum(x * x for x in row))
    usable = points.where(F.col(value).isNotNull())
    pairs = near_pairs(usable, columns, max_lag, id_col, [value, *([weight] if weight else [])])
    if direction is not None:
        pairs = pairs.where(along(columns, direction, tolerance))
    w = F.col(f"a_{weight}") * F.col(f"b_{weight}") if weight else F.lit(1.0)
    step = max_lag / n_lags
    d = F.col(f"a_{value}") - F.col(f"b_{value}")
    binned = pairs.where("h > 0").withColumn("lag", F.least(F.floor(F.col("h") / step), F.lit(n_lags - 1)).cast("int"))
    return binned.groupBy("lag").agg(F.count("*").alias("pairs"), (F.sum(w * F.col("h")) / F.sum(w)).alias("distance"), (F.sum(w * d * d) / F.sum(w) / 2).alias("gamma"))


def variogram_fan(points: DataFrame, columns: list[str], sims: str, n_lags: int, max_lag: float, id_col: str = "loc_id") -> DataFrame:
    """Semivariance per lag of every realization, from one pass over the pairs."""
    pairs = near_pairs(points, columns, max_lag, id_col, [sims]).where("h > 0")
    lag = F.least(F.floor(F.col("h") / (max_lag / n_lags)), F.lit(n_lags - 1)).cast("int")
    squares = F.zip_with(f"a_{sims}", f"b_{sims}", lambda x, y: (x - y) * (x - y))
    return pairs.select(lag.alias("lag"), F.posexplode(squares).alias("sim", "d2")).groupBy("lag", "sim").agg(F.count("*").alias("pairs"), (F.avg("d2") / 2).alias("gamma"))


def variogram_score(points: DataFrame, columns: list[str], truth: str, sims: str, reach: float, p: float = 0.5, id_col: str = "loc_id") -> DataFrame:
    """Mean over pairs within `reach` of the squared gap between |y_i - y_j|^p and its ensemble mean."""
    pairs = near_pairs(points, columns, reach, id_col, [truth, sims])
    seen = F.pow(F.abs(F.col(f"a_{truth}") - F.col(f"b_{truth}")), p)
    gaps = F.zip_with(f"a_{sims}", f"b_{sims}", lambda x, y: F.pow(F.abs(x - y), F.lit(p)))
    expected = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(gaps)
    return pairs.agg(F.avg((seen - expected) * (seen - expected)).alias("score"), F.count("*").alias("pairs"))


def nearest(left: DataFrame, right: DataFrame, columns: list[str], cell: float, left_id: str = "loc_id", right_id: str = "loc_id") -> DataFrame:
    """Each left point's nearest right point: left id, right id (the least of several as near), distance.

    Right points of one place count once. Cells of side `cell`, or finer ones where right points crowd,
    are searched first, then larger ones for the points whose answer may lie outside the neighbours,
    until none is left. A cell's neighbourhood is gathered once, so that each left point meets one row.
    Points with a coordinate that is null or not finite have no distance and no row; without right points there are none.
    """
    finite = lambda df: df.where(" AND ".join(f"abs(`{c}`) < double('infinity')" for c in columns))  # noqa: E731  also false for null and NaN
    names = [f"l_{c}" for c in columns]
    todo = dealt(finite(left).select(F.col(left_id).alias("l_id"), *(F.col(c).alias(f"l_{c}") for c in columns)), "l_id")
    r = cut(finite(right).groupBy(*(F.col(c).alias(f"r_{c}") for c in columns)).agg(F.min(right_id).alias("r_id")))
    n, largest = r.agg(F.count("*"), F.max(F.greatest(*(F.abs(f"r_{c}").cast("double") for c in columns), F.lit(0.0)))).first()
    if not n:
        return todo.where("false").select("l_id", F.lit(None).cast(r.schema["r_id"].dataType).alias("r_id"), F.lit(None).cast("double").alias("distance"))
    keys = [f"k{i}" for i in range(len(columns))]
    offsets = F.array(*(F.struct(*(F.lit(v).cast("long").alias(f"o{i}") for i, v in enumerate(o))) for o in itertools.product((-1, 0, 1), repeat=len(columns))))

    def crowd(side: float) -> tuple[float, int]:
        """Right points in the cell of one of them: mean and most."""
        cells = r.groupBy(*(F.floor(F.col(f"r_{c}") / side) for c in columns)).agg(F.count("*").alias("n"))
        return cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n"), F.max("n")).first()

    side, rounds, done = cell, 0, None
    while (found := crowd(side))[0] > CROWD and side / 4 > largest * 2.0**-50:
        side /= 4
    while True:
        chunks = math.ceil(found[1] / CHUNK)
        b = r.withColumn("m", F.explode(offsets)).withColumns({k: F.floor(F.col(f"r_{c}") / side).cast("long") + F.col(f"m.o{i}") for i, (k, c) in enumerate(zip(keys, columns))})
        b = b.groupBy(*keys, F.pmod(F.xxhash64(*(f"r_{c}" for c in columns)), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("r_id", *(f"r_{c}" for c in columns))).alias("near"))
        b = F.broadcast(b) if n * 3 ** len(columns) <= BROADCAST_ROWS else b.hint("merge")
        a = todo.withColumns({k: F.floor(F.col(f"l_{c}") / side).cast("long") for k, c in zip(keys, columns)})
        h = lambda p: F.sqrt(sum(((F.col(f"l_{c}") - p[f"r_{c}"]) ** 2 for c in columns), F.lit(0.0)))
        best = a.join(b, keys, "left").select("l_id", *names, F.array_min(F.transform("near", lambda p: F.struct(h(p).alias("distance"), p["r_id"].alias("r_id")))).alias("best"))
        best = cut(best.groupBy("l_id", *names).agg(F.min("best").alias("best")) if chunks > 1 else best)
        sure = F.coalesce(F.col("best.distance") <= side, F.lit(False))
        some = best.where(sure).select("l_id", "best")
        done = some if done is None else done.union(some)
        todo = best.where(~sure).select("l_id", *names)
        if todo.isEmpty():
            return done.groupBy("l_id").agg(F.min("best").alias("best")).select("l_id", "best.r_id", "best.distance")
        rounds += 1
        side *= 2 if rounds < 6 else 8
        found = crowd(side)


def snap_distinct(sources: list[DataFrame], columns: list[str], tolerance: float = 0.0) -> DataFrame:
    """Points of several sources in order, each dropped if an earlier one snaps to the same place."""
    tagged = [s.select(*columns, F.lit(i).alias("__src"), F.monotonically_increasing_id().alias("__row")) for i, s in enumerate(sources)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    place = [F.round(F.col(c) / tolerance) if tolerance > 0 else F.col(c) for c in columns]
    first = union.groupBy(*(p.alias(f"__p{i}") for i, p in enumerate(place))).agg(F.min(F.struct("__src", "__row", *columns)).alias("f"))
    return first.select("f.__src", "f.__row", *(f"f.{c}" for c in columns)).drop("__src", "__row")


def balanced_folds(groups: DataFrame, group: str, k: int) -> DataFrame:
    """group, n and fold: the largest group goes first, each to the fold with the fewest points.

    Only one row per group reaches the driver.
    """
    sizes = groups.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).collect()
    filled, out = [0] * k, []
    for r in sizes:
        fold = min(range(k), key=lambda i: (filled[i], i))
        filled[fold] += r["n"]
        out.append((r[group], r["n"], fold))
    return groups.sparkSession.createDataFrame(out, groups.select(group).schema.add("n", T.LongType()).add("fold", T.IntegerType()))


def kmeans_atoms(points: DataFrame, columns: list[str], k: int, seed: int = 1) -> DataFrame:
    """Points with the k-means cell (`atom`) that they fall in."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=columns, outputCol="__v").transform(points)
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="atom", maxIter=20).fit(v).transform(v).drop("__v")


def wasserstein_1(a: np.ndarray, b: np.ndarray) -> float:
    """Distance between two samples on the line: the area between their distribution functions."""
    x = np.sort(np.concatenate([a, b]))
    fa, fb = np.searchsorted(np.sort(a), x[:-1], "right") / len(a), np.searchsorted(np.sort(b), x[:-1], "right") / len(b)
    return float(np.sum(np.abs(fa - fb) * np.diff(x)))


def merge_clusters(centres: np.ndarray, weights: np.ndarray, cuts: list[int]) -> dict[int, np.ndarray]:
    """Ward merging of a bounded number of centres: labels at each number of clusters asked for."""
    n = len(centres)
    label, alive = np.arange(n), list(range(n))
    c, w, out = centres.astype(float).copy(), weights.astype(float).copy(), {}
    while alive:
        if len(alive) in cuts:
            out[len(alive)] = np.unique(label, return_inverse=True)[1]
        if len(alive) == 1:
            break
        p = np.array(alive)
        d = ((c[p, None] - c[None, p]) ** 2).sum(2) * (w[p, None] * w[None, p]) / (w[p, None] + w[None, p])
        np.fill_diagonal(d, np.inf)
        i, j = np.unravel_index(d.argmin(), d.shape)
        i, j = sorted((p[i], p[j]))
        c[i] = (w[i] * c[i] + w[j] * c[j]) / (w[i] + w[j])
        w[i] += w[j]
        label[label == j] = i
        alive.remove(j)
    return out


def spatial_k_fold(points: DataFrame, targets: DataFrame, columns: list[str], k: int = 5, group: str | None = None, id_col: str = "loc_id", cell: float = 1.0, seed: int = 1, candidates: int = 10, quantiles: int = 200) -> DataFrame:
    """Points with a `fold` whose held-out-to-training distances resemble the target-to-data distances.

    Atoms are groups or k-means cells, at most 25 k of them. Several Ward cuts of their centres are dealt
    to folds, largest first; the dealing whose nearest-neighbour distances lie closest to those of the
    targets (first Wasserstein distance between bounded quantile sketches) is taken.
    """
    if group is None:
        points, group = kmeans_atoms(points, columns, min(points.count(), 25 * k), seed), "atom"
    summary = points.groupBy(group).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in columns)).orderBy(group).collect()
    centres, sizes = np.array([[r[c] for c in columns] for r in summary]), np.array([r["n"] for r in summary])
    probs = np.linspace(0, 1, quantiles).tolist()

    def sketch(df):
        return np.array(df.agg(F.percentile("distance", probs).alias("q")).first()["q"])

    wanted = sketch(nearest(targets, points, columns, cell, id_col, id_col))
    cuts = sorted({int(x) for x in np.linspace(min(k, len(sizes)), len(sizes), candidates)})
    best = None
    spark = points.sparkSession
    for n, label in merge_clusters(centres, sizes, cuts).items():
        totals = np.bincount(label, sizes, n)
        fold, filled = np.zeros(n, int), np.zeros(k)
        for c in np.argsort(-totals, kind="stable"):
            fold[c] = filled.argmin()
            filled[fold[c]] += totals[c]
        rows = spark.createDataFrame([(r[group], int(fold[x])) for r, x in zip(summary, label)], points.select(group).schema.add("fold", T.IntegerType()))
        dealt = points.join(small_side(rows), group)
        parts = [nearest(dealt.where(F.col("fold") == f), dealt.where(F.col("fold") != f), columns, cell, id_col, id_col) for f in range(k) if filled[f] and filled.sum() > filled[f]]
        if not parts:
            continue
        gaps = parts[0]
        for x in parts[1:]:
            gaps = gaps.union(x)
        score = wasserstein_1(sketch(gaps), wanted)
        if best is None or score < best[0]:
            best = (score, dealt)
    return best[1]
