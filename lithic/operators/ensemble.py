"""Locations with an array of realizations each: derived variables, change of support, grade and tonnage."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions.arrays import array_mean, cdf, clean, sorted_quantile


def with_quantiles(df: DataFrame, sims: str, probabilities: list[float]) -> DataFrame:
    """A column q_<p> for each probability, linear between order statistics."""
    s = F.array_sort(clean(F.col(sims)))
    return df.withColumn("__s", s).withColumns({f"q_{p:g}": sorted_quantile(F.col("__s"), p) for p in probabilities}).drop("__s")


def with_probabilities(df: DataFrame, sims: str, cutoffs: list[float]) -> DataFrame:
    """A column p_<cut-off> with the share of realizations at or below it."""
    return df.withColumns({f"p_{c:g}": cdf(F.col(sims), c) for c in cutoffs})


def derive(df: DataFrame, name: str, function: Callable[..., Column], sims: list[str], plain: list[str] = (), mean: str | None = None) -> DataFrame:
    """A new ensemble: `function` over realization j of every argument, then plain columns whole.

    Its prediction is the mean of the outputs. All arguments must have as many realizations.
    """
    counts = [F.size(c) for c in sims]
    alike = F.lit(True)
    for c in counts[1:]:
        alike &= c == counts[0]
    joined = F.arrays_zip(*(F.col(c) for c in sims))
    out = F.transform(joined, lambda r: function(*(r[c] for c in sims), *(F.col(p) for p in plain)))
    out = F.when(alike, out).otherwise(F.raise_error(F.lit("arguments differ in their number of realizations")).cast("array<double>"))
    df = df.withColumn(name, out)
    return df.withColumn(mean or f"{name}_mean", array_mean(F.col(name)))


def change_of_support(df: DataFrame, block: str, sims: str, cutoffs: list[float]) -> DataFrame:
    """Sub-block realizations to blocks: the mean per realization, then what only the sub-blocks know.

    `dispersion` is the mean over realizations of the population variance within a block;
    proportion_<c> the share of sub-block values at or below a cut-off over all realizations;
    divided_<c> the share of realizations in which the block lies on both sides of it.
    """
    flat = df.select(block, F.posexplode(sims).alias("sim", "v"))
    below = [(c, F.when(F.col("v") <= c, 1).otherwise(0)) for c in cutoffs]
    per = flat.groupBy(block, "sim").agg(F.avg("v").alias("m"), F.var_pop("v").alias("d"), F.count("v").alias("n"), *(F.sum(b).alias(f"__b{i}") for i, (_, b) in enumerate(below)))
    return per.groupBy(block).agg(
        F.avg("m").alias("mean"),
        F.avg("d").alias("dispersion"),
        F.transform(F.array_sort(F.collect_list(F.struct("sim", "m"))), lambda x: x["m"]).alias("sims"),
        *((F.sum(f"__b{i}") / F.sum("n")).alias(f"proportion_{c:g}") for i, c in enumerate(cutoffs)),
        *(F.avg(F.when((F.col(f"__b{i}") > 0) & (F.col(f"__b{i}") < F.col("n")), 1.0).otherwise(0.0)).alias(f"divided_{c:g}") for i, c in enumerate(cutoffs)),
    )


def cutoff_range(df: DataFrame, sims: str, n: int) -> list[float]:
    """`n` cut-offs spread evenly over the finite values."""
    v = clean(F.col(sims))
    low, high = df.agg(F.min(F.array_min(v)), F.max(F.array_max(v))).first()
    return np.linspace(low, high, n).tolist()


#: Cut-offs that one search by halves covers.
TREE = 64


def _cleared(value: Column, levels: list[float], first: int = 0) -> Column:
    """How many of the increasing levels a value reaches: a search by halves, as one expression."""
    if not levels:
        return F.lit(first)
    mid = len(levels) // 2
    return F.when(value >= levels[mid], _cleared(value, levels[mid + 1 :], first + mid + 1)).otherwise(_cleared(value, levels[:mid], first))


def grade_tonnage(df: DataFrame, sims: str, cutoffs: list[float] | int = 30, volume: float | str = 1.0, density: float | str | None = None, uncertainty: str | None = None, max_uncertainty: float | None = None) -> DataFrame:
    """For each cut-off and realization: tonnage of what clears it, its metal and mean grade.

    A value is filed under the highest cut-off that it clears, in one pass: values stream out of their
    arrays into sums per task, cut-off and realization, and only these are shuffled. Curves are running
    totals from the top. `density` is a number, a column, or
    an array column with a value per realization. Values that are missing clear nothing.
    """
    if max_uncertainty is not None:
        if uncertainty is None:
            raise ValueError("name the uncertainty column to filter by")
        df = df.where(F.col(uncertainty).isNotNull() & ~F.isnan(uncertainty) & (F.col(uncertainty) <= max_uncertainty))
    levels = cutoff_range(df, sims, cutoffs) if isinstance(cutoffs, int) else sorted(map(float, cutoffs))
    mass = F.lit(float(volume)) if not isinstance(volume, str) else F.col(volume)
    paired = isinstance(density, str) and df.schema[density].dataType.typeName() == "array"
    if density is not None and not paired:
        mass = mass * (F.col(density) if isinstance(density, str) else float(density))
    flat = df.select(F.posexplode(F.arrays_zip(F.col(sims).alias("v"), F.col(density).alias("d")) if paired else sims).alias("sim", "x"), mass.cast("double").alias("w"))
    value = (F.col("x.v") if paired else F.col("x")).cast("double")
    flat = flat.select("sim", value.alias("v"), (F.col("w") * F.col("x.d").cast("double") if paired else F.col("w")).alias("w"))
    finite = (F.abs("v") < float("inf")) & (F.abs("w") < float("inf"))  # false for NaN, which is above all numbers
    flat = flat.withColumn("k", F.when(finite, reduce(lambda out, at: F.when(F.col("v") >= levels[at], _cleared(F.col("v"), levels[at : at + TREE], at)).otherwise(out), range(0, len(levels), TREE), F.lit(0))).otherwise(0))
    part = lambda c: F.sum(F.when(F.col("k") > 0, c).otherwise(0.0))
    binned = flat.groupBy("sim", "k").agg(part(F.col("w")).alias("w"), part(F.col("w") * F.col("v")).alias("m"))
    # At most (cut-offs + 1) bins per realization: each counts for every cut-off it clears.
    curves = binned.groupBy("sim").agg(F.sort_array(F.collect_list(F.struct("k", "w", "m"))).alias("bins")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1))))
    above = lambda part: F.aggregate(F.filter("bins", lambda b: b["k"] > F.col("i")), F.lit(0.0), lambda t, b: t + b[part])
    out = curves.select("sim", F.element_at(F.array(*map(F.lit, levels)), F.col("i") + 1).alias("cutoff"), above("w").alias("tonnage"), above("m").alias("metal"))
    return out.withColumn("grade", F.when(F.col("tonnage") > 0, F.col("metal") / F.col("tonnage")))


def realizations(df: DataFrame, sims: str, prediction: str) -> DataFrame:
    """Rows with their realizations, or the prediction as the only one."""
    return df.withColumn(sims, F.coalesce(F.when(F.size(sims) > 0, F.col(sims)), F.array(F.col(prediction).cast("double"))))


def select_simulations(df: DataFrame, sims: str, selection: bool | int | list[int], n: int) -> DataFrame:
    """Realizations as columns: none, all, the first k, or those listed."""
    if selection is False:
        which = []
    elif selection is True:
        which = list(range(n))
    elif isinstance(selection, int):
        which = list(range(min(selection, n)))
    else:
        which = list(selection)
    if any(not 0 <= i < n for i in which):
        raise IndexError(f"realizations run from 0 to {n - 1}")
    return df.withColumns({f"{sims}_{i}": F.element_at(sims, i + 1) for i in which}).drop(sims)


def combine_models(df: DataFrame, means: list[str], variances: list[str], explained: list[str]) -> DataFrame:
    """Ensemble members on one row: mean weighted by explained variance, and sum of squared weights times variances."""
    whole = sum((F.col(c) for c in explained[1:]), F.col(explained[0]))
    share = [F.col(c) / whole for c in explained]
    mean = sum((w * F.col(m) for w, m in zip(share, means)), F.lit(0.0))
    var = sum((w * w * F.col(v) for w, v in zip(share, variances)), F.lit(0.0))
    return df.withColumns({"mean": mean, "variance": var})
