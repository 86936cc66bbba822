"""Scores of predictions: one aggregate each, so any grouping works."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions.arrays import array_mean, array_var, clean, crps, interval_score, let, sorted_quantile
from lithic.functions.composition import aitchison
from lithic.functions.core import order_statistics, percentiles

#: Probabilities whose central intervals `coverage` looks at by default.
PROBABILITIES = [k / 20 for k in range(1, 20)]


def rmse(truth: str, prediction: str) -> Column:
    d = F.col(prediction) - F.col(truth)
    return F.sqrt(F.avg(d * d))


def mae(truth: str, prediction: str) -> Column:
    return F.avg(F.abs(F.col(prediction) - F.col(truth)))


def bias(truth: str, prediction: str) -> Column:
    return F.avg(F.col(prediction) - F.col(truth))


def mean_crps(truth: str, sims: str) -> Column:
    return F.avg(crps(F.col(truth), F.col(sims)))


def mean_interval_score(truth: str, sims: str, alpha: float = 0.05) -> Column:
    return F.avg(interval_score(F.col(truth), F.col(sims), alpha))


def bias_variance(truth: str, sims: str) -> tuple[Column, Column]:
    """Mean squared bias of the ensemble mean, and mean population variance."""
    v = clean(F.col(sims))
    miss = let(array_mean(v) - F.col(truth), lambda d: d * d)
    return F.avg(miss), F.avg(array_var(v))


def coverage(df: DataFrame, truth: str, sims: str, probabilities: list[float] | None = None, by: list[str] = ()) -> DataFrame:
    """Share of truths inside the central interval of each probability."""
    s = F.array_sort(clean(F.col(sims)))
    ready = df.select(*by, F.col(truth).alias("__y"), s.alias("__s"))
    p = ready.withColumn("probability", F.explode(F.array(*(F.lit(float(x)) for x in probabilities or PROBABILITIES))))
    low, high = sorted_quantile(F.col("__s"), (1 - F.col("probability")) / 2), sorted_quantile(F.col("__s"), (1 + F.col("probability")) / 2)
    inside = (F.col("__y") >= low) & (F.col("__y") <= high)
    return p.groupBy(*by, "probability").agg(F.avg(inside.cast("double")).alias("observed"))


def goodness(cover: DataFrame) -> DataFrame:
    """One less the trapezoid area between observed and nominal coverage over its span; too little coverage counts twice."""
    gap = F.col("observed") - F.col("probability")
    w = Window.orderBy("probability")
    d = cover.withColumn("d", F.when(gap < 0, -2 * gap).otherwise(gap))
    piece = (F.col("probability") - F.lag("probability").over(w)) * (F.col("d") + F.lag("d").over(w)) / 2
    return d.withColumn("a", piece).agg((1 - F.sum("a") / (F.max("probability") - F.min("probability"))).alias("goodness"))


def mean_aitchison(a: Column, b: Column) -> Column:
    return F.avg(aitchison(a, b))


def confusion(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """measured, predicted, n, share of the measured label, and overall agreement; missing labels are left out."""
    counts = df.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull()).groupBy(F.col(truth).alias("measured"), F.col(prediction).alias("predicted")).agg(F.count("*").alias("n"))
    row, everything = Window.partitionBy("measured"), Window.partitionBy()
    hit = F.when(F.col("measured") == F.col("predicted"), F.col("n")).otherwise(0)
    return counts.select("measured", "predicted", "n", (F.col("n") / F.sum("n").over(row)).alias("share"), (F.sum(hit).over(everything) / F.sum("n").over(everything)).alias("agreement"))


def one_vs_rest(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Per label: balanced accuracy, Jaccard index and Matthews correlation of that label against all others."""
    counts = df.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull()).groupBy(F.col(truth).alias("y"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    cells = counts.withColumn("total", total)
    labels = cells.select("y", "p", "n", "total", F.explode(F.array_distinct(F.array("y", "p"))).alias("label"))
    sums = labels.groupBy("label").agg(
        F.sum(F.when((F.col("y") == F.col("label")) & (F.col("p") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("y") != F.col("label")) & (F.col("p") == F.col("label")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("y") == F.col("label")) & (F.col("p") != F.col("label")), F.col("n")).otherwise(0)).alias("fn"),
        F.first("total").alias("total"),
    )
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    tn = F.col("total") - tp - fp - fn
    half = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return sums.select("label", ((half(tp, fn) + half(tn, fp)) / 2).alias("balanced_accuracy"), half(tp, fp + fn).alias("jaccard"), F.when(spread > 0, (tp * tn - fp * fn) / spread).otherwise(0.0).alias("matthews"))


def compute_metrics(df: DataFrame, truth: str, prediction: str, sims: str, alpha: float = 0.05, by: list[str] = ()) -> DataFrame:
    """Point, ensemble and interval scores over measured rows in one aggregate."""
    squared, variance = bias_variance(truth, sims)
    return df.where(F.col(truth).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), rmse(truth, prediction).alias("rmse"), mae(truth, prediction).alias("mae"), bias(truth, prediction).alias("bias"),
        mean_crps(truth, sims).alias("crps"), mean_interval_score(truth, sims, alpha).alias("interval_score"), squared.alias("bias2"), variance.alias("variance"),
    )


def vector_metrics(df: DataFrame, components: dict[str, tuple[str, str, str]], alpha: float = 0.05) -> DataFrame:
    """`compute_metrics` of every component (truth, prediction, sims) of a vector, a row each, in one pass."""
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("component"), F.col(t).cast("double").alias("t"), F.col(p).cast("double").alias("p"), F.col(s).alias("s")) for k, (t, p, s) in components.items())))
    return compute_metrics(df.select(parts.alias("x")).select("x.*"), "t", "p", "s", alpha, ["component"])


def composition_metrics(df: DataFrame, components: dict[str, tuple[str, str, str]], alpha: float = 0.05) -> DataFrame:
    """`vector_metrics`, and with every row the mean Aitchison distance between compositions measured whole and predicted."""
    truth, predicted = (F.array(*(F.col(c[i]).cast("double") for c in components.values())) for i in (0, 1))
    whole = df.where(" AND ".join(f"`{t}` IS NOT NULL" for t, _, _ in components.values()))
    return vector_metrics(df, components, alpha).join(F.broadcast(whole.agg(F.avg(aitchison(truth, predicted)).alias("aitchison"))))


def reliability(df: DataFrame, claim: str, hit: str, bins: int = 10) -> DataFrame:
    """Equal-count bins of claimed probability: n, mean claim, observed frequency and each bin's part of the calibration error."""
    edges = F.array(*map(F.lit, percentiles(df, claim, [k / bins for k in range(1, bins)])))
    placed = df.withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col(claim))))
    out = placed.groupBy("bin").agg(F.count("*").alias("n"), F.avg(claim).alias("claimed"), F.avg(F.col(hit).cast("double")).alias("observed"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return out.withColumn("ece_part", share * F.abs(F.col("claimed") - F.col("observed")))


def spread_check(df: DataFrame, truth: str, prediction: str, variance: str, noise: str, bins: int = 8) -> DataFrame:
    """Per bin of the predicted value: residual RMS with its standard error, and the spread that the model claims."""
    edges = F.array(*map(F.lit, percentiles(df, prediction, [k / bins for k in range(1, bins)])))
    placed = df.withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col(prediction))))
    r = F.col(truth) - F.col(prediction)
    rms = F.sqrt(F.avg(r * r))
    return placed.groupBy("bin").agg(
        F.count("*").alias("n"), F.avg(prediction).alias("predicted"), rms.alias("rms"), (rms / F.sqrt(2 * F.count("*"))).alias("rms_error"),
        F.sqrt(F.avg(noise)).alias("noise"), F.sqrt(F.avg(F.col(variance) + F.col(noise))).alias("spread"),
    )


def entropy(probabilities: Column) -> Column:
    """Entropy of an array of probabilities over the log of their number."""
    terms = F.transform(probabilities, lambda p: F.when(p > 0, -p * F.log(p)).otherwise(0.0))
    return F.when(F.size(probabilities) > 1, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / F.log(F.size(probabilities).cast("double"))).otherwise(0.0)


def conformal_nominal(df: DataFrame, pit: str, coverages: list[float], bins: int = 1024) -> dict[float, float]:
    """For each coverage twice the order statistic of |PIT - 1/2| at its finite-sample rank; 1 beyond the last."""
    scores = df.where(F.col(pit).isNotNull() & ~F.isnan(pit)).select(F.abs(F.col(pit).cast("double") - 0.5).alias("s"))
    n = scores.count()
    if not n:
        raise ValueError("there are no PIT values to calibrate on")
    ranks = {c: math.ceil((n + 1) * c - 1e-12) for c in coverages}
    found = order_statistics(scores, "s", sorted({*ranks.values()}), bins)
    return {c: min(1.0, 2 * found[r]) if r in found else 1.0 for c, r in ranks.items()}


def conformal_interval(df: DataFrame, samples: str, level: float, low: str = "lower", high: str = "upper") -> DataFrame:
    """`df` with the central interval of each row's samples at a calibrated level."""
    s = F.array_sort(clean(F.col(samples)))
    ends = let(s, lambda a: F.struct(sorted_quantile(a, max(0.0, 0.5 - level / 2)).alias("l"), sorted_quantile(a, min(1.0, 0.5 + level / 2)).alias("h")))
    return df.withColumn("__e", ends).withColumns({low: F.col("__e.l"), high: F.col("__e.h")}).drop("__e")
