"""Null policy and small column helpers used throughout."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Depths closer than this are the same depth.
TOLERANCE = 1e-6

#: Rows up to which a side of a join is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000

#: Rows that a task gets of a table dealt over as many tasks as it needs.
TASK_ROWS = 250_000


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating-point column, so that aggregates skip it."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where bottom is not positive."""
    return F.when(bottom > 0, top / bottom)


def all_present(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, (c.isNotNull() for c in columns))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder and read back: short plans, and a lost executor repeats one step.

    The folder is the session's; without one a local folder serves in local mode, and a cluster is refused.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(found or "/tmp/checkpoints")
    return df.checkpoint()


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it holds few rows; as it is otherwise, for Spark to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dealt(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """`df` dealt over `keys` into as many parts as it has times `rows` rows, and no fewer than there are cores.

    A fixed number of parts would let one task hold ever more as tables grow, and small files are read by few tasks.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows))
    return df.repartition(parts, *keys)


def order_statistics(df: DataFrame, column: str, ranks: list[int], bins: int = 1024) -> dict[int, float]:
    """Values at 1-based ranks among those that are neither null nor NaN; ranks beyond them are left out.

    Histograms, each over the bins of the one before that hold the ranks, until a bin holds one value
    only: no task sorts or keeps all values, and the driver gets at most `bins` rows for each rank.
    """
    v = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n, low, high = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    state = {r: (low, high, r) for r in ranks if 1 <= r <= n}
    while spans := sorted({(a, b) for a, b, _ in state.values() if a < b}):
        given = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(spans)))
        hit = v.withColumn("s", F.explode(F.filter(given, lambda s: F.col("v").between(s["a"], s["b"])))).select("v", "s.i", "s.a", "s.b")
        place = F.least(F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))
        counts: dict[int, list] = {}
        for i, p, k, lo, hi in hit.groupBy("i", place.alias("p")).agg(F.count("*"), F.min("v"), F.max("v")).collect():
            counts.setdefault(i, []).append((p, k, lo, hi))
        for r, (a, b, rest) in state.items():
            if a < b:
                for _, k, lo, hi in sorted(counts[spans.index((a, b))]):
                    if rest <= k:
                        state[r] = (lo, hi, rest)
                        break
                    rest -= k
    return {r: a for r, (a, _, _) in state.items()}


def percentiles(df: DataFrame, column: str, probabilities: list[float]) -> list[float | None]:
    """Quantiles, linear between order statistics; see `order_statistics`. None without values."""
    n = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    at = [p * (n - 1) + 1 for p in probabilities]
    found = order_statistics(df, column, sorted({r for x in at for r in (math.floor(x + 1e-9), math.ceil(x - 1e-9))})) if n else {}
    if not n:
        return [None] * len(at)
    ends = [(math.floor(x + 1e-9), math.ceil(x - 1e-9), x) for x in at]
    return [found[a] + (found[b] - found[a]) * max(0.0, x - a) for a, b, x in ends]
