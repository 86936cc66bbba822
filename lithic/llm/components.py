"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node's neighbours on one side are linked to the least of its neighbourhood instead."""
    if large:
        sides = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = sides.join(least, "a")
    if large:
        found = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        found = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return found.where("a <> b").distinct()


def connected_components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """node, root (the least node of its component) for every node of `edges` (a long, b long).

    Alternates large-star and small-star rounds until the edges are stars about the roots; the
    number of rounds grows with the logarithm of the nodes. Edges stay distributed throughout and
    are written to the shared folder after each round, to at most `files` files. Self-loops and repeats do no harm; nodes
    that occur only in self-loops are not returned.
    """
    mark = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"))
    edges, before = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", files), None
    while True:
        edges = stage(_star(_star(edges, True), False), "stars", files)
        now = tuple(edges.agg(*mark).first())
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
