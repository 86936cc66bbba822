"""Connected pieces of a distributed list of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.functions.core import cut


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the least node that a node (u, w long) is linked with, for every node of `edges`.

    In turn every larger neighbour is tied to the least of a node's neighbourhood, then every smaller
    one; edges become stars about the roots after rounds that grow with the logarithm of the nodes.
    """
    links = cut(edges.select(F.greatest("u", "w").alias("u"), F.least("u", "w").alias("w")).where("u <> w").distinct())
    before = None
    while True:
        both = links.union(links.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
        links = both.join(least, "u").where("w > u").select(F.col("w").alias("u"), F.col("m").alias("w")).distinct()
        down = links.groupBy("u").agg(F.min("w").alias("m"))
        links = cut(links.join(down, "u").select(F.col("w").alias("u"), F.col("m").alias("w")).union(down.select("u", F.col("m").alias("w"))).where("u <> w").distinct())
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "w"))).first()
        if now == before or not now[0]:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("w").alias("root")).union(links.select(F.col("w"), F.col("w")).distinct())
