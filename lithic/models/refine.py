"""Block models refined where a prediction leaves blocks divided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.functions.core import cut
from lithic.operators.blocks import ORIGIN, BlockSet
from lithic.operators.ensemble import change_of_support


def predict_blocks(model, lattice: BlockSet, blocks: DataFrame, cutoffs: list[float], n_sim: int = 20) -> DataFrame:
    """Blocks with the mean, dispersion, proportions and divided shares of their sub-blocks' realizations."""
    subs = model.predict(lattice.sub_rows(blocks), n_sim)
    per = change_of_support(subs.select("block_id", F.col("prediction.sims").alias("sims")), "block_id", "sims", cutoffs)
    return blocks.join(per, "block_id")


def refine(model, lattice: BlockSet, blocks: DataFrame, cutoffs: list[float], n_sim: int = 20, tolerance: float = 0.05) -> DataFrame:
    """Predict, split what is undecided or too coarse beside fine blocks, and predict the new blocks only, until nothing splits.

    Every pass is written to the checkpoint folder, so plans stay short and a lost executor repeats
    one pass; the number of passes is bounded by the number of levels (and balancing within each).
    """
    def numbered(df):
        side = [d**lattice.max_levels * n for d, n in zip(lattice.discretization, lattice.n)]
        key = (F.col("ox") + F.col("oy") * side[0] + F.col("oz") * side[0] * side[1]) * (lattice.max_levels + 1) + F.col("level")
        return df.withColumn("block_id", key.cast("long"))

    plain = numbered(blocks.select(*ORIGIN, "level"))
    done = cut(predict_blocks(model, lattice, plain, cutoffs, n_sim))
    shares = [f"divided_{c:g}" for c in cutoffs]
    for _ in range(4 * lattice.max_levels):
        wanted = F.greatest(*(F.coalesce(F.col(f"`{s}`"), F.lit(0.0)) for s in shares), F.lit(0.0)) > tolerance
        uneven = lattice.unbalanced(done).select(F.col("block_id").alias("__u"))
        marked = done.join(uneven, done["block_id"] == uneven["__u"], "left").withColumn("__m", (wanted | F.col("__u").isNotNull()) & (F.col("level") < lattice.max_levels)).drop("__u")
        marked = cut(marked)
        if marked.where("__m").isEmpty():
            return done
        new = lattice.split(marked.where("__m").select(*ORIGIN, "level"), F.lit(True)).select(*ORIGIN, "level")
        fresh = predict_blocks(model, lattice, numbered(new), cutoffs, n_sim)
        done = cut(marked.where("NOT __m").drop("__m").unionByName(fresh))
    return done
