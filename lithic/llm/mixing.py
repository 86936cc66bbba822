"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.llm.common import WORD_PATTERN, small, stage, table

#: Hash bits that one histogram resolves, and the levels that exhaust the 60 bits.
BITS, LEVELS = 10, 6


def word_count(text):
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Targets of sources (no_source, source, source_size): shares by weight, held at `cap` times the
    size, the excess dealt out again by weight.

    Sorted by cap over weight, those held are a prefix; the level of the rest is the largest of the
    levels that each prefix would give. One row per source goes through the two windows.
    """
    place = F.row_number().over(Window.orderBy("no_source", "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    before = Window.orderBy(F.col("most") / F.col("weight"), "no_source", "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    held, heavy = F.coalesce(F.sum("most").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) - held).cast("double") / (F.sum("weight").over(everything) - heavy)
    levelled = ranked.withColumn("level", level)
    return levelled.withColumn("target", F.least(F.col("most").cast("double"), F.max("level").over(everything) * F.col("weight"))).drop("level", "most")


def _hash(value: Column) -> Column:
    """60 bits of the digest of a string."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


def _key(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict:
    """Columns that place a document in the mix: its source, null apart, and 60 hash bits of its id and text."""
    return {
        "no_source": docs[source_col].isNull().cast("int"),
        "source": F.coalesce(docs[source_col], F.lit("")),
        "hash": _hash(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(docs[text_col], F.lit("")))),
    }


def _edges(placed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Where the hash (60 bits) of each source's rows (no_source, source, size, hash) reaches its budget.

    Each level is a histogram over the boundary bucket of the one before. Returns no_source, source,
    edge, edge_rows (how many rows have that very hash), edge_in (whether all of them come nearer to
    the budget than none) and left (what the budget holds beyond the rows below the edge).
    """
    key, zero = ["no_source", "source"], F.lit(0).cast("long")
    state = small(budgets.select(*key, "budget", zero.alias("prefix"), zero.alias("below"), zero.alias("mass"), zero.alias("rows")))
    for level in range(1, LEVELS + 1):
        bucket, parent = F.shiftright("hash", BITS * (LEVELS - level)), F.shiftright("hash", BITS * (LEVELS - level + 1))
        # A source without words has no boundary: it drops out here and takes no document in part.
        at = placed.where("size > 0").withColumn("prefix", parent).withColumn("bucket", bucket)
        histogram = at.join(state.select(*key, "prefix", "below", "budget"), [*key, "prefix"]).groupBy(*key, "bucket").agg(F.sum("size").alias("m"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("below", "budget")))
        running = F.col("below") + F.sum("m").over(Window.partitionBy(*key).orderBy("bucket"))
        reached = histogram.withColumn("running", running).where("running > budget")
        state = reached.groupBy(*key).agg(
            F.min("bucket").alias("prefix"),
            F.min_by(F.col("running") - F.col("m"), "bucket").alias("below"),
            F.min_by("m", "bucket").alias("mass"),
            F.min_by("n", "bucket").alias("rows"),
            F.first("budget").alias("budget"),
        )
        state = small(stage(state, "level"))
    left = F.col("budget") - F.col("below")
    return state.select(*key, F.col("prefix").alias("edge"), F.col("rows").alias("edge_rows"), (F.col("mass") < 2 * left).alias("edge_in"), left.alias("left"))


def plan_mix(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The plan of a mix of documents (no_source, source, size, hash), one row per source.

    `passes` whole passes over the source and, in part, the documents with a hash below `edge`; see
    `_edges` for its other columns.
    """
    key = ["no_source", "source"]
    targets = source_targets(sized.groupBy(*key).agg(F.sum("size").alias("source_size")), weights, cap)
    targets = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = stage(targets.withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")), "targets")
    return small(stage(targets.select(*key, "source_size", "target", "passes").join(_edges(sized, targets), key, "left"), "plan"))


def _tied(plan: DataFrame) -> bool:
    """Whether some source's edge falls on more than one row."""
    return not plan.where("edge_rows > 1").isEmpty()


def _counted(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """`rows` (no_source, source, size, hash and others) with the plan's columns and `copies`, how often it takes each.

    Rows that share id, text and source share their hash too. Where a source's edge falls on such rows
    they are written with numbers of their own, and a second threshold, found in the same way over the
    hashes of these numbers, takes as many as the budget holds. Which of them doesn't matter.
    """
    key = ["no_source", "source"]
    joined = rows.join(plan, key)
    part = F.coalesce((F.col("hash") < F.col("edge")) | ((F.col("hash") == F.col("edge")) & F.col("edge_in")), F.lit(False))
    copies = lambda some: F.when(F.col("size") > 0, F.col("passes") + some.cast("long")).otherwise(0).cast("long")
    if not _tied(plan):
        return joined.withColumn("copies", copies(part))
    many = F.coalesce((F.col("edge_rows") > 1) & (F.col("hash") == F.col("edge")) & (F.col("size") > 0), F.lit(False))
    alike = stage(joined.where(many).withColumn("number", F.monotonically_increasing_id()), "alike").withColumn("hash", _hash(F.col("number").cast("string"))).drop("edge", "edge_rows", "edge_in")
    again = _edges(alike.select(*key, "size", "hash"), plan.where("edge_rows > 1").select(*key, F.col("left").alias("budget"))).select(*key, "edge", "edge_rows", "edge_in")
    alike = alike.join(again, key, "left").withColumn("copies", copies(part))
    return joined.where(~many).withColumn("copies", copies(part)).unionByName(alike.drop("number"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words a mix takes of each document.

    Each source gets whole passes over all its documents while they fit into its target and one
    partial pass: the documents whose 60-bit hash of id and text lies below a threshold. Six histograms
    of 1024 buckets find the threshold, each over the boundary bucket of the one before, so nothing
    is sorted and a larger budget takes a superset. The document with the very hash on the boundary
    is taken if that comes nearer to the target.

    Returns doc_id, size, source_size, target, taken, source, copies; one row per input row. Null or
    empty text: size 0, taken 0 times. Null source: a source of its own, placed last. A null id
    hashes as the empty text. Of rows that repeat id, text and source as many are taken as the target
    asks for; which of them is left open. No rows: no rows. Other columns are ignored.
    """
    sized = stage(docs.select(docs[id_col].alias("doc_id"), word_count(docs[text_col]).alias("size"), *(c.alias(k) for k, c in _key(docs, id_col, text_col, source_col).items())), "sized")
    return _counted(sized, plan_mix(sized, weights, cap)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.when(F.col("no_source") == 0, F.col("source")).alias("source"), "copies"
    )


def take_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, each as often as `mix_sources` takes it. Texts stay where they are."""
    key = [c.alias(k) for k, c in _key(docs, id_col, text_col, source_col).items()]
    plan = plan_mix(stage(docs.select(word_count(docs[text_col]).alias("size"), *key), "sized"), weights, cap)
    # Unless rows on an edge are alike, all that matters here is whether there are words.
    size = word_count(docs[text_col]) if _tied(plan) else F.coalesce(docs[text_col].rlike(WORD_PATTERN), F.lit(False)).cast("long")
    rows = _counted(docs.select(F.struct(*docs.columns).alias("row"), size.alias("size"), *key), plan)
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies"))).otherwise(F.array().cast("array<bigint>"))
    return rows.select("row", F.explode(times).alias("copy")).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, row_number() OVER () AS number, (source IS NULL)::INT AS no_source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, ''), chr(31), coalesce(text, ''))), 1, 15))::BIGINT AS hash
  FROM {documents}),
totals AS (SELECT no_source, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
ranked AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY no_source, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight
  FROM totals),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce((sum(3 * source_size) OVER p)::BIGINT, 0))::DOUBLE
            / ((sum(weight) OVER ())::BIGINT - coalesce((sum(weight) OVER p)::BIGINT, 0)) AS level
  FROM ranked
  WINDOW p AS (ORDER BY (3 * source_size)::DOUBLE / weight, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT *, least((3 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM targets),
running AS (
  SELECT s.doc_id, s.size, s.source, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS budget,
         (sum(s.size) OVER (PARTITION BY s.no_source, s.source ORDER BY s.hash, s.number ROWS UNBOUNDED PRECEDING))::BIGINT AS upto, s.size AS mass
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
copied AS (
  SELECT *, CASE WHEN size = 0 THEN 0 WHEN upto <= budget OR (upto - mass <= budget AND mass < 2 * (budget - (upto - mass))) THEN passes + 1 ELSE passes END::BIGINT AS copies
  FROM running)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies FROM copied
"""


def oracle(documents: str = "documents") -> str:
    return ORACLE.replace("{documents}", documents)
