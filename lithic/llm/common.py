"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words: these six bytes and no others.
SPACE = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows up to which a side of a join is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000

#: Rows of text that a Python task holds at once.
TEXT_ROWS = 1_000

#: Rows that are worth a file of their own where a stage writes narrow rows.
FILE_ROWS = 20_000

_written: list[tuple] = []


def tidy() -> None:
    """Give memory back to the system: a Python worker serves later tasks too, beside another one and the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def task(run, rows: int | None = TEXT_ROWS):
    """`run` over batches of at most `rows` rows, leaving a tidy worker behind."""

    def wrapped(batches):
        try:
            yield from run(batches if rows is None else (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)))
        finally:
            tidy()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none there is a local one in local mode (tests) and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write `df` as Parquet to the shared folder, to at most `files` files, and read it back.

    Cuts the lineage so that a lost executor repeats one step and not the whole plan, and gives
    later steps column pruning and true sizes. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lithic-{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def files_for(rows: int) -> int:
    """Files that so many narrow rows go to. Hadoop's local file system starts two processes for each file that a task
    writes, and for a moment such a process counts as large as the JVM that starts it."""
    return max(1, -(-rows // FILE_ROWS))


def release() -> None:
    """Delete the staged files of this driver."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return


atexit.register(release)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` (staged) with a broadcast hint if it holds few rows, else as it is: Spark then shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_fold(doc_id, modulus: int, remainder: int):
    """Whether crc32 of the id's text leaves `remainder`."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def one_text_each(docs: DataFrame, picked: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text and the given columns of `picked` (one row per doc_id, of a bounded number), with one text
    of each id: the one whose hash is least. Rows of an id are reduced where they are read."""
    rows = docs.join(F.broadcast(picked.select("doc_id", *columns)), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), *(F.first(c).alias(c) for c in columns))


def keep_rows(docs: DataFrame, decided: DataFrame, with_key) -> DataFrame:
    """The rows of `docs` that `decided` (doc_id, key, kept; one row per row of `docs`) keeps.

    Rows go by an anti-join with the ids of dropped rows. An id that is null or repeats does not tell
    rows apart; its rows go by id and key (`with_key` adds __key to rows) and one of each stays, the longest text.
    """
    decided = stage(decided.select("doc_id", "key", "kept"), "decided")
    odd = small(stage(decided.groupBy("doc_id").count().where("doc_id is null or count > 1").select(F.col("doc_id").alias("__id")), "odd"))
    dropped = small(stage(decided.where("not kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct(), "dropped"))
    same = docs["doc_id"].eqNullSafe(odd["__id"])
    plain = docs.join(dropped, docs["doc_id"] == dropped["__id"], "left_anti").join(odd, same, "left_anti")
    kept = decided.where("kept").select(F.col("doc_id").alias("__kid"), F.col("key").alias("__kkey")).distinct()
    keyed = with_key(docs.join(odd, same, "left_semi"))
    keyed = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["__kid"]) & (keyed["__key"] == kept["__kkey"]), "left_semi")
    rank = F.row_number().over(Window.partitionBy("doc_id", "__key").orderBy(F.length("text").desc(), "text"))
    return plain.unionByName(keyed.withColumn("__rank", rank).where("__rank = 1").select(*docs.columns))
