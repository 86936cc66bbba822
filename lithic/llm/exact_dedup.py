"""Exact deduplication with counting quotient filters and byte verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm.common import SPACE, keep_rows, small, stage, table, task

#: Distinct fingerprints that one merge task holds on average.
BLOCK_ENTRIES = 65_536


class CountingQuotientFilter:
    """A counting quotient filter over 64-bit fingerprints, exact because quotient and remainder together are the fingerprint.

    The top `q` bits pick one of 2^q home slots. `occupied` has a bit per home slot with a run,
    `runend` a bit per stored remainder that ends a run. Remainders lie by quotient and sorted
    within a run, each with its count.
    """

    def __init__(self, q: int, occupied: np.ndarray, runend: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.q, self.occupied, self.runend, self.remainders, self.counts = q, occupied, runend, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """From fingerprints in any order, with repeats."""
        counts = np.ones(len(fingerprints), np.int64) if counts is None else counts
        order = np.argsort(fingerprints, kind="stable")
        values, first = np.unique(fingerprints[order], return_index=True)
        total = np.add.reduceat(counts[order], first) if len(values) else np.zeros(0, np.int64)
        q = max(1, int(len(values)).bit_length())
        homes = (values >> np.uint64(64 - q)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[homes] = True
        runend = np.append(homes[1:] != homes[:-1], True)[: len(homes)]
        return cls(q, occupied, runend, values & np.uint64((1 << (64 - q)) - 1), total)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in order and their counts."""
        homes = np.flatnonzero(self.occupied).astype(np.uint64)
        run = np.cumsum(np.append(False, self.runend[:-1]))[: len(self.runend)]
        return (homes[run] << np.uint64(64 - self.q)) | self.remainders, self.counts

    def merge(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        """Sorted remainders of all filters in one; counts add up and nothing is lost."""
        parts = [x.entries() for x in (self, *others)]
        return CountingQuotientFilter.of(np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts]))

    def to_bytes(self) -> bytes:
        head = np.array([self.q, len(self.remainders)], "<i8").tobytes()
        return head + np.packbits(self.occupied).tobytes() + np.packbits(self.runend).tobytes() + self.remainders.astype("<u8").tobytes() + self.counts.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, n = map(int, np.frombuffer(data, "<i8", 2))
        at, wide, long = 16, (1 << q) + 7 >> 3, n + 7 >> 3
        occupied = np.unpackbits(np.frombuffer(data, np.uint8, wide, at))[: 1 << q].astype(bool)
        runend = np.unpackbits(np.frombuffer(data, np.uint8, long, at + wide))[:n].astype(bool)
        at += wide + long
        return cls(q, occupied, runend, np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<i8", n, at + 8 * n))


def squeeze(text: bytes | None) -> bytes:
    """The text without white space; null counts as empty."""
    return text.translate(None, SPACE) if text else b""


def _digests(batches):
    for b in batches:
        norm = [squeeze(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_chars"), pa.array(np.array([xxhash.xxh64_intdigest(t) for t in norm], np.uint64).view(np.int64)), pa.array([hashlib.sha256(t).digest() for t in norm], pa.binary())],
            ["doc_id", "n_chars", "fp", "sha"],
        )


def _squeezed(batches):
    for b in batches:
        norm = [squeeze(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.array([xxhash.xxh64_intdigest(t) for t in norm], np.uint64).view(np.int64)), pa.array(norm, pa.binary())], ["fp", "norm"])


def _filters(block_bits: int, hold: int = 1 << 20):
    """One filter per block of the fingerprint space from each partition, flushed after `hold` fingerprints."""

    def build(batches):
        def flush(parts):
            values, counts = CountingQuotientFilter.of(np.concatenate(parts)).entries()
            block = (values >> np.uint64(63 - block_bits) >> np.uint64(1)).astype(np.int64)
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, int)
            ends = np.append(starts[1:], len(block))
            data = [CountingQuotientFilter.of(values[a:b], counts[a:b]).to_bytes() for a, b in zip(starts, ends)]
            return pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array(data, pa.binary())], ["block", "filter"])

        parts, n = [], 0
        for b in batches:
            parts.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(parts[-1])
            if n >= hold:
                yield flush(parts)
                parts, n = [], 0
        if n:
            yield flush(parts)

    return build


def _merged(group: pa.Table) -> pa.Table:
    """The fingerprints of a block that occur more than once."""
    first, *rest = [CountingQuotientFilter.from_bytes(x) for x in group.column("filter").to_pylist()]
    values, counts = first.merge(*rest).entries()
    return pa.table({"fp": pa.array(values[counts > 1].view(np.int64)), "n": pa.array(counts[counts > 1])})


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts, equal after deleting white space.

    1. One pass gives each row a 64-bit fingerprint and a SHA-256 of the squeezed text.
    2. Each partition builds counting quotient filters over ranges of the fingerprint space; the
       filters of a range merge losslessly, and fingerprints counted more than once are routed on.
    3. Routed rows are verified by their bytes: grouping by the squeezed text itself, combined before
       the shuffle, so a text repeated without end moves once per task.
    4. Rows of a verified text get their group's keeper: most code points in the original text, then
       smallest id, then the earlier row.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input row. Null and empty
    texts are one group. Null ids come after all others; of rows that repeat an id and a text only
    one is kept. No rows: no rows. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"), F.col(text_col).cast("binary").alias("text"))
    digests = stage(texts.mapInArrow(task(_digests), "doc_id long, n_chars long, fp long, sha binary").withColumn("uid", F.monotonically_increasing_id()), "digests")
    block_bits = min(40, max(0, (digests.count() // BLOCK_ENTRIES).bit_length()))
    blocks = digests.select("fp").mapInArrow(task(_filters(block_bits), None), "block long, filter binary")
    routed = small(stage(blocks.groupBy("block").applyInArrow(_merged, "fp long, n long"), "routed"))

    suspects = texts.select("text").mapInArrow(task(_squeezed), "fp long, norm binary").join(routed, "fp", "left_semi")
    verified = suspects.groupBy("norm").agg(F.first("fp").alias("fp"), F.count("*").alias("copies"))
    # Two texts that share fingerprint and SHA-256 would have to be kept apart by their bytes: refuse them loudly.
    verified = verified.groupBy("fp", F.unhex(F.sha2("norm", 256)).alias("sha")).agg(F.count("*").alias("texts"), F.max("copies").alias("copies"))
    verified = verified.withColumn("texts", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts with one SHA-256")).cast("long")).otherwise(F.col("texts")))
    verified = small(stage(verified.where("copies > 1 and texts = 1").select("fp", "sha"), "verified"))

    keeper = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"))
    groups = digests.join(verified, ["fp", "sha"], "left_semi").groupBy("fp", "sha").agg(keeper.alias("keeper"), F.count("*").alias("size"))
    groups = small(stage(groups.select("fp", "sha", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.uid").alias("keep_uid"), "size"), "groups"))
    joined = digests.join(groups, ["fp", "sha"], "left")
    alone = F.col("size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text and others) that `exact_groups` keeps."""
    key = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]", "").cast("binary"), 256)
    return keep_rows(docs, exact_groups(docs).withColumnRenamed("text_sha256", "key"), lambda rows: rows.withColumn("__key", key))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM {documents}),
g AS (SELECT h, count(*) AS c, arg_min(doc_id, (-n, doc_id)) AS k FROM d GROUP BY h)
SELECT d.doc_id, g.k AS keep_id, g.c::BIGINT AS group_size, d.doc_id = g.k AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""


def oracle(documents: str = "documents") -> str:
    return ORACLE.replace("{documents}", documents)
