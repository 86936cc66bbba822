"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from lithic.llm.common import BROADCAST_ROWS, files_for, keep_rows, small, stage, table, task
from lithic.llm.components import connected_components

SEED = 42
#: Rows of one anchor that are compared in one task; anchors with more are dealt over pairs of parts.
ANCHOR_ROWS = 16_384


def simhash(text: bytes | None, shingle: int = 4) -> int:
    """Fingerprint of a text: bit i is set if it is set in over half the shingle hashes; no words give 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    if n == 1:
        return digest(joined, SEED)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        bits += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches):
        for b in batches:
            found = np.array([simhash(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


class Code:
    """A covering code of `n` bits: syndrome decoding to the nearest anchor, at most `radius` bits away."""

    def __init__(self, n: int, columns: np.ndarray, radius: int):
        # columns[i]: syndrome of bit i. Leaders of least weight for every syndrome.
        self.n, self.columns, self.radius = n, columns.astype(np.uint32), radius
        checks = int(columns.max()).bit_length()
        self.leader = np.full(1 << checks, -1, np.int64)
        self.leader[0] = 0
        frontier = {0: 0}
        for _ in range(radius):
            step: dict[int, int] = {}
            for s, v in frontier.items():
                for i in range(n):
                    t, u = s ^ int(self.columns[i]), v ^ (1 << i)
                    if self.leader[t] < 0 and t not in step:
                        step[t] = u
            for t, u in step.items():
                self.leader[t] = u
            frontier = step
        if (self.leader < 0).any():
            raise ValueError("the code doesn't cover")

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        s = np.zeros(len(words), np.uint32)
        for i in range(self.n):
            s ^= np.where(words >> np.uint32(i) & np.uint32(1), self.columns[i], np.uint32(0)).astype(np.uint32)
        return s

    def nearest(self, words: np.ndarray) -> np.ndarray:
        return words ^ self.leader[self.syndrome(words)].astype(np.uint32)

    def anchors_near(self, words: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Nearest anchors of each word with the bits of each mask changed; syndromes add up, so each is worked out once."""
        moved = words[:, None] ^ masks[None, :]
        return moved ^ self.leader.astype(np.uint32)[self.syndrome(words)[:, None] ^ self.syndrome(masks)[None, :]]


def golay() -> Code:
    """The perfect binary code of 23 bits and radius 3: columns are x^i modulo its generator polynomial."""
    generator, columns, x = 0b101011100011, [], 1
    for _ in range(23):
        columns.append(x)
        x <<= 1
        if x >> 11 & 1:
            x ^= generator
    return Code(23, np.array(columns), 3)


def hamming(checks: int) -> Code:
    """The perfect code of 2^checks - 1 bits and radius 1."""
    return Code((1 << checks) - 1, np.arange(1, 1 << checks), 1)


#: First bit, bits that the code covers, free bits that the anchor keeps as they are.
BLOCKS = ((0, 23, 0), (23, 23, 0), (46, 15, 3))


def anchors_of(fingerprints: np.ndarray, threshold: int = 4, among: tuple[int, ...] = (0, 1, 2)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, blocks and anchors that each fingerprint is replicated to, in the blocks `among`.

    Two fingerprints that differ in `threshold` bits differ in at most threshold // 3 bits of one
    of three blocks. There, the anchor nearest to the one lies within covering radius plus that
    many bits of the other; the anchors of a fingerprint are those nearest to any word that many
    bits away, which are just these. Among fewer blocks the bits are shared by as many.
    """
    apart = threshold // len(among)
    codes = {23: golay(), 15: hamming(4)}
    rows, blocks, found = [], [], []
    for k in among:
        first, n, free = BLOCKS[k]
        width = n + free
        words = (fingerprints >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.uint32)
        masks = {0}
        for _ in range(apart):
            masks |= {m ^ (1 << i) for m in masks for i in range(width)}
        masks, low = np.array(sorted(masks), np.uint32), np.uint32((1 << n) - 1)
        near = codes[n].anchors_near(words & low, masks & low) | ((words[:, None] ^ masks) & ~low)
        near.sort(axis=1)
        fresh = np.ones(near.shape, bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :-1]
        at, _ = np.nonzero(fresh)
        rows.append(at)
        blocks.append(np.full(len(at), k, np.int32))
        found.append(near[fresh].astype(np.int32))
    return np.concatenate(rows), np.concatenate(blocks), np.concatenate(found)


def _replicate(threshold: int):
    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 20_000):
                part = fp[at : at + 20_000]
                rows, blocks, anchors = anchors_of(part.view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(anchors), pa.array(part[rows])], ["block", "anchor", "fp"])

    return run


def _deepen(threshold: int):
    """Anchors in the two other blocks, for rows of crowded anchors: there one of these holds at most half of the bits."""

    def run(batches):
        for b in batches:
            block, anchor, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "anchor", "fp"))
            for k in range(len(BLOCKS)):
                mine = np.flatnonzero(block == k)
                for at in range(0, len(mine), 2_000):
                    some = mine[at : at + 2_000]
                    rows, blocks, anchors = anchors_of(fp[some].view(np.uint64), threshold, tuple(j for j in range(len(BLOCKS)) if j != k))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block[some][rows], anchor[some][rows], blocks, anchors, fp[some][rows])], ["block", "anchor", "block2", "anchor2", "fp"])

    return run


def linked_forest(fps: np.ndarray, threshold: int) -> list[np.ndarray]:
    """Connected groups (of two and more) among fingerprints that differ in at most `threshold` bits."""
    n, linked = len(fps), np.zeros(len(fps), bool)
    step = max(1, (1 << 21) // max(n, 1))
    for at in range(0, n, step):
        near = np.bitwise_count(fps[at : at + step, None] ^ fps[None, :]) <= threshold
        linked[at : at + step] = near.sum(1) > 1
    rest, groups = fps[linked], []
    while len(rest):
        frontier, rest, group = rest[:1], rest[1:], [rest[:1]]
        while len(frontier) and len(rest):
            hit = np.zeros(len(rest), bool)
            step = max(1, (1 << 21) // len(rest))
            for at in range(0, len(frontier), step):
                hit |= (np.bitwise_count(frontier[at : at + step, None] ^ rest[None, :]) <= threshold).any(0)
            frontier, rest = rest[hit], rest[~hit]
            group.append(frontier)
        groups.append(np.concatenate(group))
    return groups


def _compare(threshold: int):
    """Stars about the first fingerprint of each group; rows arrive sorted by anchor."""

    def edges(fps):
        stars = [(g[1:], np.full(len(g) - 1, g[0])) for g in linked_forest(np.unique(fps.view(np.uint64)), threshold)]
        return [x for x in stars if len(x[0])]

    def run(batches):
        kept = np.zeros((0, 6), np.int64)
        for b in batches:
            new = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], 1)
            new = np.concatenate([kept, new])
            change = np.flatnonzero((new[1:, :5] != new[:-1, :5]).any(1)) + 1
            cuts = [0, *change.tolist()]
            stars = [e for a, z in zip(cuts, cuts[1:]) if z - a > 1 for e in edges(np.ascontiguousarray(new[a:z, 5]))]
            kept = new[cuts[-1] :]
            if stars:
                yield out(stars)
        if len(kept) > 1 and (stars := edges(np.ascontiguousarray(kept[:, 5]))):
            yield out(stars)

    def out(stars):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([s[i] for s in stars]).view(np.int64)) for i in (0, 1)], ["a", "b"])

    return run


def near_edges(distinct: DataFrame, threshold: int = 4, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """Edges (a, b) that connect what links connect among distinct fingerprints (fp long).

    Inside an anchor with over `anchor_rows` fingerprints these are anchored once more, by the two
    other blocks. What is still over `anchor_rows` is dealt over pairs of parts, every row to each
    pair with its part, so that no task grows without bound and no pair is lost.
    """
    copies = distinct.select("fp").mapInArrow(task(_replicate(threshold), None), "block int, anchor int, fp long")
    none = F.lit(-1)
    # There are at most 2^12 + 2^12 + 2^14 anchors.
    crowded = stage(copies.groupBy("block", "anchor").count().where(F.col("count") > anchor_rows).select("block", "anchor"), "anchors")
    cells = copies.select("block", "anchor", none.alias("block2"), none.alias("anchor2"), F.lit(0).cast("long").alias("cell"), "fp")
    if not crowded.isEmpty():
        deep = copies.join(F.broadcast(crowded), ["block", "anchor"], "left_semi").mapInArrow(task(_deepen(threshold), None), "block int, anchor int, block2 int, anchor2 int, fp long")
        place = ["block", "anchor", "block2", "anchor2"]
        full = small(stage(deep.groupBy(*place).count().where(F.col("count") > anchor_rows), "anchors"))
        parts = F.coalesce(F.ceil(F.col("count") / anchor_rows), F.lit(1)).cast("long")
        dealt = deep.join(full, place, "left").withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("fp"), "parts"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        cell = (F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other")).cast("long")
        cells = cells.join(F.broadcast(crowded), ["block", "anchor"], "left_anti").unionByName(dealt.select(*place, cell.alias("cell"), "fp"))
    place = ["block", "anchor", "block2", "anchor2", "cell"]
    return cells.select(*place, "fp").repartition(*place).sortWithinPartitions(*place).mapInArrow(task(_compare(threshold), None), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in at most `threshold` bits.

    Equal fingerprints collapse to one row before anchors are assigned; each anchor yields a forest
    and not its pairs. Returns doc_id, fingerprint (16 hex digits), component_id (smallest id that
    links reach), kept (one row per component); one row per input row.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Null ids count as
    larger than all others. Rows that repeat an id share a component as their texts do; the first
    row of the smallest id stays. No rows: no rows. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    prints = stage(texts.mapInArrow(task(_fingerprints(shingle)), "doc_id long, fp long").withColumn("uid", F.monotonically_increasing_id()), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("first")
    distinct = stage(prints.groupBy("fp").agg(first), "distinct", files_for(prints.count()))
    files = files_for(rows := distinct.count())
    roots = connected_components(near_edges(distinct, threshold, anchor_rows), files).withColumnRenamed("node", "fp")
    linked = roots.join(distinct, "fp")
    linked = linked.join(small(stage(linked.groupBy("root").agg(F.min("first").alias("least")), "least", files)), "root").select("fp", "least")
    least = F.coalesce("least", "first")
    classes = distinct.join(small(stage(linked, "linked", files)), "fp", "left").select("fp", least["doc_id"].alias("component_id"), least["uid"].alias("kept_uid"))
    classes = F.broadcast(classes) if rows <= BROADCAST_ROWS else classes
    return prints.join(classes, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        (F.col("uid") == F.col("kept_uid")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of `docs` (doc_id, text and others) that `near_duplicates` keeps: one of each component."""

    def with_key(rows):
        def run(batches):
            for b in batches:
                found = [f"{simhash(t, shingle):016x}" for t in b.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, "__key"])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("__key", T.StringType())]))

    return keep_rows(docs, near_duplicates(docs, threshold, shingle).withColumnRenamed("fingerprint", "key"), with_key)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
