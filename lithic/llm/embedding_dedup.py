"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from lithic.llm.common import small, stage, table, task
from lithic.llm.components import connected_components

#: Vectors that the rotations are learned from (every vector is indexed), their rounds, and the
#: recall that the tables have at pairs just at the threshold.
SAMPLE, ROUNDS, RECALL = 8_192, 20, 0.98
#: Vectors whose made-up pairs measure the recall, and how many times the planned tables it may take before keys get shorter.
PROBES, MORE = 2_048, 8
#: Code bits that filter candidates, and the distance beyond that of the farthest made-up pair at which they still are.
SKETCH, SPARE = 64, 2
#: Vectors of one bucket compared in one task; buckets with more are dealt over pairs of parts.
BUCKET_ROWS = 4_096


def rotations(centred: np.ndarray, rounds: int = ROUNDS, seed: int = 7):
    """Rotations without end, each learned from a start of its own: codes and rotation are improved in
    turn so that the rotated vectors lie close to corners of the cube."""
    d, rng = centred.shape[1], np.random.default_rng(seed)
    while True:
        rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(centred @ rotation >= 0, 1.0, -1.0).T @ centred)
            rotation = w.T @ u.T
        yield rotation


def layout(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table's key and least number of tables for `n` vectors, as vectors about the origin need them.

    A bit of a pair at the threshold agrees with probability 1 - angle / pi. Keys have log2(n) bits, so
    that buckets of unrelated vectors stay small, and there are as many tables as the recall asks for.
    """
    bits = min(31, max(8, math.ceil(math.log2(max(n, 2)))))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def partners(units: np.ndarray, threshold: float, seed: int = 11) -> list[np.ndarray]:
    """For every unit vector two whose cosine with it is just `threshold`: one in any direction, one towards another of them."""
    out, rng = [], np.random.default_rng(seed)
    for to in (rng.standard_normal(units.shape), np.roll(units, 1, 0) + 1e-9 * rng.standard_normal(units.shape)):
        to = to - (to * units).sum(1, keepdims=True) * units
        to /= np.maximum(np.linalg.norm(to, axis=1, keepdims=True), 1e-300)
        out.append(threshold * units + math.sqrt(max(0.0, 1 - threshold**2)) * to)
    return out


def pack_bits(signs: np.ndarray) -> np.ndarray:
    """The first (at most 64) bits of codes as one word each."""
    some = signs[:, :SKETCH]
    return some.astype(np.uint64) @ (np.uint64(1) << np.arange(some.shape[1], dtype=np.uint64))


def learn_tables(sample: np.ndarray, bits: int, tables: int, threshold: float, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """The mean of unit vectors, rotations of centred ones, the bits and number of tables that meet
    `recall`, and the Hamming distance of sketches up to which pairs are candidates.

    Signs are taken about the mean, where the angle of a pair at the threshold is wider than about
    the origin. So pairs at the threshold are made up from the sample and go through the tables;
    tables are added until enough pairs share a bucket, and keys get shorter if MORE times the
    tables do not suffice.
    """
    d, mean = sample.shape[1], sample.mean(0)
    source, found = rotations(sample - mean), []
    units = sample[:PROBES]
    sides = [units, *partners(units, threshold)]
    while True:
        least, tables = tables, tables * MORE
        count, met = 0, np.zeros((2, len(units)), bool)
        while count < tables and (count < least or met.mean(1).min() < recall):
            count += 1
            while len(found) * d < count * bits:
                found.append(next(source))
            first, last = (count - 1) * bits // d, -(-count * bits // d)
            axes = np.concatenate(found[first:last], 1)[:, (count - 1) * bits - first * d :][:, :bits]
            signs = [(x - mean) @ axes >= 0 for x in sides]
            met |= np.stack([(signs[0] == s).all(1) for s in signs[1:]])
        if met.mean(1).min() >= recall or bits == 1:
            axes = np.concatenate(found[: -(-count * bits // d)], 1)
            sketches = [pack_bits((x - mean) @ axes[:, : min(SKETCH, count * bits)] >= 0) for x in sides]
            return mean, axes, bits, count, SPARE + max(int(np.bitwise_count(sketches[0] ^ x).max(initial=0)) for x in sketches[1:])
        bits, tables = max(1, bits - 2), least


def _keyed(batches):
    for b in batches:
        col = b.column("embedding")
        lengths = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
        flat = col.flatten()
        kind = "<f4" if pa.types.is_float32(flat.type) else "<f8"
        flat = flat.to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # -0 becomes 0
        ends = np.cumsum(lengths)
        keys, data = [], []
        for n, z in zip(lengths.tolist(), ends.tolist()):
            v = flat[z - n : z]
            good = n and np.isfinite(v).all() and v.any()
            data.append(v.tobytes() if good else None)
            keys.append(hashlib.blake2b(data[-1], digest_size=16).digest() if good else None)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["vec_id", "key", "vec"])


def _units(vectors: list[bytes], kind: str, width: int) -> np.ndarray:
    """Unit vectors in double precision, padded with zeros to `width`."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x = np.frombuffer(v, kind)
        out[i, : len(x)] = x
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _codes(units: np.ndarray, model, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of every table, and the sketch."""
    mean, rotation = model.value
    signs = (units - mean) @ rotation[:, : bits * tables] >= 0
    return signs.reshape(len(units), tables, bits) @ (1 << np.arange(bits)).astype(np.int64), pack_bits(signs)


def _tables(model, kind: str, width: int, bits: int, tables: int):
    """An entry for every table: the place is the table's number above the key."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                p = b.slice(at, 2_000)
                vectors = p.column("vec").to_pylist()
                keys, sketch = _codes(_units(vectors, kind, width), model, bits, tables)
                take = np.repeat(np.arange(len(vectors)), tables)
                place = keys | np.arange(tables, dtype=np.int64) << 32
                yield pa.RecordBatch.from_arrays([pa.array(place.ravel()), pa.array(np.array([len(v) for v in vectors], np.int32)[take]), p.column("cid").take(pa.array(take)), pa.array(sketch.view(np.int64)[take])], ["place", "dim", "cid", "sketch"])

    return run


def _groups(batches, names: tuple[str, ...]):
    """Tables that hold whole groups of rows with the same `names`, with the number of the group; rows arrive sorted."""

    def numbers(x):
        place = np.stack([x.column(c).to_numpy().astype(np.int64) for c in names], 1)
        return np.concatenate([[0], np.cumsum((place[1:] != place[:-1]).any(1))]) if len(place) else np.zeros(0, np.int64)

    held = None
    for batch in batches:
        x = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, x]) if held is not None else x
        group = numbers(held)
        cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
        if cut:
            yield held.slice(0, cut), group[:cut]
            held = held.slice(cut)
    if held is not None and held.num_rows > 1:
        yield held, numbers(held)


def _candidates(radius: int):
    """Entries whose sketch lies within `radius` of another one's in their bucket."""

    def run(batches):
        for x, group in _groups(batches, PLACE):
            sketch, near = x.column("sketch").to_numpy().view(np.uint64), np.zeros(x.num_rows, bool)
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            sizes = np.diff(np.append(starts, len(group)))
            little = np.repeat(sizes <= 32, sizes)
            for d in range(1, min(32, int(sizes.max(initial=1)))):
                i = np.flatnonzero((group[d:] == group[:-d]) & little[d:])
                i = i[np.bitwise_count(sketch[i] ^ sketch[i + d]) <= radius]
                near[i] = near[i + d] = True
            for s, size in zip(starts[sizes > 32], sizes[sizes > 32]):
                mine = sketch[s : s + size]
                for at in range(0, size, 512):
                    near[s + at : s + min(at + 512, size)] = (np.bitwise_count(mine[at : at + 512, None] ^ mine) <= radius).sum(1) > 1
            keep = np.flatnonzero(near)
            if len(keep):
                yield x.select(["place", "dim", "cid"]).take(pa.array(keep)).combine_chunks().to_batches()[0]

    return run


PLACE = ("place", "dim", "cell")


def _links(model, kind: str, width: int, bits: int, tables: int, threshold: float):
    """Link counts and connecting edges of each bucket; a pair counts in the first table that holds both."""

    def bucket(units, codes, t, part, split, cid, n):
        """A large bucket, by blocks: counts, and stars that connect what is linked."""
        size = len(cid)
        counts, near = np.zeros(size, np.int64), []
        for at in range(0, size, 512):
            z = slice(at, at + 512)
            hit = units[z] @ units.T >= threshold
            hit[np.arange(hit.shape[0]), np.arange(at, at + hit.shape[0])] = False
            for k in range(t):
                hit &= codes[z, None, k] != codes[None, :, k]
            if split:
                hit &= part[z, None] != part[None, :]
            counts[z] = hit @ n
            near.append(hit)
        near, rest = np.concatenate(near), counts > 0
        a, b = [], []
        while rest.any():
            root = int(rest.argmax())
            rest[root], frontier, seen = False, np.array([root]), []
            while len(frontier):
                frontier = np.flatnonzero(near[frontier].any(0) & rest)
                rest[frontier] = False
                seen.append(frontier)
            seen = np.concatenate(seen)
            a.append(cid[seen])
            b.append(np.full(len(seen), cid[root]))
        return counts, a, b

    def rows(x, group):
        t, part, split, cid, n = (x.column(c).to_numpy() for c in ("place", "mine", "split", "cid", "n"))
        t = t >> 32
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(starts, len(cid)))
        units, codes = np.zeros((len(cid), width)), np.zeros((len(cid), tables), np.uint32)
        used = np.flatnonzero(np.repeat(sizes > 1, sizes))
        for at in range(0, len(used), 2_000):
            some = used[at : at + 2_000]
            units[some] = _units(x.column("vec").take(pa.array(some)).to_pylist(), kind, width)
            codes[some] = _codes(units[some], model, bits, tables)[0]
        counts, a, b = np.zeros(len(cid), np.int64), [], []
        little = np.repeat(sizes <= 32, sizes)
        for d in range(1, min(32, int(sizes.max(initial=1)))):
            i = np.flatnonzero((group[d:] == group[:-d]) & little[d:])
            j = i + d
            keep = np.einsum("ij,ij->i", units[i], units[j]) >= threshold
            i, j = i[keep], j[keep]
            earlier = (codes[i] == codes[j]) & (np.arange(codes.shape[1]) < t[i, None])
            keep = ~earlier.any(1) & ~(split[i] & (part[i] == part[j]))
            i, j = i[keep], j[keep]
            np.add.at(counts, i, n[j])
            np.add.at(counts, j, n[i])
            a.append(cid[i])
            b.append(cid[j])
        for s, size in zip(starts[sizes > 32], sizes[sizes > 32]):
            z = slice(s, s + size)
            found, x, y = bucket(units[z], codes[z], int(t[s]), part[z], bool(split[s]), cid[z], n[z])
            counts[z] += found
            a += x
            b += y
        some = np.flatnonzero(counts)
        a, b = np.concatenate([cid[some], *a]), np.concatenate([cid[some], *b])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([counts[some], np.zeros(len(a) - len(some), np.int64)]))], ["a", "b", "links"])

    def run(batches):
        for x, group in _groups(batches, PLACE):
            yield rows(x, group)

    return run


def _dealt(entries: DataFrame, bucket_rows: int) -> DataFrame:
    """Entries by bucket; one with over `bucket_rows` is dealt over pairs of parts, every row to each pair with its part.

    A row whose own part is both ends of a cell meets the same part there and in no other cell.
    """
    crowded = small(stage(entries.groupBy("place", "dim").count().where(F.col("count") > bucket_rows), "crowded"))
    parts = F.coalesce(F.ceil(F.col("count") / bucket_rows), F.lit(1)).cast("long")
    dealt = entries.join(crowded, ["place", "dim"], "left").withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("cid"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return dealt.select(*entries.columns, (low * F.col("parts") + high).alias("cell"), "mine", (low != high).alias("split"))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, recall: float = RECALL, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links between vectors whose cosine, in double precision, is at least `threshold`.

    Identical vectors collapse to one row that carries their number. Rotations learned on a bounded
    sample give each vector binary codes; runs of code bits are the keys of Hamming tables, and every
    vector is indexed in every table. There are as many tables as pairs at the threshold, made up from
    the sample, need for `recall`. Ids and sketches go to the tables. Entries whose sketch has another
    one of their bucket within a Hamming radius fetch their vector and are compared by its original
    components. A pair is counted in the first table that holds both, and each bucket passes on link
    counts and connecting edges rather than its pairs.

    Returns vec_id, n_links, component_id, kept, one row per input row. Null, empty and zero vectors
    and those with a null or non-finite component link with nothing; so do vectors of different
    lengths. Null ids count as larger than all others; of rows that repeat the id of a component one
    stays. No rows: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = stage(given.mapInArrow(task(_keyed, None), "vec_id long, key binary, vec binary").withColumn("uid", F.monotonically_increasing_id()), "vectors")
    first = F.min(F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id", "uid")).alias("first")
    classes = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.first("vec").alias("vec"), first)
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    count, longest = classes.agg(F.count("*"), F.coalesce(F.max(F.length("vec")), F.lit(0))).first()
    if count > 1:
        width = longest // int(kind[-1])
        bits, tables = layout(count, threshold, recall)
        picked = [bytes(r[0]) for r in classes.orderBy(F.xxhash64("key")).limit(sample).select("vec").collect()]
        mean, axes, bits, tables, radius = learn_tables(_units(picked, kind, width), bits, tables, threshold, recall)
        model = spark.sparkContext.broadcast((mean, axes))
        # Ids and sketches go to the tables; vectors only to the entries that have a candidate in their bucket.
        entries = classes.select("cid", "vec").mapInArrow(task(_tables(model, kind, width, bits, tables), None), "place long, dim int, cid long, sketch long")
        dealt = _dealt(entries, bucket_rows).select(*PLACE, "cid", "sketch")
        near = dealt.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(task(_candidates(radius), None), "place long, dim int, cid long")
        near = stage(near.distinct(), "candidates").join(classes.select("cid", "n", "vec"), "cid")
        near = _dealt(near, bucket_rows).repartition(*PLACE).sortWithinPartitions(*PLACE, "cid")
        found = near.mapInArrow(task(_links(model, kind, width, bits, tables, threshold), None), "a long, b long, links long")
        found = stage(found, "links")
    else:
        found = spark.createDataFrame([], "a long, b long, links long")
    links = found.where("links > 0").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("links = 0").select("a", "b")).withColumnRenamed("node", "cid")
    linked = roots.join(classes.select("cid", "first"), "cid")
    linked = linked.join(small(stage(linked.groupBy("root").agg(F.min("first").alias("least")), "least")), "root").select("cid", "least")
    per_class = classes.select("key", "cid", "n", "first").join(links, "cid", "left").join(linked, "cid", "left")
    per_class = per_class.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("least", "first").alias("least"))
    alone = F.col("least").isNull()
    return rows.select("vec_id", "uid", "key").join(per_class, "key", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("least.vec_id")).alias("component_id"),
        (alone | (F.col("uid") == F.col("least.uid"))).alias("kept"),
    )


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE usable AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN isfinite(x) THEN x ELSE 0 END) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.a = c.vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM component c
"""
