"""Quality scores by nearest-neighbour voting among latent-semantic vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm.common import in_fold, one_text_each, table, task

#: Labelled rows of each label that vectors and votes are learned from, at most.
PER_LABEL = 2_000
#: Hashed byte trigrams, latent dimensions, voting neighbours, and the similarity that a vote falls by e over.
TRIGRAMS, LATENT, NEIGHBOURS, FALL = 4_096, 64, 25, 0.05
#: Bins of each measure of a text's form, and the weight of form against trigrams.
BINS, FORM_WEIGHT = 12, 0.35
THRESHOLD = 0.7

_LETTER = np.zeros(256, np.uint8)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_BLANK = np.zeros(256, np.uint8)
_BLANK[[32, *range(9, 14)]] = 1


def form(text: bytes, a: np.ndarray) -> list[float]:
    """Measures of form, each between 0 and 1."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 8
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    solid = len(a) - int(_BLANK[a].sum())
    letters = int(_LETTER[a].sum())
    top = max(counts.values()) / n
    return [
        same,
        sum(c for c in counts.values() if c > 2) / n,
        min(1.0, top * 4),
        int(_UPPER[a].sum()) / max(letters, 1),
        1 - letters / max(solid, 1),
        min(1.0, solid / n / 16),
        counts.get(b"|", 0) / n,
        min(1.0, np.log1p(n) / 10),
    ]


def features(texts: list[bytes | None]) -> np.ndarray:
    """Sublinear counts of hashed byte trigrams, then measures of form spread over bins."""
    out = np.zeros((len(texts), TRIGRAMS + 8 * BINS), np.float32)
    for i, t in enumerate(texts):
        t = t or b""
        a = np.frombuffer(t, np.uint8)
        x = a.astype(np.uint32)
        if len(x) > 2:
            hashed = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
            out[i, :TRIGRAMS] = np.log1p(np.bincount(hashed, minlength=TRIGRAMS))
        for k, v in enumerate(form(t, a)):
            at = min(max(v, 0.0), 1.0) * (BINS - 1)
            low = min(int(at), BINS - 2)
            out[i, TRIGRAMS + k * BINS + low] = 1 - (at - low)
            out[i, TRIGRAMS + k * BINS + low + 1] = at - low
    return out


def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Trigrams by rarity and to length 1, form to its share. Overwrites x."""
    x *= idf
    left, right = x[:, :TRIGRAMS], x[:, TRIGRAMS:]
    left /= np.linalg.norm(left, axis=1, keepdims=True) + 1e-9
    right *= FORM_WEIGHT / np.sqrt(8)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)


def fit(x: np.ndarray, latent: int = LATENT, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rarities, mean, the projection onto the leading right singular vectors by subspace iteration, and x under it. Overwrites x."""
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    idf[TRIGRAMS:] = 1
    x = weigh(x, idf)
    mean = x.mean(0)
    x -= mean
    basis = np.random.default_rng(seed).standard_normal((x.shape[1], latent + 16)).astype(np.float32)
    for _ in range(5):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, v = np.linalg.svd(x @ basis, full_matrices=False)
    projection = (basis @ v[:latent].T).astype(np.float32)
    return idf, mean, projection, x @ projection


def vote(latent: np.ndarray, known: np.ndarray, labels: np.ndarray, mass: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the nearest, weighted by similarity and by the rows each label stands for."""
    cosine = latent @ known.T
    k = min(neighbours, known.shape[0])
    near = np.argpartition(cosine, -k, axis=1)[:, -k:]
    similar = np.take_along_axis(cosine, near, 1)
    weight = np.exp((similar - similar.max(1, keepdims=True)) / FALL) * mass[near]
    return (weight * labels[near]).sum(1) / weight.sum(1)


def _featured(batches):
    for b in batches:
        x = features(b.column("text").to_pylist()).astype(np.float16)
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])


def learn(docs: DataFrame, labels: DataFrame, label: str, learning, per_label: int = PER_LABEL):
    """A model from at most `per_label` rows of each label, taken in the order of a hash of the id; of rows that repeat an id one.

    None if no label is known; that label if there is only one.
    """
    known = labels.where(F.col(label).isNotNull() & learning(F.col("doc_id"))).groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("label"))
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return float(next(iter(shares))) if shares else None
    picked = None
    for value in shares:
        some = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = some if picked is None else picked.union(some)
    rows = one_text_each(docs, picked, "label").select(F.col("text").cast("binary").alias("text"), "label")
    rows = rows.mapInArrow(task(_featured), "label int, x binary").collect()
    there = {r["label"] for r in rows}
    if len(there) < 2:
        return float(there.pop()) if there else None
    y = np.array([r["label"] for r in rows], np.float32)
    x = np.empty((len(rows), TRIGRAMS + 8 * BINS), np.float32)
    for i in range(len(rows) - 1, -1, -1):
        x[i] = np.frombuffer(rows.pop()["x"], np.float16)
    idf, mean, projection, latent = fit(x)
    mass = np.array([shares[v] / max(1, (y == v).sum()) for v in y.astype(int)], np.float32)
    return idf, mean, projection, _unit(latent), y, mass


def score_texts(model, texts: list[bytes | None]) -> np.ndarray:
    """Scores of texts; 0.5 with no model."""
    if model is None or isinstance(model, float):
        return np.full(len(texts), 0.5 if model is None else model)
    idf, mean, projection, known, labels, mass = model
    out = [vote(_unit((weigh(features(texts[at : at + 256]), idf) - mean) @ projection), known, labels, mass) for at in range(0, len(texts), 256)]
    return np.concatenate(out).astype(float) if out else np.zeros(0)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, remainder: int = 2, threshold: float = THRESHOLD, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted; one row per row of `docs`.

    Labels are learned from rows of other folds than the held-out one. Their latent vectors are
    broadcast (at most 2 * per_label rows of 64 floats); each block of documents is multiplied with
    all of them. Null and empty texts are scored as a text without features. Null ids are not held
    out; rows that repeat are scored alike; a null label says nothing, conflicting ones are averaged.
    No labels: every score is 0.5, one label only: every score is that label. No rows: no rows.
    Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels.select("doc_id", label), label, lambda i: ~in_fold(i, modulus, remainder), per_label))

    def run(batches):
        for b in batches:
            found = score_texts(model.value, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    ready = docs.select("doc_id", in_fold(F.col("doc_id"), modulus, remainder).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return ready.mapInArrow(task(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, remainder: int = 2, threshold: float = THRESHOLD, per_label: int = PER_LABEL) -> DataFrame:
    """The rows of `docs` that score at least `threshold`, as they are."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels.select("doc_id", label), label, lambda i: ~in_fold(i, modulus, remainder), per_label))

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            yield b.filter(pa.array(score_texts(model.value, texts) >= threshold))

    return docs.mapInArrow(task(run), docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
