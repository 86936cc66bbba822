"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm.common import in_fold, one_text_each, table, task

#: Confirmed examples and unlabelled texts that the classifier is fitted to, at most.
POSITIVES, UNLABELLED = 2_500, 5_000
#: Hash slots of words and word beginnings, and bytes of a beginning.
SLOTS, BEGINNING = 1 << 18, (4, 5, 6)
#: Features kept: in this many positives at least, and this much more frequent among them than overall.
SUPPORT, LIFT = 4, 4.0
STEPS, RATE, SHRINK = 400, 0.05, 2e-5
#: The class prior is taken this much above its estimate: too low a prior gives up positives near the boundary.
PRIOR_SLACK = 1.15
THRESHOLD = 0.5


class Slots(dict):
    """Hash slots of a word and of its beginnings, worked out when first met."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        bare = word.strip(b".,;:!?\"'()[]*#$%&-|")
        found = (zlib.crc32(b"=" + bare) % SLOTS, *(zlib.crc32(b"^" + bare[:n]) % SLOTS for n in BEGINNING if len(bare) > n)) if bare else ()
        if len(self) > 400_000:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def slots_of(text: bytes | None, slots: Slots) -> np.ndarray:
    """The distinct slots of a text."""
    found: set[int] = set()
    for w in set((text or b"").lower().split()):
        found.update(slots[w])
    return np.fromiter(found, np.int32, len(found))


def fit(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS, rate: float = RATE, shrink: float = SHRINK) -> tuple[np.ndarray, float]:
    """Weights over slots and a bias that minimise the non-negative risk.

    With sigmoid loss l the risk is prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]); while
    the second term is negative its gradient is followed backwards. Only slots that occur clearly
    more often among the positives get a weight, and none below 0: length alone then speaks neither way.
    """
    in_p = np.bincount(np.concatenate([*positives, np.zeros(0, np.int32)]), minlength=SLOTS)
    in_u = np.bincount(np.concatenate([*unlabelled, np.zeros(0, np.int32)]), minlength=SLOTS)
    lift = (in_p / max(len(positives), 1)) / ((in_u + 1) / (len(unlabelled) + 1))
    chosen = np.flatnonzero((in_p >= SUPPORT) & (lift >= LIFT))
    place = np.full(SLOTS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))

    def packed(rows):
        cols = [place[r] for r in rows]
        cols = [c[c >= 0] for c in cols]
        return np.concatenate([*cols, np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), [len(c) for c in cols])

    (pc, pr), (uc, ur) = packed(positives), packed(unlabelled)
    w, b, k = 0.5 * np.log(lift[chosen]), -2.0, len(chosen)
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, steps + 1):
        fp = b + np.bincount(pr, w[pc], len(positives))
        fu = b + np.bincount(ur, w[uc], len(unlabelled))
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -40, 40))), 1 / (1 + np.exp(-np.clip(fu, -40, 40)))
        dp, du = sp * (1 - sp) / len(positives), su * (1 - su) / len(unlabelled)
        negative = su.mean() - prior * sp.mean()
        # d/df of l(f) = s(-f) is -s(1-s), of l(-f) = s(f) it is s(1-s).
        if negative >= 0:
            gp, gu = -2 * prior * dp, du
        else:
            gp, gu = prior * dp, -du
        g = np.bincount(pc, gp[pr], k) + np.bincount(uc, gu[ur], k) + shrink * w
        gb = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        np.maximum(w, 0, out=w)
        b -= rate * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    weights = np.zeros(SLOTS, np.float32)
    weights[chosen] = w
    return weights, float(b)


def _slotted(batches):
    slots = Slots()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("positive"), pa.array([slots_of(t, slots).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["positive", "x"])


def learn(docs: DataFrame, labels: DataFrame, label: str, learning, positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    """A model from confirmed positives and texts taken whatever their label, both in the order of a
    hash of the id; the class prior is the share of positives among the labels. None without both."""
    known = labels.where(F.col(label).isNotNull() & learning(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("y"))
    n, yes = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not yes:
        return None
    order = F.xxhash64("doc_id", F.lit("sample"))
    confirmed = known.where("y = 1").orderBy(order, "doc_id").limit(positives).select("doc_id", F.lit(True).alias("positive"))
    anyone = docs.where(learning(F.col("doc_id"))).select("doc_id").distinct().orderBy(order, "doc_id").limit(unlabelled).select("doc_id", F.lit(False).alias("positive"))
    rows = one_text_each(docs, confirmed.union(anyone).groupBy("doc_id").agg(F.collect_set("positive").alias("parts")), "parts")
    rows = rows.select(F.explode("parts").alias("positive"), F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(task(_slotted), "positive boolean, x binary").collect()
    split = {flag: [np.frombuffer(r["x"], np.int32) for r in rows if r["positive"] == flag] for flag in (True, False)}
    if not split[True] or not split[False]:
        return None
    return fit(split[True], split[False], min(0.9, PRIOR_SLACK * yes / n))


def score_texts(model, texts: list[bytes | None], slots: Slots) -> np.ndarray:
    """Scores of texts; 0 with no model."""
    if model is None:
        return np.zeros(len(texts))
    weights, bias = model
    f = np.array([float(weights[slots_of(t, slots)].sum()) for t in texts]) + bias
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, remainder: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted; one row per row of `docs`.

    Only confirmed positives of the other folds are learned from, beside texts of those folds whose
    labels are not looked at; both samples are bounded, and of rows that repeat an id one is learned from. Scoring reads every whole text. Null and
    empty texts get the score of a text without features. Null ids are not held out; rows that
    repeat are scored alike; null labels say nothing. Without positives every score is 0. No rows:
    no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels.select("doc_id", label), label, lambda i: ~in_fold(i, modulus, remainder)))

    def run(batches):
        slots = Slots()
        for b in batches:
            found = score_texts(model.value, b.column("text").to_pylist(), slots)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    ready = docs.select("doc_id", in_fold(F.col("doc_id"), modulus, remainder).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return ready.mapInArrow(task(run), "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
