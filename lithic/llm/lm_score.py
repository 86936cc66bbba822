"""Language-model scores from a hashed maximum-entropy model."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm.common import in_fold, stage, table, task

#: Words whose counts are broadcast, at most; the counts of all others are joined.
HEAD = 1 << 18
#: Words that the model tells apart, and the buckets of word endings that all other words share.
WORDS, BUCKETS = 3_328, 64
#: Hashed ids by which those other words stand in contexts.
CONTEXTS = 1 << 13
#: Slots of a class, classes at most, and clusters of spelling that classes are cut from.
SLOTS, CLASSES, SPELLINGS = 64, 64, 10
#: Hashed rows for pairs of preceding words and for words within classes, powers of two.
PAIR_ROWS, WORD_ROWS = 1 << 14, 1 << 16
#: Rounds of gradient updates; together they take every position of every training text once.
ROUNDS, BATCH, RATE = 3, 2_048, 0.6
#: Positions whose contexts are built at once.
PASS = 1 << 14
#: Training tokens that one task of a round takes, about, and the tasks whose moves are averaged at once.
SHARE, FAN = 1 << 23, 16
#: Bytes of texts that are encoded together.
TEXT_BYTES = 1 << 20
#: Distinct words that a counting task holds before it passes them on.
HELD = 400_000
#: Rows of parameters that travel together.
BLOCK = 4_096

END = b""
SYMBOLS = WORDS + BUCKETS
NEAR = WORDS + CONTEXTS
START = NEAR


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, and the end."""
    words = text.lower().split() if text else []
    words.append(END)
    return words


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


def ids_of(word: bytes, place: int = WORDS) -> int:
    """Symbol of a word (by its place among the most frequent) and, 16 bits above it, its id in contexts.

    A word that the model doesn't tell apart is its ending's bucket as a target, and a hash of the whole word as a context.
    """
    if place < WORDS:
        return place | place << 16
    return WORDS + bucket_of(word) | WORDS + zlib.crc32(word) % CONTEXTS << 16


class Buckets(dict):
    """`ids_of` rare words, by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD // 4:
            self.clear()
        self[word] = found = ids_of(word)
        return found


def _counted(batches):
    held: Counter = Counter()

    def out():
        words = list(held)
        batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
        held.clear()
        return batch

    for b in batches:
        for t in b.column("text").to_pylist():
            held.update(words_of(t))
            if len(held) >= HELD:
                yield out()
    if held:
        yield out()


def count_words(texts: DataFrame) -> DataFrame:
    """word (binary), c over texts (text binary); summed up in each task before the shuffle."""
    return texts.select("text").mapInArrow(task(_counted, None), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def classes_of(words: list[bytes], seed: int = 5) -> np.ndarray:
    """Class and slot of each word (most frequent first): words spelled alike share a cluster, and a
    cluster is cut into classes of SLOTS words by frequency."""
    if not words:
        return np.zeros((0, 2), np.int64)
    x = np.zeros((len(words), 256), np.float32)
    for i, w in enumerate(words):
        w = b"^" + w + b"$"
        for a in range(len(w) - 1):
            x[i, zlib.crc32(w[a : a + 2]) & 255] += 1
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    k = min(SPELLINGS, len(words))
    centres = x[np.random.default_rng(seed).choice(len(words), k, replace=False)]
    for _ in range(12):
        near = (x @ centres.T).argmax(1)
        centres = np.stack([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(k)])
        centres = centres / (np.linalg.norm(centres, axis=1, keepdims=True) + 1e-9)
    out, opened = np.zeros((len(words), 2), np.int64), 1  # class 0 holds the buckets
    for c in range(k):
        mine = np.flatnonzero(near == c)
        place = np.arange(len(mine))
        out[mine] = np.stack([opened + place // SLOTS, place % SLOTS], 1)
        opened += -(-len(mine) // SLOTS)
    return out


@dataclass
class Layout:
    """Which class and slot each symbol has, and which slots there are."""

    cls: np.ndarray
    slot: np.ndarray
    class_off: np.ndarray
    slot_off: np.ndarray

    @classmethod
    def of(cls, words: list[bytes], counts: np.ndarray | None = None, shared: np.ndarray | None = None) -> Layout:
        """The layout of the most frequent words. Without features classes and slots are as likely as the
        counts of the words and of the buckets' other words (`shared`) say, or all alike without counts."""
        found = classes_of(words)
        place = np.zeros((SYMBOLS, 2), np.int64)
        place[: len(words)] = found
        place[WORDS:, 1] = np.arange(BUCKETS)
        mass = np.zeros((CLASSES, SLOTS))
        mass[found[:, 0], found[:, 1]] = 1 if counts is None else counts
        mass[0, :BUCKETS] = 1 if shared is None else np.maximum(shared, 1)
        there, total = mass > 0, mass.sum(1)
        if counts is None:
            slot_off, class_off = np.where(there, 0, -1e9), np.where(there.any(1), 0, -1e9)
        else:
            slot_off = np.where(there, np.log(np.maximum(mass, 1e-9)) - np.log(np.maximum(total, 1e-9))[:, None], -1e9)
            class_off = np.where(total > 0, np.log(np.maximum(total, 1e-9)) - np.log(total.sum()), -1e9)
        return cls(place[:, 0], place[:, 1], class_off.astype(np.float32), slot_off.astype(np.float32))


def contexts(s: np.ndarray, at: np.ndarray | None = None, before: np.ndarray | None = None) -> np.ndarray:
    """Feature rows of positions (all by default): the word before, the one before that, the third back, and the pair before.

    `s` holds the context ids of texts one after the other; `before` says how many words of its own
    text precede a position (one text by default).
    """
    at = np.arange(len(s)) if at is None else at
    before = at if before is None else before
    one, two, three = (np.where(before >= k, s[np.maximum(at - k, 0)], START).astype(np.int64) for k in (1, 2, 3))
    width = NEAR + 1
    pair = ((one * 0x9E3779B1 + two * 0x85EBCA6B) >> 7) & (PAIR_ROWS - 1)
    return np.stack([one, width + two, 2 * width + three, 3 * width + pair], 1)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The 16-bit ids of a column of texts one after the other, and where each text begins."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, "<u2", (last - first) // 2, first) if last > first else np.zeros(0, "<u2"), (offsets[:-1] - first) // 2


CLASS_ROWS = 3 * (NEAR + 1) + PAIR_ROWS


def word_rows(context: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Rows of the features that tell words of a class apart: class with the word before and with the one
    before that. The class alone needs none: the layout's offsets are the words' shares of it."""
    return ((context[:, :2] * 0xC2B2AE3D + cls[:, None] * 0x27D4EB2F) >> 9) & (WORD_ROWS - 1)


def _logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = weights.take(rows[:, 0], 0)
    for k in range(1, rows.shape[1]):
        out += weights.take(rows[:, k], 0)
    return out


#: Rows that occur in a batch at most this often are summed layer by layer, so many of them at once that they stay in a core's cache.
LAYERS, TILE = 8, 1_024
#: Logits below this need no shift before they are exponentiated, unless all of a row are far below 0.
SAFE_LOGIT, SAFE_SUM = 60.0, 1e-25


def _exponents(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(z - shift), its row sums and the shift, which is 0 where the logits allow it. Overwrites z."""
    if z.max(initial=0.0) < SAFE_LOGIT:
        e = np.exp(z)
        total = e @ np.ones(e.shape[1], e.dtype)
        if total.min(initial=1.0) > SAFE_SUM:
            return e, total, 0.0
    shift = z.max(1)
    z -= shift[:, None]
    np.exp(z, out=z)
    return z, z.sum(1), shift


def _log_at(z: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Log softmax of each row at one column. Overwrites z."""
    hit = z.reshape(-1).take(np.arange(0, z.size, z.shape[1]) + column)
    _, total, shift = _exponents(z)
    return hit - shift - np.log(total)


def _softmax(z: np.ndarray) -> np.ndarray:
    """Overwrites z."""
    e, total, _ = _exponents(z)
    e /= total[:, None]
    return e


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows (those that occur most first), how often each occurs, the places of `rows` sorted by them,
    where each begins there, and for every place which of the distinct rows it holds."""
    flat = rows.ravel()
    if flat.max(initial=0) < 1 << 16:
        flat = flat.astype(np.uint16)  # sorted by radix
    order = np.argsort(flat, kind="stable")
    flat = flat.take(order)
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    times = np.diff(np.append(first, len(flat)))
    by_times = np.argsort(-times, kind="stable")
    rank = np.empty(len(first), np.int64)
    rank[by_times] = np.arange(len(first))
    back = np.empty(len(flat), np.int64)
    back[order] = np.repeat(rank, times)
    first = first.take(by_times)
    return flat.take(first).astype(np.int64), times.take(by_times), order, first, back.reshape(rows.shape)


def _sums(rows: np.ndarray, g: np.ndarray, found: tuple):
    """The sums of the gradients where each of the distinct rows (`found`) occurs, a slice of them at a time.

    Most rows occur a few times in a batch: their gradients are added layer by layer, and only those of
    the few frequent rows are laid side by side for `add.reduceat`, which is slow on short runs.
    """
    _, times, order, first, _ = found
    at = order >> 1 if rows.shape[1] == 2 else order >> 2 if rows.shape[1] == 4 else order // rows.shape[1]
    frequent = int(np.searchsorted(-times, -LAYERS))  # rows that occur more than LAYERS times
    if frequent:
        n = times[:frequent]
        begin = np.cumsum(n) - n
        places = at.take(np.repeat(first[:frequent] - begin, n) + np.arange(n.sum()))
        yield slice(0, frequent), np.add.reduceat(g.take(places, 0), begin, 0)
    for low in range(frequent, len(times), TILE):
        z = slice(low, low + TILE)
        begin, n = first[z], times[z]
        total = g.take(at.take(begin), 0)
        for k in range(1, int(n[0])):
            many = int(np.searchsorted(-n, -k))  # rows that occur more than k times
            total[:many] += g.take(at.take(begin[:many] + k), 0)
        yield z, total


def _summed(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows (those that occur most first), how often each occurs, and the sum of the gradients where it does."""
    found = _distinct(rows)
    return found[0], found[1], np.concatenate([total for _, total in _sums(rows, g, found)])


def _put_rows(weights: np.ndarray, which: np.ndarray, rows: np.ndarray) -> None:
    """weights[which] = rows, each row as one item, which is twice as fast; both are contiguous."""
    whole = np.dtype((np.void, weights.itemsize * weights.shape[1]))
    weights.view(whole)[:, 0][which] = rows.view(whole)[:, 0]


class Model:
    """Parameters of the class-factored softmax: P(class | features) * P(word | class, features)."""

    def __init__(self, layout: Layout, w1: np.ndarray | None = None, w2: np.ndarray | None = None, seen1: np.ndarray | None = None, seen2: np.ndarray | None = None):
        self.layout = layout
        if w1 is None:
            w1 = np.zeros((CLASS_ROWS, CLASSES), np.float32)
            w1[: NEAR + 1] = layout.class_off  # every position has one word before, so its row bears the classes' shares
        self.w1 = w1
        self.w2 = np.zeros((WORD_ROWS, SLOTS), np.float32) if w2 is None else w2
        self.seen1 = np.zeros(CLASS_ROWS, np.float32) if seen1 is None else seen1
        self.seen2 = np.zeros(WORD_ROWS, np.float32) if seen2 is None else seen2

    def copy(self) -> Model:
        return Model(self.layout, self.w1.copy(), self.w2.copy(), self.seen1.copy(), self.seen2.copy())

    def log_probs(self, symbols: np.ndarray, near: np.ndarray | None = None, starts: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of every symbol of texts, in sparse batches; `near` are their context ids if they differ."""
        out, near, place = np.empty(len(symbols)), symbols if near is None else near, np.arange(len(symbols))
        before = place if starts is None else place - np.repeat(starts, np.diff(np.append(starts, len(symbols))))
        for at in range(0, len(symbols), BATCH):
            s = symbols[at : at + BATCH].astype(np.int64)
            r = contexts(near, place[at : at + BATCH], before[at : at + BATCH])
            c, k = self.layout.cls.take(s), self.layout.slot.take(s)
            z = _logits(self.w1, r)
            y = _logits(self.w2, word_rows(r, c))
            y += self.layout.slot_off.take(c, 0)
            out[at : at + BATCH] = _log_at(z, c) + _log_at(y, k)
        return out

    def update(self, rows: np.ndarray, symbols: np.ndarray, rate: float = RATE) -> None:
        """One gradient step over a batch of positions; a row's steps shrink with the square root of its visits."""
        c, k = self.layout.cls.take(symbols), self.layout.slot.take(symbols)
        for weights, seen, at, off, hit in ((self.w1, self.seen1, rows, None, c), (self.w2, self.seen2, word_rows(rows, c), self.layout.slot_off.take(c, 0), k)):
            found = which, times, _, _, back = _distinct(at)
            mine = weights.take(which, 0)  # the rows that the batch reads and moves, side by side
            g = _logits(mine, back)
            if off is not None:
                g += off
            g = _softmax(g)
            g.reshape(-1)[np.arange(0, g.size, g.shape[1]) + hit] -= 1
            visits = seen.take(which) + times.astype(np.float32)
            seen[which] = visits
            scale = (rate / np.sqrt(visits * times)).astype(np.float32)[:, None]
            for z, total in _sums(at, g, found):
                total *= scale[z]
                moved = mine[z]
                moved -= total
                _put_rows(weights, which[z], moved)


def _gradients(model, round_: int, rounds: int):
    """Train a copy on a share of the texts (uid, symbols, context ids), at every position whose turn it is in this round; pass on by how much each row moved and how often it was visited."""

    def run(batches):
        start, lane = model.value, TaskContext.get().partitionId()
        mine = start.copy()
        rows, symbols, n = [], [], 0

        def step(least):
            nonlocal rows, symbols, n
            r, s = np.concatenate(rows), np.concatenate(symbols)
            at = 0
            while len(s) - at >= least and at < len(s):
                mine.update(r[at : at + BATCH], s[at : at + BATCH])
                at += BATCH
            rows, symbols, n = [r[at:]], [s[at:]], max(0, len(s) - at)

        for b in batches:
            (s, starts), (near, _), uid = flat(b.column("symbols")), flat(b.column("near")), b.column("uid").to_numpy()
            turn = (uid + round_) % rounds
            picks = np.maximum(0, -((turn - np.diff(np.append(starts, len(s)))) // rounds))  # positions of each text whose turn it is
            text = np.repeat(np.arange(len(starts)), picks)
            preceding = turn[text] + rounds * (np.arange(len(text)) - np.repeat(np.cumsum(picks) - picks, picks))
            for first in range(0, len(text), PASS):
                before = preceding[first : first + PASS]
                at = starts[text[first : first + PASS]] + before
                rows.append(contexts(near, at, before))
                symbols.append(s[at].astype(np.int64))
                n += len(at)
                if n >= 8 * BATCH:
                    step(BATCH)
        if n:
            step(1)
        for kind, w, w0, seen, seen0 in ((1, mine.w1, start.w1, mine.seen1, start.seen1), (2, mine.w2, start.w2, mine.seen2, start.seen2)):
            for at in range(0, len(w), BLOCK):
                z = slice(at, at + BLOCK)
                times = seen[z] - seen0[z]
                moved = np.flatnonzero(times)
                if len(moved):
                    yield pa.RecordBatch.from_pylist([{"lane": lane, "kind": kind, "at": at, "rows": moved.astype("<i4").tobytes(), "times": times[moved].astype("<f4").tobytes(), "moves": (w[z] - w0[z])[moved].astype("<f2").tobytes()}], DELTA)

    return run


DELTA = pa.schema([("lane", pa.int32()), ("kind", pa.int32()), ("at", pa.int32()), ("rows", pa.binary()), ("times", pa.binary()), ("moves", pa.binary())])
_DELTA = "lane int, kind int, at int, rows binary, times binary, moves binary"


def _averaged(group: pa.Table) -> pa.Table:
    """Moves of a block of rows, averaged over tasks by visits; visits added up."""
    lane, kind, at = (group.column(c)[0].as_py() for c in ("lane", "kind", "at"))
    width = CLASSES if kind == 1 else SLOTS
    times, moves = np.zeros(BLOCK, np.float32), np.zeros((BLOCK, width), np.float32)
    for i in range(group.num_rows):
        rows, n, move = (np.frombuffer(group.column(c)[i].as_py(), t) for c, t in (("rows", "<i4"), ("times", "<f4"), ("moves", "<f2")))
        times[rows] += n
        moves[rows] += n[:, None] * move.reshape(-1, width)
    rows = np.flatnonzero(times)
    return pa.Table.from_pylist([{"lane": lane, "kind": kind, "at": at, "rows": rows.astype("<i4").tobytes(), "times": times[rows].tobytes(), "moves": (moves[rows] / times[rows, None]).astype("<f2").tobytes()}], DELTA)


def train(encoded: DataFrame, layout: Layout, rounds: int = ROUNDS, tokens: int | None = None) -> Model:
    """Rounds of distributed gradient updates over texts (uid, symbols, and near where words have other ids in contexts), every position in one of them.

    In a round each task trains a copy of the parameters on a share of the texts. There are as many
    shares as the number of tokens asks for, whatever the cluster, so that no task grows with the
    input. Blocks of moved rows are averaged by visits on the executors, FAN tasks at a time, so
    neither a task nor the driver gets more than a fixed number of sets of parameters.
    """
    context = encoded.sparkSession.sparkContext
    model = Model(layout)
    texts = encoded.select("uid", "symbols", F.col("near" if "near" in encoded.columns else "symbols").alias("near"))
    if tokens is None:
        tokens = texts.agg(F.coalesce(F.sum(F.octet_length("symbols")), F.lit(0))).first()[0] // 2
    shares = max(1, -(-tokens // SHARE))
    texts = texts.coalesce(shares)
    for r in range(rounds):
        sent = context.broadcast(model)
        moved, lanes = texts.mapInArrow(task(_gradients(sent, r, rounds), 2_000), _DELTA), shares
        while True:
            moved = moved.withColumn("lane", F.floor(F.col("lane") / FAN).cast("int")).groupBy("lane", "kind", "at").applyInArrow(_averaged, _DELTA)
            lanes = -(-lanes // FAN)
            if lanes == 1:
                break
        moved = moved.collect()
        sent.destroy()
        model = model.copy()
        for row in moved:
            w, seen, width = (model.w1, model.seen1, CLASSES) if row["kind"] == 1 else (model.w2, model.seen2, SLOTS)
            at = row["at"] + np.frombuffer(row["rows"], "<i4")
            w[at] += np.frombuffer(row["moves"], "<f2").reshape(-1, width).astype(np.float32)
            seen[at] += np.frombuffer(row["times"], "<f4")
    return model


def _encoded(head):
    """Symbols of each text, sums over words with broadcast counts, and the other words with their numbers."""

    def run(batches):
        words, logs, symbol = head.value
        place = dict(zip(words, range(len(words))))
        logs, symbol, rare_ids = np.append(logs, 0.0), np.append(symbol, 0), Buckets()
        for b in batches:
            texts = b.column("text").to_pylist()
            size = np.cumsum([len(t or b"") for t in texts])
            # Texts of TEXT_BYTES at a time, or one that is longer.
            cuts = [0, *(np.flatnonzero(np.diff(size // TEXT_BYTES)) + 1).tolist(), len(texts)]
            for first, last in zip(cuts, cuts[1:]):
                if first == last:
                    continue
                tokens = [words_of(t) for t in texts[first:last]]
                n = np.array([len(t) for t in tokens])
                tokens = [w for t in tokens for w in t]
                starts = np.cumsum(n) - n
                at = np.fromiter(map(place.get, tokens, repeat(-1)), np.int64, len(tokens))
                s, missing = symbol[at], np.flatnonzero(at < 0)
                rare = [tokens[i] for i in missing.tolist()]
                s[missing] = list(map(rare_ids.__getitem__, rare))
                near, s = (s >> 16).astype("<u2"), (s & 0xFFFF).astype("<u2")
                log, rare_ends = logs[at], np.searchsorted(missing, np.append(starts, len(tokens)))
                offsets = pa.py_buffer((np.append(starts, len(tokens)) * 2).astype("<i4").tobytes())
                out = b.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([
                    out.column("doc_id"), out.column("held_out"), pa.array(n, pa.int64()), pa.array(n - np.diff(rare_ends)),
                    pa.array(np.add.reduceat(log, starts)), pa.array(np.add.reduceat(np.where(s >= WORDS, log, 0), starts)),
                    *(pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(x.tobytes())]) for x in (s, near)),
                    pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), pa.array(rare, pa.binary())),
                ], schema=ENCODED)

    return run


ENCODED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("head_known", pa.int64()), ("head_log", pa.float64()), ("shared_log", pa.float64()), ("symbols", pa.binary()), ("near", pa.binary()), ("tail", pa.list_(pa.field("element", pa.binary())))])
_ENCODED = "doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, shared_log double, symbols binary, near binary, tail array<binary>"


def score_texts(docs: DataFrame, modulus: int = 7, remainder: int = 2, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """Score every text with a model learned from the folds that aren't held out.

    Counts of all training words stay distributed. Those of the most frequent (at most `head`, so
    that they fit a broadcast) are looked up; the rest of a text's words are joined with their counts.
    The model tells WORDS words apart as targets, and hashes the others by themselves as contexts; a rarer word's probability is its ending bucket's, times its
    share of the bucket by count plus one, unseen words counting as one more word.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input
    row. Null and empty texts are the end alone. Null ids are not held out; rows that repeat count as
    often as they occur. Without training rows N and V are 0 and the model is uniform. No rows: no
    rows. Other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold(F.col("doc_id"), modulus, remainder).alias("held_out"), F.col("text").cast("binary").alias("text"))
    counts = stage(count_words(texts.where("not held_out")), "counts")
    level = F.floor(F.log2("c") * 16).cast("int")
    steps = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, lowest = 0, 1 << 20
    for at, n in steps:
        if total + n > head:
            break
        total, lowest = total + n, at
    top = counts.where(level >= lowest).toArrow()
    top = sorted(zip(top.column("c").to_pylist(), top.column("word").to_pylist()), key=lambda x: (-x[0], x[1]))
    words = [w for _, w in top]
    symbol = np.array([ids_of(w, i) for i, w in enumerate(words)], np.int64)
    logs = np.log10(np.array([c for c, _ in top], float) + 1)

    ending = F.expr("CASE WHEN length(word) > 3 THEN substring(word, -3, 3) ELSE word END")
    bucket = (F.crc32(ending) % BUCKETS).cast("int")
    sums = {r["bucket"]: (r["n"], r["v"]) for r in counts.groupBy(bucket.alias("bucket")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n_all, v_all = sum(n for n, _ in sums.values()), sum(v for _, v in sums.values())
    mass = np.array([sum(sums.get(b, (0, 0))) + 1 for b in range(BUCKETS)], float)
    for (c, w) in top[:WORDS]:
        mass[bucket_of(w)] -= c + 1
    log_mass = np.log10(np.maximum(mass, 1))
    layout = Layout.of(words[:WORDS], np.array([c + 1 for c, _ in top[:WORDS]], float), mass)

    found = context.broadcast((words, logs, symbol))
    del words, logs, symbol, top
    encoded = stage(texts.mapInArrow(task(_encoded(found)), _ENCODED).withColumn("uid", F.monotonically_increasing_id()), "encoded")
    model = context.broadcast((train(encoded.where("not held_out"), layout, rounds, n_all), log_mass))

    def run(batches):
        m, lost = model.value
        for b in batches:
            (s, starts), (near, _) = flat(b.column("symbols")), flat(b.column("near"))
            found = m.log_probs(s, near, starts) / np.log(10)
            rare = np.flatnonzero(s >= WORDS)
            found[rare] -= lost[s[rare].astype(np.int64) - WORDS]
            scores = np.add.reduceat(found, starts) if len(starts) else found  # no text is without its end
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEPT), pa.array(scores, pa.float64())], [*KEPT, "model_log"])

    scored = encoded.select(*KEPT, "symbols", "near").mapInArrow(task(run, 2_000), "uid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, shared_log double, model_log double")
    tail = encoded.select("uid", F.explode("tail").alias("word")).join(counts, "word")
    tail = tail.groupBy("uid").agg(F.count("*").alias("tail_known"), F.sum(F.log10(F.col("c") + 1)).alias("tail_log"))
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return scored.join(tail, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * F.lit(float(np.log10(n_all + v_all + 1)))).alias("base_score"),
        (F.col("model_log") + F.col("shared_log") + tail_log).alias("score"),
    )


KEPT = ["uid", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "shared_log"]


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
