"""Best-fit packing planned over a histogram of lengths."""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.llm.common import stage, table, task

TOKENIZER = "word_bpe_49k.json"
END = 1
CAPACITY = 4096
#: White-space separated chunks whose ids a task remembers before it starts afresh.
REMEMBERED = 300_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


#: Letters that stand for bytes in the model: those that print stand for themselves, the others follow from 256 on.
_PRINT = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINT)}

#: What the short cuts of `ChunkIds` are proven for; texts of any other tokenizer are encoded whole.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
PRE_TOKENIZER = ["Split", "ByteLevel"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_space(spec: dict) -> bool:
    """Whether a tokenizer (its JSON) normalizes and splits in the way that lets texts be encoded by chunks."""
    normalizer, pre, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    parts, steps = normalizer.get("normalizers", []), pre.get("pretokenizers", [])
    return (
        [n["type"] for n in parts] == NORMALIZER and parts[1]["pattern"] == {"Regex": r"\s+"} and parts[1]["content"] == " "
        and [n["type"] for n in steps] == PRE_TOKENIZER and steps[0]["pattern"] == {"Regex": SPLIT} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]) for t in spec.get("added_tokens", []))
        and model.get("type") == "BPE" and not model.get("dropout") and not spec.get("truncation") and not spec.get("padding")
    )


class ChunkIds(dict):
    """Ids of a text without white space, as little-endian unsigned 32-bit bytes, worked out when first met.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    chunks in order. Nor does it join letters or digits with ASCII punctuation, so a chunk that ends
    in punctuation is two. A chunk of letters that its normalizer leaves as they are needs only its
    model; all else goes through the whole tokenizer. Which characters are letters is asked of the
    tokenizer itself, and where its parts aren't those expected it encodes whole texts.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.closing = self.tokenizer.model, set(), {}
        with open(path, encoding="utf-8") as f:
            self.by_chunk = splits_at_space(json.load(f))

    def of(self, text: bytes | None) -> bytes:
        """Ids of a whole text. A-Z may be made small beforehand unless a mark that combines with a letter
        (U+0300 to U+036F start with these bytes) or a special token could be meant."""
        text = text or b""
        if not self.by_chunk:
            return self._whole(text)
        if b"\xcc" not in text and b"\xcd" not in text and b"<|" not in text:
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bool:
        """Whether the normalizer keeps a text and the tokenizer takes all of it as letters."""
        if not self.letters.issuperset(text):
            for c in {*text} - self.letters:
                if self.tokenizer.normalizer.normalize_str(c) != c or len(self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}a")) != 1:
                    return False
                self.letters.add(c)
        # Characters below U+3000 have composed alike in all versions of Unicode that know them.
        return unicodedata.is_normalized("NFC", text) if max(text) < "\u3000" else self.tokenizer.normalizer.normalize_str(text) == text

    def _closes(self, c: str) -> bool:
        """Whether punctuation after this character, normalized, is split off."""
        if c not in self.closing:
            self.closing[c] = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(f"{c}."))[-1][0] == "."
        return self.closing[c]

    def _ids(self, chunk: bytes) -> bytes:
        if chunk.isalpha() and chunk.islower():
            return np.array([t.id for t in self.model.tokenize(chunk.decode())], "<u4").tobytes()
        text = None if chunk.isascii() else chunk.decode("utf-8", "replace")
        if text and text.isalpha() and self._plain(text):
            return np.array([t.id for t in self.model.tokenize(chunk.decode("latin-1").translate(BYTE_LETTERS))], "<u4").tobytes()
        body = chunk.rstrip(PUNCTUATION)
        if body and len(body) < len(chunk) and b"<|" not in chunk and (body[-1:].isalnum() or (body[-1] > 127 and self._closes(text[len(text) - len(chunk) + len(body) - 1]))):
            return self[body] + self[chunk[len(body) :]]
        return self._whole(chunk)

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self._ids(chunk)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


def _pieces(path: str, capacity: int, end: int):
    """Pieces of each document, with their rank among this task's pieces of the same length."""

    def run(batches):
        ids, last, task = ChunkIds(path), np.array([end], "<u4").tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                data = ids.of(text) + last
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc, piece, at // 4, n, zlib.crc32(part), task, int(seen[n])))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]) if rows else pa.RecordBatch.from_pylist([], PIECES)

    return run


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())])


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit by decreasing length over counts: (length, rank, pieces, sequence, per_sequence, offset).

    Pieces rank .. rank + pieces - 1 of `length` go to the sequences from `sequence` on, `per_sequence`
    to each, the first of a sequence at `offset`. Sequences that are filled alike are one run of
    numbers, so the work grows with the square of the number of lengths at most and not with the
    number of pieces.
    """
    plan, runs, spaces, opened = [], {}, [], 0  # runs: space left -> [(first sequence, how many)]

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in runs:
                insort(spaces, space)
                runs[space] = []
            runs[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        at = bisect_left(spaces, length)
        while left and at < len(spaces):
            space = spaces[at]
            per, waiting, back = space // length, runs.pop(space), []
            del spaces[at]
            while waiting and left:
                first, n = waiting.pop()
                full = min(n, left // per)
                if full:
                    plan.append((length, rank, full * per, first, per, capacity - space))
                    rank, left = rank + full * per, left - full * per
                    back.append((space - per * length, first, full))
                if full < n and left:
                    plan.append((length, rank, left, first + full, left, capacity - space))
                    back.append((space - left * length, first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < n:
                    waiting.append((first + full, n - full))
            for first, n in waiting:
                put(space, first, n)
            for rest, first, n in back:
                put(rest, first, n)
            at = bisect_left(spaces, length)
            # What was put back below `length` lies before `at`; an equal space was used up or `left` is 0.
        if left:
            per = capacity // length
            full, odd = divmod(left, per)
            if full:
                plan.append((length, rank, full * per, opened, per, 0))
                put(capacity - per * length, opened, full)
            if odd:
                plan.append((length, rank + full * per, odd, opened + full, odd, 0))
                put(capacity - odd * length, opened + full, 1)
            opened += full + bool(odd)
    return plan


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    One pass tokenizes each document (with `end` after it), cuts what is longer than a sequence and
    ranks each piece among its task's pieces of the same length. The histogram of lengths (at most
    `capacity` rows) is planned on the driver by best fit over counts. A piece's rank within its
    length is its rank in its task plus the pieces of earlier tasks, and its slot is the planned run
    that this rank falls into.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are the
    end token alone. Every row counts, repeats of an id too. Sequences are gapless from offset 0. No
    rows: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    pieces = stage(texts.mapInArrow(task(_pieces(tokenizer or tokenizer_path(), capacity, end)), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"), "pieces")
    tallies = stage(pieces.groupBy("length", "task").count(), "tallies")
    counts = {r["length"]: r["n"] for r in tallies.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    earlier = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(tallies.withColumn("earlier", earlier).drop("count"), ["length", "task"])
    plan = best_fit_plan(counts, capacity)
    lengths = np.array([p[0] for p in plan], np.int64)
    slots = spark.sparkContext.broadcast((lengths, *(np.array([p[i] for p in plan], np.int64) for i in range(1, 6))))

    def place(batches):
        length, rank, _, first, per, offset = slots.value
        # Runs of a length follow each other in rank; a sorted composite key finds the run of a piece.
        order = np.lexsort((rank, length))
        length, rank, first, per, offset = (x[order] for x in (length, rank, first, per, offset))
        starts = np.searchsorted(length, np.arange(capacity + 2))
        for b in batches:
            n, r = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "global_rank"))
            at = np.empty(len(n), np.int64)
            for v in np.unique(n):
                which = n == v
                at[which] = starts[v] + np.searchsorted(rank[starts[v] : starts[v + 1]], r[which], "right") - 1
            into = r - rank[at]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(first[at] + into // per[at]), pa.array(offset[at] + into % per[at] * n)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("earlier")).alias("global_rank"))
    return ranked.mapInArrow(task(place, None), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
