"""Ids by chunks equal the whole tokenizer's on random strings."""

import random

import numpy as np

from lithic.llm import packing

ODD = list("abcABCzZiIsSkKtTwW019.,'!?-\"()<|>~ \t\n  ") + list("İıßſςσΣéÉñŁłǅǆŉﬁﬂªº½²①ⅣⅳKḴ́̀̈̇̈́́҃ͅ‍­\u0085　中文가각אבعربहिन्दी😀ᲀẞ\U0001e900\U00010400") + ["'s", "'ll", "<|endoftext|>", "<|startoftext|>", "İ.", "aİ'"]


def made(rng, k):
    if k % 3 == 0:
        return "".join(rng.choice(ODD) for _ in range(rng.randint(1, 12)))
    if k % 3 == 1:
        return "".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0x36F), rng.randint(0x370, 0x2FFF)])) for _ in range(rng.randint(1, 6))) + rng.choice([".", "", ",", "')"])
    return rng.choice(ODD) + chr(rng.choice([rng.randint(0x20, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) + rng.choice([".", "!", "", " x"])


def test_random_strings():
    from tokenizers import Tokenizer

    own, fast, rng = Tokenizer.from_file(packing.tokenizer_path()), packing.ChunkIds(packing.tokenizer_path()), random.Random(4)
    assert fast.by_chunk
    texts = ["İ.", "ABCİ, ok", "aİ'", "AKİ."] + [made(rng, k) for k in range(150_000)]
    wrong = [t for t in texts if fast.of(t.encode()) != np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
    assert not wrong


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    spec = json.load(open(packing.tokenizer_path(), encoding="utf-8"))
    assert packing.splits_at_space(spec)
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        from tokenizers import Tokenizer

        own, ids = Tokenizer.from_file(str(path)), packing.ChunkIds(str(path))
        for t in ("Two  Words, İ.", "", "a\n\nb"):
            assert not ids.by_chunk and ids.of(t.encode()) == np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
