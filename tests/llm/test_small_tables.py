"""Each operator on small tables: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lithic.llm import chat, embedding_dedup, exact_dedup, lm_score, mixing, packing, quality, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
ROWS = [
    (1, "a b  c d e", "en", "s1", 1), (2, "abcde", "en", "s1", 1), (3, None, "en", None, None), (4, "", None, "s2", 0), (5, " \t\n", "en", "s2", 3),
    (6, LONG, "en", "s1", 1), (7, LONG + "tail", "en", "s3", 1), (8, "the same text of several words here", "en", "s1", 1), (9, "the same text of several words here", "en", "s2", 1),
    (9, "the same text of several words here", "en", "s2", 1), (None, "an orphan text", "en", "s1", 1), (10, "É ÀB   x́ </s> [INST]", "fr", "s4", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    # Columns that clash with names the operators use inside.
    return spark.createDataFrame(ROWS, DOCS).select("*", *(F.lit(7).alias(c) for c in ("fp", "uid", "size", "hash", "key", "n", "score", "task", "bucket", "word")))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, 0), (6, 0, 1), (8, 1, 0), (9, None, None), (None, 1, 1), (10, 1, 1), (10, 0, 0)], "doc_id long, quality int, toxic int")


def squeeze(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_quotient_filter_is_lossless():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 1 << 64, 500, np.uint64, endpoint=False) for _ in range(2))
    b[:200] = a[:200]
    extreme = np.array([0, 0, (1 << 64) - 1, 1 << 63], np.uint64)
    parts = [exact_dedup.CountingQuotientFilter.from_bytes(exact_dedup.CountingQuotientFilter.of(x).to_bytes()) for x in (a, b, extreme, np.zeros(0, np.uint64))]
    values, counts = parts[0].merge(*parts[1:]).entries()
    want, n = np.unique(np.concatenate([a, b, extreme]), return_counts=True)
    assert (values == want).all() and (counts == n).all()


def test_exact_groups(docs, none):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(squeeze(t), []).append((i, t or ""))
    want = {k: (min(v, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0], len(v)) for k, v in groups.items()}
    sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == sha[r.text_sha256]
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(squeeze(r.text) for r in kept.collect()) == sorted(groups)


def slow_simhash(t):
    words = (t or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            m = min(label[i], label[j])
            changed |= label[i] != m or label[j] != m
            label[i] = label[j] = m
    return label


def test_codes_cover():
    for code, bits in ((simhash.golay(), 23), (simhash.hamming(4), 15)):
        words = np.random.default_rng(1).integers(0, 1 << bits, 2000).astype(np.uint32)
        near = code.nearest(words)
        assert (code.syndrome(near) == 0).all() and np.bitwise_count(words ^ near).max() <= code.radius


def test_anchors_join_every_near_pair():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 64, 400, np.uint64, endpoint=False)
    for flips in range(5):
        y = x.copy()
        for k in range(len(y)):
            for b in rng.choice(64, flips, replace=False):
                y[k] ^= np.uint64(1) << np.uint64(b)
        a, b = ({(r, k, v) for r, k, v in zip(*map(np.ndarray.tolist, simhash.anchors_of(z)))} for z in (x, y))
        met = {r for r, _, _ in a & b}
        assert met == set(range(len(x)))


def test_near_duplicates(spark, docs, none):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows = list(ROWS)
    for g in range(6):
        base = list(rng.choice(words, 300))
        for c in range(12):
            t = list(base)
            for _ in range(c // 3):
                t[rng.integers(300)] = str(rng.choice(words))
            rows.append((100 + 20 * g + c, " ".join(t), "en", "s1", 1))
    table = spark.createDataFrame(rows, DOCS)
    fps = [slow_simhash(r[1]) for r in rows]
    assert fps == [simhash.simhash(r[1].encode() if r[1] is not None else None) for r in rows]
    label = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for r, k in zip(rows, label):
        least[k] = min((x for x in (least.get(k), r[0]) if x is not None), default=None)
    want = sorted((str(r[0]), f"{f:016x}", least[k]) for r, f, k in zip(rows, fps, label))
    for limit in (16_384, 3):
        got = simhash.near_duplicates(table, anchor_rows=limit).collect()
        assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
        assert sum(r.kept for r in got) == len(set(label))
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


def test_mixing(spark, docs, none):
    got = mixing.mix_sources(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in got) == sorted(size(r[1]) for r in ROWS)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    total = sum(r["size"] for r in got)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6
    assert all(v[0].target <= 3 * v[0].source_size + 1e-9 for v in by.values())
    assert mixing.mix_sources(none).count() == 0
    assert mixing.take_mix(docs).columns == docs.columns
    assert mixing.take_mix(docs).count() == sum(r.copies for r in got)


def test_mixing_comes_near_and_is_nested(spark):
    rows = [(i, "w " * (1 + i % 40), "en", f"s{i % 10 if i % 3 else 0}", 1) for i in range(6000)]
    table = spark.createDataFrame(rows, DOCS)
    a, b = mixing.mix_sources(table).collect(), mixing.mix_sources(table.repartition(7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    for s in {r.source for r in a}:
        mine = [r for r in a if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 40
    more = {r.doc_id: r.copies for r in mixing.mix_sources(table, weights=(6, 2, 1)).collect() if r.source == "s0"}
    assert all(more[r.doc_id] >= r.copies for r in a if r.source == "s0")


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\/s> \\", "[", "<", "", None, "[INST", "x[IMG]y", "[ROLE]a[SAYS]b[/ROLE]", "é\n😀 $1 \\1", "w " * 20_000]
    part = lambda **k: {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    rows = [(1, i, r, [part(type="text", text=t)]) for i, (t, r) in enumerate(zip(odd, ["user", "assistant", "system", "tool", None, "[INST]", "</s>", "user", "assistant", "assistant", "user"]))]
    rows += [(2, 0, "user", [part(type="text", text="see "), part(type="image", ref="a.png", width=56, height=30), part(type="text", text=" and "), part(type="document", ref="d.pdf", pages=2), part(type="audio", ref="s.wav", seconds=1.5)]), (3, 0, "assistant", None), (None, 0, "user", []), (4, 1, "user", None), (4, 1, "user", None)]
    table = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").withColumn("body", F.lit(1)).withColumn("span", F.lit(2))
    out = {r.conv_id: r for r in chat.format_chats(table).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [(r[2] or "", r[3][0]["text"] or "") for r in rows if r[0] == 1]
    spans = [out[1].formatted[s.start : s.start + s.length] for s in out[1].loss_spans]
    assert len(spans) == 3 and spans[2] == odd[9] and "</s>" not in spans[0]
    assert [(a.place, a.type, a.ref, a.tokens) for a in out[2].attachments] == [(0, "image", "a.png", 4), (1, "document", "d.pdf", 512), (2, "audio", "s.wav", 38)]
    assert out[2].formatted == "<s>[INST]see [IMG] and [DOC][AUD][/INST]" and out[2].expanded_tokens == 554
    assert out[3].turns[0].text == "" and out[4].n_turns == 2 and None in out
    assert chat.format_chats(table.limit(0)).count() == 0


def brute_links(vectors, threshold=0.95):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.abs(v).max() if g else None for v, g in zip(vectors, good)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    return [(i, j) for i in range(len(vectors)) for j in range(len(vectors)) if i != j and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 24))
    vectors = [list(map(float, b)) for b in base]
    for k in range(60):
        vectors.append(list(map(float, base[k % 12] + rng.standard_normal(24) * 0.08)))
    vectors += [vectors[0]] * 40 + [[3 * x for x in vectors[0]], None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0], [-0.0] + [1.0] * 23, [0.0] + [1.0] * 23, [1e300] * 24, [1e-300] * 24]
    ids = list(range(len(vectors)))
    ids[-1] = None
    rows = [(i, v, 0) for i, v in zip(ids, vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit(1)).withColumn("n", F.lit(1))
    links = brute_links(vectors)
    n = [sum(a == i for a, _ in links) for i in range(len(rows))]
    label = components(len(rows), links)
    for limit in (4096, 7):
        got = {r.vec_id: r for r in embedding_dedup.near_vectors(table, bucket_rows=limit).collect()}
        found = [got[i].n_links for i in ids]
        assert all(f <= m for f, m in zip(found, n)) and sum(found) >= 0.97 * sum(n)
        assert [got[i].component_id for i in ids[:-1]] == label[:-1]
        assert sum(r.kept for r in got.values()) == len(set(label))
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0
    assert embedding_dedup.near_vectors(table.where("vec_id >= 251 and vec_id <= 253")).count() == 3


@pytest.mark.parametrize("common", [0.0, 0.8])
def test_embeddings_with_a_common_component(spark, common):
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = np.sqrt(1 - common) * unit(rng.standard_normal((2_000, 64)))
    base[:, 0] += np.sqrt(common)
    base = unit(base)
    x = np.concatenate([base, unit(base[:500] + 0.29 * unit(rng.standard_normal((500, 64))))])
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found, want = np.array([got[i] for i in range(len(x))]), near.sum(1)
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum() > 0


def test_quality_edges(docs, none, labels):
    for x in (labels, labels.where("false"), labels.where("quality = 1")):
        got = quality.score_quality(docs, x).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert {r.score for r in quality.score_quality(docs, labels.where("false")).collect()} == {0.5}
    assert quality.score_quality(none, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_toxicity_edges(docs, none, labels):
    for x in (labels, labels.where("false")):
        got = toxicity.score_toxicity(docs, x).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score_toxicity(none, labels).count() == 0


def test_risk_is_kept_from_going_negative():
    rng = np.random.default_rng(5)
    clean = [rng.integers(0, 2000, 30).astype(np.int32) for _ in range(600)]
    toxic = [np.append(rng.integers(0, 2000, 30), 5000 + rng.integers(0, 5)).astype(np.int32) for _ in range(150)]
    weights, bias = toxicity.fit(toxic[:100], clean[:500] + toxic[100:], 0.1)
    score = lambda x: weights[x].sum() + bias
    assert np.mean([score(x) > 0 for x in toxic]) > 0.95 and np.mean([score(x) > 0 for x in clean[500:]]) < 0.02


def test_lm(spark, none):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "Cc", "dd"], 30) if i % 2 else rng.choice(["xx", "yy", "zz", f"u{i}"], 30)), "en", "s", 1) for i in range(300)] + [r for r in ROWS if r[0] != 6]
    got = lm_score.score_texts(spark.createDataFrame(rows, DOCS).withColumn("word", F.lit(1)).withColumn("c", F.lit(1)), head=40).collect()
    counts = {}
    tokens = {}
    for k, r in enumerate(rows):
        w = (r[1] or "").encode().lower().split() + [b""]
        tokens[k] = w
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2:
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), len(w), sum(x in counts for x in w), round(sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w), 6)) for r, w in zip(rows, tokens.values()))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and {r.train_tokens for r in got} == {n}
    assert lm_score.score_texts(none).count() == 0


def test_model_is_a_distribution():
    layout = lm_score.Layout.of([b"%d" % i for i in range(200)])
    model = lm_score.Model(layout)
    rng = np.random.default_rng(7)
    model.w1 += rng.standard_normal(model.w1.shape).astype(np.float32)
    model.w2 += rng.standard_normal(model.w2.shape).astype(np.float32)
    there = [*range(200), *range(lm_score.WORDS, lm_score.SYMBOLS)]
    last = [model.log_probs(np.array([3, 9, s], np.uint16))[-1] for s in there]
    assert abs(np.exp(last).sum() - 1) < 1e-4


def test_gradients_add_up():
    rng = np.random.default_rng(8)
    rows, g = rng.integers(0, 30, (500, 3)), rng.standard_normal((500, 4)).astype(np.float32)
    which, times, total = lm_score._summed(rows, g)
    want = np.zeros((30, 4))
    np.add.at(want, rows.ravel(), np.repeat(g, 3, 0))
    assert np.allclose(total, want[which], atol=1e-4) and times.sum() == 1500


def test_rounds_take_every_position_once(spark):
    rng = np.random.default_rng(10)
    texts = [rng.integers(0, 60, n).astype("<u2") for n in [*range(1, 40), 5_000]]
    layout = lm_score.Layout.of([b"%d" % i for i in range(60)])
    encoded = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(texts)], "uid long, symbols binary")
    for rounds in (1, 3, 4):
        model = lm_score.train(encoded, layout, rounds)
        want = sum(np.bincount(lm_score.contexts(s).ravel(), minlength=lm_score.CLASS_ROWS) for s in texts)
        assert (model.seen1 == want).all()


def test_best_fit_plan_equals_best_fit_one_by_one():
    rng = np.random.default_rng(9)
    for _ in range(30):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 33, 12), rng.integers(1, 60, 12))}
        plan = packing.best_fit_plan(counts, 32)
        fill, ranks = {}, {}
        for length, rank, n, first, per, offset in plan:
            assert rank == ranks.get(length, 0)
            ranks[length] = rank + n
            for p in range(n):
                s, o = first + p // per, offset + p % per * length
                assert fill.get(s, 0) == o
                fill[s] = o + length
        assert ranks == counts and max(fill.values()) <= 32 and set(fill) == set(range(len(fill)))
        spaces = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = [k for k, s in enumerate(spaces) if s >= length]
                if fit:
                    spaces[min(fit, key=lambda k: spaces[k])] -= length
                else:
                    spaces.append(32 - length)
        assert len(fill) <= len(spaces) + 1


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(docs, capacity=512).collect()
    want = []
    for i, t, *_ in ROWS:
        ids = own.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(str(i), k // 512, k, len(ids[k : k + 512]), zlib.crc32(np.array(ids[k : k + 512], "<u4").tobytes())) for k in range(0, len(ids), 512)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 512
    assert packing.pack(none).count() == 0


def test_chunked_ids_equal_whole_ids():
    from tokenizers import Tokenizer

    own, fast = Tokenizer.from_file(packing.tokenizer_path()), packing.ChunkIds(packing.tokenizer_path())
    for t in ["Áb H̱x. <|endoftext|>. <|ENDOFTEXT|> it's. IT'S, don't!! 12,5.", "ΟΔΟΣ. İstanbul, ﬁx² ① a\x1cd\x85e", "x̸= é. ½, 中文。x.-- ...' 's", "", "  ", "Ａ! K ß. ǅ straße é́ ᄀ가 가 ﬀ ſ ς σς ªº ʼn ŉ naïve über ñandú\u00ad"]:
        assert fast.of(t.encode()) == np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
