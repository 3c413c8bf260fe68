"""Packing, language ID, ordinal regression and large near-duplicate groups against plain recomputation."""

import random
from collections import Counter

import numpy as np
import pytest

from skein.llm import common, op5_packing, op7_language, op8_ordinal, op9_weighted_minhash, tokens

from .test_operators import SCHEMA, docs, none, rows, sentences, weighted_classes  # noqa: F401

# --- 5 ---


def naive_pack(docs, idf, mean, window):
    """Greedy packing, every BM25 score computed anew from counts."""
    n = len(docs)
    tf = [Counter(d.tolist()) for d in docs]

    def bm25(seed, d):
        return sum(idf[t] * tf[d][t] * 2.2 / (tf[d][t] + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) for t in tf[seed] if tf[d][t])

    placed, done, windows = [0] * n, [False] * n, []
    for i in range(n):
        while len(docs[i]) - placed[i] >= window:
            windows.append([(i, placed[i], window)])
            placed[i] += window
        done[i] = placed[i] == len(docs[i])
    rest = None
    while rest is not None or not all(done):
        seed = rest if rest is not None else done.index(False)
        mine, room, rest = [], window, None
        queue = None
        at = seed
        while at is not None:
            take = min(len(docs[at]) - placed[at], room)
            mine.append((at, placed[at], take))
            placed[at] += take
            room -= take
            done[at] = True
            rest = at if placed[at] < len(docs[at]) else rest
            if not room:
                break
            if queue is None:
                scored = [(-np.float32(s), d) for d in range(n) if not done[d] and (s := bm25(seed, d)) > 0]
                queue = [d for _, d in sorted(scored)]
            at = queue.pop(0) if queue else next((d for d in range(n) if not done[d]), None)
        windows.append(mine)
    return windows


def test_packing_chooses_the_best_neighbours():
    rng = np.random.default_rng(8)
    topics = [rng.integers(0, 300, 50) + 1000 * t for t in range(5)]
    docs = [np.append(rng.choice(topics[i % 5], int(rng.integers(1, 700))), 2).astype(np.uint16) for i in range(70)] + [np.append(rng.choice(topics[0], 2500), 2).astype(np.uint16)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=5000)
    idf, mean = np.log1p((71 - df + 0.5) / (df + 0.5)), float(np.mean([len(d) for d in docs]))
    by_seq = {}
    for doc, start, length, seq, offset in sorted(op5_packing.pack_shard(docs, idf, mean, 1024), key=lambda p: (p[3], p[4])):
        by_seq.setdefault(seq, []).append((doc, start, length))
        assert offset == sum(x[2] for x in by_seq[seq][:-1])
    got = [w for w in by_seq.values() if sum(x[2] for x in w) == 1024]
    want = [w for w in naive_pack(docs, idf, mean, 1024) if sum(x[2] for x in w) == 1024]
    assert got == want and len(got) > 20


def test_packing_is_the_same_in_two_runs(docs):
    for shard in (op5_packing.SHARD_TOKENS, 3000):
        a, b = (sorted(map(str, op5_packing.digests(op5_packing.pack(d, shard_tokens=shard)).collect())) for d in (docs, docs.repartition(7)))
        assert a == b


def test_packing_deals_out_a_hot_signature(spark):
    table = spark.createDataFrame([(i, "one and the same text of a few words", None, None, None) for i in range(400)], SCHEMA)
    got = op5_packing.pack(table, shard_tokens=500).collect()
    assert len({r.sequence_id >> 32 for r in got}) > 3 and sum(r.length for r in got) == 400 * got[0].doc_tokens


def test_token_rows(rows):
    enc = tokens.encoder(tokens.vocabulary_path())
    import pyarrow as pa

    texts = [(r[1] or "").encode() for r in rows]
    for got in tokens.encode_rows(pa.array(texts, pa.binary()), enc, 2):
        parts = [got.ids[a:b].astype(np.uint64) for a, b in zip(got.at, got.at[1:], strict=False)]
        sig = [int((common.mix(p[:-1] << np.uint64(32) | p[1:]) >> np.uint64(1)).min()) if len(p) > 1 else 0 for p in parts]
        assert op5_packing.signatures(got).tolist() == sig
        want = [(i, int(t), int(n)) for i, p in enumerate(parts) for t, n in zip(*np.unique(p, return_counts=True), strict=True)]
        assert list(zip(*(x.tolist() for x in op5_packing.distinct(got)), strict=True)) == want
        assert tokens.binary_rows(got, "<u2").to_pylist() == [p.astype("<u2").tobytes() for p in parts]


# --- 7 ---


def plain_bucket(gram):
    h = 0
    for n, c in enumerate(gram, 1):
        h = (h * 0x01000193 + ord(c) * int(op7_language.FACTORS[n - 1]) + n) & 0xFFFFFFFF
    h ^= h >> 15
    return ((h * 0x2C1B3C6D) & 0xFFFFFFFF) >> 12 & (op7_language.BUCKETS - 1)


def plain_grams(text):
    text = text.lower()
    return Counter(plain_bucket(text[i : i + n]) for n in (1, 2, 3) for i in range(len(text) - n + 1))


def test_language_scores_against_naive_bayes(spark, monkeypatch):
    monkeypatch.setattr(op7_language, "CHUNK", 97)
    rng = random.Random(4)
    known = [(i, "".join(rng.choice("abcdé z") for _ in range(rng.randrange(0, 400))), "x" if i % 3 else "y") for i in range(40)] + [(90, None, "y"), (91, "learned from no language", None)]
    table = spark.createDataFrame(known, "doc_id long, text string, lang string")
    model = op7_language.fit(table)
    learned = {r.doc_id for r in op7_language.learned_rows(table).collect()}
    counts, prior = {"x": Counter(), "y": Counter()}, Counter()
    for i, text, lang in known:
        if i in learned:
            prior[lang] += 1
            counts[lang] += plain_grams(text or "")
    assert model.langs == ["x", "y"] and 91 not in learned
    sums = {k: sum(c.values()) + 0.5 * op7_language.BUCKETS for k, c in counts.items()}
    texts = [t for _, t, _ in known] + ["", "a", "Éz", "b" * 1000, "12 ²", "½ ① 12", "Ⅷ", "漢"]
    for text, (lang, score) in zip(texts, model.scores([None if t is None else t.encode() for t in texts]), strict=True):
        if not any(c.isalpha() for c in text or ""):
            assert (lang, score) == ("und", 0.0)
            continue
        grams = plain_grams(text)
        n = sum(grams.values())
        s = {k: np.log(prior[k] / sum(prior.values())) + min(1, 60 / n) * sum(m * np.log((counts[k][b] + 0.5) / sums[k]) for b, m in grams.items()) for k in "xy"}
        best = max(sorted(s), key=s.get)
        assert lang == best and abs(score - 1 / (1 + np.exp(min(s.values()) - max(s.values())))) < 1e-3


def test_language_ties_repeats_and_no_doc_id(spark):
    same = op7_language.Model(["a", "b"], np.zeros((op7_language.BUCKETS, 2)), np.log([0.5, 0.5]))
    assert same.scores([b"text", b"text"]) == [("a", 0.5)] * 2
    table = spark.createDataFrame([(None, "text", "a"), (1, "text", "a"), (1, "text", "a")], "doc_id long, text string, lang string")
    assert op7_language.learned_rows(table).where("doc_id is null").count() == 0


# --- 8 ---


def test_ordinal_gradients_against_differences():
    rng = np.random.default_rng(3)
    model = op8_ordinal.Ordinal(4)
    model.first, model.gaps = -0.7, np.array([0.2, -0.4])
    score, y = rng.normal(size=50), rng.integers(0, 4, 50)
    loss, g_score, g_t = model.gradients(score, y)
    t = [-0.7, -0.7 + np.exp(0.2), -0.7 + np.exp(0.2) + np.exp(-0.4)]
    below = [[0.0, *(1 / (1 + np.exp(-(c - s))) for c in t), 1.0] for s in score]
    assert abs(loss + np.mean([np.log(b[k + 1] - b[k]) for b, k in zip(below, y, strict=True)])) < 1e-9
    eps = 1e-6
    for i in (0, 7, 49):
        moved = score.copy()
        moved[i] += eps
        assert abs((model.gradients(moved, y)[0] - loss) / eps - g_score[i]) < 1e-4
    for i in range(3):
        other = op8_ordinal.Ordinal(4)
        other.first, other.gaps = model.first + eps * (i == 0), model.gaps + eps * np.array([i == 1, i == 2])
        assert abs((other.gradients(score, y)[0] - loss) / eps - g_t[i]) < 1e-4


def test_ordinal_probabilities_and_expected_grade(spark):
    model = op8_ordinal.Ordinal(3)
    rng = np.random.default_rng(5)
    model.w = rng.normal(size=len(model.w))
    model.first, model.gaps = -0.3, np.array([0.1])
    texts = ["some words here", "Other WORDS, here!", "some words here", "", None, "w " * 5000]
    got = {r.doc_id: r for r in op8_ordinal.grade(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), (model, 0.5)).collect()}
    for i, t in enumerate(texts):
        counts = Counter(b for w in (t or "").encode().split() for b in op8_ordinal.Buckets()[w])
        norm = np.sqrt(sum(np.log1p(n) ** 2 for n in counts.values()))
        s = sum(model.w[b] * np.log1p(n) / norm for b, n in counts.items())
        a, b = (1 / (1 + np.exp(-(c - s))) for c in (-0.3, -0.3 + np.exp(0.1)))
        assert abs(got[i].p_top - (1 - b)) < 1e-5 and abs(got[i].expected_grade - ((b - a) + 2 * (1 - b))) < 1e-5 and got[i].kept == (got[i].p_top >= 0.5)
    assert got[0].p_top == got[2].p_top


def test_ordinal_bounds_what_it_learns_from(spark):
    table = spark.createDataFrame([(i, f"w{i} common words {i % 5}") for i in range(60)] + [(3, "again")] * 4, "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(60)] + [(3, 1)], "doc_id long, grade int")
    assert len(op8_ordinal._fit_rows(table, ratings, 1000, 10**6)) == 60 + 1 + 8
    assert len(op8_ordinal._fit_rows(table, ratings, 20, 10**6)) <= 20 + 8
    assert 1 <= len(op8_ordinal._fit_rows(table, ratings, 1000, 640)) <= 10
    assert len(op8_ordinal._fit_rows(table, ratings, 1000, 1)) == 1


# --- 9 ---


@pytest.mark.parametrize("how", [{"block_rows": 4}, {"block_rows": 2}, {"block_rows": 8, "block_bytes": 20_000}])
def test_near_duplicates_of_many_blocks(spark, how):
    """Groups that are larger than a block, chained and just below the threshold."""
    rng = random.Random(21)
    out = []
    for g in range(3):
        base = sentences(rng, 120).split()
        for i in range(25):
            w = list(base)
            for _ in range(1 + i % 6):
                w[rng.randrange(120)] = f"x{g}-{i}-{rng.randrange(99)}"
            out.append((1000 * g + i, " ".join(w), None, None, None))
    got = {r.doc_id: r.class_id for r in op9_weighted_minhash.near_duplicates(spark.createDataFrame(out, SCHEMA), **how).collect()}
    one = {r.doc_id: r.class_id for r in op9_weighted_minhash.near_duplicates(spark.createDataFrame(out, SCHEMA), block_rows=1000).collect()}
    assert got == one and len(set(got.values())) < 70
