"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from skein.llm import batches, common, op1_warc, op2_block_search, op3_substrings, op4_mixing, op5_packing, op6_rules, op7_language, op8_ordinal, op9_weighted_minhash, op10_token_store, tokens

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with everything that may go wrong in them."""
    rng = random.Random(5)
    shared = sentences(rng, 40)
    out = [(i, sentences(rng, rng.randrange(5, 90)), rng.choice(["en", "de"]), rng.choice(["a", "a", "b"]), 1) for i in range(40)]
    out += [(100 + i, f"{sentences(rng, 7 + i)} {shared} {sentences(rng, 9)}", "en", "a", 1) for i in range(8)]
    base = sentences(rng, 200).split()
    for i in range(12):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        out.append((200 + i, " ".join(w), "de", "b", 1))
    out += [(300, None, "en", "a", None), (301, "", None, "b", 0), (302, " \n\t ", "en", None, 3), (303, "one two", "en", "a", 7), (304, "one  two", "en", "a", 7)]
    out += [(None, shared, "en", "a", 1), (305, shared, "en", "a", 1), (305, shared, "en", "a", 1), (306, "été déjà naïve   à b " + "z" * 500, "en", "a", 1), (307, "12 34 !!", "en", "a", 1)]
    out += [(308, sentences(rng, 30_000, 500), "en", "a", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- shared pieces ---


def test_packed_keys_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (common.unpack_sorted(common.pack_sorted(keys)) == keys).all()
    assert len(common.unpack_sorted(common.pack_sorted(keys[:0]))) == 0
    edges = common.bucket_edges(keys, 7, 64)
    assert edges[0] == 0 and edges[-1] == len(keys) and (np.diff(edges) >= 0).all()
    here, there = batches.member(keys, keys[::3])
    assert (keys[here] == keys[::3]).all() and (there == np.arange(len(keys[::3]))).all()


def test_ids_of_words_are_ids_of_texts(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 20)
    enc = tokens.WordIds(tokens.vocabulary_path())
    rng = random.Random(3)
    alphabet = "abcXYZ'sÉéßΣςİ²½ª\x1c\x85\xa0\u0301\u0345 \n\t\r\x0b\x0c  ́eΩ漢字😀<|endoftext|>don't 12"
    for text in ["", "Don't STOP", "a<|endoftext|>b", "ΑΣ ΑΣ.", "e ́x", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)), "q" * 300]:
        whole = enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.encode_texts([text.encode()], enc, 1)[0], "<u4").tolist() == [*whole, 1], repr(text)


def test_ids_of_all_letters_of_the_latin_blocks():
    enc = tokens.WordIds(tokens.vocabulary_path())
    letters = [chr(c) for c in range(0xA1, 0x370)]
    for text in [*(f"{x} a{x}b {x}1'{x}" for x in letters), *(f"{b}{x} A{b}{x}b" for b in "AEOTaeotÂâ=<" for x in letters if "\u0300" <= x), " ".join(letters)]:
        whole = enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.encode_texts([text.encode()], enc, 1)[0], "<u4").tolist() == [*whole, 1], repr(text)


# --- 1 ---


def test_warc_against_brute_force(spark):
    big = "é" * 120
    rows = [(5, "http://a/x", big), (2, "http://b/\r\ny", big), (9, None, big), (1, "http://c", "short"), (3, "http://d", "short"), (4, "u", None), (6, "v", ""), (None, "w", big), (7, "http://e", "WARC/1.1\r\n\r\nx" * 30), (8, "http://e", "WARC/1.1\r\n\r\nx" * 30)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, uid string")
    manifest = op1_warc.write_archives(pages, common.new_path(spark, "warc"), file_bytes=500)
    assert manifest.count() > 3
    got = {r.page_id: r for r in op1_warc.captures(op1_warc.read_records(manifest)).collect()}
    firsts = {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (html or "").encode()
        first = firsts.setdefault(data, page)
        again = len(data) >= 100 and first is not None and (page is None or first < page)
        r = got[page]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_page) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None)
        assert r.request.concurrent_to == r.metadata.concurrent_to == r.capture_id
        assert again or r.response.payload == data
    assert len(got) == 10 and got[None].refers_to_page == 2
    empty = op1_warc.write_archives(pages.limit(0), common.new_path(spark, "warc"))
    assert op1_warc.captures(op1_warc.read_records(empty)).count() == 0


def test_warc_repeated_pages(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 200)] * 2 + [(1, "v", "x" * 200)], "page_id long, url string, html string")
    got = op1_warc.captures(op1_warc.read_records(op1_warc.write_archives(pages, common.new_path(spark, "warc")))).collect()
    assert [(r.page_id, r.payload_bytes, r.record_type) for r in got] == [(1, 200, "response")] * 3


def test_warc_equal_rows_are_captures_of_their_own(spark, tmp_path):
    rows = [(2, "u", "x" * 200)] * 3 + [(2, "v", "x" * 200), (3, "u", "x" * 200), (3, "u", "x" * 200)] + [(4, "u", "short")] * 2 + [(5, None, None)] * 2 + [(None, "u", "short")] * 2
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((tuple(r) for r in op1_warc.op1_warc(spark, str(tmp_path)).collect()), key=str)
    want = [(p, len(h or ""), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if p == 3 else "response", 2 if p == 3 else None) for p, _, h in rows]
    assert got == sorted(want, key=str)
    records = op1_warc.read_records(op1_warc.write_archives(spark.read.parquet(str(tmp_path / "pages.parquet")), common.new_path(spark, "warc"))).collect()
    assert len({r.record_id for r in records}) == len(records) == 3 * len(want)


# --- 2 ---


def brute_nearest(vectors, k, every):
    fine = {i: np.array(v, float) for i, v in vectors if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q in sorted(i for i in fine if i % every == 0):
        s = sorted((-round(float(fine[q] @ v / np.sqrt(fine[q] @ fine[q]) / np.sqrt(v @ v)), 12), i) for i, v in fine.items() if i != q)
        out += [(q, r + 1, i) for r, (_, i) in enumerate(s[:k])]
    return out


def test_block_search_is_exact(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    same = [float(x) for x in rng.normal(size=8)]
    vectors += [(300 + i, same) for i in range(60)]
    vectors += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0] * 7 + [None]), (404, [float("inf")] * 8), (405, [1.0, 2.0]), (None, same), (406, [x * 1e-30 for x in same]), (407, [])]
    table = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, score int").repartition(3)
    from pyspark.sql import functions as F

    for block, group in ((2048, 8), (16, 1)):
        got = op2_block_search.nearest(table, F.col("vec_id") % 10 == 0, 5, block, group).collect()
        assert sorted((r.query_id, r.rank, r.vec_id) for r in got if r.query_id != 406) == [x for x in brute_nearest(vectors, 5, 10)]
    few = op2_block_search.nearest(table.where("vec_id < 3"), F.col("vec_id") % 10 == 0).collect()
    assert len(few) == 2
    assert op2_block_search.nearest(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0


# --- 3 ---


def brute_substrings(rows):
    """(doc_id, kept words) in the order of rows."""
    starts = {}
    words = [WORD.findall((r[1] or "").encode()) for r in rows]
    for (doc, *_), w in zip(rows, words, strict=True):
        if doc is not None:
            for i in range(len(w) - 12):
                g = tuple(w[i : i + 13])
                starts[g] = min(starts.get(g, doc), doc)
    for (doc, *_), w in zip(rows, words, strict=True):
        gone = set()
        if doc is not None:
            for i in range(len(w) - 12):
                if starts[tuple(w[i : i + 13])] < doc:
                    gone |= set(range(i, i + 13))
        yield doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("size", [(batches.BATCH_BYTES, batches.BUCKET_HASHES), (2000, 500)])
def test_substrings_against_brute_force(docs, rows, size):
    got = op3_substrings.dedup_substrings(docs.withColumnRenamed("n_chars", "n_words"), batch_bytes=size[0], bucket_hashes=size[1]).collect()
    assert got[0].__fields__ == ["doc_id", "text", "lang", "source", "n_words", "n_words_", "n_removed", "kept_sha256"]
    want = sorted((d if d is not None else -1, n, r, hashlib.sha256(k).hexdigest()) for d, n, r, k in brute_substrings(rows))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words_, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(w[2] for w in want) > 300
    texts = {r[0]: r[1] for r in rows}
    assert all(r.text == texts[r.doc_id] for r in got if r.n_removed == 0)


def test_substrings_shifted_and_empty(spark, none):
    rng = random.Random(8)
    passage = sentences(rng, 14)
    rows = [(i, f"{sentences(rng, i)} {passage} {sentences(rng, 3)}", None, None, None) for i in range(30)] + [(99, sentences(rng, 5) + " " + " ".join(passage.split()[1:13]), None, None, None)]
    got = op3_substrings.dedup_substrings(spark.createDataFrame(rows, SCHEMA), batch_bytes=1000).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == sorted((d, n) for d, _, n, _ in brute_substrings(rows))
    assert op3_substrings.dedup_substrings(none).count() == 0


# --- 4 ---


def test_mixing_follows_its_rates(spark, docs, none):
    many = spark.range(20_000).selectExpr("id AS doc_id", "concat('t', id) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 1000 = 1 THEN 'tiny' WHEN id % 7 = 0 THEN NULL ELSE 'rest' END AS source", "1 AS copy")
    out = op4_mixing.mix_sources(many, {"hot": 1.0, "tiny": 1.0, None: 1.0, "rest": 1.0})
    assert out.columns == ["doc_id", "text", "source", "copy", "copy_", "shuffle_key"]
    for r in out.groupBy("source").count().collect():
        assert abs(r["count"] - 5000) < 5 * 5000**0.5, r
    hot = out.where("source = 'hot'").groupBy("doc_id").count().groupBy("count").count().collect()
    rate, n = 5000 / 6667, {r[0]: r[1] for r in hot}
    assert abs(n[1] - 6667 * rate * np.exp(-rate)) < 150 and abs(n[2] - 6667 * rate**2 / 2 * np.exp(-rate)) < 120
    assert sorted(map(tuple, op4_mixing.mix_sources(docs).collect()), key=str) == sorted(map(tuple, op4_mixing.mix_sources(docs.repartition(7)).collect()), key=str)
    assert op4_mixing.mix_sources(docs, {}).count() == 0 and op4_mixing.mix_sources(none).count() == 0


def test_mixing_salted_join_gives_the_same(docs, monkeypatch):
    want = sorted(map(str, op4_mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(op4_mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(str, op4_mixing.mix_sources(docs).collect())) == want


# --- 5 and 10 ---


def test_packing_holds_each_id_once(docs, rows, none):
    enc = tokens.encoder(tokens.vocabulary_path())
    for shard in (op5_packing.SHARD_TOKENS, 3000):
        got = op5_packing.pack(docs, shard_tokens=shard).collect()
        by_doc, by_seq = {}, {}
        for r in got:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_seq.setdefault(r.sequence_id, []).append(r)
            assert len(r.ids) == 4 * r.length > 0
        for s in by_seq.values():
            s.sort(key=lambda r: r.offset)
            assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s[:-1])]).tolist()
            total = sum(r.length for r in s)
            assert total <= 4096 and total & (total - 1) == 0
        for doc, text, *_ in rows:
            if doc not in (None, 305):
                parts = sorted(by_doc[doc], key=lambda r: r.start)
                ids = np.array([*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
                assert b"".join(p.ids for p in parts) == ids and all(p.doc_tokens == len(ids) // 4 for p in parts)
                assert [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts[:-1])]).tolist()
        assert sum(r.length for r in by_doc[305]) == 2 * by_doc[305][0].doc_tokens
    assert op5_packing.pack(none).count() == 0


def test_packing_prefers_lexical_neighbours():
    rng = np.random.default_rng(4)
    topics = [rng.integers(0, 400, 60) + 1000 * t for t in range(4)]
    docs = [rng.choice(topics[i % 4], 1024).astype(np.uint16) for i in range(64)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=5000)
    pieces = op5_packing.pack_shard(docs, np.log1p((64 - df + 0.5) / (df + 0.5)), 1024)
    topics_of = {}
    for doc, _, _, seq, _ in pieces:
        topics_of.setdefault(seq, set()).add(doc % 4)
    assert all(len(t) == 1 for t in topics_of.values())


def test_packing_scores_all_ids_of_a_seed():
    rng = np.random.default_rng(12)
    docs = [np.append(rng.integers(0, 900, rng.integers(1, 400)), 2).astype(np.uint16) for _ in range(60)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1000)
    idf, mean = np.log1p((60 - df + 0.5) / (df + 0.5)), float(np.mean([len(d) for d in docs]))

    def bm25(seed, d):
        tf = np.bincount(d, minlength=1000)[np.unique(docs[seed])]
        return (idf[np.unique(docs[seed])] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))).sum()

    index, used = op5_packing.Index(docs, idf, mean), np.zeros(60, bool)
    for gone in ([], [7], range(20), range(50), range(60)):
        used[list(gone)] = True
        index.drop(used)
        for seed in (0, 25, 59):
            got = index.scores(seed)
            assert np.allclose(got[~used], [bm25(seed, d) for d, u in zip(docs, used, strict=True) if not u], rtol=1e-5)
    assert index.live == len(index.doc) == 0


def test_token_store_round_trip(spark, docs, rows, none):
    enc = tokens.encoder(tokens.vocabulary_path())
    manifest = op10_token_store.write_store(docs, common.new_path(spark, "store"), tokens.vocabulary_path())
    got = sorted(op10_token_store.read_store(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        ids = np.array([*enc.tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert bytes(r.ids) == ids and r.n_tokens == len(ids) // 4
    first = manifest.collect()[0]
    shard = op10_token_store.Shard(first.uri, first.dictionary_uri)
    assert len(shard.ids(0)) == 4 * shard.index["n"][0]
    empty = op10_token_store.write_store(none, common.new_path(spark, "store"), tokens.vocabulary_path())
    assert op10_token_store.read_store(empty).count() == 0


def test_token_store_refuses_another_dictionary(spark, docs):
    a, b = (op10_token_store.write_store(d, common.new_path(spark, "store"), tokens.vocabulary_path()).first() for d in (docs, docs.where("doc_id < 30")))
    with pytest.raises(ValueError):
        op10_token_store.Shard(a.uri, b.dictionary_uri)


# --- 6, 7 and 8 ---


def brute_statistics(text):
    ws = WORD.findall((text or "").encode())
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line.encode()):
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(ws) - 2):
        grams.setdefault(tuple(ws[i : i + 3]), []).append(i)
    covered = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(3)}
    return len(ws), sum(len(w.decode()) for w in ws), sum(w.decode().count(c) for w in ws for c in "#*$%&|<>"), dup, len(covered)


def test_rules_against_brute_force(spark, docs, rows, none):
    odd = [(500, "a b c\n\na b c\nx\na b c\r\n\n", None, None, None), (501, "#$ é|ü <a>\x0b% & **", None, None, None), (502, "p q r p q r p q", None, None, None)]
    table = docs.unionByName(spark.createDataFrame(odd, SCHEMA))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = op6_rules.judge(table, labels).collect()
    want = sorted((r[0] or 0, *brute_statistics(r[1])) for r in rows + odd)
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert op6_rules.judge(none, labels).count() == 0
    assert all(r.kept != r.base_failed for r in op6_rules.judge(docs, labels.limit(0)).collect())


def test_rules_catch_bad_rows(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = op6_rules.judge(table, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").toPandas()
    bad, good = got[got.quality == 0], got[got.quality == 1]
    print("held out:", len(bad), "bad, caught", 1 - bad.kept.mean(), len(good), "good, lost", 1 - good.kept.mean())
    assert len(bad) > 100 and 1 - bad.kept.mean() > 0.75 and 1 - good.kept.mean() < 0.08
    assert op6_rules.cut(np.array([0.1, 0.2, 0.6]), np.array([0.5, 0.7]), 0.0) == 0.2 and op6_rules.cut(np.array([0.3]), np.array([0.1]), 0.0) == 1.0


def test_forest_scores_against_walking_its_trees():
    x = np.random.default_rng(6).normal(size=(400, 3))
    x[-1] = 9
    forest = op6_rules.Forest(x)

    def walk(tree, row):
        feature, value, left, path = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] + (row[feature[at]] >= value[at])
        return path[at]

    want = [2 ** (-np.mean([walk(t, r) for t in forest.trees]) / float(op6_rules.average_path(256))) for r in x]
    got = forest.scores(x)
    assert np.allclose(got, want) and got.argmax() == 399
    assert op6_rules.Forest(x[:0]).scores(x[:2]).tolist() == [0, 0]


def test_language(spark, docs, none):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op7_language.fit(table)
    got = op7_language.predict(table, model).where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").selectExpr("avg(cast(lang = lang_pred as int)) AS a", "min(score) AS low", "max(score) AS high").first()
    assert got.a > 0.97 and got.low >= 0 and got.high <= 1
    odd = {r.doc_id: r for r in op7_language.predict(docs.withColumnRenamed("n_chars", "score"), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score_ == 0 for i in (300, 301, 302, 307)) and odd[308].lang_pred != "und"
    assert op7_language.predict(none, model).count() == 0
    nothing = op7_language.fit(none)
    assert {r.lang_pred for r in op7_language.predict(docs, nothing).collect()} == {"und"}
    assert op7_language.identified(table).count() > 0.98 * table.count()


def test_language_never_learns_from_held_out_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = [r.doc_id for r in table.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and not {r.doc_id for r in op7_language.learned_rows(table).collect()} & set(held)


def test_ordinal(spark, docs, none):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    trained = op8_ordinal.train(table, op8_ordinal.rated(labels), fit_docs=3000)
    model, _ = trained
    assert (np.diff(model.thresholds) > 0).all()
    got = op8_ordinal.grade(table, trained).join(labels, "doc_id").toPandas()
    good = (got.quality == 1) & (got.toxic == 0)
    # a seventh of the rows rated low bear no mark at all; those with insults do
    assert got[good].kept.mean() > 0.98 and got[~good].kept.mean() < 0.2
    insults = table.where("text rlike '(?i)\\\\b(idiot|moron|scum|loser|pathetic)\\\\b'").select("doc_id").toPandas().doc_id
    assert len(insults) > 200 and got[got.doc_id.isin(insults)].kept.mean() < 0.02
    assert got[good].expected_grade.mean() > got[~good].expected_grade.mean() + 0.3
    odd = op8_ordinal.grade(docs, trained).collect()
    assert all(0 <= r.p_top <= 1 and 0 <= r.expected_grade <= 2 for r in odd)
    assert op8_ordinal.train(docs, op8_ordinal.rated(labels.limit(0))) is None and all(r.kept and r.p_top is None for r in op8_ordinal.grade(docs, None).collect())
    assert op8_ordinal.grade(none, trained).count() == 0


# --- 9 ---


def weighted_classes(rows, threshold=0.8):
    """Classes by comparing all pairs, with exact document frequencies."""
    texts = {}
    for doc, text, *_ in rows:
        if doc is not None:
            texts.setdefault(tuple((text or "").split()), []).append(doc)
    grams = {}
    for w in texts:
        g = {}
        for i in range(max(1, len(w) - 4)) if w else ():
            g[w[i : i + 5]] = g.get(w[i : i + 5], 0) + 1
        grams[w] = g
    df, n = {}, sum(map(len, texts.values()))
    for w, g in grams.items():
        for x in g:
            df[x] = df.get(x, 0) + len(texts[w])
    weight = {w: {x: k * float(op9_weighted_minhash.idf_of(np.rint(8 * np.log2(df[x])), n)) for x, k in g.items()} for w, g in grams.items()}
    names = [w for w in texts if w]
    root = {w: w for w in names}

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    for i, a in enumerate(names):
        for b in names[:i]:
            both = sum(min(v, weight[b].get(x, 0)) for x, v in weight[a].items())
            if both and both >= threshold * (sum(weight[a].values()) + sum(weight[b].values()) - both):
                root[find(a)] = find(b)
    out = {d: d for w, ds in texts.items() for d in ds}
    least = {}
    for w in names:
        least[find(w)] = min([least.get(find(w), min(texts[w])), *texts[w]])
    return out | {d: least[find(w)] for w in names for d in texts[w]}


@pytest.mark.parametrize("size", [{}, {"batch_bytes": 3000, "bucket_hashes": 500, "block_bytes": 3000}, {"block_rows": 3}])
def test_near_duplicates_against_all_pairs(docs, rows, size):
    got = op9_weighted_minhash.near_duplicates(docs, **size).collect()
    assert len(got) == len(rows)
    want = weighted_classes(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert len({want[200 + i] for i in range(12)}) == 1 and want[304] == 303
    kept = op9_weighted_minhash.near_dedup(docs, **size)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect() if r.doc_id is not None}) == sorted(set(want.values()))


def test_near_duplicates_in_a_large_group():
    import pickle

    def text(own, n_own):
        keys = np.concatenate([np.arange(820), np.arange(n_own) + own]).astype(np.uint64)
        code = np.concatenate([np.full(820, np.rint(8 * np.log2(10_000))), np.zeros(n_own)]).astype(np.uint8)
        return pickle.dumps((keys.tobytes(), np.ones(len(keys), np.uint32).tobytes(), code.tobytes()), 5)

    # plain Jaccard 820 / 1000, 820 / 1000 and 820 / 1040; weighted below 0.8
    c = op9_weighted_minhash.Clusters([(1, text(10_000, 90), 1), (2, text(20_000, 90), 2), (3, text(30_000, 130), 3)], 1_000_000, 0.8)
    assert c.similar(0, 1) and not c.similar(0, 2)


def test_near_duplicates_of_nothing(none):
    assert op9_weighted_minhash.near_duplicates(none).count() == 0


def test_samples_collide_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(7)
    hits, want = [], []
    for _ in range(60):
        s = rng.integers(0, 2**63, 300, dtype=np.uint64)
        w = rng.uniform(1, 4, 300)
        v = w * rng.choice([1, 1, 1, 2, 0.5], 300)
        a, b = slice(0, 260), slice(20, 300)
        both = np.minimum(np.where(np.arange(300) < 260, w, 0), np.where(np.arange(300) >= 20, v, 0)).sum()
        want.append(both / (w[a].sum() + v[b].sum() - both))
        hits.append((op9_weighted_minhash.samples(s[a], np.log(w[a])) == op9_weighted_minhash.samples(s[b], np.log(v[b]))).mean())
    assert abs(np.mean(hits) - np.mean(want)) < 0.03


def test_components(spark):
    from skein.llm.components import components

    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)] + [(500, 500)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_share_a_doc_id_fill_all_batches_and_shards(spark, tmp_path):
    """A doc_id of all rows, and null in a third: op3's batches and op10's shards are dealt by more than the id."""
    from skein.llm import batches
    from skein.llm import op3_substrings as op3

    rows = [(7 if i % 3 else None, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, gathered = [], batches.gathered
    batches.gathered = lambda packed, n: seen.append((n, packed.select("batch").distinct().count())) or gathered(packed, n)
    try:
        out = op3.dedup_substrings(df, batch_bytes=4000)
    finally:
        batches.gathered = gathered
    assert out.where("n_removed > 0").count() == 0 and seen[0][0] > 20 and seen[0][1] > 0.8 * seen[0][0]


def test_op6_threshold_counts_every_labelled_row():
    """Scores with the rows that have each give the cut of the rows themselves, with bad ones and without."""
    r = np.random.default_rng(8)
    good, bad = np.array([0.1, 0.3, 0.4, 0.6]), np.array([0.3, 0.5, 0.6, 0.7])
    for _ in range(20):
        n, m = r.integers(1, 9, 4), r.integers(1, 9, 4)
        assert op6_rules.cut(good, bad, 0.1, n, m) == op6_rules.cut(np.repeat(good, n), np.repeat(bad, m), 0.1)
        assert op6_rules.cut(good, bad[:0], 0.1, n, m[:0]) == np.sort(np.repeat(good, n))[min(n.sum() - 1, int(np.ceil(0.9 * n.sum())))]
