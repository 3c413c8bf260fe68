"""Every stage of the pipeline against brute force, on documents with everything that may go wrong in them."""

import numpy as np
import pytest

import corpus_pipeline
from skein.llm import op4_mixing, op7_language, tokens

from .test_operators import SCHEMA, brute_substrings, docs, none, rows, weighted_classes  # noqa: F401


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark, docs):
    """Name to (input, result) of each stage, written and read again."""
    from skein.llm import common

    out, now = {}, common.staged(docs, "test-input")
    for name, stage in corpus_pipeline.STAGES:
        got = common.staged(stage(spark, now, "unused"), f"test-{name}")
        out[name] = now, got
        now = got
    return out


def test_names_and_columns(stages, docs):
    assert list(stages) == ["language", "near_dedup", "substring_dedup", "mixing", "packing"]
    assert all(got.columns == docs.columns and got.dtypes == docs.dtypes for name, (_, got) in stages.items() if name != "packing")


def test_language_drops_what_has_no_language(stages):
    docs, got = stages["language"]
    scored = {tuple(r)[:5]: r for r in op7_language.predict(docs, op7_language.fit(docs)).collect()}
    want = [k for k, r in scored.items() for _ in range(2 if k[0] == 305 else 1) if r.lang_pred != "und" and r.score >= 0.5]
    assert as_rows(got) == sorted(want, key=str)
    ids = [r.doc_id for r in got.collect()]
    assert not {300, 301, 302, 307} & set(ids) and len(ids) > 50


def test_near_dedup_keeps_one_of_each_class(stages):
    docs, got = stages["near_dedup"]
    before = as_rows(docs)
    classes = weighted_classes(before)
    assert as_rows(got) == [r for r in before if r[0] is None or classes[r[0]] == r[0]]


def test_substrings_go_from_all_but_the_first(stages):
    docs, got = stages["substring_dedup"]
    before = as_rows(docs)
    want = []
    for r, (_, _, gone, kept) in zip(before, brute_substrings(before), strict=True):
        text = kept.decode() if gone else r[1]
        want.append((r[0], text, r[2], r[3], len(text)))
    assert as_rows(got) == sorted(want, key=str)


def test_mixing_repeats_whole_documents(stages):
    docs, got = stages["mixing"]
    counts = {}
    for r in op4_mixing.mix_sources(docs).collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    before, after = as_rows(docs), as_rows(got)
    assert set(after) <= set(before) and len(after) == sum(counts.values())


def test_packing_holds_each_row_once(stages):
    docs, got = stages["packing"]
    enc = tokens.encoder(tokens.vocabulary_path())
    want = {}
    for r in docs.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(enc.tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    have, windows = {}, {}
    for r in got.collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert have == want
    for w in windows.values():
        w.sort()
        assert [a for a, _ in w] == np.cumsum([0, *(n for _, n in w[:-1])]).tolist() and sum(n for _, n in w) <= 4096


def test_run_writes_and_reads_between_stages(spark, docs, none, tmp_path):
    docs.write.parquet(str(tmp_path / "some" / "documents.parquet"))
    none.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "some")).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
