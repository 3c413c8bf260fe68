"""The grouped prefix join against all pairs."""

import random
import re

import pytest

from skein.llm import op13_prefix_join as op13

from ..conftest import SF

DOCS = "doc_id long, text string, digest string, n long"


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def expected(rows):
    """doc_id, n_shingles, component_id of (doc_id, text) rows, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    real = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    for x, i in enumerate(real):
        for j in real[:x]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(rows[i][0]), root(rows[j][0])
                up[max(a, b)] = min(a, b)
    return sorted(((d, len(s), None if d is None else root(d)) for (d, _), s in zip(rows, sets, strict=True)), key=str)


def answer(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def corpus(seed, n=150):
    """Families of texts with a few words changed, texts of common phrases, short texts, repeats and odd rows."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    phrases = [" ".join(r.choices(vocabulary, k=12)) for _ in range(12)]
    bases = [r.choices(vocabulary, k=r.choice([3, 9, 30, 60, 120, 121])) for _ in range(12)]
    rows = []
    for d in range(n):
        kind = r.random()
        if kind < 0.6:
            w = list(r.choice(bases))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice([*vocabulary, "NEW"])
            w += r.choices(vocabulary, k=r.choice([0, 0, 1, 2, 4]))
            text = " ".join(w)
        elif kind < 0.8:
            text = " ".join(r.choices(phrases, k=r.randint(1, 8)))
        else:
            text = r.choice(["", None, " \t ", "a", "A", "a b", "A B", "a b c", "a b c a b c", "É é", "x\xa0y z w", phrases[0] * 3])
        rows.append((d, r.choice([str, str.upper, str.title])(text) if text else text))
    rows += [(None, rows[0][1]), (None, "only here with no id at all"), (None, None), (3, rows[3][1]), (5, rows[8][1]), (5, None), (9, "")]
    return rows


def tables(spark, rows):
    return spark.createDataFrame([(d, t, "other", 1) for d, t in rows], DOCS).repartition(3)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_join_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    assert answer(op13.joined(tables(spark, rows))) == expected(rows)


def test_join_in_small_blocks(spark):
    rows = corpus(7, 220)
    assert answer(op13.joined(tables(spark, rows), batch_bytes=2000, bucket_hashes=500, block_rows=4)) == expected(rows)


def test_join_of_one_large_group(spark):
    """A third of all rows are copies or near copies of one text, of which many do not link directly."""
    r = random.Random(2)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for d in range(160):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3])):
            w[r.randrange(100)] = f"u{d}{r.random()}"
        rows.append((d, " ".join(w)))
    rows += [(1000 + d, " ".join(r.choices(base, k=100))) for d in range(50)] + [(2000 + d, " ".join(base)) for d in range(100)]
    assert answer(op13.joined(tables(spark, rows), block_rows=16)) == expected(rows)


def test_join_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert answer(op13.op13_prefix_join(spark, SF)) == expected(rows)


def test_join_of_empty_tables(spark):
    assert answer(op13.joined(tables(spark, []))) == []
    assert answer(op13.joined(tables(spark, [(1, None), (None, None)]))) == [(1, 0, 1), (None, 0, None)]


def test_prefixes_hold_a_common_shingle():
    """Of sets that link, the larger one's prefix and the smaller one's share their first common shingle, at every size."""
    for n in range(1, 400):
        large, small = op13.prefix_lengths(n)
        for m in range(-(-9 * n // 10), n + 1):
            least = next(b for b in range(m + 1) if op13.linked(b, n, m))
            assert n - least + 1 <= large and m - least + 1 <= op13.prefix_lengths(m)[1]
        assert small <= large
