"""Whitening against numpy, conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from skein.llm import op11_whitening as op11
from skein.llm import op12_repair as op12

from ..conftest import SF

# --- whitening -------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def whole(c):
    return int(np.floor(64 * float(c))) + 1_000_000


def test_whitening_equals_numpy(spark):
    got = op11.op11_whitening(spark, SF).toPandas()
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding)]
    x = np.array([[whole(c) for c in r.embedding] for r in rows])
    n = len(x)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    top = np.argsort(-values)[:32]
    white = (x - x.mean(axis=0)) @ vectors[:, top] / np.sqrt(values[top])
    assert len(got) == n * 32 and set(got["n"]) == {n}
    by = {(r.vec_id, r.component): r for r in got.itertuples()}
    for i, r in enumerate(rows):
        assert by[r.vec_id, 1].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], x.sum(axis=0), strict=True))
    table = np.array([[by[r.vec_id, k + 1].whitened for k in range(32)] for r in rows])
    sign = np.sign((table * white).sum(axis=0))
    assert np.abs(table * sign - white).max() < 1e-8
    assert np.allclose([by[rows[0].vec_id, k + 1].explained for k in range(32)], values[top] / values.sum(), rtol=1e-9)
    assert got["identity_error"].max() < 1e-9


def small(spark, tmp_path, rows, schema=VECTORS):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    return op11.op11_whitening(spark, str(tmp_path)).collect()


def test_whitening_of_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2, 0.5], 0), (2, [0.3, -0.2, 0.5], 0), (2, [0.3, -0.2, 0.5], 0), (None, [-0.4, 0.1, 0.5], 0), (3, None, 0), (4, [], 0), (5, [0.1, None, 0.2], 0), (6, [nan, 0.0, 0.1], 0), (7, [inf, 0.0, 0.1], 0), (8, [0.1, 0.2], 0), (9, [1e30, 0.0, 0.1], 0)]
    got = small(spark, tmp_path, rows)
    assert sorted((r.vec_id is None, r.vec_id, r.component) for r in got) == sorted([(False, 1, 1), (False, 1, 2), (False, 2, 1), (False, 2, 1), (False, 2, 2), (False, 2, 2), (True, None, 1), (True, None, 2)], key=str)
    assert {r.n for r in got} == {4} and got[0].identity_error < 1e-9  # the constant third dimension gives no component
    x = [[whole(c) for c in v] for _, v, _ in rows[:4]]
    want = {sum((4 * a - b) ** 2 for a, b in zip(v, map(sum, zip(*x, strict=True)), strict=True)) for v in x}
    assert {r.deviation for r in got} == want


def test_whitening_without_spread_is_empty(spark, tmp_path):
    assert small(spark, tmp_path, []) == []
    assert small(spark, tmp_path, [(1, [0.5, 0.5], 0)]) == []
    assert small(spark, tmp_path, [(i, [0.5, 0.5], 0) for i in range(9)]) == []


def test_deviations_stay_exact_beyond_64_bits():
    x = np.array([[2**40, 1], [0, 3]], np.int64)
    assert op11.deviations(x, 2, (2**40, 4)) == [None, None]
    big = np.array([[3 * 10**9, 0], [0, 0]], np.int64)
    assert op11.deviations(big, 2, (3 * 10**9, 0)) == [9 * 10**18, 9 * 10**18]


# --- repair ----------------------------------------------------------------------------------------------------

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
TALKS = "conv_id long, turn long, role string, text string, audit string"


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        text, role_ = (" " if text is None else text), (" " if role is None else role)
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        role_ = "user" if f == 4 else role_
        out += [(conv, turn, role_, text)] * (2 if f == 3 else 1)
    return out


def search(rows):
    """Cost, audit and repaired rows by a search over edit scripts, cheapest first, then in ASCII order. rows: role, text, fault."""
    heap, n = [(0, "", 0, ())], len(rows)
    done = set()
    while True:
        cost, audit, i, made = heapq.heappop(heap)
        roles = "".join(r[:1] for r, _ in made)
        if i == n and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, made
        if (i, roles) in done:
            continue
        done.add((i, roles))
        options = [("I", INSERT, i, (who, "")) for who in ("user", "assistant")]
        if i < n:
            role, text, fault = rows[i]
            options.append(("D", 4, i + 1, None))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                options += [("K", more, i + 1, (role, text)), *(("R", 3 + more, i + 1, (who, text)) for who in ("user", "assistant"))]
        for letter, price, at, row in options:
            then = made + ((row,) if row else ())
            if re.fullmatch("s?(ua)*u?", "".join(r[:1] for r, _ in then)) and all(r[:1] for r, _ in then) and len(then) <= 2 * n + 2:
                heapq.heappush(heap, (cost + price, audit + letter, at, then))


INSERT = 3


def expected(rows):
    by, all_ids = {}, {r[0] for r in rows}
    for r in damage(rows):
        by.setdefault(r[0], []).append(r)
    out = {}
    for conv in all_ids:
        mine = sorted(by.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            body = text.strip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in mine if r[1] is not None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, made = search([(r[2], r[3], f) for r, f in zip(mine, faults, strict=True)])
        text = "\n".join(f"{r}:{t}" for r, t in made)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def answer(df):
    got = df.collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r[0]: tuple(r[1:]) for r in got}


def talks(seed=5, n=60):
    r = random.Random(seed)
    texts = ["Hello.", "no end", "", " \t", "What?", "é!", None, "Hello. ", " ", "x" * 40 + "."]
    rows = []
    for conv in range(n):
        for _ in range(r.randint(1, 7)):
            rows.append((conv if conv else None, r.choice([None, *range(8)]), r.choice(["user", "assistant", "system", "tool", "", None, "u2"]), r.choice(texts), "other"))
    return rows


@pytest.mark.parametrize("how", [{}, {"long_rows": 2}, {"long_rows": 0, "long_bytes": 0}])
def test_repair_equals_a_search_over_edits(spark, how, monkeypatch):
    monkeypatch.setattr(op12, "CHUNK_ROWS", 2)
    rows = talks()
    assert answer(op12.repair(spark.createDataFrame(rows, TALKS).repartition(3), **how)) == expected(rows)


def test_repair_of_one_hot_conversation(spark, monkeypatch):
    """A third of all rows in one conversation, and a third of those equal: chunks give what one pass gives."""
    monkeypatch.setattr(op12, "CHUNK_ROWS", 7)
    r = random.Random(3)
    rows = [(7, t // 2, r.choice(["user", "assistant"]), "Same." if t % 3 == 0 else f"Text {t}{r.choice('.x')}", "") for t in range(300)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Hi {c}.", "") for c in range(100, 200) for t in range(6)]
    df = spark.createDataFrame(rows, TALKS).repartition(4)
    assert answer(op12.repair(df, long_rows=50)) == answer(op12.repair(df))


def test_repair_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answer(op12.op12_repair(spark, SF)) == expected(rows)


def test_repair_of_empty_tables(spark):
    assert op12.repair(spark.createDataFrame([], TALKS)).collect() == []


def test_trie_shares_layers(monkeypatch):
    calls, step = [], op12.step
    monkeypatch.setattr(op12, "step", lambda layer, s: calls.append(s) or step(layer, s))
    found = dict(op12.solved(["suaua", "suau", "suaua", "sua", "d"], op12._first()))
    assert len(calls) == 6 and op12.cheapest(found["suaua"][0]) == (0, "KKKKK") and op12.cheapest(found["suau"][0]) == (3, "KKKKI")
