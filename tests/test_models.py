"""Searches by tiles, trained codecs, eigenvectors and the proximity graph, against numpy."""

import numpy as np
import pytest

from skein.functions import encode
from skein.operators import algebra, codec, fingerprints, graph, opq, phrases, quantise, scores, spectral, state, tiles
from skein.plans.registry import QUERIES

from .conftest import SF


@pytest.fixture(scope="module")
def vectors(spark):
    p = tiles.usable(fingerprints.vectors_of(spark, SF)).select("doc_id", "embedding").orderBy("doc_id").toPandas()
    return p["doc_id"].to_numpy(), np.array(p["embedding"].tolist(), np.float64)


def asked(ids):
    return np.flatnonzero(ids % fingerprints.EVERY == 0)


def exact(q, x, ids, q_ids, k=10):
    """Ids of the k nearest rows by squared distance, without the query itself; queries x k."""
    d = np.round(((q[:, None] - x[None]) ** 2).sum(axis=2), 6)
    d[q_ids[:, None] == ids] = np.inf
    return [ids[np.lexsort((ids, row))[:k]].tolist() for row in d]


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.doc_id))
    return {q: [d for _, d in sorted(v)] for q, v in out.items()}


def recall(got, want):
    return np.mean([len(set(got[q]) & set(w)) / len(w) for q, w in want.items()])


# --- tiles -----------------------------------------------------------------------------------------------------


def test_tiles_of_many_groups_equal_one_matrix(spark, monkeypatch):
    """Rows and queries in many groups, over many partitions that are not joined again: each group of queries meets each group of rows once."""
    monkeypatch.setattr(tiles, "GROUP", 40)
    monkeypatch.setattr(tiles, "PART_ROWS", 16)
    monkeypatch.setattr(tiles, "PART_QUERIES", 8)
    r = np.random.default_rng(1)
    x = r.integers(-3, 4, (500, 6)).astype(float)  # many ties
    ids = r.permutation(500)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "doc_id long, embedding array<double>").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        q = rows.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "q_id")
        got = found(tiles.nearest(rows, q, 10, tiles.l2_sq, True, True))
        far = found(tiles.nearest(rows, q, 7, tiles.dot, False))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    at = np.flatnonzero(ids % 3 == 0)
    assert got == dict(zip(ids[at].tolist(), exact(x[at], x, ids, ids[at]), strict=True))
    dots = x[at] @ x.T
    assert far == {int(ids[i]): ids[np.lexsort((ids, -dots[n]))[:7]].tolist() for n, i in enumerate(at)}


def test_tiles_leave_odd_rows_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (3, [1.0, 1.0]), (None, [1.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0, 2.0, 3.0])]
    v = tiles.usable(spark.createDataFrame(rows, "doc_id long, embedding array<float>"))
    assert sorted(r.doc_id for r in v.collect()) == [1, 2, 3, 3]
    got = tiles.nearest(v, v.where("doc_id = 1").withColumnRenamed("doc_id", "q_id"), 10, tiles.rounded(tiles.cosine), False).collect()
    assert [(r.rank, r.doc_id, round(r.score, 6)) for r in got] == [(1, 1, 1.0), (2, 3, 0.707107), (3, 2, 0.0), (4, 3, 0.0)]
    empty = v.where("false")
    assert tiles.nearest(empty, empty.withColumnRenamed("doc_id", "q_id"), 3, tiles.dot, False).collect() == []


@pytest.mark.parametrize("name", ["cosine", "dot", "l2_sq", "l1"])
def test_vector_scores(name):
    r = np.random.default_rng(3)
    q, x = r.normal(size=(5, 7)), r.normal(size=(11, 7))
    x[4] = 0
    want = {"cosine": lambda a, b: 0 if not b.any() else a @ b / np.sqrt((a @ a) * (b @ b)), "dot": lambda a, b: a @ b, "l2_sq": lambda a, b: ((a - b) ** 2).sum(), "l1": lambda a, b: np.abs(a - b).sum()}[name]
    assert np.allclose(getattr(tiles, name)(q, x), [[want(a, b) for b in x] for a in q])


def test_word_scores():
    r = np.random.default_rng(4)
    q, x = r.integers(-(2**63), 2**63, (4, 3)), r.integers(-(2**63), 2**63, (9, 3))
    x[2] = q[1] = 0
    bits = lambda m: np.unpackbits(m.astype(">i8").view(np.uint8).reshape(len(m), -1), axis=1).astype(int)
    a, b = bits(q), bits(x)
    assert (tiles.hamming(q, x) == (a[:, None] != b[None]).sum(axis=2)).all()
    both, size = a @ b.T, np.sqrt(np.outer(a.sum(axis=1), b.sum(axis=1)))
    sim = np.divide(both, size, out=np.zeros_like(size), where=size > 0)
    assert np.allclose(tiles.pap_similarity(q, x), sim)
    assert tiles.pap_distance(q, x)[1, 2] == 0 and tiles.pap_distance(q, x)[1, 0] == 1


# --- codec -----------------------------------------------------------------------------------------------------


def test_levels_are_a_fixed_point():
    """Each level is the weighted mean of the values that are nearest to it, and levels ascend."""
    r = np.random.default_rng(5)
    x, n = np.sort(r.normal(size=400)), r.integers(1, 9, 400)
    levels = codec.lloyd(x, n, 500)
    near = np.abs(x[:, None] - levels).argmin(axis=1)
    assert (np.diff(levels) > 0).all() and np.allclose(levels, [np.average(x[near == k], weights=n[near == k]) for k in range(codec.LEVELS)])


def test_codes_take_the_nearest_level(spark, vectors):
    ids, x = vectors
    made = codec.train(tiles.usable(fingerprints.vectors_of(spark, SF)).select("doc_id", "embedding"))
    want = np.abs((x - made.mean)[:, :, None] - made.levels[None]).argmin(axis=2)
    assert (made.encode(x) == want).all() and np.allclose(made.decode(want.astype(np.uint8)), made.mean + np.take_along_axis(made.levels[None], want[:, :, None], 2)[:, :, 0])


def test_codec_of_one_value_and_of_nothing(spark):
    rows = spark.createDataFrame([(i, [0.5, -1.0]) for i in range(5)], "doc_id long, embedding array<float>")
    made = codec.train(rows)
    assert np.allclose(made.decode(made.encode(np.array([[0.5, -1.0]]))), [[0.5, -1.0]]) and codec.train(rows.where("false")) is None


# --- opq -------------------------------------------------------------------------------------------------------


def test_opq_beats_plain_words_and_keeps_the_neighbours(spark, vectors):
    ids, x = vectors
    error = {r.method: r.error for r in opq.opq_error(spark, SF).collect()}
    assert error["opq"] < error["pq"]
    at = asked(ids)
    want = dict(zip(ids[at].tolist(), exact(x[at], x, ids, ids[at]), strict=True))
    assert recall(found(opq.opq_rerank_topk(spark, SF)), want) >= 0.95


def test_opq_turns_lower_the_error(spark):
    """Correlated components: every turn keeps the rotation orthonormal and lowers the error."""
    r = np.random.default_rng(7)
    x = r.normal(size=(600, 8)) @ r.normal(size=(8, 64)) + 0.05 * r.normal(size=(600, 64))
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "doc_id long, embedding array<double>")
    errors = []
    for turns in (0, 2, 5):
        made = opq.train(v, turns)
        assert np.allclose(made.turn.T @ made.turn, np.eye(64))
        y = x @ made.turn
        back = np.hstack([made.book[j][quantise.nearest_code(y[:, 4 * j : 4 * j + 4], made.book[j])] for j in range(16)])
        errors.append(((y - back) ** 2).sum())
    assert errors[0] > errors[1] > errors[2]


# --- spectral --------------------------------------------------------------------------------------------------


def test_axes_equal_numpy():
    r = np.random.default_rng(8)
    x = r.normal(size=(900, 40)) * np.linspace(3, 0.5, 40)
    m = x.T @ x / len(x)
    values, basis = spectral.axes(m, 12)
    want, vec = np.linalg.eigh(m)
    order = np.argsort(-want)[:12]
    assert np.allclose(values, want[order], rtol=1e-9) and np.abs(np.abs(basis) - np.abs(vec[:, order])).max() < 1e-6
    rank2 = spectral.axes(np.diag([4.0, 1.0, 0, 0]), 4)
    assert np.allclose(rank2[0], [4, 1]) and rank2[1].shape == (4, 2)


@pytest.mark.parametrize("kind", ["bits", "float"])
def test_spectral_search_equals_numpy(spark, vectors, kind):
    ids, x = vectors
    if kind == "bits":
        x = (x @ encode.projection(x.shape[1]) > 0).astype(float)
    m = x.T @ x / len(x)
    values, vec = np.linalg.eigh(m)
    assert np.allclose(spectral.axes(m)[0], values[::-1][:16], rtol=1e-8)
    at, y = asked(ids), x @ vec[:, ::-1][:, :16]
    want = exact(y[at], y, ids, ids[at])
    got = found((spectral.spectral_bits_topk if kind == "bits" else spectral.spectral_float_topk)(spark, SF))
    assert recall(got, dict(zip(ids[at].tolist(), want, strict=True))) > 0.999  # a tie at the sixth digit may fall either way


def test_spectral_of_nothing(spark):
    assert spectral.moments(spark.createDataFrame([], "doc_id long, embedding array<double>"), spectral.vectors_in) is None


# --- graph -----------------------------------------------------------------------------------------------------


def _bits(spark, vectors):
    ids, x = vectors
    return ids, (x @ encode.projection(x.shape[1]) > 0).astype(np.int32)


def test_graph_edges_and_beam(spark, vectors):
    ids, b = _bits(spark, vectors)
    d = b @ (1 - b).T
    d = d + d.T
    place = {int(i): n for n, i in enumerate(ids)}
    h, edges = graph.edges(spark, SF)
    rows = edges.collect()
    degree = {}
    for r in rows:
        assert r.a != r.b and d[place[r.a], place[r.b]] == r.d
        degree[r.a] = degree.get(r.a, 0) + 1
    assert max(degree.values()) <= graph.MOST and len(degree) == len(ids)
    at = asked(ids)
    np.fill_diagonal(d, 10_000)
    got = graph.beam(h, edges, fingerprints.asked(h), 10).collect()
    assert all(d[place[r.query_id], place[r.doc_id]] == r.score for r in got)
    tenth = {int(ids[i]): np.sort(d[i])[9] for i in at}  # equal distances count alike
    near = {q: 0 for q in tenth}
    for r in got:
        near[r.query_id] += r.score <= tenth[r.query_id]
    assert np.mean(list(near.values())) / 10 >= 0.9


def test_neighbour_exchange_finds_the_nearest(spark, vectors):
    ids, b = _bits(spark, vectors)
    d = b @ (1 - b).T
    d = d + d.T
    np.fill_diagonal(d, 10_000)
    from skein.sources import scratch

    h = scratch.staged(graph.words(spark, SF), "test-words")
    near = graph.neighbours(h, len(ids)).collect()
    cut = {int(i): np.sort(d[n])[graph.NEAR - 1] for n, i in enumerate(ids)}
    assert np.mean([r.d <= cut[r.a] for r in near]) >= 0.9 and len(near) == graph.NEAR * len(ids)


def test_graph_of_equal_rows_and_of_nothing(spark):
    """A fingerprint of all rows: buckets are split, and equal rows are pruned to one neighbour each way."""
    rows = [(i, *([7] * 8)) for i in range(700)] + [(1000, *([-1] * 8))]
    h = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{w} long" for w in encode.WORDS))
    links = graph.first_links(h, 701)
    assert links.groupBy("a").count().agg({"count": "max"}).first()[0] <= 8 * graph.AHEAD
    near = graph.measured(links, h).withColumnRenamed("d", "d")
    kept = graph.pruned(near, h).groupBy("a").count().collect()
    assert max(r["count"] for r in kept) <= 2
    none = h.where("false")
    assert graph.pruned(graph.neighbours(none, 0), none).collect() == []


def test_queries_of_many_groups_and_parts(spark, monkeypatch):
    """Queries are dealt to groups of their own bound, and fewer where many rows are handed on; found rows are thinned while they are many."""
    monkeypatch.setattr(tiles, "ASK", 7)
    monkeypatch.setattr(tiles, "PART_ROWS", 16)
    r = np.random.default_rng(2)
    x = r.integers(-3, 4, (300, 5)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    q = rows.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "q_id")
    at = np.arange(0, 300, 3)
    want = dict(zip(at.tolist(), exact(x[at], x, np.arange(300), at, 5), strict=True))
    assert found(tiles.nearest(rows, q, 5, tiles.l2_sq, True, True)) == want
    monkeypatch.setattr(tiles, "FOUND", 50)
    assert found(tiles.nearest(rows, q, 5, tiles.l2_sq, True, True)) == want


@pytest.mark.parametrize("name", ["rank_agreement", "poincare_topk", "beacon_cascade", "blend_topk", "grade_weighted_topk", "conformal_topk", "fused_integer_topk", "ternary_pap_topk", "multi_probe", "ternary_topk", "bucket_topk", "lattice_topk", "cell_topk", "distribution_distances", "similarity_catalogue"])
def test_searches_meet_in_tiles(spark, name):
    """No pair of a query and a row is a row of a join: both sides meet in groups of bounded size."""
    assert "FlatMapCoGroupsInArrow" in QUERIES[name][0](spark, SF)._jdf.queryExecution().toString()


def test_residue_agreement_gives_every_row_in_agreement(spark):
    h = algebra.words(spark, SF).orderBy("doc_id").toPandas()
    ids, octets = h["doc_id"].to_numpy(), h["h0"].to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
    fold = lambda row, b: sum(int(x) * b ** (7 - i) for i, x in enumerate(row)) % b
    c = {b: np.array([fold(r, b) for r in octets]) for b in algebra.BASES}
    near = lambda b, i: np.minimum(np.abs(c[b] - c[b][i]), b - np.abs(c[b] - c[b][i])) <= 1
    want = {(int(ids[i]), int(d)) for i in asked(ids) for d in ids[np.all([near(b, i) for b in algebra.BASES], axis=0)] if d != ids[i]}
    got = [(r.query_id, r.doc_id) for r in algebra.residue_agreement(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_product_searches_shuffle_vectors_and_codes(spark, monkeypatch):
    """A query goes to tiles as its vector, not as a table of distances to all words."""
    sides = []
    monkeypatch.setattr(tiles, "nearest", lambda rows, queries, *rest: sides.append((rows.dtypes, queries.dtypes)) or rows)
    book = np.zeros((2, 3, 1))
    v = spark.createDataFrame([(20, [1.0, 2.0])], "doc_id long, embedding array<float>")
    quantise.adc_topk(v, book, fingerprints.asked(v), 5)
    quantise.symmetric_topk(v, book, 5)
    codes = [("doc_id", "bigint"), ("codes", "array<int>")]
    assert sides == [(codes, [("q_id", "bigint"), ("q_embedding", "array<float>")]), (codes, [("q_id", "bigint"), ("q_codes", "array<int>")])]


def test_graph_joins_are_shuffled(spark, monkeypatch):
    """No side that grows with the rows is collected on the driver to be broadcast."""
    plans = []
    keep = graph.scratch.staged
    monkeypatch.setattr(graph.scratch, "staged", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or keep(df, label))
    graph.neighbours(keep(graph.words(spark, SF), "graph-words"), 200, 1)
    assert len(plans) == 2 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for _, p in plans)


def test_pairs_of_a_bucket_meet_in_parts(spark, monkeypatch):
    b = spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'signup'").select("user_id").distinct().toPandas()["user_id"].tolist()
    monkeypatch.setattr(state, "USERS", 1)
    got = [tuple(r) for r in state.same_bucket_pairs(spark, SF).collect()]
    want = {(x % 25, x, y) for x in b for y in b if x < y and x % 25 == y % 25}
    assert len(got) == len(want) and set(got) == want


def test_field_search_counts_only_wanted_terms(spark, monkeypatch):
    plans = []
    keep = phrases.scratch.staged
    monkeypatch.setattr(phrases.scratch, "staged", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, label))
    phrases.field_topk(spark, SF)
    assert len(plans) == 1 and "sort_array" not in plans[0]


def test_all_pairs_in_many_tiles_and_blocks(spark, monkeypatch):
    """Every pair once, its values in the stated order within a block; rows are not shuffled once for every few queries."""
    for name, n in {"PAIR_ROWS": 70, "PAIR_ASKS": 30, "PART_ROWS": 32, "PAIRS": 400, "HANDED": 90, "PART_QUERIES": 8, "LEAST": 1000}.items():
        monkeypatch.setattr(tiles, name, n)
    r = np.random.default_rng(8)
    x = r.integers(-3, 4, (300, 5)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    q = rows.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "q_id")
    measure = lambda a, b: {"dot": a @ b.T, "gap": np.abs(a[:, None] - b).sum(axis=2)}
    got = tiles.all_pairs(rows, q, {"dot": "double", "gap": "double"}, measure, by="dot").collect()
    want = {(a, b): (x[a] @ x[b], np.abs(x[a] - x[b]).sum()) for a in range(0, 300, 3) for b in range(300)}
    assert len(got) == len(want) and {(g.query_id, g.doc_id): (g.dot, g.gap) for g in got} == want
    near = tiles.all_pairs(rows, q, {"dot": "double", "gap": "double"}, measure, lambda a, b, m: (m["gap"] < 6) & (a != b)).collect()
    assert {(g.query_id, g.doc_id) for g in near} == {k for k, v in want.items() if v[1] < 6 and k[0] != k[1]} and len(near) == len({(g.query_id, g.doc_id) for g in near})


@pytest.mark.parametrize("name", ["distribution_distances", "similarity_catalogue"])
def test_pairs_shuffle_sides_and_not_copies(spark, monkeypatch, name):
    """A tile's size is not bound by the pairs that it hands on: at 1 GB (102,564 rows, 5,129 queries) a row is shuffled once, a query a few dozen times."""
    asked_for = []
    keep = tiles.met
    monkeypatch.setattr(tiles, "met", lambda rows, queries, groups, asks, *rest: asked_for.append((groups, asks)) or keep(rows, queries, groups, asks, *rest))
    counts = iter([102_564, 5_129])
    v = tiles.usable(fingerprints.vectors_of(spark, SF).select("doc_id", "embedding"))
    monkeypatch.setattr(type(v), "count", lambda df: next(counts))
    getattr(scores, name)(spark, SF)
    assert asked_for[0][1] == 1 and asked_for[0][0] <= 36


def test_pairs_of_a_block_lie_by_value(spark, monkeypatch):
    """So equal values lie together in files."""
    monkeypatch.setattr(tiles, "LEAST", 10_000)
    dots = [r.dot_product for r in scores.similarity_catalogue(spark, SF).collect()]
    near = [r.affinity for r in scores.distribution_distances(spark, SF).collect()]
    assert near == sorted(near) and dots == sorted(dots, key=abs)


def test_distances_of_shares_that_are_zero():
    """No share at all in one or both of two vectors adds nothing that is not a number; a zero vector has no distances."""
    got = {}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(scores, "pairs", lambda spark, sf_dir, names, measure, by: got.update(measure=measure))
        scores.distribution_distances(None, None)
    q = np.array([[1.0, 0, 0, 0], [0.6, 0.8, 0, 0], [0.0, 0, 0, 0]])
    out = got["measure"](q, q)
    a, b = np.array([1, 0]), np.array([0.36, 0.64])
    js = (np.log2(2 / 1.36) + 0.36 * np.log2(0.72 / 1.36) + 0.64 * np.log2(2)) / 2
    assert np.allclose(out["jensen_shannon"][:2, :2], [[0, js], [js, 0]], atol=1e-6) and np.allclose(out["chi_square"][0, 1], ((a - b) ** 2 / (a + b)).sum(), atol=1e-6)
    assert np.isnan(out["jensen_shannon"][2]).all() and np.isnan(out["chi_square"][:, 2]).all()


def test_exchange_offers_only_what_can_be_a_neighbour(spark, monkeypatch):
    """Links of links are measured where they meet; those that are farther than the last neighbour so far go before they are shuffled."""
    monkeypatch.setattr(graph, "NEAR", 4)
    monkeypatch.setattr(graph, "LINKS", 6)
    r = np.random.default_rng(12)
    w = r.integers(-(2**63), 2**63 - 1, (80, 8))
    d = np.bitwise_count((w[:, None] ^ w[None]).view(np.uint64)).sum(axis=2).astype(int)
    h = spark.createDataFrame([(i, *row) for i, row in enumerate(w.tolist())], "doc_id long, " + ", ".join(f"{x} long" for x in encode.WORDS))
    near = {a: sorted((int(d[a, b]), int(b)) for b in r.choice([i for i in range(80) if i != a], 2 if a % 7 == 0 else 4, False)) for a in range(80)}
    rows = [(a, n + 1, b, x) for a, links in near.items() for n, (x, b) in enumerate(links)]
    both = {(a, b) for a, _, b, _ in rows} | {(b, a) for a, _, b, _ in rows}
    linked = {a: [b for _, b in sorted((int(d[a, b]), b) for x, b in both if x == a)[:6]] for a in range(80)}
    may = lambda a, c: len(near[a]) < 4 or (int(d[a, c]), c) <= near[a][-1]
    want = {(a, c, int(d[a, c])) for a in range(80) for b in linked[a] for c in linked[b] if c != a and may(a, c)}
    got = {tuple(x) for x in graph.offered(spark.createDataFrame(rows, "a long, rank int, b long, d long"), h).collect()}
    known = {(a, b, x) for a, _, b, x in rows}
    assert got - known == want - known and len(want - known) > 20


def test_beam_keeps_its_best_alone(spark, monkeypatch):
    """A query's state does not grow with the rows that it has met."""
    states = []
    keep = graph.scratch.staged
    h, edges = graph.edges(spark, SF)
    monkeypatch.setattr(graph.scratch, "staged", lambda df, label: states.append(keep(df, label)) or states[-1] if label == "beam" else keep(df, label))
    graph.beam(h, edges, fingerprints.asked(h).limit(5), 5, size=12, width=4, rounds=3)
    assert len(states) == 4 and all(max(r["count"] for r in s.groupBy("q_id").count().collect()) <= 12 for s in states)


def test_pruning_of_many_rows_at_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "PRUNED", 100)
    r = np.random.default_rng(13)
    w = r.integers(-(2**63), 2**63 - 1, (40, 8))
    w[20:] = w[:20] ^ (1 << r.integers(0, 60, (20, 8)))  # near ones
    w[39] = w[38]
    d = np.bitwise_count((w[:, None] ^ w[None]).view(np.uint64)).sum(axis=2).astype(int)
    h = spark.createDataFrame([(i, *row) for i, row in enumerate(w.tolist())], "doc_id long, " + ", ".join(f"{x} long" for x in encode.WORDS))
    rows, want = [], set()
    for a in range(40):
        own = sorted((int(d[a, b]), int(b)) for b in r.choice([i for i in range(40) if i != a], a % 9 + 1, False))
        rows += [(a, n + 1, b, x) for n, (x, b) in enumerate(own)]
        kept = []
        for x, b in own:
            if len(own) <= 2 or not any(d[b, p] < (x or 1) for _, p in kept):
                kept.append((x, b))
        want |= {(a, b, x) for x, b in kept}
    assert {tuple(x) for x in graph.pruned(spark.createDataFrame(rows, "a long, rank int, b long, d long"), h).collect()} == want
