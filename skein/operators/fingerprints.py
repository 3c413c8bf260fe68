"""Search over 512-bit fingerprints of embeddings, their algebra, and fusion of rankings.

The stated queries are the rows whose id is divisible by 20; every row is a candidate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, encode, vectors
from ..sources.tables import table
from . import tiles
from .topk import asked_in_blocks, topk

W = encode.WORDS
QW = [f"q_{w}" for w in W]
#: Candidates that the coarse stages hand on.
POOL, PREFIX_POOL, EVERY = 200, 400, 20


def cols(names):
    return [F.col(n) for n in names]


def vectors_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", "embedding")


def hashed(spark, sf_dir) -> DataFrame:
    """doc_id, label, embedding and the eight words."""
    return encode.encoded(vectors_of(spark, sf_dir))


def asked(h: DataFrame) -> DataFrame:
    return h.where(F.col("doc_id") % EVERY == 0).select(*(F.col(c).alias(f"q_{c}" if c != "doc_id" else "q_id") for c in h.columns))


def search(score, k, ascending, exclude_self=False, words=True, whole=False):
    """The k best rows of every stated query by a score of tiles.py, of words or of vectors; whole: the score is a whole number."""

    def run(spark, sf_dir):
        v = tiles.usable(vectors_of(spark, sf_dir).select("doc_id", "embedding"))
        side = (lambda df: tiles.word_columns(encode.encoded(df))) if words else (lambda df: df)
        out = tiles.nearest(side(v), side(v.where(F.col("doc_id") % EVERY == 0)), k, score, ascending, exclude_self, vectors_of(spark, sf_dir).count())
        return out.withColumn("score", F.col("score").cast("long")) if whole else out

    return run


def sides(near, rows):
    """near's query_id and doc_id with the columns of rows for both: plain and q_*."""
    near = near.select(F.col("query_id").alias("q_id"), "doc_id").distinct()
    return near.join(rows, "doc_id").join(asked(rows), "q_id")


def _round(x):
    return F.round(x, 6)


def ham():
    return bits.hamming(cols(QW), cols(W))


def pap():
    return _round(bits.pap_sim(cols(QW), cols(W)))


def dot():
    return _round(vectors.dot(F.col("q_embedding"), F.col("embedding")))


cosine_topk = search(tiles.rounded(tiles.cosine), 10, False, words=False)
dot_topk = search(tiles.rounded(tiles.dot), 10, False, True, words=False)
l2_topk = search(tiles.rounded(tiles.l2_sq), 10, True, words=False)
l1_topk = search(tiles.rounded(tiles.l1), 10, True, words=False)
hamming_topk = search(tiles.hamming, 10, True, whole=True)
hamming_topk_exclude_self = search(tiles.hamming, 10, True, True, whole=True)
hamming_score_topk = search(lambda q, x: 1 - tiles.hamming(q, x) / 512, 10, False)
hamming_128_topk = search(tiles.first_words(tiles.hamming), 10, True, whole=True)
pap_similarity_topk = search(tiles.rounded(tiles.pap_similarity), 10, False)
pap_similarity_128_topk = search(tiles.first_words(tiles.rounded(tiles.pap_similarity)), 10, False)
pap_distance_topk = search(tiles.rounded(tiles.pap_distance), 10, True)
direct_top1 = search(tiles.rounded(tiles.pap_similarity), 1, False)


def pairs(spark, sf_dir, embedding=True):
    """Every row with every stated query."""
    h = hashed(spark, sf_dir) if embedding else hashed(spark, sf_dir).drop("embedding")
    return asked_in_blocks(h, asked(h))


def _named(df):
    return df.select(F.col("q_id").alias("query_id"), "rank", "doc_id", "score")


def fingerprints(spark, sf_dir):
    return hashed(spark, sf_dir).select("doc_id", *W)


def itq_encode(spark, sf_dir):
    """Sign bits after the corpus mean is taken off; the mean is one number for each component."""
    v = vectors_of(spark, sf_dir)
    first = v.where("embedding is not null").select(F.size("embedding")).first()
    if first is None:
        return encode.encoded(v).select("doc_id", *W)
    dim = first[0]
    mean = v.agg(F.array(*(F.round(F.avg(F.get("embedding", F.lit(i)).cast("double")), 9) for i in range(dim)))).first()[0]
    import numpy as np

    return encode.encoded(v, (np.array(mean), encode.projection(dim)), at_zero=True).select("doc_id", *W)


def prefix_filter_topk(spark, sf_dir):
    """The nearest by the first 128 bits, then the 10 nearest of them by all."""
    near = search(tiles.first_words(tiles.hamming), PREFIX_POOL, True)(spark, sf_dir)
    return _named(topk(sides(near, hashed(spark, sf_dir).select("doc_id", *W)).withColumn("score", ham()), 10, ["q_id"], [F.asc("score"), F.asc("doc_id")]))


def rerank(spark, sf_dir, pool=POOL, k=10):
    """The pool of nearest fingerprints, re-scored by dot product."""
    near = search(tiles.hamming, pool, True, True)(spark, sf_dir)
    return _named(topk(sides(near, vectors_of(spark, sf_dir)).withColumn("score", dot()), k, ["q_id"], [F.desc("score"), F.asc("doc_id")]))


def cosine_rerank(spark, sf_dir):
    """The two-tier form: 100 by Hamming, self included, the 10 best of them by cosine."""
    near = search(tiles.hamming, 100, True)(spark, sf_dir)
    s = sides(near, vectors_of(spark, sf_dir)).withColumn("score", _round(vectors.cosine(F.col("q_embedding"), F.col("embedding"))))
    return _named(topk(s, 10, ["q_id"], [F.desc("score"), F.asc("doc_id")]))


def three_stage(spark, sf_dir):
    """First 128 bits, then all, then squared distance: each stage scores what the one before left."""
    a = search(tiles.first_words(tiles.hamming), PREFIX_POOL, True, True)(spark, sf_dir)
    b = topk(sides(a, hashed(spark, sf_dir).drop("label")).withColumn("fine", ham()), POOL, ["q_id"], [F.asc("fine"), F.asc("doc_id")], "r")
    return _named(topk(b.withColumn("score", _round(vectors.l2_sq(F.col("q_embedding"), F.col("embedding")))), 10, ["q_id"], [F.asc("score"), F.asc("doc_id")]))


def unified_bypass(spark, sf_dir):
    """Queries of an even tenth are answered by fingerprints alone; the rest are re-scored by dot product, where id 0 counts as missing."""
    near = search(tiles.hamming, POOL, True)(spark, sf_dir)
    h = near.select(F.col("query_id").alias("q_id"), "doc_id", F.col("score").alias("h")).distinct()
    bypass = F.col("q_id") % (2 * EVERY) == 0
    s = sides(near, vectors_of(spark, sf_dir)).join(h, ["q_id", "doc_id"]).where(bypass | (F.col("doc_id") != 0)).withColumn("score", F.when(bypass, 1 - F.col("h") / 512.0).otherwise(dot()))
    return _named(topk(s, 10, ["q_id"], [F.desc("score"), F.asc("doc_id")]))


def two_tier_recall(spark, sf_dir):
    """How many of the exact top 10 the re-ranked pool holds."""
    exact, got = dot_topk(spark, sf_dir), rerank(spark, sf_dir).select("query_id", "doc_id", F.lit(1).alias("hit"))
    return exact.join(got, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.sum(F.coalesce("hit", F.lit(0))).cast("long").alias("found"))


def hit_rate(spark, sf_dir):
    """Share of queries whose nearest by dot product is among the first 1, 5 and 10 by fingerprint."""
    best = dot_topk(spark, sf_dir).where("rank = 1").select("query_id", F.col("doc_id").alias("target"))
    r = best.join(hamming_topk_exclude_self(spark, sf_dir), "query_id").groupBy("query_id").agg(F.min(F.when(F.col("doc_id") == F.col("target"), F.col("rank"))).alias("at"))
    return r.agg(*(_round(F.avg(F.when(F.col("at") <= k, 1.0).otherwise(0.0))).alias(f"r{k}") for k in (1, 5, 10)))


def bucket(n: int, word: str = "h0"):
    """The first n bits."""
    return F.shiftrightunsigned(F.col(word), 64 - n)


def _prefix(words: np.ndarray, n: int) -> np.ndarray:
    """The first n bits of rows of words."""
    return np.ascontiguousarray(words[:, 0]).view(np.uint64) >> np.uint64(64 - n)


def bucketed(spark, sf_dir, n=4):
    return hashed(spark, sf_dir).withColumn("bucket", bucket(n))


def bucket_topk(spark, sf_dir):
    """Nearest within the query's own bucket of the first 4 bits."""
    return search(lambda q, x: np.where(_prefix(q, 4)[:, None] == _prefix(x, 4), tiles.hamming(q, x), np.inf), 10, True, whole=True)(spark, sf_dir)


def bucket_sizes(spark, sf_dir):
    return bucketed(spark, sf_dir).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def bucket_fast_path(spark, sf_dir):
    """Answers from the query's bucket of 6 bits, if it holds 64 rows or fewer."""
    h = bucketed(spark, sf_dir, 6).drop("embedding")
    small = h.groupBy("bucket").count().where("count <= 64").select("bucket")
    p = h.join(small, "bucket", "left_semi").join(asked(h), F.col("bucket") == F.col("q_bucket")).withColumn("score", _round(bits.pap_sim(cols(QW[:2]), cols(W[:2]))))
    return _named(topk(p, 10, ["q_id"], [F.desc("score"), F.asc("doc_id")]))


def exact_lookup(spark, sf_dir):
    """Rows with the query's very fingerprint, by an equi-join on all words."""
    h = hashed(spark, sf_dir).select("doc_id", *W)
    return h.join(asked(h), [F.col(a) == F.col(b) for a, b in zip(W, QW, strict=True)]).select(F.col("q_id").alias("query_id"), "doc_id")


def prefix_exact(spark, sf_dir):
    """The first row with the query's first 64 bits."""
    h = hashed(spark, sf_dir).select("doc_id", "h0")
    return h.groupBy("h0").agg(F.min("doc_id").alias("doc_id")).join(asked(h), F.col("h0") == F.col("q_h0")).select(F.col("q_id").alias("query_id"), "doc_id")


def bucket_exact(spark, sf_dir):
    """At most 5 rows of the query's bucket of 16 bits that equal it in 128."""
    h = bucketed(spark, sf_dir, 16).select("doc_id", "bucket", "h0", "h1")
    p = h.join(asked(h), (F.col("bucket") == F.col("q_bucket")) & (F.col("h0") == F.col("q_h0")) & (F.col("h1") == F.col("q_h1")))
    return topk(p.select(F.col("q_id").alias("query_id"), "doc_id"), 5, ["query_id"], [F.asc("doc_id")])


def hybrid_topk(spark, sf_dir):
    """The pool by 128-bit similarity, re-scored by 512-bit similarity."""
    near = search(tiles.first_words(tiles.rounded(tiles.pap_similarity)), POOL, False)(spark, sf_dir)
    return _named(topk(sides(near, hashed(spark, sf_dir).select("doc_id", *W)).withColumn("score", pap()), 10, ["q_id"], [F.desc("score"), F.asc("doc_id")]))


def auto_merge(spark, sf_dir):
    """Union of the 10 best by 128 and by 512 bits, the better score of each document, the 10 best of all."""
    a, b = pap_similarity_128_topk(spark, sf_dir), pap_similarity_topk(spark, sf_dir)
    best = a.select("query_id", "doc_id", "score").unionByName(b.select("query_id", "doc_id", "score")).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return topk(best, 10, ["query_id"], [F.desc("score"), F.asc("doc_id")])


def hinted_search(spark, sf_dir):
    """Exact rows of the bucket if it has any but the query itself, else the 10 best."""
    hint = bucket_exact(spark, sf_dir).where("query_id <> doc_id").select("query_id", "doc_id", F.lit(1.0).alias("score"))
    rest = hybrid_topk(spark, sf_dir).join(hint.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "doc_id", "score")
    return hint.unionByName(rest)


def multi_probe(spark, sf_dir):
    """Rows in the query's bucket of 6 bits or in one that differs in one bit, the 10 nearest."""
    return search(lambda q, x: np.where(np.bitwise_count(_prefix(q, 6)[:, None] ^ _prefix(x, 6)) <= 1, tiles.hamming(q, x), np.inf), 10, True, whole=True)(spark, sf_dir)


def multi_index(spark, sf_dir):
    """The 20 nearest by each of three ranges of words, united; the 10 nearest of them by all bits."""
    ranges = [lambda q, x, a=a, b=b: tiles.hamming(q[:, a:b], x[:, a:b]) for a, b in ((0, 3), (3, 6), (6, 8))]
    near = [search(score, 20, True)(spark, sf_dir) for score in ranges]
    s = sides(near[0].unionByName(near[1]).unionByName(near[2]), hashed(spark, sf_dir).select("doc_id", *W)).withColumn("score", ham())
    return _named(topk(s, 10, ["q_id"], [F.asc("score"), F.asc("doc_id")]))


def graph_diffusion(spark, sf_dir):
    """The 5 nearest and the 5 nearest of each of those: candidates, the 10 best by similarity."""
    words = tiles.word_columns(encode.encoded(tiles.usable(vectors_of(spark, sf_dir).select("doc_id", "embedding"))))
    near = hamming_5(spark, sf_dir).select("query_id", F.col("doc_id").alias("seed"))
    again = tiles.nearest(words, words.join(near.select(F.col("seed").alias("doc_id")).distinct(), "doc_id", "left_semi"), 5, tiles.hamming, True, True)
    hops = near.join(again.select(F.col("query_id").alias("seed"), "doc_id"), "seed").select("query_id", "doc_id")
    c = near.select("query_id", F.col("seed").alias("doc_id")).unionByName(hops).where("query_id <> doc_id")
    return _named(topk(sides(c, words).withColumn("score", pap()), 10, ["q_id"], [F.desc("score"), F.asc("doc_id")]))


hamming_5 = search(tiles.hamming, 5, True, True)


def bit_meet_join(spark, sf_dir):
    """Meet and join of each label, the share of its smallest member that the meet keeps, and the share of the join that its largest covers."""
    h = hashed(spark, sf_dir).withColumn("n", bits.popcount(cols(W)))
    a = h.groupBy("label").agg(*(F.expr(f"{f}({w})").alias(f"{n}_{w}") for f, n in (("bit_and", "meet"), ("bit_or", "join")) for w in W), F.min("n").alias("least"), F.max("n").alias("most"))
    meet, join = (bits.popcount(cols([f"{n}_{w}" for w in W])) for n in ("meet", "join"))
    share = lambda x, y: _round(F.when(y == 0, F.lit(1.0)).otherwise(x / y))
    return a.select("label", "meet_h0", "join_h0", meet.alias("meet_bits"), join.alias("join_bits"), share(meet, F.col("least")).alias("consensus"), share(F.col("most"), join).alias("coverage"))


def xor_wave(spark, sf_dir):
    return hashed(spark, sf_dir).groupBy("label").agg(*(F.expr(f"bit_xor({w})").alias(f"wave_{w}") for w in W))


def bit_counters(spark, sf_dir):
    """Per bit of a label's fingerprints the sum of +1 and -1, and the majority: 512 numbers a label."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(511)))
    word = F.get(F.array(*cols(W)), F.floor(F.col("bit") / 64).cast("int"))
    h = hashed(spark, sf_dir).select("label", *W, bit.alias("bit")).select("label", "bit", F.getbit(word, 63 - F.col("bit") % 64).cast("int").alias("one"))
    return h.groupBy("label", "bit").agg(F.sum(2 * F.col("one") - 1).cast("long").alias("counter")).withColumn("majority", F.col("counter") > 0)


def bridge_best(spark, sf_dir):
    """For each stated query and the next one, the row that is near both and equally so: least min(da, db) + |da - db| of pap() distances."""
    h = hashed(spark, sf_dir).select("doc_id", *W).where("h0 is not null")
    q = asked(h)
    pair = q.join(q.select((F.col("q_id") - EVERY).alias("q_id"), *(F.col(w).alias(f"n_{w}") for w in QW)), "q_id")

    def score(q, x):
        a, b = tiles.pap_distance(q[:, :8], x), tiles.pap_distance(q[:, 8:], x)
        return np.round(np.minimum(a, b) + np.abs(a - b), 6)

    # the next query's own row is left out as well: of the two best at least one is another
    near = tiles.nearest(h, pair, 2, score, True, True, vectors_of(spark, sf_dir).count()).where(f"doc_id <> query_id + {EVERY}").drop("rank")
    return topk(near, 1, ["query_id"], [F.asc("score"), F.asc("doc_id")]).select("query_id", "doc_id", "score")


def gap_best(spark, sf_dir):
    """The row with the largest product of its pap() distances to the query and to the query's complement."""
    return search(lambda q, x: np.round(tiles.pap_distance(q, x) * tiles.pap_distance(~q, x), 6), 1, False)(spark, sf_dir).select("query_id", "doc_id", "score")


def wedge(a, b):
    """(Hamming - shared bits) over the larger count, held within -1 and 1; 0 for equal or empty sides."""
    most = F.greatest(bits.popcount(a), bits.popcount(b))
    raw = (bits.hamming(a, b) - bits.both(a, b)) / most
    return F.when((bits.hamming(a, b) == 0) | (most == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def wedge_novelty(spark, sf_dir):
    """The most novel row of each query, if any is novel at all."""
    return search(lambda q, x: np.round(np.maximum(0, tiles.wedge(q, x)), 6), 1, False)(spark, sf_dir).where("score > 0").select("query_id", "doc_id", "score")


def gap_bonus(spark, sf_dir):
    """The 11 nearest by similarity, each with its lead over the next added (half of it after the first, none for the last); the 10 best."""
    w = Window.partitionBy("query_id").orderBy("rank")
    r = search(tiles.rounded(tiles.pap_similarity), 11, False, True)(spark, sf_dir).withColumn("next", F.lead("score").over(w))
    lead = F.greatest(F.col("score") - F.col("next"), F.lit(0.0))
    s = r.select("query_id", "doc_id", _round(F.col("score") + F.coalesce(F.when(F.col("rank") == 1, lead).otherwise(lead / 2), F.lit(0.0))).alias("score"))
    return topk(s, 10, ["query_id"], [F.desc("score"), F.asc("doc_id")])


def confidence_band():
    """0.98, 0.85 or 0.55 by the ratio of the best two scores; 0.4 without two or a positive one."""
    ratio = F.col("score") / (F.col("next") + 1e-6)
    return F.when(F.col("next").isNull() | (F.col("score") <= 0), 0.4).when(ratio > 1.5, 0.98).when(ratio > 1.2, 0.85).otherwise(0.55)


def ratio_confidence(spark, sf_dir):
    w = Window.partitionBy("query_id").orderBy("rank")
    r = dot_topk(spark, sf_dir).withColumn("next", F.lead("score").over(w)).where("rank = 1")
    return r.select("query_id", "score", confidence_band().alias("confidence"))


STAGES = {"hash": 0.20, "spectral": 0.25, "wedge": 0.25, "hologram": 0.30}  # fixed values


def consensus_fusion(spark, sf_dir):
    """Four rankings fused: score times weight over 1 + position, over the sum of weights, raised by a tenth for each list that holds the row; the 5 best.

    The lists are the 10 best by similarity, by 1 / (1 + distance), by similarity with the gap bonus, and the latter's first 5."""
    bonus = gap_bonus(spark, sf_dir)
    near = search(lambda q, x: np.round(1 / (1 + np.sqrt(tiles.l2_sq(q, x))), 6), 10, False, True, words=False)(spark, sf_dir)
    lists = {"hash": search(tiles.rounded(tiles.pap_similarity), 10, False, True)(spark, sf_dir), "spectral": near, "wedge": bonus, "hologram": bonus.where("rank <= 5")}
    rows = None
    for name, df in lists.items():
        part = df.select("query_id", "doc_id", (F.col("score") * STAGES[name] / F.col("rank")).alias("part"))  # rank is 1 + position
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "doc_id").agg(_round(F.sum("part") / sum(STAGES.values()) * (1 + 0.1 * F.count(F.lit(1)))).alias("score"), F.count(F.lit(1)).alias("hits"))
    return topk(fused, 5, ["query_id"], [F.desc("score"), F.asc("doc_id")])


def centroid_by_label(spark, sf_dir):
    """Mean vector of each label, scaled to unit length."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    m = e.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    norm = m.groupBy("label").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"))
    return m.join(norm, "label").select("label", "dim", _round("mean").alias("mean"), _round(F.col("mean") / F.col("norm")).alias("unit"))


def label_counts_rollup(spark, sf_dir):
    h = hashed(spark, sf_dir)
    return h.rollup("label", bucket(2).alias("cell")).agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("label", F.lit(-1)).cast("long").alias("label"), F.coalesce("cell", F.lit(-1)).cast("long").alias("cell"), "n")


HASHED = f"{encode.SQL}, q AS (SELECT doc_id AS q_id, label AS q_label, embedding AS q_embedding, b AS q_b, {', '.join(f'{w} AS q_{w}' for w in W)} FROM h WHERE doc_id % {EVERY} = 0)"


def _ham(a, b):
    return "(0::BIGINT + " + " + ".join(f"bit_count(xor({x}, {y}))" for x, y in zip(a, b, strict=True)) + ")::BIGINT"


def _pop(a):
    return "(0::BIGINT + " + " + ".join(f"bit_count({x})" for x in a) + ")::BIGINT"


def _both(a, b):
    return "(0::BIGINT + " + " + ".join(f"bit_count({x} & {y})" for x, y in zip(a, b, strict=True)) + ")::BIGINT"


def sql_pap(a, b):
    return f"CASE WHEN {_pop(a)} * {_pop(b)} = 0 THEN 0.0::DOUBLE ELSE {_both(a, b)} / sqrt(({_pop(a)} * {_pop(b)})::DOUBLE) END"


def sql_pap_dist(a, b):
    return f"CASE WHEN {_pop(a)} = 0 AND {_pop(b)} = 0 THEN 0.0::DOUBLE ELSE 1 - ({sql_pap(a, b)}) END"


def sql_top(score, order, k=10, where="true", name="s", source="h, q"):
    return f"{name} AS (SELECT q_id AS query_id, doc_id, {score} AS score, row_number() OVER (PARTITION BY q_id ORDER BY {score} {order}, doc_id)::INT AS rank FROM {source} WHERE {where} QUALIFY rank <= {k})"


def sql_one(score, order, k=10, where="true", source="h, q"):
    return f"WITH {HASHED}, {sql_top(score, order, k, where, 's', source)} SELECT query_id, rank, doc_id, score FROM s"


def sql_near(score, order, k, source="h, q", where="true"):
    """Rows of h and q, the k first of each query by a coarse score."""
    return f"(SELECT * FROM {source} WHERE {where} QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY {score} {order}, doc_id) <= {k})"


SHAM, SHAM2 = _ham(W, QW), _ham(W[:2], QW[:2])
SPAP, SPAP2 = f"round({sql_pap(W, QW)}, 6)", f"round({sql_pap(W[:2], QW[:2])}, 6)"
SDOT = "round(list_dot_product(embedding::DOUBLE[], q_embedding::DOUBLE[]), 6)"
SCOS = "round(list_dot_product(embedding::DOUBLE[], q_embedding::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q_embedding::DOUBLE[], q_embedding::DOUBLE[]))), 6)"
SL2 = "list_sum(list_transform(list_zip(embedding, q_embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
OTHERS = "q_id <> doc_id"


def sql_bucket(n, word="h0"):
    return f"(({word} >> {64 - n}) & {(1 << n) - 1})"


SWEDGE = f"CASE WHEN {SHAM} = 0 OR greatest({_pop(W)}, {_pop(QW)}) = 0 THEN 0.0::DOUBLE ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({SHAM} - {_both(W, QW)}) / greatest({_pop(W)}, {_pop(QW)})::DOUBLE)) END"
BONUS = f"{sql_top(SPAP, 'DESC', 11, OTHERS, 'n11')}, l11 AS (SELECT *, greatest(score - lead(score) OVER (PARTITION BY query_id ORDER BY rank), 0) AS lead FROM n11), bonus AS (SELECT query_id, doc_id, round(score + coalesce(CASE WHEN rank = 1 THEN lead ELSE lead / 2 END, 0), 6) AS score FROM l11), b10 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM bonus QUALIFY rank <= 10)"
PROBES = ", ".join(str(1 << i) for i in range(6))
QUERIES = {
    "fingerprints": (fingerprints, f"WITH {HASHED} SELECT doc_id, {', '.join(W)} FROM h"),
    "itq_encode": (itq_encode, f"WITH {encode.PROJECTION_SQL}, m AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, round(avg(x), 9) AS m FROM (SELECT unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY i)), z AS (SELECT vec_id AS doc_id, list((list_dot_product(list_transform(list_zip(embedding, m), lambda t: t[1]::DOUBLE - t[2]), v) >= 0)::INT ORDER BY j) AS bits FROM embeddings, m, proj GROUP BY vec_id) SELECT doc_id, {encode.sql_words()} FROM z"),
    "cosine_topk": (cosine_topk, sql_one(SCOS, "DESC")),
    "dot_topk": (dot_topk, sql_one(SDOT, "DESC", where=OTHERS)),
    "l2_topk": (l2_topk, sql_one(f"round({SL2}, 6)", "ASC")),
    "l1_topk": (l1_topk, sql_one("round(list_sum(list_transform(list_zip(embedding, q_embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))), 6)", "ASC")),
    "hamming_topk": (hamming_topk, sql_one(SHAM, "ASC")),
    "hamming_topk_exclude_self": (hamming_topk_exclude_self, sql_one(SHAM, "ASC", where=OTHERS)),
    "hamming_score_topk": (hamming_score_topk, sql_one(f"(1 - {SHAM} / 512.0::DOUBLE)", "DESC")),
    "hamming_128_topk": (hamming_128_topk, sql_one(SHAM2, "ASC")),
    "pap_similarity_topk": (pap_similarity_topk, sql_one(SPAP, "DESC")),
    "pap_similarity_128_topk": (pap_similarity_128_topk, sql_one(SPAP2, "DESC")),
    "pap_distance_topk": (pap_distance_topk, sql_one(f"round({sql_pap_dist(W, QW)}, 6)", "ASC")),
    "direct_top1": (direct_top1, sql_one(SPAP, "DESC", 1)),
    "prefix_filter_topk": (prefix_filter_topk, sql_one(SHAM, "ASC", source=sql_near(SHAM2, "ASC", PREFIX_POOL))),
    "dot_rerank": (rerank, sql_one(SDOT, "DESC", source=sql_near(SHAM, "ASC", POOL, where=OTHERS))),
    "cosine_rerank": (cosine_rerank, sql_one(SCOS, "DESC", source=sql_near(SHAM, "ASC", 100))),
    "three_stage": (three_stage, sql_one(f"round({SL2}, 6)", "ASC", source=sql_near(SHAM, "ASC", POOL, sql_near(SHAM2, "ASC", PREFIX_POOL, where=OTHERS)))),
    "unified_bypass": (unified_bypass, sql_one(f"CASE WHEN q_id % {2 * EVERY} = 0 THEN 1 - {SHAM} / 512.0::DOUBLE ELSE {SDOT} END", "DESC", where=f"q_id % {2 * EVERY} = 0 OR doc_id <> 0", source=sql_near(SHAM, "ASC", POOL))),
    "two_tier_recall": (two_tier_recall, f"WITH {HASHED}, {sql_top(SDOT, 'DESC', where=OTHERS)}, {sql_top(SDOT, 'DESC', name='rr', source=sql_near(SHAM, 'ASC', POOL, where=OTHERS))} SELECT s.query_id, count(rr.doc_id)::BIGINT AS found FROM s LEFT JOIN rr ON s.query_id = rr.query_id AND s.doc_id = rr.doc_id GROUP BY 1"),
    "hit_rate": (hit_rate, f"WITH {HASHED}, {sql_top(SDOT, 'DESC', 1, OTHERS)}, {sql_top(SHAM, 'ASC', 10, OTHERS, 'f')}, r AS (SELECT s.query_id, min(CASE WHEN f.doc_id = s.doc_id THEN f.rank END) AS seat FROM s JOIN f USING (query_id) GROUP BY 1) SELECT " + ", ".join(f"round(avg(CASE WHEN seat <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS r{k}" for k in (1, 5, 10)) + " FROM r"),
    "bucket_topk": (bucket_topk, sql_one(SHAM, "ASC", where=f"{sql_bucket(4)} = {sql_bucket(4, 'q_h0')}")),
    "bucket_sizes": (bucket_sizes, f"WITH {HASHED} SELECT {sql_bucket(4)} AS bucket, count(*) AS n, min(doc_id) AS first_doc FROM h GROUP BY 1"),
    "bucket_fast_path": (bucket_fast_path, sql_one(SPAP2, "DESC", where=f"{sql_bucket(6)} = {sql_bucket(6, 'q_h0')} AND {sql_bucket(6)} IN (SELECT {sql_bucket(6)} FROM h GROUP BY 1 HAVING count(*) <= 64)")),
    "exact_lookup": (exact_lookup, f"WITH {HASHED} SELECT q_id AS query_id, doc_id FROM h, q WHERE {SHAM} = 0"),
    "prefix_exact": (prefix_exact, f"WITH {HASHED} SELECT q_id AS query_id, min(doc_id) AS doc_id FROM h JOIN q ON h0 = q_h0 GROUP BY 1"),
    "bucket_exact": (bucket_exact, f"WITH {HASHED} SELECT q_id AS query_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY doc_id)::INT AS rank FROM h JOIN q ON h0 = q_h0 AND h1 = q_h1 QUALIFY rank <= 5"),
    "hybrid_topk": (hybrid_topk, sql_one(SPAP, "DESC", source=sql_near(SPAP2, "DESC", POOL))),
    "auto_merge": (auto_merge, f"WITH {HASHED}, {sql_top(SPAP2, 'DESC', name='a')}, {sql_top(SPAP, 'DESC', name='c')}, f AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM c) GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM f QUALIFY rank <= 10"),
    "hinted_search": (hinted_search, f"WITH {HASHED}, t AS (SELECT q_id AS query_id, doc_id FROM h JOIN q ON h0 = q_h0 AND h1 = q_h1 QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY doc_id) <= 5), e AS (SELECT query_id, doc_id, 1.0::DOUBLE AS score FROM t WHERE query_id <> doc_id), {sql_top(SPAP, 'DESC', source=sql_near(SPAP2, 'DESC', POOL))} SELECT * FROM e UNION ALL SELECT query_id, doc_id, score FROM s WHERE query_id NOT IN (SELECT query_id FROM e)"),
    "multi_probe": (multi_probe, sql_one(SHAM, "ASC", where=f"xor({sql_bucket(6)}, {sql_bucket(6, 'q_h0')}) IN (0, {PROBES})")),
    "multi_index": (multi_index, f"WITH {HASHED}, u AS (" + " UNION ".join(f"(SELECT q_id, doc_id, {SHAM} AS score FROM {sql_near(_ham(W[a:b], QW[a:b]), 'ASC', 20)})" for a, b in ((0, 3), (3, 6), (6, 8))) + ") SELECT q_id AS query_id, row_number() OVER (PARTITION BY q_id ORDER BY score, doc_id)::INT AS rank, doc_id, score FROM u QUALIFY rank <= 10"),
    "graph_diffusion": (graph_diffusion, f"WITH {HASHED}, g AS (SELECT a.doc_id AS src, h.doc_id AS dst FROM h a, h WHERE a.doc_id <> h.doc_id QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY {_ham([f'h.{w}' for w in W], [f'a.{w}' for w in W])}, h.doc_id) <= 5), n AS (SELECT src AS query_id, dst AS doc_id FROM g WHERE src % {EVERY} = 0), c AS (SELECT * FROM n UNION SELECT n.query_id, g.dst FROM n JOIN g ON g.src = n.doc_id WHERE n.query_id <> g.dst), {sql_top(SPAP, 'DESC', source='c JOIN h USING (doc_id) JOIN q ON q_id = query_id')} SELECT query_id, rank, doc_id, score FROM s"),
    "bit_meet_join": (bit_meet_join, f"WITH {HASHED}, a AS (SELECT label, {', '.join(f'bit_and({w}) AS meet_{w}, bit_or({w}) AS join_{w}' for w in W)}, min({_pop(W)}) AS least, max({_pop(W)}) AS most FROM h GROUP BY 1), c AS (SELECT *, {_pop([f'meet_{w}' for w in W])} AS meet_bits, {_pop([f'join_{w}' for w in W])} AS join_bits FROM a) SELECT label, meet_h0, join_h0, meet_bits, join_bits, round(CASE WHEN least = 0 THEN 1 ELSE meet_bits / least::DOUBLE END, 6) AS consensus, round(CASE WHEN join_bits = 0 THEN 1 ELSE most / join_bits::DOUBLE END, 6) AS coverage FROM c"),
    "xor_wave": (xor_wave, f"WITH {HASHED} SELECT label, {', '.join(f'bit_xor({w}) AS wave_{w}' for w in W)} FROM h GROUP BY 1"),
    "bit_counters": (bit_counters, f"WITH {encode.SQL}, x AS (SELECT label, unnest(range(512))::INT AS bit, unnest(bits) AS one FROM z JOIN embeddings ON vec_id = doc_id) SELECT label, bit, sum(2 * one - 1)::BIGINT AS counter, sum(2 * one - 1) > 0 AS majority FROM x GROUP BY 1, 2"),
    "bridge_best": (bridge_best, f"WITH {HASHED}, p AS (SELECT q.q_id AS query_id, h.doc_id, {sql_pap_dist([f'q.{w}' for w in QW], [f'h.{w}' for w in W])} AS da, {sql_pap_dist([f'n.{w}' for w in QW], [f'h.{w}' for w in W])} AS db FROM h, q JOIN q n ON n.q_id = q.q_id + {EVERY} WHERE h.doc_id NOT IN (q.q_id, n.q_id)), r AS (SELECT query_id, doc_id, round(least(da, db) + abs(da - db), 6) AS score FROM p) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) = 1"),
    "gap_best": (gap_best, f"WITH {HASHED}, {sql_top(f'round(({sql_pap_dist(W, QW)}) * ({sql_pap_dist(W, [f'(~{w})' for w in QW])}), 6)', 'DESC', 1)} SELECT query_id, doc_id, score FROM s"),
    "wedge_novelty": (wedge_novelty, f"WITH {HASHED}, {sql_top(f'round(greatest(0.0, {SWEDGE}), 6)', 'DESC', 1)} SELECT query_id, doc_id, score FROM s WHERE score > 0"),
    "gap_bonus": (gap_bonus, f"WITH {HASHED}, {BONUS} SELECT * FROM b10"),
    "ratio_confidence": (ratio_confidence, f"WITH {HASHED}, {sql_top(SDOT, 'DESC', where=OTHERS)}, r AS (SELECT *, lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS next FROM s) SELECT query_id, score, CASE WHEN next IS NULL OR score <= 0 THEN 0.4 WHEN score / (next + 1e-6) > 1.5 THEN 0.98 WHEN score / (next + 1e-6) > 1.2 THEN 0.85 ELSE 0.55 END::DOUBLE AS confidence FROM r WHERE rank = 1"),
    "consensus_fusion": (consensus_fusion, f"WITH {HASHED}, {BONUS}, {sql_top(f'round(1 / (1 + sqrt({SL2})), 6)', 'DESC', 10, OTHERS, 'near')}, u AS (SELECT query_id, doc_id, score * 0.20::DOUBLE / rank AS part FROM n11 WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, score * 0.25::DOUBLE / rank FROM near UNION ALL SELECT query_id, doc_id, score * 0.25::DOUBLE / rank FROM b10 UNION ALL SELECT query_id, doc_id, score * 0.30::DOUBLE / rank FROM b10 WHERE rank <= 5), f AS (SELECT query_id, doc_id, round(sum(part) * (1 + 0.1::DOUBLE * count(*)), 6) AS score, count(*) AS hits FROM u GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM f QUALIFY rank <= 5"),
    "centroid_by_label": (centroid_by_label, "WITH x AS (SELECT label, unnest(range(64))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, dim, avg(x) AS mean FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(mean * mean)) AS norm FROM m GROUP BY 1) SELECT label, dim, round(mean, 6) AS mean, round(mean / norm, 6) AS unit FROM m JOIN n USING (label)"),
    "label_counts_rollup": (label_counts_rollup, f"WITH {HASHED} SELECT coalesce(label, -1)::BIGINT AS label, coalesce({sql_bucket(2)}, -1)::BIGINT AS cell, count(*) AS n FROM h GROUP BY ROLLUP (label, {sql_bucket(2)})"),
}
