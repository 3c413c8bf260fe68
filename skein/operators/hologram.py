"""Superposed holograms: vaults of bound bit vectors, the arrow query over a row's mirrors, and the tiered ensemble.

A fingerprint's 512 bits, as +1 and -1, are its key; its content is the key with its places permuted; the two bound (their
product, place by place) are added to the wave of a vault. A row is in one vault for each mirror: the vault is the first
bits of the mirrored fingerprint, as many as keep vaults at some HELD rows. Tasks add up what they hold of a vault before
anything is shuffled; a vault is 512 pairs of whole numbers, however many rows it superposes.

A query unbinds a vault's wave with its own key and the vault's phase (the sum of its keys, scaled to unit length) and cleans
up against the contents of the members. All of that is linear in the content, so a probe is one vector of weights, and
probes and members of a vault meet in parts of bounded size, one matrix product each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encode
from . import tiles
from .fingerprints import EVERY, HASHED, W, asked, sql_pap_dist, vectors_of
from .topk import topk

MIRRORS, STEP, ARROW = 4, 2654435761, 350.0  # fixed values: mirrors, multiplier of turns and places, score that ends a query
HELD, PART, K = 64, 4096, 10
#: A row is in hologram t if bit t of its last word is set; fixed values: 100 votes of a hologram, distance 0.5, 1000 rows.
HOLOGRAMS, VOTES, NEAR, SMALL = 4, 100, 0.5, 1000

TURNS = [m * STEP % 512 for m in range(MIRRORS)]
#: Where a content's place comes from: content[j] = key[SOURCE[j]].
SOURCE = np.argsort(np.arange(512) * STEP % 512)


def mirrored(turn: int) -> list:
    """The words turned left by so many bits."""
    k, s = divmod(turn, 64)
    return [F.shiftleft(F.col(W[(k + i) % 8]), s).bitwiseOR(F.shiftrightunsigned(F.col(W[(k + i + 1) % 8]), 64 - s)) if s else F.col(W[(k + i) % 8]) for i in range(8)]


def vault_bits(n: int) -> int:
    return max(4, int(np.floor(np.log2(max(1, n) / HELD))) if n else 4)


def _words(spark, sf_dir) -> DataFrame:
    return tiles.word_columns(encode.encoded(tiles.usable(vectors_of(spark, sf_dir).select("doc_id", "embedding"))))


def in_vaults(h: DataFrame, bits: int) -> DataFrame:
    """h's rows with mirror and vault, a row for each mirror."""
    each = F.array(*(F.struct(F.lit(m).alias("mirror"), F.shiftrightunsigned(mirrored(t)[0], 64 - bits).alias("vault")) for m, t in enumerate(TURNS)))
    return h.withColumn("each", F.explode(each)).select(*h.columns, "each.mirror", "each.vault")


def _keys(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).astype(">i8").view(np.uint8).reshape(len(words), -1), axis=1).astype(np.float64) * 2 - 1


def _stack(t: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([t.column(c).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t[c].to_numpy() for c in names], axis=1)


def waves(members: DataFrame) -> DataFrame:
    """vault, place, wave, total: the sums of bound vectors and of keys; place -1 holds the number of members as total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vault, key = b.column(0).to_numpy(), _keys(_stack(b, W))
            own, at = np.unique(vault, return_inverse=True)
            one = np.zeros((len(own), len(vault)))
            one[at, np.arange(len(vault))] = 1
            wave, total, n = one @ (key * key[:, SOURCE]), one @ key, one.sum(axis=1)
            places = np.concatenate([np.tile(np.arange(512), len(own)), np.full(len(own), -1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.repeat(own, 512), own])), pa.array(places.astype(np.int32)), pa.array(np.concatenate([wave.ravel(), n]).astype(np.int64)), pa.array(np.concatenate([total.ravel(), n]).astype(np.int64))], ["vault", "place", "wave", "total"])

    parts = members.select("vault", *W).mapInArrow(run, "vault long, place int, wave long, total long")
    return parts.groupBy("vault", "place").agg(F.sum("wave").alias("wave"), F.sum("total").alias("total"))


def vault_waves(spark, sf_dir) -> DataFrame:
    """What each vault superposes: 512 sums of bound vectors and of keys."""
    h = _words(spark, sf_dir)
    return waves(in_vaults(h, vault_bits(vectors_of(spark, sf_dir).count()))).where("place >= 0")


def arrow_topk(spark, sf_dir) -> DataFrame:
    """A query's vaults in the order of likeness to their centroids; it ends at the first whose best score is over ARROW. The 10 best rows of the vaults it probed."""
    h, bits = _words(spark, sf_dir), vault_bits(vectors_of(spark, sf_dir).count())
    vaults = waves(in_vaults(h, bits)).groupBy("vault").agg(F.max(F.when(F.col("place") < 0, F.col("total"))).alias("n"), F.sort_array(F.collect_list(F.when(F.col("place") >= 0, F.struct("place", "wave", "total")))).alias("v"))
    vaults = vaults.select("vault", F.ceil(F.col("n") / PART).cast("int").alias("parts"), F.col("v.wave").alias("wave"), F.col("v.total").alias("total"))
    probes = in_vaults(h.where(F.col("doc_id") % EVERY == 0), bits).join(vaults, "vault")

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                key, wave, total = _keys(_stack(b, W)), tiles.matrix(b.column(b.schema.get_field_index("wave"))), tiles.matrix(b.column(b.schema.get_field_index("total")))
                norm = np.sqrt((total * total).sum(axis=1))
                norm = np.where(norm > 0, norm, 1.0)
                alike = np.round((key * total).sum(axis=1) / norm, 6)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(alike), pa.array(norm), pa.array(list(wave * total * key), pa.list_(pa.float64()))], ["q_id", "mirror", "vault", "parts", "alike", "norm", "weights"])

    aimed = probes.select(F.col("doc_id").alias("q_id"), "mirror", "vault", "parts", *W, "wave", "total").mapInArrow(aim, "q_id long, mirror int, vault long, parts int, alike double, norm double, weights array<double>")
    aimed = aimed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = in_vaults(h, bits).drop("mirror").distinct().join(vaults.select("vault", "parts"), "vault")
    members = members.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))

    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            content, docs = _keys(_stack(left, W))[:, SOURCE], left["doc_id"].to_numpy()
            norm, alike = right["norm"].to_numpy(), right["alike"].to_numpy()
            score = np.round(tiles.matrix(right["weights"]) @ content.T / norm[:, None], 6)
            for i, (q, m) in enumerate(zip(right["q_id"].to_pylist(), right["mirror"].to_pylist(), strict=True)):
                best = np.lexsort((docs, -score[i]))[:K]
                out += [(q, m, float(alike[i]), int(docs[j]), float(score[i, j]) + 0.0) for j in best]
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.float64()]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["query_id", "mirror", "alike", "doc_id", "score"])

    found = members.groupBy("vault", "part").cogroup(aimed.groupBy("vault", "part")).applyInArrow(clean, "query_id long, mirror int, alike double, doc_id long, score double")
    found = topk(found, K, ["query_id", "mirror"], [F.desc("score"), F.asc("doc_id")], "seat")
    w = Window.partitionBy("query_id").orderBy(F.desc("alike"), "mirror").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    hit = found.groupBy("query_id", "mirror", "alike").agg((F.max("score") > ARROW).cast("int").alias("hit")).withColumn("hits", F.sum("hit").over(w))
    probed = found.join(hit.where("hits - hit = 0").select("query_id", "mirror"), ["query_id", "mirror"])
    return topk(probed.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), K, ["query_id"], [F.desc("score"), F.asc("doc_id")]).select("query_id", "rank", "doc_id", "score")


def ensemble_topk(spark, sf_dir) -> DataFrame:
    """Each hologram gives its first 100 rows that are nearer than 0.5 to the query in 128 bits; rows by votes, then by the likeness of their holograms' waves. Where the holograms hold fewer than 1000 rows, the nearest rows fill what is missing of 10."""
    h = _words(spark, sf_dir)
    q = asked(h)
    n = vectors_of(spark, sf_dir).count()
    of = F.array(*(F.struct(F.lit(t).alias("t"), F.getbit("h7", F.lit(t)).alias("is")) for t in range(HOLOGRAMS)))
    held = h.withColumn("o", F.explode(of)).where("o.is = 1").select("doc_id", *W, "o.t")
    wave = held.groupBy("t").agg(F.count(F.lit(1)).alias("n"), *(F.expr(f"bit_xor({w})").alias(w) for w in W)).collect()  # HOLOGRAMS rows
    total = sum(r.n for r in wave)

    def first(x_q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.where(tiles.pap_distance(x_q, x) < NEAR, 0.0, np.inf)  # equal scores: in the order of ids

    pair, q_pair = ["h0", "h1"], ["q_h0", "q_h1"]
    votes = None
    for r in wave:
        folded = np.array([[r.h0 ^ r.h2 ^ r.h4 ^ r.h6, r.h1 ^ r.h3 ^ r.h5 ^ r.h7]], np.int64)
        mine = tiles.nearest(held.where(F.col("t") == r.t).select("doc_id", *pair), q.select("q_id", *q_pair), VOTES, first, True, n=n).drop("rank", "score")
        like = tiles.nearest(spark.createDataFrame([(int(r.t), int(folded[0, 0]), int(folded[0, 1]))], "doc_id long, h0 long, h1 long"), q.select("q_id", *q_pair), 1, tiles.pap_distance, True, n=1)
        part = mine.join(like.select("query_id", F.col("score").alias("apart")), "query_id")
        votes = part if votes is None else votes.unionByName(part)
    if votes is None:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    voted = votes.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("votes"), (F.round(1 / (1 + F.avg("apart")), 6)).alias("score"))
    best = topk(voted, K, ["query_id"], [F.desc("votes"), F.desc("score"), F.asc("doc_id")]).select("query_id", "doc_id", "score", F.lit(0).alias("later"), "rank")
    if total < SMALL:
        near = tiles.nearest(held.select("doc_id", *pair).distinct(), q.select("q_id", *q_pair), 2 * K, tiles.rounded(tiles.pap_distance), True, n=n)
        near = near.join(best.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.round(1 / (1 + F.col("score")), 6).alias("score"), F.lit(1).alias("later"), "rank")
        best = best.unionByName(near)
    return topk(best.withColumnRenamed("rank", "seat"), K, ["query_id"], [F.asc("later"), F.asc("seat")]).select("query_id", "rank", "doc_id", "score")


_BITS = f"k AS (SELECT greatest(4, floor(log2(count(*) / {HELD}::DOUBLE)))::INT AS size FROM embeddings)"
_MEMBERS = f"""{_BITS}, m AS MATERIALIZED (SELECT doc_id, mirror, bits, list_sum(list_transform(range(size), lambda i: bits[(i + turn) % 512 + 1]::BIGINT << (size - 1 - i)::INT))::BIGINT AS vault FROM z, k, (SELECT unnest(range({MIRRORS}))::INT AS mirror, unnest([{', '.join(map(str, TURNS))}]) AS turn)),
s AS MATERIALIZED (SELECT vault, p::INT AS place, sum((2 * bits[p + 1] - 1) * (2 * bits[p * {pow(STEP % 512, -1, 512)} % 512 + 1] - 1))::BIGINT AS wave, sum(2 * bits[p + 1] - 1)::BIGINT AS total FROM m, range(512) g(p) GROUP BY vault, p)"""
_WORD128 = ["h0", "h1"]
_APART = f"({sql_pap_dist(_WORD128, ['q_h0', 'q_h1'])})"
QUERIES = {
    "vault_waves": (vault_waves, f"WITH {encode.SQL}, {_MEMBERS} SELECT vault, place, wave, total FROM s"),
    "arrow_topk": (arrow_topk, f"""WITH {encode.SQL}, {_MEMBERS}, v AS MATERIALIZED (SELECT vault, list((wave * total)::DOUBLE ORDER BY place) AS wt, list(total::DOUBLE ORDER BY place) AS t, sqrt(sum(total * total)) AS norm FROM s GROUP BY vault),
c AS MATERIALIZED (SELECT doc_id, list_transform(range(512), lambda i: 2.0::DOUBLE * bits[i + 1] - 1) AS x, list_transform(range(512), lambda i: 2.0::DOUBLE * bits[i * {pow(STEP % 512, -1, 512)} % 512 + 1] - 1) AS content FROM z),
a AS MATERIALIZED (SELECT m.doc_id AS query_id, mirror, vault, CASE WHEN norm > 0 THEN norm ELSE 1 END AS norm, round(list_dot_product(t, x) / CASE WHEN norm > 0 THEN norm ELSE 1 END, 6) AS alike, list_transform(list_zip(wt, x), lambda e: e[1] * e[2]) AS w FROM m JOIN v USING (vault) JOIN c ON c.doc_id = m.doc_id WHERE m.doc_id % {EVERY} = 0),
f AS (SELECT query_id, mirror, alike, d.doc_id, round(list_dot_product(w, content) / norm, 6) + 0.0 AS score FROM a JOIN (SELECT DISTINCT doc_id, vault FROM m) d USING (vault) JOIN c ON c.doc_id = d.doc_id QUALIFY row_number() OVER (PARTITION BY query_id, mirror ORDER BY round(list_dot_product(w, content) / norm, 6) DESC, d.doc_id) <= {K}),
g AS (SELECT query_id, mirror, alike, (max(score) > {ARROW})::INT AS hit FROM f GROUP BY ALL), e AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY alike DESC, mirror) - hit AS earlier FROM g),
b AS (SELECT query_id, doc_id, max(score) AS score FROM f JOIN e USING (query_id, mirror) WHERE earlier = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM b QUALIFY rank <= {K}"""),
    "ensemble_topk": (ensemble_topk, f"""WITH {HASHED}, o AS MATERIALIZED (SELECT h.*, t FROM h, range({HOLOGRAMS}) g(t) WHERE (h7 >> t::INT) & 1 = 1), w AS (SELECT t, bit_xor(xor(xor(h0, h2), xor(h4, h6))) AS w0, bit_xor(xor(xor(h1, h3), xor(h5, h7))) AS w1 FROM o GROUP BY t),
a AS MATERIALIZED (SELECT q_id, doc_id, t, {_APART} AS apart FROM o, q), r AS (SELECT q_id, t, ({sql_pap_dist(['q_h0', 'q_h1'], ['w0', 'w1'])}) AS wave FROM q, w),
p AS (SELECT q_id, doc_id, t FROM a WHERE apart < {NEAR} QUALIFY row_number() OVER (PARTITION BY q_id, t ORDER BY doc_id) <= {VOTES}),
v AS (SELECT q_id, doc_id, count(*) AS votes, round(1 / (1 + avg(wave)), 6) AS score FROM p JOIN r USING (q_id, t) GROUP BY ALL),
b AS (SELECT q_id, doc_id, score, 0 AS later, row_number() OVER (PARTITION BY q_id ORDER BY votes DESC, score DESC, doc_id) AS seat FROM v QUALIFY seat <= {K}),
n AS (SELECT q_id, doc_id, round(1 / (1 + round(apart, 6)), 6) AS score, 1 AS later, row_number() OVER (PARTITION BY q_id ORDER BY round(apart, 6), doc_id) AS seat FROM (SELECT DISTINCT q_id, doc_id, apart FROM a) WHERE (q_id, doc_id) NOT IN (SELECT q_id, doc_id FROM b) AND (SELECT count(*) FROM o) < {SMALL}),
u AS (SELECT * FROM b UNION ALL SELECT * FROM n) SELECT q_id AS query_id, row_number() OVER (PARTITION BY q_id ORDER BY later, seat)::INT AS rank, doc_id, score FROM u QUALIFY rank <= {K}"""),
}
