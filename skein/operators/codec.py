"""A codec of 16 levels for each component: one-dimensional k-means over mergeable histograms.

Two passes over the rows, whatever the number of rounds: mean and span of each component, then a histogram of BINS equal
bins with their means. Histograms add up, so Spark sums them before the shuffle and the driver gets at most BINS rows for
each component. Lloyd's rounds run on these bins until the levels stay, ROUNDS times at most."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .fingerprints import EVERY, asked, sides, vectors_of
from .topk import topk
from ..functions import vectors

LEVELS, BINS, ROUNDS, POOL = 16, 1024, 50, 100


@dataclass(frozen=True)
class Codec:
    """The components' means, and their LEVELS levels around them, ascending."""

    mean: np.ndarray
    levels: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        """The nearest level of each component, the lower one at a tie."""
        c = x - self.mean
        middle = (self.levels[:, 1:] + self.levels[:, :-1]) / 2
        return np.stack([np.searchsorted(middle[i], c[:, i], "left") for i in range(c.shape[1])], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.levels[np.arange(codes.shape[1]), codes] + self.mean


def lloyd(x: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """LEVELS levels of weighted values (ascending), from their quantiles; a level without values stays where it is."""
    most = np.cumsum(n)
    levels = x[[int(np.argmax(most * 2 * LEVELS >= (2 * k + 1) * most[-1])) for k in range(LEVELS)]]
    for _ in range(rounds):
        near = np.searchsorted((levels[1:] + levels[:-1]) / 2, x, "left")
        weight, total = np.bincount(near, n, LEVELS), np.bincount(near, n * x, LEVELS)
        new = np.where(weight > 0, np.round(total / np.maximum(weight, 1), 9), levels)
        if (new == levels).all():
            break
        levels = new
    return levels


def train(v: DataFrame) -> Codec | None:
    """The codec of v's vectors; None without rows."""
    e = v.select(F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    span = e.groupBy("i").agg(F.round(F.avg("x"), 9).alias("mu"), F.min("x").alias("low"), F.max("x").alias("high"))  # a row for each component
    at = F.when(F.col("high") > F.col("low"), F.least(F.lit(BINS - 1), F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * BINS))).otherwise(0).cast("int")
    bins = e.join(F.broadcast(span), "i").groupBy("i", at.alias("bin")).agg(F.max("mu").alias("mu"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"))
    got = bins.orderBy("i", "bin").toPandas()
    if not len(got):
        return None
    mean, levels = [], []
    for _, mine in got.groupby("i"):
        mean.append(mine["mu"].iloc[0])
        levels.append(lloyd(np.round(mine["m"].to_numpy() - mean[-1], 9), mine["n"].to_numpy()))
    return Codec(np.array(mean), np.array(levels))


def encoded(v: DataFrame, codec: Codec) -> DataFrame:
    """doc_id and codes, a byte for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = codec.encode(tiles.matrix(b.column(1))) if b.num_rows else np.empty((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["doc_id", "codes"])

    return v.select("doc_id", "embedding").mapInArrow(run, "doc_id long, codes binary")


def decoded(codes: DataFrame, codec: Codec) -> DataFrame:
    """doc_id and the vector that a row's levels make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = codec.decode(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)) if b.num_rows else np.empty((0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "embedding"])

    return codes.mapInArrow(run, "doc_id long, embedding array<double>")


def _made(spark, sf_dir) -> tuple[DataFrame, Codec | None]:
    v = tiles.usable(vectors_of(spark, sf_dir)).select("doc_id", "embedding")
    return v, train(v)


def level_codebook(spark, sf_dir) -> DataFrame:
    """The levels of each component, as values (mean added)."""
    _, codec = _made(spark, sf_dir)
    rows = [(i, k, float(x + codec.mean[i])) for i, own in enumerate(codec.levels) for k, x in enumerate(own)] if codec else []
    return spark.createDataFrame(rows, "i int, level int, value double").withColumn("value", F.round("value", 6) + F.lit(0.0))


def level_codec(spark, sf_dir) -> DataFrame:
    """Each row's squared error when its components take the nearest level."""
    v, codec = _made(spark, sf_dir)
    if codec is None:
        return spark.createDataFrame([], "doc_id long, error double")
    back = decoded(encoded(v, codec), codec).withColumnRenamed("embedding", "made")
    return v.join(back, "doc_id").select("doc_id", (F.round(vectors.l2_sq(F.col("embedding"), F.col("made")), 6) + F.lit(0.0)).alias("error"))


def level_topk(spark, sf_dir, k=10) -> DataFrame:
    """The query's own vector against what the rows' levels make."""
    v, codec = _made(spark, sf_dir)
    if codec is None:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    return tiles.nearest(decoded(encoded(v, codec), codec), asked(v), k, tiles.rounded(tiles.l2_sq), True, True, v.count())


def level_rerank_topk(spark, sf_dir) -> DataFrame:
    """The pool by the codec, re-scored by the vectors themselves."""
    near = sides(level_topk(spark, sf_dir, POOL), vectors_of(spark, sf_dir).select("doc_id", "embedding"))
    s = near.select(F.col("q_id").alias("query_id"), "doc_id", (F.round(vectors.l2_sq(F.col("q_embedding"), F.col("embedding")), 6) + F.lit(0.0)).alias("score"))
    return topk(s, 10, ["query_id"], [F.asc("score"), F.asc("doc_id")])


#: The same rounds in SQL: r holds the levels (around the mean) of each component and round, c the last ones.
SQL = f"""WITH RECURSIVE e AS (SELECT vec_id AS doc_id, unnest(range(64))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
sp AS MATERIALIZED (SELECT i, round(avg(x), 9) AS mu, min(x) AS low, max(x) AS high FROM e GROUP BY i),
b AS MATERIALIZED (SELECT i, bin, count(*) AS n, round(avg(x) - any_value(mu), 9) AS m FROM (SELECT i, mu, x, CASE WHEN high > low THEN least({BINS - 1}, floor((x - low) / (high - low) * {BINS})) ELSE 0 END AS bin FROM e JOIN sp USING (i)) GROUP BY i, bin),
q AS (SELECT i, m, bin, sum(n) OVER (PARTITION BY i ORDER BY bin) AS c, sum(n) OVER (PARTITION BY i) AS total FROM b),
f AS MATERIALIZED (SELECT i, list(m ORDER BY k) AS lv FROM (SELECT i, k, arg_min(m, bin) AS m FROM q, range({LEVELS}) g(k) WHERE c * {2 * LEVELS} >= (2 * k + 1) * total GROUP BY i, k) GROUP BY i),
r AS (SELECT 0 AS t, i, lv FROM f UNION ALL
  SELECT t + 1, i, list_transform(range(1, {LEVELS + 1}), lambda j: coalesce(mp[j], lv[j])) FROM (SELECT t, i, any_value(lv) AS lv, map(list(k), list(c)) AS mp FROM (SELECT t, i, k, any_value(lv) AS lv, round(sum(n * m) / sum(n), 9) AS c FROM
    (SELECT r.t, r.i, r.lv, b.n, b.m, 1 + len(list_filter(range(1, {LEVELS}), lambda j: b.m > (r.lv[j] + r.lv[j + 1]) / 2)) AS k FROM r JOIN b USING (i) WHERE r.t < {ROUNDS}) GROUP BY t, i, k) GROUP BY t, i)),
c AS MATERIALIZED (SELECT i, mu, lv FROM r JOIN sp USING (i) WHERE t = {ROUNDS}),
d AS MATERIALIZED (SELECT doc_id, i, x, mu + lv[1 + len(list_filter(range(1, {LEVELS}), lambda j: x - mu > (lv[j] + lv[j + 1]) / 2))] AS y FROM e JOIN c USING (i))"""
_PAIRS = f"s AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum((q.x - d.y) * (q.x - d.y)), 6) + 0.0 AS score, round(sum((q.x - d.x) * (q.x - d.x)), 6) + 0.0 AS exact FROM d q JOIN d ON q.i = d.i AND q.doc_id <> d.doc_id WHERE q.doc_id % {EVERY} = 0 GROUP BY ALL)"
QUERIES = {
    "level_codebook": (level_codebook, f"{SQL} SELECT i, k::INT AS level, round(mu + lv[k + 1], 6) + 0.0 AS value FROM c, range({LEVELS}) g(k)"),
    "level_codec": (level_codec, f"{SQL} SELECT doc_id, round(sum((x - y) * (x - y)), 6) + 0.0 AS error FROM d GROUP BY 1"),
    "level_topk": (level_topk, f"{SQL}, {_PAIRS} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id)::INT AS rank, doc_id, score FROM s QUALIFY rank <= 10"),
    "level_rerank_topk": (level_rerank_topk, f"{SQL}, {_PAIRS}, p AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) <= {POOL}) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY exact, doc_id)::INT AS rank, doc_id, exact AS score FROM p QUALIFY rank <= 10"),
}
