"""A navigable proximity graph over fingerprints: neighbour exchange, diverse pruning, and a beam search in rounds of joins.

Building. Each row first links to the next rows in its bucket of each word, buckets being as many as keep them small and
split where one is large. A round of exchange then offers each row the neighbours of its neighbours, over links in both
directions, and keeps its NEAR nearest: candidates are measured before they are shuffled, and only those that can still be
among the nearest are. A few rounds find nearly all true neighbours without ever comparing all pairs. Of
these, greedy pruning keeps those that no kept one is closer to (diverse edges); a row's MOST nearest edges in either
direction are the graph, so a row that many choose is no hub.

Searching. Every query starts at its nearest of SEEDS rows (a sample of bounded size, in tiles). A round expands its WIDTH
best open rows among the BEAM best so far, by a join with the edges, drops those that are among them, measures the rest, and
keeps the BEAM best (its state). It ends when no query has an open row among its best, or after ROUNDS. The state is
written after each round.

Every step is a join, an aggregation or a window limit on (row) or (query, row); what a row takes part in is bounded by
NEAR, MOST and BEAM, so the work grows with the number of rows and queries, not with their product."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, encode
from ..sources import scratch
from . import tiles
from .fingerprints import EVERY, HASHED, SHAM, W, asked, cols, vectors_of
from .topk import topk

#: Neighbours that the exchange keeps, links that a row takes part in with, rounds of it, rows of a first bucket and links in it.
NEAR, LINKS, EXCHANGES, BUCKET, AHEAD = 16, 24, 4, 64, 6
#: Edges of a row in the graph; how strict pruning is.
MOST, ALPHA = 24, 1.0
#: Pairs of neighbours that pruning compares at a time.
PRUNED = 1 << 17
SEEDS, ENTRIES, BEAM, WIDTH, ROUNDS = 256, 8, 64, 8, 24

V = [f"v_{w}" for w in W]


def words(spark, sf_dir) -> DataFrame:
    """doc_id and words of the rows that have them; of rows that repeat an id the one with the least words."""
    h = tiles.word_columns(encode.encoded(tiles.usable(vectors_of(spark, sf_dir).select("doc_id", "embedding"))))
    return h.groupBy("doc_id").agg(F.min(F.struct(*W)).alias("w")).select("doc_id", "w.*")


def _nearest(pairs: DataFrame, k: int, of: str = "a", to: str = "b") -> DataFrame:
    return topk(pairs, k, [of], [F.asc("d"), F.asc(to)], "rank")


def first_links(h: DataFrame, n: int) -> DataFrame:
    """a, b, d: each row with the next AHEAD rows of its bucket of each word, in the order of that word."""
    width = max(1, min(60, int(math.log2(max(2, n / BUCKET)))))
    each = h.select("doc_id", *W, F.posexplode(F.array(*W)).alias("t", "word")).withColumn("bucket", F.shiftrightunsigned("word", 64 - width))
    # a bucket of very many rows is split by ranges of nothing but a hash, so equal fingerprints go apart
    parts = each.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / (8 * BUCKET)).cast("int").alias("parts"))
    each = each.join(merged(parts), ["t", "bucket"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    w = Window.partitionBy("t", "bucket", "part").orderBy("word", "doc_id")
    row = F.struct(F.col("doc_id").alias("b"), *(F.col(x).alias(y) for x, y in zip(W, V, strict=True)))
    ahead = each.select(F.col("doc_id").alias("a"), *W, F.array(*(F.lead(row, i).over(w) for i in range(1, AHEAD + 1))).alias("next"))
    return ahead.select("a", *W, F.inline("next")).where("b is not null").select("a", "b", bits.hamming(cols(W), cols(V)).alias("d")).distinct()


def both_ways(e: DataFrame) -> DataFrame:
    """a, b, d of links in both directions."""
    return e.select("a", "b", "d").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).distinct()


def merged(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the rows: it is shuffled, never collected on the driver to be broadcast, however small its files seem."""
    return side.hint("merge")


def measured(e: DataFrame, h: DataFrame) -> DataFrame:
    """a, b, d of distinct pairs (a, b)."""
    e = e.join(merged(h.select(F.col("doc_id").alias("a"), *W)), "a").join(merged(h.select(F.col("doc_id").alias("b"), *(F.col(x).alias(y) for x, y in zip(W, V, strict=True)))), "b")
    return e.select("a", "b", bits.hamming(cols(W), cols(V)).alias("d"))


def neighbours(h: DataFrame, n: int, rounds: int = EXCHANGES) -> DataFrame:
    """a, rank, b, d: about the NEAR nearest rows of each row of h, which is staged."""
    near = scratch.staged(_nearest(both_ways(first_links(h, n)), NEAR), "graph-near")
    for _ in range(rounds):
        near = scratch.staged(_nearest(near.select("a", "b", "d").unionByName(offered(near, h)).distinct(), NEAR), "graph-near")
    return near


def offered(near: DataFrame, h: DataFrame) -> DataFrame:
    """a, b, d: the links of a's links that are no farther than its NEAR-th neighbour so far (all of them, while it has fewer): no other can become one of its neighbours.

    A row's links go to those that link to it as one list with their words, and are measured where they arrive, so that the
    candidates, some LINKS squared for each row, are neither shuffled nor sorted before most of them are gone."""
    # links in both directions, the nearest LINKS of each row, so that none offers more than that squared
    linked = _nearest(both_ways(near), LINKS).select("a", "b")
    words_of_b = h.select(F.col("doc_id").alias("b"), *(F.col(x).alias(y) for x, y in zip(W, V, strict=True)))
    lists = linked.join(merged(words_of_b), "b").groupBy(F.col("a").alias("b")).agg(F.collect_list(F.struct(F.col("b").alias("c"), *V)).alias("list"))
    last = near.where(F.col("rank") == NEAR).select("a", F.col("d").alias("worst"), F.col("b").alias("last"))
    asking = linked.join(merged(h.select(F.col("doc_id").alias("a"), *W)), "a").join(merged(last), "a", "left")
    met = asking.join(merged(lists), "b").select("a", "worst", "last", *W, F.inline("list"))
    d = bits.hamming(cols(W), cols(V))
    may = F.col("worst").isNull() | (d < F.col("worst")) | ((d == F.col("worst")) & (F.col("c") < F.col("last")))
    return met.where((F.col("a") != F.col("c")) & may).select("a", F.col("c").alias("b"), d.alias("d"))


def _kept(d: np.ndarray, w: np.ndarray, alpha: float) -> np.ndarray:
    """rows x neighbours: of each row's neighbours in order of distance, those that no kept one is closer to than alpha times their own distance (1 for equal fingerprints)."""
    u = w.view(np.uint64)
    between = sum(np.bitwise_count(u[:, :, None, k] ^ u[:, None, :, k]).astype(np.int16) for k in range(w.shape[2]))
    limit, kept = np.where(d > 0, (alpha * d).astype(np.int64), 1), np.zeros(d.shape, bool)
    for i in range(d.shape[1]):
        kept[:, i] = ~((between[:, i] < limit[:, i, None]) & kept).any(axis=1)
    return kept


def pruned(near: DataFrame, h: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Of near (a, rank, b, d, at most some NEAR rows for each a) the diverse edges a, b, d; rows of two neighbours or fewer keep them."""
    lists = near.join(merged(h.select(F.col("doc_id").alias("b"), *W)), "b").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("d", "b", F.array(*W).alias("w")))).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = batch.column(1).flatten(), pc.list_value_length(batch.column(1)).to_numpy()
            ids, b, d = batch.column(0).to_numpy(), flat.field("b").to_numpy(), flat.field("d").to_numpy()
            w, first, keep = flat.field("w").flatten().to_numpy().reshape(len(flat), -1), np.cumsum(n) - n, np.ones(len(flat), bool)
            for m in np.unique(n[n > 2]).tolist():  # rows of as many neighbours at once
                rows, step = np.flatnonzero(n == m), max(1, PRUNED // (m * m))
                for low in range(0, len(rows), step):
                    at = first[rows[low : low + step], None] + np.arange(m)
                    keep[at] = _kept(d[at], w[at], alpha)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)[keep]), pa.array(b[keep]), pa.array(d[keep].astype(np.int64))], ["a", "b", "d"])

    return lists.mapInArrow(run, "a long, b long, d long")


def edges(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The staged words and the staged graph a, b, d: diverse edges in both directions, the MOST nearest of each row."""
    h = scratch.staged(words(spark, sf_dir), "graph-words")
    sparse = pruned(neighbours(h, h.count()), h)
    return h, scratch.staged(_nearest(both_ways(sparse), MOST).select("a", "b", "d"), "graph-edges")


def beam(h: DataFrame, graph: DataFrame, queries: DataFrame, k: int, size: int = BEAM, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """query_id, rank, doc_id, score: the k nearest rows that a beam of `size` finds in the graph; queries: q_id and the words as q_*."""
    spread = F.least(F.lit(1.0), (F.lit(1.2 * SEEDS) + 40) / F.lit(max(1, h.count())))
    seeds = h.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < spread * (1 << 30)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SEEDS)  # of a share of the rows
    state = tiles.nearest(seeds, queries, ENTRIES, tiles.hamming, True).select(F.col("query_id").alias("q_id"), F.col("doc_id").alias("b"), F.col("score").cast("long").alias("d"), F.lit(False).alias("done"))
    state = scratch.staged(state, "beam")
    for _ in range(rounds):
        chosen = scratch.staged(_nearest(state.where("not done"), width, "q_id").select("q_id", "b"), "beam-open")
        if chosen.isEmpty():
            break
        met = chosen.join(merged(graph.select(F.col("a").alias("b"), F.col("b").alias("c"))), "b").select("q_id", F.col("c").alias("b")).distinct().join(merged(state.select("q_id", "b")), ["q_id", "b"], "left_anti")
        new = met.join(merged(h.select(F.col("doc_id").alias("b"), *W)), "b").join(merged(queries), "q_id").select("q_id", "b", bits.hamming(cols(W), cols([f"q_{w}" for w in W])).alias("d"), F.lit(False).alias("done"))
        now = chosen.select("q_id", "b", F.lit(True).alias("now"))
        seen = state.join(merged(now), ["q_id", "b"], "left").select("q_id", "b", "d", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        # what falls out of the best never comes back, as they only get nearer: if it is met again, it falls out again
        state = scratch.staged(_nearest(seen.unionByName(new), size, "q_id").drop("rank"), "beam")
    found = state.select(F.col("q_id").alias("query_id"), F.col("b").alias("doc_id"), F.col("d").alias("score"))
    return topk(found.where("query_id <> doc_id"), k, ["query_id"], [F.asc("score"), F.asc("doc_id")])


def graph_edges(spark, sf_dir) -> DataFrame:
    """The graph's edges with their distances."""
    return edges(spark, sf_dir)[1].select(F.col("a").alias("doc_id"), F.col("b").alias("neighbour"), F.col("d").alias("distance"))


def graph_topk(spark, sf_dir) -> DataFrame:
    """The stated queries by a beam search in the graph, without themselves."""
    h, graph = edges(spark, sf_dir)
    return beam(h, graph, asked(h), 10)


def pruned_neighbours(spark, sf_dir) -> DataFrame:
    """One pruning round over exact neighbours: of each stated query's NEAR nearest rows the diverse ones."""
    h = scratch.staged(words(spark, sf_dir), "graph-words")
    near = tiles.nearest(h, asked(h), NEAR, tiles.hamming, True, True).select(F.col("query_id").alias("a"), F.col("doc_id").alias("b"), F.col("score").cast("long").alias("d"))
    return pruned(near, h).select(F.col("a").alias("query_id"), F.col("b").alias("doc_id"), F.col("d").alias("score"))


_BETWEEN = "list_sum(list_transform(list_zip(k.w, n.w), lambda p: bit_count(xor(p[1], p[2]))))"
_CLOSE = _BETWEEN.replace("k.w", "e.w")
_LIST = f"[{', '.join(W)}]"
QUERIES = {
    "graph_edges": (graph_edges, None),
    "graph_topk": (graph_topk, None),
    "pruned_neighbours": (pruned_neighbours, f"""WITH RECURSIVE {HASHED}, n AS MATERIALIZED (SELECT q_id, doc_id, {SHAM} AS d, {_LIST} AS w, row_number() OVER (PARTITION BY q_id ORDER BY {SHAM}, doc_id) AS r FROM h, q WHERE q_id <> doc_id QUALIFY r <= {NEAR}),
p AS (SELECT q_id, 1 AS r, [{{'doc_id': doc_id, 'd': d, 'w': w}}] AS kept FROM n WHERE r = 1 UNION ALL
SELECT p.q_id, p.r + 1, CASE WHEN len(list_filter(p.kept, lambda e: {_CLOSE} < CASE WHEN n.d = 0 THEN 1 ELSE n.d END)) = 0 THEN list_append(p.kept, {{'doc_id': n.doc_id, 'd': n.d, 'w': n.w}}) ELSE p.kept END FROM p JOIN n ON n.q_id = p.q_id AND n.r = p.r + 1)
SELECT q_id AS query_id, k.doc_id, k.d AS score FROM (SELECT q_id, unnest(arg_max(kept, r)) AS k FROM p GROUP BY q_id)"""),
}
