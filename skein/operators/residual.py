"""An inverted file of int8 residuals: trained cells, whole-number codes of what is left, and a fused whole-number score.

Cells are about the square root of the number of rows, without a cap, so a cell holds about as many rows as there are cells
at any size; their centres are trained by Lloyd's rounds over all rows (a job a round, sums for each cell added up by
Spark). A row keeps its cell and the residual to its centre in steps of the largest residual over 127. A query meets its
PROBES nearest cells, coded against each centre in turn: cells and probes meet in parts of bounded size, so a cell of a
third of all rows is no hot group. The score is 64 times the codes' squared distance plus the distance of two-component
sketches, 63 at most: every step from the codes on is exact in whole numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quantise, tiles
from .fingerprints import EVERY, asked, vectors_of
from .topk import topk

ROUNDS, PROBES, PART, K = 3, 8, 4096, 10
SKETCH, SHIFT = 256, 4  # fixed values: scale of a sketch, and what its distance is shifted by


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, at nine digits."""
    return np.round(np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T, 0), 9)


def train(v: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Centres from rows evenly spaced in the order of doc_id; a cell without rows keeps its centre."""
    c = quantise.numbered(v, lambda n: [i * (n // (math.isqrt(n - 1) + 1)) for i in range(math.isqrt(n - 1) + 1)] if n else [])
    for _ in range(rounds if len(c) else 0):
        now = c

        def part(x: np.ndarray, now=now) -> np.ndarray:
            out = np.zeros((len(now), now.shape[1] + 1))
            for at in range(0, len(x), 1024):
                own = x[at : at + 1024]
                np.add.at(out, distances(own, now).argmin(axis=1), np.hstack([own, np.ones((len(own), 1))]))
            return out.ravel()

        sums = quantise.summed(v, part, c.size + len(c)).reshape(len(c), -1)
        n = sums[:, -1:]
        c = np.where(n > 0, np.round(sums[:, :-1] / np.maximum(n, 1), 9), c)
    return c


def celled(v: DataFrame, c: np.ndarray, n: int) -> DataFrame:
    """The id, the n nearest cells (a row for each) and the residual to each centre."""
    shared = v.sparkSession.sparkContext.broadcast(c)  # the square root of the number of rows times the components
    first = v.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x = tiles.matrix(b.column(1))
                near = np.argsort(distances(x, c), axis=1, kind="stable")[:, :n]
                rest = (x[:, None] - c[near]).reshape(-1, x.shape[1])
                ids = b.column(0).take(pa.array(np.repeat(np.arange(len(x)), near.shape[1])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(near.ravel()), pa.array(list(rest), pa.list_(pa.float64()))], [first, "cell", "rest"])

    return v.mapInArrow(run, f"{first} long, cell long, rest array<double>")


def codes(rest: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number codes and two-component sketches of residuals."""
    return np.floor(rest / step + 0.5), np.floor(rest[:, :2] * SKETCH)


def fused(q: tuple, x: tuple) -> np.ndarray:
    """Queries x rows: whole numbers, exact in double precision."""
    apart = lambda a, b: (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return 64 * apart(q[0], x[0]) + np.minimum(apart(q[1], x[1]).astype(np.int64) >> SHIFT, 63)


def residual_search(v: DataFrame, queries: DataFrame, k: int = K, probes: int = PROBES) -> DataFrame:
    """query_id, rank, doc_id, score: the k least fused scores in the query's `probes` nearest cells, without itself."""
    none = v.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, score long")
    c = train(v)
    if not len(c):
        return none
    own = celled(v, c, 1)
    step = own.agg(F.max(F.array_max(F.transform("rest", F.abs)))).first()[0] / 127 or 1.0
    parts = own.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    rows = own.join(parts, "cell").select("cell", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), "doc_id", "rest")
    asks = celled(queries, c, probes).join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "q_id", "rest")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            docs, ids = left["doc_id"].to_numpy(), right["q_id"].to_numpy()
            own = codes(tiles.matrix(left["rest"]), step)
            asked_codes = codes(tiles.matrix(right["rest"]), step)
            for at in range(0, len(ids), 256):
                some = slice(at, at + 256)
                score = fused(tuple(a[some] for a in asked_codes), own)
                for i, q in enumerate(ids[some]):
                    fine = np.flatnonzero(docs != q)
                    best = fine[np.lexsort((docs[fine], score[i, fine]))[:k]]
                    out[0].append(np.full(len(best), q)), out[1].append(docs[best]), out[2].append(score[i, best])
        a, b, s = (np.concatenate(o).astype(np.int64) if o else np.empty(0, np.int64) for o in out)
        return pa.table({"query_id": a, "doc_id": b, "score": s})

    found = rows.groupBy("cell", "part").cogroup(asks.groupBy("cell", "part")).applyInArrow(meet, "query_id long, doc_id long, score long")
    return topk(found, k, ["query_id"], [F.asc("score"), F.asc("doc_id")]).select("query_id", "rank", "doc_id", "score")


def residual_topk(spark, sf_dir) -> DataFrame:
    """The stated queries in the inverted file of residuals."""
    v = tiles.usable(vectors_of(spark, sf_dir)).select("doc_id", "embedding")
    return residual_search(v, asked(v))


def residual_cells(spark, sf_dir) -> DataFrame:
    """Each trained cell's number of rows, and its gateway: the row with the least code norm."""
    v = tiles.usable(vectors_of(spark, sf_dir)).select("doc_id", "embedding")
    c = train(v)
    if not len(c):
        return spark.createDataFrame([], "cell long, n long, gateway long")
    own = celled(v, c, 1)
    step = own.agg(F.max(F.array_max(F.transform("rest", F.abs)))).first()[0] / 127 or 1.0
    norm = F.aggregate(F.transform("rest", lambda x: F.pow(F.floor(x / step + 0.5), 2)), F.lit(0.0), lambda s, x: s + x)
    return own.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min_by("doc_id", F.struct(norm, F.col("doc_id"))).alias("gateway"))


def _sql() -> str:
    """CTEs up to x (id, cell, component i, residual r, code, sketch s) of every row's own cell and p, the same of the queries' probed cells."""
    out = ["v AS MATERIALIZED (SELECT vec_id AS id, unnest(range(64))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)", "o AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n, ceil(sqrt(count(*) OVER ()))::BIGINT AS cells FROM embeddings)", "c0 AS MATERIALIZED (SELECT r // (n // cells) AS cell, i, x AS value FROM o JOIN v USING (id) WHERE r % (n // cells) = 0 AND r // (n // cells) < cells)"]
    for t in range(ROUNDS + 1):
        out.append(f"d{t} AS MATERIALIZED (SELECT id, cell, round(sum((x - value) * (x - value)), 9) AS d FROM v JOIN c{t} USING (i) GROUP BY ALL), a{t} AS MATERIALIZED (SELECT id, arg_min(cell, (d, cell)) AS cell FROM d{t} GROUP BY id)")
        if t < ROUNDS:
            out.append(f"c{t + 1} AS MATERIALIZED (SELECT cell, i, coalesce(m, value) AS value FROM c{t} LEFT JOIN (SELECT cell, i, round(avg(x), 9) AS m FROM v JOIN a{t} USING (id) GROUP BY ALL) USING (cell, i))")
    coded = "floor(r / step + 0.5)::BIGINT AS code, floor(r * 256)::BIGINT AS s"
    out.append(f"e AS MATERIALIZED (SELECT id, cell, i, x - value AS r FROM v JOIN a{ROUNDS} USING (id) JOIN c{ROUNDS} USING (cell, i)), st AS (SELECT max(abs(r)) / 127 AS step FROM e)")
    out.append(f"x AS MATERIALIZED (SELECT id, cell, i, {coded} FROM e, st), p AS MATERIALIZED (SELECT id, cell, i, {coded} FROM (SELECT id, cell, i, x - value AS r FROM (SELECT id, cell FROM d{ROUNDS} WHERE id % {EVERY} = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cell) <= {PROBES}) JOIN v USING (id) JOIN c{ROUNDS} USING (cell, i)), st)")
    return ", ".join(out)


QUERIES = {
    "residual_topk": (residual_topk, f"WITH {_sql()}, m AS (SELECT p.id AS query_id, x.id AS doc_id, (64 * sum((p.code - x.code) ** 2) + least(sum(CASE WHEN i < 2 THEN (p.s - x.s) ** 2 ELSE 0 END)::BIGINT >> {SHIFT}, 63))::BIGINT AS score FROM p JOIN x USING (cell, i) WHERE p.id <> x.id GROUP BY ALL) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id)::INT AS rank, doc_id, score FROM m QUALIFY rank <= {K}"),
    "residual_cells": (residual_cells, f"WITH {_sql()}, n AS (SELECT cell, id, sum(code * code) AS norm FROM x GROUP BY ALL) SELECT cell, count(*) AS n, arg_min(id, (norm, id)) AS gateway FROM n GROUP BY 1"),
}
