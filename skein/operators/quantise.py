"""Product quantisation, cells and second moments of vectors. Models are of bounded size and live on the driver; rows are coded and summed in their tasks with numpy."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import scratch
from . import tiles
from .fingerprints import asked
from .topk import topk

SUBSPACES, WIDTH, CODES, ROUNDS = 8, 8, 256, 10  # fixed values: codes and rounds
SEED_STEP = 7919  # fixed value: the k-th first word is row (k * 7919) % n
MOST_CELLS, FIRST_PROBES = 4096, 4
#: Rows of a cell that meet its queries at a time; numbers that a task holds while it measures rows against all centres.
PART, LEAPS = 16_384, 1 << 22


def _with(df: DataFrame, more: str) -> StructType:
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def matrix(b: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a batch that are not null, and their rows. (tiles.usable() leaves those of one length.)"""
    v = b.column(b.schema.get_field_index(column))
    fine = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
    return tiles.matrix(v.take(pa.array(fine))), fine


def summed(df: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of part(vectors of a batch), which has `size` numbers: one row a task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            x, _ = matrix(b, "embedding")
            if len(x):
                total += part(x)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "value"])

    got = df.select("embedding").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(size)
    out[got["at"].to_numpy()] = got["value"].to_numpy()
    return out


def nearest_code(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each row of x the nearest word, the first of equals at nine digits."""
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 256):
        d = ((x[at : at + 256, None] - words) ** 2).sum(axis=2)
        out[at : at + 256] = np.round(d, 9).argmin(axis=1)
    return out


def numbered(v: DataFrame, wanted: Callable[[int], list[int]], cells: int = 65_536) -> np.ndarray:
    """The vectors whose places in the order of doc_id are wanted(number of rows), in that order: counts of equal ranges of doc_id say which ranges hold them, and only those are numbered."""
    v = v.where("embedding is not null")
    n, low, high = v.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    places = wanted(n) if n else []
    if not places:
        return np.empty((0, 0))
    width = max(1, -(-(high - low + 1) // cells))
    b = v.where("doc_id is not null").withColumn("cell", F.floor((F.col("doc_id") - low) / width))
    counts = sorted(b.groupBy("cell").count().collect())  # at most `cells` rows
    ends = np.cumsum([c for _, c in counts])
    spark = v.sparkSession
    held = sorted({int(np.searchsorted(ends, p, "right")) for p in places})
    base = spark.createDataFrame([(int(counts[i][0]), int(ends[i] - counts[i][1])) for i in held], "cell long, base long")
    rows = b.join(F.broadcast(base), "cell").withColumn("place", F.col("base") + F.row_number().over(Window.partitionBy("cell").orderBy("doc_id")) - 1)
    got = rows.join(F.broadcast(spark.createDataFrame([(p,) for p in sorted(set(places))], "place long")), "place").select("place", "embedding").collect()  # as many as places
    by = {r.place: r.embedding for r in got}
    return np.array([by[p] for p in places], np.float64)


def train(v: DataFrame, rounds: int = ROUNDS, codes: int = CODES, subspaces: int = SUBSPACES, width: int = WIDTH) -> np.ndarray:
    """Words of each subspace after `rounds` of Lloyd over all rows; a code without rows keeps its word."""
    first = numbered(v, lambda n: [(k * SEED_STEP) % n for k in range(codes)])
    if not len(first):
        return np.zeros((subspaces, 0, width))
    book = np.stack([first[:, j * width : (j + 1) * width] for j in range(subspaces)])
    for _ in range(rounds):
        now = book

        def part(x: np.ndarray, now=now) -> np.ndarray:
            out = np.zeros((subspaces, codes, width + 1))
            for j in range(subspaces):
                own = x[:, j * width : (j + 1) * width]
                np.add.at(out[j], nearest_code(own, now[j]), np.hstack([own, np.ones((len(own), 1))]))
            return out.ravel()

        sums = summed(v, part, subspaces * codes * (width + 1)).reshape(subspaces, codes, width + 1)
        n = sums[..., -1:]
        book = np.where(n > 0, np.round(sums[..., :-1] / np.maximum(n, 1), 9), book)
    return book


def coded(v: DataFrame, book: np.ndarray) -> DataFrame:
    """doc_id and codes (one for each subspace) of every vector."""
    subspaces, _, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rows = matrix(b, "embedding")
            c = np.stack([nearest_code(x[:, j * width : (j + 1) * width], book[j]) for j in range(subspaces)], axis=1) if len(x) else np.empty((0, subspaces), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(c.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["doc_id", "codes"])

    return v.select("doc_id", "embedding").mapInArrow(run, "doc_id long, codes array<int>")


def made(codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The vectors that rows of codes stand for."""
    return np.hstack([book[j][own] for j, own in enumerate(codes.astype(np.int64).T)])


def adc_topk(v: DataFrame, book: np.ndarray, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc_id, score: the k nearest codes of each query by the distance of its vector to what the codes' words make, which is the sum over subspaces of the distances to the words. Codes and queries alone are shuffled; a tile makes the vectors of a part at a time."""
    return tiles.nearest(coded(v, book), queries.select("q_id", "q_embedding"), k, lambda q, own: np.round(tiles.l2_sq(q, made(own, book)), 6), True, True, v.count())


def symmetric_topk(v: DataFrame, book: np.ndarray, k: int) -> DataFrame:
    """query_id, rank, doc_id, score: the k nearest codes of each stated query's code, by the words of both."""
    c = coded(v, book)
    return tiles.nearest(c, asked(c), k, lambda q, own: np.round(tiles.l2_sq(made(q, book), made(own, book)), 6), True, True, v.count())


# --- cells -----------------------------------------------------------------------------------------------------


def centres(v: DataFrame) -> np.ndarray:
    """About the square root of the number of rows, evenly spaced in the order of doc_id, MOST_CELLS at most."""

    def places(n: int) -> list[int]:
        k = min(MOST_CELLS, math.isqrt(n - 1) + 1)
        return [i * (n // k) for i in range(k)]

    return numbered(v, places)


def celled(v: DataFrame, c: np.ndarray, n: int) -> DataFrame:
    """v with cell (its n nearest centres, a row for each; the first of equals at nine digits) and far, the distance to it."""
    kept = v.columns
    column = "q_embedding" if "q_embedding" in kept else "embedding"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, LEAPS // c.size)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                x, rows = matrix(b, column)
                if not len(x):
                    continue
                d = np.round(((x[:, None] - c) ** 2).sum(axis=2), 9)
                order = np.argsort(d, axis=1, kind="stable")[:, :n]
                out = b.take(pa.array(np.repeat(rows, order.shape[1])))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(order.ravel()), pa.array(np.sqrt(np.take_along_axis(d, order, 1)).ravel())], [*kept, "cell", "far"])

    return v.mapInArrow(run, _with(v, "cell long, far double")) if len(c) else v.withColumns({"cell": F.lit(0).cast("long"), "far": F.lit(0.0)}).limit(0)


def cell_search(v: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc_id, score: the k nearest by squared distance, exact.

    Cells and the queries that meet them are dealt to parts of bounded size, so a cell of most rows is no hot group; a part is a
    tile, which hands on the k best rows of each query that its bound does not rule out.
    A query first meets its FIRST_PROBES nearest cells, by an equi-join; its k-th distance there then rules out every cell whose
    centre is farther than that plus the cell's radius, and it meets the rest."""
    v, queries = v.select("doc_id", "embedding"), queries.select("q_id", "q_embedding")
    c = centres(v)
    own = scratch.staged(celled(v, c, 1), "cells")
    radius = dict(own.groupBy("cell").agg(F.max("far")).collect())  # at most MOST_CELLS rows

    parts = own.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    asks = max(1, -(-queries.count() // tiles.GROUP))
    block = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return tiles.best(np.empty((0, 1)), np.empty(0, np.int64), np.empty((0, 1)), np.empty(0, np.int64), k, tiles.l2_sq, True, True)
        ids, worst = right["q_id"].to_numpy(), right["worst"].to_numpy()
        t = tiles.best(tiles.matrix(right["q_embedding"]), ids, tiles.matrix(left["embedding"]), left["doc_id"].to_numpy(), k, tiles.rounded(tiles.l2_sq), True, True)
        order = np.argsort(ids, kind="stable")
        return t.filter(pa.array(t["score"].to_numpy() <= worst[order[np.searchsorted(ids, t["query_id"].to_numpy(), sorter=order)]]))

    def met(probes: DataFrame) -> DataFrame:
        """probes: q_id, q_embedding, cell and worst, the largest score of use."""
        rows = own.join(parts, "cell").select("cell", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), block(F.lit(asks)).alias("ask"), "doc_id", "embedding")
        wants = probes.join(parts, "cell").select("cell", block(F.col("parts")).alias("part"), F.pmod(F.xxhash64("q_id"), F.lit(asks)).cast("int").alias("ask"), "q_id", "q_embedding", "worst")
        return rows.groupBy("cell", "part", "ask").cogroup(wants.groupBy("cell", "part", "ask")).applyInArrow(tile, "query_id long, doc_id long, score double")

    probes = celled(queries, c, FIRST_PROBES).withColumn("worst", F.lit(float("inf"))).drop("far")
    first = scratch.staged(topk(met(probes), k, ["query_id"], [F.asc("score"), F.asc("doc_id")]), "cell-first")
    bound = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("score")).alias("worst")).select(F.col("query_id").alias("q_id"), "worst")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = np.array([radius.get(i, -np.inf) for i in range(len(c))])  # a cell without rows is never met
        for b in batches:
            x, rows = matrix(b, "q_embedding")
            worst = b.column(2).to_pylist()
            for row, own_x in zip(rows.tolist(), x, strict=True):
                d = np.round(((own_x - c) ** 2).sum(axis=1), 9)
                seen = np.argsort(d, kind="stable")[:FIRST_PROBES]
                far = np.sqrt(d) - reach - 1e-6
                may = far <= (np.inf if worst[row] is None else np.sqrt(worst[row] + 1e-6))
                may[seen] = False
                at = np.flatnonzero(may & np.isfinite(reach))
                if len(at):
                    out = b.slice(row, 1).take(pa.array(np.zeros(len(at), np.int64)))
                    most = np.inf if worst[row] is None else worst[row]
                    yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), pa.array(at), pa.array(np.full(len(at), most))], ["q_id", "q_embedding", "cell", "worst"])

    more = queries.join(bound, "q_id", "left").select("q_id", "q_embedding", "worst")
    second = met(more.mapInArrow(rest, _with(queries, "cell long, worst double"))) if len(c) else first.drop("rank").limit(0)
    return topk(first.drop("rank").unionByName(second), k, ["query_id"], [F.asc("score"), F.asc("doc_id")])


def gram(v: DataFrame, dim: int | None = None) -> DataFrame:
    """i, j, value for i <= j: the mean product of components i and j."""
    spark = v.sparkSession
    first = v.where("embedding is not null").select(F.size("embedding")).first()
    dim = dim or (first[0] if first else 0)
    total = summed(v, lambda x: np.append((x.T @ x).ravel(), len(x)), dim * dim + 1)
    g = total[:-1].reshape(dim, dim) / max(1.0, total[-1])
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(dim) for j in range(i, dim)], "i int, j int, value double")
