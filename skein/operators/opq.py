"""Product quantisation in a trained rotation.

A round is one job. Tasks sum, for every word of every subspace, the rows that are nearest to it (whole rows, not just the
subspace) and their number; Spark adds the sums up: SUBSPACES * CODES * (dim + 1) numbers, whatever the number of rows.
From these sums alone come the new words and the cross moments of rows and what the words make of them, and so the
rotation that brings the two closest (Procrustes, by SVD). Neither step can raise the mean squared error."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from . import quantise, tiles
from .fingerprints import POOL, asked, sides, vectors_of
from .quantise import CODES
from .topk import topk

#: A byte for every four components.
SUBSPACES, WIDTH = 16, 4
#: Rounds with a rotation, after quantise.ROUNDS without one.
TURNS = 8


@dataclass(frozen=True)
class Rotated:
    """Rows times `turn` are coded by the words of `book`."""

    turn: np.ndarray
    book: np.ndarray


def plain_words(v: DataFrame) -> np.ndarray:
    return quantise.train(v, subspaces=SUBSPACES, width=WIDTH)


def train(v: DataFrame, turns: int = TURNS) -> Rotated | None:
    """The rotation and words of v's vectors of SUBSPACES * WIDTH components; None without rows."""
    book = plain_words(v)
    if not book.shape[1]:
        return None
    dim = SUBSPACES * WIDTH
    turn = np.eye(dim)
    for _ in range(turns):
        now, held = turn, book

        def part(x: np.ndarray, now=now, held=held) -> np.ndarray:
            out, y = np.zeros((SUBSPACES, CODES, dim + 1)), x @ now
            wide = np.hstack([x, np.ones((len(x), 1))])
            for j in range(SUBSPACES):
                np.add.at(out[j], quantise.nearest_code(y[:, j * WIDTH : (j + 1) * WIDTH], held[j]), wide)
            return out.ravel()

        sums = quantise.summed(v, part, SUBSPACES * CODES * (dim + 1)).reshape(SUBSPACES, CODES, dim + 1)
        rows, n = sums[..., :-1], sums[..., -1:]
        cross = np.empty((dim, dim))
        new = np.empty_like(book)
        for j in range(SUBSPACES):
            own = (rows[j] @ turn)[:, j * WIDTH : (j + 1) * WIDTH]
            new[j] = np.where(n[j] > 0, own / np.maximum(n[j], 1), book[j])
            cross[:, j * WIDTH : (j + 1) * WIDTH] = rows[j].T @ new[j]
        u, _, vt = np.linalg.svd(cross)
        turn, book = u @ vt, new
    return Rotated(turn, book)


def turned(v: DataFrame, turn: np.ndarray, column: str = "embedding") -> DataFrame:
    """The id and the rotated vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = tiles.matrix(b.column(1)) @ turn if b.num_rows else np.empty((0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(y), pa.list_(pa.float64()))], [first, column])

    first = v.columns[0]
    return v.select(first, column).mapInArrow(run, f"{first} long, {column} array<double>")


def error(v: DataFrame, book: np.ndarray) -> float:
    """The mean squared distance of the vectors to what their words make."""

    def part(x: np.ndarray) -> np.ndarray:
        made = np.hstack([book[j][quantise.nearest_code(x[:, j * WIDTH : (j + 1) * WIDTH], book[j])] for j in range(SUBSPACES)])
        return np.array([((x - made) ** 2).sum(), len(x)])

    total, n = quantise.summed(v, part, 2)
    return total / max(n, 1)


def _rows(spark, sf_dir) -> DataFrame:
    return tiles.usable(vectors_of(spark, sf_dir)).where(F.size("embedding") == SUBSPACES * WIDTH).select("doc_id", "embedding")


def opq_error(spark, sf_dir) -> DataFrame:
    """The mean squared error of plain words and of words in the rotation."""
    v = _rows(spark, sf_dir)
    model, plain = train(v), plain_words(v)
    rows = [("opq", error(turned(v, model.turn), model.book)), ("pq", error(v, plain))] if model else []
    return spark.createDataFrame([(m, float(e)) for m, e in rows], "method string, error double")


def opq_adc_topk(spark, sf_dir, k=10) -> DataFrame:
    """Asymmetric distance of the rotated query to each code's words."""
    v = _rows(spark, sf_dir)
    model = train(v)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    y = turned(v, model.turn)
    return quantise.adc_topk(y, model.book, asked(y), k)


def opq_rerank_topk(spark, sf_dir) -> DataFrame:
    """The pool by asymmetric distance, re-scored by the vectors themselves."""
    near = sides(opq_adc_topk(spark, sf_dir, POOL), vectors_of(spark, sf_dir).select("doc_id", "embedding"))
    s = near.select(F.col("q_id").alias("query_id"), "doc_id", (F.round(vectors.l2_sq(F.col("q_embedding"), F.col("embedding")), 6) + F.lit(0.0)).alias("score"))
    return topk(s, 10, ["query_id"], [F.asc("score"), F.asc("doc_id")])


#: Trained by turns of two steps over all rows: no SQL; tests/test_models.py compares them with numpy.
QUERIES = {"opq_error": (opq_error, None), "opq_adc_topk": (opq_adc_topk, None), "opq_rerank_topk": (opq_rerank_topk, None)}
