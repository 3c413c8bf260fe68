"""Search in the leading eigenvectors of second moments, of fingerprint bits or of vectors.

Tasks sum the products of each two columns with one matrix product a batch; Spark adds the partial matrices up, and the
driver gets dim x dim numbers. Its eigenvectors come one by one from the power iteration, each found direction taken out
of the matrix (with its eigenvalue) before the next. Rows are projected in their tasks and searched in tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encode
from . import tiles
from .fingerprints import HASHED, W, asked, vectors_of

AXES = 16
#: The power is 2**DOUBLINGS, reached by squaring the matrix; then so many plain steps take rounding errors out.
DOUBLINGS, STEPS = 24, 8


def bits_of(b: pa.RecordBatch) -> np.ndarray:
    """Rows x 512 of 0.0 and 1.0, the most significant bit of the first word first; the first column is the id."""
    words = np.stack([b.column(i + 1).to_numpy() for i in range(len(W))], axis=1) if b.num_rows else np.empty((0, len(W)), np.int64)
    return np.unpackbits(words.astype(">i8").view(np.uint8).reshape(len(words), -1), axis=1).astype(np.float64)


def vectors_in(b: pa.RecordBatch) -> np.ndarray:
    return tiles.matrix(b.column(1))


def products(rows: DataFrame, read: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """i, j, value for i <= j: the sum over all rows of the products of two columns; i = j = -1: the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                x = read(b)
                total, n = x.T @ x + (0 if total is None else total), n + len(x)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(np.append(total[i, j], float(n)))], ["i", "j", "value"])

    return rows.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def moments(rows: DataFrame, read: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The mean products, dim x dim; None without rows."""
    got = products(rows, read).toPandas()  # dim * (dim + 1) / 2 + 1 rows
    if not len(got):
        return None
    count = got.loc[got["i"] < 0, "value"].iloc[0]
    own = got[got["i"] >= 0]
    i, j = own["i"].to_numpy(), own["j"].to_numpy()
    out = np.zeros((i.max() + 1, i.max() + 1))
    out[i, j] = out[j, i] = own["value"].to_numpy() / count
    return out


def axes(m: np.ndarray, k: int = AXES) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their unit eigenvectors (columns; each sums to 0 or more), by power iteration and deflation."""
    values, found = [], []
    rest, start = m.copy(), np.random.default_rng(1).normal(size=len(m))
    for _ in range(min(k, len(m))):
        power = rest / max(np.abs(rest).max(), 1e-300)
        for _ in range(DOUBLINGS):
            power = power @ power
            power /= max(np.abs(power).max(), 1e-300)
        v = power @ start
        for step in range(STEPS + 1):
            v = rest @ v if step else v
            for u in found:
                v -= (u @ v) * u
            size = np.sqrt(v @ v)
            if size < 1e-12:
                return np.array(values), np.array(found).T.reshape(len(m), -1)
            v /= size
        values.append(float(v @ m @ v))
        found.append(v if v.sum() >= 0 else -v)
        rest = rest - values[-1] * np.outer(v, v)
    return np.array(values), np.array(found).T


def projected(rows: DataFrame, read: Callable[[pa.RecordBatch], np.ndarray], basis: np.ndarray) -> DataFrame:
    """The id and the coordinates of each row."""
    first = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(read(b) @ basis), pa.list_(pa.float64()))], [first, "at"])

    return rows.mapInArrow(run, f"{first} long, at array<double>")


def _words(spark, sf_dir) -> DataFrame:
    return tiles.word_columns(encode.encoded(tiles.usable(vectors_of(spark, sf_dir).select("doc_id", "embedding"))))


def _vectors(spark, sf_dir) -> DataFrame:
    return tiles.usable(vectors_of(spark, sf_dir)).select("doc_id", "embedding")


def _search(source, read):
    def run(spark, sf_dir) -> DataFrame:
        rows = source(spark, sf_dir)
        m = moments(rows, read)
        if m is None:
            return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
        at = projected(rows, read, axes(m)[1])
        return tiles.nearest(at, asked(at), 10, tiles.rounded(tiles.l2_sq), True, True, vectors_of(spark, sf_dir).count())

    return run


def bit_moments(spark, sf_dir) -> DataFrame:
    """For each two of the 512 bits, in how many fingerprints both are set."""
    return products(_words(spark, sf_dir), bits_of).where("i >= 0").select("i", "j", F.col("value").cast("long").alias("n"))


def spectral_axes(spark, sf_dir) -> DataFrame:
    """The leading axes of the bits' mean products: eigenvalue, and its share of their sum."""
    m = moments(_words(spark, sf_dir), bits_of)
    rows = [(i + 1, float(e), float(e / np.trace(m))) for i, e in enumerate(axes(m)[0])] if m is not None else []
    return spark.createDataFrame(rows, "axis int, eigenvalue double, share double").select("axis", F.round("eigenvalue", 6).alias("eigenvalue"), F.round("share", 6).alias("share"))


spectral_bits_topk = _search(_words, bits_of)
spectral_float_topk = _search(_vectors, vectors_in)

#: Eigenvectors have no SQL; tests/test_models.py compares these with numpy.
QUERIES = {
    "bit_moments": (bit_moments, f"WITH {HASHED}, k AS (SELECT j, list(b ORDER BY doc_id) AS v FROM (SELECT doc_id, unnest(range(512))::INT AS j, unnest(bits)::DOUBLE AS b FROM z) GROUP BY j) SELECT a.j AS i, c.j, list_dot_product(a.v, c.v)::BIGINT AS n FROM k a JOIN k c ON a.j <= c.j"),
    "spectral_axes": (spectral_axes, None), "spectral_bits_topk": (spectral_bits_topk, None), "spectral_float_topk": (spectral_float_topk, None),
}
