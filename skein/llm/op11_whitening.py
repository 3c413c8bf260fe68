"""Embedding whitening: upper-triangle column aggregates.

1. Entries become whole numbers; one aggregation gives the number of vectors and the exact sum of each dimension.
2. Spark SQL expressions are generated, one for each pair of dimensions i <= j: the sum of the products of the two centred
   columns. One aggregation computes them all; Spark adds them up in each task before anything is shuffled.
3. The driver assembles the covariance, dim x dim numbers, and LAPACK decomposes it.
4. Each batch of rows is projected with one matrix product, and written once. The same aggregation over the written columns
   measures how far their covariance is from the identity.

Nothing but sums of dim * (dim + 1) / 2 numbers comes to the driver, whatever the number of rows; the model is as large.

Results: vectors that are null, empty, of another length than most (of lengths equally frequent the smaller one), or that
hold null or non-finite entries (or such as 2**53 / 64 and beyond, whose 64-fold is no exact whole number) take no part.
Components with an eigenvalue of at most RANK times the largest are left out: there the rows are constant. So one row, or
equal rows alone, give an empty result, as does an empty table. Repeated and null vec_ids are rows of their own; equal
eigenvalues come in LAPACK's order; a deviation that exceeds a long is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000  # fixed values of the contract
RANK = 1e-10
WHITENED = "vec_id long, deviation long, whitened array<double>"


@dataclass(frozen=True)
class Model:
    """n vectors with the sums of their dimensions; eigenvalues falling, one column of `components` for each; trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> list[float]:
        return [s / self.n for s in self.sums]


def whole_numbers(table: DataFrame) -> DataFrame:
    """vec_id and x (array<long>) of the rows that take part."""
    c = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    fine = F.forall("c", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < 2.0**53 / SCALE))
    c = c.where(F.col("c").isNotNull() & (F.size("c") > 0)).where(fine)
    size = c.groupBy(F.size("c").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    c = c.join(F.broadcast(size.select("n")), F.size("c") == F.col("n"), "left_semi")  # one row
    return c.select("vec_id", F.transform("c", lambda e: F.floor(e * SCALE).cast("long") + F.lit(OFFSET).cast("long")).alias("x"))


def totals(x: DataFrame, column: str, dim: int) -> list:
    """The number of rows, then the sum of each dimension."""
    return list(x.selectExpr("count(1)", *(f"sum({column}[{i}])" for i in range(dim))).first())


def covariance(x: DataFrame, column: str, mean: list[float], n: int) -> np.ndarray:
    """The covariance of an array column of n rows, divisor n, in one aggregation of a sum for each pair of dimensions."""
    dim = len(mean)
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    centred = x.selectExpr(*(f"CAST({column}[{i}] AS DOUBLE) - ({m!r}D) AS c{i}" for i, m in enumerate(mean)))
    found = centred.selectExpr(*(f"sum(c{i} * c{j}) AS s{i}_{j}" for i, j in pairs)).first()
    out = np.zeros((dim, dim))
    for (i, j), s in zip(pairs, found, strict=True):
        out[i, j] = out[j, i] = s / n
    return out


def fit(x: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The whitening of all rows of x; None if there are none, or all are equal."""
    first = x.select(F.size("x")).first()
    if first is None:
        return None
    n, *sums = totals(x, "x", first[0])
    v = covariance(x, "x", [s / n for s in sums], n)
    values, vectors = np.linalg.eigh(v)
    keep = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > RANK * values.max()]
    if not keep:
        return None
    chosen = vectors[:, keep]
    sign = np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(len(keep))])
    return Model(n, tuple(sums), values[keep], chosen * sign, float(np.trace(v)))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sums of (n x - S)^2 over the dimensions, exactly: in 64 bits where they suffice, else in Python's whole numbers."""
    most, side = int(np.abs(x).max(initial=0)), max(map(abs, sums))
    if n * most + side < 2**62:
        d = x * n - np.array(sums, np.int64)
        if int(np.abs(d).max(initial=0)) ** 2 * x.shape[1] < 2**63:
            return (d * d).sum(axis=1).tolist()
    exact = (sum((n * e - s) ** 2 for e, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [v if v < 2**63 else None for v in exact]


def whiten(x: DataFrame, model: Model) -> DataFrame:
    """vec_id, deviation and whitened (a number for each component) of each row of x."""
    mean, turn = np.array(model.mean), model.components / np.sqrt(model.values)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            rows = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            w = (rows - mean) @ turn
            at = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviations(rows, model.n, model.sums), pa.int64()), pa.ListArray.from_arrays(at, pa.array(w.ravel()))], ["vec_id", "deviation", "whitened"])

    return x.mapInArrow(run, WHITENED)


def identity_error(white: DataFrame, n: int, dim: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    _, *sums = totals(white, "whitened", dim)
    return float(np.abs(covariance(white, "whitened", [s / n for s in sums], n) - np.eye(dim)).max())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors: a row for each of their first 32 components."""
    x = whole_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    model = fit(x)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = common.staged(whiten(x, model), "whitened")
    error = identity_error(white, model.n, len(model.values))
    share = F.array(*(F.lit(float(e / model.trace)) for e in model.values))
    rows = white.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(error).alias("identity_error")
    )
