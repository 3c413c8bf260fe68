"""512-bit sign fingerprints of vectors: a fixed or trained projection, and its bits packed into eight BIGINT words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

BITS = 512
WORDS = [f"h{k}" for k in range(BITS // 64)]


def projection(dim: int, bits: int = BITS) -> np.ndarray:
    """The fixed model: dim x bits whole numbers from -1001 to 1001, quadratic in both places, the same in SQL."""
    i, j = np.arange(1, dim + 1, dtype=np.int64)[:, None], np.arange(1, bits + 1, dtype=np.int64)
    return ((i * j * 7919 + i * i * 104_729 + j * j * 1_299_709 + i * i * j * 31) % 2003 - 1001).astype(np.float64)


#: The same in DuckDB: bits of each vector, the first one the most significant of its word.
PROJECTION_SQL = "proj AS MATERIALIZED (SELECT j, list((((i + 1) * (j + 1) * 7919 + (i + 1) * (i + 1) * 104729 + (j + 1) * (j + 1) * 1299709 + (i + 1) * (i + 1) * (j + 1) * 31) % 2003 - 1001)::DOUBLE ORDER BY i) AS v FROM range(512) a(j), range(64) b(i) GROUP BY j)"


def sql_words(bits: str = "bits") -> str:
    """h0 to h7 of a list of 512 bits."""
    return ", ".join(f"(list_sum(list_transform(range(1, 64), lambda t: {bits}[{64 * k} + t + 1]::BIGINT << (63 - t)::INT)) + {bits}[{64 * k + 1}] * (-9223372036854775808)::HUGEINT)::BIGINT AS h{k}" for k in range(8))


SQL = f"""{PROJECTION_SQL},
z AS MATERIALIZED (SELECT vec_id AS doc_id, list((list_dot_product(embedding::DOUBLE[], v) > 0)::INT ORDER BY j) AS bits FROM embeddings, proj GROUP BY vec_id),
h AS MATERIALIZED (SELECT z.doc_id, label, embedding, {sql_words()}, list_transform(range(64), lambda i: list_sum(list_transform(range(8), lambda t: bits[8 * i + t + 1] << (7 - t)::INT))::BIGINT) AS b FROM z JOIN embeddings ON vec_id = doc_id)"""


def train_itq(x: np.ndarray, bits: int = BITS, rounds: int = 50, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection by iterative quantisation on a bounded sample: alternately the signs of the projected rows, and the projection with orthonormal rows that comes nearest to them (Procrustes, by SVD)."""
    mean = x.mean(axis=0)
    c = x - mean
    wide = np.random.default_rng(seed).normal(size=(bits, bits))
    p = np.linalg.qr(wide)[0][: x.shape[1]]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(c.T @ np.where(c @ p > 0, 1.0, -1.0), full_matrices=False)
        p = u @ vt
    return mean, p


def packed(x: np.ndarray, mean: np.ndarray, p: np.ndarray, at_zero: bool = False) -> np.ndarray:
    """rows x words: the signs of (x - mean) p, most significant bit first; at_zero says whether a zero sets the bit."""
    s = (x - mean) @ p
    return np.packbits(s >= 0 if at_zero else s > 0, axis=1).view(">i8").astype(np.int64)


def encoded(df: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, column: str = "embedding", at_zero: bool = False) -> DataFrame:
    """df with h0 to h7 of its vectors; null for null vectors and those of another length than the model's (without one: each length has its fixed projection)."""
    kept = df.columns
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most dim x 512 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for b in batches:
            vectors = b.column(kept.index(column))
            length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            out, told = np.zeros((b.num_rows, len(WORDS)), np.int64), np.zeros(b.num_rows, bool)
            for dim in np.unique(length[length > 0]).tolist():
                mean, p = shared.value or made.setdefault(dim, (np.zeros(dim), projection(dim)))
                if len(mean) != dim:
                    continue
                rows = np.flatnonzero(length == dim)
                flat = vectors.take(pa.array(rows)).flatten()
                whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, dim).any(axis=1)
                x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)[whole]
                out[rows[whole]], told[rows[whole]] = packed(x, mean, p, at_zero), True
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(out[:, k], mask=~told) for k in range(len(WORDS)))], [*kept, *WORDS])

    return df.mapInArrow(run, StructType([*df.schema.fields, *(StructField(w, LongType()) for w in WORDS)]))


def byte(i: int):
    """The i-th of a fingerprint's 64 bytes."""
    return F.shiftrightunsigned(F.col(WORDS[i // 8]), 56 - 8 * (i % 8)).bitwiseAND(F.lit(255).cast("long"))


def all_bytes():
    return F.array(*(byte(i) for i in range(BITS // 8)))
