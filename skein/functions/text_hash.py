"""128-bit fingerprints of texts from their tokens: by position, saturating, and as a bag of words. numpy on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

M = (1 << 64) - 1
#: The token hash's multiplier, which is also the generator's step, and the generator's two multipliers.
STEP, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3  # fixed values
SATURATION, BAG_BITS = 10, 4  # fixed values


def mixed(state: np.ndarray) -> np.ndarray:
    """The generator's finaliser."""
    with np.errstate(over="ignore"):
        z = (state ^ (state >> np.uint64(30))) * np.uint64(MIX1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX2)
    return z ^ (z >> np.uint64(31))


def two_words(seeds: np.ndarray) -> np.ndarray:
    """The generator's first two values from each seed: rows x 2."""
    with np.errstate(over="ignore"):
        return np.stack([mixed(seeds + np.uint64(STEP)), mixed(seeds + np.uint64(2 * STEP & M))], axis=1)


def token_hash(token: bytes, seed: int = 0) -> int:
    for b in token:
        seed = (seed * STEP + b) & M
    return seed


def fnv1(data: bytes, xor_first: bool) -> int:
    """FNV-1a if xor_first, else FNV-1."""
    h = FNV_BASIS
    for b in data:
        h = (h ^ b) * FNV_PRIME & M if xor_first else h * FNV_PRIME & M ^ b
    return h


def bits_of(words: np.ndarray) -> np.ndarray:
    """rows x 128 of 0 and 1, the lowest bit of the first word first."""
    return np.unpackbits(np.ascontiguousarray(words.astype("<u8")).view(np.uint8).reshape(len(words), 16), axis=1, bitorder="little")


def words_of(bits: np.ndarray) -> tuple[int, int]:
    a = np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")
    return int(a[0]), int(a[1])


def ordered(hashes: np.ndarray) -> tuple[int, int]:
    """Majority of the tokens' bits, each token's hash with its place worked in."""
    return words_of(2 * bits_of(two_words(hashes ^ np.arange(len(hashes), dtype=np.uint64))).sum(axis=0, dtype=np.int64) > len(hashes)) if len(hashes) else (0, 0)


def saturating(hashes: np.ndarray) -> tuple[int, int]:
    """The same, but a bit stands still once its sum is SATURATION either way."""
    if not len(hashes):
        return 0, 0
    sums = (2 * bits_of(two_words(hashes ^ np.arange(len(hashes), dtype=np.uint64))).astype(np.int64) - 1).cumsum(axis=0)
    full = np.abs(sums) >= SATURATION
    at = np.where(full.any(axis=0), full.argmax(axis=0), len(hashes) - 1)
    return words_of(sums[at, np.arange(128)] > 0)


def bag(hashes: np.ndarray) -> tuple[int, int]:
    """Each token sets BAG_BITS bits, named by the seven-bit pieces of its 128 bits from the lowest up; the second word is the lower one."""
    out = np.zeros(128, bool)
    if len(hashes):
        low = two_words(hashes)[:, 1]
        for k in range(BAG_BITS):
            out[(low >> np.uint64(7 * k) & np.uint64(127)).astype(np.int64)] = True
    return words_of(out)


FORMS: dict[str, Callable] = {"ordered": ordered, "saturating": saturating, "bag": bag}


def fingerprinted(df: DataFrame, text: str = "text", form: str = "ordered", seed: int = 0) -> DataFrame:
    """df with t0 and t1, the words of its texts' fingerprints; a null text has none. Tokens are split at white space."""
    kept, make = df.columns, FORMS[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            got = []
            for t in b.column(kept.index(text)).to_pylist():
                if t is None:
                    got.append((None, None))
                    continue
                if len(known) > 200_000:
                    known.clear()
                hashes = [known[w] if w in known else known.setdefault(w, token_hash(w.encode(), seed)) for w in t.split()]
                got.append(make(np.array(hashes, np.uint64)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], [*kept, "t0", "t1"])

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", t0 long, t1 long")


def seed_words(text: str) -> tuple[int, int]:
    """The two words that a seed text names."""
    w = two_words(np.array([fnv1(text.encode(), False)], np.uint64))[0].astype("<u8").view("<i8")
    return int(w[0]), int(w[1])


@F.udf(LongType())
def fnv1a(data: bytes) -> int:
    """FNV-1a of bytes, as a signed number. For small inputs such as fingerprints."""
    h = fnv1(bytes(data), True)
    return h - (1 << 64) if h >> 63 else h
