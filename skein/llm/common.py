"""Shared pieces: the scratch folder, staged tables, words and n-gram hashes, hash blobs."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct words whose hash or ids a Python worker keeps; the rest are computed anew each time.
CACHE_WORDS = 250_000
CACHE_WORD_BYTES = 48

_LOCAL: str | None = None


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary folder of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _LOCAL
    if _LOCAL is None or not os.path.isdir(_LOCAL):
        _LOCAL = tempfile.mkdtemp(prefix="skein-")
    return f"file://{_LOCAL}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch(spark)}/skein-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared store through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def column_named(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores added until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def hash_share(df: DataFrame, key: Column, most: int, n: int) -> DataFrame:
    """Of df's n rows those whose 64-bit hash is in the lowest share, which holds `most` of them with a margin; all, if they are fewer. Who takes the first `most` by the hash gets the same rows from it, and no task sends more than its share to the driver."""
    share = (1.1 * most + 200) / max(1, n)
    return df if share >= 1 else df.where(key <= int(share * 2.0**64) - 2**63)


def utf8(name: str):
    """The column's UTF-8 bytes; Python then needs no decoding."""
    return F.col(f"`{name}`").cast("string").cast("binary")


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about `most` bytes in the column, or one row."""
    sizes = np.cumsum(np.append(0, pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


# --- memory of a Python worker ---------------------------------------------------------------------------


_KEPT: dict = {}


def kept(name, make: Callable):
    """What make() made for `name` in this Python worker, which lives on from batch to batch and from stage to stage. A worker keeps one such thing: that of another name goes first."""
    if _KEPT.get("name") != name:
        _KEPT.clear()
        release()
        _KEPT.update(name=name, value=make())
    return _KEPT["value"]


def release() -> None:
    """Give freed memory back to the system; workers that wait would keep it."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(_libc(), "malloc_trim", None)) is not None:
        trim(0)


@lru_cache(1)
def _libc():
    try:
        return ctypes.CDLL(None)
    except (OSError, TypeError):
        return None


def tidy(run: Callable) -> Callable:
    """run, for one group or two cogrouped ones of bounded size, and release() after it. (Spark counts the arguments.)"""

    def one(t):
        try:
            return run(t)
        finally:
            release()

    def two(left, right):
        try:
            return run(left, right)
        finally:
            release()

    return one if run.__code__.co_argcount == 1 else two


# --- words -----------------------------------------------------------------------------------------------


def words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and \\x09-\\x0D, which are just what bytes.split() cuts at."""
    return text.split() if text else []


class WordHash(dict):
    """Word to 64-bit hash, remembering up to CACHE_WORDS short words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS and len(word) <= CACHE_WORD_BYTES:
            self[word] = h
        return h

    def array(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def word_hash() -> WordHash:
    """This worker's WordHash."""
    return kept("words", WordHash)


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def ngrams(h: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """Hashes of the n-word windows of a row of word hashes, one for each start."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for j, k in enumerate(_odd(n, seed)):
        out += h[j : j + m] * k
    return mix(out)


# --- blobs of sorted keys --------------------------------------------------------------------------------


def pack_sorted(keys: np.ndarray, z: zstandard.ZstdCompressor | None = None) -> bytes:
    """Ascending uint64 keys as deltas, byte planes apart, compressed."""
    d = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return (z or zstandard.ZstdCompressor(level=1)).compress(d.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def bucket_edges(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each of so many equal ranges of bits-wide keys starts in the ascending keys; one more entry than buckets."""
    at = (np.arange(1, buckets, dtype=object) * (1 << bits) // buckets).astype(np.uint64) if buckets > 1 else np.empty(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, at), [len(keys)]]).astype(np.int64)


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Index of the first of each run of equal keys."""
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
