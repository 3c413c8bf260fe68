"""Documents as batches of bounded size, and exchanges of hashes between batches.

A corpus-wide question about hashes ("how often does it occur", "does it occur elsewhere") is asked batch by batch:
each batch sends its distinct hashes, sorted and packed, to buckets by ranges of the hash; a bucket answers with one
small value for each hash, in the order asked, and the answers come back to the batch. A hash that occurs in a third of
all rows is one entry of each batch, so no bucket is hot, and rows of the shuffle are blobs instead of hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Text of a batch and hashes of a bucket: what a Python worker holds at a time is some twenty times the first.
BATCH_BYTES = 8 << 20
BUCKET_HASHES = 1_500_000
KEY_BITS = 48
SENT = "bucket int, batch int, keys binary, extra binary"
REPLY = "batch int, bucket int, answer binary"


def sizes(docs: DataFrame, batch_bytes: int = BATCH_BYTES, bucket_hashes: int = BUCKET_HASHES) -> tuple[int, int]:
    """Numbers of batches and of buckets for docs, whose column `text` holds UTF-8 bytes."""
    n, total = docs.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    total = total or 0
    return max(1, -(-total // batch_bytes), -(-n // 16_384)), max(1, total // 6 // bucket_hashes)


def freeze(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=None)) as w:
        w.write(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def thaw(blobs) -> pa.Table:
    """One table of all blobs, which have one schema."""
    z = zstandard.ZstdDecompressor()
    return pa.concat_tables([pa.ipc.open_stream(z.decompress(b.as_py())).read_all() for b in blobs])


def gathered(packed: DataFrame, n: int) -> DataFrame:
    """Rows (batch, blob) with each batch in one partition, kept on disk because several passes read them; lost partitions are computed anew."""
    return packed.repartition(n, "batch").persist(StorageLevel.DISK_ONLY)


def split(rows: pa.RecordBatch, batch: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(batch, blob) for each batch number of the rows."""
    order = np.argsort(batch, kind="stable")
    for part in np.split(order, common.starts_of(batch[order])[1:]) if len(order) else ():
        yield pa.RecordBatch.from_arrays([pa.array([batch[part[0]]], pa.int32()), pa.array([freeze(rows.take(pa.array(part)))], pa.binary())], ["batch", "blob"])


def request(batch: int, keys: np.ndarray, extra: np.ndarray, buckets: int, bits: int = KEY_BITS) -> pa.Table:
    """SENT rows of one batch: its ascending keys and a value for each."""
    edges = common.bucket_edges(keys, buckets, bits)
    used = [i for i in range(buckets) if edges[i + 1] > edges[i]]
    parts = [slice(edges[i], edges[i + 1]) for i in used]
    return pa.table({
        "bucket": pa.array(used, pa.int32()), "batch": pa.array([batch] * len(used), pa.int32()),
        "keys": pa.array([common.pack_sorted(keys[p]) for p in parts], pa.binary()), "extra": pa.array([common.pack(extra[p]) for p in parts], pa.binary()),
    })


def answered(sent: DataFrame, answer: Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]], kind, buckets: int) -> DataFrame:
    """REPLY rows, of as many tasks as there are buckets: answer(keys of each batch, extras of each batch) gives a value for each key of each batch, as a numpy array."""

    def run(t: pa.Table) -> pa.Table:
        got = answer([common.unpack_sorted(x.as_py()) for x in t["keys"]], [common.unpack(x.as_py(), kind) for x in t["extra"]])
        return pa.table({"batch": t["batch"], "bucket": t["bucket"], "answer": pa.array([common.pack(a) for a in got], pa.binary())})

    return sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(common.tidy(run), REPLY)


def answers(rows: pa.Table, kind) -> np.ndarray:
    """The values of one batch's REPLY rows, in the order of its keys."""
    order = np.argsort(rows["bucket"].to_numpy())
    got = [common.unpack(rows["answer"][int(i)].as_py(), kind) for i in order]
    return np.concatenate(got) if got else np.empty(0, kind)


def member(x: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where x is in the ascending distinct `found`: the indices into x and those into found."""
    if not len(found) or not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = max(10, int(len(found)).bit_length() + 3)
    mask = np.uint64((1 << bits) - 1)
    table = np.zeros(1 << bits, bool)
    table[found & mask] = True
    maybe = np.flatnonzero(table[x & mask])
    at = np.searchsorted(found, x[maybe])
    at[at == len(found)] = 0
    same = found[at] == x[maybe]
    return maybe[same], at[same]
