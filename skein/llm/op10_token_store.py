"""Token-ID / binary output: documents as zstandard frames that share one trained dictionary.

A store is a folder with one dictionary file and shard files in ascending doc_id order.

Shard file, little-endian:
  magic ``TOKZ0001``, SHA-256 of the dictionary (32 bytes, of nothing if there is none)
  frames: one zstandard frame for each document, holding its ids as uint32
  index: for each document doc_id int64, a null flag uint8, frame offset uint64, number of ids uint64
  footer: index offset uint64, number of documents uint64, magic

One document costs one read of the index and one of its frame. Results: a null text is empty and has the end id
alone; a null doc_id is kept and comes first; repeated doc_ids each keep their own frame, in the order of the frames'
CRC-32; a very long text is one frame, encoded whole; an empty table gives an empty store; other columns of the input are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, storage, tokens

MAGIC = b"TOKZ0001"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("n", "<u8")])


def train_dictionary(samples: list[bytes], size: int = 65_536) -> bytes:
    """A zstandard dictionary from serialized id arrays; a raw one if they are too few to train on; nothing from nothing."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionary_of(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def sample_ids(docs: DataFrame, path: str, end_id: int, most: int, most_ids: int, n_docs: int) -> list[bytes]:
    """Ids of about `most` documents, picked by the hash of doc_id (of the text without one) over the whole table; at most most_ids of each. Only the dictionary is trained on them."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[: 4 * most_ids] for x in tokens.encode_texts(b.column(1), enc, end_id)], pa.binary())], ["h", "ids"])

    h = F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text")))
    picked = common.hash_share(docs, h, most, n_docs).select(h.alias("h"), "text")
    return [bytes(r.ids) for r in picked.mapInArrow(take, "h long, ids binary").orderBy("h", "ids").limit(most).collect()]


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, dictionary_docs: int = 2000, dictionary_ids: int = 2048, shard_bytes: int = 64 << 20) -> DataFrame:
    """Encode every whole text and write the store. Returns its manifest: shard, uri, n_docs, n_tokens, dictionary_uri.

    docs has doc_id and text; its other columns are not read. dictionary_docs and dictionary_ids bound what the
    dictionary is trained on."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8("text").alias("text"))
    raw = train_dictionary(sample_ids(docs, tokenizer, end_id, dictionary_docs, dictionary_ids, docs.count()))
    digest = hashlib.sha256(raw).digest()
    with storage.new_file(folder, "dictionary", ".zdict") as (out, dictionary_uri):
        out.write(raw)
    shared = spark.sparkContext.broadcast(raw)  # at most the dictionary's size, 64 KB

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        z = zstandard.ZstdCompressor(level=3, dict_data=dictionary_of(shared.value), write_checksum=False, write_content_size=True)
        for b in batches:
            at = 0
            for rows in tokens.encode_rows(b.column(1), enc, end_id):
                data, bounds = memoryview(rows.ids.astype("<u4", copy=False)).cast("B"), (4 * rows.at).tolist()
                out = [z.compress(data[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(rows)), pa.array(np.diff(rows.at)), pa.array(out, pa.binary())], ["doc_id", "n", "frame"])
                at += len(rows)

    encoded = common.staged(docs.mapInArrow(frames, "doc_id long, n long, frame binary"), "token-frames", "none")
    total = encoded.agg(F.sum(F.length("frame"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // shard_bytes + 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        index, at, n_tokens, n_docs = [], 40, 0, 0
        with storage.new_file(folder, f"shard-{shard:06d}", ".tokz") as (out, uri):
            out.write(MAGIC + digest)
            for b in (x for part in ([first], batches) for x in part):
                rows = np.zeros(b.num_rows, INDEX)
                rows["doc_id"] = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                rows["null"] = b.column(0).is_null().to_numpy(zero_copy_only=False)
                rows["n"] = b.column(1).to_numpy(zero_copy_only=False)
                for i, f in enumerate(b.column(2)):
                    data = f.as_buffer()
                    out.write(data)
                    rows["offset"][i] = at
                    at += data.size
                index.append(rows.tobytes())
                n_tokens += int(rows["n"].sum())
                n_docs += b.num_rows
            for part in index:
                out.write(part)
            out.write(struct.pack("<QQ", at, n_docs) + MAGIC)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([uri]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64()), pa.array([dictionary_uri])], ["shard", "uri", "n_docs", "n_tokens", "dictionary_uri"])

    ordered = encoded.repartitionByRange(shards, F.col("doc_id"), F.crc32("frame")).sortWithinPartitions(F.col("doc_id"), F.crc32("frame"))
    return common.staged(ordered.mapInArrow(write, "shard long, uri string, n_docs long, n_tokens long, dictionary_uri string"), "token-manifest")


class Shard:
    """Random access to one shard file."""

    def __init__(self, uri: str, dictionary_uri: str):
        self.file = storage.read_file(uri)
        size = self.file.size()
        at, n, magic = struct.unpack("<QQ8s", self.file.read_at(24, size - 24))
        with storage.read_file(dictionary_uri) as f:
            raw = f.read()
        head = self.file.read_at(40, 0)
        if magic != MAGIC or head[:8] != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        if head[8:] != hashlib.sha256(raw).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.index = np.frombuffer(self.file.read_at(INDEX.itemsize * n, at), INDEX)
        self.ends = np.append(self.index["offset"][1:], np.uint64(at))
        self.z = zstandard.ZstdDecompressor(dict_data=dictionary_of(raw))

    def ids(self, i: int) -> bytes:
        """The i-th document's ids as little-endian uint32 bytes, read alone."""
        start = int(self.index["offset"][i])
        return self.z.decompress(self.file.read_at(int(self.ends[i]) - start, start))


def read_store(manifest: DataFrame) -> DataFrame:
    """A row per document in the files: doc_id, start, n_tokens and ids (little-endian uint32 bytes). The manifest has one row per file."""
    spark = manifest.sparkSession
    files, start = [], 0
    for r in manifest.orderBy("shard").collect():  # one row per 64 MB file
        files.append((r.uri, r.dictionary_uri, start))
        start += r.n_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, dictionary_uri, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                shard = Shard(uri, dictionary_uri)
                starts = base + np.concatenate([[0], np.cumsum(shard.index["n"].astype(np.int64))])
                for at in range(0, len(shard.index), 512):
                    part = shard.index[at : at + 512]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(part["doc_id"], mask=part["null"].astype(bool)), pa.array(starts[at : at + len(part)]), pa.array(part["n"].astype(np.int64)),
                        pa.array([shard.ids(i) for i in range(at, at + len(part))], pa.binary()),
                    ], ["doc_id", "start", "n_tokens", "ids"])

    rows = spark.createDataFrame(files, "uri string, dictionary_uri string, base long").repartition(max(1, len(files)))
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a token store: doc_id, start, n_tokens, ids_crc32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_store(docs, common.new_path(spark, "token-store"), tokens.vocabulary_path())
    return read_store(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
