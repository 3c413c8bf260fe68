"""Sources and sinks beside Parquet tables: binary record files, NPY and half-precision matrices, JSON lines, SQLite, XML, bucketed and versioned tables, synthetic vectors."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.encode import WORDS

RECORD, HASH = 72, 64  # bytes of an id and a fingerprint, and of the fingerprint


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _words(ids: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    h = np.ascontiguousarray(hashes).view(">i8").reshape(len(ids), 8).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), *(pa.array(h[:, k]) for k in range(8))], ["doc_id", *WORDS])


def read_fingerprint_files(spark: SparkSession, path: str, header: int = 14, columns: bool = False) -> DataFrame:
    """doc_id and h0 to h7 of files of up to 2 GB: a header whose last 9 bytes but one are the count (little-endian) and then rows of id and
    fingerprint; or, with columns, an 8-byte count, all fingerprints and all ids. A file of the wrong size is refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                raw = np.frombuffer(x.as_buffer(), np.uint8)
                first = 8 if columns else header
                n = struct.unpack("<Q", raw[:8].tobytes())[0] if columns else struct.unpack("<Q", raw[header - 9 : header - 1].tobytes())[0]
                if len(raw) != first + n * RECORD:
                    raise ValueError(f"{n} records need {first + n * RECORD} bytes, the file has {len(raw)}")
                for at in range(0, n, 65_536):
                    end = min(n, at + 65_536)
                    if columns:
                        yield _words(raw[8 + n * HASH + 8 * at : 8 + n * HASH + 8 * end].view("<i8"), raw[8 + at * HASH : 8 + end * HASH].reshape(-1, HASH))
                    else:
                        rows = raw[first + at * RECORD : first + end * RECORD].reshape(-1, RECORD)
                        yield _words(np.ascontiguousarray(rows[:, :8]).view("<i8").ravel(), rows[:, 8:])

    return _files(spark, path).mapInArrow(run, "doc_id long, " + ", ".join(f"{w} long" for w in WORDS))


def fingerprint_file(ids: list[int], words: list[list[int]], magic: bytes = b"FPRT") -> bytes:
    """One file of rows: magic, version 1, count, fingerprint length, and the rows."""
    body = b"".join(struct.pack("<q", i) + np.array(w, ">i8").tobytes() for i, w in zip(ids, words, strict=True))
    return magic[:4] + b"\x01" + struct.pack("<Q", len(ids)) + bytes([HASH]) + body


def read_matrix_files(spark: SparkSession, path: str, kind: str = "npy", dim: int = 0) -> DataFrame:
    """row and embedding of the matrices in NPY files, or of raw rows of dim half-precision numbers (kind f16)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for b in batches:
            for x in b.column(0).to_pylist():
                m = np.load(io.BytesIO(x), allow_pickle=False) if kind == "npy" else np.frombuffer(x, "<f2").reshape(-1, dim)
                for at in range(0, len(m), 4096):
                    part = m[at : at + 4096].astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(list(part), pa.list_(pa.float32()))], ["row", "embedding"])

    return _files(spark, path).mapInArrow(run, "row long, embedding array<float>")


def write_checked(df: DataFrame, path: str, columns: list[str]) -> None:
    """Parquet with a CRC-32 of the columns in each row."""
    df.withColumn("crc", F.crc32(F.concat_ws("|", *columns).cast("binary"))).write.mode("errorifexists").parquet(path)


def read_checked(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The rows, once it is sure that every checksum holds."""
    df = spark.read.parquet(path)
    if not df.where(F.col("crc") != F.crc32(F.concat_ws("|", *columns).cast("binary"))).isEmpty():
        raise ValueError(f"{path}: a row does not have its checksum")
    return df.drop("crc")


def write_buckets(fingerprints: DataFrame, path: str, bits: int = 8) -> None:
    """One folder for each bucket of the first bits; a search of one bucket then reads that folder alone."""
    fingerprints.withColumn("bucket", F.shiftrightunsigned("h0", 64 - bits)).repartition("bucket").write.partitionBy("bucket").mode("errorifexists").parquet(path)


def read_bucket(spark: SparkSession, path: str, bucket: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("bucket") == bucket)


def append_events(df: DataFrame, folder: str, stream: str) -> None:
    """Rows as JSON lines, a folder for each stream."""
    df.withColumn("_stream", F.lit(stream)).write.mode("append").json(f"{folder}/{stream}")


def tail_events(spark: SparkSession, folder: str, stream: str, n: int, order: str, schema: str) -> DataFrame:
    """The last n rows of a stream by the column `order`."""
    return spark.read.schema(schema).json(f"{folder}/{stream}").orderBy(F.desc(order)).limit(n)


def stream_events(spark: SparkSession, folder: str, stream: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """The stream's new files as they come, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(f"{folder}/{stream}")


def read_sqlite(spark: SparkSession, file: str, table: str, key: str, schema: str, first: int, last: int, parts: int = 8) -> DataFrame:
    """Rows of a SQLite file that every executor can open, by ranges of the key from first to last."""
    names = [x.split()[0] for x in schema.split(",")]
    if not all(x.isidentifier() for x in (table, key, *names)):
        raise ValueError("names of tables and columns must be identifiers")
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        for b in batches:
            for low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c = sqlite3.connect(f"file:{file}?mode=ro", uri=True)
                cursor = c.execute(f"SELECT {', '.join(names)} FROM {table} WHERE {key} >= ? AND {key} < ? ORDER BY {key}", (low, high))
                while rows := cursor.fetchmany(4096):
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)
                c.close()

    edges = [first + (last + 1 - first) * i // parts for i in range(parts + 1)]
    return spark.createDataFrame(list(zip(edges, edges[1:], strict=False)), "low long, high long").repartition(parts).mapInArrow(run, schema)


def read_xml(spark: SparkSession, path: str, row_tag: str, key: str) -> DataFrame:
    """Rows of XML files, packed or not, one for each key."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path).dropDuplicates([key])


def publish(df: DataFrame, folder: str, view: str) -> str:
    """Write a new version beside the old ones, then point the view at it: readers see the one or the other, whole. Returns its path."""
    path = f"{folder}/{view}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession.read.parquet(path).createOrReplaceTempView(view)
    return path


def clustered_vectors(spark: SparkSession, n: int, dim: int = 64, clusters: int = 10, spread: float = 0.3, seed: int = 42) -> DataFrame:
    """doc_id, label and unit vectors around random centres."""
    v = spark.range(n).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(clusters)).cast("int").alias("label"))
    unit = lambda *x: (F.pmod(F.xxhash64(*x), F.lit(1 << 20)) + 0.5) / (1 << 20)
    normal = lambda *x: F.sqrt(-2 * F.ln(unit(*x, F.lit(1)))) * F.cos(2 * 3.141592653589793 * unit(*x, F.lit(2)))
    x = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: normal(F.lit(seed), F.col("label"), i) + spread * normal(F.lit(seed + 1), F.col("doc_id"), i))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, y: s + y * y))
    return v.withColumn("x", x).select("doc_id", "label", F.transform("x", lambda y: (y / norm).cast("float")).alias("embedding"))


def zipf_terms(spark: SparkSession, n: int, terms: int, seed: int = 42) -> DataFrame:
    """id and term, the k-th of them about 1 / k as frequent as the first."""
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    return spark.range(n).select("id", F.least(F.floor(F.pow(F.lit(float(terms + 1)), u)), F.lit(terms)).alias("term"))
