"""WARC: archives of request, response (or revisit) and metadata records, and their assembly into captures.

write_archives() turns pages into WARC/1.1 files, one gzip member for each record. Of pages with equal payloads of at
least revisit_bytes, those with the smallest page_id are stored as responses; the others are revisit records that carry
the digest and refer to the first. read_records() parses archives; captures() joins the records of a transaction through
WARC-Concurrent-To and emits one nested row per capture, resolving a revisit's payload length by the record it
refers to.

Results: a null html is an empty payload, a null url is recorded as `urn:page:<page_id>`; a null page_id counts as larger
than any other, so such a row is a revisit if a row with a page_id has its payload, else a response; if a page_id or a whole
row repeats, each row is a capture of its own (equal rows are numbered; the first response of a payload is that which hashes
lowest); a very long payload is one record, streamed through gzip whole; an empty table gives no archives; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, storage

RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, page_id long, digest string, length long, payload binary"
FILE_BYTES = 64 << 20


def record_types(pages: DataFrame, revisit_bytes: int = 100) -> DataFrame:
    """page_id, uid, url, payload, digest, first_uid: the capture whose payload this one repeats, else null.

    Only digests that occur more than once are joined back. Rows that are equal in page_id, url and payload get a number
    in their uid; just the rows of digests that have such are dealt anew for it."""
    named = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.concat(F.lit("urn:page:"), named)).alias("url"), F.coalesce(common.utf8("html"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("uid", F.concat_ws("-", named, F.substring(F.sha2(F.concat_ws("|", "url", "digest"), 256), 1, 16)))
    copies = rows.groupBy("digest", "page_id", "uid").agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("payload")).alias("size"))
    again = common.staged(copies.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "uid")).alias("first"), F.sum("copies").alias("n"), F.max("copies").alias("copies"), F.max("size").alias("size")).where("n > 1"), "warc-digests")
    equal = again.where("copies > 1").select("digest")
    if not equal.isEmpty():
        # numbered within the parts of the input, so that a page of a third of all rows is no hot group
        parted = rows.withColumn("part", F.spark_partition_id()).join(equal, "digest", "left_semi")
        least = parted.groupBy("uid").agg(F.min("part").alias("least"))
        number = F.row_number().over(Window.partitionBy("uid", "part").orderBy("digest"))  # rows of one uid are equal in all columns
        numbered = parted.withColumn("number", number).join(least, "uid")
        numbered = numbered.withColumn("uid", F.when((F.col("part") > F.col("least")) | (F.col("number") > 1), F.concat_ws("-", "uid", "part", "number")).otherwise(F.col("uid"))).select(*rows.columns)
        rows = rows.join(equal, "digest", "left_anti").select(*numbered.columns).unionByName(numbered)
    firsts = again.where(F.col("size") >= revisit_bytes).select("digest", F.col("first.uid").alias("first_uid"), F.col("first.page_id").alias("first_page"))
    joined = rows.join(firsts, "digest", "left")
    return joined.withColumn("first_uid", F.when((F.col("first_page") < F.col("page_id")) | (F.col("page_id").isNull() & F.col("first_page").isNotNull()), F.col("first_uid")))


def uuid_of(text: str, kind: str) -> str:
    import hashlib

    h = hashlib.sha256(f"{kind}|{text}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def record(kind: str, record_id: str, uri: str, content_type: str, block: bytes, **more: str) -> bytes:
    """One WARC record as a gzip member."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A")), *((k.replace("_", "-"), v) for k, v in more.items()), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def transaction(page_id: int | None, uid: str, url: str, payload: bytes, digest: str, first_uid: str | None) -> list[bytes]:
    """The request, response or revisit, and metadata records of one capture."""
    mine, path = uuid_of(uid, "response"), url.partition("//")[2].partition("/")[2].split("\r")[0].split("\n")[0]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if first_uid is None:
        answer = record("response", mine, url, "application/http; msgtype=response", head + payload, WARC_Payload_Digest=f"sha256:{digest}")
    else:
        answer = record("revisit", mine, url, "application/http; msgtype=response", head, WARC_Payload_Digest=f"sha256:{digest}", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=uuid_of(first_uid, "response"))
    return [
        record("request", uuid_of(uid, "request"), url, "application/http; msgtype=request", f"GET /{path} HTTP/1.1\r\n\r\n".encode(), WARC_Concurrent_To=mine),
        answer,
        record("metadata", uuid_of(uid, "metadata"), url, "application/warc-fields", (b"" if page_id is None else b"page-id: %d\r\n" % page_id), WARC_Concurrent_To=mine),
    ]


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 100, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives into folder; returns uri and n_records of each file. A file is closed at file_bytes."""
    typed = record_types(pages, revisit_bytes).select("page_id", "uid", "url", "payload", "digest", "first_uid")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*b.columns, strict=True))
        row = next(rows, None)
        while row is not None:
            size = n = 0
            with storage.new_file(folder, "pages", ".warc.gz") as (out, uri):
                while row is not None and size < file_bytes:
                    for part in transaction(*(x.as_py() for x in row)):
                        out.write(part)
                        size += len(part)
                        n += 1
                    row = next(rows, None)
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], ["uri", "n_records"])

    return common.staged(typed.mapInArrow(write, "uri string, n_records long"), "warc-manifest")


def members(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one after another; also a file that is one single member of many records."""
    z, out, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = stream.read(block)
            if not data:
                break
        out.append(z.decompress(data))
        data = z.unused_data if z.eof else b""
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []
    if any(out):
        yield b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record in data."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, n = end + 4, int(head["content-length"])
        yield head, data[start : start + n]
        at = start + n


def read_records(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """RECORD rows of the archives named in column uri. digest is that of the payload as read (for a revisit, as its header says); without payloads, only its length and digest are returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for uri in b.column(0).to_pylist():
                rows, held = [], 0
                with storage.read_file(uri) as f:
                    for head, block in (x for m in members(f) for x in parse(m)):
                        kind, page, digest, body = head["warc-type"], None, None, None
                        if kind == "metadata":
                            page = next((int(x.partition(b":")[2]) for x in block.split(b"\r\n") if x.startswith(b"page-id:")), None)
                        elif kind in ("response", "revisit"):
                            body = block.partition(b"\r\n\r\n")[2]
                            digest = hashlib.sha256(body).hexdigest()
                            said = head.get("warc-payload-digest", "").removeprefix("sha256:")
                            if kind == "revisit":
                                digest, body = said, None
                            elif said and said != digest:
                                raise ValueError(f"{uri}: the payload of {head['warc-record-id']} does not have the digest in its header")
                        rows.append((head["warc-record-id"], kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), page, digest, None if body is None else len(body), body if payloads else None))
                        held += len(body or b"")
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return manifest.select("uri").repartition(max(1, manifest.count())).mapInArrow(run, RECORD)  # a task for each file


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, page_id, uri, request, response and metadata (structs of their record), payload_bytes, payload_digest, record_type, refers_to_page.

    A revisit's payload length and page come from the response that it refers to."""
    whole = F.struct(*(c for c in records.columns))
    by = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        *(F.max(F.when(cond, whole)).alias(name) for name, cond in (("request", F.col("type") == "request"), ("response", F.col("type").isin("response", "revisit")), ("metadata", F.col("type") == "metadata")))
    )
    by = by.where("response is not null")
    plain = by.where("response.type = 'response'")
    revisits = by.where("response.type = 'revisit'").withColumn("target", F.col("response.refers_to"))
    wanted = revisits.select("target").distinct()
    targets = plain.join(wanted, F.col("capture_id") == F.col("target"), "left_semi").select(F.col("capture_id").alias("target"), F.col("metadata.page_id").alias("refers_to_page"), F.col("response.length").alias("target_bytes"))
    found = revisits.join(targets, "target", "left").drop("target")
    both = plain.withColumns({"refers_to_page": F.lit(None).cast("long"), "target_bytes": F.col("response.length")}).unionByName(found)
    return both.select("capture_id", F.col("metadata.page_id").alias("page_id"), F.col("response.uri").alias("uri"), "request", "response", "metadata", F.col("target_bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"), "refers_to_page")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), common.new_path(spark, "warc"))
    records = common.staged(read_records(manifest, payloads=False), "warc-records")
    return captures(records).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_page FROM p),
r AS (SELECT *, n >= 100 AND first_page IS NOT NULL AND (page_id IS NULL OR first_page < page_id) AS again FROM f)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_page END AS refers_to
FROM r
"""
