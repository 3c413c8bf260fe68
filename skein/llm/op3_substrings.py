"""Substring dedup with fixed-block anchors.

Each document is a reference cut into non-overlapping 7-word blocks, the anchors, and a probe with every rolling
7-word window. A 13-word window holds exactly one whole block of its own document's grid, so two equal 13-word windows
always meet at an anchor. Round 1 finds the anchors that rolling windows of other documents hit. Round 2 extends the
hits: only 13-word windows around a hit are compared, by 96-bit hashes, for the smallest document they start in. The
covered windows, chained, are the maximal exact repeats; their words go from every document but the first.

Both rounds are exchanges of packed hashes between batches of documents (batches.py). A window of a third of all rows is
one entry of a batch; no pairs are made.

Results: a null or empty text has no words; a null doc_id neither removes nor loses words; rows that repeat a
doc_id do not remove each other's words; texts of fewer than 13 words stay; an empty table gives an empty table; extra
columns stay, and added ones get names that are not taken. A text that loses nothing stays as it is, another becomes its
kept words joined by one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches, common

WINDOW, BLOCK = 13, 7
SHIFT = np.uint64(64 - batches.KEY_BITS)


class Words:
    """The word hashes of a batch's documents of WINDOW words or more that have an id, in ascending doc_id order."""

    def __init__(self, table: pa.Table, ids: str, text: str, hashed: common.WordHash):
        doc = table[ids].to_numpy(zero_copy_only=False) if not table[ids].null_count else np.array([x if x is not None else 0 for x in table[ids].to_pylist()], np.int64)
        null = table[ids].is_null().to_numpy()
        rows, parts, sizes = [], [], []
        for i in np.argsort(doc, kind="stable"):
            ws = [] if null[i] else common.words(table[text][int(i)].as_py())
            if len(ws) >= WINDOW:
                rows.append(int(i))
                parts.append(hashed.array(ws))
                sizes.append(len(ws))
        self.rows, self.ids = rows, doc[rows].astype(np.int64) if rows else np.empty(0, np.int64)
        self.h = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        size = np.array(sizes, np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(rows)), size)
        self.place = np.arange(len(self.h)) - self.start[self.doc] if len(self.h) else np.empty(0, np.int64)
        self.left = self.start[self.doc + 1] - np.arange(len(self.h)) if len(self.h) else np.empty(0, np.int64)

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Where a rolling window of BLOCK words starts, and its key."""
        if not len(self.h):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = common.ngrams(self.h, BLOCK)
        at = np.flatnonzero(self.left[: len(h)] >= BLOCK)
        return at, h[at] >> SHIFT

    def block_request(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, and for each: 1 if it is an anchor, plus 2 if several documents have it."""
        at, key = self.blocks()
        if not len(at):
            return key, np.empty(0, np.uint8)
        doc = np.minimum(self.doc[at], 0x7FFF).astype(np.uint64)
        v = np.sort(key << np.uint64(16) | doc << np.uint64(1) | (self.place[at] % BLOCK == 0).astype(np.uint64))
        k = v >> np.uint64(16)
        s = common.starts_of(k)
        first, last = v[s] >> np.uint64(1) & np.uint64(0x7FFF), v[np.append(s[1:], len(v)) - 1] >> np.uint64(1) & np.uint64(0x7FFF)
        several = (first != last) | (last == 0x7FFF)  # documents from 0x7FFF on share a number: taken as several
        return k[s], (np.bitwise_or.reduceat(v & np.uint64(1), s) | several.astype(np.uint64) << np.uint64(1)).astype(np.uint8)

    def windows(self, hit: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts of the WINDOW-word windows with a block among the hit keys, ordered by hash, then doc_id; hash, check hash and starts of runs of equal ones."""
        at, key = self.blocks()
        found, _ = batches.member(key, hit)
        marks = np.zeros(len(self.h) + 1, np.int64)
        marks[at[found] + 1] = 1
        c = np.cumsum(marks)
        if len(self.h) < WINDOW:
            s = np.empty(0, np.int64)
        else:
            n = len(self.h) - WINDOW + 1
            s = np.flatnonzero((self.left[:n] >= WINDOW) & (c[WINDOW - BLOCK + 1 : WINDOW - BLOCK + 1 + n] > c[:n]))
        a, b = common.ngrams(self.h, WINDOW, 11)[s], common.ngrams(self.h, WINDOW, 23)[s] >> np.uint64(32)
        order = np.argsort(a, kind="stable")  # positions ascend with doc_id, so the first of a run has the smallest
        s, a, b = s[order], a[order], b[order]
        runs = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
        return s, a, b, runs


PAIR = np.dtype([("doc", "<i8"), ("check", "<u4")])


def block_answer(keys: list[np.ndarray], flags: list[np.ndarray]) -> list[np.ndarray]:
    """Bits: is the key an anchor somewhere, and in more than one document."""
    v = np.sort(np.concatenate([k << np.uint64(16) | f for k, f in zip(keys, flags, strict=True)]))
    k = v >> np.uint64(16)
    s = common.starts_of(k)
    anchor, several = np.bitwise_or.reduceat(v & np.uint64(1), s), np.bitwise_or.reduceat(v & np.uint64(2), s)
    hit = k[s[(anchor > 0) & ((several > 0) | (np.diff(np.append(s, len(v))) > 1))]]
    out = []
    for mine in keys:
        bit = np.zeros(len(mine), np.uint8)
        bit[batches.member(mine, hit)[0]] = 1
        out.append(bit)
    return out


def window_answer(keys: list[np.ndarray], extras: list[np.ndarray]) -> list[np.ndarray]:
    """Bits: does the window start in a document with a smaller id than the batch's smallest."""
    a, x = np.concatenate(keys), np.concatenate(extras)
    order = np.argsort(a)
    a, doc, check = a[order], x["doc"][order], x["check"][order]
    s = common.starts_of(a)
    sizes = np.diff(np.append(s, len(a)))
    smaller = doc > np.repeat(np.minimum.reduceat(doc, s), sizes)
    mixed = np.flatnonzero(np.minimum.reduceat(check, s) != np.maximum.reduceat(check, s))
    for i in mixed:  # equal in 64 bits only
        run = slice(s[i], s[i] + sizes[i])
        for c in np.unique(check[run]):
            mine = check[run] == c
            smaller[run][mine] = doc[run][mine] > doc[run][mine].min()
    out = np.empty(len(a), np.uint8)
    out[order] = smaller
    return np.split(out, np.cumsum([len(k) for k in keys])[:-1])


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = batches.BATCH_BYTES, bucket_hashes: int = batches.BUCKET_HASHES) -> DataFrame:
    """docs with its text cut, and n_words, n_removed and kept_sha256 of each row."""
    added = [common.column_named(docs, c) for c in ("n_words", "n_removed", "kept_sha256")]
    out_schema = T.StructType([*(T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema.fields), *(T.StructField(c, t) for c, t in zip(added, (T.LongType(), T.LongType(), T.StringType()), strict=True))])
    names = docs.columns
    rows = docs.withColumn(text, common.utf8(text)).withColumn(doc_id, F.col(f"`{doc_id}`").cast("long"))
    key = common.column_named(docs, "_batch")
    n_batches, n_buckets = batches.sizes(rows.select(F.col(f"`{text}`").alias("text")), batch_bytes, bucket_hashes)
    spread = F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), F.lit(n_batches)).cast("int")  # rows that share a doc_id go apart

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = b.schema.get_field_index(key)
            yield from batches.split(b.drop_columns([key]), b.column(at).to_numpy())

    held = batches.gathered(rows.withColumn(key, spread).mapInArrow(pack, "batch int, blob binary"), n_batches)

    def load(blobs) -> tuple[pa.Table, Words]:
        t = batches.thaw(blobs)
        return t, Words(t, doc_id, text, common.word_hash())

    def ask_blocks(t: pa.Table) -> pa.Table:
        return batches.request(t["batch"][0].as_py(), *load(t["blob"])[1].block_request(), n_buckets)

    hits = batches.answered(held.groupBy("batch").applyInArrow(common.tidy(ask_blocks), batches.SENT), block_answer, np.uint8, n_buckets)
    hits = common.staged(hits.withColumn("round", F.lit(1)), "substring-hits", "none")

    def windows(t: pa.Table, reply: pa.Table):
        table, w = load(t["blob"])
        keys, _ = w.block_request()
        mine = reply.filter(pa.compute.equal(reply["round"], 1))
        return table, w, w.windows(keys[batches.answers(mine, np.uint8).astype(bool)])

    def ask_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return batches.request(0, np.empty(0, np.uint64), np.empty(0, PAIR), n_buckets, 64)
        _, w, (s, a, b, runs) = windows(left, right)
        extra = np.zeros(len(runs), PAIR)
        extra["doc"], extra["check"] = w.ids[w.doc[s[runs]]], b[runs]
        return batches.request(left["batch"][0].as_py(), a[runs], extra, n_buckets, 64)

    smaller = batches.answered(held.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(common.tidy(ask_windows), batches.SENT), window_answer, PAIR, n_buckets)
    replies = hits.unionByName(smaller.withColumn("round", F.lit(2)))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in shape})
        table, w, (s, a, b, runs) = windows(left, right)
        second = batches.answers(right.filter(pa.compute.equal(right["round"], 2)), np.uint8).astype(bool)
        run = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(s))))
        doc = w.ids[w.doc[s]]
        gone = s[second[run] | (doc > w.ids[w.doc[s[runs]]][run])] if len(s) else s
        cover = np.zeros(len(w.h) + 1, np.int64)
        cover[gone] += 1
        cover[gone + WINDOW] -= 1
        removed = np.cumsum(cover)[: len(w.h)] > 0
        by_row = {r: removed[w.start[i] : w.start[i + 1]] for i, r in enumerate(w.rows)}
        texts, n_words, n_removed, digest = [], [], [], []
        for i, t in enumerate(table[text]):
            ws, raw = common.words(t.as_py()), t.as_py()
            mask = by_row.get(i)
            n = int(mask.sum()) if mask is not None else 0
            kept = b" ".join(x for x, m in zip(ws, mask.tolist(), strict=True) if not m) if n else b" ".join(ws)
            texts.append(kept if n else raw)
            n_words.append(len(ws)), n_removed.append(n), digest.append(hashlib.sha256(kept).hexdigest())
        columns = {c: table[c] for c in names} | {text: pa.array(texts, pa.binary()).cast(pa.string(), safe=False)}
        return pa.table([*columns.values(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], names=[*columns, *added])

    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(out_schema)
    out = common.staged(held.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(common.tidy(cut), out_schema), "substring-cut")
    held.unpersist()
    return out


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_words, n_removed, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g FROM p),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY g) AS first_doc FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM m WHERE first_doc < doc_id),
x AS (SELECT doc_id, list(place) AS gone, count(*) AS n FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE [ws[k] for k in range(1, len(ws) + 1) if NOT list_contains(gone, k)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN x USING (doc_id)
"""
