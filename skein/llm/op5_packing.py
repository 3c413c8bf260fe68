"""Packing: lexical retrieval packing with a sharded BM25 inverted index.

Documents are tokenised, dealt to shards of bounded size by a lexical signature (the hash of a min-hash of neighbouring id
pairs; a signature that holds more than a shard is dealt on by doc_id), and packed shard by shard: the next unused document
seeds a window, an inverted index over the shard's token ids scores the others by BM25 over all ids of the seed, and unused
neighbours fill the window best first. What does not fit is cut and seeds the next window. A seed meets the documents of its
own shard alone; the README gives the share of its neighbours in the whole corpus that it finds there. Document frequencies
and the mean length are those of the whole corpus; they are at most one number for each id of the vocabulary. Full windows
of a long document stand alone. A shard's last, short window is cut into sequences whose lengths are powers of two, so
nothing is padded. Two runs over one table give the same sequences.

Results: a null text is empty and has its end id alone; null and repeated doc_ids are packed row by row; equal scores go
to the earlier document in the shard; a very long text is cut into full windows and a rest; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

WINDOW = 4096
K1, B = 1.2, 0.75
#: The index lets go of placed documents whenever they are this share of it.
DROP = 0.125
SHARD_TOKENS = 2_000_000
NAMES = ["doc_id", "n", "sig", "ids"]
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n, sig and ids (little-endian, two bytes each if the vocabulary allows, else four) of every row.

    Rows with a null n hold in ids the document frequencies within a task, one 8-byte number for each id of the vocabulary,
    compressed."""
    size = vocabulary_size(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, df = tokens.encoder(tokenizer), np.zeros(size, np.int64)
        for b in batches:
            at = 0
            for rows in tokens.encode_rows(b.column(1), enc, end_id):
                df += np.bincount(distinct(rows)[1], minlength=size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(rows)), pa.array(np.diff(rows.at)), pa.array(signatures(rows)), tokens.binary_rows(rows, id_kind(size))], NAMES)
                at += len(rows)
        if df.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([common.pack(df)], pa.binary())], NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8("text").alias("text")).mapInArrow(run, "doc_id long, n long, sig long, ids binary")


def id_kind(size: int) -> str:
    return "<u4" if size > 65_536 else "<u2"


def signatures(rows: tokens.Rows) -> np.ndarray:
    """Min-hash of each row's neighbouring id pairs; 0 for a row of one id. Every row has an id."""
    hashed = common.mix(rows.ids[:-1].astype(np.uint64) << np.uint64(32) | rows.ids[1:])
    hashed = np.append(hashed, np.uint64(0))
    hashed[rows.at[1:] - 1] = np.uint64(2**64 - 1)  # the pair of a row's last id and the next row's first
    out = np.minimum.reduceat(hashed, rows.at[:-1]) >> np.uint64(1)
    out[np.diff(rows.at) == 1] = 0
    return out.astype(np.int64)


def distinct(rows: tokens.Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and count of each distinct id of each row, in that order."""
    key = np.sort(np.repeat(np.arange(len(rows), dtype=np.uint64) << np.uint64(32), np.diff(rows.at)) | rows.ids)
    at = common.starts_of(key)
    key = key[at] if len(at) else key
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), np.diff(np.append(at, rows.at[-1]))


def vocabulary_size(tokenizer: str) -> int:
    return tokens.encoder(tokenizer).tokenizer.get_vocab_size()


def document_frequencies(table: DataFrame, size: int) -> np.ndarray:
    """Number of documents with each id, over the whole corpus, from the rows with a null n; at most one row for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                sums += common.unpack(x.as_py(), np.int64)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], ["term", "n"])

    got = table.where("n is null").select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(size, np.int64)
    df[got["term"].to_numpy()] = got["n"].to_numpy()
    return df


class Index:
    """BM25 inverted index over the documents of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        length = np.array([len(d) for d in docs])
        doc, term, tf = distinct(tokens.Rows(np.concatenate(docs), length))
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(mean_length, 1e-9)))).astype(np.float32)
        self.n, self.bounds = len(docs), np.searchsorted(doc, np.arange(len(docs) + 1))
        self.doc_terms, self.live = term, len(docs)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order].astype(np.int32), weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document in the index for all ids of the seed."""
        terms = self.doc_terms[self.bounds[seed] : self.bounds[seed + 1]]
        first, n = self.first[terms], self.first[terms + 1] - self.first[terms]
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        return np.bincount(self.doc[at], self.weight[at], self.n).astype(np.float32)

    def drop(self, used: np.ndarray) -> None:
        """Let go of used documents once they are DROP of the index; they score 0 from then on, as seeds they still count."""
        left = len(used) - int(used.sum())
        if left <= (1 - DROP) * self.live:
            keep = ~used[self.doc]
            self.first = np.concatenate([[0], np.cumsum(keep)])[self.first]
            self.doc, self.weight, self.live = self.doc[keep], self.weight[keep], left


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences are numbered from 0. docs: each with one id or more."""
    pieces, seq = [], 0
    left = np.zeros(len(docs), np.int64)  # where the part of a document that is not placed yet starts
    for i, d in enumerate(docs):
        while len(d) - left[i] >= window:
            pieces.append((i, int(left[i]), window, seq, 0))
            left[i] += window
            seq += 1
    used = np.array([len(d) == s for d, s in zip(docs, left, strict=True)])
    index = Index(docs, idf, mean_length)
    cursor, pending = 0, None
    while True:
        while cursor < len(docs) and used[cursor]:
            cursor += 1
        seed = pending if pending is not None else cursor
        if seed >= len(docs):
            break
        pending, at, mine, ranked, k, nxt = None, 0, [], None, 0, cursor
        take = seed
        while take is not None:
            n = min(len(docs[take]) - int(left[take]), window - at)
            mine.append((take, int(left[take]), n, seq, at))
            left[take] += n
            at += n
            used[take] = True
            if left[take] < len(docs[take]):
                pending = take
            if at == window:
                break
            if ranked is None:
                index.drop(used)
                s = index.scores(seed)
                ranked = np.flatnonzero((s > 0) & ~used)
                ranked = ranked[np.argsort(-s[ranked], kind="stable")]
            take = None
            if k < len(ranked):
                take, k = int(ranked[k]), k + 1
            else:  # no neighbour shares an id: the next unused document
                while nxt < len(docs) and used[nxt]:
                    nxt += 1
                take = nxt if nxt < len(docs) else None
        if at == window:
            pieces += mine
            seq += 1
        else:
            cut, seq = powers_of_two(mine, at, seq)
            pieces += cut
    return pieces


def powers_of_two(mine: list[tuple], total: int, seq: int) -> tuple[list[tuple], int]:
    """The pieces of one short window cut into sequences whose lengths are the powers of two that sum to its length."""
    sizes = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    out, room, at = [], sizes.pop(0), 0
    for doc, start, n, _, _ in mine:
        while n:
            take = min(n, room)
            out.append((doc, start, take, seq, at))
            start, n, at, room = start + take, n - take, at + take, room - take
            if not room:
                seq, at = seq + 1, 0
                room = sizes.pop(0) if sizes else 0
    return out, seq


def sharded(table: DataFrame, total: int, shard_tokens: int) -> tuple[DataFrame, int]:
    """table with its rows' shard, and the number of shards: by the hash of sig, and within a sig of more than a shard by doc_id as well."""
    parts = max(1, -(-total // shard_tokens))
    hot = table.groupBy("sig").agg(F.sum("n").alias("held")).where(F.col("held") > shard_tokens).select("sig", F.ceil(F.col("held") / shard_tokens).alias("pieces"))
    hot = common.staged(hot, "hot-signatures")  # at most one row for each shard; written, so that Spark knows its size when it picks the join
    salt = F.pmod(F.xxhash64("doc_id", F.crc32("ids")), F.coalesce("pieces", F.lit(1)))
    return table.join(hot, "sig", "left").withColumn("shard", F.pmod(F.xxhash64("sig", salt), F.lit(parts))).drop("pieces"), parts


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """PIECES of all rows of docs (doc_id, text); a shard holds about shard_tokens ids, or one document if that has more."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokens.vocabulary_path()
    size = vocabulary_size(tokenizer)
    kind = id_kind(size)
    table = common.staged(token_table(docs, tokenizer, end_id), "tokens")
    df = document_frequencies(table, size)
    table = table.where("n is not null")
    n, total = table.agg(F.count(F.lit(1)), F.sum("n")).first()
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    shared = spark.sparkContext.broadcast((idf, (total or 0) / max(1, n)))  # one number for each id of the vocabulary
    dealt, parts = sharded(table, total or 0, shard_tokens)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, list[tuple]]]:
        """Shard, whether it goes on after another part of it, and its rows, at most twice shard_tokens or one document."""
        rows, held, now, more = [], 0, None, False
        for b in batches:
            for shard, doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if rows and (shard != now or held >= 2 * shard_tokens):
                    yield now, more, rows
                    rows, held, more = [], 0, shard == now
                elif shard != now:
                    more = False
                now = shard
                rows.append((doc_id, np.frombuffer(ids.as_buffer(), kind)))
                held += len(rows[-1][1])
        if rows:
            yield now, more, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean_length = shared.value
        base = 0
        for shard, more, rows in shards(batches):
            base = base if more else shard << 32
            pieces = pack_shard([r[1] for r in rows], idf, mean_length, window)
            for at in range(0, len(pieces), 2048):
                part = pieces[at : at + 2048]
                yield pa.RecordBatch.from_arrays([
                    pa.array([rows[p[0]][0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64()), pa.array([p[2] for p in part], pa.int64()), pa.array([len(rows[p[0]][1]) for p in part], pa.int64()),
                    pa.array([base + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64()), pa.array([rows[p[0]][1][p[1] : p[1] + p[2]].astype("<u4").tobytes() for p in part], pa.binary()),
                ], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            base += max(p[3] for p in pieces) + 1

    # beyond 256 shards a task packs up to some eight, one after the other
    ordered = dealt.repartition(max(min(parts, 256), parts // 8), "shard").sortWithinPartitions("shard", "sig", "doc_id", F.crc32("ids"))
    return ordered.select("shard", "doc_id", "ids").mapInArrow(run, PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    return digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
