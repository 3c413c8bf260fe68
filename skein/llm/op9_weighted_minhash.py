"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. Texts with the same words are one text; its digest groups them, and copies are counted, not compared.
2. Document frequencies of all 5-word shingles, over all documents (copies count), by an exchange of packed hashes.
3. Each distinct text gets weights tf * idf and BANDS * ROWS consistent weighted samples (Ioffe, 2010); a band is a hash
   of ROWS samples.
4. Texts that share a band form provisional components. The members' shingles meet in blocks of bounded bytes and rows, and
   within a block every two members of a band that are not yet connected are compared; weighted Jaccard of `threshold`
   links them, and so does plain Jaccard of their sets of shingles.
   A component that is larger than a block is compared in more rounds: one delegate of each cluster in a band, then, for the
   bands that still span clusters, tiles of two blocks; the largest cluster of a band meets the others and not itself.
   Vectors are fetched for what is compared alone. No pair of a band is left out and none is emitted.
5. Connected components of the links are the classes; a class is named by its smallest doc_id.

idf is 1 + ln(N / df) / ln(N), from 1 to 2: rare shingles count up to twice. A group's own copies raise the df of what they
share and so can push its members below the threshold of weighted Jaccard, which is why plain Jaccard links as well. df is
taken at an eighth of an octave.

Results: texts without words are each a class of their own, as are null doc_ids (with a null class); texts of fewer words
than a shingle are one shingle; repeated doc_ids are one document, in the class of its smallest text; a very long text is
compared whole, as one row; an empty table gives an empty table; other columns are ignored (near_dedup keeps them).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches, common
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 9, 4
#: Members whose shingles a task compares at a time.
BLOCK_BYTES, BLOCK_ROWS = 24 << 20, 128
#: Rounds of delegates, at most; what they leave goes to the tiles.
ROUNDS = 3
SHIFT = np.uint64(64 - batches.KEY_BITS)
#: One odd constant for each sample, and the finaliser's multiplier.
_A = common._odd(BANDS * ROWS, 101)
_M = np.uint64(0xD6E8FEB86659FD93)


def gamma_quantiles(n: int) -> np.ndarray:
    """n equally likely values of a Gamma(2, 1) variable, by bisection of its distribution 1 - (1 + x) exp(-x)."""
    u, low, high = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 64.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < u
        low, high = np.where(below, x, low), np.where(below, high, x)
    return low.astype(np.float32)


_R = gamma_quantiles(4096)


def shingles(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a row of word hashes, ascending, and their counts."""
    s = np.sort(common.ngrams(h, SHINGLE) if len(h) >= SHINGLE else common.ngrams(h, len(h), 77))
    at = common.starts_of(s)
    return s[at], np.diff(np.append(at, len(s)))


def idf_of(code: np.ndarray, n_docs: int) -> np.ndarray:
    """idf from df codes, 8 to an octave."""
    return 1 + np.maximum(0, 1 - code * (np.log(2) / 8) / np.log(max(2, n_docs)))


def samples(s: np.ndarray, log_w: np.ndarray) -> np.ndarray:
    """BANDS * ROWS consistent weighted samples of one document, each as a hash of (shingle, t)."""
    k, n = BANDS * ROWS, len(s)
    out = np.empty(k, np.uint64)
    step = max(1, 65_536 // n)
    lw = log_w.astype(np.float32)
    for at in range(0, k, step):
        # 64 bits of a hash: 12 for r, 12 for beta, and twice 20 for c
        a = s * _A[at : at + step, None]
        a ^= a >> np.uint64(29)
        a *= _M
        a ^= a >> np.uint64(32)
        high, low = (a >> np.uint64(32)).astype(np.uint32), a.astype(np.uint32)
        r = _R.take(high >> np.uint32(20))
        beta = (low >> np.uint32(20)).astype(np.float32) * np.float32(2.0**-12)
        both = ((high & np.uint32(0xFFFFF)).astype(np.float32) + np.float32(0.5)) * ((low & np.uint32(0xFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-40)
        t = np.floor(lw / r + beta)
        score = np.log(-np.log(both)) - r * (t - beta + np.float32(1))
        best = score.argmin(axis=1)
        rows = np.arange(len(best))
        out[at : at + step] = common.mix(s[best] + t[rows, best].astype(np.int64).astype(np.uint64) * _M)
    return out


def bands(sample: np.ndarray) -> np.ndarray:
    """One key for each band, as int64."""
    h = np.zeros(BANDS, np.uint64)
    for j, m in enumerate(common._odd(ROWS, 103)):
        h += sample.reshape(BANDS, ROWS)[:, j] * m
    return common.mix(h + np.arange(BANDS, dtype=np.uint64) * _M).view(np.int64)


# --- steps 1 and 2 -----------------------------------------------------------------------------------------


def digests(docs: DataFrame, words: Callable = common.words) -> DataFrame:
    """doc_id and digest of the words (null without words) of each row with a doc_id."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [b" ".join(words(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_digest(g) if g else None for g in got], pa.binary())], ["doc_id", "digest"])

    return docs.mapInArrow(run, "doc_id long, digest binary")


class Texts:
    """The distinct texts of a batch: smallest doc_id, number of copies, and words."""

    def __init__(self, blobs, shingled: Callable = shingles):
        found: dict[bytes, list] = {}
        z = zstandard.ZstdDecompressor()
        for blob in blobs:
            for digest, text, first, copies in pickle.loads(z.decompress(blob.as_py())):
                have = found.get(digest)
                if have is None:
                    found[digest] = [text, first, copies]
                else:
                    have[1], have[2] = min(have[1], first), have[2] + copies
        rows = sorted(found.values(), key=lambda r: r[1])
        self.shingled = shingled
        self.text, self.id, self.copies = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        self._shingles = None

    def shingles(self) -> list[tuple[np.ndarray, np.ndarray]]:
        if self._shingles is None:
            hashed = common.word_hash()
            self._shingles = [self.shingled(hashed.array(t.split(b" "))) for t in self.text]
        return self._shingles


def packed_texts(docs: DataFrame, n_batches: int, words: Callable = common.words) -> DataFrame:
    """(batch, blob): each chunk's distinct texts, dealt by digest. Copies are counted before the shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in it:
            found: dict[bytes, list] = {}
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = b" ".join(words(t.as_py()))
                if not text:
                    continue
                digest = xxhash.xxh3_128_digest(text)
                have = found.setdefault(digest, [text, doc, 0])
                have[1], have[2] = min(have[1], doc), have[2] + 1
            by: dict[int, list] = {}
            for digest, (text, doc, n) in found.items():
                by.setdefault(int.from_bytes(digest[:8], "big") % n_batches, []).append((digest, text, doc, n))
            for k, rows in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([z.compress(pickle.dumps(rows, 5))], pa.binary())], ["batch", "blob"])

    return docs.mapInArrow(run, "batch int, blob binary")


def frequency_request(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the batch's shingles and the number of its documents with each."""
    parts = [s >> SHIFT for s, _ in t.shingles()]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    return summed(np.concatenate(parts), np.repeat(t.copies, [len(p) for p in parts]))


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit keys, ascending, and the sums of n."""
    if n.max(initial=0) < 1 << 16:  # sort key and count as one number: several times as fast
        v = np.sort(key << np.uint64(16) | n.astype(np.uint64))
        k, n = v >> np.uint64(16), (v & np.uint64(0xFFFF)).astype(np.int64)
    else:
        order = np.argsort(key)
        k, n = key[order], n[order].astype(np.int64)
    s = common.starts_of(k)
    return k[s], (np.add.reduceat(n, s) if len(s) else n).astype(np.uint32)


def frequency_answer(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """The df code of each key: 8 log2(df), rounded."""
    k, n = summed(np.concatenate(keys), np.concatenate(counts))
    k, n = k[n > 1], n[n > 1]
    code = np.rint(8 * np.log2(n)).astype(np.uint8)
    out = []
    for mine in keys:
        got = np.zeros(len(mine), np.uint8)
        here, there = batches.member(mine, k)
        got[here] = code[there]
        out.append(got)
    return out


def df_codes(s: np.ndarray, keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Codes of a document's shingles; keys: those of codes over 0, ascending."""
    out = np.zeros(len(s), np.uint8)
    at = np.searchsorted(keys, s >> SHIFT)
    at[at == len(keys)] = 0
    if len(keys):
        same = keys[at] == s >> SHIFT
        out[same] = codes[at[same]]
    return out


# --- step 4 ------------------------------------------------------------------------------------------------


class Clusters:
    """Texts with their shingles and weights, and a union-find over them."""

    def __init__(self, rows: list[tuple[int, bytes, int]], n_docs: int, threshold: float):
        """rows: (id, shingles as packed by vectors(), cluster that the text is in so far)."""
        self.rows, self.n, self.threshold = rows, n_docs, threshold
        self.vector: dict[int, tuple] = {}
        self.parent = list(range(len(rows)))
        self.failed: set[tuple[int, int]] = set()
        first: dict[int, int] = {}
        for i, r in enumerate(rows):
            self.join(i, first.setdefault(r[2], i))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray, float]:
        got = self.vector.get(i)
        if got is None:
            keys, tf, code = pickle.loads(self.rows[i][1])
            w = np.frombuffer(tf, np.uint32) * idf_of(np.frombuffer(code, np.uint8), self.n)
            got = self.vector[i] = (np.frombuffer(keys, np.uint64), w, float(w.sum()))
            if len(self.vector) > 4096:
                self.vector.pop(next(iter(self.vector)))
        return got

    def similar(self, i: int, j: int) -> bool:
        pair = (min(i, j), max(i, j))
        if pair in self.failed:
            return False
        (ka, wa, ta), (kb, wb, tb) = self.of(i), self.of(j)
        least, na, nb = self.threshold * (1 - 1e-9), len(ka), len(kb)
        good = min(ta, tb) >= least * max(ta, tb) or min(na, nb) >= least * max(na, nb)
        if good:
            at = np.searchsorted(kb, ka)
            at[at == len(kb)] = 0
            same = kb[at] == ka
            both = float(np.minimum(wa[same], wb[at[same]]).sum())
            n = int(np.count_nonzero(same))
            good = both >= least * (ta + tb - both) or n >= least * (na + nb - n)
        if not good:
            self.failed.add(pair)
        return good

    def compare(self, members: list[int], others: list[int] | None = None) -> None:
        """Compare every two of members, or each of members with each of others, that are not connected yet; a cluster's first member is tried before the rest."""
        clusters: dict[int, list[int]] = {}
        for i in others or ():
            clusters.setdefault(self.root(i), []).append(i)
        for i in members:
            mine = self.root(i)
            for root in list(clusters):
                if self.root(root) != mine and any(self.similar(i, j) for j in clusters[root]):
                    self.join(i, root)
                    mine = self.root(i)
            if others is None:
                clusters.setdefault(mine, []).append(i)
                for root in [r for r in clusters if r != mine and self.root(r) == mine]:
                    clusters[mine] += clusters.pop(root)
            else:
                for root in [r for r in clusters if self.root(r) != r]:
                    clusters.setdefault(self.root(root), []).extend(clusters.pop(root))

    def result(self, names: list[int] | None = None) -> pa.Table:
        """Links of each text, by its id or the name given, to the smallest of its cluster."""
        names = names or [r[0] for r in self.rows]
        least: dict[int, int] = {}
        for i, name in enumerate(names):
            k = self.root(i)
            least[k] = min(least.get(k, name), name)
        pairs = [(name, least[self.root(i)]) for i, name in enumerate(names)]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


LINKS = "a long, b long"


def links(members: DataFrame, vectors: DataFrame, n_docs: int, threshold: float, block_bytes: int, block_rows: int, kind: type = Clusters) -> DataFrame:
    """members: doc, bands, component; vectors: doc, vector, both staged; kind compares them. Returns links (a, b) that connect the texts of each class."""
    sized = members.join(vectors.select("doc", F.length("vector").alias("bytes")), "doc")
    total = sized.groupBy("component").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    blocks = F.greatest(F.ceil(F.col("bytes") / block_bytes), F.ceil(F.col("n") / block_rows)).cast("int").alias("blocks")
    members = common.staged(members.join(total.select("component", blocks), "component").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")), "near-members")

    def clusters(t: pa.Table) -> Clusters:
        return kind(list(zip(t["doc"].to_pylist(), t["vector"].to_pylist(), t["cluster"].to_pylist(), strict=True)), n_docs, threshold)

    def within(t: pa.Table) -> pa.Table:
        ids = t["doc"].to_pylist()
        c = clusters(t)
        by: dict[int, list[int]] = {}
        for i, keys in sorted(enumerate(t["bands"].to_pylist()), key=lambda x: ids[x[0]]):
            for k in keys:
                by.setdefault(k, []).append(i)
        for group in by.values():
            if len(group) > 1:
                c.compare(group)
        return c.result()

    # each text is in one block: its link is its cluster so far
    out = common.staged(members.join(vectors, "doc").withColumn("cluster", F.col("doc")).groupBy("component", "block").applyInArrow(within, LINKS), "near-links")

    def spanning(rows: DataFrame) -> DataFrame:
        """Of rows (band, doc, cluster) those of bands that span clusters."""
        wide = rows.groupBy("band").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low < high").select("band")
        return common.staged(rows.join(wide, "band", "left_semi"), "near-left")

    def delegates(t: pa.Table) -> pa.Table:
        c = clusters(t)
        c.compare(list(range(t.num_rows)))
        return c.result(t["cluster"].to_pylist())

    large = members.where("blocks > 1").select("doc", F.explode("bands").alias("band"))
    left = spanning(large.join(out.select(F.col("a").alias("doc"), F.col("b").alias("cluster")), "doc").select("band", "doc", "cluster"))
    for _ in range(ROUNDS):
        if left.isEmpty():
            return out
        # a band with very many clusters is dealt out; its parts meet in the next round, or in the tiles
        each = left.groupBy("band", "cluster").agg(F.min("doc").alias("doc"))
        parts = each.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
        each = common.staged(each.join(parts, "band").withColumn("part", F.pmod(F.xxhash64("cluster"), F.col("parts")).cast("int")), "near-delegates")
        merged = common.staged(each.join(vectors, "doc").groupBy("band", "part").applyInArrow(delegates, LINKS), "near-links")
        out = out.unionByName(merged)
        left = spanning(left.join(components(merged), F.col("cluster") == F.col("node"), "left").select("band", "doc", F.coalesce("component", "cluster").alias("cluster")))
        if each.where("parts > 1").isEmpty():
            break

    # of a band's clusters the largest is dealt to `wide` blocks, behind the `rest` blocks of all others; it has links within
    held = left.groupBy("band", "cluster").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("band").agg(F.max(F.struct("n", "cluster")).alias("top"), F.sum("n").alias("n"))
    size = held.select("band", F.col("top.cluster").alias("top"), F.ceil(F.col("top.n") / block_rows).cast("int").alias("wide"), F.ceil((F.col("n") - F.col("top.n")) / block_rows).cast("int").alias("rest"))
    own = F.when(F.col("cluster") == F.col("top"), F.col("rest") + F.pmod(F.xxhash64("doc"), F.col("wide"))).otherwise(F.pmod(F.xxhash64("doc"), F.col("rest"))).cast("int")
    meets = F.when(F.col("own") >= F.col("rest"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("wide") - 1))
    tiles = left.join(size, "band").withColumn("own", own).withColumn("other", F.explode(meets)).select("band", "doc", "cluster", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def tile(t: pa.Table) -> pa.Table:
        c = clusters(t)
        own, i, j = t["own"].to_pylist(), t["i"][0].as_py(), t["j"][0].as_py()
        c.compare(list(range(len(own)))) if i == j else c.compare([x for x, o in enumerate(own) if o == i], [x for x, o in enumerate(own) if o == j])
        return c.result()

    return out.unionByName(tiles.join(vectors, "doc").groupBy("band", "i", "j").applyInArrow(tile, LINKS))


# --- the operator --------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, batch_bytes: int = batches.BATCH_BYTES, bucket_hashes: int = batches.BUCKET_HASHES, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id and class_id of every document."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), common.utf8(text).alias("text"))
    real = rows.where("doc_id is not null")
    named = common.staged(digests(real), "near-digests")
    n_docs = named.count()
    n_batches, n_buckets = batches.sizes(real, batch_bytes, bucket_hashes)
    held = batches.gathered(packed_texts(real, n_batches), n_batches)

    def ask(t: pa.Table) -> pa.Table:
        return batches.request(t["batch"][0].as_py(), *frequency_request(Texts(t["blob"])), n_buckets)

    codes = common.staged(batches.answered(held.groupBy("batch").applyInArrow(common.tidy(ask), batches.SENT), frequency_answer, np.uint32, n_buckets), "near-df", "none")

    def sketch(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, keys_of, codes_of = [], [], []
        if left.num_rows:
            t = Texts(left["blob"])
            keys, _ = frequency_request(t)
            code = batches.answers(right, np.uint8)
            keys, code = keys[code > 0], code[code > 0]
            z = zstandard.ZstdCompressor(level=1)
            for d, (s, tf) in zip(t.id.tolist(), t.shingles(), strict=True):
                mine = df_codes(s, keys, code)
                docs.append(d)
                keys_of.append(bands(samples(s, np.log(tf * idf_of(mine, n_docs)))).tolist())
                codes_of.append(z.compress(mine.tobytes()))
        return pa.table({"doc": pa.array(docs, pa.int64()), "batch": pa.array([left["batch"][0].as_py()] * len(docs) if docs else [], pa.int32()), "bands": pa.array(keys_of, pa.list_(pa.int64())), "codes": pa.array(codes_of, pa.binary())})

    sketched = common.staged(held.groupBy("batch").cogroup(codes.groupBy("batch")).applyInArrow(common.tidy(sketch), "doc long, batch int, bands array<long>, codes binary"), "near-bands")
    by_band = sketched.select("doc", F.explode("bands").alias("band"))
    heads = by_band.groupBy("band").agg(F.min("doc").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "head")
    provisional = components(by_band.join(heads, "band").select(F.col("doc").alias("a"), F.col("head").alias("b")))
    chosen = common.staged(sketched.join(provisional, F.col("doc") == F.col("node")).select("doc", "batch", "bands", "component", "codes"), "near-chosen")

    def vector_rows(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, out = [], []
        wanted = dict(zip(right["doc"].to_pylist(), right["codes"].to_pylist(), strict=True))
        if left.num_rows and wanted:
            t = Texts(left["blob"])
            z = zstandard.ZstdDecompressor()
            for d, text in zip(t.id.tolist(), t.text, strict=True):
                if d in wanted:
                    s, tf = shingles(common.word_hash().array(text.split(b" ")))
                    docs.append(d)
                    out.append(pickle.dumps((s.tobytes(), tf.astype(np.uint32).tobytes(), z.decompress(wanted[d])), 5))
        return pa.table({"doc": pa.array(docs, pa.int64()), "vector": pa.array(out, pa.binary())})

    vectors = common.staged(held.groupBy("batch").cogroup(chosen.select("batch", "doc", "codes").groupBy("batch")).applyInArrow(common.tidy(vector_rows), "doc long, vector binary"), "near-vectors", "none")
    classes = components(links(chosen.select("doc", "bands", "component"), vectors, n_docs, threshold, block_bytes, block_rows))
    held.unpersist()

    # digest to class, then document to class
    firsts = named.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"))
    by_digest = firsts.join(classes, F.col("first") == F.col("node"), "left").select("digest", F.coalesce("component", "first").alias("class_id"))
    out = named.join(by_digest, "digest", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return common.staged(out.unionByName(rows.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"))), "near-classes")


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each class, that with the smallest doc_id; rows with a null doc_id stay."""
    classes = near_duplicates(docs, **how)
    gone = classes.where("doc_id <> class_id").groupBy("doc_id").agg(F.count(F.lit(1))).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def op9_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, class_id."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
