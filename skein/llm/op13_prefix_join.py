"""N-gram Jaccard join: a grouped prefix join of the documents' sets of 3-word shingles.

1. Texts with the same lower-cased words are one text. The frequency of each shingle among distinct texts, coded to an eighth
   of an octave, comes from an exchange of packed hashes; (code, hash) orders all shingles, rare ones first.
2. A set of n shingles that links with another shares one of its first n - ceil(0.9 n) + 1 in that order (its prefix). Texts
   with the same prefix and size are one group; where a prefix has a shingle of its own text alone, so has the group.
3. Groups meet by a prefix shingle and a size class one tenth wide: a group offers its whole prefix as the larger side, to its
   own class and the one below, and only the first n - ceil(18 n / 19) + 1 shingles as the smaller side. A meeting without a
   smaller side or with one group is dropped, and meetings of the very same groups count once.
4. Groups expand to their members, which also meet one another. Members that meet, directly or in a chain, are dealt to
   blocks of bounded bytes and rows and verified there: first by what their sizes and their counts of shared shingles allow,
   then by the intersection. Pairs that are connected already are passed over; none is emitted. A meeting that is larger than
   a block is compared by delegates of its clusters, then in tiles of two blocks (see op9's `links`).
5. Connected components of the links, named by their smallest doc_id.

Only the shingles that two texts share are kept for comparison; an unshared one counts in the sizes.

Results: null texts and texts without words have an empty set and are components of their own; texts of fewer than three
words are one shingle; rows with a null doc_id have a null component and link with nothing; rows that repeat a doc_id each
keep their own size and are one document in the components; a very long text is compared whole, as one row; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches, common
from . import op9_weighted_minhash as near
from .components import components

SHINGLE = 3
#: Links: 100 * intersection >= 90 * union.
NUMERATOR, DENOMINATOR = 90, 100
#: Width of a size class, as a difference of logarithms: a little over that of two sizes that can still link.
CLASS = math.log(DENOMINATOR / NUMERATOR) * 1.0001
#: Id of a text that only rows without a doc_id have: it has a size and no links.
NOBODY = 2**63 - 1


def words(text: bytes | None) -> list[bytes]:
    """Words with A-Z in lower case."""
    return text.lower().split() if text else []  # bytes.lower() changes A-Z alone


def shingled(h: np.ndarray) -> tuple[np.ndarray, None]:
    """The distinct shingles of a row of word hashes, ascending."""
    s = np.sort(common.ngrams(h, SHINGLE) if len(h) >= SHINGLE else common.ngrams(h, len(h), 77))
    return s[common.starts_of(s)], None


def prefix_lengths(n: int) -> tuple[int, int]:
    """Of a set of n: the prefix that it offers as the larger side, and as the smaller one."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1, n - -(-2 * NUMERATOR * n // (NUMERATOR + DENOMINATOR)) + 1


def linked(both: int, na: int, nb: int) -> bool:
    return DENOMINATOR * both >= NUMERATOR * (na + nb - both)


class Sets(near.Clusters):
    """Texts with their shared shingles and sizes, and a union-find over them."""

    def of(self, i: int) -> tuple[np.ndarray, int]:
        got = self.vector.get(i)
        if got is None:
            keys, n = pickle.loads(self.rows[i][1])
            got = self.vector[i] = (np.frombuffer(keys, np.uint64), n)
        return got

    def similar(self, i: int, j: int) -> bool:
        pair = (min(i, j), max(i, j))
        if pair in self.failed:
            return False
        (a, na), (b, nb) = self.of(i), self.of(j)
        if len(a) > len(b):
            a, b = b, a
        good = linked(len(a), na, nb)
        if good:
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            good = linked(int(np.count_nonzero(b[at] == a)), na, nb)
        if not good:
            self.failed.add(pair)
        return good


def _texts(blobs) -> near.Texts:
    t = near.Texts(blobs, shingled)
    t.copies = np.ones_like(t.copies)  # frequencies count distinct texts
    return t


PREFIXES = "doc long, batch int, digest binary, n int, family binary, tokens array<long>, small int, codes binary"


def _prefixes(left: pa.Table, right: pa.Table) -> pa.Table:
    """PREFIXES rows of one batch: the prefix's shingles that other texts have, how many of them the smaller side offers, and the codes."""
    docs, digests, sizes, families, tokens, small, kept = [], [], [], [], [], [], []
    if left.num_rows:
        t = _texts(left["blob"])
        keys, _ = near.frequency_request(t)
        code = batches.answers(right, np.uint8)
        keys, code = keys[code > 0], code[code > 0]
        z = zstandard.ZstdCompressor(level=1)
        for d, text, (s, _) in zip(t.id.tolist(), t.text, t.shingles(), strict=True):
            mine, n = near.df_codes(s, keys, code), len(s)
            large, least = prefix_lengths(n)
            first = np.lexsort((s, mine))[:large]
            live = np.flatnonzero(mine[first]) if d != NOBODY else np.empty(0, np.int64)
            docs.append(d)
            digests.append(xxhash.xxh3_128_digest(text))
            sizes.append(n)
            families.append(xxhash.xxh3_128_digest(n.to_bytes(8, "big") + s[first].tobytes()) if len(live) else None)
            tokens.append(s[first[live]].view(np.int64).tolist())
            small.append(int((live < least).sum()))
            kept.append(z.compress(mine.tobytes()) if len(live) else None)
    batch = [left["batch"][0].as_py()] * len(docs) if docs else []
    return pa.table({
        "doc": pa.array(docs, pa.int64()), "batch": pa.array(batch, pa.int32()), "digest": pa.array(digests, pa.binary()), "n": pa.array(sizes, pa.int32()),
        "family": pa.array(families, pa.binary()), "tokens": pa.array(tokens, pa.list_(pa.int64())), "small": pa.array(small, pa.int32()), "codes": pa.array(kept, pa.binary()),
    })


def _sets(left: pa.Table, right: pa.Table) -> pa.Table:
    """doc and vector (shared shingles and size) of the texts of a batch that are wanted."""
    docs, out = [], []
    wanted = dict(zip(right["digest"].to_pylist(), right["codes"].to_pylist(), strict=True))
    if left.num_rows and wanted:
        t = _texts(left["blob"])
        z = zstandard.ZstdDecompressor()
        for d, text in zip(t.id.tolist(), t.text, strict=True):
            codes = wanted.get(xxhash.xxh3_128_digest(text))
            if codes is not None:
                s, _ = shingled(common.word_hash().array(text.split(b" ")))
                docs.append(d)
                out.append(pickle.dumps((s[np.frombuffer(z.decompress(codes), np.uint8) > 0].tobytes(), len(s)), 5))
    return pa.table({"doc": pa.array(docs, pa.int64()), "vector": pa.array(out, pa.binary())})


def meetings(prefixes: DataFrame) -> DataFrame:
    """family and bands: the meetings of each group that could hold a link with another group."""
    groups = prefixes.where("family is not null").groupBy("family").agg(F.min(F.struct("n", "tokens", "small")).alias("g")).select("family", "g.*")  # equal in all members
    own = F.floor(F.log(F.col("n").cast("double")) / CLASS).cast("int")
    offers = groups.select("family", "small", own.alias("own"), F.posexplode("tokens").alias("at", "token")).select("family", "token", "small", "at", "own", F.explode(F.array("own", F.col("own") - 1)).alias("size"))
    offers = common.staged(offers.select("family", F.xxhash64("token", "size").alias("band"), ((F.col("at") < F.col("small")) & (F.col("size") == F.col("own"))).alias("smaller")), "join-offers")
    met = offers.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("smaller").alias("any"), *(F.bit_xor(F.xxhash64("family", F.lit(i))).alias(f"x{i}") for i in (1, 2)))
    bands = met.where("n > 1 and any").groupBy("n", "x1", "x2").agg(F.min("band").alias("band")).select("band")
    return offers.join(bands, "band", "left_semi").groupBy("family").agg(F.collect_set("band").alias("bands"))  # at most twice its prefix


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = batches.BATCH_BYTES, bucket_hashes: int = batches.BUCKET_HASHES, block_bytes: int = near.BLOCK_BYTES, block_rows: int = near.BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), common.utf8(text).alias("text"))
    named = common.staged(near.digests(rows, words), "join-digests")
    real = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(NOBODY)))
    n_batches, n_buckets = batches.sizes(real, batch_bytes, bucket_hashes)
    held = batches.gathered(near.packed_texts(real, n_batches, words), n_batches)

    def ask(t: pa.Table) -> pa.Table:
        return batches.request(t["batch"][0].as_py(), *near.frequency_request(_texts(t["blob"])), n_buckets)

    codes = common.staged(batches.answered(held.groupBy("batch").applyInArrow(common.tidy(ask), batches.SENT), near.frequency_answer, np.uint32, n_buckets), "join-df", "none")
    prefixes = common.staged(held.groupBy("batch").cogroup(codes.groupBy("batch")).applyInArrow(common.tidy(_prefixes), PREFIXES), "join-prefixes")

    # the nodes of the join are texts, by their smallest doc_id
    firsts = named.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"))
    family_size = prefixes.where("family is not null").groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    met = family_size.join(meetings(prefixes), "family", "left")
    within = F.when(F.col("members") > 1, F.array(F.xxhash64("family"))).otherwise(F.array().cast("array<long>"))
    met = met.select("family", F.concat(F.coalesce("bands", F.array().cast("array<long>")), within).alias("bands")).where(F.size("bands") > 0)
    chosen = prefixes.where("family is not null").select("doc", "batch", "digest", "family", "codes").join(met, "family").drop("family")
    chosen = common.staged(chosen, "join-chosen")
    by_band = chosen.select("doc", F.explode("bands").alias("band"))
    heads = by_band.groupBy("band").agg(F.min("doc").alias("head"))
    provisional = components(by_band.join(heads, "band").select(F.col("doc").alias("a"), F.col("head").alias("b")))
    members = chosen.join(provisional, F.col("doc") == F.col("node")).select("doc", "bands", "component")
    sets = common.staged(held.groupBy("batch").cogroup(chosen.select("batch", "digest", "codes").groupBy("batch")).applyInArrow(common.tidy(_sets), "doc long, vector binary"), "join-sets", "none")
    found = near.links(members, sets, 0, 0.0, block_bytes, block_rows, Sets)

    # rows that repeat a doc_id with other words are one document
    of = named.where("doc_id is not null").join(firsts, "digest")
    again = of.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a <> b").select("doc_id", "a")
    classes = components(found.unionByName(of.join(again, "doc_id").select("a", F.col("first").alias("b"))))
    held.unpersist()

    by_digest = prefixes.select("digest", "n").join(firsts, "digest", "left").join(classes, F.col("first") == F.col("node"), "left").select("digest", "n", F.coalesce("component", "first").alias("component"))
    full = named.where("digest is not null").join(by_digest, "digest").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    empty = named.where("digest is null").join(of.join(classes, F.col("first") == F.col("node"), "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "first")).alias("component")), "doc_id", "left")
    return full.unionByName(empty.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))


def op13_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))
