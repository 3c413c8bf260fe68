"""Language ID: multinomial naive Bayes over hashed character n-grams.

Results: a text that is null or has no letter (Unicode's categories L) is `und` with score 0; so is every text if nothing
could be learned. Overlapping grams are not independent evidence, so a text's log likelihoods weigh as those of EVIDENCE grams
at most; that tempers its score, as the prior then counts as much as beside a short text. A very long text is scored whole, part by part; extra columns are kept, an empty table gives an empty
table, repeated rows are each predicted alike, ties of two languages go to the first in the alphabet, and a row without a
doc_id is neither learned from nor held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
LETTER = re.compile(r"[^\W\d_]")
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
EVIDENCE = 60
#: Code points that are scored at a time; a longer text goes part by part.
CHUNK = 1 << 18


def has_letter(text: str) -> bool:
    """Is a character of Unicode's categories L in it? (The pattern also finds number signs such as superscripts.)"""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def grams(points: np.ndarray, left: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the hash bucket of the gram that starts at each code point; BUCKETS where its text (of which `left` are left) ends before the gram does."""
    h = np.zeros(len(points), np.uint32)
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            return
        h = h[:m] * np.uint32(0x01000193) + points[n - 1 :] * FACTORS[n - 1] + np.uint32(n)
        g = h ^ (h >> np.uint32(15))
        g *= np.uint32(0x2C1B3C6D)
        out = np.full(len(points), BUCKETS, np.uint32)
        out[:m] = (g >> np.uint32(12)) & np.uint32(BUCKETS - 1)
        out[left < n] = BUCKETS
        yield out


def chunks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse batches of about CHUNK code points: which texts (in order, none empty), where each starts, and the lower-case code points with the number left in their text.

    A long text comes in parts; a part's last code points come again, with nothing left, at the start of none: each gram is in just one part."""
    rows, parts, lefts, starts, held = [], [], [], [], 0

    def batch():
        return np.array(rows), np.array(starts), np.concatenate(parts), np.concatenate(lefts)

    for i, text in enumerate(texts):
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(c), CHUNK):
            more = c[at : at + CHUNK + max(ORDERS) - 1]
            left = len(c) - at - np.arange(len(more))
            left[CHUNK:] = 0  # their grams start in the next part
            rows.append(i), parts.append(more), lefts.append(left), starts.append(held)
            held += len(more)
            if held >= CHUNK:
                yield batch()
                rows, parts, lefts, starts, held = [], [], [], [], 0
    if rows:
        yield batch()


class Model:
    """langs, in order, and their log probabilities: BUCKETS x langs float32, at most BUCKETS * 4 bytes a language."""

    def __init__(self, langs: list[str], table: np.ndarray, prior: np.ndarray):
        self.langs, self.prior = langs, prior
        self.table = np.vstack([table, np.zeros((1, len(langs)))]).astype(np.float32)  # a gram that is none adds nothing

    def scores(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        """Language and probability of each text: the rows of gram counts, as a sparse matrix, times the table."""
        strings = [(t or b"").decode("utf-8", "replace") for t in texts]
        told = [bool(self.langs) and has_letter(s) for s in strings]
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for rows, starts, points, left in chunks([s if ok else "" for s, ok in zip(strings, told, strict=True)]):
            for bucket in grams(points, left):
                np.add.at(total, rows, np.add.reduceat(self.table.take(bucket, axis=0), starts, axis=0))
                np.add.at(n, rows, np.add.reduceat((bucket < BUCKETS).astype(np.int64), starts))
        s = self.prior + total * np.minimum(1.0, EVIDENCE / np.maximum(1, n))[:, None]
        p = np.exp(s - s.max(axis=1, keepdims=True)) if self.langs else s
        return [(self.langs[k], float(x[k] / x.sum())) if ok else ("und", 0.0) for ok, x, k in zip(told, p, p.argmax(axis=1) if self.langs else told, strict=True)]


def learned_rows(docs: DataFrame) -> DataFrame:
    """Those whose crc32 of doc_id as text leaves a remainder other than 2 by 4, with a language."""
    return docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2) & F.col("lang").isNotNull())


def fit(docs: DataFrame, fit_docs: int = 40_000, alpha: float = 0.5) -> Model:
    """Learn from about fit_docs of the rows that may be learned from (all, if fewer), picked by the hash of doc_id; whole texts, counted on the executors."""
    rows = learned_rows(docs).select("lang", common.utf8("text").alias("text"), F.xxhash64("doc_id").alias("h"))
    n = rows.count()
    share = min(1.0, fit_docs / max(1, n))
    picked = rows.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, int] = {}
        seen: list[int] = []
        sums = np.zeros((0, BUCKETS + 1), np.int64)
        for b in batches:
            langs = b.column(0).to_pylist()
            for lang in langs:
                if lang not in index:
                    index[lang] = len(index)
                    seen.append(0)
                seen[index[lang]] += 1
            sums = np.vstack([sums, np.zeros((len(index) - len(sums), BUCKETS + 1), np.int64)])
            for rows, starts, points, left in chunks([(t or b"").decode("utf-8", "replace") for t in b.column(1).to_pylist()]):
                of = np.repeat([index[langs[i]] * (BUCKETS + 1) for i in rows.tolist()], np.diff(np.append(starts, len(points))))
                for bucket in grams(points, left):
                    sums += np.bincount(of + bucket, minlength=sums.size).reshape(sums.shape)
        for lang, i in index.items():
            mine = sums[i, :BUCKETS]
            f = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(f) + 1)), pa.array(np.append(f, -1)), pa.array(np.append(mine[f], seen[i]))], ["lang", "bucket", "n"])

    sums = picked.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS + 1 rows a language
    langs = sorted(sums["lang"].unique())
    table, prior = np.full((BUCKETS, len(langs)), alpha), np.zeros(len(langs))
    for i, lang in enumerate(langs):
        mine = sums[sums["lang"] == lang]
        prior[i] = mine.loc[mine["bucket"] < 0, "n"].sum()
        counts = mine[mine["bucket"] >= 0]
        table[counts["bucket"].to_numpy(), i] += counts["n"].to_numpy()
    table = np.log(table / table.sum(axis=0)) if langs else table
    return Model([str(x) for x in langs], table, np.log(prior / prior.sum()) if langs else prior)


def predict(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns (named anew if docs has them already)."""
    pred, score = common.column_named(docs, pred), common.column_named(docs, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.columns
    docs = docs.withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for b in common.slices(whole, "text"):
                texts = b.column(b.schema.get_field_index("text"))
                got = model.scores(texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*kept, pred, score])

    out = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, out)


def identified(docs: DataFrame, least_score: float = 0.5, fit_docs: int = 40_000) -> DataFrame:
    """The documents whose language is told with least_score or more; und goes."""
    pred, score = common.column_named(docs, "lang_pred"), common.column_named(docs, "score")
    return predict(docs, fit(docs, fit_docs)).where((F.col(pred) != "und") & (F.col(score) >= least_score)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    model = fit(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
