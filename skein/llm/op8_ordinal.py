"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(threshold_j - w.x) with one weight vector over hashed words and ordered thresholds. Grades are
quality + 1 - toxic: 0, 1 or 2. Words are scaled by how much their share differs between the top grade and the rest, which
lets rare telling words weigh as much as they should under a common penalty. Prediction gives the expected grade and the tail probability of the top grade;
documents over the calibrated cut are kept.

Results: a null text has no features and gets the grade of the thresholds alone; without ratings every document has
a null grade and probability and is kept; rows with a null rating are not learned from; of several ratings of a
document, and of several documents of a rated doc_id, all count; a very long text counts whole; equal documents get equal
grades, and of equally good cuts the middle one is taken; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 18
EDGES = b"!?.,;:'\"()[]{}-_/\\@^~`+=#*$%&|<>0123456789"


class Buckets(dict):
    """A word to its two buckets: its lower-case core, and the shape of what surrounds the core."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        core = word.strip(EDGES)
        shape = b"\x01%b|%b|%d" % (word[: len(word) - len(word.lstrip(EDGES))][:3], word[len(word.rstrip(EDGES)) :][:3], core.isupper() and len(core) > 1)
        out = tuple(xxhash.xxh3_64_intdigest(x) >> (64 - BITS) for x in (core.decode("utf-8", "replace").lower().encode(), shape))
        if len(self) < common.CACHE_WORDS and len(word) <= common.CACHE_WORD_BYTES:
            self[word] = out
        return out


def vector(text: bytes | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the whole text and log-damped counts of unit length."""
    ws = common.words(text)
    if not ws:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    found, n = np.unique(np.array([buckets[w] for w in ws], np.int32), return_counts=True)
    v = np.log1p(n)
    return found.astype(np.int32), (v / np.sqrt((v * v).sum())).astype(np.float32)


def contrast(docs: list[tuple[np.ndarray, np.ndarray]], top: np.ndarray, smooth: float = 2.0) -> np.ndarray:
    """For each bucket the log ratio of its document share below and at the top grade; 0 if too few of the documents have it."""
    counts = np.zeros((2, 1 << BITS))
    for (idx, _), t in zip(docs, top, strict=True):
        counts[int(t), idx] += 1
    n = np.array([(~top).sum(), top.sum()], float)
    share = (counts + smooth * (n / n.sum())[:, None]) / (n + smooth)[:, None]
    enough = counts.sum(axis=0) >= min(10, max(1, len(docs) // 100))
    return np.where(enough, np.log(share[0] / share[1]) * 3, 0.0) if n.min() else enough * 3.0


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    def __init__(self, grades: int):
        self.w = np.zeros(1 << BITS, np.float64)
        self.first, self.gaps = -1.0, np.zeros(max(0, grades - 2))  # thresholds: first, then exp(gap) apart

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])

    def gradients(self, score: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The mean negative log likelihood of grades y at the scores, and its derivatives by score and by (first, *gaps)."""
        cuts = np.concatenate([[-np.inf], self.thresholds, [np.inf]])
        up, low = sigmoid(cuts[y + 1] - score), sigmoid(cuts[y] - score)
        p, du, dl = np.maximum(up - low, 1e-9), up * (1 - up), low * (1 - low)
        g_cut = np.zeros(len(cuts))
        np.add.at(g_cut, y + 1, -du / p)
        np.add.at(g_cut, y, dl / p)
        g_cut = g_cut[1:-1] / len(y)
        g_t = np.concatenate([[g_cut.sum()], [g_cut[j + 1 :].sum() * np.exp(self.gaps[j]) for j in range(len(self.gaps))]])
        return float(-np.log(p).mean()), (du - dl) / p / len(y), g_t

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 20, batch: int = 128, rate: float = 0.3, decay: float = 1e-3, seed: int = 3) -> None:
        """Adagrad on the penalised negative log likelihood. Thresholds stay ordered because only their log gaps move."""
        scale = contrast(docs, y == len(self.gaps) + 1)
        docs = [(i[scale[i] != 0], v[scale[i] != 0] * scale[i][scale[i] != 0]) for i, v in docs]
        rng, seen, seen_t = np.random.default_rng(seed), np.full(1 << BITS, 1e-8), np.full(1 + len(self.gaps), 1e-8)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), batch):
                mine = order[at : at + batch]
                idx, val = np.concatenate([docs[i][0] for i in mine]), np.concatenate([docs[i][1] for i in mine])
                row = np.repeat(np.arange(len(mine)), [len(docs[i][0]) for i in mine])
                _, g_score, g_t = self.gradients(np.bincount(row, self.w[idx] * val, minlength=len(mine)), y[mine])
                found, inv = np.unique(idx, return_inverse=True)
                g = np.bincount(inv, g_score[row] * val) + decay * self.w[found]
                seen[found] += g * g
                self.w[found] -= rate * g / np.sqrt(seen[found])
                seen_t += g_t * g_t
                step = 0.1 * g_t / np.sqrt(seen_t)
                self.first -= step[0]
                self.gaps -= step[1:]
        self.w *= scale

    def probabilities(self, doc: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        below = sigmoid(self.thresholds - float(self.w[doc[0]] @ doc[1]))
        return np.diff(np.concatenate([[0.0], below, [1.0]]))


def rated(labels: DataFrame) -> DataFrame:
    """doc_id and grade of each rating."""
    return labels.where("quality is not null and toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))


def _fit_rows(docs: DataFrame, ratings: DataFrame, fit_docs: int, fit_features: int) -> list:
    """Rows grade, idx, val of the documents that are learned from."""
    h = F.xxhash64("doc_id")
    picked = common.hash_share(ratings, h, fit_docs, ratings.count()).orderBy(h, "doc_id", "grade").limit(fit_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for b in batches:
            got = [vector(t.as_py(), buckets) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary())], ["h", "grade", "n", "idx", "val"])

    joined = texts.join(F.broadcast(picked), "doc_id").select("text", h.alias("h"), "grade")  # at most fit_docs rows of two numbers
    vectors = common.staged(joined.mapInArrow(run, "h long, grade int, n long, idx binary, val binary"), "rated-vectors")
    # the first hashes whose documents are within fit_features together; a document counts as 64 at least, which bounds the rows
    by_hash = vectors.groupBy("h").agg(F.sum(F.greatest("n", F.lit(64))).alias("n")).orderBy("h").toPandas()  # at most fit_docs rows
    fits = np.flatnonzero(by_hash["n"].cumsum().to_numpy() <= fit_features)
    if len(fits):
        vectors = vectors.where(F.col("h") <= int(by_hash["h"][int(fits[-1])]))
    else:  # the first doc_id alone has more, in very many rows
        vectors = vectors.orderBy("h", "n", "idx").limit(max(1, fit_features >> BITS))
    return vectors.select("grade", "idx", "val").collect()


def train(docs: DataFrame, ratings: DataFrame, fit_docs: int = 12_000, fit_features: int = 8_000_000, keep_good: float = 0.995) -> tuple[Ordinal, float] | None:
    """The model and the cut on the tail probability, from at most fit_docs rated documents picked by the hash of doc_id, with at most fit_features features together (8 bytes each), the first by that hash.

    A fifth of them is held out of the fit and sets the cut: the value that best tells top grades from others while
    keep_good of the top grades stay."""
    rows = _fit_rows(docs, ratings, fit_docs, fit_features)
    if not rows:
        return None
    rows.sort(key=lambda r: (r.grade, r.idx, r.val))
    vectors = [(np.frombuffer(r.idx, np.int32), np.frombuffer(r.val, np.float32)) for r in rows]
    y = np.array([r.grade for r in rows])
    held = np.random.default_rng(9).permutation(len(rows)) % 5 == 0
    if held.all() or not held.any():
        held[:] = False
    model = Ordinal(3)
    model.fit([v for v, h in zip(vectors, held, strict=True) if not h], y[~held])
    test = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    tail = np.array([model.probabilities(vectors[i])[-1] for i in test])
    top, rest = np.sort(tail[y[test] == 2]), np.sort(tail[y[test] < 2])
    if not len(top):
        return model, 0.5
    cuts = np.linspace(0.001, 0.999, 999)
    kept = 1 - np.searchsorted(top, cuts) / len(top)
    gone = np.searchsorted(rest, cuts) / max(1, len(rest))
    merit = np.where(kept >= keep_good, kept + gone, -1)
    best = np.flatnonzero(merit == merit.max())
    return model, float(cuts[best[len(best) // 2]])


def grade(docs: DataFrame, trained: tuple[Ordinal, float] | None) -> DataFrame:
    """doc_id, expected_grade, p_top and kept for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(trained)  # 2 MB of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for b in batches:
            if shared.value is None:
                none = pa.nulls(b.num_rows, pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(0), none, none, pa.array([True] * b.num_rows)], ["doc_id", "expected_grade", "p_top", "kept"])
                continue
            model, cut = shared.value
            p = np.array([model.probabilities(vector(t.as_py(), buckets)) for t in b.column(1)]).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p @ np.arange(p.shape[1])), pa.array(p[:, -1]), pa.array(p[:, -1] >= cut)], ["doc_id", "expected_grade", "p_top", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8("text").alias("text")).mapInArrow(run, "doc_id long, expected_grade double, p_top double, kept boolean")


def op8_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, expected_grade, p_top, kept."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return grade(docs, train(docs, rated(labels)))
