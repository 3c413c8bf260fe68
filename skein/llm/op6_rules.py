"""Quality rules: an isolation forest on rule statistics.

Every document gets its rule statistics from its whole text. A forest of random splits is grown, each tree on a sample of
its own from all documents that pass the base rules; short mean path lengths mark anomalies. The threshold comes from all
labelled rows of both kinds that pass the base rules, by how many have each score: the score at which the share of bad ones caught exceeds that of good ones
lost by most.

Results: a null or empty text has zeros and fails the base rules; without rows labelled bad the threshold is the lowest
score at which at most max_good_lost of the good ones are lost, without labelled rows nothing but the base rules rejects; an
empty table gives an empty table; repeated rows are judged alike; a very long text is judged by its whole text; of equally
good thresholds that which keeps most is taken; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines"]
#: Trees of the forest and the documents that each is grown on.
TREES, TREE_ROWS = 100, 256
#: Digits to which scores are rounded for the threshold.
DIGITS = 5
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _c in b"!?.,;:'\"()[]{}-_/\\@^~`+=":
    _CLASS[_c] = 3


def statistics(text: bytes | None, hashed: common.WordHash) -> tuple[int, ...]:
    """STATS of one text."""
    ws = common.words(text)
    if not ws:
        return (0,) * len(STATS)
    joined = b"".join(ws)
    seen, lines, repeated = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\r\x0b\x0c"):
            lines += 1
            repeated += line in seen
            seen.add(line)
    covered = 0
    if len(ws) > 3:
        h = common.ngrams(hashed.array(ws), 3)
        s = np.sort(h)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if len(twice):
            hit = np.isin(h, twice)
            cover = np.zeros(len(ws), bool)
            for j in range(3):
                cover[j : j + len(h)] |= hit
            covered = int(cover.sum())
    raw = np.frombuffer(joined, np.uint8)
    kinds = np.bincount(_CLASS[raw], minlength=4)
    return len(ws), int(((raw & 0xC0) != 0x80).sum()), sum(map(joined.count, SYMBOLS)), repeated, covered, int(kinds[1]), int(kinds[2]), int(kinds[3]), lines


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, STATS and base_failed of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = common.word_hash()
        for b in batches:
            rows = [statistics(t.as_py(), hashed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(STATS)))], ["doc_id", *STATS])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8("text").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} long" for s in STATS))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rates that do not grow with the length of a text."""
    n, c = np.maximum(s["n_words"], 1).astype(float), np.maximum(s["word_chars"], 1).astype(float)
    return np.column_stack([c / n, s["n_symbols"] / n, s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / n, s["n_upper"] / c, s["n_digits"] / c, s["n_marks"] / n])


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary search tree of n leaves."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n < 2, 0.0, np.where(n < 3, 1.0, 2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m))


class Forest:
    """Random trees over samples of 256 rows, as arrays: split feature (-1 at a leaf), split value, left child, path length at a leaf."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 5):
        """x: random rows, a tree's after another's; if they are fewer than trees * rows, the trees share them."""
        rng = np.random.default_rng(seed)
        self.rows, self.trees = min(rows, len(x)), []
        for i in range(trees if len(x) else 0):
            own = x[i * rows : (i + 1) * rows] if len(x) >= trees * rows else x[rng.choice(len(x), self.rows, replace=False)]
            self.trees.append(self._grow(own, rng))

    @staticmethod
    def _grow(x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, value, left, path = [-1], [0.0], [0], [0.0]
        limit = int(np.ceil(np.log2(max(2, len(x)))))
        stack = [(0, x, 0)]
        while stack:
            at, rows, depth = stack.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            wide = np.flatnonzero(high > low)
            if depth >= limit or len(rows) < 2 or not len(wide):
                path[at] = depth + float(average_path(len(rows)))
                continue
            f = int(rng.choice(wide))
            v = float(rng.uniform(low[f], high[f]))
            feature[at], value[at], left[at] = f, v, len(feature)
            for part in (rows[rows[:, f] < v], rows[rows[:, f] >= v]):
                stack.append((len(feature), part, depth + 1)) if len(part) else None
                feature.append(-1), value.append(0.0), left.append(0), path.append(float(depth + 1))
        return np.array(feature), np.array(value), np.array(left), np.array(path)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores from 0 to 1: 2 to the minus mean path length over the expected one."""
        if not self.trees:
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(feature[at], 0)] >= value[at]
                at = np.where(inner, left[at] + go, at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(float(average_path(self.rows)), 1e-9))


def _sample(stats: DataFrame, most: int) -> dict[str, np.ndarray]:
    """At most `most` of the rows, in the order of the hash of doc_id."""
    picked = common.hash_share(stats, F.xxhash64("doc_id"), most, stats.count())
    got = picked.orderBy(F.xxhash64("doc_id"), "doc_id", *STATS).limit(most).select(*STATS).toPandas()
    return {s: got[s].to_numpy() for s in STATS}


def cut(good: np.ndarray, bad: np.ndarray, max_good_lost: float, good_n: np.ndarray | None = None, bad_n: np.ndarray | None = None) -> float:
    """The highest score that is kept, from those of good and bad rows and how many rows have each (one, if not given); of equal cuts that which keeps most."""
    if not len(good):
        return 1.0

    def up_to(x: np.ndarray, n: np.ndarray | None):
        """Rows at or below each of some scores."""
        order = np.argsort(x, kind="stable")
        total = np.append(0, np.cumsum(np.ones(len(x), np.int64) if n is None else n[order]))
        return lambda at: total[np.searchsorted(x[order], at, "right")]

    goods, bads = up_to(good, good_n), up_to(bad, bad_n)
    at = np.unique(np.concatenate([good, bad, [1.0]]))
    if not len(bad):
        n = goods(np.inf)
        return float(at[np.searchsorted(goods(at), min(n - 1, int(np.ceil((1 - max_good_lost) * n))), "right")])
    merit = goods(at) / goods(np.inf) - bads(at) / bads(np.inf)
    return float(at[np.flatnonzero(merit == merit.max())[-1]])


def judge(docs: DataFrame, labels: DataFrame, max_good_lost: float = 0.002) -> DataFrame:
    """doc_id, STATS, base_failed, anomaly and kept for every row of docs.

    max_good_lost counts only if no row is labelled bad."""
    spark = docs.sparkSession
    stats = common.staged(rule_statistics(docs), "rule-statistics")
    passed = stats.where(~F.col("base_failed"))
    forest = Forest(features(_sample(passed, TREES * TREE_ROWS)))
    rated = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    grown = spark.sparkContext.broadcast(forest)  # 100 trees of at most 511 nodes

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = grown.value.scores(features({s: b.column(i).to_numpy() for i, s in enumerate(STATS)}))
            yield pa.RecordBatch.from_arrays([b.column(len(STATS)), pa.array(np.round(score, DIGITS))], ["quality", "score"])

    # every labelled row counts: at most 2 * 10 ** DIGITS + 2 sums reach the driver
    known = passed.join(rated, "doc_id").select(*STATS, "quality").mapInArrow(marks, "quality int, score double").groupBy("quality", "score").count().toPandas()
    good, bad = (known[known["quality"] == q] for q in (1, 0))
    threshold = cut(good["score"].to_numpy(), bad["score"].to_numpy(), max_good_lost, good["count"].to_numpy(), bad["count"].to_numpy())
    shared = spark.sparkContext.broadcast((forest, threshold))  # 100 trees of at most 511 nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, threshold = shared.value
        for b in batches:
            score = forest.scores(features({s: b.column(b.schema.get_field_index(s)).to_numpy() for s in STATS}))
            failed = b.column(b.schema.get_field_index("base_failed")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array(~failed & (np.round(score, DIGITS) <= threshold))], [*b.schema.names, "anomaly", "kept"])

    return stats.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in stats.dtypes) + ", anomaly double, kept boolean")


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: statistics, base_failed and the forest's verdict."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
