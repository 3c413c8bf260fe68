"""Approximate nearest neighbours by a block matrix join of int8 products with error bounds.

Vectors are scaled to unit length and rounded to int8 with a scale of their own. Query blocks and candidate blocks meet in
tiles; a tile is one matrix product of int8 values (exact in float32 up to 1024 dimensions, else in float64). With the exact
norm of each vector's rounding error, a product bounds the cosine from both sides, so a candidate is passed over only
if its upper bound is below the query's k-th best score so far. Survivors are recomputed in double precision from the
original vectors and merged by heaps, within a tile and then over tiles. The answer is exact.

Equal vectors are joined to one candidate with its k + 1 smallest ids (enough for any top k without the query itself).
Every vector is in one candidate block; a query block goes to every group of candidate blocks. The query set is given.

Results: vectors that are null, empty, zero, of another dimension than most, or that hold null or non-finite components
take no part; equal scores go to the smaller vec_id; fewer candidates than k give fewer rows; rows that
repeat a vec_id are each a candidate (the query's own id never is); an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = 2048
GROUP_BLOCKS = 8


def usable(table: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part."""
    v = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(fine & F.exists("embedding", lambda x: x != 0))
    common_size = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return v.join(F.broadcast(common_size.select("n")), F.size("embedding") == F.col("n"), "left_semi")  # one row


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, and an upper bound of the norm of the rounding error, of unit vectors."""
    big = np.abs(x).max(axis=1)
    u = x / big[:, None]  # first by the largest component: squares cannot overflow or vanish
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    scale = np.abs(u).max(axis=1) / 127
    code = np.rint(u / scale[:, None]).astype(np.int8)
    error = np.sqrt(((u - code * scale[:, None]) ** 2).sum(axis=1))
    return code, scale, error * (1 + 1e-9) + 1e-12


def cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each row on its own, so that equal vectors get equal scores."""
    a, b = q / np.abs(q).max(), rows / np.abs(rows).max(axis=1)[:, None]
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))


def search_tile(queries: list[tuple[int, np.ndarray]], x: np.ndarray, ids: list[list[int]], k: int, heaps: dict[int, list]) -> None:
    """Merge one tile into the queries' heaps of (score, -vec_id), worst first."""
    code, scale, error = quantise(x)
    kind = np.float32 if x.shape[1] <= 1024 else np.float64
    c = code.astype(kind)
    q = np.array([v for _, v in queries])
    qcode, qscale, qerror = quantise(q)
    for at in range(0, len(queries), 256):
        part = slice(at, at + 256)
        about = (qcode[part].astype(kind) @ c.T).astype(np.float64) * qscale[part, None] * scale
        slack = qerror[part, None] + error + qerror[part, None] * error + 1e-9
        for i, (qid, vector) in enumerate(queries[part]):
            heap = heaps.setdefault(qid, [])
            low = about[i] - slack[i]
            # at most one candidate's ids can all be the query's own: k + 1 candidates hold k of others
            floor = np.partition(low, len(low) - k - 1)[len(low) - k - 1] if len(low) > k + 1 else -np.inf
            if len(heap) == k:
                floor = max(floor, heap[0][0])
            live = np.flatnonzero(about[i] + slack[i] >= floor)
            for j, s in zip(live, cosines(vector, x[live]), strict=True):
                for v in ids[j]:
                    if v == qid:
                        continue
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -v))
                    elif (s, -v) > heap[0]:
                        heapq.heapreplace(heap, (s, -v))
                    else:
                        break


def nearest(table: DataFrame, query_rows: F.Column, k: int = 5, block: int = BLOCK, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of the rows that query_rows picks. A query id that repeats is searched for its row that sorts first."""
    v = usable(table)
    same = _distinct(v, k)
    n = same.count()
    blocks = max(1, -(-n // block))
    groups = max(1, -(-blocks // group_blocks))

    query_blocks = max(1, -(-v.where(query_rows).count() // (block * group_blocks)))

    def key(column, m):
        return F.pmod(F.xxhash64(column), F.lit(m)).cast("int")

    def packer(grouped: str):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                for at in range(0, b.num_rows, block):
                    part = b.slice(at, block)
                    by: dict[int, list] = {}
                    for g, ids, e in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                        by.setdefault(g, []).append((ids, e.values.to_numpy(zero_copy_only=False)))
                    for g, rows in by.items():
                        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([pickle.dumps(([r[0] for r in rows], np.array([r[1] for r in rows])), 5)], pa.binary())], [grouped, "blob"])

        return run

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def spread(df: DataFrame, grouped: str, n: int, other: str, m: int) -> DataFrame:
        """df's vectors as blobs of the n groups they are dealt to, each for all m groups of the other side."""
        return df.select(key("embedding", n).alias(grouped), "ids", "embedding").mapInArrow(packer(grouped), f"{grouped} int, blob binary").withColumn(other, every(m))

    tiles = spread(same, "grp", groups, "asked", query_blocks)
    chosen = v.where(query_rows).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = spread(chosen.select(F.array("vec_id").alias("ids"), "embedding"), "asked", query_blocks, "grp", groups)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        mine = [pickle.loads(x.as_py()) for x in left["blob"]]
        heaps: dict[int, list] = {}
        if mine:
            ids, x = [i for m in mine for i in m[0]], np.concatenate([m[1] for m in mine])
            for blob in right["blob"]:
                qids, q = pickle.loads(blob.as_py())
                for at in range(0, len(ids), block):
                    search_tile([(i[0], e) for i, e in zip(qids, q, strict=True)], x[at : at + block], ids[at : at + block], k, heaps)
        rows = [(qid, -v, float(s)) for qid, h in heaps.items() for s, v in h]
        a, c, s = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64())})

    found = tiles.groupBy("grp", "asked").cogroup(asked.groupBy("grp", "asked")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    merged = found.groupBy("query_id").agg(best.alias("best"))  # k rows from each group of blocks
    return merged.select("query_id", F.posexplode("best").alias("i", "b")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def _distinct(v: DataFrame, k: int) -> DataFrame:
    """embedding and the k + 1 smallest vec_ids of each distinct vector: ranked in each task first, so a vector of a third of all rows is no hot group."""
    from pyspark.sql import Window

    # equal vectors are cut to k + 1 in salted groups before they meet
    salted = v.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)).cast("int"))
    for keys in (["embedding", "salt"], ["embedding"]):
        w = Window.partitionBy(*keys).orderBy("vec_id")
        salted = salted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    return salted.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def op2_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50, among all the others."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table, F.col("vec_id") % 50 == 0)

