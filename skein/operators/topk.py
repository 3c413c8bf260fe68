"""Top-k with total order: Spark puts a group limit on both sides of the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are broadcast at a time.
BLOCK = 4096


def topk(df: DataFrame, k: int, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int")).where(F.col(rank) <= k)


def asked_in_blocks(docs: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every row of docs with every query (q_*). Queries are dealt to blocks of about `block`, each broadcast to one scan of docs: the stated query set against all rows, never a cartesian product of two large sides."""
    blocks = max(1, -(-queries.count() // block))
    parts = [queries.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == i) for i in range(blocks)] if blocks > 1 else [queries]
    return reduce(DataFrame.unionByName, (docs.crossJoin(F.broadcast(q)) for q in parts))


def score_all(queries: DataFrame, docs: DataFrame, score: Column, k: int, ascending: bool, exclude_self: bool = False) -> DataFrame:
    """query_id, rank, doc_id, score of the k best rows of docs for each query."""
    pairs = asked_in_blocks(docs, queries)
    if exclude_self:
        pairs = pairs.where("q_id <> doc_id")
    scored = pairs.select(F.col("q_id").alias("query_id"), "doc_id", score.alias("score"))
    return topk(scored, k, ["query_id"], [F.asc("score") if ascending else F.desc("score"), F.asc("doc_id")])
