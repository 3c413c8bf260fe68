"""SQL surface: the tables of a folder as views, the measures as SQL functions, and a nearest-neighbour table function."""

from __future__ import annotations

import heapq

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources.tables import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class _AnnSearch:
    """Of the rows of a table argument (vec_id, embedding) in each partition, the k with the largest dot product with a vector."""

    def __init__(self):
        self.heap, self.k = [], 0

    def eval(self, row, query, k):
        import numpy as np

        self.k = k
        if row["embedding"] is None or len(row["embedding"]) != len(query):
            return
        s = (float(np.dot(np.asarray(row["embedding"], float), np.asarray(query, float))), -row["vec_id"])
        heapq.heappush(self.heap, s) if len(self.heap) < k else heapq.heappushpop(self.heap, s)

    def terminate(self):
        for s, v in sorted(self.heap, reverse=True):
            yield -v, s


def register(spark: SparkSession, sf_dir: str) -> None:
    """Views of the folder's tables, the SQL functions dot_product, cosine_of and hamming_of, and the table function

    ann_search(TABLE(SELECT vec_id, embedding FROM embeddings) PARTITION BY (vec_id % 8), query, k), whose rows (vec_id, score) want a last ORDER BY ... LIMIT k."""
    for t in TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    total = "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION dot_product(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN {total}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cosine_of(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN CASE WHEN size(a) <> size(b) OR dot_product(a, a) = 0 OR dot_product(b, b) = 0 THEN 0D ELSE dot_product(a, b) / (sqrt(dot_product(a, a)) * sqrt(dot_product(b, b))) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hamming_of(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS INT RETURN aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    spark.udtf.register("ann_search", udtf(_AnnSearch, returnType="vec_id BIGINT, score DOUBLE"))
