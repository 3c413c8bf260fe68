"""Exact top-k of a stated query set against all rows, as tiles of a score matrix.

Rows and queries are dealt to groups of bounded size; every group of queries meets every group of rows once, as one tile. A
tile computes its scores with numpy, a part at a time, and hands on the k best of each query; one window merges them. What
is shuffled is each side once for every group of the other, and no pair of a query and a row is ever a row of a table. A
tile's time and memory are bounded by the sizes of its groups; that of all tiles grows with rows times queries. Rows whose
score is infinite in the sense of the order are no candidates. all_pairs() hands on every pair, in blocks of PAIRS at most.

Rows whose vector is null, of another length than most, or holds null or non-finite components take no part, nor do rows
without an id. Equal scores go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encode import WORDS
from .topk import topk

#: Rows of a group and queries of a group; a tile's scores are computed for so many queries and rows at a time.
GROUP, ASK, PART_QUERIES, PART_ROWS = 65_536, 4_096, 64, 2_048
#: Rows that a tile hands on at most.
FOUND = 1 << 20
#: Where all pairs are handed on: rows and queries of a tile, pairs that are made at a time, and those handed on at a time.
PAIR_ROWS, PAIR_ASKS, PAIRS, HANDED = 16_384, 32_768, 1 << 21, 1 << 16
#: Below a group, rows are still dealt to all cores, but not thinner than this.
LEAST = 256

Scores = Callable[[np.ndarray, np.ndarray], np.ndarray]


def usable(v: DataFrame, column: str = "embedding") -> DataFrame:
    """v's rows with an id and a vector of the usual length that holds finite numbers alone."""
    c = F.col(column)
    fine = v.where(c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    usual = fine.groupBy(F.size(c).alias("_n")).count().orderBy(F.desc("count"), "_n").limit(1).select("_n")  # one row
    return fine.where(F.col(v.columns[0]).isNotNull()).join(F.broadcast(usual), F.size(c) == F.col("_n"), "left_semi")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as one matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, score: Scores, ascending: bool, exclude_self: bool) -> pa.Table:
    """query_id, doc_id, score of the k best rows of a tile for each of its queries."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]

    def first(parts: list[tuple]) -> tuple:
        """Of the rows found so far the k first of each query."""
        i, s, d = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((d, s, i))
        i, s, d = i[order], s[order], d[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[keep], s[keep], d[keep]

    found = []
    for at in range(0, len(q), PART_QUERIES):
        mine, mine_ids = q[at : at + PART_QUERIES], q_ids[at : at + PART_QUERIES]
        limit = np.full(len(mine), np.inf)
        parts, held = [], 0
        for low in range(0, len(x), PART_ROWS):
            s = score(mine, x[low : low + PART_ROWS]).astype(np.float64, copy=False)
            s = s if ascending else -s
            if exclude_self:
                s[mine_ids[:, None] == ids[low : low + PART_ROWS]] = np.inf
            if not low and s.shape[1] > k:
                limit = np.partition(s, k - 1, axis=1)[:, k - 1]
            i, j = np.nonzero((s <= limit[:, None]) & (s < np.inf))
            parts.append((i, s[i, j], ids[low + j]))
            held += len(i)
            if held > 4 * k * len(mine):
                parts = [first(parts)]
                i, s, _ = parts[0]
                held, n = len(i), np.bincount(i, minlength=len(mine))
                full = n == k
                limit[full] = s[np.cumsum(n)[full] - 1]
        if parts:
            i, s, d = first(parts)
            found.append((mine_ids[i], d, s if ascending else -s))
    a, d, s = (np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pa.table({"query_id": pa.array(a.astype(np.int64)), "doc_id": pa.array(d.astype(np.int64)), "score": pa.array(s + 0.0)})


def values(t: pa.Table) -> np.ndarray:
    """A side's vectors or words as a matrix."""
    names = [c for c in t.column_names if c.startswith("v")]
    if len(names) == 1:
        return matrix(t["v0"]) if pa.types.is_list(t["v0"].type) else t["v0"].to_numpy()[:, None]
    return np.stack([t[c].to_numpy() for c in names], axis=1) if t.num_rows else np.empty((0, 1), np.int64)


def met(rows: DataFrame, queries: DataFrame, groups: int, asks: int, tile: Callable[[pa.Table, pa.Table], pa.Table], schema: str, apart: bool = False) -> DataFrame:
    """tile(rows, queries) of every group of rows with every group of queries; a side's columns are id, v0, v1, ... apart: small tiles stay
    in as many partitions as there are tiles, as they make much of little."""

    def dealt(df: DataFrame, mine: str, m: int, other: str, o: int) -> DataFrame:
        df = df.toDF("id", *(f"v{i}" for i in range(len(df.columns) - 1)))
        # both sides' keys must be of one type, or they are hashed to different partitions
        df = df.withColumn(mine, F.pmod(F.xxhash64(*df.columns), F.lit(m)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(o - 1))))
        return df.repartition(groups * asks, "_group", "_ask") if apart else df

    a, b = dealt(rows, "_group", groups, "_ask", asks), dealt(queries, "_ask", asks, "_group", groups)
    return a.groupBy("_group", "_ask").cogroup(b.groupBy("_group", "_ask")).applyInArrow(tile, schema)


def even(n: int, most: int) -> list[slice]:
    """n rows in slices of about one size, of `most` rows at most."""
    step = -(-n // -(-n // most))
    return [slice(at, min(n, at + step)) for at in range(0, n, step)]


def all_pairs(rows: DataFrame, queries: DataFrame, columns: dict[str, str], measure: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], keep: Callable | None = None, by: str | None = None) -> DataFrame:
    """query_id, doc_id and the stated columns (name to type) of every query with every row: measure() gives a matrix of queries x
    rows for each. keep(query ids, row ids, measured) says which pairs are handed on; without it all are. by: a column in whose
    order a block's pairs are handed on, from small sizes to large, so that equal values lie together and files of pairs are small.

    A tile hands on its two sides as they are, and a map after it makes the pairs, a block of PAIRS at a time: the size of a
    tile then bounds what is shuffled, not what is held."""
    n, q_n = rows.count(), queries.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    groups, asks = max(-(-n // PAIR_ROWS), min(3 * cores, -(-n // LEAST)), 1), max(1, -(-q_n // PAIR_ASKS))
    kinds = {"long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), *((c, kinds[t]) for c, t in columns.items())])
    packed = pa.schema([("kind", pa.string()), *((c, pa.binary()) for c in ("ids", "x", "q_ids", "q"))])

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return packed.empty_table()
        x, q = values(left), values(right)
        sides = (left["id"].to_numpy(), x, right["id"].to_numpy(), q)
        return pa.table([[x.dtype.str], *([np.ascontiguousarray(m).tobytes()] for m in sides)], schema=packed)

    def block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = []
        for at in range(0, len(q), PART_QUERIES):
            own = q_ids[at : at + PART_QUERIES]
            got = measure(q[at : at + PART_QUERIES], x)
            i, j = np.nonzero(np.ones((len(own), len(ids)), bool) if keep is None else keep(own[:, None], ids, got))
            found.append([own[i], ids[j], *(got[c][i, j] for c in columns)])
        whole = [np.concatenate(parts) for parts in zip(*found, strict=True)]
        del found
        order = np.argsort(np.abs(whole[2 + list(columns).index(by)])) if by else np.arange(len(whole[0]))
        for at in range(0, len(order), HANDED):
            some = order[at : at + HANDED]
            yield pa.RecordBatch.from_arrays([pa.array(m[some], t) for m, t in zip(whole, schema.types, strict=True)], schema=schema)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                kind, *sides = (batch.column(c)[k] for c in packed.names)
                ids, x, q_ids, q = (np.frombuffer(m.as_buffer(), t) for m, t in zip(sides, (np.int64, kind.as_py()) * 2, strict=True))
                x, q = x.reshape(len(ids), -1), q.reshape(len(q_ids), -1)
                for mine in even(len(ids), PART_ROWS):
                    for own in even(len(q_ids), max(1, PAIRS // (mine.stop - mine.start))):
                        yield from block(q_ids[own], q[own], ids[mine], x[mine])

    tiles = met(rows, queries, groups, asks, tile, "kind string, ids binary, x binary, q_ids binary, q binary", True)
    return tiles.mapInArrow(pairs, "query_id long, doc_id long, " + ", ".join(f"{c} {t}" for c, t in columns.items()))


def nearest(rows: DataFrame, queries: DataFrame, k: int, score: Scores, ascending: bool, exclude_self: bool = False, n: int | None = None, rank: str = "rank") -> DataFrame:
    """query_id, rank, doc_id, score of the k best rows for each query.

    rows: doc_id, then either one vector column or several BIGINT columns; queries: q_id, then the same. n: how many rows
    there are, where that is cheaper to tell from another table."""
    n, q_n = rows.count() if n is None else n, queries.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    groups = max(-(-n // GROUP), min(cores, -(-n // LEAST)), 1)
    asks = max(1, -(-q_n // max(1, min(ASK, FOUND // k))))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return best(np.empty((0, 1)), np.empty(0, np.int64), np.empty((0, 1)), np.empty(0, np.int64), k, score, ascending, exclude_self)
        return best(values(right), right["id"].to_numpy(), values(left), left["id"].to_numpy(), k, score, ascending, exclude_self)

    tiles = met(rows, queries, groups, asks, tile, "query_id long, doc_id long, score double")
    return topk(tiles, k, ["query_id"], [F.asc("score") if ascending else F.desc("score"), F.asc("doc_id")], rank).select("query_id", rank, "doc_id", "score")


# --- scores: queries x rows, of matrices of vectors or of words -----------------------------------------------------


def rounded(score: Scores, digits: int = 6) -> Scores:
    return lambda q, x: np.round(score(q, x), digits)


def dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return q @ x.T


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """0 where a norm is 0."""
    norms = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))
    return np.where(norms > 0, (q @ x.T) / np.where(norms > 0, norms, 1.0), 0.0)


def l2_sq(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * (q @ x.T), 0.0)


def l1(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    out, one, columns = np.zeros((len(q), len(x))), np.empty((len(q), len(x))), np.ascontiguousarray(x.T)
    for i, column in enumerate(columns):
        np.abs(np.subtract(q[:, i, None], column, out=one), out=one)
        out += one
    return out


def _counts(q: np.ndarray, x: np.ndarray, op: Callable) -> np.ndarray:
    out, one = np.zeros((len(q), len(x)), np.int16), np.empty((len(q), len(x)), np.uint64)
    columns = np.ascontiguousarray(x.T).view(np.uint64)
    for i in range(q.shape[1]):
        out += np.bitwise_count(op(q[:, i, None].view(np.uint64), columns[i], out=one))
    return out.astype(np.int32)


def first_words(score: Scores, n: int = 2) -> Scores:
    return lambda q, x: score(np.ascontiguousarray(q[:, :n]), np.ascontiguousarray(x[:, :n]))


def hamming(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _counts(np.ascontiguousarray(q), np.ascontiguousarray(x), np.bitwise_xor)


def shared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _counts(np.ascontiguousarray(q), np.ascontiguousarray(x), np.bitwise_and)


def sizes(q: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(q).view(np.uint64)).sum(axis=1).astype(np.float64)


def pap_similarity(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Shared bits over the geometric mean of the counts; 0 if a side is empty."""
    n = sizes(q)[:, None] * sizes(x)
    return np.where(n > 0, shared(q, x) / np.sqrt(np.where(n > 0, n, 1.0)), 0.0)


def pap_distance(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """0 if both sides are empty, 1 if one is."""
    neither = (sizes(q)[:, None] == 0) & (sizes(x) == 0)
    return np.where(neither, 0.0, 1 - pap_similarity(q, x))


def wedge(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(Hamming - shared bits) over the larger count, held within -1 and 1; 0 for equal or empty sides."""
    apart, most = hamming(q, x), np.maximum(sizes(q)[:, None], sizes(x))
    return np.where((apart == 0) | (most == 0), 0.0, np.clip((apart - shared(q, x)) / np.maximum(most, 1), -1, 1))


def word_columns(h: DataFrame) -> DataFrame:
    """doc_id and the words of the rows that have them."""
    return h.select(h.columns[0], *WORDS).where(F.col(WORDS[0]).isNotNull() & F.col(h.columns[0]).isNotNull())
