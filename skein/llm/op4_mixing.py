"""Mixing sources to target weights, by Poisson replication. DataFrame functions only.

A source with target weight w, n of the N documents and so the rate w * N / n has each of its documents drawn
Poisson(rate) times: the hash of (seed, doc_id) is a uniform number that inverts the distribution. Copies are exploded
and dealt out by a hash of (seed, doc_id, copy), sorted by it within each partition: a global shuffle.

Rates over 16 are sums of draws of at most 16 each. Results: a null source is a source of its own; a null doc_id is
hashed as the empty string; repeated rows are drawn alike, each on its own; a source without a target weight gets
none; an empty table gives an empty table; extra columns stay, and added ones get names that are not taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Entries of the cumulative distribution of a draw; the rest of Poisson(16) is below 1e-30.
TERMS = 80
DRAW = 16.0
#: Rows of per-source rates that may be broadcast: at most 1 KB each.
BROADCAST_SOURCES = 10_000
SALTS = 64


def rates(docs: DataFrame, weights: dict[str | None, float] | None, exponent: float) -> DataFrame:
    """source and its rate; weights are normalised. Without weights a source weighs as its number of documents to the power of exponent."""
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(exponent))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "given string, w double")
        n = n.join(given, F.col("source").eqNullSafe(F.col("given")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = n.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    return n.crossJoin(F.broadcast(total)).select("source", F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("all_n") / F.col("n")).otherwise(F.lit(0.0)).alias("rate"))  # total is one row


def uniform(seed: int, *parts) -> F.Column:
    """52 bits of an md5 as a number in [0, 1)."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_distribution(r: DataFrame) -> DataFrame:
    """rate as `draws` draws of equal rate, with the cumulative distribution `cdf` of one."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / DRAW)).cast("int")
    r = r.withColumn("draws", draws).withColumn("one", F.col("rate") / F.col("draws"))
    p = F.transform(F.sequence(F.lit(0), F.lit(TERMS - 1)), lambda i: F.exp(i * F.ln("one") - F.col("one") - F.aggregate(F.sequence(F.lit(0), i), F.lit(0.0), lambda a, j: a + F.ln(F.greatest(j, F.lit(1)).cast("double")))))
    r = r.withColumn("p", p)
    cdf = F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda k: F.aggregate(F.slice("p", F.lit(1), k), F.lit(0.0), lambda a, x: a + x))
    return r.where("rate > 0").select("source", "draws", cdf.alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.5, seed: int = 17, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs, each row as many times as drawn, with `copy` (from 0) and `shuffle_key`, globally shuffled."""
    copy, key = common.column_named(docs, "copy"), common.column_named(docs, "shuffle_key")
    names = {x: common.column_named(docs, f"_mix_{x}") for x in ("source", "draws", "cdf", "salt")}
    by_source = with_distribution(rates(docs.select(F.col(f"`{source}`").cast("string").alias("source")), weights, exponent))
    by_source = by_source.select(*(F.col(c).alias(names[c]) for c in ("source", "draws", "cdf")))
    few = by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    same = F.col(f"`{source}`").cast("string").eqNullSafe(F.col(names["source"]))
    if few:
        joined = docs.join(F.broadcast(by_source), same)
    else:  # salted, so that a source with a third of all rows is spread
        salts = by_source.withColumn(names["salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mine = common.column_named(docs, "_mix_own_salt")
        salted = docs.withColumn(mine, F.pmod(F.xxhash64(F.col(f"`{doc_id}`")), F.lit(SALTS)).cast("int"))
        joined = salted.join(salts, same & (F.col(mine) == F.col(names["salt"])))
    cdf, draws, ident = F.col(names["cdf"]), F.col(names["draws"]), F.col(f"`{doc_id}`")
    one = F.size(F.filter(cdf, lambda c: c <= uniform(seed, ident, F.lit(1))))
    more = F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda a, d: a + F.size(F.filter(cdf, lambda c: c <= uniform(seed, ident, d))))
    count = F.when(draws == 1, one).otherwise(more)
    copies = joined.withColumn(copy, F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))))
    text = F.concat_ws("|", F.lit(f"{seed}|shuffle"), F.coalesce(ident.cast("string"), F.lit("")), F.col(copy).cast("string"))
    out = copies.select(*(F.col(f"`{c}`") for c in docs.columns), copy, F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias(key))
    return out.repartition(F.col(key)).sortWithinPartitions(key)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights that are the square root of their sources' sizes: every column, copy and shuffle_key."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = f"""
WITH n AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / sum(w) OVER () * sum(n) OVER () / n AS rate FROM n),
d AS (SELECT source, greatest(1, ceil(rate / {DRAW}))::INT AS draws, rate / greatest(1, ceil(rate / {DRAW})) AS one FROM r),
p AS (SELECT source, draws, i, exp(i * ln(one) - one - coalesce((SELECT sum(ln(j)) FROM range(1, i + 1) t(j)), 0)) AS p
      FROM d, range(0, {TERMS}) s(i)),
c AS (SELECT source, draws, sum(p) OVER (PARTITION BY source ORDER BY i) AS c FROM p),
k AS (SELECT source, any_value(draws) AS draws, list(c ORDER BY c) AS cdf FROM c GROUP BY source),
u AS (SELECT documents.*, (SELECT sum(len(list_filter(k.cdf, lambda x: x <=
        ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || t.d), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)))
        FROM range(1, k.draws + 1) t(d))::INT AS times
      FROM documents JOIN k ON documents.source IS NOT DISTINCT FROM k.source),
e AS (SELECT *, unnest(range(0, times))::INT AS copy FROM u)
SELECT doc_id, text, lang, source, n_chars, copy,
       ('0x' || substr(md5('17|shuffle|' || coalesce(doc_id::VARCHAR, '') || '|' || copy), 1, 15))::BIGINT AS shuffle_key FROM e
"""
