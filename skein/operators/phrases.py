"""Phrase, prefix and field search over texts: positional postings of anchors, prefixes as keys, weighted columns.

A phrase is looked for by its rarest term alone: only that term's positions leave the scan and meet the phrases that hold
it; a position fixes where the phrase would start, and only the documents with such a start are read again to compare the
words around it. So frequent words of a phrase are never joined. Fields are weighted as in SQLite's FTS5: a term's count is
the sum over columns of weight times count, in one BM25 score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.tables import table
from .documents import EVERY, K1, B, docs, let, postings, terms, wanted
from .topk import topk

#: Letters of a prefix; characters of a text that stand in for its title; weights of title and text.
PREFIX, TITLE, WEIGHTS = 4, 60, (10.0, 1.0)


def phrases(spark, sf_dir, every: int = EVERY) -> DataFrame:
    """query_id and phrase (all its terms in order) of the items that have terms and an id divisible by `every`."""
    b = table(spark, sf_dir, "benchmark").where(F.col("item_id") % every == 0)
    return b.select(F.col("item_id").alias("query_id"), terms(F.col("text")).alias("phrase")).where(F.size("phrase") > 0)


def phrase_matches(spark, sf_dir) -> DataFrame:
    """The documents that hold an item's terms one after the other, and how many times; every item is asked."""
    q = phrases(spark, sf_dir, 1)
    places = q.select("query_id", F.posexplode("phrase").alias("at", "term"))
    df = postings(spark, sf_dir).join(places.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = topk(places.join(df, "term"), 1, ["query_id"], [F.asc("df"), F.asc("term"), F.asc("at")])
    # a phrase with a term that no document holds matches none
    known = places.join(df, "term", "left").groupBy("query_id").agg(F.min(F.coalesce("df", F.lit(0))).alias("least")).where("least > 0")
    anchors = scratch.staged(rarest.join(known, "query_id", "left_semi").select("query_id", "at", "term"), "phrase-anchors")
    held = docs(spark, sf_dir).select("doc_id", F.posexplode(terms(F.col("text"))).alias("pos", "term")).join(anchors, "term")
    starts = scratch.staged(held.select("query_id", "doc_id", (F.col("pos") - F.col("at")).alias("start")).where("start >= 0"), "phrase-starts")
    texts = docs(spark, sf_dir).join(starts.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", terms(F.col("text")).alias("t"))
    same = F.slice(F.col("t"), F.col("start") + 1, F.size("phrase")) == F.col("phrase")
    found = starts.distinct().join(texts, "doc_id").join(q, "query_id").where(same)
    return found.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("hits"))


def prefix_topk(spark, sf_dir) -> DataFrame:
    """The 10 documents with most terms that begin as a stated item's longest term does (the first of equals), in its first four letters."""
    q = phrases(spark, sf_dir).select("query_id", F.posexplode("phrase").alias("at", "term")).where(F.length("term") >= PREFIX)
    q = topk(q, 1, ["query_id"], [F.desc(F.length("term")), F.asc("at")], "r").select("query_id", F.substring("term", 1, PREFIX).alias("prefix"))
    p = postings(spark, sf_dir).where(F.length("term") >= PREFIX).select("doc_id", F.substring("term", 1, PREFIX).alias("prefix"), "tf")
    found = p.join(q, "prefix").groupBy("query_id", "doc_id").agg(F.sum("tf").alias("score"))
    return topk(found, 10, ["query_id"], [F.desc("score"), F.asc("doc_id")])


def field_topk(spark, sf_dir) -> DataFrame:
    """BM25 over two columns, title (a text's first characters) and text, a term in the title counting ten times as much; the 10 best."""
    both = F.struct(terms(F.substring("text", 1, TITLE)).alias("h"), terms(F.col("text")).alias("t"))
    length = lambda d: F.greatest(F.size(d["h"]), F.lit(0)) + F.greatest(F.size(d["t"]), F.lit(0))
    n, all_dl = docs(spark, sf_dir).agg(F.count(F.lit(1)), F.sum(let(both, length))).first()
    n, all_dl = float(max(n, 1)), float(max(all_dl or 0, 1))
    # each text is split once, and only the queries' terms, found in a broadcast while their size allows, are counted
    each = let(both, lambda d: F.struct(length(d).cast("double").alias("dl"), F.concat(F.transform(d["h"], lambda x: F.struct(x.alias("term"), F.lit(WEIGHTS[0]).alias("tf"))), F.transform(d["t"], lambda x: F.struct(x.alias("term"), F.lit(WEIGHTS[1]).alias("tf")))).alias("p")))
    d = docs(spark, sf_dir).where("text is not null").select("doc_id", each.alias("d")).select("doc_id", "d.dl", F.explode("d.p").alias("p"))
    p = d.select("doc_id", "dl", "p.term", "p.tf").join(wanted(spark, sf_dir), "term").groupBy("query_id", "doc_id", "term").agg(F.max("dl").alias("dl"), F.sum("tf").alias("tf"))
    hits = scratch.staged(p, "field-hits")
    df = hits.groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (all_dl / n)))
    return topk(hits.join(df, ["query_id", "term"]).groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score")), 10, ["query_id"], [F.desc("score"), F.asc("doc_id")])


def _terms(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda x: x <> '')"


_Q = f"q AS MATERIALIZED (SELECT item_id AS query_id, {_terms('text')} AS phrase FROM benchmark WHERE item_id % {EVERY} = 0)"
_ALL = _Q.replace(f" WHERE item_id % {EVERY} = 0", "")
_T = f"d AS MATERIALIZED (SELECT doc_id, {_terms('text')} AS t, {_terms(f'substring(text, 1, {TITLE})')} AS h FROM documents WHERE text IS NOT NULL)"
QUERIES = {
    "phrase_matches": (phrase_matches, f"WITH {_ALL}, {_T}, m AS (SELECT query_id, doc_id, len(list_filter(range(len(t) - len(phrase) + 1), lambda i: t[i + 1] = phrase[1] AND t[i + 1 : i + len(phrase)] = phrase))::BIGINT AS hits FROM q, d WHERE len(phrase) > 0 AND len(t) >= len(phrase)) SELECT * FROM m WHERE hits > 0"),
    "prefix_topk": (prefix_topk, f"WITH {_Q}, {_T}, x AS (SELECT query_id, substring(list_filter(phrase, lambda w: len(w) = list_max(list_transform(phrase, lambda y: len(y))))[1], 1, {PREFIX}) AS prefix FROM q WHERE len(phrase) > 0), y AS (SELECT query_id, doc_id, len(list_filter(t, lambda w: len(w) >= {PREFIX} AND substring(w, 1, {PREFIX}) = prefix))::BIGINT AS score FROM x, d WHERE len(prefix) = {PREFIX}) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM y WHERE score > 0 QUALIFY rank <= 10"),
    "field_topk": (field_topk, f"WITH {_Q}, {_T}, n AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, sum(len(t) + len(h))::DOUBLE AS all_dl FROM d), w AS (SELECT DISTINCT query_id, unnest(phrase) AS term FROM q), e AS (SELECT doc_id, unnest(h) AS term, {WEIGHTS[0]}::DOUBLE AS c FROM d UNION ALL SELECT doc_id, unnest(t), {WEIGHTS[1]}::DOUBLE FROM d), p AS (SELECT query_id, doc_id, term, sum(c) AS tf FROM e JOIN w USING (term) GROUP BY ALL), f AS (SELECT query_id, term, count(*)::DOUBLE AS df FROM p GROUP BY ALL), s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({K1}::DOUBLE + 1) / (tf + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * (len(t) + len(h)) / (all_dl / n)))), 6) AS score FROM p JOIN f USING (query_id, term) JOIN d USING (doc_id), n GROUP BY ALL) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s QUALIFY rank <= 10"),
}
