"""Text search, spelling, fingerprints of texts, de-duplication and category operators over documents."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.tables import table
from .components import components
from .topk import topk

K1, B = 1.2, 0.75  # the defaults of SQLite's FTS5
EVERY = 20
#: Bytes of text of a part whose bigrams one task counts.
PART = 16 << 20
#: Words that a title's index leaves out (fixed values).
STOP_WORDS = """the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might must shall
can need dare ought used pdf hal arxiv et al using based via we this that these those i you he she it they them their our its as all any both each few more
most other some such no nor not only own same so than too very about up out if into through during before after above below between among""".split()
#: Keywords of the three domains, in the order in which they are tried (fixed values).
DOMAINS = (("medical", ("medical", "patient", "clinical")), ("legal", ("legal", "law", "court")), ("cs", ("neural", "algorithm", "network")))
#: Keywords whose count decides a title's domain (fixed values).
KEYWORDS = {
    "cs": ("neural", "deep learning", "algorithm", "network", "optimization", "machine learning", "computer vision", "nlp", "transformer", "gpt", "reinforcement learning", "classification", "regression", "clustering", "convolutional", "recurrent", "language model", "graph neural", "generative", "adversarial", "dataset", "benchmark"),
    "medical": ("cancer", "tumor", "protein", "gene", "clinical", "patient", "drug", "therapy", "disease", "biomarker", "cell", "virus", "bacteria", "genome", "treatment", "diagnosis", "pathology", "medical", "health", "hospital", "surgical", "mri", "ct scan"),
}


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def terms(text: Column) -> Column:
    """Runs of [a-z0-9] of the lower-case text."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def let(x: Column, use) -> Column:
    """use(x), with x evaluated once: inside a lambda an expression would be evaluated for every element."""
    return F.transform(F.array(x), use)[0]


def counted(t: Column) -> Column:
    """term and tf of each distinct term of an array, within the row: runs of the sorted terms. Nothing is shuffled for it."""

    def runs(s: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(at, lambda at: F.transform(at, lambda p, k: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - p).cast("long").alias("tf"))))

    return let(F.sort_array(t), lambda s: F.when(F.size(s) > 0, runs(s)))


def postings(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(counted(terms(F.col("text")))).alias("p")).select("doc_id", "p.term", "p.tf")


def token_df(spark, sf_dir):
    """Documents and occurrences of each term that two or more documents hold: one shuffle, of sums."""
    return postings(spark, sf_dir).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where("df >= 2")


def wanted(spark, sf_dir):
    """Query terms: the distinct terms of the benchmark items whose id is divisible by 20."""
    b = table(spark, sf_dir, "benchmark").where(F.col("item_id") % EVERY == 0)
    return b.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


def _scored(spark, sf_dir, weight):
    """The 10 best of each query. Only the query terms' postings leave the scan; another counts documents and their lengths."""
    text = F.col("text")
    n, all_dl = docs(spark, sf_dir).agg(F.count(F.lit(1)), F.sum(F.greatest(F.size(terms(text)), F.lit(0)))).first()
    n, all_dl = float(max(n, 1)), float(max(all_dl or 0, 1))
    d = docs(spark, sf_dir).select("doc_id", let(terms(text), lambda t: F.struct(F.size(t).cast("double").alias("dl"), counted(t).alias("p"))).alias("d"))
    p = d.select("doc_id", F.col("d.dl").alias("dl"), F.explode("d.p").alias("p")).select("doc_id", "dl", "p.term", "p.tf")
    hits = scratch.staged(p.join(wanted(spark, sf_dir), "term"), "hits")  # Spark broadcasts the terms while their size allows
    df = hits.groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    h = hits.join(df, ["query_id", "term"]).withColumns({"n": F.lit(n), "all_dl": F.lit(all_dl)})
    return topk(h.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score")), 10, ["query_id"], [F.desc("score"), F.asc("doc_id")])


def tfidf_topk(spark, sf_dir):
    return _scored(spark, sf_dir, F.col("tf") * F.ln(F.col("n") / F.col("df")))


def bm25_topk(spark, sf_dir):
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return _scored(spark, sf_dir, idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (F.col("all_dl") / F.col("n")))))


def bigrams(t: Column) -> Column:
    return let(t, lambda t: F.when(F.size(t) > 1, F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.concat_ws(" ", F.get(t, i), F.get(t, i + 1)))))


def dealt(text: DataFrame) -> tuple[DataFrame, int]:
    """Texts with their part, a Spark partition each, and how many parts there are: a part has about PART bytes, or one longer text."""
    parts = max(1, math.ceil((text.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / PART))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    return text.withColumn("id", F.monotonically_increasing_id()).select("text", part.alias("part")).repartitionById(parts, F.col("part")), parts


def bigram_counts(spark, sf_dir):
    """Bigrams found five times or more. Each part of the texts is counted on its own, and as many parts of the bigrams add up: a larger table has more parts, not larger ones."""
    text, parts = dealt(docs(spark, sf_dir).where("text is not null").select("text"))
    g = text.select("part", F.explode(bigrams(terms(F.col("text")))).alias("bigram")).groupBy("part", "bigram").agg(F.count(F.lit(1)).alias("n"))
    return g.repartition(parts, "bigram").groupBy("bigram").agg(F.sum("n").alias("n")).where("n >= 5")


def trigram_counts(spark, sf_dir):
    """Three-letter pieces of the distinct terms, by how many documents' terms hold them."""
    t = docs(spark, sf_dir).select(F.explode(F.array_distinct(terms(F.col("text")))).alias("t")).where("length(t) >= 3")
    g = t.groupBy("t").agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring(F.col("t"), i, F.lit(3)))).alias("trigram"))
    return g.groupBy("trigram").agg(F.sum("n").alias("n"))


def whitespace_tokens(spark, sf_dir):
    """Tokens between spaces, and the distinct ones of three letters or more that are no stop words."""
    t = F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda x: x != "")
    good = F.array_distinct(F.filter(t, lambda x: (F.length(x) >= 3) & ~x.isin(STOP_WORDS)))
    return docs(spark, sf_dir).where("text is not null").select("doc_id", F.size(t).cast("long").alias("tokens"), F.size(good).cast("long").alias("content"))


def inverted_index(spark, sf_dir):
    """Of each content token, block by block of 65,536 ids, the ascending ids: a list is never longer than a block."""
    t = F.array_distinct(F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda x: (F.length(x) >= 3) & ~x.isin(STOP_WORDS)))
    p = docs(spark, sf_dir).select("doc_id", F.explode(t).alias("term")).withColumn("block", F.floor(F.col("doc_id") / 65_536))
    g = p.groupBy("term", "block").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    return g.select("term", "block", F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def vocabulary_fields(spark, sf_dir):
    """Documents of each language that hold a term, three or more."""
    return docs(spark, sf_dir).select("lang", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term", "lang").agg(F.count(F.lit(1)).alias("df")).where("df >= 3")


def title(text: Column) -> Column:
    """The first 60 characters, spaces joined."""
    return F.trim(F.regexp_replace(F.substring(text, 1, 60), r"[ \t\n\r]+", " "))


def clean_titles(spark, sf_dir):
    """Titles of five characters or more without tags and spaces around."""
    t = F.trim(F.regexp_replace(F.regexp_replace(title(F.col("text")), "<[^>]*>", " "), " +", " "))
    return docs(spark, sf_dir).select("doc_id", t.alias("title")).where("length(title) >= 5")


def _title_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(title(text)), "[^a-z]+"), lambda x: F.length(x) > 2))


def cooccurring(spark, sf_dir):
    """Of each title word the five that most titles hold beside it, two or more."""
    w = docs(spark, sf_dir).select(_title_words(F.col("text")).alias("ws"))
    p = w.select(F.explode("ws").alias("word"), "ws").select("word", F.explode("ws").alias("other")).where("word <> other")  # a title has 20 words at most
    return topk(p.groupBy("word", "other").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"), 5, ["word"], [F.desc("n"), F.asc("other")])


def expanded_queries(spark, sf_dir):
    """The first four words of each benchmark item, with up to three related words; none for an exact title."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 2), 1, 4).alias("ws"))
    known = docs(spark, sf_dir).select(F.lower(title(F.col("text"))).alias("known")).distinct()
    q = q.withColumn("query", F.array_join("ws", " "))
    q = q.join(known.withColumn("exact", F.lit(True)), F.col("query") == F.col("known"), "left")
    r = q.where("exact is null").select("query_id", "ws", F.posexplode("ws").alias("at", "word")).join(cooccurring(spark, sf_dir), "word").where(~F.array_contains("ws", F.col("other")))
    first = r.groupBy("query_id", "other").agg(F.min(F.struct("at", "rank")).alias("place"))
    three = topk(first, 3, ["query_id"], [F.asc("place"), F.asc("other")], "r")
    added = three.groupBy("query_id").agg(F.sort_array(F.collect_list("other")).alias("added"))  # three at most
    return q.join(added, "query_id", "left").select("query_id", F.concat_ws(" ", "query", F.array_join("added", " ")).alias("expanded"))


def _typo(w: Column) -> Column:
    return F.concat(F.substring(w, 1, 1), F.substring(w, 3, 1), F.substring(w, 2, 1), F.substring(w, F.lit(4), F.length(w)))


def deletions(w: Column) -> Column:
    """The word, and what is left of it after one and after two letters are taken out."""
    one = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    first = one(w)
    return F.array_distinct(F.concat(F.array(w), first, F.flatten(F.transform(first, lambda x: F.when(F.length(x) > 0, one(x)).otherwise(F.array(F.lit("")))))))


def _edits(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return rows[-1][-1]


def spell_candidates(spark, sf_dir):
    """For misspelt benchmark words (second and third letter swapped): the word itself if the corpus knows it, else the most
    frequent term at the least distance, two at most. Candidates share a word with up to two letters taken out: an equi-join."""
    v = token_df(spark, sf_dir).where("length(term) between 3 and 30").select("term", "df")
    q = wanted(spark, sf_dir).where("length(term) between 4 and 28").select(_typo(F.col("term")).alias("word")).distinct()
    keys = lambda d, c: d.withColumn("key", F.explode(deletions(F.col(c))))

    @F.pandas_udf("int")
    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_edits(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    near = keys(q, "word").join(keys(v, "term"), "key").select("word", "term", "df").distinct().withColumn("edits", edits("word", "term")).where("edits <= 2")
    return topk(near, 1, ["word"], [F.asc("edits"), F.desc("df"), F.asc("term")]).drop("rank")


def perturbed(spark, sf_dir):
    """Each benchmark item without the words that a hash of word and place picks, about three tenths."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.filter(F.split("text", " "), lambda x: x != "").alias("ws"))
    kept = F.filter("ws", lambda w, i: F.substring(F.md5(F.concat(w, i.cast("string")).cast("binary")), 1, 1) >= "5")
    return b.select("item_id", F.size("ws").cast("long").alias("words"), F.array_join(kept, " ").alias("text"))


def title_router(spark, sf_dir):
    """Documents for each benchmark item: of equal text, else of the same first 40 characters, else of a title with its first two long words; the 5 first of the best layer."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q_text"))
    d = docs(spark, sf_dir).select("doc_id", "text")
    exact = d.join(b, F.col("text") == F.col("q_text")).select("query_id", "doc_id", F.lit(0).alias("layer"))
    prefix = d.join(b.where("length(q_text) >= 40"), F.substring("text", 1, 40) == F.substring("q_text", 1, 40)).select("query_id", "doc_id", F.lit(1).alias("layer"))
    long = F.slice(F.filter(F.split(F.lower("q_text"), "[^a-z]+"), lambda x: F.length(x) > 4), 1, 2)
    q = b.select("query_id", F.array_distinct(long).alias("k")).where("size(k) = 2").select("query_id", F.explode("k").alias("word"))
    words = d.select("doc_id", F.explode(_title_words(F.col("text"))).alias("word")).join(q, "word").groupBy("query_id", "doc_id").count().where("count = 2").select("query_id", "doc_id", F.lit(2).alias("layer"))
    best = exact.unionByName(prefix).unionByName(words).groupBy("query_id", "doc_id").agg(F.min("layer").alias("layer"))
    top = best.withColumn("first", F.min("layer").over(Window.partitionBy("query_id"))).where("layer = first").drop("first")
    return topk(top, 5, ["query_id"], [F.asc("doc_id")])


def anchor_masks(spark, sf_dir):
    """64 anchors, the most frequent terms of three letters or more; the document that covers most of a query's anchors, if that is 87.5 % and no other but the best reaches half."""
    a = token_df(spark, sf_dir).where("length(term) >= 3").orderBy(F.desc("df"), "term").limit(64).select("term")
    p = docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(F.broadcast(a), "term")  # 64 terms
    q = wanted(spark, sf_dir).join(F.broadcast(a), "term")
    n = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("asked"))
    s = p.join(q, "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("held"))
    two = topk(s, 2, ["query_id"], [F.desc("held"), F.asc("doc_id")])
    w = Window.partitionBy("query_id").orderBy("rank")
    best = two.withColumn("next", F.coalesce(F.lead("held").over(w), F.lit(0))).where("rank = 1").join(n, "query_id")
    return best.select("query_id", "doc_id", "held", "asked", ((F.col("held") >= 0.875 * F.col("asked")) & (F.col("held") >= 2 * F.col("next"))).alias("accepted"))


def semantic_bypass(spark, sf_dir):
    """Texts that need no meaning: fewer than 12 terms, or term entropy below 3 bits."""
    d = docs(spark, sf_dir).select("doc_id", F.greatest(F.size(terms(F.col("text"))), F.lit(0)).alias("n"), counted(terms(F.col("text"))).alias("p"))
    share = lambda x: x["tf"] / F.col("n")
    entropy = F.round(F.coalesce(F.aggregate("p", F.lit(0.0), lambda s, x: s - share(x) * F.log2(share(x))), F.lit(0.0)), 6) + F.lit(0.0)
    return d.select("doc_id", F.col("n").cast("long").alias("n"), entropy.alias("entropy")).withColumn("bypass", (F.col("n") < 12) | (F.col("entropy") < 3))


def dedup_first_wins(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def first_per_source(spark, sf_dir):
    """Insert-or-ignore: of each digest and source the row with the least id."""
    d = docs(spark, sf_dir).select("doc_id", "source", F.md5("text").alias("digest"))
    return topk(d, 1, ["source", "digest"], [F.asc("doc_id")]).select("doc_id", "source")


def simhashes(spark, sf_dir) -> DataFrame:
    """doc_id and 64 bits in two words of 32: each distinct term adds +1 or -1 to a bit as its MD5 says; a bit is set if its sum is over 0. One row a document is shuffled."""
    t = docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("t")).select("doc_id", F.md5(F.col("t").cast("binary")).alias("m"))
    t = t.select("doc_id", *(F.conv(F.substring("m", 1 + 8 * k, 8), 16, 10).cast("long").alias(f"m{k}") for k in (0, 1)))
    sums = t.groupBy("doc_id").agg(*(F.sum(2 * F.getbit(F.col(f"m{k}"), F.lit(i)).cast("int") - 1).alias(f"s{k}_{i}") for k in (0, 1) for i in range(32)))
    word = lambda k: sum((F.when(F.col(f"s{k}_{i}") > 0, F.lit(1 << i)).otherwise(0).cast("long") for i in range(32)), F.lit(0).cast("long"))
    return sums.select("doc_id", word(0).alias("w0"), word(1).alias("w1"))


RADIUS = 3


def _near_pairs(spark, sf_dir) -> DataFrame:
    """Pairs (id1 < id2) of classes of equal SimHashes within RADIUS bits, by their smallest ids. Of four pieces of 16 bits one
    is equal; a pair comes from its first equal piece alone. Equal SimHashes are one class, so copies make no pairs."""
    h = scratch.staged(simhashes(spark, sf_dir).groupBy("w0", "w1").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")), "simhashes")
    piece = lambda a, b: [F.col(w).bitwiseAND(F.lit(0xFFFF)) if s == 0 else F.shiftright(w, 16) for w in (a, b) for s in (0, 1)]
    keyed = h.select("id", "w0", "w1", F.posexplode(F.array(*piece("w0", "w1"))).alias("band", "value"))
    other = keyed.select("band", "value", F.col("id").alias("o_id"), F.col("w0").alias("o_w0"), F.col("w1").alias("o_w1"))
    j = keyed.join(other, ["band", "value"]).where("id < o_id")
    first = sum((F.when(F.lit(k) < F.col("band"), (x == y).cast("int")).otherwise(0) for k, (x, y) in enumerate(zip(piece("w0", "w1"), piece("o_w0", "o_w1"), strict=True))), F.lit(0))
    d = (F.bit_count(F.col("w0").bitwiseXOR(F.col("o_w0"))) + F.bit_count(F.col("w1").bitwiseXOR(F.col("o_w1")))).cast("long")
    return j.where(first == 0).withColumn("distance", d).where(F.col("distance") <= RADIUS).select(F.col("id").alias("id1"), F.col("o_id").alias("id2"), "distance")


def hamming_radius_join(spark, sf_dir):
    return _near_pairs(spark, sf_dir)


def duplicate_clusters(spark, sf_dir):
    """Representative of each document: the smallest id of the documents that chains of near SimHashes connect."""
    h = simhashes(spark, sf_dir)
    own = h.join(h.groupBy("w0", "w1").agg(F.min("doc_id").alias("id")), ["w0", "w1"]).select("doc_id", "id")
    c = components(_near_pairs(spark, sf_dir).select(F.col("id1").alias("a"), F.col("id2").alias("b")))
    return own.join(c, F.col("id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "id").alias("canonical"))


def holdout_anti_join(spark, sf_dir):
    """Documents that are not the text of a benchmark item."""
    return docs(spark, sf_dir).join(table(spark, sf_dir, "benchmark").select("text"), "text", "left_anti").select("doc_id", "source")


def labelled_semi_join(spark, sf_dir):
    """Documents with a good rating."""
    return docs(spark, sf_dir).join(table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0"), "doc_id", "left_semi").select("doc_id", "lang")


def category_counts_having(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars")).where("n >= 5")


def grouping_sets(spark, sf_dir):
    """Counts by language and source, by each alone, and of all, with the level of grouping."""
    d = docs(spark, sf_dir).groupingSets([[F.col("lang"), F.col("source")], [F.col("lang")], [F.col("source")], []], F.col("lang"), F.col("source")).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))
    return d.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n", "level")


def length_classes(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("class", F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long"))
    return d.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("lang") == "en", 1).otherwise(0)).cast("long").alias("english"))


def domain_rule(spark, sf_dir):
    """The first domain of DOMAINS that has a keyword in the text, else general."""
    t, rule = F.lower("text"), None
    for name, keys in DOMAINS:
        hit = t.contains(keys[0]) | t.contains(keys[1]) | t.contains(keys[2])
        rule = F.when(hit, name) if rule is None else rule.when(hit, name)
    return docs(spark, sf_dir).select("doc_id", rule.otherwise("general").alias("domain"))


def domain_keywords(spark, sf_dir):
    """The domain with more of its KEYWORDS in the text, cs before medical; general if none is."""
    n = {k: sum((F.coalesce(F.lower("text").contains(w), F.lit(False)).cast("int") for w in ws), F.lit(0)) for k, ws in KEYWORDS.items()}
    return docs(spark, sf_dir).select("doc_id", n["cs"].cast("long").alias("cs"), n["medical"].cast("long").alias("medical")).withColumn("domain", F.when((F.col("cs") == 0) & (F.col("medical") == 0), "general").when(F.col("cs") >= F.col("medical"), "cs").otherwise("medical"))


def quality_join(spark, sf_dir):
    return docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("rated"), F.sum("toxic").cast("long").alias("toxic"))


def conversation_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max_by("role", "turn").alias("last_role"), F.sum(F.length("text")).alias("chars"))


def bucket_votes(spark, sf_dir):
    """The language that a benchmark item's terms and bigrams vote for: 0.3 for each document and term, 0.7 for each and bigram; taken if two languages or more have votes and it has 0.65 of all."""
    d, b = docs(spark, sf_dir), table(spark, sf_dir, "benchmark").where(F.col("item_id") % EVERY == 0)
    rows = None
    for f, w in ((F.array_distinct, 0.3), (lambda t: F.array_distinct(bigrams(t)), 0.7)):
        x = d.select("lang", F.explode(f(terms(F.col("text")))).alias("k")).join(b.select(F.col("item_id").alias("query_id"), F.explode(f(terms(F.col("text")))).alias("k")), "k")
        part = x.groupBy("query_id", "lang").agg((F.count(F.lit(1)) * w).alias("v"))
        rows = part if rows is None else rows.unionByName(part)
    v = rows.groupBy("query_id", "lang").agg(F.sum("v").alias("v"))
    w = Window.partitionBy("query_id")
    v = v.withColumns({"share": F.round(F.col("v") / F.sum("v").over(w), 6), "n": F.count(F.lit(1)).over(w)})
    return topk(v, 1, ["query_id"], [F.desc("share"), F.asc("lang")]).where("n >= 2 and share >= 0.65").select("query_id", "lang", "share")


X = "regexp_extract_all(lower(text), '[a-z0-9]+')"
T = f"t AS (SELECT doc_id, unnest({X}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2)"
D = "d AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM p GROUP BY 1)"
QW = f"w AS (SELECT DISTINCT item_id AS query_id, unnest({X}) AS term FROM benchmark WHERE item_id % {EVERY} = 0)"
L = "l AS (SELECT doc_id, sum(tf)::DOUBLE AS dl FROM p GROUP BY 1), c AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(dl) FROM l) AS all_dl)"
TITLE = "trim(regexp_replace(substr(text, 1, 60), '[ \\t\\n\\r]+', ' ', 'g'))"
TW = f"tw AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower({TITLE}), '[a-z]+'), lambda x: len(x) > 2)) AS ws FROM documents WHERE text IS NOT NULL)"
CO = "pw AS (SELECT doc_id, unnest(ws) AS word, ws FROM tw), po AS (SELECT word, unnest(ws) AS other FROM pw), co AS (SELECT word, other, count(*) AS n, row_number() OVER (PARTITION BY word ORDER BY count(*) DESC, other)::INT AS rank FROM po WHERE word <> other GROUP BY 1, 2 HAVING count(*) >= 2 QUALIFY rank <= 5)"
STOP = "('" + "', '".join(STOP_WORDS) + "')"
SPLIT = "list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '')"
GOOD = f"list_distinct(list_filter({SPLIT}, lambda x: len(x) >= 3 AND x NOT IN {STOP}))"


def _rank(weight):
    return f"WITH {T}, {D}, {QW}, {L}, s AS (SELECT query_id, doc_id, round(sum({weight}), 6) AS score FROM w JOIN d USING (term) JOIN p USING (term) JOIN l USING (doc_id), c GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 10"


def _hash_sql(k):
    bits = " + ".join(f"CASE WHEN sum(2 * ((m{k} >> {i}) & 1) - 1) > 0 THEN {1 << i} ELSE 0 END" for i in range(32))
    return f"({bits})::BIGINT AS w{k}"


SIM = f"u AS (SELECT doc_id, unnest(list_distinct({X})) AS t FROM documents), m AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS m0, ('0x' || substr(md5(t), 9, 8))::BIGINT AS m1 FROM u), sh AS MATERIALIZED (SELECT doc_id, {_hash_sql(0)}, {_hash_sql(1)} FROM m GROUP BY 1), k AS MATERIALIZED (SELECT w0, w1, min(doc_id) AS id FROM sh GROUP BY 1, 2), np AS MATERIALIZED (SELECT a.id AS id1, b.id AS id2, (bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1)))::BIGINT AS distance FROM k a JOIN k b ON a.id < b.id AND bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1)) <= {RADIUS})"
_KEYS = {k: " + ".join(f"coalesce(contains(lower(text), '{w}')::INT, 0)" for w in ws) for k, ws in KEYWORDS.items()}
_RULE = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{name}'" for name, ws in DOMAINS)
_BI = "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"
QUERIES = {
    "postings": (postings, f"WITH {T} SELECT * FROM p"),
    "token_df": (token_df, f"WITH {T}, {D} SELECT * FROM d WHERE df >= 2"),
    "tfidf_topk": (tfidf_topk, _rank("tf * ln(n / df)")),
    "bm25_topk": (bm25_topk, _rank(f"ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * dl / (all_dl / n)))")),
    "bigram_counts": (bigram_counts, f"WITH d AS (SELECT {X} AS t FROM documents), g AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS bigram FROM d WHERE len(t) > 1) SELECT bigram, count(*) AS n FROM g GROUP BY 1 HAVING n >= 5"),
    "trigram_counts": (trigram_counts, f"WITH {T}, g AS (SELECT unnest(list_transform(range(1, len(term) - 1), lambda i: substr(term, i, 3))) AS trigram FROM p WHERE len(term) >= 3) SELECT trigram, count(*) AS n FROM g GROUP BY 1"),
    "whitespace_tokens": (whitespace_tokens, f"SELECT doc_id, len({SPLIT})::BIGINT AS tokens, len({GOOD})::BIGINT AS content FROM documents WHERE text IS NOT NULL"),
    "inverted_index": (inverted_index, f"WITH p AS (SELECT doc_id, unnest({GOOD}) AS term FROM documents) SELECT term, floor(doc_id / 65536)::BIGINT AS block, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM p GROUP BY 1, 2"),
    "vocabulary_fields": (vocabulary_fields, f"WITH {T} SELECT term, lang, count(*) AS df FROM p JOIN documents USING (doc_id) GROUP BY 1, 2 HAVING df >= 3"),
    "clean_titles": (clean_titles, f"SELECT doc_id, trim(regexp_replace(regexp_replace({TITLE}, '<[^>]*>', ' ', 'g'), ' +', ' ', 'g')) AS title FROM documents WHERE len(trim(regexp_replace(regexp_replace({TITLE}, '<[^>]*>', ' ', 'g'), ' +', ' ', 'g'))) >= 5"),
    "cooccurring": (cooccurring, f"WITH {TW}, {CO} SELECT * FROM co"),
    "expanded_queries": (expanded_queries, f"WITH {TW}, {CO}, q AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: len(x) > 2)[1:4] AS ws FROM benchmark), z AS (SELECT *, array_to_string(ws, ' ') AS query FROM q), o AS (SELECT query_id, ws, unnest(ws) AS word, unnest(range(len(ws))) AS seat FROM z WHERE query NOT IN (SELECT lower({TITLE}) FROM documents WHERE text IS NOT NULL)), r AS (SELECT query_id, other, min((seat, rank)) AS place FROM o JOIN co USING (word) WHERE NOT list_contains(ws, other) GROUP BY 1, 2), r3 AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place, other) <= 3), a AS (SELECT query_id, string_agg(other, ' ' ORDER BY other) AS added FROM r3 GROUP BY 1) SELECT query_id, query || coalesce(' ' || added, '') AS expanded FROM z LEFT JOIN a USING (query_id)"),
    "spell_candidates": (spell_candidates, f"WITH {T}, {D}, {QW}, v AS (SELECT term, df FROM d WHERE df >= 2 AND len(term) BETWEEN 3 AND 30), q AS (SELECT DISTINCT term[1] || term[3] || term[2] || substr(term, 4) AS word FROM w WHERE len(term) BETWEEN 4 AND 28) SELECT word, term, df, damerau_levenshtein(word, term)::INT AS edits FROM q JOIN v ON damerau_levenshtein(word, term) <= 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY edits, df DESC, term) = 1"),
    "perturbed": (perturbed, "WITH b AS (SELECT item_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM benchmark) SELECT item_id, len(ws)::BIGINT AS words, array_to_string(list_transform(list_filter(list_zip(ws, range(len(ws))), lambda z: md5(z[1] || z[2]::VARCHAR)[1] >= '5'), lambda z: z[1]), ' ') AS text FROM b"),
    "title_router": (title_router, f"WITH {TW}, b AS (SELECT item_id AS query_id, text AS q_text FROM benchmark), k AS (SELECT query_id, list_distinct(list_filter(regexp_extract_all(lower(q_text), '[a-z]+'), lambda x: len(x) > 4)[1:2]) AS k FROM b), u AS (SELECT query_id, doc_id, 0 AS layer FROM documents JOIN b ON text = q_text UNION ALL SELECT query_id, doc_id, 1 FROM documents JOIN b ON substr(text, 1, 40) = substr(q_text, 1, 40) AND len(q_text) >= 40 UNION ALL SELECT query_id, doc_id, 2 FROM tw JOIN k ON len(k) = 2 AND list_contains(ws, k[1]) AND list_contains(ws, k[2])), m AS (SELECT query_id, doc_id, min(layer)::INT AS layer FROM u GROUP BY 1, 2), f AS (SELECT * FROM m QUALIFY layer = min(layer) OVER (PARTITION BY query_id)) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id)::INT AS rank FROM f QUALIFY rank <= 5"),
    "anchor_masks": (anchor_masks, f"WITH {T}, {D}, {QW}, a AS (SELECT term FROM d WHERE df >= 2 AND len(term) >= 3 ORDER BY df DESC, term LIMIT 64), q AS (SELECT query_id, term FROM w JOIN a USING (term)), s AS (SELECT query_id, doc_id, count(*) AS held FROM p JOIN q USING (term) GROUP BY 1, 2), r AS (SELECT *, coalesce(lead(held) OVER o, 0) AS next, row_number() OVER o AS rank FROM s WINDOW o AS (PARTITION BY query_id ORDER BY held DESC, doc_id)), n AS (SELECT query_id, count(*) AS asked FROM q GROUP BY 1) SELECT query_id, doc_id, held, asked, held >= 0.875 * asked AND held >= 2 * next AS accepted FROM r JOIN n USING (query_id) WHERE rank = 1"),
    "semantic_bypass": (semantic_bypass, f"WITH {T}, n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1), e AS (SELECT doc_id, any_value(n) AS n, round(-sum(tf / n * log2(tf / n)), 6) + 0.0 AS entropy FROM p JOIN n USING (doc_id) GROUP BY 1) SELECT doc_id, coalesce(n, 0)::BIGINT AS n, coalesce(entropy, 0.0) AS entropy, coalesce(n, 0) < 12 OR coalesce(entropy, 0) < 3 AS bypass FROM documents LEFT JOIN e USING (doc_id)"),
    "dedup_first_wins": (dedup_first_wins, "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"),
    "first_per_source": (first_per_source, "SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, text"),
    "hamming_radius_join": (hamming_radius_join, f"WITH {SIM} SELECT * FROM np"),
    "duplicate_clusters": (duplicate_clusters, f"WITH RECURSIVE {SIM}, e AS (SELECT id1 AS a, id2 AS b FROM np UNION SELECT id2, id1 FROM np), r AS (SELECT id AS a, id AS b FROM k UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a, min(b) AS canonical FROM r GROUP BY 1) SELECT doc_id, canonical FROM sh JOIN k USING (w0, w1) JOIN c ON c.a = k.id"),
    "holdout_anti_join": (holdout_anti_join, "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)"),
    "labelled_semi_join": (labelled_semi_join, "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)"),
    "category_counts_having": (category_counts_having, "SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY 1, 2 HAVING n >= 5"),
    "grouping_sets": (grouping_sets, "SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n, grouping(documents.lang, documents.source)::BIGINT AS level FROM documents GROUP BY GROUPING SETS ((documents.lang, documents.source), (documents.lang), (documents.source), ())"),
    "length_classes": (length_classes, "SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS class, count(*) AS n, sum((lang = 'en')::INT)::BIGINT AS english FROM documents GROUP BY 1"),
    "domain_rule": (domain_rule, f"SELECT doc_id, CASE {_RULE} ELSE 'general' END AS domain FROM documents"),
    "domain_keywords": (domain_keywords, f"WITH n AS (SELECT doc_id, ({_KEYS['cs']})::BIGINT AS cs, ({_KEYS['medical']})::BIGINT AS medical FROM documents) SELECT *, CASE WHEN cs = 0 AND medical = 0 THEN 'general' WHEN cs >= medical THEN 'cs' ELSE 'medical' END AS domain FROM n"),
    "quality_join": (quality_join, "SELECT source, count(*) AS n, count(quality) AS rated, sum(toxic)::BIGINT AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"),
    "conversation_turns": (conversation_turns, "SELECT conv_id, count(*) AS turns, arg_max(role, turn) AS last_role, sum(len(text))::BIGINT AS chars FROM conversations GROUP BY 1"),
    "bucket_votes": (bucket_votes, f"WITH x AS (SELECT lang, {X} AS t FROM documents), y AS (SELECT item_id AS query_id, {X} AS t FROM benchmark WHERE item_id % {EVERY} = 0), a AS (SELECT lang, unnest(list_distinct(t)) AS k, 0.3::DOUBLE AS w FROM x UNION ALL SELECT lang, unnest(list_distinct({_BI})), 0.7 FROM x), b AS (SELECT query_id, unnest(list_distinct(t)) AS k FROM y UNION ALL SELECT query_id, unnest(list_distinct({_BI})) FROM y), v AS (SELECT query_id, lang, sum(w) AS v FROM a JOIN b USING (k) GROUP BY 1, 2), s AS (SELECT query_id, lang, round(v / sum(v) OVER w, 6) AS share, count(*) OVER w AS n FROM v WINDOW w AS (PARTITION BY query_id)) SELECT query_id, lang, share FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY share DESC, lang) = 1 AND n >= 2 AND share >= 0.65"),
}
