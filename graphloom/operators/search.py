"""Search: BM25 over token tables, scores of files, vector search, rank fusion, segmentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_K = 60

#: Suffixes that the light stemmer cuts, longest first, where three letters or more are left.
SUFFIXES = ["ational", "ization", "fulness", "ousness", "iveness", "ments", "ness", "ment", "ings", "ing", "edly", "ed", "ies", "ly", "es", "s"]


def stem(word: Column) -> Column:
    """One suffix off, as an expression."""
    out = F.when(F.lit(False), word)
    for s in SUFFIXES:
        out = out.when(word.endswith(s) & (F.length(word) >= len(s) + 3), F.substr(word, F.lit(1), F.length(word) - len(s)))
    return out.otherwise(word)


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", stemmed: bool = False) -> DataFrame:
    """key, term, tf, len: one row for each term of a document."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")
    t = docs.select(key, words.alias("w")).select(key, F.size("w").alias("len"), F.explode("w").alias("term"))
    if stemmed:
        t = t.withColumn("term", stem(F.col("term")))
    return t.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def bm25(docs: DataFrame, query: str, key: str = "doc_id", conjunctive: bool = False, limit: int | None = 20, stemmed: bool = False) -> DataFrame:
    """key, score, rank. Documents are cut down to the query's terms before anything is shuffled; the corpus statistics are
    one pass of their own. Ties go to the smaller key."""
    spark = docs.sparkSession
    terms = sorted({w for w in "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in query.lower()).split()})
    if stemmed and terms:
        terms = sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(stem(F.col("t"))).collect()})
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")
    base = docs.select(key, words.alias("w")).select(key, F.size("w").alias("len"), F.explode(F.filter(F.transform("w", lambda w: stem(w)) if stemmed else F.col("w"), lambda w: w.isin(terms))).alias("term"))
    hits = base.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    stats = docs.select(F.size(words).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    x = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # one row of statistics, and as many as the query has terms
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = x.groupBy(key).agg(F.round(F.sum(weight), 9).alias("score"), F.count_distinct("term").alias("terms"))
    if conjunctive:
        scored = scored.filter(F.col("terms") == len(terms))
    scored = scored.select(key, "score")
    return scored.orderBy(F.desc("score"), key).limit(limit) if limit else scored


def file_scores(hits: DataFrame, top: int = 3) -> DataFrame:
    """filePath, score (the sum of its best `top` nodes), ids of those nodes, best first."""
    best = hits.withColumn("rn", F.row_number().over(W.partitionBy("filePath").orderBy(F.desc("score"), "id"))).filter(F.col("rn") <= top)
    return best.groupBy("filePath").agg(F.round(F.sum("score"), 9).alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]), ",").alias("ids"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id") -> DataFrame:
    """key, distance (1 - cosine): exact, one scan, top-k without a full sort."""
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    size = sum(float(x) ** 2 for x in query) ** 0.5
    return vectors.select(key, F.round(1 - dot(F.col("embedding"), q) / (norm * size), 9).alias("distance")).orderBy("distance", key).limit(k)


def fuse(ranked: dict[str, DataFrame], limit: int = 10, key: str = "filePath") -> DataFrame:
    """key, score, sources: reciprocal rank fusion of tables (key, rank from 1)."""
    rows = reduce(DataFrame.union, [d.select(key, "rank", F.lit(name).alias("source")) for name, d in ranked.items()])
    out = rows.groupBy(key).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return out.orderBy(F.desc("score"), key).limit(limit)


def ranked(scored: DataFrame, by: list[Column]) -> DataFrame:
    """Ranks of a list that a limit has bounded."""
    return scored.withColumn("rank", F.row_number().over(W.orderBy(*by)))


def cjk_bigrams(text: Column) -> Column:
    """Runs of Han, kana and Hangul become overlapping pairs, with spaces where scripts meet."""
    cjk = r"[぀-ヿ㐀-䶿一-鿿가-힯]"
    parts = F.regexp_extract_all(text, F.lit(rf"({cjk}+|(?:(?!{cjk})\S)+)"), 1)
    pairs = lambda p: F.when(p.rlike(rf"^{cjk}") & (F.length(p) > 1), F.array_join(F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substr(p, i, F.lit(2))), " ")).otherwise(p)
    return F.array_join(F.transform(parts, pairs), " ")


def result_line(rank: Column, path: Column, score: Column, sources: Column) -> Column:
    return F.format_string("[%d] %s (%.4f, %s)", rank.cast("int"), path, score, sources)
