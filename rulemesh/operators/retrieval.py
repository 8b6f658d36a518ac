"""Lexical and vector retrieval, and line search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Okapi constants: term saturation, length normalisation, and the share of the mean idf that replaces negative ones.
K1, B, EPSILON = 1.5, 0.75, 0.25


def corpus_stats(docs: DataFrame, terms: Column) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) and the single row (n_docs, avgdl).

    A negative idf is replaced by EPSILON times the mean over all terms. A
    document's terms are made distinct in its row, so only counts of terms,
    added up before they are moved, are shuffled.
    """
    tokens = docs.select(terms.alias("_terms"))
    sizes = tokens.agg(F.count("*").alias("n_docs"), F.avg(F.size("_terms")).alias("avgdl"))
    df = tokens.select(F.explode(F.array_distinct("_terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # the sizes are a single row, the mean is another
    raw = df.join(F.broadcast(sizes)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw")).alias("idf"))
    return idf, sizes


def bm25(docs: DataFrame, key: str, text: Column, query: str, k: int = 10) -> DataFrame:
    """The ``k`` best documents for the query's words, ties by key; scores of 0 and less are dropped after the cut.

    A word that the query repeats counts each time. How often a document has
    the query's words is counted in its row; the mean idf takes all words into
    account.
    """
    words = re.findall("[a-z0-9#]+", query.lower())
    times = {w: words.count(w) for w in words}
    if not times:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    idf, sizes = corpus_stats(docs, S.words(text))
    own = docs.select(key, S.words(text).alias("_terms"))

    def seen(word: str) -> Column:
        return F.size(F.filter("_terms", lambda x: x == word))

    counts = F.array(*[F.struct(F.lit(w).alias("term"), F.lit(n).alias("times"), seen(w).alias("tf")) for w, n in times.items()])
    hits = own.select(key, F.size("_terms").alias("length"), F.explode(F.filter(counts, lambda c: c["tf"] > 0)).alias("c")).select(key, "length", "c.*")
    # one row for each word of the query, and a single row
    hits = hits.join(F.broadcast(idf.where(F.col("term").isin(*times))), "term").join(F.broadcast(sizes))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    scores = hits.groupBy(key).agg(F.sum(part * F.col("times")).alias("score"))
    return scores.orderBy(F.desc(F.round("score", 9)), key).limit(k).where("score > 0")


def vector_top(rows: DataFrame, key: str, vector: str, query: Column, keep: Column, k: int = 10, fetch: int = 3) -> DataFrame:
    """The ``k`` nearest by cosine among the ``fetch * k`` nearest that pass ``keep``; may be fewer than ``k``.

    The filter comes after the first cut on purpose.
    """
    scored = rows.withColumn("similarity", F.round(S.cosine(F.col(vector), query), 3))
    near = scored.orderBy(F.desc("similarity"), key).limit(fetch * k)
    return near.where(keep).orderBy(F.desc("similarity"), key).limit(k).select(key, "similarity")


def grep(docs: DataFrame, key: str, text: Column, pattern: str, cap: int | None = 80) -> DataFrame:
    """Lines that match, without regard to case: (key, line number from 1, the line's first 200 characters).

    A pattern that isn't a regular expression raises ValueError. With ``cap``
    the first that many by key and line.
    """
    try:
        re.compile(pattern)
    except re.error as error:
        raise ValueError(f"bad regular expression: {error}") from None
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    hits = lines.where(F.col("line").rlike(f"(?i){pattern}"))
    out = hits.select(key, (F.col("at") + 1).alias("line_no"), F.substring(F.trim("line"), 1, 200).alias("line"))
    return out if cap is None else out.orderBy(key, "line_no").limit(cap)


def embed_text(summary: Column, intent: Column, text: Column, which: str, longest: int = 6000) -> Column:
    """What is embedded for a collection: summary, intent or text, with fallbacks."""
    filled = lambda c: F.nullif(c, F.lit(""))
    chosen = {
        "summary": F.coalesce(filled(summary), text),
        "intent": F.coalesce(filled(intent), filled(summary), text),
        "text": text,
    }[which]
    return F.substring(chosen, 1, longest)


def candidate_union(reports: DataFrame, item: str, retriever: str, score: str) -> DataFrame:
    """Items of several retrievers with who found them and their best score, most finders first."""
    return reports.groupBy(item).agg(
        F.array_sort(F.collect_set(retriever)).alias("found_by"), F.max(score).alias("best"), F.countDistinct(retriever).alias("n")
    )
