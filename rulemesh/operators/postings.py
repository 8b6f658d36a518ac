"""Postings with block bounds, and many lexical queries at once over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .joins import tasks
from .retrieval import EPSILON, K1, B

#: Documents of a block, about: bounds the entries of one row of ``lists``.
BLOCK = 4096
#: Bands of document lengths for each doubling: a block's documents are about as long, so its bound is near their scores.
BANDS = 4
#: Scores are compared with bounds up to this, as sums of doubles depend on their order.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """``lists``: (term, block, hi, n, entries of key, part), ``terms``: (term, df, idf), ``sizes``: the row (n_docs, avgdl).

    ``part`` is a document's share of a term's score, but for the term's idf; ``hi`` is a block's largest.
    ``sizes`` is None where tables of an index were read again: searches don't need it.
    """

    lists: DataFrame
    terms: DataFrame
    sizes: DataFrame | None = None


def build(docs: DataFrame, key: str, text: Column, block: int = BLOCK) -> Index:
    """An index of all documents; ``key`` is unique, a null text has no words but counts as a document.

    Texts are dealt over many tasks and a document's words counted within its
    row, so no task holds more than its share of documents; what is shuffled are
    the texts, then a block's entries.
    """
    # a few files can hold many documents, so these are dealt out before they become rows of words
    dealt = docs.select(F.col(key).alias("key"), text.alias("_text")).repartition(tasks(docs), "key")
    own = dealt.select("key", F.coalesce(S.words(F.col("_text")), F.array().cast("array<string>")).alias("_terms"))
    own = own.withColumn("length", F.size("_terms"))
    sizes = docs.select(F.size(F.coalesce(S.words(text), F.array().cast("array<string>"))).alias("length")).agg(F.count("*").alias("n_docs"), F.avg("length").alias("avgdl"))
    split = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block))
    place = F.struct(F.floor(F.log2(F.col("length")) * BANDS).alias("band"), F.pmod(F.xxhash64("key"), split).alias("deal"))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    # a document's words in order: where each begins, and up to where the next one does
    ordered = own.where("length > 0").select("key", "length", F.sort_array("_terms").alias("_sorted"))
    begins = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)))
    begun = ordered.withColumn("_begins", begins)
    until = lambda i: F.coalesce(F.get("_begins", i + 1), F.col("length"))
    counted = F.transform("_begins", lambda at, i: F.struct(F.get("_sorted", at).alias("term"), (until(i) - at).alias("tf")))
    seen = begun.select("key", "length", F.inline(counted))
    # the sizes are a single row
    entries = seen.join(F.broadcast(sizes)).select("term", place.alias("block"), "key", part.alias("part"))
    lists = entries.groupBy("term", "block").agg(F.max("part").alias("hi"), F.count("*").alias("n"), F.collect_list(F.struct("key", "part")).alias("entries"))
    return over(lists, sizes)


def over(lists: DataFrame, sizes: DataFrame) -> Index:
    """An index of lists that were written out: how many documents have a term is read off its blocks."""
    return Index(lists, term_weights(lists.groupBy("term").agg(F.sum("n").alias("df")), sizes), sizes)


def term_weights(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """(term, df, idf); a negative idf is replaced by a share of the mean over all terms."""
    raw = df.join(F.broadcast(sizes)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw")).alias("idf"))


def search(index: Index, queries: DataFrame, query: str, text: Column, k: int = 10) -> DataFrame:
    """Each query's ``k`` best documents, ties by key: (query, key, score). Scores of 0 and less are dropped after the cut.

    A block's bound for a query is the sum of its words' largest shares. The
    blocks with the highest bounds that surely hold ``k`` documents give the
    query's k-th score so far; blocks whose bound lies below it hold no document
    that could come in, and their entries aren't joined. Nothing is dropped that
    might count: the result is that of scoring all.
    """
    words = queries.select(F.col(query).alias("query"), F.explode(S.words(text)).alias("term"))
    weighted = words.groupBy("query", "term").agg(F.count("*").alias("times")).join(index.terms, "term")
    weighted = weighted.select("query", "term", (F.col("times") * F.col("idf")).alias("weight"))
    over = F.sum(F.greatest(F.lit(0.0), F.col("weight") * F.col("hi")))
    bounds = weighted.join(index.lists.select("term", "block", "hi", "n"), "term").groupBy("query", "block").agg(over.alias("bound"), F.max("n").alias("n"))
    before = Window.partitionBy("query").orderBy(F.desc("bound"), F.desc("n"), "block").rowsBetween(Window.unboundedPreceding, -1)
    first = bounds.withColumn("_held", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("_held") < k)
    kth = _best(_scores(index, weighted, first.select("query", "block")), k).where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    open_ = bounds.join(kth, "query", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
    return _best(_scores(index, weighted, open_.select("query", "block")), k).where("score > 0").select("query", "key", "score")


def _scores(index: Index, weighted: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query, key, score) of the documents with one of the query's words in the given blocks."""
    lists = index.lists.select("term", "block", "entries")
    # a pair of a query and a list is few bytes and many rows, so tasks aren't to be drawn together by their bytes
    n = tasks(pairs)
    asked = pairs.join(weighted, "query").repartition(n, "term", "block")
    hits = asked.join(lists, ["term", "block"]).select("query", "weight", F.explode("entries").alias("e"))
    shares = hits.select("query", F.col("e.key").alias("key"), (F.col("weight") * F.col("e.part")).alias("share"))
    return shares.repartition(n, "query", "key").groupBy("query", "key").agg(F.sum("share").alias("score"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "key")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
