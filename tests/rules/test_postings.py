"""Blocks of postings: the same documents as scoring all, and fewer entries read."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from rulemesh.operators import postings as Q
from rulemesh.operators.retrieval import bm25

WORDS = [f"w{n}" for n in range(60)]


def corpus(n=600, seed=3):
    draw = random.Random(seed)
    texts = [" ".join(draw.choices(WORDS, [1 / (r + 1) for r in range(60)], k=int(2 ** draw.uniform(0, 7)))) for _ in range(n)]
    return [*enumerate(texts), (n, ""), (n + 1, None), (n + 2, "?!"), *((n + 3 + i, "w7 w9 w9") for i in range(15))]


def plain(docs, queries, k):
    """Scores of all documents, one query after the other."""
    words = {key: (text or "").split() if (text or "").isascii() and text != "?!" else [] for key, text in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for own in words.values() for w in set(own))
    raw = {w: math.log(len(words) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: low if i < 0 else i for w, i in raw.items()}
    out = {}
    for name, text in queries:
        scores = {}
        for key, own in words.items():
            tf, seen = Counter(own), [w for w in (text or "").lower().split() if w in own]
            if seen:
                scores[key] = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(own) / mean)) for w in seen)
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out |= {(name, key): round(score, 6) for key, score in best if score > 0}
    return out


def rows(found):
    return {(r["query"], r["key"]): round(r["score"], 6) for r in found.collect()}


def test_many_queries_as_scoring_all(spark):
    docs, draw = corpus(), random.Random(5)
    queries = [(n, " ".join(draw.choices(WORDS, k=draw.randint(1, 5)))) for n in range(40)]
    queries += [(100, "w7 W9 w9"), (101, "nothing"), (102, ""), (103, None), (104, "w0 w0 w1"), (105, "w0")]
    table = spark.createDataFrame(docs, "id long, text string")
    asked = spark.createDataFrame(queries, "q long, words string")
    for block in (8, 64, 4096):
        index = Q.build(table, "id", F.col("text"), block=block)
        assert rows(Q.search(index, asked, "q", F.col("words"), k=7)) == plain(docs, queries, 7)


def test_same_as_one_query_and_empty_tables(spark):
    docs = [d for d in corpus() if d[1]]
    table = spark.createDataFrame(docs, "id long, text string")
    index = Q.build(table, "id", F.col("text"), block=32)
    asked = spark.createDataFrame([(1, "w3 w20 w3")], "q long, words string")
    one = {(1, r.id): round(r.score, 6) for r in bm25(table, "id", F.col("text"), "w3 w20 w3").collect()}
    assert rows(Q.search(index, asked, "q", F.col("words"))) == one
    assert rows(Q.search(index, asked.limit(0), "q", F.col("words"))) == {}
    assert rows(Q.search(Q.build(table.limit(0), "id", F.col("text")), asked, "q", F.col("words"))) == {}


def test_an_index_read_again_and_blocks_left_closed(spark, tmp_path):
    """A query of a rare word and a common one opens a part of the common word's blocks; entries of a block are bounded."""
    docs = corpus(3000)
    index = Q.build(spark.createDataFrame(docs, "id long, text string"), "id", F.col("text"), block=64)
    for name in ("lists", "terms"):
        getattr(index, name).write.parquet(f"{tmp_path}/{name}")
    again = Q.Index(spark.read.parquet(f"{tmp_path}/lists"), spark.read.parquet(f"{tmp_path}/terms"))
    queries = [(1, "w0 w59")]
    asked = spark.createDataFrame(queries, "q long, words string")
    opened, whole = [], Q._scores

    def counted(index, weighted, pairs):
        opened.append(pairs.count())
        return whole(index, weighted, pairs)

    Q._scores = counted
    try:
        assert rows(Q.search(again, asked, "q", F.col("words"), k=3)) == plain(docs, queries, 3)
    finally:
        Q._scores = whole
    blocks = again.lists.where("term IN ('w0', 'w59')").select("block").distinct().count()
    assert opened[1] < 0.7 * blocks, (opened, blocks)
    assert again.lists.agg(F.max(F.size("entries"))).first()[0] < 2 * 64


def test_documents_of_one_file_are_dealt_out_before_their_words(spark):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id", "concat_ws(' ', 'b', 'a', id, 'b') AS text")
    index = Q.build(docs, "id", F.col("text"))
    plan = index.lists._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("RepartitionByExpression") and "Aggregate [key" not in plan
    assert {r["term"]: r["n"] for r in index.lists.where("term IN ('a', 'b')").groupBy("term").agg(F.sum("n").alias("n")).collect()} == {"a": 3000, "b": 3000}
