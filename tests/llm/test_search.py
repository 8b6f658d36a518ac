"""The threshold algorithm against scoring every document, and what it reads."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rulemesh.llm import ranked_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_all = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOW)))
        found = []
        for (i, bag), n in zip(bags, sizes):
            m = 25 + 75 * n * n_docs // max(1, n_all)
            score = sum(
                c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t, c in asked.items() if t in bag
            )
            found += [(-score, i is None, i or 0)] if score > 0 else []
        out += [(item, n + 1, None if nameless else i, -s) for n, (s, nameless, i) in enumerate(sorted(found)[:k])]
    return Counter(out)


DOCS = [
    (1, None), (2, ""), (3, "..."), (4, "Red fox"), (5, "red FOX red"), (5, "red FOX red"), (6, "blue fox"), (None, "red fox"), (7, "red fox"),
    (8, "the " * 20_000 + "red"), (9, "日本 fuchs übér"), (10, "the the a"), (11, "the b"), (12, "the fox"),
]
ITEMS = [(1, "red fox"), (2, "fox fox Red the"), (3, None), (4, ""), (5, "nowhere"), (6, "日本 ÜBÉR übér"), (None, "blue"), (7, "red fox"), (7, "the")]


@pytest.mark.parametrize("k,pass_terms", [(1, 2), (3, 5), (10, 10**6)])
def test_odd_rows(spark, k, pass_terms):
    """Nulls, empty and long texts, ties, repeated rows and items, clashing names; in one pass or many."""
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in DOCS], "doc_id long, text string, score int, number string").repartition(3)
    items = spark.createDataFrame([(i, t, 2) for i, t in ITEMS], "item_id long, text string, rank int")
    got = S.search(docs, items, k, pass_terms=pass_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain(DOCS, ITEMS, k)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert S.search(docs.limit(0), items).collect() == [] and S.search(docs, items.limit(0)).collect() == []
    assert Counter(map(tuple, S.search(docs, items).collect())) == plain([(1, "a b"), (2, "a")], [(1, "b")])


def blocks(rng, n):
    words = np.array([f"w{int(x)}" for x in range(200)])
    return [" ".join(words[np.minimum(rng.zipf(1.3, rng.integers(1, 60)) - 1, 199)]) for _ in range(n)]


def test_one_block_keeps_ties_and_stops_early():
    """Same best scores as scoring all; a query with one rare term and a common one reads a part of the common list."""
    rng = np.random.default_rng(3)
    texts = blocks(rng, 3000)
    vocabulary = pa.array([f"w{n}".encode() for n in range(200)], pa.large_binary())
    block = S.Block(pa.array(texts, pa.large_string()), vocabulary)
    index = S.Index(block, 25 + 75 * block.length * block.n // block.length.sum(), 200)
    read = []
    scored = index.score
    index.score = lambda docs, weight: read.append(len(docs)) or scored(docs, weight)
    for wanted in ([0], [0, 1, 150], [5, 6, 7, 8, 9], [199]):
        weight = np.zeros(200, np.int64)
        weight[wanted] = [3 + n for n in range(len(wanted))]
        whole = np.zeros(block.n, np.int64)
        np.add.at(whole, index.doc, index.impact * weight[index.term])
        for held in (np.zeros(0, np.int64), np.full(5, np.sort(whole)[-3])):
            read.clear()
            docs, scores = index.best(np.array(wanted), weight, 5, held)
            assert (whole[docs] == scores).all() and len(set(docs.tolist())) == len(docs)
            kth = np.sort(np.concatenate([whole, held]))[-5]
            assert sorted(docs.tolist()) == np.flatnonzero((whole >= max(kth, 1))).tolist()
    index.best(np.array([0]), np.eye(200, dtype=np.int64)[0], 1, np.zeros(0, np.int64))
    assert read[-1] < (index.list_at[1] - index.list_at[0]) / 2


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert Counter(map(tuple, S.op12_threshold_search(spark, sf_dir).collect())) == plain(docs, items)
