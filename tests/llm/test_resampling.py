"""Importance resampling against a plain version, by SQL over the table, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rulemesh.llm import resampling as R
from rulemesh.llm._text import crc32

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, target, run_words=1, buckets=R.BUCKETS, least=R.LEAST_WORDS, percent=R.PERCENT):
    def words(text):
        return WORD.findall((text or "").translate(LOW))

    def bag(text):
        w = words(text)
        return Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, run_words + 1) for i in range(len(w) - k + 1))

    s, t = Counter(), Counter()
    for _, x in docs:
        s += bag(x)
    for x in target:
        t += bag(x)
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        b = bag(x)
        weight = sum(gain[k] * n for k, n in b.items())
        out.append([i, sum(b.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = n + 1
    return Counter(tuple(r[:5]) for r in out)


LONG = "Überall Straßen und 42 Häuser, " * 20
ODD = [
    (1, None), (2, ""), (3, "  ..  "), (4, LONG), (4, LONG), (5, LONG), (None, LONG), (6, "one two three four five six seven eight nine ten " * 2),
    (7, "é́ 日本 a-b A_B " * 9), (8, "word " * 30_000), (9, "\x00x\x7fy\x80z " * 10),
]


@pytest.mark.parametrize("run_words", [1, 2, 3])
@pytest.mark.parametrize("hot", [R.HOT, 0.0, 2.0])
def test_odd_rows(spark, run_words, hot):
    """Nulls, empty and long texts, repeated rows and ids, clashing names; copies joined by either way."""
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, digest string, n int").repartition(3)
    target = spark.createDataFrame([(1, "one two STRASSEN 42"), (2, None), (3, "")], "item_id long, text string")
    got = R.resample(docs, target, run_words=run_words, buckets=500, percent=60, hot=hot)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain(ODD, ["one two STRASSEN 42", None, ""], run_words, 500, percent=60)


def test_empty_tables(spark):
    none, some = (spark.createDataFrame(x, "doc_id long, text string") for x in ([], [(1, "a b")]))
    assert R.resample(none, some).collect() == []
    assert Counter(map(tuple, R.resample(some, none).collect())) == plain([(1, "a b")], [])


def test_texts_are_grouped_before_they_are_read(spark, sf_dir):
    """Equal texts are one row of features, counted as often as they occur."""
    texts = spark.createDataFrame([("a b a", 3), ("b", 1)], "text string, n long")
    sums = R.totals(R.bags(texts, "text"))
    assert sums[zlib.crc32(b"a") % R.BUCKETS] == 6 and sums[zlib.crc32(b"b") % R.BUCKETS] == 4 and sums.sum() == 10


def test_crc32():
    words = [b"", b"a", "é".encode(), b"hello world", bytes(range(256))]
    ends = np.cumsum([len(w) for w in words])
    got = crc32(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert got.tolist() == [zlib.crc32(w) for w in words]


def test_bag_of_slices():
    n, bucket, counts, offs = R.bag(pa.array(["x y x", None, "y"], pa.large_string()).fill_null(""))
    assert n.tolist() == [3, 0, 1] and offs.tolist() == [0, 2, 2, 3] and sorted(counts.tolist()) == [1, 1, 2]


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert Counter(map(tuple, R.op11_importance_resampling(spark, sf_dir).collect())) == plain(docs, target)
