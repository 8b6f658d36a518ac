"""The q-gram index of quotes, chains of any length, and labels by patterns."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rulemesh.functions import scalars as S
from rulemesh.operators import extraction as M
from rulemesh.operators import graph as J
from rulemesh.operators import quotes as Q


@pytest.mark.parametrize("q,w", [(16, 16), (6, 4), (1, 1), (2, 5)])
def test_a_text_keeps_what_any_quote_of_it_keeps(q, w):
    rng = random.Random(q)
    texts = ["", "a", "ab" * 50, "é日本" * 30, *("".join(rng.choices("abé ", k=rng.randint(0, 120))) for _ in range(30))]
    owner, place, gram = Q.winnowed(pa.array(texts), q, w)
    kept = {(o, p): g for o, p, g in zip(owner.tolist(), place.tolist(), gram.tolist())}
    for n, text in enumerate(texts):
        raw = text.encode()
        assert all(p + q <= len(raw) for o, p in kept if o == n)
        for at in range(len(raw) - q - w + 2):  # each window of the text holds one
            assert any((n, at + k) in kept for k in range(w))
        for _ in range(5):
            if len(raw) >= q + w - 1:
                low = rng.randint(0, len(text) - 1)
                part = text[low : low + rng.randint(1, 80)]
                start = len(text[:low].encode())
                for o, p, g in zip(*(x.tolist() for x in Q.winnowed(pa.array([part]), q, w))):
                    assert kept[n, start + p] == g
    assert len(owner) == len(np.unique(np.stack([owner, place]), axis=1).T)


def test_quotes_of_all_lengths(spark):
    """Texts that share long passages, quotes of 1 to 200 characters from any place, some with a slip, more quotes than texts."""
    rng = random.Random(8)
    passages = ["".join(rng.choices("abcdefé ", k=200)) for _ in range(4)]
    texts = {n: "".join(rng.choice(passages)[: rng.randint(0, 200)] for _ in range(3)) for n in range(40)}
    texts |= {100: None, 101: "", 102: texts[3], 103: texts[3]}
    wanted = []
    for n in range(150):
        text = texts[rng.randrange(40)] or "abc"
        low, size = rng.randrange(len(text) or 1), rng.choice([1, 2, 5, 8, 9, 12, 30, 31, 32, 60, 200])
        quote = text[low : low + size]
        wanted.append((n, quote if rng.random() < 0.8 else quote[:-1] + "#"))
    units = spark.createDataFrame(list(texts.items()), "unit int, body string").repartition(3)
    quotes = spark.createDataFrame(wanted, "name int, quote string")
    want = sorted((i, n, t.find(q), t.find(q) + len(q)) for i, t in texts.items() for n, q in wanted if t is not None and q in t)
    for chars in (50, 1_000_000):
        got = M.exact_quotes(quotes, units, "quote", "body", chars=chars)
        assert sorted((r.unit, r.name, r.start, r.end) for r in got.collect()) == want


def test_each_level_reads_the_texts_once(spark, tmp_path):
    quotes = spark.createDataFrame([(f"a quote of forty characters or more, no. {n}",) for n in range(300)], "quote string")
    texts = spark.createDataFrame([(n, -n, f"text {n} has a quote of forty characters or more, no. {n} in it") for n in range(0, 400, 2)], "d1 long, d2 long, text string")
    got = Q.containing(quotes, texts)
    assert got.where(F.concat(F.lit("a quote of forty characters or more, no. "), F.col("d1")) == F.col("quote")).count() == 150
    assert "Cartesian" not in got._jdf.queryExecution().toString()


def test_chains_of_any_length_all_get_a_status(spark):
    """Chains of 40 and 1,000, cycles of one to five, ends that aren't there, and chains into cycles."""
    ref = {f"a{n}": f"a{n + 1}" for n in range(40)} | {"a40": None} | {f"b{n}": f"b{n + 1}" for n in range(1000)} | {"b1000": None}
    ref |= {"c0": "c0"} | {f"d{n}": f"d{(n + 1) % 5}" for n in range(5)} | {"e0": "e1", "e1": "nowhere", "f0": "f1", "f1": "d2", "g": None, "h": "a7"}
    rows = spark.createDataFrame([(i, r, f"v{i}") for i, r in ref.items()], "id string, ref string, value string")
    got = {r.id: (r.end, r.value, r.steps, r.status) for r in J.resolve_chains(rows).collect()}
    assert set(got) == set(ref)
    for i in ref:
        at, steps, seen = i, 0, set()
        while at in ref and ref[at] is not None and at not in seen:
            seen.add(at)
            at, steps = ref[at], steps + 1
        if at in seen:
            assert got[i] == (None, None, None, "cycle")
        else:
            assert got[i] == (at, f"v{at}" if at in ref else None, steps, "ok" if at in ref else "missing")
    rows.createOrReplaceTempView("chains_of_a_test")
    assert J.resolve_refs_recursive(spark, "chains_of_a_test").count() == sum(s == "ok" for *_, s in got.values())
    assert J.resolve_chains(rows.limit(0)).collect() == []


LABELS = [
    ("Headlines keep at least two lines and avoid widows.", "sentence", ["normative"]),
    ("Don't stretch the mark; reserved for print.", "sentence", ["conditional", "normative"]),
    ("Max width is 600 px on mobile.", "bullet", ["conditional", "normative", "value"]),
    ("The maximal effect and the minimal one.", "sentence", []),
    ("Corner radius: 4px 8px 4px 8px", "sentence", ["value"]),
    ("Use #ABCD or #12345678 here", "sentence", ["value"]),
    ("font-weight: 700 for titles", "sentence", ["value"]),
    ("Banner at 16 : 9", "sentence", ["value"]),
    ("rgb( 1, 22,255 ) is the accent", "sentence", ["value"]),
    ("Opacity is 80%.", "sentence", ["value"]),
    ("It's 12pxx wide", "sentence", []),
    ("Copy it word-for-word, as written.", "sentence", ["verbatim"]),
    ("Say exactly this", "sentence", ["normative"]),
    ("He said ‘one two three four five six seven eight’ twice", "sentence", ["verbatim"]),
    ("He said “one two three four five six seven” once", "sentence", []),
    ("If it rains, stay", "sentence", []),
    ("When on dark, never invert", "sentence", ["conditional", "normative"]),
    ("## Sizes in px must be 12px", "heading", ["structural", "value"]),
    ("## Colours", "heading", ["noise", "structural"]),
    ("\n", "blank", ["noise"]),
    ("", "blank", ["noise"]),
    ("miné, éonly", "sentence", []),
]


def test_labels(spark):
    rows = spark.createDataFrame([(n, t, k) for n, (t, k, _) in enumerate(LABELS)], "n int, text string, kind string")
    got = {r.n: r.l for r in rows.select("n", M.labels(F.col("kind"), F.col("text")).alias("l")).collect()}
    assert [got[n] for n in range(len(LABELS))] == [want for *_, want in LABELS]


def test_long_quotes_in_any_quotes(spark):
    eight = "one two three four five six seven eight"
    texts = [f'"{eight}"', f"'{eight}'", f"“{eight}”", f"‘{eight}’", f"“{eight}\"", f'"{eight[:-6]}"', f'"a" {eight} "b"', f"it's {eight} don't", None, ""]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    got = [r.q for r in rows.select("n", S.has_long_quote(F.col("text")).alias("q")).orderBy("n").collect()]
    assert got == [True, True, True, True, False, False, False, True, None, False]
