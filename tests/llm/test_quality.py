import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rulemesh.llm import divergence as D
from rulemesh.llm import gbdt, quality
from rulemesh.llm.stats import CLASSES, FEATURES, TextStats, features

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    "",
    None,
    " \n\t ",
    "one",
    "a b c d e f g h a b c d e f g h",
    "x " * 40,
    "line one\nline one\n\n\n  \nline two\nline one",
    "#*$%&|<> ###&&& é ñ ß z",
    "A1b2 ÜBER " * 30 + "\n" + "tail " * 9,
    "w" * 50_000,
    " ".join(str(i % 97) for i in range(5000)),
]


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_counts_equal_a_plain_reading(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()
    texts = ODD + [r.text for r in rows]
    s = TextStats(pa.array([t or "" for t in texts], pa.large_string()))
    got = list(zip(*(x.tolist() for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words))))
    assert got == [plain(t) for t in texts]


def test_op2_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = D.op2_distribution_divergence(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_references_equal_a_plain_count(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    refs = D.references(docs)
    by = {D.ALL: Counter()}
    for r in docs.collect():
        words = WORD.findall(r.text or "")
        n, *_, repeated = plain(r.text)
        if n < 20 or 100 * repeated > 30 * n:
            continue
        by[D.ALL].update(words)
        by.setdefault(r.lang or D.ALL, Counter()).update(words if r.lang else [])
    for lang, ref in refs.items():
        size = sum(by[lang].values())
        want = {w.encode(): n for w, n in by[lang].items() if n >= D.WORD_SHARE * size}
        assert dict(zip(ref.words.to_pylist(), ref.counts[:-1].astype(int).tolist())) == want
        assert ref.counts.sum() == size


def test_distance_is_a_bounded_metric():
    p = np.array([[1, 0, 0], [0, 5, 5], [0, 0, 0], [2, 2, 0]], float)
    q = np.array([3.0, 0, 0])
    assert D.distance(p, q) == pytest.approx([0, 1, 0, 0.557924], abs=1e-5)


def test_sparse_distance_equals_the_dense_one():
    rng = np.random.default_rng(3)
    p, q = rng.integers(0, 4, (50, 30)) * (rng.random((50, 30)) < 0.3), rng.integers(0, 9, 30).astype(float)
    p[7] = 0
    row, column = np.nonzero(p)
    assert D.sparse_distance(row, column, p[row, column], 50, q) == pytest.approx(D.distance(p.astype(float), q))


def test_many_short_texts_take_little_memory():
    import tracemalloc

    words = pa.array([f"w{i:04d}".encode() for i in range(2000)], pa.large_binary())
    ref = D.Reference(np.ones(len(CLASSES)), words, np.ones(2001))
    s = TextStats(pa.array([f"w{i % 2000:04d}xx" for i in range(10_000)], pa.large_string()))
    tracemalloc.start()
    ref.distances(s, np.arange(10_000))
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
    batch = pa.RecordBatch.from_arrays([pa.array([""] * 10_000)], names=["text"])
    from rulemesh.llm._text import SLICE_ROWS, slices

    assert [b.num_rows for b in slices(batch)] == [SLICE_ROWS, SLICE_ROWS, 10_000 - 2 * SLICE_ROWS]


def test_divergence_of_odd_rows(spark):
    rows = [(i, t, ["en", None, "xx"][i % 3], 1.5) for i, t in enumerate(ODD)] + [(None, "a b", "en", None), (3, "one", "en", 1.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept double")
    got = D.judge(docs, D.references(docs))
    assert got.count() == len(rows)
    empty = docs.limit(0)
    assert D.judge(empty, D.references(empty)).count() == 0


def test_symbol_junk_is_rejected_and_prose_kept(spark):
    rng = np.random.default_rng(0)
    vocabulary = ["the", "of", "and", "to"] * 5 + [f"w{c}{d}" for c in "abcdefghij" for d in "klmnop"]
    prose = [(i, " ".join(rng.choice(vocabulary, 150)), "en") for i in range(60)]
    junk = [(100 + i, " ".join(w + "###$$$&&&" for w in rng.choice(vocabulary, 150)), "en") for i in range(3)]
    docs = spark.createDataFrame(prose + junk, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in D.judge(docs, D.references(docs)).collect() if r.kept}
    assert kept == set(range(60))


def test_a_rare_language_has_its_own_reference(spark):
    rng = np.random.default_rng(1)
    latin = [f"w{c}{d}" for c in "abcdefghij" for d in "klmnop"]
    cyrillic = [f"ш{c}{d}" for c in "абвгдежзик" for d in "лмнопр"]
    prose = [(i, " ".join(rng.choice(latin, 20_000)), "en") for i in range(50)]
    rare = [(100 + i, " ".join(rng.choice(cyrillic, 150)), "ru") for i in range(30)]
    junk = [(200 + i, " ".join(w + "###$$$&&&" for w in rng.choice(cyrillic, 150)), "ru") for i in range(2)]
    alone = [(300, " ".join(rng.choice(cyrillic, 150)), "bg"), (301, " ".join(rng.choice(cyrillic, 150)), None)]
    docs = spark.createDataFrame(prose + rare + junk + alone, "doc_id long, text string, lang string")
    refs = D.references(docs)
    assert set(refs) == {"en", "ru"}  # ru makes 0.5 % of all words
    rows = {r.doc_id: r for r in D.judge(docs, refs).collect()}
    assert {i for i, r in rows.items() if not r.kept} == {200, 201}
    assert all(rows[i].class_distance is None and rows[i].word_distance is None for i in (300, 301))


def test_trees_learn_and_walk_like_single_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    forest = gbdt.fit(x[:1000], y[:1000])
    assert ((forest.predict(x[1000:]) >= 0.5) == y[1000:]).mean() > 0.95

    def one(row):
        out = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            out += v[node - len(f)]
        return out

    assert np.allclose([one(r) for r in x[:50]], forest.margin(x[:50]))


def test_trees_without_rows_or_with_one_class():
    none = gbdt.fit(np.zeros((0, 3)), np.zeros(0))
    assert none.predict(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (gbdt.fit(np.ones((9, 3)), np.ones(9)).predict(np.ones((1, 3))) > 0.9).all()


def test_features_of_odd_texts_are_finite():
    x = features(pa.array([t or "" for t in ODD], pa.large_string()))
    assert x.shape == (len(ODD), len(FEATURES)) and np.isfinite(x).all() and len(CLASSES) == 9


def test_op4_query(spark, sf_dir):
    rows = quality.op4_boosted_tree_quality(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(rows) == docs.count()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([p == q for p, q in held]) > 0.9


def test_held_out_labels_do_not_reach_the_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.withColumn("quality", (1 - labels.quality) * quality.held_out().cast("int") + labels.quality * (1 - quality.held_out().cast("int")))
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert np.array_equal(a.value, b.value) and np.array_equal(a.threshold, b.threshold)


def test_classifier_on_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(ODD)] + [(None, None, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, "x"), (None, 1, "x"), (2, None, "x")], "doc_id long, quality int, text string")
    model = quality.train(docs, labels)
    assert quality.score(docs, model).count() == len(ODD) + 1
    assert quality.train(docs, labels.limit(0)).predict(np.zeros((1, len(FEATURES)))).tolist() == [0.5]
    assert quality.keep_good(docs, model, 0.0).columns == docs.columns
    assert quality.score(docs.limit(0), model).count() == 0
