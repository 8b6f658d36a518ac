"""The transducer against a dictionary and a plain minimisation; ids and decoded texts against the tokenizers library."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from rulemesh.llm import bpe
from rulemesh.llm.packing import tokenizer_path
from rulemesh.llm.transducer import Transducer, compile_words

ODD = [
    None, "", " \t\n", "a", "Hello, WORLD! it's 12345", "<|endoftext|> x<|startoftext|>y", "<|ENDOFTEXT|>", "é É ΣΑΣ ΟΔΟΣ", " 　 x",
    "日本語テキスト", "👩‍👩‍👧 🇩🇪", "\x00\x01\x1c\x1f", "naïve café ﻿", "x" * 5000, "word " * 20_000, "it's I'LL we're'd",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(tokenizer_path()))


def found(t, words):
    column = pa.array(words, pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[: len(words) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return t.find(raw, offs[:-1], offs[1:]).tolist()


def read(words, ids):
    return Transducer(np.frombuffer(compile_words(words, ids), np.uint8))


def test_transducer_numbers_words_in_order():
    rng = np.random.default_rng(1)
    words = sorted({bytes(rng.integers(97, 101, rng.integers(0, 7)).astype(np.uint8)) for _ in range(3000)})
    ids = [[n, n + 1][: n % 3] for n in range(len(words))]
    t = read(words, ids)
    assert t.n_words == len(words) and found(t, words) == list(range(len(words)))
    assert [t.ids[t.begin[n] : t.begin[n + 1]].tolist() for n in range(len(words))] == ids
    others = [w + b"!" for w in words] + [b"zz", "é".encode()]
    assert set(found(t, others)) == {-1}


def test_transducer_is_minimal():
    words = sorted({a + b + c for a in (b"", b"re", b"un") for b in (b"walk", b"talk", b"form", b"load") for c in (b"", b"s", b"ed", b"ing")})
    t = read(words, [[0]] * len(words))
    # states of the smallest automaton: prefixes told apart by the sets of words that end them
    rests = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:n] for n in range(len(w) + 1))}
    assert t.n_states == len(rests)


@pytest.mark.parametrize("words", [[], [b""], [b"", b"a"]])
def test_small_transducers(words, tmp_path):
    (tmp_path / "x").write_bytes(compile_words(words, [[7]] * len(words)))
    t = Transducer.mapped(str(tmp_path / "x"))
    assert found(t, [b"", b"a", b"b"]) == [words.index(w) if w in words else -1 for w in (b"", b"a", b"b")]


def test_unordered_words_raise():
    with pytest.raises(ValueError):
        compile_words([b"b", b"a"], [[1], [2]])


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("share,most", [(bpe.SHARE, bpe.MOST), (1e-2, 3), (1.1, 10)])
def test_odd_texts(spark, tokenizer, share, most):
    """Nulls, empty and long texts, repeated rows, a null id, clashing names; whatever the lexicon holds."""
    rows = [(n, t, n, "z") for n, t in enumerate(ODD)] + [(3, "a", 3, "z"), (None, "no id", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long, id string").repartition(3)
    path = str(tokenizer_path())
    made = bpe.decode(bpe.encode(docs, path, bpe.write_lexicon(docs, path, share=share, most=most)), path)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) for r in made.collect())
    assert got == sorted((-1 if n is None else n, *expected(tokenizer, t)) for n, t, *_ in rows)
    assert {r["n_tokens"] == len(r["ids"]) // 4 for r in made.collect()} == {True}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = str(tokenizer_path())
    assert bpe.decode(bpe.encode(docs, path, bpe.write_lexicon(docs, path)), path).collect() == []


def test_frequent_words_are_the_most_frequent(spark):
    docs = spark.createDataFrame([(1, "a a a b b c"), (2, "a b d d"), (3, None)], "doc_id long, text string").coalesce(1)
    got = [(bytes(r["word"]), r["n"]) for r in bpe.frequent_words(docs, most=2).collect()]
    assert got == [(b"a", 4), (b"b", 3)]


def test_other_decoders_raise():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Pieces(str(public_tokenizers.path("byte_bpe_50k.json")))


def test_whole_table(spark, sf_dir, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = bpe.op13_transducer_bpe(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids, text = expected(tokenizer, texts[r["doc_id"]])
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha, hashlib.sha256(text.encode()).hexdigest())
