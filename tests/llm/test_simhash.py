import re

import numpy as np
import pyarrow as pa
import xxhash

from rulemesh.llm import simhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (id, fingerprint); all pairs."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f, least.get(find(f))) for i, f in rows]


TEXTS = [
    "The quick  brown\tfox jumps over the lazy dog",
    "the quick brown fox jumps over the lazy dog",
    "one two",
    "",
    None,
    " \n ",
    "é" * 50 + " ß ñ x",
    "a b c d " * 5000,
    "Word " * 3,
    "x" * 100_000,
    "a b c d e f g",
]


def test_fingerprints_of_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint % 2**64 for r in S.fingerprints(docs).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}


def test_xxh64_equals_the_library():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 3000, dtype=np.uint8)
    starts = rng.integers(0, 2900, 500)
    ends = starts + rng.integers(0, 100, 500)
    from rulemesh.llm._text import xxh64

    assert xxh64(data, starts, ends, 42).tolist() == [
        xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(starts, ends)
    ]


def test_trie_join_finds_all_links(monkeypatch):
    monkeypatch.setattr(S, "FRONTIER", 64)
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    bits = []
    for c in centres:
        for _ in range(60):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            bits.append(int(c) ^ sum(1 << int(b) for b in flips))
    bits = np.array(sorted(set(bits)), np.uint64)
    for groups in (1, 3):
        group = np.sort(rng.integers(0, groups, len(bits)))
        rows = np.lexsort((bits, group))
        label = S.Trie(group[rows], bits[rows], 4).join()
        a, b = np.nonzero(
            (np.bitwise_count(bits[rows][:, None] ^ bits[rows][None, :]) <= 4)
            & (group[rows][:, None] == group[rows][None, :])
        )
        assert np.array_equal(label, S.components(len(bits), a, b))


def cluster_rows(n, seed):
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 2**63, 8, dtype=np.uint64)]
    rows = []
    for i in range(n):
        flips = rng.choice(64, rng.integers(0, 5), replace=False)
        rows.append((i, base[rng.integers(0, 8)] ^ sum(1 << int(b) for b in flips)))
    return rows


def test_components_with_and_without_hot_keys(spark):
    rows = cluster_rows(300, 3)
    signed = [(i, f - 2**64 if f >= 2**63 else f) for i, f in rows]
    distinct = spark.createDataFrame(signed, "doc_id long, fingerprint long").groupBy("fingerprint").agg({"doc_id": "min"})
    distinct = distinct.select("fingerprint").cache()
    want = {}
    for _, f, c in plain_components(rows):
        want.setdefault(c, set()).add(f)
    for hot in (10, 50_000):
        roots = {r.node % 2**64: r.root % 2**64 for r in S.star_components(S.links(distinct, 4, hot)).collect()}
        got = {}
        for f in {f for _, f in rows}:
            got.setdefault(roots.get(f, f), set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs]))
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in S.op7_simhash_trie_join(spark, sf_dir).collect())
    assert got == want


def test_nulls_ties_empty_table_and_clashing_columns(spark):
    rows = [(3, "same text here now ok", 1, "x"), (1, "same text here now ok", 2, "y"), (None, "same text here now ok", 3, None)]
    rows += [(1, "same text here now ok", 2, "y"), (7, None, None, None), (8, "", 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint long, component_id string")
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect())
    assert [(i, c) for _, i, c in got] == [(1, 1), (1, 1), (3, 1), (7, 7), (8, 7), (None, 1)]
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7]
    empty = docs.limit(0)
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(empty).count() == 0


def test_one_row_stays_of_rows_that_share_ids_or_are_equal(spark):
    x, y = "some words of a text that repeat here", "an altogether other one with its own few words"
    rows = [(7, x, 1), (7, x, 1), (None, y, 2), (None, y, 2), (5, y, 3), (None, x, 2), (9, "third text stands alone", 4), (None, "fourth one", 5), (None, "fourth one", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept int").withColumnRenamed("_kept", "_text_hash")
    docs = docs.withColumn("_place", docs.doc_id).withColumn("keys", docs.text)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect())
    assert got == [(False, 5, y), (False, 7, x), (False, 9, "third text stands alone"), (True, 0, "fourth one")]


def plain_stream(x, k):
    x = (x + (2 * k + 1) * 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def plain_shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def plain_wide(text):
    """Fingerprint as one number, and keys."""
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in plain_shingles(text)]
    out = 0
    for k in range(S.WIDE_WORDS):
        mixed = [plain_stream(h, k) for h in hashes]
        out = out << 64 | sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mixed) > len(mixed))
    keys = []
    for band in range(S.BANDS):
        key = band
        for row in range(S.BAND_ROWS):
            low = min((plain_stream(h, S.WIDE_WORDS + band * S.BAND_ROWS + row) for h in hashes), default=0)
            key = plain_stream(key ^ low, row)
        keys.append(key)
    return out, keys


def plain_kept(texts):
    """texts: id to text; the smallest id of each component, linked where the Jaccard similarity of shingles is 0.8 or more."""
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in ids}


def test_wide_fingerprints_equal_a_plain_version():
    prints, keys = S.wide_simhash(pa.array([t or "" for t in TEXTS], pa.large_string()))
    for text, words, k in zip(TEXTS, prints.tolist(), keys.tolist()):
        want, want_keys = plain_wide(text)
        assert int("".join(f"{w:016x}" for w in words), 16) == want and k == want_keys


def test_keep_one_equals_brute_force_and_similar_texts_meet(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng = np.random.default_rng(8)
    for n, i in enumerate(sorted(texts)[:60]):  # near copies: one word in forty, so that most sets have a Jaccard similarity of 0.8
        words = (texts[i] or "").split(" ")
        texts[10**6 + n] = " ".join("changed" if rng.random() < 0.02 else w for w in words)
    more = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = plain_kept(texts)
    for settings in ({}, {"hot": 4}, {"hot_bytes": 2000}):
        assert {r.doc_id for r in S.keep_one(more, **settings).collect()} == want


def edited(words, share, rng):
    """``words`` with so many of them changed, in places, that the sets of shingles have about this similarity."""
    words, left = list(words), round((1 - share) / (1 + share) * (len(words) - 4))
    at = rng.integers(0, len(words) - 5)
    while left > 0:  # a change spoils the five shingles over it
        words[at] = "changed" + str(rng.integers(10**9))
        at, left = (at + 5 + int(rng.integers(0, 3))) % len(words), left - 5
    return words


def test_links_from_a_similarity_of_four_fifths_on_and_none_below(spark):
    """Pairs planted on both sides of 0.8, between 0.70 and 0.90: recall of at least 0.99 (by keys) and no false link."""
    rng = np.random.default_rng(21)
    texts, pairs = {}, []
    for n in range(600):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 200))]
        texts[n], texts[1000 + n] = " ".join(words), " ".join(edited(words, rng.uniform(0.72, 0.9), rng))
        pairs.append((n, 1000 + n))
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    alike = {j for i, j in pairs if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    near = {j for i, j in pairs if j not in alike and 0.7 <= len(sets[i] & sets[j]) / len(sets[i] | sets[j])}
    assert len(alike) > 150 and len(near) > 150
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in S.keep_one(docs).collect()}
    assert len(alike - kept) >= 0.99 * len(alike) and set(texts) - kept <= alike


def test_sets_are_compared_whole():
    texts = ["a b c d e f g h i j k l m n", "a b c d e f g h i j k l m x", "", "a b", "a b", "a b c d e f g h i j k l m n o", "x " * 9]
    sets = S.ShingleSets(pa.array(texts, pa.large_string()))
    i, j = (np.array(x) for x in zip(*[(i, j) for i in range(7) for j in range(7)]))
    own = [plain_shingles(t) for t in texts]
    want = [not (own[a] | own[b]) or 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]) for a, b in zip(i, j)]
    assert sets.similar(i, j).tolist() == want


def test_rekeyed_fingerprints_meet_again(spark):
    rng = np.random.default_rng(9)
    rows, pairs = [], []
    for _ in range(150):
        a = int(rng.integers(0, 2**63))
        b = a ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False))
        pairs.append((a, b - 2**64 if b >= 2**63 else b))
        rows += pairs[-1]
    distinct = spark.createDataFrame([(x,) for x in sorted(set(rows))], "fingerprint long")
    again = S._rekeyed(S._keyed(distinct)).groupBy("key").agg({"fingerprint": "collect_set"}).collect()
    met = {frozenset((a, b)) for r in again for a in r[1] for b in r[1] if a != b}
    assert all(frozenset(p) in met for p in pairs)


def test_majority_over_many_hashes():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    first = np.array([0, 0, 700, 701, 2000])
    want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[i:j]) > j - i) for i, j in zip(first, first[1:])]
    assert S.majority(hashes, first).tolist() == want


def test_simhash_of_no_rows():
    assert len(S.simhash(pa.array([], pa.large_string()))) == 0
