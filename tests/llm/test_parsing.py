import hashlib
import random

import numpy as np
import pytest

from rulemesh.llm import parsing as P

M64 = 2**64 - 1


def plain_mix(x):
    x = ((x ^ x >> 31) * 0x7FB5D329728EA185) & M64
    x = ((x ^ x >> 27) * 0x81DADEF4BC2DD44D) & M64
    return x ^ x >> 33


def plain_levels(text):
    """Phrase names of each level, one symbol after another."""
    names, wide = [ord(c) for c in text], 32
    out = [names]
    while len(names) > 1:
        drawn, i = [], 0
        changed = False
        while i < len(names):
            j = i
            while j < len(names) and names[j] == names[i]:
                j += 1
            changed |= j - i > 1
            drawn.append(names[i] if j - i == 1 else plain_mix((names[i] + plain_mix(j - i + (1 << 50))) & M64))
            i = j
        width = 64 if wide == 64 or changed else 32
        label = drawn
        for _ in range(P.ROUNDS):
            mask = (1 << width) - 1
            before = [~label[0] & mask, *label[:-1]]
            place = [((a ^ b) & -(a ^ b)).bit_length() - 1 for a, b in zip(label, before)]
            label = [2 * k + (a >> k & 1) for k, a in zip(place, label)]
            width = 8
        n = len(label)
        starts = [0] + [i for i in range(2, n - 1) if label[i] > label[i - 1] and label[i] >= label[i + 1]]
        names = []
        for a, b in zip(starts, [*starts[1:], n]):
            total = sum(plain_mix(x) * pow(0x9E3779B97F4A7C15, k, 2**64) for k, x in enumerate(drawn[a:b])) & M64
            names.append(plain_mix((total + plain_mix(b - a)) & M64))
        wide = 64
        out.append(names)
    return out


TEXTS = ["", "a", "ab", "aaaa", "abababababab", "the cat sat on the mat " * 9, "é漢字😀" * 20, "x" * 3000, "a" * 50 + "b" * 50]


def random_text(rng, n):
    return "".join(rng.choice("abcdefgh  éß") for _ in range(n))


def test_names_equal_a_plain_parse():
    rng = random.Random(3)
    texts = TEXTS + [random_text(rng, rng.randrange(1, 400)) for _ in range(30)]
    size = np.array(list(map(len, texts)))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    got = [[] for _ in texts]
    for names, owner in P.levels(codes, np.cumsum(size) - size, size):
        for k in np.unique(owner):
            got[k].append(names[owner == k].tolist())
    for text, rows in zip(texts, got):
        assert rows == ([] if not text else plain_levels(text)), text


def test_equal_substrings_share_interior_phrases_at_any_offset():
    rng = random.Random(4)
    common = random_text(rng, 600)
    for _ in range(20):
        texts = [random_text(rng, rng.randrange(0, 90)) + common + random_text(rng, rng.randrange(0, 90)) for _ in range(2)]
        for level in (1, 2, 3):
            a, b = (plain_levels(t)[level] for t in texts)
            shared = set(zip(a, a[1:])) & set(zip(b, b[1:]))
            inside = len(plain_levels(common)[level])
            assert len(shared) >= inside - 14, level


def test_levels_shrink_and_end():
    for text in TEXTS[1:]:
        sizes = list(map(len, plain_levels(text)))
        assert sizes[-1] == 1 and all(b <= (a + 1) // 2 for a, b in zip(sizes, sizes[1:]))


def test_likeness_estimates_jaccard():
    rng = random.Random(5)
    a, b = random_text(rng, 20_000), random_text(rng, 20_000)
    mixed = a[:10_000] + b[:10_000]
    s = P.sketches([a, b, mixed, a, "", ""])
    like = lambda i, j: float(P.likeness(s[i : i + 1], s[j : j + 1])[0])
    assert like(0, 3) == 1 and like(4, 5) == 1 and like(0, 4) == 0
    assert like(0, 1) < 0.1 and 0.15 < like(0, 2) < 0.55


def check(rows, docs):
    """docs: (id, text) in order."""
    texts = [t or "" for _, t in docs]
    following = texts[1:] + texts[:1]
    changed = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, following)]
    a, b, c = P.sketches(texts), P.sketches(changed), P.sketches(following)
    want = sorted(
        (str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, round(float(x), 9), round(float(y), 9))
        for (i, _), t, e, f, g, x, y in zip(docs, texts, changed, P.written(a), P.written(b), P.likeness(a, b), P.likeness(a, c))
    )
    got = sorted(
        (str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
        for r in rows
    )
    assert got == want


def test_query_equals_a_single_pass(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    check(P.op5_locally_consistent_parsing(spark, sf_dir).collect(), docs)


@pytest.mark.parametrize("rows", [[], [(4, "alone in the world")], [(None, "no id")], [(2, "b" * 30), (1, "a" * 31)]])
def test_few_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(P.with_next(docs).collect(), sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(i, random_text(random.Random(i), 50 + 40 * i), True, "k") for i in range(40)]
    rows += [(None, "null id", False, ""), (7, None, None, None), (11, "", True, "x"), (5, rows[5][1], False, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tail boolean, key string").repartition(3)
    found = P.with_next(docs).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    hashes = {r.doc_id: {x.edited_sha256 for x in by[r.doc_id]} for r in found}
    texts = {i: t for i, t, *_ in rows}
    sha = lambda t, u: hashlib.sha256(P.edited(t, u).encode()).hexdigest()
    assert hashes[None] == {sha("null id", texts[0])} and hashes[39] == {sha(texts[39], "null id")}
    assert hashes[20] == {sha(texts[20], texts[21])}
    assert len(by[5]) == len(by[7]) == 2 and len({x.fingerprint for x in by[5]}) == 1


@pytest.mark.parametrize("kind", ["string", "smallint", "decimal(12,2)", "date"])
def test_ids_of_any_order(spark, kind):
    rows = [(i, random_text(random.Random(i), 30 + 7 * i)) for i in range(30)]
    docs = spark.createDataFrame(rows, "n int, text string")
    made = "lpad(cast(n as string), 4, '0')" if kind == "string" else "date_add(date'2020-01-01', n)" if kind == "date" else f"cast(n as {kind})"
    docs = docs.selectExpr(f"{made} AS doc_id", "text")
    ids = {r.text: r.doc_id for r in docs.collect()}
    check(P.with_next(docs).collect(), [(ids[t], t) for _, t in rows])
    assert dict(P.with_next(docs).dtypes)["doc_id"] == kind


def test_one_id_for_all(spark):
    texts = [random_text(random.Random(i), 40) for i in range(50)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert P.in_order(docs).where("NOT tail").select("bucket").distinct().count() == 4  # as many as partitions
    rows = P.with_next(docs).collect()
    assert len(rows) == 50 and len({r.edited_sha256 for r in rows}) == 50


def test_fingerprints_alone(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_chars, r.fingerprint) for r in P.fingerprints(docs).collect()}
    assert got == {i: (len(t or ""), P.written(P.sketches([t or ""]))[0]) for i, t in [*enumerate(TEXTS), (99, None)]}
