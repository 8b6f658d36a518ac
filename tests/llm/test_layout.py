"""Sharding, packing and mixing."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rulemesh.llm import mixing as M
from rulemesh.llm import packing as P
from rulemesh.llm import sharding as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (5, "plain words here", "b", 1),
    (5, "plain words here", "b", 1),
    (None, "no id", None, 2),
    (6, None, "a", 3),
    (7, "", None, 4),
    (8, "é ñ ß 漢字 " * 3, "", 5),
    (9, "long text of many words. " * 3000, "a", 6),
    (10, "It's <|endoftext|> don't 42 -- A.B. ﬁ İ Σας é ́x", "c", 7),
    (11, " nb sp\u0085x", "c", 8),
]
SCHEMA = "doc_id long, text string, source string, size int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


# -------------------------------------------------------------------- sharding


def plain_shards(rows, shards):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode())))
    sizes = [len((t or "").encode()) + 16 for _, t in rows]
    out, before, slots = [], 0, Counter()
    for (i, t), size in zip(rows, sizes):
        shard = (2 * before + size) * shards // (2 * sum(sizes))
        out.append((i, size, zlib.crc32((t or "").encode()), shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def test_shards_of_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = S.op8_prefix_sum_shards(spark, sf_dir).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in rows) == sorted(plain_shards(docs, 40))
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_shards_of_odd_rows(spark, odd):
    got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in S.shard(odd, 3).collect()]
    assert sorted(got, key=key) == sorted(plain_shards([r[:2] for r in ODD], 3), key=key)
    assert S.shard(odd.limit(0)).count() == 0


# --------------------------------------------------------------------- packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=150), st.integers(60, 90))
def test_plan_places_every_piece_once(lengths, capacity):
    plan = P.Plan(Counter(lengths), capacity)
    length = np.array(lengths, np.int64)
    bins, offset = plan.find(length, P._occurrence(length)) if lengths else (length, length)
    held = defaultdict(list)
    for b, o, n in zip(bins.tolist(), offset.tolist(), lengths):
        held[b].append((o, n))
    assert len(held) == plan.n_bins
    for rows in held.values():
        end = 0
        for o, n in sorted(rows):
            assert o == end
            end += n
        assert end <= capacity
        assert sum(3 * n > capacity for _, n in rows) <= 2
    if lengths:
        large = [n for n in lengths if 3 * n > capacity]
        # first-fit decreasing needs no fewer bins than this, up to its own bound
        assert plan.n_bins <= max(len(large), math.ceil(11 / 9 * sum(lengths) / capacity) + 1) + 1


def most_pairs(lengths, capacity):
    """Bins for large pieces: smallest with largest where they fit."""
    lengths, bins = sorted(lengths), 0
    i, j = 0, len(lengths) - 1
    while i <= j:
        if i < j and lengths[i] + lengths[j] <= capacity:
            i += 1
        j -= 1
        bins += 1
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(34, 100), max_size=80))
def test_large_pieces_are_matched_as_well_as_can_be(lengths):
    assert P.Plan(Counter(lengths), 100).n_bins == most_pairs(lengths, 100)


def test_plan_rejects_what_cannot_fit():
    with pytest.raises(ValueError):
        P.Plan({101: 1}, 100)


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(P.tokenizer_path()))
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_tokenizer(spark, sf_dir, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [t for _, t, *_ in ODD]
    monkeypatch.setattr(P, "CACHE_WORDS", 500)
    words = P.WordIds(str(P.tokenizer_path()))
    for _ in range(2):
        ids, offs = P.token_ids(pa.array([t or "" for t in texts], pa.large_string()), words)
        assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == whole_ids(texts)


def check_packing(rows, docs):
    want = {}
    for (i, _), ids in zip(docs, whole_ids([t for _, t in docs])):
        want.setdefault(i, []).append(ids)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for i, found in by_doc.items():
        exp = []
        for ids in want[i]:
            for k, a in enumerate(range(0, len(ids), 2048)):
                part = ids[a : a + 2048]
                exp.append((k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
        assert sorted(found) == sorted(exp)
    for found in by_sequence.values():
        end = 0
        for o, n in sorted(found):
            assert o == end
            end += n
        assert end <= 2048
    return len(by_sequence), sum(n for f in by_sequence.values() for _, n in f)


def test_packing_of_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    bins, tokens = check_packing(P.op9_best_fit_packing(spark, sf_dir).collect(), docs)
    assert bins <= tokens / 2048 * 1.02 + 1


def test_packing_of_odd_rows(spark, odd):
    rows = P.pack(odd.repartition(3), str(P.tokenizer_path())).collect()
    check_packing(rows, [r[:2] for r in ODD])
    assert P.pack(odd.limit(0), str(P.tokenizer_path())).count() == 0


# ---------------------------------------------------------------------- mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Share by weight, again and again, until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, whole = budget - sum(fixed.values()), sum(weight[s] for s in free)
        now = {s: left * weight[s] / whole for s in free}
        over = [s for s in free if now[s] > most * sizes[s]]
        if not over:
            return fixed | now
        fixed |= {s: most * sizes[s] for s in over}


def check_mix(rows, docs):
    size = {k: len(WORD.findall(t or "")) for k, (_, t, _) in enumerate(docs)}
    sources = defaultdict(int)
    for k, (_, _, s) in enumerate(docs):
        sources[s] += size[k]
    aims = plain_targets(sources)
    assert Counter((r.doc_id, r["size"], r.source_size) for r in rows) == Counter(
        (i, size[k], sources[s]) for k, (i, _, s) in enumerate(docs)
    )
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert {round(r.target, 6) for r in rows} == {round(t, 6) for t in aims.values()}
    by = defaultdict(int)
    for r in rows:
        by[round(r.target, 6), r.source_size] += r.taken
    for (target, _), words in by.items():
        assert words == pytest.approx(math.floor(target), abs=1)


def test_mix_of_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = M.op10_low_discrepancy_mix(spark, sf_dir).collect()
    check_mix(rows, docs)
    assert sorted(rows) == sorted(M.op10_low_discrepancy_mix(spark, sf_dir).collect())


def test_mix_of_odd_rows(spark, odd):
    docs = [r[:3] for r in ODD]
    found = M.taken(*M.mix(odd, block=16)).withColumnRenamed("id", "doc_id").collect()
    size = {s: sum(len(WORD.findall(t or "")) for _, t, x in docs if x == s) for *_, s in docs}
    aims = plain_targets(size)
    assert len(found) == len(docs)
    assert sorted({r.target for r in found}) == pytest.approx(sorted(set(aims.values())))
    assert all(0 <= r.taken <= 2 * r["size"] for r in found)
    mixed, rows = M.mix(odd.limit(0))
    assert mixed.count() == 0 and M.taken(mixed, rows).count() == 0


def test_mix_equals_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = M.op10_low_discrepancy_mix(spark, sf_dir)
    want = con.sql(M.OP10_SQL)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


def test_slots_say_where_words_stand(spark, odd):
    mixed, rows = M.mix(odd, block=16)
    parts, by = mixed.collect(), defaultdict(list)
    for r in parts:
        by[r.number, r.start].append(r.slot)
    for r in M.taken(mixed, rows).collect():
        slots = by.get((r.number, r.start), []) if r["size"] else []
        assert (r.n_parts, r.first_slot, r.last_slot) == (len(slots), min(slots, default=None), max(slots, default=None))


def test_whole_documents_stand_in_the_order_of_the_schedule(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = M.whole_documents(docs, block=128).collect()
    size = {r.doc_id: len(WORD.findall(r.text)) for r in found}
    totals = Counter()
    for r in found:
        totals[r.source] += size[r.doc_id]
    whole, seen, before = sum(totals.values()), Counter(), 0
    for r in found:
        seen[r.source] += size[r.doc_id]
        before += size[r.doc_id]
        for source, n in totals.items():
            # at each place each source has its share, give or take a few documents
            assert abs(seen[source] - before * n / whole) < 3000 + 3 * max(size.values()), (source, before)
    runs = sum(a.source != b.source for a, b in zip(found, found[1:]))
    assert runs > 0.5 * len(found)


def test_whole_documents_of_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a b c d", "s", 1)] * 7 + [(1, "a b c e", "s", 2), (None, "x y z", None, 3), (None, "x y z", None, 3), (2, "", "s", 4), (3, None, "t", 5), (4, "w " * 5000, "t", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies int").withColumn("_place", M.F.col("_copies"))
    for copies in (1024, 2):
        M.COPIES, kept = copies, M.COPIES
        found = M.whole_documents(docs, block=3)
        got = Counter(map(tuple, found.collect()))
        M.COPIES = kept
        assert found.columns == docs.columns
        given_ = Counter((*r, r[-1]) for r in rows)
        assert all(n <= 2 * given_[r] for r, n in got.items()) and not any(r[0] in (2, 3) for r in got)
        assert got[(1, "a b c d", "s", 1, 1)] == 14 and got[(1, "a b c e", "s", 2, 2)] == 2 and got[(None, "x y z", None, 3, 3)] == 4
    assert M.whole_documents(docs.limit(0)).count() == 0 and M.whole_documents(docs.where("doc_id = 2")).count() == 0


def test_large_schedules_do_not_overflow(spark):
    big = 4_000_000_000  # blocks: a product of two of them is more than a long holds
    step = M.golden_step(big)
    back = pow(step, -1, big)
    point = spark.range(1).selectExpr(f"cast({big - 7} as decimal(19,0)) as p")
    assert point.select(M.F.pmod(point.p * M.F.lit(back).cast("decimal(19,0)"), M.F.lit(big).cast("decimal(19,0)")).cast("long")).first()[0] == (big - 7) * back % big


def test_slots_are_a_permutation_and_evenly_spread(spark):
    sources = spark.createDataFrame([(0, 9000.0), (1, 3000.0), (2, 0.0), (3, 1000.5)], "number int, target double")
    rows = sorted(M.schedule(sources, 10).collect())
    assert [r.slot for r in rows] == list(range(900 + 300 + 100))
    seen = Counter()
    for n, r in enumerate(rows, 1):
        assert r.block == seen[r.number]
        seen[r.number] += 1
        for k, share in ((0, 900), (1, 300), (3, 100)):
            assert abs(seen[k] - n * share / 1300) < 4


def test_targets_of_limited_sources(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 3, None: 40, "": 0, "Z": 77}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in M.targets(rows).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_golden_step_is_prime_to_its_modulus():
    for n in range(1, 300):
        assert math.gcd(M.golden_step(n), n) == 1


def test_marks_are_md5_of_seed_and_id(spark):
    _, rows = M.mix(spark.createDataFrame([(i, "w " * (i + 1), "s", 1) for i in range(40)], SCHEMA))
    order = [r.id for r in sorted(rows.collect(), key=lambda r: r.start)]
    assert order == sorted(range(40), key=lambda i: hashlib.md5(f"mix-1:{i}".encode()).hexdigest())
