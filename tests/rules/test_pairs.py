"""Pairs of rows of one group: all of them, once, and as the work of many tasks."""

import numpy as np
from pyspark.sql import functions as F

from rulemesh.operators import aggregates as A
from rulemesh.operators import consistency as L
from rulemesh.operators import dedupe as D
from rulemesh.operators import guards as G
from rulemesh.operators import joins as C


def shares(found):
    """Rows of each task that has some."""
    return sorted(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect())


def test_similar_pairs_of_copies_and_near_sets(spark):
    words = [f"w{i}" for i in range(10)]
    sets = [words, words[::-1] * 2, words[:8], words[5:] + ["x", "y", "z"], [], [None], [*words[:4], None]] * 3
    rows = [("b" if i % 2 else None, i, w) for i, w in enumerate(sets)] + [("c", 100 + i, w) for i, w in enumerate(sets)]
    found = D.similar_pairs(spark.createDataFrame(rows, "blk string, id int, w array<string>"), "blk", "id", "w", 0.4)

    def alike(a, b):  # a null counts in the sizes but isn't shared
        return len((set(a) & set(b)) - {None}) / (len(set(a)) + len(set(b)) - len((set(a) & set(b)) - {None}) or 1)

    want = {}
    for g, a, x in rows:
        for h, b, y in rows:
            if g == h and g is not None and a < b and alike(x, y) >= 0.4 and (set(x) & set(y)) - {None}:
                want[a, b] = round(alike(x, y), 9)
    assert {(r[0], r[1]): round(r[2], 9) for r in found.collect()} == want and found.count() == len(want)


def test_similar_pairs_of_many_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(D, "MET_ITEMS", 40)
    monkeypatch.setattr(D, "MET_ROWS", 8)
    sets = {i: [f"w{(i * k) % 23}" for k in range(1 + i % 17)] for i in range(120)}
    found = D.similar_pairs(spark.createDataFrame([("b", i, w) for i, w in sets.items()], "blk string, id int, w array<string>"), "blk", "id", "w", 0.4)
    want = {(a, b): len(x & y) / len(x | y) for a, x in ((i, set(w)) for i, w in sets.items()) for b, y in ((i, set(w)) for i, w in sets.items()) if a < b}
    got = found.collect()
    assert {(r[0], r[1]): r[2] for r in got} == {k: v for k, v in want.items() if v >= 0.4} and len({(r[0], r[1]) for r in got}) == len(got)


def test_shared_words_of_common_and_rare_ones():
    words = [sorted({f"w{(i * k) % 97}" for k in range(i % 60)} | {f"own{i // 3}", "all"}) for i in range(1500)]
    left, right = np.arange(0, 1500, 1), np.arange(200, 1400, 7)
    for k, shared in D._shared(words, left, right):
        for at in range(0, len(shared), 37):
            assert shared[at].tolist() == [len(set(words[left[k + at]]) & set(words[r])) for r in right]


def test_similar_pairs_of_many_copies_are_many_tasks(spark):
    rows = spark.range(2100).select(F.lit("b").alias("blk"), "id", F.split(F.lit("one two three"), " ").alias("w"))
    found = shares(D.similar_pairs(rows, "blk", "id", "w", 0.4))
    assert sum(found) == 2100 * 2099 // 2 and found[-1] < 0.8 * sum(found)


def test_pairs_within_small_chunks_are_all_pairs(spark):
    rows = spark.createDataFrame([(g, i) for g in ("a", "b", None) for i in range(23)], "g string, id int")
    found = sorted((r.g, r.a_id, r.b_id) for r in C.pairs_within(rows, ["g"], "id", F.col("a_id") < F.col("b_id"), 4).collect())
    assert found == [(g, a, b) for g in ("a", "b") for a in range(23) for b in range(a + 1, 23)]
def test_verbatim_clashes_of_a_hot_trigger_are_many_tasks(spark):
    rows = spark.range(0, 2100, 1, 1).selectExpr("id", "CAST(nullif(id, id) AS INT) AS p", "id DIV 10000 AS tr", "CAST(id % 3 AS STRING) AS f")
    found = shares(L.verbatim_clashes(rows, "id", "p", "tr", "f"))
    assert sum(found) == 3 * 700 * 700 and found[-1] < 0.8 * sum(found)


def guarded(spark, n):
    guard = F.create_map(F.lit("theme"), F.array(F.concat(F.lit("t"), (F.col("id") % 2).cast("string"))))
    return spark.range(0, n, 1, 1).select("id", F.expr("id DIV 10000").alias("g"), guard.alias("guard"), F.col("id").cast("string").alias("value"))


def test_guards_of_a_hot_group_are_many_tasks(spark):
    found = G.joint(guarded(spark, 2100), "g", "id", "guard", G.satisfiable, "ok")
    split = shares(found)
    assert sum(split) == 2100 * 2099 // 2 and split[-1] < 0.8 * sum(split)
    assert found.where("ok <> (a % 2 = b % 2) OR a >= b").count() == 0


def test_conjunctions_are_made_once_for_two_guards(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def both(a, b):
        asked.add(1)
        return a["theme"][0] if a == b else None

    found = G.joint(guarded(spark, 400), "g", "id", "guard", lambda a, b: both(a, b), "c")
    assert found.count() == 2 * 200 * 199 // 2 and asked.value <= 8


def test_conflicts_of_a_hot_path_are_many_tasks(spark):
    rows = guarded(spark, 2100).selectExpr("concat('p', id DIV 10000) AS element_path", "id AS source_id", "value", "guard", "IF(id < 1050, 'hard_constraint', 'soft') AS hardness", "struct(id % 5 AS r) AS spec")
    found = L.pair_conflicts(rows)
    split = shares(found)
    kinds = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    ids = range(2100)
    alike = sum(1 for a in ids for b in range(a + 2, 2100, 2) if not (a < 1050 and b < 1050) and (a - b) % 5 == 0)
    assert kinds == {"hard_hard": 2 * 525 * 524 // 2, "equal_specificity": alike} and split[-1] < 0.8 * sum(split)


def test_proposals_of_a_hot_group_are_many_tasks(spark):
    rows = spark.range(0, 2100, 1, 1).selectExpr("id", "IF(id < 2090, 1, NULL) AS g", "concat('p', id % 10) AS place", "id % 3 AS precedence")
    found = L.precedence_proposals(rows, "g")
    split = shares(found)
    assert sum(split) == 2090 * 2089 // 2 and split[-1] < 0.8 * sum(split)
    wrong = "a_id >= b_id OR winner <> IF(b_id % 10 > a_id % 10, b_id, a_id) OR precedence <> greatest(a_id % 3, b_id % 3) + 1"
    assert found.where(wrong).count() == 0


def test_variants_of_a_hot_token_are_many_tasks(spark):
    rows = guarded(spark, 2100).select(F.col("g").alias("token_id"), F.col("id").alias("at"), F.col("guard").alias("when"), "value")
    found = shares(L.variant_conflicts(rows))
    assert sum(found) == 2 * 1050 * 1049 // 2 and found[-1] < 0.8 * sum(found)


def test_first_siblings_are_found_without_a_sort_by_row(spark):
    rows = spark.createDataFrame([(g, i) for g, n in (("a", 3), ("b", 4), ("c", 5), ("d", 9), (None, 4)) for i in range(n * 10, n * 11)], "g string, id int")
    found = C.siblings(rows, "id", "g", 3)
    groups = [range(n * 10, n * 11) for n in (3, 4, 5, 9)]
    assert sorted(map(tuple, found.collect())) == sorted((a, b) for ids in groups for a in ids for b in [x for x in ids if x != a][:3])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [row_number") == 1


def moved(spark, found):
    """Rows that ``found``'s tasks write for others."""
    jobs = spark.sparkContext
    bus, store = jobs._jsc.sc().listenerBus(), jobs._jsc.sc().statusStore()
    jobs.setJobGroup(group := f"moved-{id(found)}", "")
    found.write.format("noop").mode("overwrite").save()
    jobs.setLocalProperty("spark.jobGroup.id", None)
    bus.waitUntilEmpty()
    status = jobs.statusTracker()
    stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds if status.getStageInfo(s)}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def shared_items(sets):
    return {(a, b): (len(x & y), round(len(x & y) / len(x | y), 9)) for a, x in sets.items() for b, y in sets.items() if a < b and (x & y) - {None}}


def test_jaccard_pairs_by_chunks_and_of_owners_of_many_items(spark):
    sets = {a: {i for i in range(30) if (i * a) % 7 < 3} | {100 + a // 9} for a in range(40)} | {40: {None, 3}, 41: {5}}
    rows = [(a, i) for a, items in sets.items() for i in items] * 2 + [(None, 3), (None, None)]
    table = spark.createDataFrame(rows, "o long, i long")
    want = {(a, b): (n - (None in sets[a] & sets[b]), j) for (a, b), (n, j) in shared_items(sets).items()}
    for chunk, most in ((1024, 1 << 16), (4, 1 << 16), (4, 12), (1, 0)):
        found = A.jaccard_pairs(table, "o", "i", chunk, most).collect()
        assert {(r["a"], r["b"]): (r["shared"], round(r["jaccard"], 9)) for r in found} == want and len(found) == len(want)


def test_jaccard_pairs_are_counted_where_they_are_made(spark):
    table = spark.range(0, 4500, 1, 3).selectExpr("id AS o", "id DIV 45 AS i")
    found = A.jaccard_pairs(table, "o", "i")
    assert found.count() == 100 * 45 * 44 // 2
    assert moved(spark, found) < 100 * 45 * 44 // 2 // 2


def test_rows_of_kinds_are_moved_as_lists(spark):
    rows = guarded(spark, 6000).selectExpr("concat('p', id DIV 10000) AS element_path", "id AS source_id", "CAST(id DIV 3000 AS STRING) AS value", "guard", "'soft' AS hardness", "struct(id % 20 AS r) AS spec")
    found = L.pair_conflicts(rows)
    assert found.count() == found.distinct().count() == 20 * 150 * 150
    assert moved(spark, found) < 4 * 6000


def test_jaccard_pairs_move_an_item_once_for_a_block_of_owners(spark):
    table = spark.range(0, 40000, 1, 3).selectExpr("id DIV 1000 * 1000 + id % 100 AS o", "id DIV 1000 * 1000 + id DIV 100 % 10 + id % 2 * 10 AS i")
    found = A.jaccard_pairs(table, "o", "i")
    assert found.count() == 40 * 2 * 50 * 49 // 2 and found.where("shared <> 10 OR jaccard <> 1").count() == 0
    assert moved(spark, found) < 2.2 * 40000


def test_longest_prefix_of_copies_is_looked_up_once(spark):
    rows = [(n, text) for n, text in enumerate(["abcdef", "abcxyz", "ab", "a", "", None, "zz", "ABC"] * 500)]
    rows = spark.createDataFrame([*rows, (None, "abcdef"), (None, "abcdef")], "n int, t string").coalesce(1)
    owners = lambda *names: spark.createDataFrame([(x,) for x in names], "o string")
    want = {"abcdef": "abcde", "abcxyz": "abc", "ab": "ab", "a": None, "": None, None: None, "zz": None, "ABC": None}
    found = C.longest_prefix(rows, F.col("t"), owners("abcde", "abc", "ab", "b", "abcdef", None, "ab"), "o", 5)
    assert found.count() == 4002 and {(r.t, r.owner) for r in found.collect()} == set(want.items())
    assert moved(spark, found) < 1.5 * 4002
    every = C.longest_prefix(rows, F.col("t"), owners("", "ab"), "o", 5)
    assert {(r.t, r.owner) for r in every.collect()} == {(t, None if t is None else "ab" if t.startswith("ab") else "") for t in want}
