"""Logs of patches against a plain interpreter, and what became of entities."""

import random

import pytest
from pyspark.sql import functions as F

from rulemesh.operators import patches as P

SCHEMA = "seq long, op string, kind string, targets array<string>, keep string, products array<struct<id:string, v:long, tags:array<string>>>"


def plain(state, log):
    """(entities, {seq: reason}, {id: final ids}) by the rules, one patch after another."""
    now = {i: (k, v, tags) for i, k, v, tags in state}
    origin = {i: {i} for i, *_ in state}
    kinds = {i: k for i, k, *_ in state}
    for seq, op, kind, targets, keep, products in sorted(log):
        for p in products if op in ("add", "split") else []:
            kinds.setdefault(p[0], kind)
    out = {}
    for seq, op, kind, targets, keep, products in sorted(log):
        made = [p[0] for p in products]
        named = list(targets) + (made if op != "update" else [])
        reason = None
        if op != "add" and not targets:
            reason = "no_target"
        elif len(set(targets)) < len(targets):
            reason = "targets_repeat"
        elif op in ("update", "split") and len(targets) != 1:
            reason = "one_target"
        elif op == "merge" and len(targets) < 2:
            reason = "two_targets"
        elif op == "merge" and keep not in targets:
            reason = "keep"
        elif op in ("add", "update") and len(products) != 1:
            reason = "one_product"
        elif op == "split" and not products:
            reason = "no_product"
        elif op in ("add", "split") and not all(made):
            reason = "product_id"
        elif op == "split" and len(set(made)) < len(made):
            reason = "products_repeat"
        elif any(i in kinds and kinds[i] != kind for i in named):
            reason = "kind"
        elif op != "add" and not all(t in now for t in targets):
            reason = "missing"
        elif op in ("add", "split") and any(i in now and i not in targets for i in made):
            reason = "exists"
        out[seq] = reason
        if reason:
            continue
        old, from_ = {t: now.get(t) for t in targets}, set().union(*[origin.get(t, set()) for t in targets], set())
        if op == "add":
            now[made[0]], origin[made[0]] = (kind, *products[0][1:]), set()
        elif op == "update":
            _, v, tags = products[0]
            k, v0, t0 = now[targets[0]]
            now[targets[0]] = (k, v0 if v is None else v, t0 if tags is None else tags)
        else:
            for t in targets:
                now.pop(t), origin.pop(t)
            if op == "split":
                for i, v, tags in products:
                    now[i], origin[i] = (kind, v, tags), set(from_)
            if op == "merge":
                order = [keep] + [t for t in targets if t != keep]
                v = next((old[t][1] for t in order if old[t][1] is not None), None)
                lists = [old[t][2] for t in order if old[t][2] is not None]
                now[keep] = (kind, v, list(dict.fromkeys(x for xs in lists for x in xs)) if lists else None)
                origin[keep] = from_
    ends = {i: sorted(e for e in now if i in origin[e]) for i, *_ in state}
    return {i: (k, v, None if t is None else list(t)) for i, (k, v, t) in now.items()}, out, ends


def run(spark, state, log):
    s = spark.createDataFrame(state, "id string, kind string, v long, tags array<string>")
    done = P.apply_log(s, spark.createDataFrame(log, SCHEMA))
    audit = {r.seq: r for r in done.audit.collect()}
    ways = {}
    for r in P.lineage(s, done.moves).collect():
        ways.setdefault(r.id, []).extend([r.final_id] if r.final_id else [])
    return {r.id: (r.kind, r.v, r.tags) for r in done.entities.collect()}, audit, {i: sorted(x) for i, x in ways.items()}


def check(spark, state, log):
    entities, audit, ways = run(spark, state, log)
    want, reasons, ends = plain(state, log)
    assert {s: r.reason for s, r in audit.items()} == reasons
    assert entities == want and ways == ends
    assert all(r.before and r.after and (r.status == "applied") == (r.reason is None) for r in audit.values())
    return audit


def test_random_logs(spark):
    """Fourteen ids, most of them in chains of splits and merges, and what can be wrong with a patch."""
    rng = random.Random(5)
    ids = [f"e{n}" for n in range(14)]
    state = [(i, "rule" if n % 5 else "token", n if n % 3 else None, [f"t{n}"] if n % 2 else None) for n, i in enumerate(ids[:8])]
    log = []
    for seq in range(40):
        op = rng.choice(["add", "update", "update", "delete", "split", "merge", "merge"])
        n = {"add": 0, "update": 1, "delete": rng.choice([1, 1, 2]), "split": 1, "merge": rng.choice([1, 2, 2, 3])}[op]
        targets = rng.choices(ids, k=n) if rng.random() < 0.1 else rng.sample(ids, n)
        made = rng.sample(ids, {"add": 1, "update": 1, "split": rng.choice([0, 1, 2, 2])}.get(op, 0))
        products = [(i if rng.random() < 0.97 else "", rng.choice([None, seq]), rng.choice([None, [f"s{seq}"]])) for i in made]
        keep = rng.choice(targets or ids) if op == "merge" and rng.random() < 0.9 else None
        log.append((seq * 3, op, rng.choice(["rule"] * 9 + ["token"]), targets, keep, products))
    audit = check(spark, state, log)
    assert {r.status for r in audit.values()} == {"applied", "rejected"}


def test_chain_of_renames_and_a_dead_end(spark):
    """Four splits in a row, each of the one before's product; merged at the end, and one branch deleted."""
    state = [("a0", "rule", 1, None), ("b", "rule", 2, ["x"]), ("c", "rule", 3, None)]
    log = [(n, "split", "rule", [f"a{n}"], None, [(f"a{n + 1}", None, [f"s{n}"])]) for n in range(4)]
    log += [(20, "merge", "rule", ["a4", "b"], "b", []), (21, "update", "rule", ["a4"], None, [("a4", 9, None)]), (22, "delete", "rule", ["c"], None, [])]
    entities, audit, ways = run(spark, state, log)
    assert entities == {"b": ("rule", 2, ["x", "s3"])} and ways == {"a0": ["b"], "b": ["b"], "c": []} and audit[21].reason == "missing"


def test_hashes_tell_what_changed(spark):
    state = [("a", "rule", 1, None), ("b", "rule", 2, None)]
    up = lambda seq, v: (seq, "update", "rule", ["a"], None, [("a", v, None)])
    audit = run(spark, state, [up(1, 5), up(2, 5), up(3, 1), (4, "update", "rule", ["z"], None, [("z", 5, None)]), (5, "update", "rule", ["z"], None, [("z", 6, None)])])[1]
    assert audit[1].before == audit[3].after != audit[1].after == audit[2].before == audit[2].after
    assert len({audit[4].after, audit[5].after, audit[4].before}) == 3


@pytest.mark.parametrize("state,log", [([], []), ([("a", "rule", 1, None)], []), ([], [(1, "add", "rule", [], None, [("a", 1, None)])])])
def test_empty_tables(spark, state, log):
    check(spark, state, log)


def test_patches_of_one_entity_need_no_rounds(spark, monkeypatch):
    """However long, such a log is one pass: no round is taken."""
    monkeypatch.setattr(P, "_round", lambda *_: pytest.fail("a round"))
    s = spark.createDataFrame([("a", "rule", 1, None)], "id string, kind string, v long, tags array<string>")
    log = spark.range(500).select(
        F.col("id").alias("seq"), F.element_at(F.array(*map(F.lit, P.OPS[:3])), (F.col("id") % 3 + 1).cast("int")).alias("op"), F.lit("rule").alias("kind"),
        F.when(F.col("id") % 3 > 0, F.array(F.lit("a"))).alias("targets"), F.lit(None).cast("string").alias("keep"),
        F.array(F.struct(F.lit("a").alias("id"), F.col("id").alias("v"), F.lit(None).cast("array<string>").alias("tags"))).alias("products"),
    )
    done = P.apply_log(s, log)
    assert done.audit.where("status = 'rejected'").count() == 1 and [r.v for r in done.entities.collect()] == [499]


def renames(n, entities):
    """A log in which each of some entities is split or merged n times in a row."""
    log = []
    for at in range(n):
        for e in range(entities):
            log.append((at * entities + e, "split", "rule", [f"a{e}_{at}"], None, [(f"a{e}_{at + 1}", at, None), (f"b{e}_{at}", None, None)]))
    return [(f"a{e}_0", "rule", e, [f"t{e}"]) for e in range(entities)], log


def test_small_groups_need_no_rounds(spark, monkeypatch):
    """chains of splits, each of the one before's product, are one pass however long they are."""
    monkeypatch.setattr(P, "_round", lambda *_: pytest.fail("a round"))
    state, log = renames(9, 4)
    log += [(100 + e, "merge", "rule", [f"b{e}_3", f"a{e}_9"], f"b{e}_3", []) for e in range(3)]
    check(spark, state, log)


@pytest.mark.parametrize("bound", [0, 7])
def test_groups_held_or_taken_in_rounds(spark, monkeypatch, bound):
    """Larger groups than the bound go by rounds, with the same audit as those held in a row."""
    rng = random.Random(bound)
    state, log = renames(2, 2)
    state += [("x", "rule", 1, None), ("y", "rule", None, ["y"])]
    up = lambda seq, i: (seq, rng.choice(["update", "add"]), "rule", [i], None, [(i, rng.choice([None, seq]), None)])
    log += [up(20 + n, rng.choice(["x", "y", "a0_2", "b0_0"])) for n in range(6)]
    log = [(s, op, k, [] if op == "add" else t, keep, p) for s, op, k, t, keep, p in log]
    log += [(40, "merge", "rule", ["x", "y"], "y", []), (41, "split", "rule", ["y"], None, [("y", 3, None), ("x", 4, None)]), (42, "delete", "rule", ["x", "b1_0"], None, []), (43, "delete", "rule", ["b1_1"], None, [])]
    log += [(44, "merge", "rule", ["b1_1", "a1_2"], "a1_2", []), (45, "split", "rule", ["y"], None, [("b0_1", 3, None)])]
    held = {r.seq: r for r in P.apply_log(spark.createDataFrame(state, "id string, kind string, v long, tags array<string>"), spark.createDataFrame(log, SCHEMA)).audit.collect()}
    monkeypatch.setattr(P, "WALKED", bound)
    assert check(spark, state, log) == held


def test_components(spark):
    from rulemesh.operators.graph import components

    rng = random.Random(3)
    edges = [(n, n + 1) for n in range(20)] + [(100, n) for n in range(101, 130)] + [(7, 7), (50, 49), (48, 50), (200, 3)] + [tuple(rng.sample(range(300, 340), 2)) for _ in range(25)]
    roots = {n: n for e in edges for n in e}
    for _ in roots:
        for a, b in edges:
            roots[a] = roots[b] = min(roots[a], roots[b])
    found = [tuple(r) for r in components(spark.createDataFrame(edges, "src long, dst long")).select("node", "root").collect()]
    assert sorted(found) == sorted((n, r) for n, r in roots.items() if n != r)
