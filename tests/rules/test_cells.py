"""Cells of equivalent axis values against evaluating every context and every value."""

import random
from itertools import product

import pytest

from rulemesh.operators import cells as X
from rulemesh.operators.guards import EMAIL_AXES

SCHEMA = "element_path string, source_id string, source_kind string, value string, guard map<string, array<string>>, hardness string, selector_rank int, precedence int, scope string"
HARD = {"hard_constraint": 3, "strong_default": 2, "soft_guidance": 1}
FEW = [("audience", "hcp"), ("audience", "patient"), ("section", "hero"), ("section", "footer"), ("theme", "none")]


def binding(i, guard, hardness="strong_default", value=None, precedence=0, path="p"):
    return (path, i, "rule_binding", value or i, guard, hardness, 0, precedence, "brand")


def plain(rows, domains, combinations):
    """({(path, active, winners)}, {id: shadowed by}) over all contexts and cells."""
    known = {}
    for axis, value in domains:
        known.setdefault(axis, set()).add(value)
    for r in rows:
        for axis, values in (r[4] or {}).items():
            if axis not in EMAIL_AXES and not axis.startswith("tag:"):
                known.setdefault(axis, set()).update(values)
    axes = sorted(known)
    found, live, beaten = set(), set(), {}
    for path in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == path]
        for tags in combinations:
            for values in product(*[sorted(known[a]) for a in axes]):
                at = dict(zip(axes, values))
                holds = lambda r: all((("present" if a[4:] in tags else "absent") if a.startswith("tag:") else at.get(a)) in v for a, v in (r[4] or {}).items())  # noqa: B023, E731
                active = [r for r in own if holds(r)]
                if not active:
                    continue
                spec = lambda r: (HARD[r[5]], len(r[4] or {}), r[7])
                top = max(map(spec, active))
                tied = [r for r in active if spec(r) == top]
                wins = tied if len({r[3] for r in tied}) > 1 else [max(tied, key=lambda r: r[1])]
                names = {r[1] for r in wins}
                found.add((path, frozenset(r[1] for r in active), frozenset(names)))
                live |= names
                for r in active:
                    if r[1] not in names:
                        beaten.setdefault(r[1], set()).update(names)
    return found, {i: sorted(w) for i, w in beaten.items() if i not in live}


def run(spark, rows, domains, combinations):
    bindings = X.numbered(spark.createDataFrame(rows, SCHEMA))
    members = X.cells(bindings, spark.createDataFrame(domains, "axis string, value string"), spark.createDataFrame([(c,) for c in combinations], "tags array<string>"))
    named = {r.bid: r.source_id for r in bindings.collect()}
    active = {}
    for r in members.collect():
        active.setdefault((r.path, r.cell), set()).add(named[r.bid])
    wins = {(r.element_path, r.cell): frozenset(r.winners) for r in X.cell_winners(bindings, members).collect()}
    return {(p, frozenset(active[p, c]), wins[p, c]) for p, c in active}, {r.source_id: r.shadowed_by for r in X.never_winning(bindings, members).collect()}, active


def check(spark, rows, domains=FEW, combinations=([],)):
    found, beaten, active = run(spark, rows, domains, combinations)
    assert (found, beaten) == plain(rows, domains, combinations)
    assert len(active) == len(found)  # each set once
    return found, beaten


def test_hard_beats_soft_everywhere(spark):
    assert check(spark, [binding("soft", None, "soft_guidance"), binding("hard", {}, "hard_constraint")])[1] == {"soft": ["hard"]}


def test_disjoint_and_wider_guards_are_not_shadowed(spark):
    rows = [binding("d", {"breakpoint": ["desktop"]}, "hard_constraint"), binding("m", {"breakpoint": ["mobile"]}, "soft_guidance")]
    rows += [binding("dense", {"density": ["dense"]}, "hard_constraint", path="q"), binding("both", {"density": ["dense", "sparse"]}, "soft_guidance", path="q")]
    assert check(spark, rows)[1] == {}


def test_values_outside_the_domain_and_contradictions(spark):
    rows = [binding("never", {"section": []}), binding("nobody", {"audience": ["vet"]}), binding("hcp", {"audience": ["hcp"]}, "soft_guidance"), binding("all", {})]
    found, beaten = check(spark, rows)
    assert beaten == {"hcp": ["all"]} and not any({"never", "nobody"} & a for _, a, _ in found)


def test_tags_occur_only_in_known_combinations(spark):
    rows = [binding("new", {"tag:new": ["present"]}, "hard_constraint"), binding("old", {"tag:new": ["absent"], "tag:sale": ["present"]}), binding("any", {"tag:new": ["absent", "present"]})]
    check(spark, rows, combinations=([], ["new"], ["new", "sale"]))
    found, _ = check(spark, rows, combinations=(["new", "sale"],))
    assert {a for _, a, _ in found} == {frozenset({"new", "any"})}


def test_conflicting_ties_win_together(spark):
    rows = [binding("a", {"section": ["hero"]}, value="1"), binding("b", {"section": ["hero"]}, value="2"), binding("c", {"section": ["footer"]}, value="1"), binding("d", {"section": ["footer"]}, value="1")]
    found, _ = check(spark, rows)
    assert {w for _, a, w in found if "a" in a} == {frozenset({"a", "b"})} and {w for _, a, w in found if "c" in a} == {frozenset({"d"})}


def test_random_guards(spark):
    rng = random.Random(3)
    pools = {"audience": ["hcp", "patient", "vet"], "section": ["hero", "footer", "body"], "breakpoint": ["s", "m", "l"], "tag:new": ["present", "absent"], "tag:x": ["present"]}
    rows = []
    for n in range(40):
        guard = {a: rng.sample(v, rng.randint(1, len(v))) for a, v in pools.items() if rng.random() < 0.4}
        rows.append(binding(f"r{n:02d}", guard, rng.choice(list(HARD)), rng.choice("uvw"), rng.randint(0, 1), rng.choice("pqrs")))
    check(spark, rows, combinations=([], ["new"], ["new", "x"]))


def test_many_values_are_few_cells(spark):
    """Six axes of 30 values each: 729 million cells, but four sets of bindings; no product of tables in the plan."""
    domains = [(f"axis{n}", f"v{k}") for n in range(6) for k in range(30)]
    rows = [binding("a", {f"axis{n}": [f"v{k}" for k in range(15)] for n in range(6)}), binding("b", {f"axis{n}": [f"v{k}" for k in range(10, 30)] for n in range(3)}), binding("c", {})]
    found, _, active = run(spark, rows, domains, [[]])
    assert {a for _, a, _ in found} == {frozenset(x) for x in ("c", "bc", "ac", "abc")} and len(active) == 4
    bindings = X.numbered(spark.createDataFrame(rows, SCHEMA))
    plan = X.cell_winners(bindings, X.cells(bindings, spark.createDataFrame(domains, "axis string, value string"), spark.createDataFrame([([],)], "tags array<string>")))
    assert "Cartesian" not in plan._jdf.queryExecution().toString() and "NestedLoop" not in plan._jdf.queryExecution().toString()


def test_empty_tables(spark):
    assert run(spark, [], FEW, [[]]) == (set(), {}, {})
    with_none = run(spark, [binding("a", {"audience": ["hcp"]}), binding("b", None)], [], [[]])
    assert {a for _, a, _ in with_none[0]} == {frozenset("b")} or with_none[0] == set()


def test_kinds_stand_for_all_their_bindings(spark):
    """200 bindings of two guards are laid out as two; results are those of the bindings one by one."""
    rows = [binding(f"a{i:03}", {"audience": ["hcp"]} if i % 2 else None, "x" if i < 190 else "y") for i in range(200)]
    made = spark.createDataFrame(rows, SCHEMA)
    domains, none = spark.createDataFrame([("audience", "hcp"), ("audience", "patient")], "axis string, value string"), spark.createDataFrame([([],)], "tags array<string>")
    kinds = X.of_kinds(made)
    members = X.cells(kinds, domains, none)
    assert members.count() == 3 and kinds.count() == 200
    each = X.numbered(made)
    alone = X.cells(each, domains, none)
    won = [sorted((r.candidates, r.conflict, tuple(r.winners)) for r in X.cell_winners(b, m).collect()) for b, m in ((kinds, members), (each, alone))]
    lost = [{r.source_id: tuple(r.shadowed_by) for r in X.never_winning(b, m).collect()} for b, m in ((kinds, members), (each, alone))]
    assert won[0] == won[1] and lost[0] == lost[1]
