"""Cases that are easy to get wrong: null against empty, ties, empty tables, order, reruns."""

import itertools
import json
import random
import time
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from rulemesh.functions import scalars as S
from rulemesh.operators import aggregates as A
from rulemesh.operators import cascade as K
from rulemesh.operators import catalogue as T
from rulemesh.operators import consistency as L
from rulemesh.operators import dedupe as D
from rulemesh.operators import extraction as M
from rulemesh.operators import facets as B
from rulemesh.operators import graph as J
from rulemesh.operators import guards as G
from rulemesh.operators import joins as C
from rulemesh.operators import retrieval as I
from rulemesh.operators import segments as U
from rulemesh.operators import tokens as N
from rulemesh.operators import windows as E
from rulemesh.plans import queries as R

RULE = "id string, rule_class string, tags array<string>, section_types array<string>, content_sub_type_ids array<string>, audience string, hardness string, gov_type string, severity string, applies_kind string, content_types array<string>"


def rule(id_, sections, tags=None, subs=None, audience=None, hard="soft_guidance", kind=None):
    return (id_, "style", tags, sections, subs, audience, hard, None, None, kind, None)


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame([rule("all", None), rule("none", []), rule("a", ["x"], ["t"]), rule("b", ["y"], [], ["s"], "hcp")], RULE)


def ids(rows):
    return sorted(r.id for r in rows.collect())


def test_null_selectors_take_all_and_empty_ones_nothing(rules):
    assert ids(B.filter_rules(rules, section_types=["x"])) == ["a", "all"]
    assert ids(B.filter_rules(rules, section_types=["x"], include_all_section_rules=False)) == ["a"]
    assert ids(B.filter_rules(rules, section_types=[])) == ["all"]
    assert ids(B.filter_rules(rules, content_sub_type_ids=[])) == ["a", "all", "none"]
    assert ids(B.filter_rules(rules, tags=[])) == ["a", "all", "b", "none"]
    assert ids(B.filter_rules(rules, audience=["patient"])) == ["a", "all", "none"]
    assert ids(B.filter_rules(rules, rule_class=["style"])) == ["a", "all", "b", "none"]


def test_coerced_lists_are_null_rather_than_empty(spark):
    rows = spark.createDataFrame([(["a", "z"],), (["z"],), ([],), (None,)], "v array<string>")
    assert [r[0] for r in rows.select(B.coerce_list(F.col("v"), ["a"])).collect()] == [["a"], None, None, None]


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("kind", "raw", "canon"),
    [
        ("color", "#ABC", "#aabbcc"), ("color", " #A1B2C3", "#a1b2c3"), ("color", "rgb(1, 2,3)", "#010203"), ("color", "rgb(1,2,300)", None),
        ("color", "Teal", "Teal"), ("Spacing", "12", "12px"), ("spacing", "1.50 EM", "1.5em"), ("radius", "4px  8px", "4px 8px"), ("size", "-3.0%", "-3%"),
        ("spacing", " ", None), ("fontWeight", "Semi Bold", "600"), ("weight", "0700", "700"), ("weight", "odd", "odd"), ("opacity", "50%", "0.5"),
        ("number", "5", "5"), ("number", "5.50", "5.5"), ("ratio", "1 : 02", "1:2"), ("number", "1:2", "1:2"), ("case", "  Title\n Case ", "title case"), ("body", " As Is ", "As Is"),
    ],
)
def test_normalised_values(spark, kind, raw, canon):
    rows = spark.createDataFrame([(kind, raw)], "k string, v string")
    once = rows.select("k", S.normalise(F.col("k"), F.col("v")).alias("v"))
    assert once.first().v == canon
    assert once.select(S.normalise(F.col("k"), F.col("v"))).first()[0] == canon


def test_patterns_accept_what_the_source_may_write(spark):
    cases = [
        ("color", "#aabbcc", "use #ABC here", True), ("color", "#aabbcc", "#aabbccd", False), ("spacing", "12px", "12 PX", True), ("spacing", "12px", "112", False),
        ("size", "50%", "50 %", True), ("weight", "700", "set in bold", True), ("weight", "700", "1700", False), ("number", "1.5", "at 1.5", True), ("number", "1.5", "1.55", False),
    ]
    rows = spark.createDataFrame(cases, "k string, c string, t string, want boolean")
    for r in rows.select("*", F.regexp_like("t", S.value_pattern(F.col("k"), F.col("c"))).alias("got")).collect():
        assert r.got == r.want, r


def test_slugs(spark):
    for raw, want in (("Hello, World!", "hello_world"), ("__", "x"), ("é", "x"), ("a" * 47 + "-b", "a" * 47), ("", "x")):
        assert value(spark, S.slugify, raw) == want


def test_ratios_without_a_whole(spark):
    rows = spark.createDataFrame([("a", None), ("b", 1)], "source string, q int")
    found = {r.source: r.ratio for r in A.coverage(rows, "source", F.col("q").isNotNull(), F.coalesce(F.col("q") == 1, F.lit(False))).collect()}
    assert found == {"a": 0.0, "b": 1.0, None: 1.0}
    empty = spark.createDataFrame([([], [])], "a array<string>, b array<string>")
    assert empty.select(A.jaccard(F.col("a"), F.col("b"))).first()[0] == 1.0


def test_majority_ties_and_absent_values(spark):
    rows = spark.createDataFrame([("g", "b", "r1"), ("g", "a", "r2"), ("h", None, "r1"), ("h", None, "r2"), ("h", "z", "r3")], "g string, v string, run string")
    plain = {r.g: r.v for r in A.majority(rows, ["g"], "v").collect()}
    led = {r.g: r.v for r in A.majority(rows, ["g"], "v", F.col("run") == "r1").collect()}
    assert plain == {"g": "a", "h": None} and led == {"g": "b", "h": None}


def test_suffixed_ids_step_over_natural_ones(spark):
    rows = spark.createDataFrame(list(enumerate(["a", "a", "a_2", "a", "b", "a_4"])), "n int, slug string")
    got = [r.unique_id for r in E.uniquified(rows, "slug", "n").orderBy("n").collect()]
    assert len(set(got)) == 6 and got[0] == "a" and got[2] == "a_2" and got[5] == "a_4"
    assert got[1] == "a_3" and got[3] == "a_5"


def test_overlap_is_found_once_in_wide_and_narrow_cells(spark):
    rng = random.Random(1)
    spans = [("d", s, s + rng.randrange(1, 90)) for s in rng.sample(range(500), 30)]
    units = [("d", s, s + rng.randrange(1, 60)) for s in rng.sample(range(500), 30)]
    want = sorted((a, b, c, d) for _, a, b in spans for _, c, d in units if c < b and d > a)
    frames = [spark.createDataFrame(x, "doc string, start int, end int") for x in (spans, units)]
    for width in (1, 40, 10_000):
        got = C.overlapping(*frames, "doc", width).select("span_start", "span_end", "unit_start", "unit_end")
        assert sorted(map(tuple, got.collect())) == want


def test_references_missing_and_cyclic(spark):
    rows = [("a", "b", None), ("b", "c", None), ("c", None, "red"), ("x", "y", None), ("y", "x", None), ("s", "s", None), ("m", "gone", None), ("t", "x", None)]
    rows += [(f"n{i}", f"n{i + 1}" if i < 20 else None, str(i)) for i in range(21)]
    tokens = spark.createDataFrame(rows, "id string, ref string, value string")
    found = {r.id: r for r in J.resolve_refs(tokens).collect()}
    assert [(found[i].value, found[i].status) for i in "abc"] == [("red", "ok")] * 3
    assert [found[i].status for i in "xyst"] == ["cycle"] * 4 and found["m"].status == "missing"
    assert found["n0"].value == "20" and found["a"].chain == ["a", "b", "c"] and found["n0"].chain == [f"n{i}" for i in range(21)]
    assert J.resolve_refs(tokens.limit(0)).count() == 0


def test_a_walk_lists_edges_back_but_leaves_new_nodes_only(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "d", "t")], "src string, dst string, type string")
    start = spark.createDataFrame([("a",)], "node string")
    got = sorted((r["from"], r["to"], r.direction, r.step) for r in J.walk(edges, start, 2).collect())
    assert got == [("a", "b", "out", 1), ("b", "a", "in", 2), ("b", "c", "out", 2)]
    with pytest.raises(ValueError):
        J.walk(edges, start, 3)


GUARDS = st.dictionaries(st.sampled_from(["a", "b", "tag:x"]), st.lists(st.sampled_from("123"), max_size=3, unique=True), max_size=3)


def test_guard_algebra(spark):
    rng = random.Random(7)
    pool = [{k: sorted(rng.sample("1234", rng.randrange(0, 4))) for k in rng.sample(["a", "b", "c"], rng.randrange(0, 4))} for _ in range(60)]
    pairs = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(zip(pool, reversed(pool)))], "n int, a map<string,array<string>>, b map<string,array<string>>")
    rows = pairs.select("*", G.satisfiable(F.col("a"), F.col("b")).alias("s"), G.satisfiable(F.col("b"), F.col("a")).alias("r"), G.conjunction(F.col("a"), F.col("b")).alias("c"), G.conjunction(F.col("b"), F.col("a")).alias("d"))
    for r in rows.collect():
        empty = any(not v for g in (r.a, r.b) for v in g.values())
        want = not empty and all(set(r.a[k]) & set(r.b[k]) for k in set(r.a) & set(r.b))
        assert r.s == r.r == want and (r.c is not None) == want and r.c == r.d
        if want:
            assert r.c == {k: sorted(set(r.a.get(k, r.b.get(k))) & set(r.b.get(k, r.a.get(k)))) for k in {*r.a, *r.b}}


@settings(max_examples=50, deadline=None)
@given(GUARDS, GUARDS, GUARDS)
def test_parsed_guards_join_in_any_grouping(a, b, c):
    assert G.parse([a, [b, c]]) == G.parse([[a, b], c]) == G.parse([c, b, a])


def test_shapes_of_raw_guards():
    assert G.parse(None) == {}
    assert G.parse({"kind": "audience", "value": {"audience": "hcp"}}) == {"audience": ["hcp"]}
    assert G.parse([{"kind": "content_tag", "value": ["a", "b"]}, {"theme": "dark"}]) == {"tag:a": ["present"], "tag:b": ["present"], "theme": ["dark"]}
    assert G.parse({"x": {"op": "in", "values": ["2", "1"]}}) == {"x": ["1", "2"]}
    assert G.parse([{"x": "1"}, {"x": "2"}]) == {"x": []}
    with pytest.raises(TypeError):
        G.parse(3)


def test_unknown_axes_cannot_hold_but_tags_always_can(spark):
    rows = spark.createDataFrame([({"u": ["1"]},), ({"tag:x": ["present"]},), ({},), ({"k": ["3"]},)], "g map<string,array<string>>")
    domains = F.create_map(F.lit("k"), F.array(F.lit("1")))
    assert [r[0] for r in rows.select(G.is_satisfiable(F.col("g"), domains)).collect()] == [False, True, True, False]


BINDING = "element_path string, source_id string, source_kind string, value string, guard map<string,array<string>>, hardness string, selector_rank int, precedence int, scope string"


def test_ties_of_other_values_are_conflicts_and_leave_no_value(spark):
    rows = [
        ("p", "a", "rule_binding", "1", {}, "hard_constraint", 0, 0, "brand"), ("p", "b", "rule_binding", "2", {}, "hard_constraint", 0, 0, "brand"),
        ("q", "a", "rule_binding", "1", {}, "hard_constraint", 0, 0, "brand"), ("q", "b", "rule_binding", "2", {}, "hard_constraint", 0, 1, "brand"),
        ("r", "a", "rule_binding", "1", {"section": ["x"]}, "hard_constraint", 0, 0, "brand"), ("r", "b", "rule_binding", "2", {"section": ["y"]}, "hard_constraint", 0, 0, "brand"),
        ("s", "a", "rule_binding", "1", {"audience": ["no"]}, "hard_constraint", 0, 0, "brand"), ("s", "z", "token_default", "9", {}, "soft_guidance", 0, 0, "brand"),
    ]
    bindings = spark.createDataFrame(rows, BINDING)
    contexts = spark.createDataFrame([("k", {"audience": "yes"}, [])], "context_key string, context map<string,string>, tags array<string>")
    found = {r.element_path: r for r in K.resolve(K.survivors(bindings, contexts)).collect()}
    assert found["p"].conflict and found["p"].value is None and found["p"].tied == ["a", "b"]
    assert (found["q"].value, found["q"].conflict) == ("2", False)
    assert (found["r"].value, found["r"].conflict) == (None, False)
    assert (found["s"].value, found["s"].candidates) == ("9", 1)
    again = K.resolve(K.survivors(bindings.orderBy(F.desc("source_id")), contexts))
    assert sorted(map(str, again.collect())) == sorted(map(str, found.values()))


def test_cores_are_minimal():
    def c(*names):
        return names

    constraints = {"a": (c("x"), lambda x: x > 1), "b": (c("x"), lambda x: x < 1), "c": (c("y"), lambda y: y == 0), "d": (c("x", "y"), lambda x, y: x + y < 9)}
    assert L.smallest_contradiction({"x": [0, 1, 2], "y": [0, 1]}, constraints) == ["a", "b"]
    assert L.smallest_contradiction({"x": [0, 1, 2], "y": [0, 1]}, {k: constraints[k] for k in "acd"}) is None


def test_layouts_have_twelve_slots_and_equal_all_layouts(spark):
    rng = random.Random(5)
    names = ["a", "b", "c"]
    layouts = [p for k in range(5) for p in itertools.product(names, repeat=k)]
    keeps = {
        "at_least": lambda p, a, b, n: p.count(a) >= n,
        "at_most": lambda p, a, b, n: p.count(a) <= n,
        "before": lambda p, a, b, n: a not in p or b not in p or p.index(a) < p.index(b),
        "requires": lambda p, a, b, n: a not in p or b in p,
        "forbids": lambda p, a, b, n: a not in p or b not in p,
    }
    seen = set()
    for _ in range(2000):
        rules = [(rng.choice(list(keeps)), rng.choice(names), rng.choice(names), rng.randint(-1, 5)) for _ in range(rng.randint(1, 8))]
        want = any(all(keeps[k](p, a, b, n) for k, a, b, n in rules) for p in layouts)
        assert L.layout_fits(rules, 4) == want
        seen.add(want)
    assert seen == {True, False}
    rows = [("five", "1", "at_least", "a", None, 5), ("twelve", "1", "at_least", "a", None, 12), ("thirteen", "1", "at_least", "a", None, 12), ("thirteen", "2", "at_least", "b", None, 1), ("shared", "1", "at_least", "a", None, 1), ("shared", "1", "at_most", "a", None, 0)]
    rules = spark.createDataFrame(rows, "context string, id string, kind string, a string, b string, n int")
    assert {r.context: r.core for r in L.layout_cores(rules).collect()} == {"five": None, "twelve": None, "thirteen": "1,2", "shared": "1"}


def test_first_last_and_once_equal_all_layouts(spark):
    rng = random.Random(8)
    names = ["a", "b", "c"]
    keeps = {
        "at_least": lambda p, a, b, n: p.count(a) >= n,
        "at_most": lambda p, a, b, n: p.count(a) <= n,
        "before": lambda p, a, b, n: a not in p or b not in p or p.index(a) < p.index(b),
        "requires": lambda p, a, b, n: a not in p or b in p,
        "forbids": lambda p, a, b, n: a not in p or b not in p,
        "first": lambda p, a, b, n: p[0] in a.split("|"),
        "last": lambda p, a, b, n: p[-1] in a.split("|"),
        "once": lambda p, a, b, n: sum(x in a.split("|") for x in p) == 1,
    }
    several = ["a", "b", "c", "a|b", "b|c", "a|b|c"]
    for slots in (1, 2, 4):
        layouts = list(itertools.product([*names, ""], repeat=slots))
        seen = set()
        for _ in range(1500):
            rules = []
            for _ in range(rng.randint(1, 6)):
                kind = rng.choice(list(keeps))
                rules.append((kind, rng.choice(several if kind in ("first", "last", "once") else names), rng.choice(names), rng.randint(-1, 3)))
            want = any(all(keeps[k](p, a, b, n) for k, a, b, n in rules) for p in layouts)
            assert L.layout_fits(rules, slots) == want, (slots, rules)
            seen.add(want)
        assert seen == {True, False}


def test_layout_axioms(spark):
    sections = spark.createDataFrame([("x", "top_matter"), ("x", "end_matter"), ("x", "hero"), ("x", "body"), ("y", "hero")], "context string, section string")
    kinds = "context string, id string, position string, locked boolean, fills array<string>"
    subtypes = spark.createDataFrame([("x", "s1", "first", True, ["hero", "body", "gone"]), ("x", "s2", None, None, ["hero"]), ("x", "s3", "last", False, []), ("y", "s4", "last", False, ["hero"]), ("x", "s5", "first", True, None)], kinds)
    rules = L.layout_axioms(sections, subtypes)
    got = {(r.context, r.id, r.kind, r.a) for r in rules.collect()}
    assert got == {
        ("x", "struct:base:top_matter", "first", "top_matter"), ("x", "struct:base:top_matter", "once", "top_matter"),
        ("x", "struct:base:end_matter", "last", "end_matter"), ("x", "struct:base:end_matter", "once", "end_matter"),
        ("x", "struct:s1", "first", "body|hero"), ("x", "struct:s1", "once", "body|hero"), ("y", "struct:s4", "last", "hero"),
    }
    # two different sections can't both stand first
    assert {r.context: r.core for r in L.layout_cores(rules).collect()} == {"x": "struct:base:top_matter,struct:s1", "y": None}


def test_sets_of_layout_rules_are_decided_once(monkeypatch):
    asked = []
    fits = L._least_fits
    monkeypatch.setattr(L, "_least_fits", lambda rules, slots: asked.append(rules) or fits(rules, slots))
    rules = [("first", "once-only", None, None), ("last", "x|once-only", None, None), ("at_most", "x", None, 0)]
    assert {L.layout_fits(rules[k:] + rules[:k] * 2, 9) for k in (0, 1, 2) for _ in range(50)} == {True}
    assert 0 < len(asked) <= 4


TEXT = "# Colour\n\nUse e.g. #FFF. It must (see Fig. 2. Then) be so! \"One. Two\" J. R. Smith agreed.\n1. item\n   more\n\n\n| a | b |\n```\nx = 1\n\n```\n## Sub\nLast 1.5 line"


def test_units_put_together_are_the_text():
    rng = random.Random(2)
    pieces = TEXT.split(" ") + ["\n", "\n\n", "```\n", "- x", "| y |\n", "'it's'", "`a.b` ", "(", ")"]
    for text in [TEXT, "", "\n", "no end", *(" ".join(rng.choices(pieces, k=40)) for _ in range(60))]:
        units = list(U.units(text))
        assert "".join(text[u.start : u.end] for u in units) == text
        assert all(a.end == b.start for a, b in zip(units, units[1:]))


def test_kinds_and_headings_of_units():
    got = [(u.kind, TEXT[u.start : u.end].strip()[:12], u.headings) for u in U.units(TEXT)]
    assert got == [
        ("heading", "# Colour", ()), ("blank", "", ("Colour",)), ("sentence", "Use e.g. #FF", ("Colour",)), ("sentence", "It must (see", ("Colour",)),
        ("sentence", '"One. Two" J', ("Colour",)), ("sentence", "Smith agreed", ("Colour",)), ("list_item", "1. item\n   m", ("Colour",)), ("blank", "", ("Colour",)), ("table_row", "| a | b |", ("Colour",)),
        ("code_block", "```\nx = 1\n\n`", ("Colour",)), ("heading", "## Sub", ("Colour",)), ("sentence", "Last 1.5 lin", ("Colour", "Sub")),
    ]


@pytest.mark.parametrize(
    "text, parts",
    [
        ("One. Two! Three? four. Five", ["One. ", "Two! ", "Three? four. ", "Five"]),
        ("See Dr. Who etc. And no. 5. Then", ["See Dr. Who etc. And no. 5. Then"]),
        ("J. K. Rowling wrote. A. Smith read.", ["J. K. ", "Rowling wrote. ", "A. ", "Smith read."]),
        ('He said "No. Way. Out" now. So', ['He said "No. Way. Out" now. ', "So"]),
        ("(A. B (C. D) E. F) G. Hi", ["(A. B (C. D) E. F) G. ", "Hi"]),
        ("Use ``a. B`` or `c. D`. Done", ["Use ``a. B`` or `c. D`. ", "Done"]),
        ("It's 3.5 m. The dog's 'own. Bed' is. Ok", ["It's 3.5 m. ", "The dog's 'own. Bed' is. ", "Ok"]),
        ("A\\ \"x\\\" y. Z\". Next", ["A\\ \"x\\\" y. Z\". ", "Next"]),
        ("End...   “Quoted” one", ["End...   ", "“Quoted” one"]),
        ("", []),
    ],
)
def test_sentences(text, parts):
    assert [text[a:b] for a, b in U.sentences(text)] == parts


def test_sentences_of_a_long_text_take_linear_time():
    text = "The cat sat. On the (mat. Yes) it did! \"No. way\" he's ok, see Fig. 3. " * 15_000
    began = time.perf_counter()
    assert "".join(text[a:b] for a, b in U.sentences(text)) == text
    assert time.perf_counter() - began < 5


def test_alignment_prefers_exact_then_normalized_then_fuzzy():
    text = "Say “Hello  World” to all; café closed on Mondays and Tuesdays."
    assert M.align("to all", text) == (text.index("to all"), text.index("to all") + 6, "exact", 1.0)
    start, end, match, _ = M.align('"hello world"', text)
    assert match == "normalized" and text[start:end] == "“Hello  World”"
    start, end, match, _ = M.align("café closed", text)
    assert match == "normalized" and unicodedata.normalize("NFC", text[start:end]) == "café closed"
    start, end, match, ratio = M.align("closed on Mondeys and Tuesdays.", text)
    assert match == "fuzzy" and text[start:end] == "closed on Mondays and Tuesdays." and ratio >= 0.92
    assert M.align("nothing of the kind here", text) is None and M.align("", text) is None


def plain_fuzzy(quote, text, least=0.92):
    found = []
    for width in range(max(1, int(0.8 * len(quote))), max(1, int(0.8 * len(quote)), int(1.2 * len(quote))) + 1):
        for at in range(len(text) - width + 1):
            ratio = SequenceMatcher(None, text[at : at + width], quote, autojunk=False).ratio()
            if ratio >= least:
                found.append((-ratio, at, at + width))
    return min(found, default=None)


def test_fuzzy_windows_begin_and_end_anywhere():
    rng = random.Random(4)
    for signs in ("ab", "abcdefgh ij", "天地玄黄宇宙洪荒日月盈昃"):
        for _ in range(60):
            text = "".join(rng.choices(signs, k=rng.randint(1, 60))).strip() or "a"
            text = " ".join(text.split())
            at, width = rng.randrange(len(text)), rng.randint(1, 30)
            quote = " ".join((text[at : at + width // 2] + "x" + text[at + width // 2 : at + width]).split())
            got, want = M.align(quote, text), plain_fuzzy(quote, text)
            if quote in text:
                assert got[2] == "exact"
            else:
                assert (got and (-got[3], got[0], got[1])) == want
    start, end, match, _ = M.align("玄黄宇宙洪荒日月盈昃辰宿列张寒", "天地玄黄宇宙洪荒日月盈昃辰宿列張寒来暑往秋收冬藏")
    assert (start, end, match) == (2, 17, "fuzzy")
    assert M.align("straßex hier entlang laufen", "Die Straße hier entlang laufen")[1] == 30


def plain_cited(quote, ids, units):
    """Every window of cited units, of joined consecutive ones, then of neighbours: (doc_ref, ids, start, end, match)."""
    by_id = {u["unit_id"]: u for u in units}
    cited = [by_id[i] for i in dict.fromkeys(ids) if i in by_id]
    rank = {"exact": 3, "normalized": 2, "fuzzy": 1}
    found = []
    for u in cited:
        if hit := M.align(quote, u["text"]):
            found.append((-rank[hit[2]], -hit[3], u["start"] + hit[0], u["start"] + hit[1], [u["unit_id"]], u["doc_ref"]))
    for a in cited:
        for n in range(2, len(cited) + 1):
            run = [u for k in range(n) for u in cited if u["doc_ref"] == a["doc_ref"] and u["ordinal"] == a["ordinal"] + k]
            before = any(u["doc_ref"] == a["doc_ref"] and u["ordinal"] == a["ordinal"] - 1 for u in cited)
            after = any(u["doc_ref"] == a["doc_ref"] and u["ordinal"] == a["ordinal"] + n for u in cited)
            if len(run) < n or before or after:
                continue
            hit = M.align(quote, "".join(u["text"] for u in run))
            if hit:
                spots = [u["start"] + k for u in run for k in range(len(u["text"]))]
                b, e = spots[hit[0]], spots[hit[1] - 1] + 1
                over = [u["unit_id"] for u in run if u["start"] < e and u["end"] > b]
                if len(over) > 1:
                    found.append((-1, -hit[3], b, e, over, a["doc_ref"]))
    if not found:
        for u in units:
            if any(u["doc_ref"] == c["doc_ref"] and abs(u["ordinal"] - c["ordinal"]) == 1 for c in cited) and (hit := M.align(quote, u["text"])):
                found.append((-1, -hit[3], u["start"] + hit[0], u["start"] + hit[1], [u["unit_id"]], u["doc_ref"]))
    if found:
        best = min(found)
        return best[5], best[4], best[2], best[3], {-3: "exact", -2: "normalized", -1: "fuzzy"}[best[0]]
    same = sorted((u for u in cited if u["doc_ref"] == cited[0]["doc_ref"]), key=lambda u: u["ordinal"])
    return cited[0]["doc_ref"] if cited else "", [u["unit_id"] for u in same], min((u["start"] for u in same), default=0), max((u["end"] for u in same), default=0), "failed"


def test_quotes_over_units_and_beside_them(spark):
    texts = {"d": ["Logos stay on white grounds", "and keep clear space around", "", "them at all times always"], "e": ["Buttons are never round here", "they use the brand colour"]}
    units, at = [], 0
    for doc, lines in texts.items():
        at = 0
        for n, line in enumerate(lines):
            units.append({"unit_id": f"{doc}{n}", "doc_ref": doc, "ordinal": n, "start": at, "end": at + len(line), "text": line})
            at += len(line) + 1
    cases = [
        ("on white grounds", ["d0"]), ("on white groundsand keep clear", ["d0", "d1"]), ("on white grounds and keep clear", ["d1", "d0", "d0"]),
        ("on white grounds and keep clear", ["d0"]), ("keep clear space around", ["d0"]), ("they use the brand color", ["e0", "gone"]),
        ("nothing like it stands anywhere", ["e1", "d0", "e0"]), ("anything", ["gone"]), ("anything", []), ("", ["d0"]), (None, ["d1", "d2"]),
        ("space around them at all times", ["d1", "d2", "d3"]), ("anything", None), ("Never round here", ["d0", "e0"]),
    ]
    quotes = spark.createDataFrame([(n, q, ids) for n, (q, ids) in enumerate(cases)], "quote_id int, quote string, unit_ids array<string>")
    rows = spark.createDataFrame([tuple(u.values()) for u in units], "unit_id string, doc_ref string, ordinal int, start int, end int, text string")
    got = {r.quote_id: (r.doc_ref, r.unit_ids, r.start, r.end, r.match) for r in M.align_cited(quotes, rows).collect()}
    want = {n: plain_cited(q or "", ids or [], units) for n, (q, ids) in enumerate(cases)}
    assert got == want
    assert [want[n][4] for n in range(8)] == ["exact", "fuzzy", "fuzzy", "failed", "fuzzy", "fuzzy", "failed", "failed"]
    assert M.align_cited(quotes.limit(0), rows).count() == 0


def test_fuzzy_align_takes_every_line(spark, tmp_path):
    rng = random.Random(6)
    texts = ["short", "", "\n".join(["".join(rng.choices("abcdefghijkl ", k=n)).strip() or "a" for n in (3, 25, 120, 700)])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r.doc_ref, r.ordinal): r for r in R.QUERIES["fuzzy_align"](spark, str(tmp_path)).collect()}
    assert set(rows) == {(str(i), k) for i, x in enumerate(texts) for k in range(len(x.split("\n")))}
    for (doc, k), r in rows.items():
        if len(texts[int(doc)].split("\n")[k]) >= 28:
            assert r.match == "fuzzy" and r.ratio >= 0.982
    assert rows["2", 3].start > 0


def test_aligned_columns(spark):
    rows = spark.createDataFrame([("b c", "a b c"), ("zzz", "a b c"), (None, "x"), ("x", None)], "q string, t string")
    got = [tuple(r.a) for r in rows.select(M.aligned("q", "t").alias("a")).collect()]
    assert got == [(2, 5, "exact", 1.0), (None, None, "failed", 0.0), (None, None, "failed", 0.0), (None, None, "failed", 0.0)]


def test_patches_are_judged_by_what_is_there(spark):
    state = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int")
    patches = [(1, "add", 1, "z", 0), (2, "update", 2, None, 9), (3, "add", 3, "c", 3), (4, "delete", 4, None, None), (5, "delete", 5, None, None), (6, "add", 5, "e", 5)]
    new, rejected = M.apply_patches(state, spark.createDataFrame(patches, "seq int, op string, k int, v string, w int"), "k", ["v", "w"])
    assert sorted(map(tuple, new.collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", 3), (5, "e", 5)]
    assert sorted((r.k, r.reason) for r in rejected.collect()) == [(1, "exists"), (4, "missing"), (5, "missing")]


def test_patches_of_a_key_are_applied_one_after_another(spark):
    rng = random.Random(5)
    state = {k: (f"s{k}", k) for k in range(12) if k % 2}
    patches = [(n, rng.choice(["add", "update", "update", "delete"]), rng.randrange(12), rng.choice([None, f"v{n}"]), rng.choice([None, n])) for n in range(150)]
    want, rejects, now = dict(state), [], set(state)
    for n, op, k, v, w in patches:
        if (op == "add") == (k in want):
            rejects.append((n, k))
        elif op == "add":
            want[k] = (v, w)
        elif op == "delete":
            del want[k]
        else:
            old = want[k]
            want[k] = (old[0] if v is None else v, old[1] if w is None else w)
    rows = spark.createDataFrame([(k, *x) for k, x in state.items()], "k int, v string, w int")
    frame = spark.createDataFrame(patches, "seq int, op string, k int, v string, w int").repartition(5)
    new, rejected = M.apply_patches(rows, frame, "k", ["v", "w"])
    assert {r.k: (r.v, r.w) for r in new.collect()} == want
    assert sorted((r.seq, r.k) for r in rejected.collect()) == rejects
    hashes = {r.k: (r.before, r.after) for r in M.audit(rows, new, frame, "k", ["v", "w"]).collect()}
    assert set(hashes) == {p[2] for p in patches}
    assert all((b is None) == (k not in state) and (a is None) == (k not in want) and (a == b) == (state.get(k) == want.get(k)) for k, (b, a) in hashes.items())


@pytest.mark.parametrize("chars", [1_000_000, 12])
def test_quotes_are_found_however_many_passes_it_takes(spark, chars):
    texts = {1: "a b a b", 2: None, 3: "", 4: "naïve café, b a", 5: "aaa"}
    wanted = [("p", "a b"), ("q", "b a"), ("r", ""), ("s", None), ("t", "aa"), ("u", "a b"), ("v", "café"), ("w", "zz")]
    units = spark.createDataFrame(list(texts.items()), "unit int, body string").repartition(3)
    quotes = spark.createDataFrame(wanted, "name string, quote string")
    got = sorted((r.unit, r.name, r.start, r.end) for r in M.exact_quotes(quotes, units, "quote", "body", chars=chars).collect())
    assert got == sorted((i, n, t.find(q), t.find(q) + len(q)) for i, t in texts.items() for n, q in wanted if t is not None and q is not None and q in t)


def test_siblings_with_a_cap_are_the_first_ones(spark):
    rows = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(60)], "id int, g int")
    every, capped = C.siblings(rows, "id", "g").collect(), C.siblings(rows, "id", "g", 4).collect()
    want = {i: sorted(r.sibling for r in every if r.id == i)[:4] for i in {r.id for r in every}}
    assert {i: sorted(r.sibling for r in capped if r.id == i) for i in want} == want


def test_greedy_clusters_follow_the_order_of_keys(spark):
    rows = spark.createDataFrame([("i", 1, [1, 2]), ("i", 2, [2, 3]), ("i", 3, [1, 2, 3]), ("i", 4, []), ("i", 5, [])], "i string, k int, u array<int>")
    want = [(1, 1), (2, 2), (3, 1), (4, 4), (5, 4)]
    for frame in (rows, rows.orderBy(F.desc("k")).repartition(3)):
        assert sorted((r.k, r.cluster) for r in M.greedy_clusters(frame, "i", "k", "u").collect()) == want


def test_search_drops_scores_of_nothing_and_bad_patterns_raise(spark):
    docs = spark.createDataFrame([(1, "red fish"), (2, "blue fish fish"), (3, None), (4, "")], "id int, text string")
    assert [r.id for r in I.bm25(docs.where("text IS NOT NULL"), "id", F.col("text"), "red red").collect()] == [1]
    assert I.bm25(docs, "id", F.col("text"), "?!").count() == 0
    with pytest.raises(ValueError):
        I.grep(docs, "id", F.col("text"), "(")


def test_vector_search_may_find_fewer_than_asked(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i)], i % 2) for i in range(10)], "id int, v array<double>, label int")
    got = I.vector_top(rows, "id", "v", F.array(F.lit(1.0), F.lit(0.0)), F.col("label") == 1, k=2, fetch=2).collect()
    assert [r.id for r in got] == [1, 3]


def test_tree_round_trip(spark):
    tokens = spark.createDataFrame(
        [("t1", "a.b", "color", "#ABC", None), ("t2", "a.b.c", "spacing", "4", None), ("t3", "d", "color", None, "t1"), ("t4", "e", "odd", "X y", None)],
        "id string, key string, token_type string, value string, ref string",
    )
    tree = json.loads(N.export(tokens))
    assert N.flattened(tree) == [("a.b.c", "dimension", "4px"), ("a.b_value", "color", "#aabbcc"), ("d", "color", "{a.b_value}"), ("e", None, "x y")]
    assert N.nested([(p, k, v) for p, k, v in N.flattened(tree)]) == tree
    with pytest.raises(ValueError):
        N.nested([("a", "x", "1"), ("a.b", "x", "2")])


def test_similar_pairs_have_no_self_or_mirrored_pairs(spark):
    rows = spark.createDataFrame([("b", i, w) for i, w in enumerate([["x", "y"], ["y", "x", "x"], ["z"], []])], "blk string, id int, w array<string>")
    assert [tuple(r) for r in D.similar_pairs(rows, "blk", "id", "w", 0.4).collect()] == [(0, 1, 1.0)]


def test_loose_json_is_found_in_prose():
    from rulemesh.operators.catalogue import loose_json

    assert loose_json('Sure:\n```json\n{"b": 1, "a": [2]}\n```') == '{"a":[2],"b":1}'
    assert loose_json('x {not json} then {"a": "}"} end') == '{"a":"}"}'
    assert loose_json("nothing") is None and loose_json(None) is None


def test_unknown_references_leave_null_and_are_reported(spark):
    from rulemesh.operators import catalogue as T

    rows = spark.createDataFrame([("r1", ["a", "x", "b", "a"]), ("r2", ["x"]), ("r3", None), ("r4", [])], "id string, refs array<string>")
    targets = spark.createDataFrame([("a",), ("b",)], "key string")
    clean, dangling = T.known_refs(rows, "id", "refs", targets, "key")
    assert {r.id: r.refs for r in clean.collect()} == {"r1": ["a", "b", "a"], "r2": None, "r3": None, "r4": None}
    assert sorted(map(tuple, dangling.collect())) == [("r1", "x"), ("r2", "x")]


def test_composite_values(spark):
    rows = [
        ("s", "shadow", '{"x": "1", "offset_x": "2", "color": {"$ref": "c"}, "inset": true, "blur": {"$ref": "gone"}}'),
        ("t", "typography", '{"fontFamily": "\\"Acme Sans\\" , serif,", "fontSize": "9", "lineHeight": "1.50", "letterSpacing": "2 PX", "other": "x"}'),
        ("b", "border", "no json"), ("n", "border", None), ("e", "type_scale", "{}"),
    ]
    tokens = spark.createDataFrame(rows, "id string, token_type string, value string")
    paths = spark.createDataFrame([("c", "brand.ink")], "id string, path string")
    got = {r.id: (json.loads(r.value) if r.value else None, r.lacking) for r in N.composites(tokens, paths).collect()}
    assert got["s"] == ({"blur": None, "offsetX": "2px", "color": "{brand.ink}", "inset": "true"}, [])
    assert got["t"] == ({"fontFamily": "Acme Sans,serif", "fontSize": "9px", "lineHeight": "1.5", "letterSpacing": "2px"}, ["fontWeight"])
    assert got["b"] == got["n"] == (None, [])
    assert got["e"][1] == ["fontFamily", "fontSize", "fontWeight", "letterSpacing", "lineHeight"]


def test_evidence_of_known_entities_only(spark):
    kind = "entity string, guard string, path string, items array<string>"
    base = spark.createDataFrame([("e", "", "value", ["1"]), ("e", "", "value_evidence", ["q", "a"]), ("e", "g", "value", ["2"])], kind)
    other = spark.createDataFrame(
        [("e", "", "value", ["9"]), ("e", "", "value_evidence", ["b", "a"]), ("e", "", "notes", ["x"]), ("e", "", "notes_evidence", ["n"]), ("e", "h", "value", ["3"]), ("f", "", "value_evidence", ["z"])], kind
    )
    got = {(r.entity, r.guard, r.path): r["items"] for r in M.merged_evidence(base, other).collect()}
    assert got == {("e", "", "value"): ["1"], ("e", "", "value_evidence"): ["a", "b", "q"], ("e", "", "notes_evidence"): ["n"], ("e", "g", "value"): ["2"], ("e", "h", "value"): ["3"]}
    assert M.merged_evidence(base.limit(0), other).count() == 0 and M.merged_evidence(base, other.limit(0)).count() == 3


def test_majority_of_the_runs_that_emitted_a_group(spark):
    emitted = spark.createDataFrame([("r1", "g"), ("r2", "g"), ("r3", "g"), ("r4", "h"), ("r2", "h")], "run string, group string")
    relations = spark.createDataFrame([("r1", "g", "a"), ("r2", "g", "b"), ("r3", "g", "b"), ("r3", "g", "c"), ("r3", "g", "c"), ("r2", "h", "d")], "run string, group string, relation string")
    got = {(r["group"], r.relation) for r in M.relation_handoff(relations, emitted, "r1").collect()}
    assert got == {("g", "a"), ("g", "b")}  # d has one of two runs, which is no majority


def test_numbers_of_documents(spark):
    texts = ['{"a": 1, "b": {"c": {"d": 2.5, "e": "x", "f": null}, "g": [1]}, "h": true}', "[1]", "no", None, "{}"]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(texts)], "n int, x string").select("n", T.flattened_numbers("x").alias("f"))
    got = {r.n: {x.path: x.value for x in r.f} for r in rows.collect()}
    assert got == {0: {"a": 1.0, "b.c.d": 2.5, "h": 1.0}, 1: {}, 2: {}, 3: {}, 4: {}}


def test_records_settings_and_caches(spark):
    runs = spark.createDataFrame([("k", n, s, f) for n, (s, f) in enumerate([("a", "1"), ("a", "1"), ("a", "2"), ("b", "2"), ("a", "3"), (None, "3"), (None, None)])], "k string, n int, signature string, fingerprint string")
    assert [r.status for r in T.determinism(runs, "k", "n").orderBy("n").collect()] == ["pass", "pass", "fail", "pass", "pass", "pass", "fail"]
    layer = lambda rows: spark.createDataFrame(rows, "name string, value string")
    got = {r.name: (r.value, r.layer) for r in T.settings([layer([("a", None), ("b", "1")]), layer([("a", "2"), ("b", "3")]), layer([])]).collect()}
    assert got == {"a": ("2", 1), "b": ("1", 0)}
    wanted = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    cache = spark.createDataFrame([(2, "x"), (2, "x")], "k int, v string")
    hits, misses = T.from_cache(wanted, cache, "k")
    assert [r.v for r in hits.collect()] == ["x", "x"] and sorted(r.k or 0 for r in misses.collect()) == [0, 1]


def test_alignment_tries_no_window_twice(monkeypatch):
    tried = []

    class Counting(M.SequenceMatcher):
        def ratio(self):
            tried.append(self.a)
            return super().ratio()

    monkeypatch.setattr(M, "SequenceMatcher", Counting)
    assert M.align("Shti Shtix Shti xShti Shti Sh", "Shti " * 400) is None
    assert M.align("r, atanor,x atanor, atanor, a", "atanor, " * 90) == (0, 25, "fuzzy", 50 / 54)
    assert len(tried) == len(set(tried)) <= 60
    # repeated blanks and composed signs change places, others don't
    assert M.folded("Größe – „ja“") == ("grösse - „ja\"", [0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10, 11])
    assert M.folded("a  éb") == ("a éb", [0, 1, 3, 5])
