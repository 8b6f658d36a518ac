"""Gap rounds: why they stop, what is rejected, and what an escalated reply replaces."""

import pytest

from rulemesh.operators import gaps as Y

UNITS = "unit_id string, doc_ref string, required boolean, yields array<string>"
ENTITIES = "id string, kind string, doc_ref string, value string, unit_ids array<string>"
REPLIES = "round int, doc_ref string, mode string, id string, kind string, marker string, value string, unit_ids array<string>, verified boolean"
LINKS = "round int, doc_ref string, mode string, relation string"
P, BOTH = ["token_primitive"], ["token_primitive", "token_semantic"]


def run(spark, units, entities=(), relations=(), replies=(), links=(), **settings):
    frame = lambda rows, kind: spark.createDataFrame(list(rows), kind).repartition(2)
    got = Y.close_gaps(frame(units, UNITS), frame(entities, ENTITIES), frame(relations, "doc_ref string, relation string"), frame(replies, REPLIES), frame(links, LINKS), **settings)
    return (
        got.stopped, {r.id: tuple(r[1:]) for r in got.entities.collect()}, sorted(r.unit_id for r in got.open.collect()),
        sorted(map(tuple, got.rounds.collect())), sorted(map(tuple, got.rejects.collect())), sorted(map(tuple, got.relations.collect())),
    )


def reply(n, doc, i, kind="rule", marker=None, value="v", units=(), ok=True, mode="gap_patch"):
    return (n, doc, mode, i, kind, marker, value, list(units), ok)


def test_nothing_open(spark):
    units = [("u1", "d", True, P), ("u2", "d", False, P)]
    stopped, entities, left, rounds, rejects, _ = run(spark, units, [("e", "rule", "d", "x", ["u1"])])
    assert (stopped, left, rounds, rejects) == ("empty_queue", [], [], []) and entities == {"e": ("rule", "d", "x", ["u1"])}
    assert run(spark, [])[0] == "empty_queue"
    with pytest.raises(ValueError):
        run(spark, units, rounds=0)


def test_a_stalled_blob_is_escalated_once_and_replaces_its_rules(spark):
    units = [(f"u{n}", "d", True, P) for n in range(3)] + [("x", "other", True, P)]
    old = [("r_old", "rule", "d", "x", []), ("t_old", "token_primitive", "d", "x", []), ("r_else", "rule", "other", "x", ["x"])]
    replies = [reply(2, "d", "r_new", units=["u0", "u1", "u2"], mode="escalate"), reply(1, "d", "late", units=["u0"], mode="escalate")]
    stopped, entities, left, rounds, _, relations = run(
        spark, units, old, [("d", "old"), ("other", "kept")], replies, [(2, "d", "escalate", "new"), (1, "d", "escalate", "no"), (1, "d", "gap_patch", "first")]
    )
    assert stopped == "empty_queue" and set(entities) == {"r_new", "t_old", "r_else"} and left == []
    assert rounds == [(1, "d", "gap_patch", 3, 3), (2, "d", "escalate", 3, 0)] and relations == [("d", "new"), ("other", "kept")]


def test_an_escalated_reply_with_a_row_that_fails_replaces_nothing(spark):
    units = [("u0", "d", True, P), ("u1", "d", True, P)]
    replies = [reply(2, "d", "new", units=["u0"], mode="escalate"), reply(2, "d", "bad", ok=False, mode="escalate")]
    stopped, entities, left, rounds, rejects, relations = run(spark, units, [("old", "rule", "d", "x", [])], [("d", "old")], replies, [(2, "d", "escalate", "new")])
    assert set(entities) == {"old", "new"} and relations == [("d", "old")] and rejects == [(2, "d", "bad", "unverified")]
    assert stopped == "zero_progress" and left == ["u1"] and rounds[-1] == (3, "d", "gap_patch", 1, 1)


def test_stops_without_progress_or_after_all_rounds(spark):
    units = [(f"u{n}", "d", True, P) for n in range(9)]
    assert run(spark, units)[0] == "zero_progress"
    stopped, _, left, rounds, *_ = run(spark, units, replies=[reply(n, "d", f"e{n}", units=[f"u{n}"]) for n in (1, 2, 3)])
    assert stopped == "max_rounds" and len(left) == 6 and [r[3:] for r in rounds] == [(9, 8), (8, 7), (7, 6)]


def test_kinds(spark):
    units = [(f"u{n}", f"d{n}", True, P if n < 6 else BOTH) for n in range(9)]
    old = [("tok", "token_semantic", "z", None, []), ("ru", "rule", "z", "x", ["q"])]
    replies = [
        reply(1, "d0", "a", "token", units=["u0"]), reply(1, "d1", "b", "token", "token_semantic", units=["u1"]), reply(1, "d2", "tok", "token", units=["u2"]),
        reply(1, "d3", "tok", "token", "token_primitive", units=["u3"]), reply(1, "d4", "c", "token", "colour", units=["u4"]), reply(1, "d4", "fine", units=["u4"]),
        reply(1, "d5", "ru", "asset", units=["u5"]), reply(1, "d6", "d", "token", units=["u6"]), reply(1, "d7", "both", "asset", units=["u7"]), reply(1, "d8", "both", "rule", units=["u8"]),
    ]
    _, entities, left, _, rejects, _ = run(spark, units, old, replies=replies, rounds=1)
    assert {i: e[0] for i, e in entities.items()} == {"tok": "token_semantic", "ru": "rule", "a": "token_primitive", "b": "token_semantic", "both": "asset"}
    assert [r[1:] for r in rejects] == [("d3", "tok", "kind_conflict"), ("d4", "c", "invalid_kind"), ("d5", "ru", "kind_conflict"), ("d6", "d", "kind_missing"), ("d8", "both", "kind_conflict")]
    assert left == ["u3", "u4", "u5", "u6", "u8"] and entities["ru"] == ("rule", "z", "x", ["q"])


def test_updates_keep_what_they_do_not_give(spark):
    units = [("u0", "d", True, P), ("u1", "d", True, P)]
    replies = [(1, "d", "gap_patch", "e", "rule", None, None, ["u0", "u1"], True), (1, "d", "gap_patch", "f", "rule", None, "new", None, True)]
    entities = run(spark, units, [("e", "rule", "z", "kept", []), ("f", "rule", "z", "old", ["w"])], replies=replies)[1]
    assert entities == {"e": ("rule", "z", "kept", ["u0", "u1"]), "f": ("rule", "z", "new", ["w"])}
