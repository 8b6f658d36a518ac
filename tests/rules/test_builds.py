"""Builds that are taken up again, by another process too, and what they make anew."""

import pytest
from pyspark.sql import functions as F

from rulemesh.plans.builds import Build, Step
from rulemesh.sources.snapshots import Snapshots

RULES = [("a", "x", "red cta", "s1"), ("b", "x", "blue", "s2"), ("c", "y", "red", "s3"), ("d", None, "green", "s4")]
WORDS = [("red", "colour"), ("cta", "place")]
CALLS = []


def rules(spark, data=RULES):
    return spark.createDataFrame(data, "id string, brand_id string, text string, note string")


def words(spark, data=WORDS):
    return spark.createDataFrame(data, "word string, kind string")


def cut(spark, tables):
    got = tables["rules"].select("id", "brand_id", F.explode(F.split("text", " ")).alias("word"), "note")
    CALLS.append(("cut", sorted({r.brand_id or "-" for r in tables["rules"].select("brand_id").distinct().collect()})))
    return got


def label(spark, tables):
    CALLS.append(("label", sorted({r.brand_id or "-" for r in tables["cut"].select("brand_id").distinct().collect()})))
    return tables["cut"].join(tables["words"], "word", "left").select("id", "brand_id", "word", "kind")


def total(spark, tables):
    CALLS.append(("total", []))
    return tables["label"].groupBy("kind").agg(F.count("*").alias("n"))


STEPS = (
    Step("cut", ("rules",), cut, volatile=("note",)),
    Step("label", ("cut", "words"), label),
    Step("total", ("label",), total, by_part=False),
)


@pytest.fixture
def store(spark, tmp_path):
    found = Snapshots(spark, f"file://{tmp_path}/kb")
    found.commit({"rules": rules(spark), "words": words(spark)})
    CALLS.clear()
    return found


def content(build, name):
    return sorted(map(tuple, build.table(name).collect()), key=str)


def did(build, **how):
    CALLS.clear()
    return {n: o.did for n, o in build.run(**how).items()}


def fresh(spark, tmp_path, data, vocabulary=WORDS):
    """All tables made at once from the sources."""
    store = Snapshots(spark, f"file://{tmp_path}/fresh")
    store.commit({"rules": rules(spark, data), "words": words(spark, vocabulary)})
    build = Build(store, STEPS)
    build.run()
    return {n: content(build, n) for n in ("cut", "label", "total")}


def same(build, want):
    assert {n: content(build, n) for n in want} == want


def test_a_restart_skips_and_one_partition_is_made_again(spark, store, tmp_path):
    assert did(Build(store, STEPS)) == dict.fromkeys(("cut", "label", "total"), "ran")
    again = Build(Snapshots(spark, store.root), STEPS)
    assert did(again) == dict.fromkeys(("cut", "label", "total"), "skipped") and CALLS == []
    before = {n: t["parts"] for n, t in store.manifest()["tables"].items()}
    changed = [*RULES[:2], ("c", "y", "cta", "s3"), RULES[3]]
    store.commit({"rules": rules(spark, changed)})
    outcome = again.run()
    assert [len(outcome[n].made) for n in ("cut", "label")] == [1, 1] and CALLS == [("cut", ["y"]), ("label", ["y"]), ("total", [])]
    after = {n: t["parts"] for n, t in store.manifest()["tables"].items()}
    for name in ("cut", "label"):
        assert sum(before[name][p] == after[name][p] for p in before[name]) == 2
    same(again, fresh(spark, tmp_path, changed))


def test_partitions_come_and_go(spark, store, tmp_path):
    build = Build(store, STEPS)
    build.run()
    store.commit({"rules": rules(spark, [*RULES[:2], ("e", "z", "red red", None)])})
    outcome = build.run()
    assert len(outcome["cut"].made) == 1 and len(outcome["cut"].gone) == 2 and outcome["label"].did == outcome["total"].did == "ran"
    same(build, fresh(spark, tmp_path, [*RULES[:2], ("e", "z", "red red", None)]))
    store.commit({"rules": rules(spark, [])})
    build.run()
    assert content(build, "label") == content(build, "total") == []
    assert did(build)["label"] == "skipped"


def test_same_rows_stop_the_rest_and_volatile_columns_do_not_count(spark, store):
    build = Build(store, STEPS)
    build.run()
    store.commit({"rules": rules(spark, [(*r[:3], "new") for r in RULES])})
    assert did(build) == {"cut": "ran", "label": "skipped", "total": "skipped"}
    assert {r[3] for r in content(build, "cut")} == {"new"}


def test_whole_inputs_versions_and_force_make_all(spark, store, tmp_path):
    build = Build(store, STEPS)
    build.run()
    store.commit({"words": words(spark, WORDS[:1])})
    assert did(build) == {"cut": "skipped", "label": "ran", "total": "ran"} and CALLS[0] == ("label", ["-", "x", "y"])
    same(build, fresh(spark, tmp_path, RULES, WORDS[:1]))
    newer = Build(store, (Step("cut", ("rules",), cut, version="2", volatile=("note",)), *STEPS[1:]))
    assert did(newer) == {"cut": "ran", "label": "skipped", "total": "skipped"}
    assert did(newer, force={"label"}) == {"cut": "skipped", "label": "ran", "total": "skipped"}


def test_steps_left_out_are_read_as_stored(spark, store):
    build = Build(store, STEPS)
    with pytest.raises(ValueError, match="nothing has made"):
        build.run(wanted={"label"})
    build.run(wanted={"cut"})
    assert did(build, wanted={"label"}) == {"cut": "left out", "label": "ran", "total": "left out"} and ("label", ["-", "x", "y"]) in CALLS
    assert did(build) == {"cut": "skipped", "label": "skipped", "total": "ran"}


@pytest.mark.parametrize("step, at", [("_write", 1), ("_hashes", 2), ("_publish", 3), ("_create", 2)])
def test_a_build_that_is_stopped_goes_on(spark, store, tmp_path, monkeypatch, step, at):
    build, whole, calls = Build(store, STEPS), getattr(Snapshots, step), []
    build.run()
    changed = [("a", "x", "cta cta", "s1"), *RULES[1:]]
    store.commit({"rules": rules(spark, changed)})

    def stopped(self, *args):
        calls.append(1)
        if len(calls) == at:
            raise OSError("stopped")
        return whole(self, *args)

    with monkeypatch.context() as patch:
        patch.setattr(Snapshots, step, stopped)
        with pytest.raises(OSError):
            build.run()
    again = Build(Snapshots(spark, store.root), STEPS)
    assert list(did(again).values()) == ["skipped"] * (at - 1) + ["ran"] * (4 - at)
    same(again, fresh(spark, tmp_path, changed))
    store.sweep(1)
    same(again, fresh(spark, tmp_path, changed))


def test_damage_is_found_and_mended(spark, store, tmp_path):
    build = Build(store, STEPS)
    build.run()
    part = sorted(store.manifest()["tables"]["label"]["parts"].values(), key=lambda p: p["path"])[0]
    store._store().delete(store._path(part["path"]), True)
    assert did(build) == dict.fromkeys(("cut", "label", "total"), "skipped")
    assert did(build, verify=True) == {"cut": "skipped", "label": "ran", "total": "skipped"} and len(CALLS[0][1]) == 1
    same(build, fresh(spark, tmp_path, RULES))


def test_rows_outside_the_asked_partitions_are_refused(spark, store):
    def stray(spark, tables):
        return tables["rules"].withColumn("brand_id", F.lit("elsewhere"))

    version = store.manifest()["version"]
    with pytest.raises(ValueError, match="outside"):
        Build(store, (Step("stray", ("rules",), stray),)).run()
    assert store.manifest()["version"] == version and "stray" not in store.manifest()["tables"]
    with pytest.raises(ValueError, match="later step"):
        Build(store, (STEPS[1], STEPS[0]))
    with pytest.raises(ValueError, match="one name"):
        Build(store, (STEPS[0], STEPS[0]))


def test_a_step_may_become_whole_and_back(spark, store, tmp_path):
    build = Build(store, STEPS)
    build.run()
    whole = Build(store, (STEPS[0], Step("label", ("cut", "words"), label, by_part=False), STEPS[2]))
    assert did(whole)["label"] == "ran" and did(whole)["label"] == "skipped"
    assert did(build)["label"] == "ran" and did(build)["label"] == "skipped"
    same(build, fresh(spark, tmp_path, RULES))
