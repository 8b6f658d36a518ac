"""Commits that are stopped at any step, concurrent ones, and what is written again."""

import pytest

from rulemesh.sources.snapshots import Conflict, Snapshots


def rows(spark, data):
    return spark.createDataFrame(data, "id string, brand_id string, n long, tags array<string>")


ONE = [("a", "x", 1, ["t"]), ("b", "x", 2, None), ("c", "y", 3, []), ("d", None, 4, None)]
TWO = [("a", "x", 1, ["t"]), ("b", "x", 9, None), ("c", "y", 3, []), ("d", None, 4, None)]


def table(s, name="rules", version=None):
    return sorted(map(tuple, s.read(name, version).collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/kb")


def test_only_changed_parts_are_written(spark, store):
    assert sorted(store.commit({"rules": rows(spark, ONE), "edges": spark.createDataFrame([(1, 2)], "src long, dst long")})["rules"]) != []
    first = store.manifest()
    written = store.commit({"rules": rows(spark, TWO).repartition(3)})
    assert len(written["rules"]) == 1 and store.versions() == [1, 2]
    same = [p for p, x in store.manifest()["tables"]["rules"]["parts"].items() if first["tables"]["rules"]["parts"][p] == x]
    assert len(same) == 2 and store.manifest()["tables"]["edges"] == first["tables"]["edges"]
    assert table(store) == sorted(TWO, key=str) and table(store, version=1) == sorted(ONE, key=str)
    assert store.commit({"rules": rows(spark, TWO)}) == {"rules": []} and store.versions() == [1, 2]


def test_parts_tables_and_columns_come_and_go(spark, store):
    store.commit({"rules": rows(spark, ONE), "old": rows(spark, ONE)})
    store.commit({"rules": rows(spark, ONE[:2])}, drop=("old",))
    assert table(store) == sorted(ONE[:2], key=str) and set(store.manifest()["tables"]) == {"rules"}
    store.commit({"rules": rows(spark, [])})
    assert table(store) == [] and store.read("rules").columns == ["id", "brand_id", "n", "tags"]
    assert store.commit({"rules": rows(spark, ONE[:2]).drop("tags")})["rules"] and store.read("rules").columns == ["id", "brand_id", "n"]
    assert table(store, "old", 1) == sorted(ONE, key=str)


@pytest.mark.parametrize("step", ["_prints", "_write", "_create", "_publish", "after"])
def test_a_commit_that_is_stopped_leaves_a_whole_version(spark, store, monkeypatch, step):
    store.commit({"rules": rows(spark, ONE), "more": rows(spark, ONE)})
    whole, calls = getattr(Snapshots, step if step != "after" else "_publish"), []

    def stopped(self, *args):
        calls.append(1)
        if step == "after":
            whole(self, *args)
        if len(calls) == (2 if step in ("_prints", "_write") else 1):  # the second table's step
            raise OSError("stopped")
        return whole(self, *args)

    with monkeypatch.context() as patch:
        patch.setattr(Snapshots, step if step != "after" else "_publish", stopped)
        with pytest.raises(OSError):
            store.commit({"rules": rows(spark, TWO), "more": rows(spark, TWO)})
    want = sorted(TWO if step == "after" else ONE, key=str)
    assert table(store) == want and table(store, "more") == want
    store.commit({"rules": rows(spark, TWO), "more": rows(spark, TWO)})
    store.commit({"rules": rows(spark, ONE[:1]), "more": rows(spark, ONE[:1])})
    store.sweep(1)
    assert table(store) == table(store, "more") == ONE[:1] and len(store.versions()) == 1
    left = {p["path"].rsplit("/", 1)[0] for t in store.manifest()["tables"].values() for p in t["parts"].values()}
    assert {f"data/{t}/{f}" for t in store._names("data") for f in store._names("data", t)} == left
    assert not [n for n in store._names("manifests") if n.startswith(".")]


def test_of_two_commits_one_wins(spark, store, monkeypatch):
    store.commit({"rules": rows(spark, ONE)})
    write = Snapshots._write

    def overtaken(self, *args):
        monkeypatch.setattr(Snapshots, "_write", write)
        store.commit({"rules": rows(spark, ONE[:1])})
        return write(self, *args)

    monkeypatch.setattr(Snapshots, "_write", overtaken)
    with pytest.raises(Conflict):
        store.commit({"rules": rows(spark, TWO)})
    assert table(store) == ONE[:1]
    store.commit({"rules": rows(spark, TWO)})
    assert table(store) == sorted(TWO, key=str)
