"""Files, stages, reports and streams."""

import json

import pytest
from pyspark.sql import functions as F

from rulemesh.operators import aggregates as A
from rulemesh.plans import reports
from rulemesh.plans.stages import Runner, Stage, fingerprint
from rulemesh.sources import kb
from rulemesh.streaming import logs


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "tokens"
    root.mkdir()
    token = {"id": "tok_a", "token_type": "color", "kind": "primitive", "key": "a", "value": {"default": "#abc", "variants": None}, "element_paths": None, "aliases": [], "status": "active", "version": 1}
    (root / "tok_a.json").write_text(json.dumps(token, indent=1))
    (root / "tok_b.json").write_text(json.dumps(token | {"id": "tok_b", "value": {"default": {"$ref": "tok_a"}}, "element_paths": []}))
    (root / "_index.json").write_text('{"id": "index"}')
    (root / "broken.json").write_text("{no json")
    return root


def test_entities_of_a_folder(spark, folder):
    rows = {r.id: r for r in kb.read_entities(spark, str(folder), "tokens").collect()}
    assert set(rows) == {"tok_a", "tok_b"}
    assert rows["tok_a"].element_paths is None and rows["tok_b"].element_paths == []
    assert json.loads(rows["tok_b"].value) == {"default": {"$ref": "tok_a"}}
    assert kb.read_entities(spark, str(folder / "none"), "rules").count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        kb.read_entities(spark, str(folder), "tokens", strict=True).collect()


def test_references_in_values(spark, folder):
    rows = kb.read_entities(spark, str(folder), "tokens")
    ref = F.try_variant_get(F.try_parse_json("value"), '$.default["$ref"]', "string")
    assert {r.id: r.ref for r in rows.select("id", ref.alias("ref")).collect()} == {"tok_a": None, "tok_b": "tok_a"}


def test_lines_and_the_open_log(spark, tmp_path):
    rows = spark.createDataFrame([("q", "k1", "open"), ("q", "k2", "done")], "queue string, key string, status string")
    path = str(tmp_path / "log")
    kb.append_open(rows, path)
    kb.append_open(rows, path)
    back = kb.read_lines(spark, path, rows.schema)
    assert sorted(map(tuple, back.collect())) == [("q", "k1", "open")] * 2
    kb.write_lines(rows, path)
    assert kb.read_lines(spark, path, rows.schema).count() == 2


def test_tables_replace_only_their_partitions(spark, tmp_path):
    schema = "id string, brand_id string"
    kb.write_tables({"rules": spark.createDataFrame([("a", "x"), ("b", "y")], schema)}, str(tmp_path))
    kb.write_tables({"rules": spark.createDataFrame([("c", "x")], schema)}, str(tmp_path))
    assert sorted(r.id for r in kb.read_tables(spark, str(tmp_path), ["rules"])["rules"].collect()) == ["b", "c"]


def test_vocabulary_upsert_and_blobs(spark):
    core = spark.createDataFrame([("section", "hero", ["x"]), ("section", "cta", [])], "domain string, name string, brands array<string>")
    found = spark.createDataFrame([("section", "hero", "y"), ("section", "new", "y")], "domain string, name string, brand string")
    assert {r.name: r.brands for r in kb.vocabulary(core, found).collect()} == {"hero": ["x", "y"], "cta": [], "new": ["y"]}
    bible = spark.createDataFrame([("c", ["one", "two"])], "category string, blobs array<string>")
    assert sorted(map(tuple, kb.blobs(bible).collect())) == [("c[0]", "one"), ("c[1]", "two")]


def test_stages_run_once_and_again_when_something_changes(spark, tmp_path):
    source = spark.range(5)
    stages = [Stage("double", ("n",), lambda s, t: t["n"].selectExpr("id * 2 AS id")), Stage("sum", ("double",), lambda s, t: t["double"].agg(F.sum("id").alias("s")))]
    runner = Runner(spark, str(tmp_path), stages)
    assert runner.run({"n": source}) == {"double": "ran", "sum": "ran"}
    assert runner.run({"n": source.repartition(3)}) == {"double": "skipped", "sum": "skipped"}
    spark.range(1).write.mode("overwrite").parquet(f"{tmp_path}/sum")
    assert runner.run({"n": source}) == {"double": "skipped", "sum": "ran"}
    assert runner.run({"n": spark.range(6)}) == {"double": "ran", "sum": "ran"}
    runner.stages[1] = Stage("sum", ("double",), stages[1].make, version="2")
    assert runner.run({"n": spark.range(6)}, wanted={"double"}) == {"double": "skipped", "sum": "left out"}
    assert runner.run({"n": spark.range(6)}) == {"double": "skipped", "sum": "ran"}
    with pytest.raises(ValueError):
        Runner(spark, str(tmp_path), [Stage("x", ("nowhere",), stages[0].make)]).run({})


def test_fingerprints_ignore_order_only(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "a int, b string")
    assert fingerprint(a) == fingerprint(a.repartition(3).orderBy(F.desc("b"))) != fingerprint(a.distinct())


def test_reports(spark):
    rows = spark.createDataFrame([("b|c", 1), ("a", None)], "source string, q int")
    text = reports.coverage(A.coverage(rows, "source", F.lit(True), F.coalesce(F.col("q") == 1, F.lit(False))), "source")
    assert text == "# Coverage\n\n| source | required | covered | share |\n| --- | --- | --- | --- |\n| all | 2 | 1 | 50.0% |\n| a | 1 | 0 | 0.0% |\n| b\\|c | 1 | 1 | 100.0% |\n"
    conflicts = spark.createDataFrame([("p", "a", "b", "hard_hard")], "element_path string, a_id string, b_id string, kind string")
    assert "| hard_hard | p | a | b |" in reports.conflicts(conflicts)


def test_streams_equal_their_batch_twins(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = str(tmp_path / "log")
    events.repartition(3).write.parquet(path)
    stream = logs.read_log(spark, path, events)
    windows = logs.run_to_memory(logs.window_counts(stream), "window_counts_test", "complete")
    plain = logs.window_counts(events)
    key = lambda r: (r.window_start, r.event_type)
    assert [(*key(r), r.n) for r in sorted(windows.collect(), key=key)] == [(*key(r), r.n) for r in sorted(plain.collect(), key=key)]
    stream = logs.read_log(spark, path, events, files_per_trigger=1)
    query = logs.keep_latest(stream, ["user_id", "event_type"], "event_id", str(tmp_path / "latest"), str(tmp_path / "state"))
    query.awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "latest").iterdir() if p.name.isdigit())
    found = spark.read.parquet(f"{tmp_path}/latest/{last}").select("user_id", "event_type", "event_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, logs.latest_per_key(events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id").collect()))


def test_repeated_content_is_dropped_from_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").limit(50)
    path = str(tmp_path / "log")
    events.unionByName(events).write.parquet(path)
    fresh = logs.new_content(logs.read_log(spark, path, events), ["user_id", "event_type", "props", "value"], late="60 days")
    assert logs.run_to_memory(fresh, "new_content_test").count() == events.select("user_id", "event_type", "props", "value").distinct().count()


def test_a_document_and_lines_replace_older_ones(spark, tmp_path):
    path = f"{tmp_path}/one.json"
    kb.write_document(spark, {"b": 1, "a": "é"}, path)
    kb.write_document(spark, {"b": 2, "a": "é"}, path)
    assert open(path, encoding="utf-8").read() == '{\n  "a": "é",\n  "b": 2\n}\n'
    rows = spark.createDataFrame([(1, "x")], "b int, a string")
    kb.write_lines(rows, f"{tmp_path}/lines")
    kb.write_lines(spark.read.json(f"{tmp_path}/lines").withColumn("b", F.col("b") + 1), f"{tmp_path}/lines")  # reads what it replaces
    assert [r.asDict() for r in spark.read.json(f"{tmp_path}/lines").collect()] == [{"a": "x", "b": 2}]


def test_results_of_runs_from_a_folder_or_a_file(spark, tmp_path):
    for name in ("r1", "r2"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"section": name, "rules": ["a"]}, indent=1))
    kind = kb.T.StructType.fromDDL("section string, rules array<string>")
    assert sorted((r.run, r.section) for r in kb.read_runs(spark, str(tmp_path), kind).collect()) == [("r1", "r1"), ("r2", "r2")]
    assert [r.run for r in kb.read_runs(spark, f"{tmp_path}/r2.json", kind).collect()] == ["r2"]


def test_markdown_as_html():
    text = "# A & b\n\n## Deep `x<y`\n- one **two**\n- three\n\n- four\n| h | i |\n| --- | :-: |\n| 1 | `2` |\nplain\nnext  \n"
    assert reports.html_of(text).split("\n") == [
        "<h2>A &amp; b</h2>", "<h3>Deep <code>x&lt;y</code></h3>", "<ul>", "<li>one <strong>two</strong></li>", "<li>three</li>", "</ul>", "<ul>", "<li>four</li>", "</ul>",
        "<table>", "<thead><tr><th>h</th><th>i</th></tr></thead>", "<tbody>", "<tr><td>1</td><td><code>2</code></td></tr>", "</tbody></table>", "<p>plain</p>", "<p>next</p>",
    ]
    assert reports.html_of("") == "" and reports.html_of("| a |\n| b |") == "<table>\n<thead><tr><th>a</th></tr></thead>\n<tbody>\n<tr><td>b</td></tr>\n</tbody></table>"
    assert reports.html_of("#no\n-no") == "<p>#no</p>\n<p>-no</p>"


def test_schema_documents_by_name(spark, tmp_path):
    (tmp_path / "rule.md").write_text("# Rule\n\ntext\n")
    (tmp_path / "other.txt").write_text("x")
    assert [(r.name, r.text) for r in kb.schema_docs(spark, str(tmp_path)).collect()] == [("rule", "# Rule\n\ntext\n")]
    assert kb.schema_docs(spark, f"{tmp_path}/none").count() == 0
