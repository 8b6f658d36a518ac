"""Validation of a catalogue of entities, and small operators around it."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from . import facets as B


def first_per_id(rows: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows with each id once, the first by ``order``; duplicates with their number)."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = rows.withColumn("_n", F.row_number().over(w))
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return numbered.where("_n = 1").drop("_n"), twice


def known_refs(rows: DataFrame, key: str, array: str, targets: DataFrame, target_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``array`` has known ids only, null rather than empty if none was known; dangling (key, ref))."""
    long = rows.where(F.col(array).isNotNull()).select(F.col(key).alias("_k"), F.posexplode(array).alias("_at", "_ref"))
    ids = targets.select(F.col(target_key).alias("_ref")).distinct()
    kept = long.join(ids, "_ref", "left_semi").groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_ref"))), lambda x: x["_ref"]).alias("_kept"))
    dangling = long.join(ids, "_ref", "left_anti").select(F.col("_k").alias(key), F.col("_ref").alias("ref"))
    joined = rows.join(kept, rows[key] == kept["_k"], "left").withColumn(array, F.col("_kept")).drop("_k", "_kept")
    return joined, dangling


def known_ref(rows: DataFrame, column: str, targets: DataFrame, target_key: str) -> DataFrame:
    """``rows`` with ``column`` null where it names no target."""
    ids = targets.select(F.col(target_key).alias("_ref")).distinct().withColumn("_known", F.lit(True))
    joined = rows.join(ids, rows[column] == ids["_ref"], "left")
    return joined.withColumn(column, F.when(F.col("_known"), F.col(column))).drop("_ref", "_known")


def validated_rules(raw: DataFrame, classes: list[str], hardness: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rules, warnings): rules without a text are left out, classes and hardness coerced, references read from the effect.

    ``raw``: id, rule_class, hardness, rule_text, effect. Warnings: (id, field, raw).
    """
    kept = raw.where(F.trim(F.coalesce("rule_text", F.lit(""))) != "")
    class_, new = B.discover(F.col("rule_class"), classes)
    hard, defaulted = B.coerce(F.col("hardness"), sorted({"hard_constraint", "strong_default", "soft_guidance"}), hardness, "soft_guidance")
    marked = kept.withColumns({"_class": class_, "_new": new, "_hard": hard, "_defaulted": defaulted})
    refs = S.ids_in(F.coalesce("effect", F.lit("")))
    rules = marked.select(
        "id", F.col("_class").alias("rule_class"), F.col("_hard").alias("hardness"), "rule_text",
        F.filter(refs, lambda r: r.startswith("tok_")).alias("token_ids"), F.filter(refs, lambda r: r.startswith("ast_")).alias("asset_ids"),
    )
    lost = marked.where(F.col("_class").isNull() & F.col("rule_class").isNotNull()).select("id", F.lit("rule_class").alias("field"), F.col("rule_class").alias("raw"))
    odd = marked.where("_defaulted").select("id", F.lit("hardness").alias("field"), F.col("hardness").alias("raw"))
    return rules, lost.unionByName(odd)


def templates(rows: DataFrame, fills: str | None = None, group: str | None = None) -> DataFrame:
    """Templates that fill a section, or of a group, or both."""
    out = rows
    if fills:
        out = out.where(B.overlaps(F.col("fills_section_types"), [fills]))
    return out.where(F.col("group_id") == group) if group else out


def library(rows: DataFrame, kind: str = "EMAIL") -> DataFrame:
    """Template library rows of one kind, whatever its case."""
    return rows.where(F.upper("type") == kind.upper())


def inherited_tags(owners: DataFrame, words: DataFrame, body: str) -> DataFrame:
    """Tags of assets that a body names: (id, tags). ``words``: (keyword, tag); a body is split once and meets keywords by equality."""
    spoken = owners.select("id", F.explode(F.array_distinct(S.words(F.col(body)))).alias("keyword"))
    return spoken.join(words, "keyword").groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def dissent(rows: DataFrame, group: str, run: str, units: str, champion: str) -> DataFrame:
    """Units that other runs give a group and the champion's run doesn't."""
    own = F.flatten(F.collect_list(F.when(F.col(run) == champion, F.col(units))))
    others = F.flatten(F.collect_list(F.when(F.col(run) != champion, F.col(units))))
    return rows.groupBy(group).agg(F.array_sort(F.array_except(others, own)).alias("units"))


def numbered(rows: DataFrame, prefix: str, group: str, order: list[str]) -> DataFrame:
    """Ids like ``x_0001`` in order within each group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("finding_id", F.concat(F.lit(prefix), F.format_string("_%04d", n)))


def acceptance(checks: DataFrame, open_items: DataFrame) -> DataFrame:
    """One row: whether all checks passed and nothing is open, and both numbers."""
    a = checks.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"), F.count_if(~F.col("passed")).alias("failed"))
    b = open_items.agg(F.count("*").alias("open"))
    # single rows
    return a.join(F.broadcast(b)).select((F.col("all_passed") & (F.col("open") == 0)).alias("accepted"), "failed", "open")


def metrics(rows: DataFrame, group: str, measures: dict[str, Column]) -> DataFrame:
    """Named aggregates of each group as rows (group, metric, value)."""
    wide = rows.groupBy(group).agg(*[m.cast("double").alias(n) for n, m in measures.items()])
    return wide.unpivot(group, list(measures), "metric", "value")


def render_units(units: DataFrame, group: str, order: str, target: Column) -> DataFrame:
    """Units of a group as one text: ``[id] (kind) ROLE text`` in order, each on a line of its own."""
    role = F.when(target, "TARGET").otherwise("context")
    line = F.concat(F.lit("["), "unit_id", F.lit("] ("), "kind", F.lit(") "), role, F.lit(" "), F.regexp_replace("text", r"\n$", ""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    return units.groupBy(group).agg(F.array_join(lines, "\n").alias("rendered"))


def coverage_line(longest: int = 110) -> Column:
    """A rule on one line: id, sections or ALL, hardness, severity, whether it is conditional, summary."""
    sections = F.when(F.col("section_types").isNull(), "ALL").otherwise(F.array_join("section_types", ","))
    return F.concat(
        F.concat_ws(
            " | ", "id", F.concat(F.lit("sections="), sections), F.concat(F.lit("hardness="), "hardness"), F.concat(F.lit("gov_severity="), "severity"),
            F.when(F.col("applies_kind").isNotNull(), "conditional"),
        ),
        F.lit(" :: "), F.substring(F.coalesce("summary", "rule_text"), 1, longest),
    )


def chunks(rows: DataFrame, group: str, order: str, text: str, most: int = 120_000) -> DataFrame:
    """Rows in chunks by a running length within the group: a chunk begins where the sum passes another ``most`` characters."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("chunk", F.floor((F.sum(F.length(text)).over(w) - 1) / most))


def reports(rows: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean reports, unknown ids): evidence of at most 200 characters, confidence 0.5 where none is given."""
    known = rows.join(rules.select("id"), "id", "left_semi")
    clean = known.select("id", F.substring(F.coalesce("evidence", F.lit("")), 1, 200).alias("evidence"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
    return clean, rows.join(rules, "id", "left_anti").select("id").distinct()


def shard(rules: DataFrame, shards: dict[str, list[str]]) -> DataFrame:
    """(id, shard) of the shards whose classes or tags a rule has."""
    known = F.array_append(F.coalesce("tags", F.array().cast("array<string>")), F.col("rule_class"))
    fits = F.array_compact(F.array(*[F.when(B.overlaps(known, names), F.lit(s)) for s, names in shards.items()]))
    return rules.select("id", F.explode(fits).alias("shard"))


def loose_json(text: str | None) -> str | None:
    """The first JSON object in a text that may have fences or words around it, written plainly; null if there is none."""
    if text is None:
        return None
    fenced = re.search(r"```(?:json)?\s*\n(.*?)```", text, re.DOTALL)
    for part in ([fenced[1]] if fenced else []) + [text]:
        for at in (m.start() for m in re.finditer(r"[{\[]", part)):
            try:
                value, _ = json.JSONDecoder().raw_decode(part[at:])
            except ValueError:
                continue
            return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return None


loose_json_udf = F.udf(lambda text: loose_json(text), T.StringType())


def render_section(order: Column, headline: Column, outline: Column, fact: Column) -> Column:
    """A blueprint section as text; absent parts are left out."""
    return F.concat_ws(
        "\n", F.concat(F.lit("Section "), order.cast("string")), F.concat(F.lit("Headline: "), headline), F.concat(F.lit("Copy: "), outline), F.concat(F.lit("Fact: "), fact)
    )


def screened(findings: DataFrame, verified: DataFrame) -> DataFrame:
    """Findings of invention or distortion against a verified entity are rejected without further ado."""
    ok = verified.select(F.col("entity_id").alias("_ok")).distinct()
    joined = findings.join(ok, findings.target == ok["_ok"], "left")
    bad = F.col("_ok").isNotNull() & F.col("kind").isin("fabrication", "distortion")
    return joined.withColumn("resolution", F.when(bad, "rejected").otherwise(F.col("resolution"))).drop("_ok")


def determinism(runs: DataFrame, subject: str, order: str) -> DataFrame:
    """``runs`` with ``status``: fail where the fingerprint differs from the one recorded for the same inputs.

    ``runs``: ``subject``, ``order``, signature, fingerprint. The record is that
    of the first run since the signature last changed.
    """
    turn = Window.partitionBy(subject).orderBy(order)
    changed = runs.withColumn("_new", ~F.col("signature").eqNullSafe(F.lag("signature").over(turn)) | (F.row_number().over(turn) == 1))
    since = changed.withColumn("_since", F.sum(F.col("_new").cast("int")).over(turn))
    first = F.first("fingerprint").over(Window.partitionBy(subject, "_since").orderBy(order))
    same = F.col("fingerprint").eqNullSafe(first)
    return since.withColumn("status", F.when(same, "pass").otherwise("fail")).drop("_new", "_since")


def from_cache(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that the cache has, with its columns; rows to be made)."""
    once = cache.dropDuplicates([key])
    return wanted.join(once, key), wanted.join(once, key, "left_anti")


def settings(layers: list[DataFrame]) -> DataFrame:
    """(name, value, layer): of each setting the value of the first layer that gives one; layers: name, value."""
    rows = None
    for n, layer in enumerate(layers):
        one = layer.select("name", "value", F.lit(n).alias("layer")).where("value IS NOT NULL")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("name").agg(F.min_by("value", "layer").alias("value"), F.min("layer").alias("layer"))


def summary_text(counts: DataFrame, group: str, kind: str, n: str) -> DataFrame:
    """(group, text): ``3 rules, 1 asset`` and so on, in order of kinds; there are a few kinds."""
    one = F.concat(F.col(n).cast("string"), F.lit(" "), F.col(kind), F.when(F.col(n) == 1, "").otherwise("s"))
    return counts.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(kind).alias("k"), one.alias("t")))), lambda x: x["t"]), ", ").alias("text"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.DoubleType())])))
def flattened_numbers(document: pd.Series) -> pd.Series:
    """Numbers of a JSON object by dotted path; truth values are 1 and 0, texts, lists and nulls are left out."""

    def walk(value, above):
        for name, v in value.items():
            path = f"{above}.{name}" if above else name
            if isinstance(v, dict):
                yield from walk(v, path)
            elif isinstance(v, (int, float)):
                yield {"path": path, "value": float(v)}

    def one(text):
        try:
            found = json.loads(text)
        except (TypeError, ValueError):
            return []
        return list(walk(found, "")) if isinstance(found, dict) else []

    return document.map(one)
