"""Design tokens as a W3C-style tree, and back."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import graph

# Our token types and the declared types of the exchange format.
DECLARED = {
    "color": "color", "gradient": "gradient", "spacing": "dimension", "padding": "dimension", "margin": "dimension",
    "size": "dimension", "radius": "dimension", "breakpoint": "dimension", "dimension": "dimension", "font": "fontFamily",
    "fontfamily": "fontFamily", "fontweight": "fontWeight", "weight": "fontWeight", "type_scale": "typography",
    "shadow": "shadow", "border": "border", "number": "number", "opacity": "number", "ratio": "number", "line_height": "number",
}


def declared_type(token_type: Column) -> Column:
    """The exchange format's type, null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for p in DECLARED.items() for x in p]), F.lower(token_type))


def alias(path: Column) -> Column:
    return F.concat(F.lit("{"), path, F.lit("}"))


def leaves(tokens: DataFrame) -> DataFrame:
    """(id, path, type, value): each token's place in the tree and its value, references as aliases of places.

    ``tokens``: id, key, token_type, value, ref.
    """
    placed = graph.assigned_paths(tokens, "key").withColumnRenamed("assigned", "path")
    targets = placed.select(F.col("id").alias("_target"), F.col("path").alias("_path"))
    joined = placed.join(targets, placed.ref == F.col("_target"), "left")
    value = F.when(F.col("ref").isNotNull(), alias(F.col("_path"))).otherwise(S.normalise(F.col("token_type"), F.col("value")))
    return joined.select("id", "path", declared_type(F.col("token_type")).alias("type"), value.alias("value"))


def modes(variants: DataFrame) -> DataFrame:
    """(mode, token_id, value) of variants with a single axis; others have no mode of their own."""
    single = variants.where(F.size("when") == 1).select("token_id", "value", F.explode("when").alias("axis", "allowed"))
    rows = single.select("token_id", "value", "axis", F.explode("allowed").alias("of"))
    return rows.select(S.mode_file(F.col("axis"), F.col("of")).alias("mode"), "token_id", "value")


def nested(rows: list[tuple[str, str, str]]) -> dict[str, Any]:
    """A tree from (path, type, value) leaves."""
    tree: dict[str, Any] = {}
    for path, kind, value in sorted(rows):
        at = tree
        *groups, name = path.split(".")
        for group in groups:
            at = at.setdefault(group, {})
            if "$value" in at:
                raise ValueError(f"{path} lies below a leaf")
        if name in at:
            raise ValueError(f"{path} is there already")
        at[name] = {"$type": kind, "$value": value} if kind else {"$value": value}
    return tree


def flattened(tree: dict[str, Any], above: str = "") -> list[tuple[str, str | None, Any]]:
    """Leaves of a tree: (path, type, value)."""
    out = []
    for name, node in sorted(tree.items()):
        if not name.startswith("$"):
            path = f"{above}.{name}" if above else name
            out += [(path, node.get("$type"), node["$value"])] if "$value" in node else flattened(node, path)
    return out


def export(tokens: DataFrame) -> str:
    """The tree as JSON. A brand's tokens are one document, so they are collected: at most 100,000."""
    rows = leaves(tokens).select("path", "type", "value").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("a token document holds at most 100,000 tokens")
    return json.dumps(nested([tuple(r) for r in rows]), sort_keys=True, ensure_ascii=False, indent=2)


def imported(tree: DataFrame, canonical: DataFrame) -> DataFrame:
    """(path, id, value, origin): canonical rows win, leaves without one are manual, rows without a leaf are lost.

    ``tree``: path, value; ``canonical``: path, id, value.
    """
    a = tree.select("path", F.col("value").alias("_leaf"), F.lit(True).alias("_in_tree"))
    b = canonical.select("path", "id", F.col("value").alias("_kept"), F.lit(True).alias("_known"))
    joined = a.join(b, "path", "full")
    origin = F.when(F.col("_known").isNull(), "manual").when(F.col("_in_tree").isNull(), "lost").otherwise("canonical")
    return joined.select("path", F.coalesce("id", F.concat(F.lit("tok_"), S.slugify(F.col("path")))).alias("id"), F.coalesce("_kept", "_leaf").alias("value"), origin.alias("origin"))


def propagated_types(tokens: DataFrame, kind: Column) -> DataFrame:
    """(id, type, status): a reference has the type of the token at its end; see ``graph.resolve_refs`` for status.

    ``tokens``: id, ref and what ``kind`` needs.
    """
    ends = graph.resolve_refs(tokens.select("id", "ref", kind.alias("_type")), value="_type")
    return ends.select("id", F.col("value").alias("type"), "status")


# Names of the exchange format for fields of composite values.
TYPOGRAPHY = {"font_family": "fontFamily", "font_size": "fontSize", "font_weight": "fontWeight", "line_height": "lineHeight", "letter_spacing": "letterSpacing"}
SHADOW = {"x": "offsetX", "y": "offsetY", "offset_x": "offsetX", "offset_y": "offsetY", "blur_radius": "blur", "spread_radius": "spread"}
LENGTHS = ("offsetX", "offsetY", "blur", "spread", "width", "fontSize")


def composite_fields(tokens: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, field, value) of shadows, borders and typographies: fields by their exchange names, values normalised, references as aliases.

    ``tokens``: id, token_type, value (a JSON object of fields); ``paths``: id,
    path. Of two spellings of a field the later counts. A typography has its
    five fields only. A reference to no token has a null value. Objects that
    aren't JSON have no fields.
    """
    fields = F.from_json("value", "map<string,string>")
    each = tokens.select("id", F.lower("token_type").alias("kind"), F.posexplode(F.map_entries(fields)).alias("at", "e")).select("id", "kind", "at", F.col("e.key").alias("name"), F.col("e.value").alias("raw"))
    named = {"type": TYPOGRAPHY, "shadow": SHADOW}
    typed, shaded = (F.create_map(*[F.lit(x) for p in names.items() for x in p]) for names in named.values())
    is_type = F.col("kind").isin("type_scale", "typography")
    field = F.when(is_type, F.coalesce(F.try_element_at(typed, "name"), "name")).when(F.col("kind") == "shadow", F.coalesce(F.try_element_at(shaded, "name"), "name")).otherwise(F.col("name"))
    known = each.withColumn("field", field).where(~is_type | F.col("field").isin(*TYPOGRAPHY.values()))
    last = known.groupBy("id", "field").agg(F.max_by("raw", "at").alias("raw")).withColumn("_ref", F.get_json_object("raw", "$.$ref"))
    targets = paths.select(F.col("id").alias("_target"), F.col("path").alias("_path"))
    joined = last.join(targets, F.col("_ref") == F.col("_target"), "left")
    return joined.select("id", "field", F.when(F.col("_ref").isNotNull(), alias(F.col("_path"))).otherwise(_field_value(F.col("field"), F.col("raw"))).alias("value"))


def _field_value(field: Column, raw: Column) -> Column:
    families = F.array_join(F.array_compact(F.transform(F.split(raw, ","), lambda x: F.nullif(F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", ""), F.lit("")))), ",")
    sized = F.regexp_replace(raw, r"\s+", "").rlike(r"(?i)^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:px|rem|em|%|pt)$")
    return (
        F.when(field == "color", S.color(raw))
        .when(field.isin(*LENGTHS), S.dimension(raw))
        .when(field == "fontWeight", S.weight(raw))
        .when(field == "fontFamily", families)
        .when(field.isin("lineHeight", "letterSpacing"), F.when(sized, S.dimension(raw)).otherwise(S.number(raw)))
        .when(field == "style", S.enum_text(raw))
        .otherwise(raw)
    )


def composites(tokens: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, value, lacking): the fields of each composite as JSON, and the names that a typography lacks."""
    fields = composite_fields(tokens, paths).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("_map"))
    wanted = F.when(F.lower("token_type").isin("type_scale", "typography"), F.array(*[F.lit(x) for x in sorted(TYPOGRAPHY.values())])).otherwise(F.array().cast("array<string>"))
    there = F.coalesce(F.map_keys("_map"), F.array().cast("array<string>"))
    return tokens.join(fields, "id", "left").select("id", F.to_json("_map").alias("value"), F.array_except(wanted, there).alias("lacking"))
