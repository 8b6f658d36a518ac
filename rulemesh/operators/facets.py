"""Projections, filters and predicates over rules and tokens.

Null selectors apply everywhere and empty ones nowhere; they are never mixed up.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def _texts(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def overlaps(column: Column, values: Iterable[str]) -> Column:
    """Whether an array has one of ``values``; false for null."""
    return F.coalesce(F.arrays_overlap(column, _texts(values)), F.lit(False))


def selects(column: Column, values: Iterable[str], null_too: bool = True) -> Column:
    """Whether a selector takes one of ``values``; a null selector takes all if ``null_too``."""
    return F.when(column.isNull(), null_too).otherwise(overlaps(column, values))


def filter_rules(
    rules: DataFrame,
    rule_class: list[str] | None = None,
    tags: list[str] | None = None,
    section_types: list[str] | None = None,
    content_sub_type_ids: list[str] | None = None,
    audience: list[str] | None = None,
    hardness: list[str] | None = None,
    has_governance: bool | None = None,
    gov_type: list[str] | None = None,
    include_all_section_rules: bool = True,
    include_all_subtype_rules: bool = True,
) -> DataFrame:
    """Rules that pass all facets given; within a facet any value will do.

    Empty lists are ignored, but for sections and sub-types they leave only
    rules with a null selector. A rule's class counts as one of its tags for
    ``rule_class``. ``gov_type`` is compared with the rule's in lower case.
    """
    out = rules
    if has_governance is not None:
        out = out.where((F.col("gov_type").isNotNull() | F.col("severity").isNotNull()) == has_governance)
    if gov_type:
        out = out.where(F.coalesce(F.lower("gov_type"), F.lit("")).isin(*gov_type))
    if rule_class:
        known = F.array_append(F.coalesce("tags", F.array().cast("array<string>")), F.col("rule_class"))
        out = out.where(overlaps(known, rule_class))
    if tags:
        out = out.where(overlaps(F.col("tags"), tags))
    if section_types is not None:
        out = out.where(selects(F.col("section_types"), section_types, include_all_section_rules))
    if content_sub_type_ids is not None:
        out = out.where(selects(F.col("content_sub_type_ids"), content_sub_type_ids, include_all_subtype_rules))
    if audience:
        out = out.where(F.col("audience").isNull() | F.col("audience").isin(*audience))
    if hardness:
        out = out.where(F.col("hardness").isin(*hardness))
    return out


def page(rows: DataFrame, key: str, offset: int = 0, size: int = 80) -> DataFrame:
    """One page by ``key`` with the count of all rows and the next page's offset, null on the last."""
    total = rows.agg(F.count("*").alias("total"))
    chosen = rows.orderBy(key).offset(offset).limit(size)
    # a single row
    paged = chosen.join(F.broadcast(total))
    return paged.withColumn("next_offset", F.when(F.col("total") > offset + size, F.lit(offset + size)))


def short_rules(rules: DataFrame, longest: int = 160) -> DataFrame:
    """Compact rows; a missing summary is the beginning of the text."""
    return rules.select("id", "rule_class", F.coalesce("summary", S.shortened(F.col("rule_text"), longest)).alias("summary"), "hardness")


def full_json(rows: DataFrame, key: str) -> DataFrame:
    """Each row as JSON without nulls."""
    return rows.select(F.col(key), F.to_json(F.struct(*rows.columns)).alias("json"))


def first_store(stores: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """An id's row in the first store that has it: (id, store)."""
    out = None
    for n, (name, rows) in enumerate(stores.items()):
        one = rows.select(F.col(key).alias("id"), F.lit(n).alias("at"), F.lit(name).alias("store"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("id").agg(F.min_by("store", "at").alias("store"))


def filter_tokens(
    tokens: DataFrame,
    token_type: list[str] | None = None,
    kind: str | None = None,
    gated: bool | None = None,
    key_contains: str = "",
    path_contains: str = "",
    scope_contains: str = "",
    limit: int = 100,
) -> DataFrame:
    """Tokens by type, kind, gate and parts of key, path or scope; the first ``limit`` by id, with the count of all."""
    out = tokens
    if token_type:
        out = out.where(F.col("token_type").isin(*[t.lower() for t in token_type]))
    if kind:
        out = out.where(F.col("kind") == kind)
    if gated is not None:
        out = out.where(F.col("gated") == gated)
    if key_contains:
        out = out.where(F.lower("key").contains(key_contains.lower()))
    if path_contains:
        out = out.where(F.exists("element_paths", lambda p: F.lower(p).contains(path_contains.lower())))
    if scope_contains:
        out = out.where(F.lower("scope").contains(scope_contains.lower()))
    total = out.agg(F.count("*").alias("total"))
    # a single row
    return out.orderBy("id").limit(limit).join(F.broadcast(total))


def variant_axes(variants: Column) -> Column:
    """Sorted names of the axes that an array of ``when`` maps uses."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(variants, F.map_keys))))


def baseline(rules: DataFrame, surface: str = "email", audience: str = "patient") -> DataFrame:
    """Rules nobody may leave out: unconditional, hard or blocking, of this surface and audience."""
    return rules.where(
        F.col("section_types").isNull()
        & F.col("applies_kind").isNull()
        & F.col("content_sub_type_ids").isNull()
        & ((F.col("hardness") == "hard_constraint") | F.coalesce(F.col("severity") == "block", F.lit(False)))
        & selects(F.col("content_types"), [surface])
        & (F.col("audience").isNull() | (F.col("audience") == audience))
    )


def candidates(rules: DataFrame, sections: list[str], positional: tuple[str, ...] = ("adjacent_section_state", "position_in_email")) -> DataFrame:
    """Rules that a result for ``sections`` has to account for."""
    return rules.where(selects(F.col("section_types"), sections) | F.coalesce(F.col("applies_kind").isin(*positional), F.lit(False)))


def coerce(raw: Column, vocabulary: list[str], aliases: dict[str, str], default: str) -> tuple[Column, Column]:
    """A value of a closed vocabulary, and whether that took the default."""
    key = F.lower(F.trim(raw))
    known = F.when(key.isin(*vocabulary), key)
    if aliases:
        known = F.coalesce(known, F.try_element_at(F.create_map(*[F.lit(x) for p in aliases.items() for x in p]), key))
    return F.coalesce(known, F.lit(default)), known.isNull()


def coerce_list(raw: Column, vocabulary: list[str]) -> Column:
    """Values of a vocabulary; null rather than an empty array."""
    kept = F.filter(raw, lambda v: v.isin(*vocabulary))
    return F.when(F.size(kept) > 0, kept)


def discover(raw: Column, vocabulary: list[str]) -> tuple[Column, Column]:
    """(value, newly found): known ones as they are, ``other.name`` as a new name, the rest null."""
    key = F.lower(F.trim(raw))
    new = F.regexp_extract(key, r"^other\.([a-z0-9_]+)$", 1)
    return F.when(key.isin(*vocabulary), key).when(new != "", new), (new != "") & ~key.isin(*vocabulary)


def prose(rows: DataFrame, *columns: str) -> Column:
    """The first of ``columns`` that isn't empty."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])


def sections(blueprint: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    """Sections of a blueprint; with ``chosen`` only those."""
    return blueprint if chosen is None else blueprint.where(F.col("section_id").isin(*chosen))
