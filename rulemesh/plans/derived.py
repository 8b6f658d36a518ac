"""Knowledge-base shaped tables made from the star-schema tables.

Each column is one expression that Spark SQL and ANSI engines read alike, so
queries and their SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NONE = "array_intersect(split('a', ','), split('b', ','))"

PART = {
    "id": "'rule_' || p_partkey",
    "n": "p_partkey",
    "rule_class": "lower(p_type)",
    "tags": "CASE WHEN p_size % 9 = 0 THEN NULL ELSE split(p_name, ' ') END",
    "audience": "CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN 'hcp' ELSE 'patient' END",
    "content_types": "CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN split('email,web', ',') ELSE split('web', ',') END",
    "content_sub_type_ids": "CASE WHEN p_partkey % 5 <> 0 THEN NULL ELSE split('sub_' || (p_partkey % 7), ',') END",
    "section_types": "CASE WHEN p_size % 6 = 0 THEN NULL WHEN p_size % 6 = 5 THEN " + _NONE
    + " ELSE split('sec_' || (p_size % 6) || ',sec_' || ((p_size + p_partkey) % 6), ',') END",
    "applies_kind": "CASE WHEN p_partkey % 4 = 0 THEN 'position_in_email' WHEN p_partkey % 4 = 1 THEN 'content_tag' ELSE NULL END",
    "hardness": "CASE WHEN p_size % 3 = 0 THEN 'hard_constraint' WHEN p_size % 3 = 1 THEN 'strong_default' ELSE 'soft_guidance' END",
    "severity": "CASE WHEN p_partkey % 11 = 0 THEN 'block' WHEN p_partkey % 11 = 1 THEN 'warn' ELSE NULL END",
    "gov_type": "CASE WHEN p_partkey % 11 < 2 THEN 'Legal' ELSE NULL END",
    "constraint_type": "CASE WHEN p_partkey % 6 = 0 THEN 'binding' WHEN p_partkey % 6 = 1 THEN 'ordering' ELSE NULL END",
    "rule_text": "p_name || ' must use ' || p_brand || ' at ' || p_size || 'px in every ' || lower(p_type) || ' section'",
    "summary": "CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'use ' || p_brand END",
    "element_path": "replace(p_name, ' ', '.') || CASE WHEN p_size % 2 = 0 THEN '.color' ELSE '' END",
    "value": "p_brand",
    "token_ids": "split('tok_' || (p_partkey % 60) || ',tok_' || ((p_partkey * 7) % 130), ',')",
    "group_id": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'grp_' || (p_partkey % 200) END",
    "precedence": "p_size % 2",
}
SUPPLIER = {
    "id": "'tok_' || s_suppkey",
    "n": "s_suppkey",
    "kind": "CASE WHEN s_suppkey % 2 = 1 THEN 'semantic' ELSE 'primitive' END",
    "token_type": "CASE WHEN s_suppkey % 3 = 0 THEN 'color' WHEN s_suppkey % 3 = 1 THEN 'spacing' ELSE 'fontweight' END",
    "key": "'brand.' || s_nationkey || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '.k' || s_suppkey END",
    "value": "CASE WHEN s_suppkey % 3 = 0 THEN '#AB' || (s_suppkey % 10) WHEN s_suppkey % 3 = 1 THEN (s_suppkey % 40) || '.50 PX' ELSE 'Semi-Bold' END",
    "ref": "CASE WHEN s_suppkey % 7 = 3 THEN 'tok_' || (s_suppkey + 1000000) WHEN s_suppkey % 2 = 1 THEN 'tok_' || CAST(floor(s_suppkey / 2) AS BIGINT) ELSE NULL END",
    "gated": "s_suppkey % 5 = 0",
    "scope": "CASE WHEN s_suppkey % 10 = 0 THEN 'campaign' ELSE 'org_baseline' END",
    "element_paths": "CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE split('cta.' || s_nationkey || ',body.' || s_nationkey, ',') END",
}
#: Verdicts: which run (order status) put which rule into which section (priority).
ORDERS = {
    "run": "o_orderstatus",
    "section": "o_orderpriority",
    "rule_id": "'rule_' || (o_custkey % 97)",
    "ord": "o_orderkey",
    "why": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'order ' || o_orderkey END",
}
TABLES = {"rules": ("part", PART), "tokens": ("supplier", SUPPLIER), "verdicts": ("orders", ORDERS)}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = TABLES[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def cte(*names: str) -> str:
    """The same tables for a SQL text: ``WITH`` and their definitions."""
    parts = []
    for name in names:
        source, columns = TABLES[name]
        parts.append(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})")
    return "WITH " + ",\n".join(parts)
