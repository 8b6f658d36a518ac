"""Markdown reports over small aggregates."""

from __future__ import annotations

import html
import itertools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a report; more are counted, not shown.
ROWS = 1000


def table(rows: DataFrame, columns: list[str], order: list[str]) -> str:
    """A Markdown table of the first ROWS rows in order, with the number of those left out."""
    from ..functions.scalars import cell

    chosen = rows.select(*[cell(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns], *[F.col(c).alias(f"_{n}") for n, c in enumerate(order)])
    found = chosen.orderBy(*[f"_{n}" for n in range(len(order))]).limit(ROWS + 1).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(r[c] for c in columns) + " |" for r in found[:ROWS]]
    if len(found) > ROWS:
        lines.append(f"\n{rows.count() - ROWS} more rows")
    return "\n".join(lines) + "\n"


def coverage(rows: DataFrame, group: str) -> str:
    """``aggregates.coverage`` as text, the total first."""
    shown = rows.withColumn("share", F.concat(F.format_string("%.1f", F.col("ratio") * 100), F.lit("%"))).withColumn(group, F.coalesce(group, F.lit("all")))
    return "# Coverage\n\n" + table(shown.withColumn("_first", -F.col("is_total")), [group, "required", "covered", "share"], ["_first", group])


def conflicts(rows: DataFrame) -> str:
    kinds = rows.groupBy("kind").agg(F.count("*").alias("n"))
    return "# Conflicts\n\n" + table(kinds, ["kind", "n"], ["kind"]) + "\n" + table(rows, ["kind", "element_path", "a_id", "b_id"], ["kind", "element_path", "a_id", "b_id"])


def findings(rows: DataFrame) -> str:
    counted = rows.groupBy("resolution", "severity").agg(F.count("*").alias("n"))
    return "# Findings\n\n" + table(counted, ["resolution", "severity", "n"], ["resolution", "severity"])


def _kind(line: str) -> str:
    bare = line.strip()
    if not bare:
        return "blank"
    for start, name in (("# ", "h2"), ("## ", "h3")):
        if line.startswith(start):
            return name
    return {"|": "table", "-": "list"}.get(bare[0] if bare[0] == "|" or bare.startswith("- ") else "", "p")


def _inline(text: str) -> str:
    out = html.escape(text, quote=False)
    for sign, tag in ((r"\*\*", "strong"), ("`", "code")):
        out = re.sub(f"{sign}(.+?){sign}", rf"<{tag}>\1</{tag}>", out)
    return out


def _rows(lines: list[str]) -> list[str]:
    head, *body = [[c.strip() for c in line.strip().strip("|").split("|")] for line in lines]
    if body and re.fullmatch(":?-+:?", body[0][0]):
        body = body[1:]
    row = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{_inline(c)}</{tag}>" for c in cells) + "</tr>"
    return ["<table>", f"<thead>{row('th', head)}</thead>", "<tbody>", *[row("td", cells) for cells in body], "</tbody></table>"]


def html_of(text: str) -> str:
    """Headings, lists, tables, bold, code and paragraphs of one line each; anything else is text."""
    out: list[str] = []
    for kind, group in itertools.groupby(text.splitlines(), _kind):
        lines = [line.rstrip() for line in group]
        if kind == "table":
            out += _rows(lines)
        elif kind == "list":
            out += ["<ul>", *[f"<li>{_inline(line.strip()[2:])}</li>" for line in lines], "</ul>"]
        elif kind != "blank":
            marks = {"h2": 2, "h3": 3}.get(kind, 0)
            out += [f"<{kind}>{_inline(line[marks:] if marks else line.strip())}</{kind}>" for line in lines]
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def markdown_html(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else html_of(x))
