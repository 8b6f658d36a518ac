"""Comparison and scoring of result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import jaccard, ratio
from .facets import baseline, candidates


def compare_runs(verdicts: DataFrame, run: str = "run", section: str = "section", item: str = "rule_id") -> DataFrame:
    """For each section and pair of runs the sizes of their sets and their Jaccard similarity; two empty sets are alike.

    Runs of one blueprint are few; their sets of one section are arrays.
    """
    sets = verdicts.groupBy(section, run).agg(F.collect_set(item).alias("items"))
    a = sets.withColumnsRenamed({run: "a", "items": "a_items"})
    b = sets.withColumnsRenamed({run: "b", "items": "b_items"})
    pairs = a.join(b, section).where("a < b")
    return pairs.select(section, "a", "b", F.size("a_items").alias("a_size"), F.size("b_items").alias("b_size"), jaccard(F.col("a_items"), F.col("b_items")).alias("jaccard"))


def agreement(verdicts: DataFrame, run: str = "run", section: str = "section", item: str = "rule_id") -> DataFrame:
    """For each section how many items all runs have, how many only one has, and how many there are."""
    runs = verdicts.groupBy(section).agg(F.countDistinct(run).alias("runs"))
    counted = verdicts.groupBy(section, item).agg(F.countDistinct(run).alias("n")).join(runs, section)
    return counted.groupBy(section).agg(
        F.count_if(F.col("n") == F.col("runs")).alias("by_all"), F.count_if(F.col("n") == 1).alias("by_one"), F.count("*").alias("union_size")
    )


def run_stats(rows: DataFrame, run: str, targeted: Column, wide: Column) -> DataFrame:
    """Averages of each run over its sections; a run without sections has averages of 0."""
    n = F.greatest(F.count("*"), F.lit(1))
    return rows.groupBy(run).agg(
        (F.coalesce(F.sum(targeted), F.lit(0)).cast("double") / n).alias("avg_targeted"), (F.coalesce(F.sum(wide), F.lit(0)).cast("double") / n).alias("avg_wide")
    )


def score(found: DataFrame, truth: DataFrame, group: str, item: str) -> DataFrame:
    """True and false positives, false negatives, precision and recall of each group."""
    a = found.select(group, item, F.lit(True).alias("_found")).distinct()
    b = truth.select(group, item, F.lit(True).alias("_true")).distinct()
    both = a.join(b, [group, item], "full")
    tp = F.count_if(F.col("_found") & F.col("_true"))
    n_found, n_true = F.count("_found"), F.count("_true")
    return both.groupBy(group).agg(
        tp.alias("tp"), (n_found - tp).alias("fp"), (n_true - tp).alias("fn"), ratio(tp, n_found).alias("precision"), ratio(tp, n_true).alias("recall")
    )


def finalize(rules: DataFrame, chosen: DataFrame, excluded: DataFrame, sections: list[str], surface: str = "email", audience: str = "patient") -> DataFrame:
    """What speaks against a result: (check, id), empty if it holds.

    ``chosen``: id, bucket (targeted or email_wide); ``excluded``: id, reason.
    Baseline rules may not be excluded; they count as chosen otherwise.
    """
    must = baseline(rules, surface, audience).select("id")
    named = chosen.select("id").unionByName(excluded.select("id")).distinct()
    included = chosen.select("id").unionByName(must).distinct()

    def problem(name: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(name).alias("check"), "id").distinct()

    out = problem("unknown", named.join(rules, "id", "left_anti"))
    checks = (
        problem("both_buckets", chosen.where("bucket = 'targeted'").join(chosen.where("bucket = 'email_wide'"), "id", "left_semi")),
        problem("contradicted", chosen.join(excluded, "id", "left_semi")),
        problem("no_reason", excluded.where("trim(coalesce(reason, '')) = ''")),
        problem("not_excludable", must.join(excluded, "id", "left_semi")),
        problem("unaccounted", candidates(rules, sections).join(included, "id", "left_anti").join(excluded, "id", "left_anti")),
    )
    for rows in checks:
        out = out.unionByName(rows)
    return out
