"""Which bindings hold together somewhere, and which of them never win.

The values of an axis that the same bindings of a path accept are one class,
so a path's cells are combinations of classes, not of contexts and values. They
are made one axis after another: a cell's bindings meet the classes of the next
axis by path and value, and cells that are left with the same bindings become
one, so there are never more cells than sets of bindings that can hold together.
Only these sets decide who wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import guards as G
from .cascade import specificity
from .joins import tasks
from .steps import cut

#: The axis that stands for all of a context's tags together.
TAGS = "tags"


def _sums() -> list[Column]:
    return [F.sum(F.xxhash64(F.lit(n), "bid").cast("decimal(20,0)")) for n in (1, 2)]


def numbered(bindings: DataFrame) -> DataFrame:
    """``bindings`` that can hold at all, with a number ``bid``; null guards are empty."""
    canonical = bindings.withColumn("guard", G.canonical(F.col("guard")))
    return cut(canonical.where(~G.contradictory(F.col("guard"))).withColumn("bid", F.monotonically_increasing_id()))


def of_kinds(bindings: DataFrame) -> DataFrame:
    """Like ``numbered``, but bindings of a path with the same guard share their ``bid``: they hold in the same places.

    So there are as many to lay out as a path has guards, however many bindings it has.
    """
    canonical = bindings.withColumn("guard", G.canonical(F.col("guard")))
    rows = cut(canonical.where(~G.contradictory(F.col("guard"))).withColumn("_mark", F.to_json(F.struct("guard"))))
    kinds = cut(rows.select("element_path", "_mark").distinct().withColumn("bid", F.monotonically_increasing_id()))
    return cut(rows.join(kinds.hint("merge"), ["element_path", "_mark"]).drop("_mark"))


def _marks(terms: DataFrame, axis: str, domains: DataFrame, combinations: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(needs, marks, values) of an axis.

    ``needs``: (path, bid, need) of bindings that restrict it; one holds at a value if
    its marks there are ``need`` hits and no miss. ``values``: all there are.
    """
    if axis != TAGS:
        own = terms.where(F.col("axis") == axis).select("path", "bid", F.explode("allowed").alias("value"))
        known = domains.where(F.col("axis") == axis).select("value").distinct()
        if axis not in G.EMAIL_AXES:
            known = known.union(own.select("value")).distinct()
        marks = own.join(known, "value", "left_semi").select("path", "bid", "value", F.lit(1).alias("hits"), F.lit(0).alias("misses"))
        return own.select("path", "bid", F.lit(1).alias("need")).distinct(), marks, known
    own = terms.where(F.col("axis").startswith("tag:")).select("path", "bid", F.substring("axis", 5, 1 << 20).alias("tag"), "allowed")
    present, absent = F.array_contains("allowed", "present"), F.array_contains("allowed", "absent")
    own = own.where(~(present & absent)).withColumn("wanted", present)
    named = combinations.select(F.array_join(F.array_sort(F.array_distinct("tags")), "\u0000").alias("value"), F.array_distinct("tags").alias("tags")).distinct()
    met = named.select("value", F.explode("tags").alias("tag")).join(own, "tag")
    marks = met.groupBy("path", "bid", "value").agg(F.count(F.when(F.col("wanted"), 1)).alias("hits"), F.count(F.when(~F.col("wanted"), 1)).alias("misses"))
    needs = own.groupBy("path", "bid").agg(F.count(F.when(F.col("wanted"), 1)).alias("need"))
    return needs, marks, named.select("value")


def _classes(needs: DataFrame, marks: DataFrame, values: DataFrame) -> DataFrame:
    """(path, value): one value of each class of a path that restricts the axis; null stands for those that no guard names."""
    signed = marks.groupBy("path", "value").agg(
        *[F.sum(F.xxhash64(F.lit(n), "bid", "hits", "misses").cast("decimal(20,0)")).alias(f"s{n}") for n in (1, 2)]
    )
    named = signed.groupBy("path", "s1", "s2").agg(F.min("value").alias("value"), F.count("*").alias("n"))
    every = values.count()
    told = named.groupBy("path").agg(F.sum("n").alias("n"))
    paths = needs.select("path").distinct().join(told, "path", "left")
    unnamed = paths.where(F.coalesce("n", F.lit(0)) < every).select("path", F.lit(None).cast("string").alias("value"))
    return named.select("path", "value").unionByName(unnamed)


def cells(bindings: DataFrame, domains: DataFrame, combinations: DataFrame) -> DataFrame:
    """(path, cell, bid): the sets of ``numbered`` bindings, or ``of_kinds``, that hold together somewhere, each once.

    ``domains``: (axis, value). Audience, surface, campaign and theme have no
    other values than these, all other axes also those that guards name.
    ``combinations``: the sets of ``tags`` that occur. There is one step for each
    axis; axes are predicates of a vocabulary, hence few, and their names are
    what the driver sees.
    """
    kinds = cut(bindings.groupBy(F.col("element_path").alias("path"), "bid").agg(F.first("guard").alias("guard")))
    terms = cut(kinds.select("path", "bid", F.explode("guard").alias("axis", "allowed")))
    plain = terms.where(~F.col("axis").startswith("tag:")).select("axis").distinct()
    axes = [TAGS, *sorted(r["axis"] for r in plain.collect())]
    members = kinds.select("path", F.lit(0).cast("long").alias("cell"), "bid")
    for axis in axes:
        needs, marks, values = _marks(terms, axis, domains, combinations)
        marks = cut(marks)
        classes = cut(_classes(needs, marks, values))
        spread = members.join(classes, "path").join(needs, ["path", "bid"], "left")
        held = spread.join(marks, (spread.path == marks.path) & (spread.bid == marks.bid) & (spread.value == marks.value), "left").where(
            (F.coalesce("hits", F.lit(0)) == F.coalesce("need", F.lit(0))) & (F.coalesce("misses", F.lit(0)) == 0)
        )
        held = cut(held.select(spread.path, "cell", spread.value, spread.bid))
        sums = held.groupBy("path", "cell", "value").agg(F.xxhash64(*_sums(), F.count("*")).alias("new"))
        first = sums.groupBy("path", "new").agg(F.min(F.struct("cell", "value")).alias("at")).select("path", "new", "at.cell", "at.value")
        kept = held.join(first.withColumnsRenamed({"path": "p", "cell": "c", "value": "v"}), (F.col("path") == F.col("p")) & (F.col("cell") == F.col("c")) & F.col("value").eqNullSafe(F.col("v")))
        untouched = members.join(needs.select("path").distinct(), "path", "left_anti")
        members = cut(untouched.unionByName(kept.select("path", F.col("new").alias("cell"), "bid")))
    return members


def _specs(bindings: DataFrame) -> DataFrame:
    """Rows of bindings with their rank among those of their ``bid``: ``leads`` are first, maybe with others."""
    rows = bindings.select(F.col("element_path").alias("path"), "bid", "source_kind", "source_id", F.to_json(F.struct("value")).alias("value"), specificity().alias("spec"))
    best = rows.groupBy("path", "bid").agg(F.max("spec").alias("best"), F.count("*").alias("n"))
    # merged here and below: kinds can be as many as bindings, and a broadcast would pass them through the driver
    return cut(rows.join(best.hint("merge"), ["path", "bid"]).withColumn("leads", F.col("spec") == F.col("best")).drop("spec"))


def _winning(specs: DataFrame, members: DataFrame) -> DataFrame:
    """(path, cell, bid, candidates, conflict, first) of the kinds whose leading bindings rank first in their cell.

    In a conflict, leading ones of different values that only their ids tell apart, all of these win, else only ``first``.
    """
    leads = F.col("leads")
    told = specs.groupBy("path", "bid").agg(
        F.first("best").alias("best"), F.first("n").alias("n"), F.min(F.when(leads, F.col("value"))).alias("low"), F.max(F.when(leads, F.col("value"))).alias("high"), F.max(F.when(leads, F.col("source_id"))).alias("last")
    )
    held = members.join(told.hint("merge"), ["path", "bid"])
    top = held.groupBy("path", "cell").agg(F.max("best").alias("top"), F.sum("n").alias("candidates"))
    tied = held.join(top.hint("merge"), ["path", "cell"]).where(F.col("best") == F.col("top"))
    verdict = tied.groupBy("path", "cell").agg((F.min("low") != F.max("high")).alias("conflict"), F.max("last").alias("first"))
    return cut(tied.select("path", "cell", "bid", "candidates").join(verdict.hint("merge"), ["path", "cell"]))


def cell_winners(bindings: DataFrame, members: DataFrame) -> DataFrame:
    """(element_path, cell, candidates, conflict, winners) of each cell."""
    specs = _specs(bindings)
    leading = specs.where("leads").select("path", "bid", "source_id")
    rows = _winning(specs, members).join(leading.hint("merge"), ["path", "bid"]).where(F.col("conflict") | (F.col("source_id") == F.col("first")))
    found = rows.groupBy("path", "cell").agg(F.first("candidates").alias("candidates"), F.first("conflict").alias("conflict"), F.array_sort(F.collect_set("source_id")).alias("winners"))
    return found.withColumnRenamed("path", "element_path")


def never_winning(bindings: DataFrame, members: DataFrame) -> DataFrame:
    """(element_path, source_kind, source_id, shadowed_by) of bindings that hold somewhere and win nowhere.

    Who shadows them is the same for all bindings of a kind, so it is listed once for each kind.
    """
    specs = _specs(bindings)
    winning = _winning(specs, members)
    held = members.select("path", "bid").distinct()
    clashing = winning.where("conflict").select("path", "bid", F.lit(True).alias("all")).distinct()
    firsts = winning.where("NOT conflict").select("path", "bid", F.col("first").alias("source_id"), F.lit(True).alias("one")).distinct()
    marked = specs.join(held.hint("merge"), ["path", "bid"]).join(clashing.hint("merge"), ["path", "bid"], "left").join(firsts.hint("merge"), ["path", "bid", "source_id"], "left")
    live = F.col("leads") & (F.col("all").isNotNull() | F.col("one").isNotNull())
    beaten = cut(marked.where(~live).select("path", "bid", "source_kind", "source_id"))
    losing = members.join(beaten.select("path", "bid").distinct().hint("merge"), ["path", "bid"], "left_semi")
    over = winning.select("path", "cell", F.col("bid").alias("by"), F.when(~F.col("conflict"), F.col("first")).alias("one"))
    pairs = cut(losing.join(over.hint("merge"), ["path", "cell"]).select("path", "bid", "by", "one").distinct())
    leading = specs.where("leads").select("path", F.col("bid").alias("by"), F.col("source_id").alias("winner"))
    several = pairs.where("one IS NULL").join(leading.hint("merge"), ["path", "by"]).select("path", "bid", "winner")
    winners = several.unionByName(pairs.where("one IS NOT NULL").select("path", "bid", F.col("one").alias("winner")))
    lists = winners.groupBy("path", "bid").agg(F.array_sort(F.collect_set("winner")).alias("shadowed_by"))
    n = tasks(bindings)
    found = beaten.repartition(n, "path", "bid").join(lists.repartition(n, "path", "bid").hint("merge"), ["path", "bid"])
    return found.select(F.col("path").alias("element_path"), "source_kind", "source_id", "shadowed_by")
