"""Joins between entities, and the anti and range joins around them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that meet as one, about: in a small group, and in one so large that its chunks are more than tasks need.
CHUNK, MOST = 1024, 32 * 1024


def hydrate(rows: DataFrame, array: str, target: DataFrame, key: str = "id", name: str = "ref_id") -> DataFrame:
    """A row for each id in ``array`` that ``target`` has, with the target's columns; its place in the array as ``at``."""
    exploded = rows.select("*", F.posexplode(F.col(array)).alias("at", name))
    return exploded.join(target.withColumnRenamed(key, name), name)


def found_and_missing(wanted: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """``wanted`` keys with whether ``target`` has them."""
    known = target.select(key).distinct().withColumn("known", F.lit(True))
    return wanted.join(known, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def missing(wanted: DataFrame, target: DataFrame, key: str) -> DataFrame:
    return wanted.join(target, key, "left_anti")


def siblings(rows: DataFrame, key: str, group: str, cap: int | None = None) -> DataFrame:
    """(key, sibling) of rows in one group, no row with itself; with ``cap`` the first that many of each row.

    Without ``cap`` a group's pairs are what this asks for. With it, the
    listing's length, a row's first siblings are among the first ``cap + 1`` of
    its group, so it meets only those.
    """
    left = rows.select(F.col(key), F.col(group).alias("_group")).where(F.col("_group").isNotNull())
    right = left.select(F.col(key).alias("sibling"), F.col("_group"))
    if cap is not None:
        first = Window.partitionBy("_group").orderBy("sibling")
        right = right.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= cap + 1)
    own = F.col(key) != F.col("sibling")
    if cap is not None:
        # the last one takes a row's own place, where the row stands before it; so nothing is sorted by row
        own = own & ((F.col("_n") <= cap) | (F.col(key) < F.col("sibling")))
    return left.join(right, "_group").where(own).select(key, "sibling")


def tasks(rows: DataFrame) -> int:
    """Tasks of a join whose output is far larger than its input, which adaptive execution would put into too few."""
    spark = rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _enough(n: int) -> int:
    """Chunks of a group whose pairs keep ``n`` tasks busy; a row is moved once for each, so it has more only where they are large."""
    return math.ceil(math.sqrt(2 * n))


def _parts(on: list[str], size: int, n: int) -> Column:
    """How many chunks of ``size`` rows or more a row's group has."""
    rows = F.count("*").over(Window.partitionBy(*on))
    return F.least(F.ceil(rows / size), F.greatest(F.ceil(rows / max(size, MOST)), F.lit(_enough(n))))


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def pairs_within(rows: DataFrame, on: list[str], key: str, condition: Column, chunk: int = CHUNK) -> DataFrame:
    """Ordered pairs of rows of one group for which ``condition`` holds, as columns ``on``, ``a_...`` and ``b_...``.

    A group's rows are dealt to chunks by their ``key``, and each two of its chunks
    meet in one place, so a large group is the work of many tasks and a task
    holds two chunks. Null groups have no pairs.
    """
    others = [c for c in rows.columns if c not in on]
    place, n = [*on, "_i", "_j"], tasks(rows)
    dealt = rows.dropna(subset=on).withColumn("_parts", _parts(on, chunk, n))
    dealt = dealt.withColumn("_deal", F.pmod(F.xxhash64(key), F.col("_parts")))
    a = dealt.select(*on, F.col("_deal").alias("_i"), _each(F.col("_parts")).alias("_j"), *[F.col(c).alias(f"a_{c}") for c in others])
    b = dealt.select(*on, _each(F.col("_parts")).alias("_i"), F.col("_deal").alias("_j"), *[F.col(c).alias(f"b_{c}") for c in others])
    # merged, as a broadcast would pass one side through the driver
    return a.repartition(n, *place).join(b.repartition(n, *place).hint("merge"), place).where(condition).drop("_i", "_j")


def spread(kinds: DataFrame, members: DataFrame, on: list[str], own: list[str], condition: Column) -> DataFrame:
    """Pairs of kinds of a group (``on``, ``a_kind``, ``b_kind`` and what else they have) as pairs of the rows of these kinds.

    ``members``: ``on``, kind, ``own``. ``condition`` is on columns ``a_...`` and ``b_...`` of ``own``.
    A kind's rows are moved as lists, one for each of its chunks. A pair of kinds
    meets the first's lists by itself, then each of the second's; pairs of rows
    are made there. A list of the second is in as many places as its kind has
    chunks, so a large kind is the work of many tasks.
    """
    place, n = [*on, "b_kind", "_j", "_salt"], tasks(members)
    rows = members.dropna(subset=on).withColumn("_all", F.count("*").over(Window.partitionBy(*on)))
    sized = rows.withColumn("_parts", F.ceil(F.count("*").over(Window.partitionBy(*on, "kind")) / F.greatest(F.lit(CHUNK), F.least(F.lit(MOST), F.ceil(F.col("_all") / _enough(n))))))
    deal = F.pmod(F.xxhash64(*own), F.col("_parts"))
    listed = lambda side: F.collect_list(F.struct(*[F.col(c).alias(f"{side}_{c}") for c in own])).alias(f"_{side}")
    a = sized.groupBy(*on, F.col("kind").alias("a_kind"), deal.alias("_i")).agg(listed("a"))
    b = sized.groupBy(*on, F.col("kind").alias("b_kind"), deal.alias("_j")).agg(listed("b"), F.first("_parts").alias("_parts"))
    parts = sized.groupBy(*on, F.col("kind").alias("b_kind")).agg(F.first("_parts").alias("_parts"))
    left = kinds.join(parts.hint("merge"), [*on, "b_kind"]).join(a.hint("merge"), [*on, "a_kind"])
    left = left.withColumn("_j", _each(F.col("_parts"))).withColumn("_salt", F.pmod("_i", "_parts")).drop("_i", "_parts")
    right = b.withColumn("_salt", _each(F.col("_parts"))).drop("_parts")
    met = left.repartition(n, *place).join(right.repartition(n, *place).hint("merge"), place).drop("_j", "_salt")
    return met.select("*", F.inline("_a")).drop("_a").select("*", F.inline("_b")).drop("_b").where(condition)


def overlapping(spans: DataFrame, units: DataFrame, on: str, width: int) -> DataFrame:
    """Spans with the units of the same document that they overlap; half-open [start, end) in both.

    Both sides are cut at multiples of ``width``, so the join is an equi-join on
    (document, cell) however long a document is; a pair is kept in its first
    common cell only.
    """

    def cells(rows: DataFrame, start: str, end: str) -> DataFrame:
        low, high = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
        return rows.where(F.col(start) < F.col(end)).withColumn("_cell", F.explode(F.sequence(low, high)))

    left = cells(spans.withColumnsRenamed({"start": "span_start", "end": "span_end"}), "span_start", "span_end")
    right = cells(units.withColumnsRenamed({"start": "unit_start", "end": "unit_end"}), "unit_start", "unit_end")
    both = left.join(right, [on, "_cell"]).where((F.col("unit_start") < F.col("span_end")) & (F.col("unit_end") > F.col("span_start")))
    first = F.floor(F.greatest("span_start", "unit_start") / width)
    return both.where(F.col("_cell") == first).drop("_cell")


def neighbours(units: DataFrame, doc: str, ordinal: str, key: str) -> DataFrame:
    """Units with those just before and after them."""
    near = units.select(doc, F.col(key).alias("neighbour"), F.explode(F.array(F.col(ordinal) - 1, F.col(ordinal) + 1)).alias(ordinal))
    return units.select(doc, ordinal, key).join(near, [doc, ordinal]).select(doc, key, "neighbour")


def longest_prefix(rows: DataFrame, text: Column, owners: DataFrame, key: str, longest: int) -> DataFrame:
    """Rows with the longest owner, of ``longest`` characters at most, that is a prefix of ``text``, null if none.

    An owner depends on a text's first characters alone, so each different
    beginning meets its own prefixes by an equi-join, once, and rows are only
    given what their beginning has.
    """
    # a null text has no beginning and no owner
    begun = rows.withColumn("_head", F.substring(text, 1, longest))
    heads = begun.select("_head").where(F.col("_head").isNotNull()).distinct()
    prefixes = F.transform(F.sequence(F.lit(0), F.length("_head")), lambda n: F.substr("_head", F.lit(1), n))
    known = owners.select(F.col(key).alias("_prefix"), F.col(key).alias("owner")).distinct()
    hits = heads.select("_head", F.explode(prefixes).alias("_prefix")).join(known, "_prefix")
    found = hits.groupBy("_head").agg(F.max_by("owner", F.length("owner")).alias("owner"))
    return begun.join(found, "_head", "left").select(*rows.columns, "owner")


def full_outer_differences(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys on one side only or with other values."""
    a = left.select(key, F.col(value).alias("left_value"))
    b = right.select(key, F.col(value).alias("right_value"))
    return a.join(b, key, "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def by_signature(rows: DataFrame, key: str, array: str, classes: DataFrame, class_key: str) -> DataFrame:
    """Rows with the last class whose array holds the same values."""
    mark = lambda d, k: d.select(F.col(k), F.array_sort(F.array_distinct(F.col(array))).alias("_mark"))
    last = mark(classes, class_key).groupBy("_mark").agg(F.max(class_key).alias(class_key))
    return mark(rows, key).join(last, "_mark", "left").select(key, class_key)


def product(*axes: DataFrame) -> DataFrame:
    """All combinations of axis tables, of which those of at most 10,000 rows are broadcast."""
    out = None
    for axis in axes:
        small = axis.limit(10_001).count() <= 10_000
        out = axis if out is None else out.crossJoin(F.broadcast(axis) if small else axis)
    return out


def hydrate_resolved(rows: DataFrame, array: str, tokens: DataFrame) -> DataFrame:
    """``hydrate`` of tokens with the value at the end of each one's references, and its status; null where it doesn't end."""
    from .graph import resolve_refs

    return hydrate(rows, array, resolve_refs(tokens).select("id", "value", "status"))
