"""Window operators: neighbourhoods, islands, latest rows and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbourhood(rows: DataFrame, group: str, order: str, value: Column, radius: int = 2) -> DataFrame:
    """Each row with the values up to ``radius`` rows before and after it in its group."""
    near = Window.partitionBy(group).orderBy(order).rowsBetween(-radius, radius)
    return rows.withColumn("near", F.collect_list(value).over(near))


def near_targets(rows: DataFrame, group: str, order: str, target: Column, radius: int = 1) -> DataFrame:
    """Rows within ``radius`` rows of a target, each once."""
    near = Window.partitionBy(group).orderBy(order).rowsBetween(-radius, radius)
    return rows.withColumn("_near", F.max(target.cast("int")).over(near)).where("_near = 1").drop("_near")


def islands(rows: DataFrame, group: str, number: str, least: int = 2) -> DataFrame:
    """Runs of consecutive numbers of at least ``least`` members: (group, first, last, n)."""
    order = Window.partitionBy(group).orderBy(number)
    marked = rows.select(group, number).distinct().withColumn("_island", F.col(number) - F.row_number().over(order))
    found = marked.groupBy(group, "_island").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least).drop("_island")


def ranked(rows: DataFrame, group: str, keys: list[Column], last: Column) -> DataFrame:
    """Rank in the group by ``keys`` and ``last``, all descending, and whether the first by ``keys`` alone are several."""
    by_keys = Window.partitionBy(group).orderBy(*[k.desc() for k in keys])
    by_all = Window.partitionBy(group).orderBy(*[k.desc() for k in [*keys, last]])
    tied = F.dense_rank().over(by_keys) == 1
    out = rows.withColumn("rank", F.row_number().over(by_all)).withColumn("_top", tied.cast("int"))
    return out.withColumn("tied", (F.col("_top") == 1) & (F.sum("_top").over(Window.partitionBy(group)) > 1)).drop("_top")


def latest(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """The last row of each group."""
    w = Window.partitionBy(*groups).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_of(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def uniquified(rows: DataFrame, slug: str, order: str) -> DataFrame:
    """Slugs made unique: the first stays, later ones get _2, _3 and so on.

    A suffixed slug that is itself another row's slug moves on to the next free
    number, as a loop over the rows would.
    """
    nth = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    numbered = rows.withColumn("_n", nth)
    # suffixes that natural slugs have taken, for each stem
    natural = rows.select(F.col(slug).alias("_natural")).distinct()
    stem, number = (F.regexp_extract("_natural", r"^(.*)_([1-9]\d{0,8})$", k) for k in (1, 2))
    taken = natural.where(number != "").groupBy(stem.alias(slug)).agg(F.array_sort(F.collect_set(number.cast("int"))).alias("_taken"))
    joined = numbered.join(taken, slug, "left")

    def skip(at: Column, used: Column) -> Column:
        return F.when(used <= at, at + 1).otherwise(at)

    above = F.filter(F.coalesce("_taken", F.array().cast("array<int>")), lambda v: v >= 2)
    free = F.aggregate(above, F.col("_n"), skip)
    unique = F.when(F.col("_n") == 1, F.col(slug)).otherwise(F.concat(slug, F.lit("_"), free.cast("string")))
    return joined.withColumn("unique_id", unique).drop("_n", "_taken")


def positions(rows: DataFrame, group: str, order: str) -> DataFrame:
    """first, middle or last of the group; a single row is first."""
    w = Window.partitionBy(group)
    place = F.when(F.col(order) == F.min(order).over(w), "first").when(F.col(order) == F.max(order).over(w), "last").otherwise("middle")
    return rows.withColumn("position", place)


def batches(rows: DataFrame, group: str, order: list[str], size: int = 40) -> DataFrame:
    """Batches of ``size`` rows in order, numbered within the group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("batch", F.floor((n - 1) / size))
