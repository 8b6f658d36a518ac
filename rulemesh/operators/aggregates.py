"""Votes, ratios and other grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import CHUNK, tasks


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole as a double, ``empty`` where there is no whole."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(empty))


def vote_union(votes: DataFrame, item: str, voter: str, order: str, why: str) -> DataFrame:
    """Items with their voters in order, the first reason that isn't empty and the number of votes."""
    voters = F.transform(F.array_sort(F.collect_list(F.struct(order, voter))), lambda v: v[voter])
    reason = F.min_by(F.when(F.col(why) != "", F.col(why)), F.when(F.col(why) != "", F.struct(order, voter)))
    return votes.groupBy(item).agg(voters.alias("voters"), reason.alias("why"), F.count("*").alias("votes"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    whole = F.size(F.array_union(a, b))
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / whole)


def jaccard_pairs(sets: DataFrame, owner: str, item: str, chunk: int = CHUNK, most: int = 64 * CHUNK) -> DataFrame:
    """Jaccard similarity of the sets of every pair of owners that share an item: (a, b, shared, jaccard).

    Owners are cut into blocks by their order, and an item's owners into chunks,
    each two of which meet in one place. What moves on is not pairs but, for each
    block that has some of an item's owners, one list of these and of those behind
    them; pairs are made and counted where the block is. So an item costs as
    many lists as there are blocks among its owners, however many these are. Pairs
    of an owner of more than ``most`` items are counted before they are moved, as
    all of them would be one task's.
    """
    n = tasks(sets)
    rows = sets.select(F.col(owner).alias("a"), F.col(item).alias("_item")).where(F.col(owner).isNotNull())
    # by owner once: distinct rows, sizes and blocks need no other move
    rows = rows.repartitionByRange(n, "a").distinct().withColumn("n", F.count("*").over(Window.partitionBy("a"))).withColumn("k", F.spark_partition_id())
    rows = rows.where(F.col("_item").isNotNull()).repartition(n, "_item")
    order = Window.partitionBy("_item").orderBy("a")
    ranked = rows.withColumn("_chunk", F.floor((F.row_number().over(order) - 1) / chunk))
    ranked = ranked.withColumn("_last", F.max("_chunk").over(Window.partitionBy("_item")))
    lists = ranked.groupBy("_item", "_last", "_chunk").agg(F.array_sort(F.collect_list(F.struct("a", "n", "k"))).alias("owners"))
    # of one chunk only: nothing to meet
    few = lists.where("_last = 0").select("owners", F.slice("owners", 1, 0).alias("others"))
    many, place = lists.where("_last > 0"), ["_item", "_i", "_j"]
    left = many.select("_item", F.col("_chunk").alias("_i"), F.explode(F.sequence("_chunk", "_last")).alias("_j"), "owners")
    right = many.select("_item", F.explode(F.sequence(F.lit(0).cast("long"), "_chunk")).alias("_i"), F.col("_chunk").alias("_j"), F.col("owners").alias("others"))
    met = left.repartition(n, *place).join(right.repartition(n, *place).hint("merge"), place)
    met = few.unionByName(met.select("owners", F.when(F.col("_i") != F.col("_j"), F.col("others")).otherwise(F.slice("others", 1, 0)).alias("others")))
    each = met.where(F.size("owners") + F.size("others") > 1).withColumn("k", F.explode(F.array_distinct("owners.k")))
    of_block = each.withColumn("_at", F.array_position("owners.k", F.col("k")).cast("int")).withColumn("_m", F.size(F.filter("owners", lambda o: o["k"] == F.col("k"))))
    alone = F.size("others") == 0
    whole = F.when(alone, F.slice("owners", F.col("_at"), F.size("owners"))).otherwise(F.concat(F.slice("owners", F.col("_at"), F.col("_m")), "others"))
    # the first _m are the block's, and meet those behind them from _from on
    tails = of_block.select("k", "_m", F.when(alone, 0).otherwise(F.col("_m")).alias("_from"), whole.alias("_w"))
    tails = tails.select("k", "_m", "_from", F.col("_w.a").alias("_a"), F.col("_w.n").cast("array<int>").alias("_n"))

    def count(rows: DataFrame, kept: Column, *by: str) -> DataFrame:
        first = rows.select("*", F.posexplode(F.slice("_a", F.lit(1), F.col("_m"))).alias("_p", "a")).withColumn("n_a", F.get("_n", F.col("_p"))).where(kept)
        begin = F.greatest(F.col("_p") + 1, F.col("_from"))
        behind = first.where(begin < F.size("_a")).select(*by, "a", "n_a", "_a", "_n", F.explode(F.sequence(begin, F.size("_a") - 1)).alias("_q"))
        pairs = behind.select(*by, "a", "n_a", F.get("_a", F.col("_q")).alias("b"), F.get("_n", F.col("_q")).alias("n_b"))
        return pairs.groupBy(*by, "a", "n_a", "b", "n_b").agg(F.count("*").alias("shared")).select("a", "n_a", "b", "n_b", "shared")

    shared = count(tails.repartition(n, "k"), F.col("n_a") <= most, "k").unionByName(count(tails.where(F.exists("_n", lambda x: x > most)), F.col("n_a") > most))
    return shared.select("a", "b", "shared", ratio(F.col("shared"), F.col("n_a") + F.col("n_b") - F.col("shared"), 1.0).alias("jaccard"))


def coverage(units: DataFrame, group: str, required: Column, covered: Column) -> DataFrame:
    """Required, covered and their ratio for each group and, with a null group, for all."""
    return units.groupingSets([[F.col(group)], []], F.col(group)).agg(
        F.count_if(required).alias("required"),
        F.count_if(required & covered).alias("covered"),
        ratio(F.count_if(required & covered), F.count_if(required)).alias("ratio"),
        F.grouping(group).cast("int").alias("is_total"),
    )


def majority(votes: DataFrame, groups: list[str], value: str, champion: Column | None = None) -> DataFrame:
    """The value with most votes in each group: the champion's on a tie, else the smallest; with its agreement.

    ``champion``: true for votes of the run that wins ties. A null value is a vote.
    """
    champion = F.lit(False) if champion is None else champion
    counted = votes.groupBy(*groups, value).agg(F.count("*").alias("n"), F.max(champion.cast("int")).alias("_champion"))
    order = Window.partitionBy(*groups).orderBy(F.desc("n"), F.desc("_champion"), F.asc_nulls_first(value))
    total = F.sum("n").over(Window.partitionBy(*groups))
    ranked = counted.withColumn("_rank", F.row_number().over(order)).withColumn("agreement", F.col("n").cast("double") / total)
    return ranked.where("_rank = 1").select(*groups, value, F.col("n").alias("votes"), "agreement")


def confidence(agreement: Column) -> Column:
    return F.when(agreement >= 1, "high").when(agreement > 0.5, "medium").otherwise("low")


def evidence(rows: DataFrame, group: str, run: str, item: str) -> DataFrame:
    """Items of each group by the number of runs that have them, then by value."""
    counted = rows.groupBy(group, item).agg(F.countDistinct(run).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), F.col(item).alias("item"))))
    return counted.groupBy(group).agg(F.transform(ordered, lambda x: x["item"]).alias("items"), F.max("n").alias("most"))


def all_failed(rows: DataFrame, group: str, failed: Column) -> DataFrame:
    """Groups of which every row failed."""
    return rows.groupBy(group).agg(F.bool_and(failed).alias("_failed")).where("_failed").select(group)


def counts_with_zeros(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of each pair of values, pairs that don't occur included."""
    grid = rows.select(a).distinct().crossJoin(rows.select(b).distinct())
    counted = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    return grid.join(counted, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"))


def reverse_index(rows: DataFrame, array: str, key: str) -> DataFrame:
    """For each value of an array the sorted keys of the rows that have it."""
    return rows.select(key, F.explode(array).alias("value")).groupBy("value").agg(F.array_sort(F.collect_set(key)).alias("keys"))


def alias_merge(rows: DataFrame, group: str, array: str) -> DataFrame:
    return rows.groupBy(group).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(array)))).alias("aliases"))


def best_verification(rows: DataFrame, group: str, status: str, ranks: dict[str, int]) -> DataFrame:
    """The best status of each group, and whether any passed."""
    rank = F.element_at(F.create_map(*[F.lit(x) for p in ranks.items() for x in p]), F.col(status))
    return rows.groupBy(group).agg(F.max_by(status, rank).alias("status"), F.bool_or(rank >= max(ranks.values())).alias("passed"))


def domains(sources: list[DataFrame], seeds: dict[str, list[str]]) -> DataFrame:
    """Sorted values of each axis over all sources (columns axis, value) and seeds."""
    out = sources[0].select("axis", "value")
    for more in sources[1:]:
        out = out.unionByName(more.select("axis", "value"))
    pairs = [F.struct(F.lit(a).alias("axis"), F.lit(v).alias("value")) for a, vs in seeds.items() for v in vs]
    if pairs:
        seeded = out.sparkSession.range(1).select(F.inline(F.array(*pairs)))
        out = out.unionByName(seeded)
    return out.where(F.col("value").isNotNull()).groupBy("axis").agg(F.array_sort(F.collect_set("value")).alias("values"))


def ratchet(now: DataFrame, accepted: DataFrame, key: str, value: str, higher_is_better: Column) -> DataFrame:
    """Metrics that became worse: (key, now, accepted, delta)."""
    both = now.select(key, F.col(value).alias("now")).join(accepted.select(key, F.col(value).alias("accepted")), key)
    delta = F.col("now") - F.col("accepted")
    return both.withColumn("delta", delta).where(F.when(higher_is_better, F.col("delta") < 0).otherwise(F.col("delta") > 0))


def price(usage: DataFrame, model: Column, prices: dict[str, float], amount: Column) -> DataFrame:
    """Usage with the cost by the longest price prefix of the model's name, null if none fits."""
    out = F.lit(None).cast("double")
    for prefix in sorted(prices, key=len):
        out = F.when(model.startswith(prefix), F.lit(prices[prefix])).otherwise(out)
    return usage.withColumn("cost", out * amount)
