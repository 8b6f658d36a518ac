"""Property graph operators over node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import cut, some


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: (node, other, type, direction)."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "type", F.lit("out").alias("direction"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "type", F.lit("in").alias("direction"))
    return out.unionAll(back)


def walk(edges: DataFrame, start: DataFrame, depth: int = 1, types: list[str] | None = None) -> DataFrame:
    """Edges within ``depth`` (at most 2) steps of each node of ``start``: (start, from, to, type, direction, step).

    A second step lists edges back to nodes that were seen before as well, but
    only nodes seen for the first time are left by it.
    """
    if depth not in (1, 2):
        raise ValueError("a walk has one or two steps")
    sides = both_ways(edges)
    if types:
        sides = sides.where(F.col("type").isin(*types))
    named = sides.withColumnsRenamed({"node": "from", "other": "to"})
    first = start.select(F.col("node").alias("start"), F.col("node").alias("from")).join(named, "from").withColumn("step", F.lit(1))
    columns = ["start", "from", "to", "type", "direction", "step"]
    if depth == 1:
        return first.select(columns)
    reached = first.select("start", F.col("to").alias("from")).distinct().where(F.col("start") != F.col("from"))
    second = reached.join(named, "from").withColumn("step", F.lit(2))
    return first.select(columns).unionByName(second.select(columns))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges that are no nodes, with the number of such ends."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.join(nodes, "id", "left_anti").groupBy("id").agg(F.count("*").alias("n"))


def edges_of(rows: DataFrame, key: str, target: Column, type_: str, many: bool = False) -> DataFrame:
    """Edges from each row to its target, or to each of an array of targets."""
    dst = F.explode(target) if many else target
    return rows.select(F.col(key).alias("src"), dst.alias("dst"), F.lit(type_).alias("type")).where(F.col("dst").isNotNull())


def resolve_refs(tokens: DataFrame, key: str = "id", ref: str = "ref", value: str = "value", depth: int = 32) -> DataFrame:
    """Each token with the value at the end of its reference chain: (id, value, chain, status).

    status: ok, missing (a reference to no token), cycle, or deep (longer than
    ``depth``). A token stands on its own path only, so one primitive may be
    used by many. Works by doubling: each round joins what a token points at
    with what that points at, so a chain of n takes log n joins.
    """
    base = tokens.select(F.col(key).alias("id"), F.col(ref).alias("at"), F.col(value).alias("own"))
    known = base.select(F.col("id").alias("_id"), F.col("own").alias("_own"), F.lit(True).alias("_known"))
    ends = base.select("id", F.coalesce("at", "id").alias("end"), F.when(F.col("at").isNull(), F.array("id")).otherwise(F.array("id", "at")).alias("chain"), F.col("at").isNull().alias("done"))
    steps = 1
    while steps < depth:
        hop = ends.select(F.col("id").alias("_id"), F.col("end").alias("_end"), F.col("chain").alias("_chain"), F.col("done").alias("_done"))
        joined = ends.join(hop, ends["end"] == hop["_id"], "left")
        move = ~F.col("done") & F.col("_id").isNotNull()
        ends = joined.select(
            "id",
            F.when(move, F.col("_end")).otherwise(F.col("end")).alias("end"),
            F.when(move, F.concat("chain", F.slice("_chain", 2, depth))).otherwise(F.col("chain")).alias("chain"),
            F.when(move, F.col("_done")).otherwise(F.col("done")).alias("done"),
        )
        steps *= 2
    joined = ends.join(known, ends["end"] == known["_id"], "left")
    looped = F.size(F.array_distinct("chain")) < F.size("chain")
    status = F.when(F.col("_known").isNull(), "missing").when(F.col("done"), "ok").when(looped, "cycle").otherwise("deep")
    return joined.select("id", F.when(status == "ok", F.col("_own")).alias("value"), F.when(status != "cycle", F.col("chain")).alias("chain"), status.alias("status"))


def resolve_chains(tokens: DataFrame, key: str = "id", ref: str = "ref", value: str = "value") -> DataFrame:
    """Each token with the end of its reference chain, of any length: (id, end, value, steps, status).

    status: ok, missing (``end`` is what isn't there) or cycle (no end). A chain
    of n takes log n joins, each of what hasn't ended yet; what hasn't after as
    many as the number of tokens allows for goes round.
    """
    base = tokens.select(F.col(key).alias("id"), F.col(ref).alias("at"), F.col(value).alias("own"))
    known = cut(base.select(F.col("id").alias("end"), "own", F.lit(True).alias("known")))
    ended = base.where("at IS NULL").select("id", F.col("id").alias("end"), F.lit(0).cast("long").alias("steps"))
    going = cut(base.where("at IS NOT NULL").select("id", F.col("at").alias("end"), F.lit(1).cast("long").alias("steps")))
    ended = cut(ended)
    rounds = max(1, known.count()).bit_length() + 1
    while rounds and some(going):
        # where the ends of those that still go lead to, in as many steps as these have taken or to their ends
        hop = going.unionByName(ended.where("steps > 0")).select(F.col("id").alias("end"), F.col("end").alias("next"), F.col("steps").alias("more"))
        moved = going.join(hop, "end", "left")
        stopped = moved.where("next IS NULL").select("id", "end", "steps")
        ended = cut(ended.unionByName(stopped))
        going = cut(moved.where("next IS NOT NULL").select("id", F.col("next").alias("end"), (F.col("steps") + F.col("more")).alias("steps")))
        rounds -= 1
    found = ended.join(known, "end", "left")
    status = F.when(F.col("known"), "ok").otherwise("missing")
    done = found.select("id", "end", F.when(F.col("known"), F.col("own")).alias("value"), "steps", status.alias("status"))
    kinds = dict(done.dtypes)
    round_ = going.select("id", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("end", "value", "steps")], F.lit("cycle").alias("status"))
    return done.unionByName(round_)


def resolve_refs_recursive(spark, view: str) -> DataFrame:
    """Tokens of a view (id, ref, value) whose chain ends at a token: (id, end, value, steps); ``resolve_chains`` has all of them."""
    return resolve_chains(spark.table(view)).where("status = 'ok'").select("id", "end", "value", "steps")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node with an edge to a smaller one or through others: the smallest node that it is tied to; roots aren't listed.

    Each round ties a node's larger neighbours to its smallest one and then the
    smaller ones to the least of them, until only stars are left; a chain of n
    takes some log n rounds. Stars are set aside, so rounds get smaller. A round
    groups and joins by node, so no node's neighbours are held together.
    """
    pairs = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("node"), F.least("src", "dst").alias("root")).distinct())
    stars = []
    while True:
        sides = pairs.select("node", "root", F.lit(1).alias("up")).unionByName(pairs.select(F.col("root").alias("node"), F.col("node").alias("root"), F.lit(0).alias("up")))
        ups = F.sum("up")
        # a node of no star yet has two smaller neighbours, or one and larger ones too
        nodes = cut(sides.groupBy("node").agg(F.least("node", F.min("root")).alias("least"), ((ups > 1) | ((ups == 1) & (F.count("*") > 1))).alias("amid")))
        if not some(nodes.where("amid")):
            return reduce(DataFrame.unionByName, [*stars, pairs])
        amid = nodes.where("amid").select("node")
        unsettled = pairs.join(amid, "node", "left_semi").select("root").unionByName(amid.select(F.col("node").alias("root"))).distinct()
        stars.append(pairs.join(unsettled, "root", "left_anti").select("node", "root"))
        small = nodes.select(F.col("node").alias("root"), F.col("least"))
        large = pairs.join(unsettled, "root", "left_semi").join(small, "root").select("node", F.col("least").alias("root"))
        # a node's larger neighbours now have its least one, itself for a root
        least = large.groupBy("node").agg(F.min("root").alias("least"))
        tied = large.join(least, "node").where("root > least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        pairs = cut(tied.unionByName(least.withColumnRenamed("least", "root")).distinct())


def path_collisions(paths: DataFrame, path: str) -> DataFrame:
    """Paths that are also groups, that is the beginning of another path before a dot."""
    parts = F.split(F.col(path), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    groups = paths.where(F.size(parts) > 1).select(F.explode(above).alias(path)).distinct()
    return paths.select(path).distinct().join(groups, path, "left_semi")


def assigned_paths(paths: DataFrame, path: str) -> DataFrame:
    """Paths with ``_value`` after those that are groups too."""
    clash = path_collisions(paths, path).withColumn("_clash", F.lit(True))
    joined = paths.join(clash, path, "left")
    return joined.withColumn("assigned", F.when(F.col("_clash"), F.concat(path, F.lit("_value"))).otherwise(F.col(path))).drop("_clash")


def group_order(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Place of each member in its group, from 0."""
    return rows.withColumn("group_order", F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1)
