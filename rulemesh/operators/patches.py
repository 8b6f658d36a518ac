"""A log of patches over entities, applied one after another: adds, updates, deletes, splits and merges.

Whether a patch holds depends on what earlier ones did to the entities it
names. Adds, updates and deletes of one entity are settled by windows, however
many there are: after an add an entity is there and after a delete it isn't,
whether or not that patch held. Only patches of several entities (splits,
merges, deletes of more than one) make others wait. Entities that such patches
tie together, directly or through others, make a group, and nothing outside
touches it. A group of at most ``WALKED`` patches is a row, in which they are
taken one after another: all such groups are done in one pass. Those of larger
groups are taken in rounds, each of all patches that no earlier such patch can
touch any more, so rounds are as many as the longest chain of them. Every other
entity is done in one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .graph import components
from .steps import cut, some

OPS = ("add", "update", "delete", "split", "merge")
#: Patches of the largest group that is held in one row.
WALKED = 500


@dataclass(frozen=True)
class Applied:
    """``entities``: id, kind and columns. ``audit``: seq, op, status, reason, before, after. ``moves``: seq, src, dst (null for a deletion)."""

    entities: DataFrame
    audit: DataFrame
    moves: DataFrame


def mark(*parts: Column) -> Column:
    """A hash of some values; null where the first is."""
    return F.when(parts[0].isNotNull(), F.substring(F.sha2(F.to_json(F.struct(*[p.alias(f"p{n}") for n, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256), 1, 16))


def _misshapen() -> Column:
    """Why a patch can't hold whatever the state, else null."""
    n, products = F.size("targets"), F.transform("products", lambda p: p["id"])
    empty = F.exists(products, lambda i: i.isNull() | (i == ""))
    return (
        F.when(~F.col("op").isin(*OPS), "op")
        .when((F.col("op") != "add") & (n < 1), "no_target")
        .when(F.size(F.array_distinct("targets")) < n, "targets_repeat")
        .when(F.col("op").isin("update", "split") & (n != 1), "one_target")
        .when((F.col("op") == "merge") & (n < 2), "two_targets")
        .when((F.col("op") == "merge") & ~F.coalesce(F.array_contains("targets", F.col("keep")), F.lit(False)), "keep")
        .when(F.col("op").isin("add", "update") & (F.size("products") != 1), "one_product")
        .when((F.col("op") == "split") & (F.size("products") < 1), "no_product")
        .when(F.col("op").isin("add", "split") & empty, "product_id")
        .when((F.col("op") == "split") & (F.size(F.array_distinct(products)) < F.size(products)), "products_repeat")
    )


def _kinds(state: DataFrame, patches: DataFrame) -> DataFrame:
    """The kind of each id: the state's, else that of the first patch that makes it."""
    made = patches.where(F.col("op").isin("add", "split")).select("seq", "kind", F.explode("products.id").alias("id"))
    first = made.groupBy("id").agg(F.min_by("kind", "seq").alias("made_kind"))
    return state.select("id", "kind").join(first, "id", "full").select("id", F.coalesce("kind", "made_kind").alias("known_kind"))


def fold(now: DataFrame, singles: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(each of ``singles`` judged, the state of their ids after them).

    ``now``: id and columns; ``singles``: seq, op, id and columns. Judged ones
    have ok, old and new: the entity before and after, null where it isn't there.
    """
    by = Window.partitionBy("id").orderBy("seq")
    known = now.select("id", F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in columns])
    rows = singles.select("seq", "op", "id", *columns).join(known, "id", "left")
    last = F.last(F.when(F.col("op").isin("add", "delete"), F.col("op")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    there = F.when(last.isNull(), F.col("_there").isNotNull()).otherwise(last == "add")
    rows = rows.withColumn("was", there).withColumn("ok", (F.col("op") == "add") != F.col("was"))
    ends = F.col("ok") & F.col("op").isin("add", "delete")
    rows = rows.withColumn("epoch", F.count(F.when(ends, 1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    # values given since the entity was added last, or else its old ones
    since = Window.partitionBy("id", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    for c in columns:
        given = F.last(F.when(F.col("ok") & (F.col("op") != "delete"), F.col(c)), ignorenulls=True).over(since)
        rows = rows.withColumn(f"new_{c}", F.when(F.col("epoch") == 0, F.coalesce(given, F.col(f"_{c}"))).otherwise(given))
    rows = rows.withColumn("is_there", F.when(F.col("ok"), F.col("op") != "delete").otherwise(F.col("was")))
    whole = F.when(F.col("is_there"), F.struct("id", *[F.col(f"new_{c}").alias(c) for c in columns]))
    rows = rows.withColumn("new", whole)
    initial = F.when(F.col("_there"), F.struct("id", *[F.col(f"_{c}").alias(c) for c in columns]))
    first = F.row_number().over(by) == 1
    rows = rows.withColumn("old", F.when(first, initial).otherwise(F.lag("new").over(by)))
    judged = rows.select("seq", "op", "id", "ok", "old", "new", *columns)
    after = judged.groupBy("id").agg(F.max_by(F.struct("new"), "seq").alias("last"))
    return judged, after.select("last.new.*").where("id IS NOT NULL")


def _audited(judged: DataFrame, columns: list[str]) -> DataFrame:
    given = F.struct("id", *columns)
    ok, add = F.col("ok"), F.col("op") == "add"
    reason = F.when(~ok, F.when(add, "exists").otherwise("missing"))
    before = F.when(add, mark(F.col("id"), F.lit("add"), given)).otherwise(F.coalesce(mark(F.col("old")), mark(F.col("id"), given)))
    after = F.when(ok, F.coalesce(mark(F.col("new")), mark(F.col("id"), F.lit("deleted")))).otherwise(mark(F.col("id"), F.col("op"), given, reason))
    return judged.select("seq", "op", F.when(ok, "applied").otherwise("rejected").alias("status"), reason.alias("reason"), before.alias("before"), after.alias("after"))


def _put(item: Column, columns: list[str]) -> Column:
    return F.struct(item["id"].alias("id"), *[item[c].alias(c) for c in columns])


def _merged(keep: Column, others: Column, kinds: dict[str, str]) -> Column:
    """``keep`` with what it lacks from ``others`` in their order; lists also gain the others' items."""
    def field(c: str, kind: str) -> Column:
        theirs = F.transform(others, lambda o: o[c])
        if not kind.startswith("array"):
            return F.coalesce(keep[c], F.get(F.filter(theirs, lambda x: x.isNotNull()), F.lit(0)))
        none = F.array().cast(kind)
        every = F.array_distinct(F.concat(F.coalesce(keep[c], none), F.flatten(F.transform(theirs, lambda x: F.coalesce(x, none)))))
        return F.when(keep[c].isNotNull() | F.exists(theirs, lambda x: x.isNotNull()), every)

    return F.struct(keep["id"].alias("id"), *[field(c, kind).alias(c) for c, kind in kinds.items()])


def _round(now: DataFrame, ready: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state after, audit, moves) of patches of several entities that no two of share an id."""
    columns = list(kinds)
    entity = now.select("id", F.struct("id", *columns).alias("entity"))
    targets = ready.select("seq", F.posexplode("targets").alias("at", "id")).join(entity, "id", "left")
    held = targets.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("at", "entity"))).alias("held"))
    made = ready.where("op = 'split'").select("seq", F.explode("products.id").alias("id"), F.element_at("targets", 1).alias("own"))
    clash = made.where("id <> own").join(now.select("id"), "id", "left_semi").select("seq").distinct().withColumn("clash", F.lit(True))
    rows = ready.join(held, "seq").join(clash, "seq", "left")
    olds = F.transform("held", lambda h: h["entity"])
    reason = F.when(F.exists(olds, lambda e: e.isNull()), "missing").when(F.col("clash"), "exists")
    keep = F.get(F.filter(olds, lambda e: e["id"] == F.col("keep")), F.lit(0))
    others = F.filter(olds, lambda e: e["id"] != F.col("keep"))
    puts = (
        F.when(F.col("op") == "split", F.transform("products", lambda p: _put(p, columns)))
        .when(F.col("op") == "merge", F.array(_merged(keep, others, kinds)))
        .otherwise(F.filter(olds, lambda e: F.lit(False)))
    )
    rows = rows.select("*", olds.alias("olds"), reason.alias("reason")).withColumn("puts", F.when(F.col("reason").isNull(), puts))
    rows = cut(rows.select("seq", "op", "targets", "keep", "products", "olds", "reason", "puts"))
    good = rows.where("reason IS NULL")
    gone = good.select(F.explode("targets").alias("id"))
    after = now.join(gone, "id", "left_anti").select("id", *columns).unionByName(good.select(F.inline("puts")))
    return after, _audited_many(rows), _moved(rows)


def _audited_many(rows: DataFrame) -> DataFrame:
    attempt = mark(F.col("seq"), F.col("op"), F.col("olds"), F.col("keep"), F.col("products"), F.col("reason"))
    done = F.when(F.size("puts") > 0, mark(F.array_sort("puts"))).otherwise(mark(F.array_sort("targets"), F.lit("deleted")))
    return rows.select(
        "seq", "op", F.when(F.col("reason").isNull(), "applied").otherwise("rejected").alias("status"), "reason",
        mark(F.array_sort("olds")).alias("before"), F.when(F.col("reason").isNull(), done).otherwise(attempt).alias("after"),
    )


def _moved(rows: DataFrame) -> DataFrame:
    good = rows.where("reason IS NULL")
    moves = good.select("seq", F.explode("targets").alias("src"), F.transform("puts", lambda p: p["id"]).alias("to"))
    return moves.select("seq", "src", F.explode_outer("to").alias("dst"))


def _tied(waiting: DataFrame) -> DataFrame:
    """(id, root): the ids of patches of several entities; ids that such patches tie together have one root.

    Ids are known by a hash here. Two that share one would only make one group of two.
    """
    keys = F.transform(F.array_union("targets", "products.id"), lambda i: F.xxhash64(i))
    ties = waiting.select(F.explode(keys).alias("src"), F.array_min(keys).alias("dst"))
    ids = waiting.select(F.explode(F.array_union("targets", "products.id")).alias("id")).distinct().withColumn("node", F.xxhash64("id"))
    return ids.join(components(ties), "node", "left").select("id", F.coalesce("root", "node").alias("root"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _walked(now: DataFrame, events: DataFrame, kinds: dict[str, DataType], names: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(state after, the patches of ``events`` with reason, olds and puts): each root's, one after another.

    ``now``: root, id and columns; ``events``: root and a log's columns.
    """
    columns, given = list(kinds), ["seq", "op", "targets", "keep", "products"]
    entity = StructType().add("id", "string")
    for c, kind in kinds.items():
        entity = entity.add(c, kind)
    entities, told = ArrayType(entity), StructType()
    for c in given:
        told = told.add(c, events.schema[c].dataType)
    told = told.add("reason", "string").add("olds", entities).add("puts", entities)
    rows = events.select("root", F.struct(*given).alias("event")).unionByName(now.select("root", F.struct("id", *columns).alias("entity")), allowMissingColumns=True)
    groups = rows.groupBy("root").agg(F.array_sort(F.collect_list("event")).alias("events"), F.collect_list("entity").cast(entities).alias("now"))

    def reason(now: Column, e: Column, olds: Column) -> Column:
        taken = F.exists(e["products"], lambda p: ~F.array_contains(e["targets"], p["id"]) & F.exists(now, lambda x: x["id"] == p["id"]))
        return F.when((e["op"] != "add") & F.exists(olds, lambda o: o.isNull()), "missing").when(e["op"].isin("add", "split") & taken, "exists")

    def puts(e: Column, olds: Column) -> Column:
        old, new = F.get(olds, F.lit(0)), F.get(e["products"], F.lit(0))
        keep = F.get(F.filter(olds, lambda o: o["id"] == e["keep"]), F.lit(0))
        updated = F.struct(old["id"].alias("id"), *[F.coalesce(new[c], old[c]).alias(c) for c in columns])
        return (
            F.when(e["op"].isin("add", "split"), F.transform(e["products"], lambda p: _put(p, columns)))
            .when(e["op"] == "update", F.array(updated))
            .when(e["op"] == "merge", F.array(_merged(keep, F.filter(olds, lambda o: o["id"] != e["keep"]), names)))
            .otherwise(F.array().cast(entities))
        )

    def step(done: Column, e: Column) -> Column:
        def told_of(olds: Column, why: Column, made: Column) -> Column:
            kept = F.filter(done["now"], lambda x: ~F.array_contains(e["targets"], x["id"]))
            row = F.struct(*[e[c].alias(c) for c in given], why.alias("reason"), olds.alias("olds"), made.alias("puts"))
            return F.struct(F.when(why.isNull(), F.concat(kept, made)).otherwise(done["now"]).alias("now"), F.concat(done["out"], F.array(row)).alias("out"))

        olds = F.transform(e["targets"], lambda t: F.get(F.filter(done["now"], lambda x: x["id"] == t), F.lit(0)))
        return _let(olds, lambda o: _let(reason(done["now"], e, o), lambda w: _let(F.when(w.isNull(), puts(e, o)), lambda m: told_of(o, w, m))))

    start = F.struct(F.col("now").alias("now"), F.array().cast(ArrayType(told)).alias("out"))
    done = cut(groups.select(F.aggregate("events", start, step).alias("done")).select("done.now", "done.out"))
    return done.select(F.inline("now")), done.select(F.inline("out"))


def apply_log(state: DataFrame, patches: DataFrame) -> Applied:
    """Apply ``patches`` to ``state`` in the order of ``seq``, which is unique.

    ``state``: id, kind and any columns. ``patches``: seq, op, kind, targets
    (ids), keep (of a merge) and products, an array of structs of id and the
    state's columns: one for an add or update (its id is the target's in an
    update), one or more for a split. An update's nulls leave old values. A
    split's target goes, its products come, one of which may have its id. A
    merge's targets become the one to keep, which takes from the others what it
    lacks, in their order. A patch that can't hold changes nothing. An id keeps
    the kind under which it was first known.

    Reasons: those of ``_misshapen``, ``kind``, ``missing`` (a target isn't
    there) and ``exists`` (what is to be made is there already). ``before`` is a
    hash of the entities named (of the new one for an add), ``after`` one of what
    they have become, or of the attempt where it was rejected.
    """
    kinds = {f.name: f.dataType.simpleString() for f in state.schema if f.name not in ("id", "kind")}
    columns = list(kinds)
    log = patches.select("seq", "op", "kind", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"), "keep", "products")
    log = log.withColumn("products", F.coalesce("products", F.filter(F.array(F.get("products", F.lit(0))), lambda p: F.lit(False))))
    known = _kinds(state, log)
    named = log.select("seq", "kind", F.explode(F.array_union("targets", F.when(F.col("op") == "update", F.array().cast("array<string>")).otherwise(F.col("products.id")))).alias("id"))
    other = named.join(known, "id").where("kind <> known_kind").select("seq").distinct().withColumn("other_kind", F.lit(True))
    log = log.join(other, "seq", "left").withColumn("reason", F.coalesce(_misshapen(), F.when(F.col("other_kind"), "kind"))).drop("other_kind")
    log = cut(log)
    bad = log.where("reason IS NOT NULL")
    attempt = mark(*[F.col(c) for c in ("seq", "op", "targets", "keep", "products", "reason")])
    whole = mark(*[F.col(c) for c in ("seq", "op", "targets", "keep", "products")])
    audits = [bad.select("seq", "op", F.lit("rejected").alias("status"), "reason", whole.alias("before"), attempt.alias("after"))]
    log = log.where("reason IS NULL")
    single = (F.col("op") == "add") | (F.col("op").isin("update", "delete") & (F.size("targets") == 1))
    one = F.get("products", F.lit(0))
    target = F.when(F.col("op") == "add", one["id"]).otherwise(F.get("targets", F.lit(0)))
    singles = log.where(single).select("seq", "op", target.alias("id"), *[one[c].alias(c) for c in columns])
    waiting = log.where(~single).drop("reason")
    ids = F.explode(F.array_union("targets", "products.id")).alias("id")
    shared = cut(_tied(waiting))
    moves = []

    def deleted(judged: DataFrame) -> DataFrame:
        return judged.where("ok AND op = 'delete'").select("seq", F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"))

    # entities that no patch of several names
    rest = singles.join(shared, "id", "left_anti")
    bare = state.select("id", *columns)
    judged, after = fold(bare.join(rest.select("id").distinct(), "id", "left_semi"), rest, columns)
    judged = cut(judged)
    audits.append(_audited(judged, columns))
    moves.append(deleted(judged))
    alone = bare.join(rest.select("id").distinct(), "id", "left_anti").join(shared, "id", "left_anti").unionByName(after)
    # groups of few patches, each in a row
    placed = log.withColumn("id", target)
    large = placed.groupBy("id").count().join(shared, "id").groupBy("root").agg(F.sum("count").alias("n")).where(F.col("n") > WALKED)
    large = cut(large.select("root"))
    events = placed.join(shared, "id").join(large, "root", "left_anti")
    after, told = _walked(bare.join(shared, "id").join(large, "root", "left_anti"), events, {c: state.schema[c].dataType for c in columns}, kinds)
    alone = alone.unionByName(after)
    row = F.get("olds", F.lit(0)).alias("old"), F.get("puts", F.lit(0)).alias("new")
    audits.append(_audited(told.where(single).select("seq", "op", target.alias("id"), F.col("reason").isNull().alias("ok"), *row, *[one[c].alias(c) for c in columns]), columns))
    audits.append(_audited_many(told.where(~single)))
    moves.append(_moved(told.where(~F.col("op").isin("add", "update"))))
    # those of many, round by round
    shared = shared.join(large, "root", "left_semi").select("id")
    now, left = cut(bare.join(shared, "id", "left_semi")), cut(singles.join(shared, "id", "left_semi"))
    waiting = cut(waiting.withColumn("id", F.get("targets", F.lit(0))).join(shared, "id", "left_semi").drop("id"))
    while some(waiting):
        events = waiting.select("seq", ids)
        first = events.groupBy("id").agg(F.min("seq").alias("first"))
        turn = events.join(first, "id").groupBy("seq").agg(F.max(F.col("seq") > F.col("first")).alias("late")).where("NOT late").select("seq")
        ready = cut(waiting.join(turn, "seq", "left_semi"))
        upto = ready.select(F.col("seq").alias("turn"), ids)
        before = left.join(upto, "id").where("seq < turn").drop("turn")
        judged, after = fold(now.join(before.select("id").distinct(), "id", "left_semi"), before, columns)
        judged = cut(judged)
        audits.append(_audited(judged, columns))
        moves.append(deleted(judged))
        changed = judged.select("id").distinct()
        now = cut(now.join(changed, "id", "left_anti").unionByName(after))
        now, audit, moved = _round(now, ready, kinds)
        audits.append(audit)
        moves.append(moved)
        left = cut(left.join(judged.select("seq"), "seq", "left_anti"))
        now, waiting = cut(now), cut(waiting.join(turn, "seq", "left_anti"))
    if some(large):
        judged, after = fold(now, left, columns)
        judged = cut(judged)
        audits.append(_audited(judged, columns))
        moves.append(deleted(judged))
        alone = alone.unionByName(now.join(judged.select("id").distinct(), "id", "left_anti").unionByName(after))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    found = alone.join(known, "id").select("id", F.col("known_kind").alias("kind"), *columns)
    return Applied(found, union(audits), union(moves))


def lineage(state: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, final_id): what the entities of ``state`` have become in the end, one row each; null for what was deleted.

    An entity's way is a chain of moves, each the first to leave the place that
    the one before has come to. Chains are followed by doubling, so a chain of n
    takes log n joins.
    """
    moves = cut(moves)
    places = moves.select(F.col("src").alias("id"), "seq").distinct()
    arrivals = moves.select(F.col("dst").alias("id"), "seq").where("id IS NOT NULL").distinct()
    later = Window.partitionBy("id").orderBy("seq").rangeBetween(1, Window.unboundedFollowing)
    both = arrivals.withColumn("leaves", F.lit(None).cast("long")).unionByName(places.withColumn("leaves", F.col("seq")))
    ahead = both.select("id", "seq", F.min("leaves").over(later).alias("next")).distinct()
    # from each departure to the next one, or to an end
    hops = moves.join(ahead.select(F.col("id").alias("dst"), "seq", "next"), ["dst", "seq"], "left")
    hops = hops.select("src", "seq", "dst", "next").distinct()
    hops = cut(hops)
    ended, going = hops.where("next IS NULL"), hops.where("next IS NOT NULL")
    while some(going):
        onward = ended.unionByName(going).select(F.col("src").alias("dst"), F.col("seq").alias("next"), F.col("dst").alias("_dst"), F.col("next").alias("_next"))
        moved = going.join(onward, ["dst", "next"]).select("src", "seq", F.col("_dst").alias("dst"), F.col("_next").alias("next"))
        moved = cut(moved.distinct())
        ended, going = ended.unionByName(moved.where("next IS NULL")), moved.where("next IS NOT NULL")
    first = places.groupBy("id").agg(F.min("seq").alias("seq"))
    found = first.join(ended.select(F.col("src").alias("id"), "seq", F.col("dst").alias("final_id")), ["id", "seq"]).drop("seq").distinct()
    started = state.select("id").join(found.withColumn("_moved", F.lit(True)), "id", "left")
    return started.select("id", F.when(F.col("_moved"), F.col("final_id")).otherwise(F.col("id")).alias("final_id"))
