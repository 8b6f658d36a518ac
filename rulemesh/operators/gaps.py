"""Rounds that close gaps: units that nothing claims are asked for again, blob by blob, until all are claimed or nothing helps.

Replies are a table by round, so a loop around a model and a rerun over stored
replies are the same. State is four tables; a round joins what is open with its replies and
writes the new state, and only whether something is open or has changed reaches
the driver. A blob that a round didn't help is asked once more as a whole
(escalated); what it then says replaces its rules and relations.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import cut, some

# Kinds of tokens, and rounds at most.
TOKENS = ("token_primitive", "token_semantic")
ROUNDS = 3


@dataclass(frozen=True)
class Closed:
    """``open``: units left; ``rounds``: (round, doc_ref, mode, before, after); ``rejects``: (round, doc_ref, id, reason)."""

    entities: DataFrame
    relations: DataFrame
    open: DataFrame
    rounds: DataFrame
    rejects: DataFrame
    stopped: str


def unclaimed(units: DataFrame, entities: DataFrame) -> DataFrame:
    """(unit_id, doc_ref, yields) of required units that no entity claims."""
    claims = entities.select(F.explode("unit_ids").alias("unit_id")).distinct()
    return units.where("required").join(claims, "unit_id", "left_anti").select("unit_id", "doc_ref", "yields")


def judged(payload: DataFrame, entities: DataFrame) -> DataFrame:
    """``payload`` with the kind each row has, and why it can't have one.

    A token's kind is that of the token there is, else its marker, else
    primitive where its blob's open units yield primitive tokens and no
    semantic ones. What an id is it stays; of several blobs that make one id in
    a round, the first by name says what it is.
    """
    rows = payload.join(entities.select("id", F.col("kind").alias("old")), "id", "left")
    token, primitive, semantic = F.col("kind") == "token", *(F.array_contains("yields", x) for x in TOKENS)
    guessed = F.when(primitive & ~semantic, TOKENS[0])
    made = F.when(~token, F.col("kind")).when(F.col("old").isin(*TOKENS), F.col("old")).otherwise(F.coalesce("marker", guessed))
    rows = rows.withColumn("made", made)
    wrong = F.when(token & ~F.col("marker").isin(*TOKENS), "invalid_kind").when(F.col("made").isNull(), "kind_missing")
    wrong = wrong.when((F.col("old") != F.col("made")) | (token & F.col("old").isin(*TOKENS) & (F.col("marker") != F.col("old"))), "kind_conflict")
    rows = cut(rows.withColumn("wrong", wrong))
    first = rows.where("wrong IS NULL AND old IS NULL").groupBy("id").agg(F.min_by("made", "doc_ref").alias("first"))
    later = F.when(F.col("wrong").isNull() & (F.col("made") != F.col("first")), "kind_conflict")
    return rows.join(first, "id", "left").withColumn("wrong", F.coalesce("wrong", later)).drop("first", "old")


def close_gaps(units: DataFrame, entities: DataFrame, relations: DataFrame, replies: DataFrame, links: DataFrame, rounds: int = ROUNDS) -> Closed:
    """Run at most ``rounds`` rounds.

    ``units``: unit_id, doc_ref, required, yields; ``entities``: id, kind,
    doc_ref, value, unit_ids (what they claim); ``relations``: doc_ref,
    relation. ``replies``: round, doc_ref, mode (gap_patch or escalate), id,
    kind (token, rule, asset, subtype, template), marker, value, unit_ids,
    verified; ``links``: round, doc_ref, mode, relation. A blob without any row
    in a round gave no answer.

    A blob's reply with any row of a wrong kind is rejected as a whole, a row
    that isn't verified by itself. Nulls in an update leave old values; of
    several blobs that give an id in a round the last by name counts. An
    escalated blob whose rows all were applied loses the rules that it doesn't
    name, and its relations are those named; any other reply whose rows all were
    applied adds its relations.

    Stops: empty_queue (nothing open), zero_progress (the same units open after
    a round, and no blob left to escalate), max_rounds. A blob is escalated
    once, in the round after one that left it as many open units.
    """
    spark = units.sparkSession
    if rounds < 1:
        raise ValueError("at least one round")
    now, linked = cut(entities.select("id", "kind", "doc_ref", "value", "unit_ids")), cut(relations.select("doc_ref", "relation").distinct())
    left = cut(unclaimed(units, now))
    escalate = spark.createDataFrame([], "doc_ref string")
    escalated, logs, rejects, stopped = escalate, [], [], "max_rounds"
    for n in range(1, rounds + 1):
        if not some(left):
            stopped = "empty_queue"
            break
        asked = left.groupBy("doc_ref").agg(F.count("*").alias("before"), F.array_distinct(F.flatten(F.collect_set("yields"))).alias("yields"))
        asked = asked.join(escalate.withColumn("_again", F.lit(True)), "doc_ref", "left").withColumn("mode", F.when(F.col("_again"), "escalate").otherwise("gap_patch")).drop("_again")
        asked = cut(asked)
        rows = cut(judged(replies.where(F.col("round") == n).join(asked.select("doc_ref", "mode", "yields"), ["doc_ref", "mode"]), now))
        said = links.where(F.col("round") == n).join(asked.select("doc_ref", "mode"), ["doc_ref", "mode"])
        bad = rows.where("wrong IS NOT NULL").select("doc_ref").distinct()
        good = rows.join(bad, "doc_ref", "left_anti")
        reason = F.coalesce("wrong", F.lit("unverified"))
        rejects.append(rows.where("wrong IS NOT NULL").unionByName(good.where("NOT verified")).select(F.lit(n).alias("round"), "doc_ref", "id", reason.alias("reason")))
        answered = rows.select("doc_ref", "mode").union(said.select("doc_ref", "mode")).distinct()
        whole = cut(answered.join(bad, "doc_ref", "left_anti").join(good.where("NOT verified").select("doc_ref").distinct(), "doc_ref", "left_anti"))
        # the new state
        order = F.struct("doc_ref", "value", F.array_join("unit_ids", ","))
        given = good.where("verified").groupBy("id").agg(
            F.min_by("made", "doc_ref").alias("n_kind"), F.min("doc_ref").alias("n_doc"), F.max_by("value", F.when(F.col("value").isNotNull(), order)).alias("n_value"),
            F.max_by("unit_ids", F.when(F.col("unit_ids").isNotNull(), order)).alias("n_units"),
        )
        merged = now.join(given, "id", "full").select(
            "id", F.coalesce("kind", "n_kind").alias("kind"), F.coalesce("doc_ref", "n_doc").alias("doc_ref"), F.coalesce("n_value", "value").alias("value"), F.coalesce("n_units", "unit_ids").alias("unit_ids")
        )
        again = whole.where("mode = 'escalate'").select("doc_ref")
        old_rules = now.where("kind = 'rule'").join(again, "doc_ref", "left_semi").select("doc_ref", "id")
        gone = old_rules.join(rows.where("made = 'rule'").select("doc_ref", "id"), ["doc_ref", "id"], "left_anti").select("id")
        now = cut(merged.join(gone, "id", "left_anti"))
        added = said.join(whole.select("doc_ref"), "doc_ref", "left_semi").select("doc_ref", "relation")
        linked = cut(linked.join(again, "doc_ref", "left_anti").union(added).distinct())
        # what it has changed
        after = cut(unclaimed(units, now))
        counted = asked.join(after.groupBy("doc_ref").agg(F.count("*").alias("after")), "doc_ref", "left").withColumn("after", F.coalesce("after", F.lit(0)))
        logs.append(counted.select(F.lit(n).alias("round"), "doc_ref", "mode", "before", "after"))
        escalated = cut(escalated.union(escalate).distinct())
        escalate = cut(counted.where("after >= before").select("doc_ref").join(escalated, "doc_ref", "left_anti"))
        ids = [x.select("unit_id") for x in (left, after)]
        same = not some(ids[0].join(ids[1], "unit_id", "left_anti")) and not some(ids[1].join(ids[0], "unit_id", "left_anti"))
        left = after
        if not some(left):
            stopped = "empty_queue"
            break
        if same and not (n < rounds and some(escalate)):
            stopped = "zero_progress"
            break
    union = lambda frames, kind: reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], kind)
    return Closed(
        now, linked, left, union(logs, "round int, doc_ref string, mode string, before long, after long"), union(rejects, "round int, doc_ref string, id string, reason string"), stopped
    )
