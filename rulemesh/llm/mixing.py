"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents stand in a keyed random order and are cut into blocks
of equal word counts, the order starting anew when it is used up. A source's
target gives the number of its blocks. The schedule has one slot for each
block of the mix: slot j gets the point (j * a mod N) / N, where a / N is the
golden ratio as nearly as numbers prime to N allow that spread well (their
continued fractions have small terms, as the golden ratio's), and the point falls into
one source's part of the cumulated weights. As the points of all N slots are
distinct, each source gets exactly its blocks, evenly spread. The k-th slot of
a source takes its k-th block. What stands where in the mix is thus the slots'
order; ``whole_documents`` returns documents in it.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, fresh, partitions, read_table, row_marks, running

WEIGHTS = (5, 2, 1)
#: Words of the mix, as a multiple of all words, and the most of a source's words.
SHARE, MOST = 1.5, 2
#: Words of a block.
BLOCK = 1024
SEED = "mix-1"
#: Slots that one row expands to.
RUN = 4096


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def largest_quotient(a: int, n: int) -> int:
    """The largest term of the continued fraction of a / n; points of a step a spread the better the smaller it is."""
    out = 0
    while n:
        out, a, n = max(out, a // n), n, a % n
    return out


def golden_step(n: int) -> int:
    """A number prime to n close to n / phi; of the nearest ones that whose multiples spread best."""
    near = round(n * 0.6180339887498949)
    tried = [a for d in range(100) for a in {near + d, near - d} if 0 < a <= n and gcd(a, n) == 1]
    return min(tried, key=lambda a: (largest_quotient(a, n), abs(a - near), a))


def _running(rows: DataFrame, value: str, group: str, bucket: str, order: list[str]) -> DataFrame:
    """``rows`` with the sum of ``value`` before each row of its group, as ``before``.

    ``bucket`` ascends with ``order``; the sums of buckets are added up first,
    so no task takes more than a bucket of a group.
    """
    first = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    sums = sums.select(group, bucket, F.coalesce(F.sum("_sum").over(first), F.lit(0)).alias("_first"))
    own = rows.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    # the window has sorted the rows by what they are joined on
    return own.join(sums.hint("merge"), [group, bucket]).withColumn("before", F.col("_first") + F.col("_own")).drop("_first", "_own")


def targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """(source, number, source_size, weight, target) of each source of ``sized`` (columns source, size).

    Sources are numbered by code point, null last, and weighed by ``weights``
    over and over. Targets share ``share`` times all words by weight; none is
    above ``most`` times its source's words, the excess being shared anew by
    weight. With sources ordered by what their limit allows for a unit of
    weight, the limited ones come first, so running sums show where they end.
    Sources may be many: no task takes all of them.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = running(rows.withColumn("nothing", F.col("source").isNull()), ["nothing", "source"], [])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = rows.select("source", F.col("place").alias("number"), "source_size", weight.cast("double").alias("weight"))
    rows = rows.withColumn("limit", F.col("source_size").cast("double") * F.lit(float(most)))
    rows = cut(running(rows.withColumn("unit", F.col("limit") / F.col("weight")), ["unit", "number"], ["limit", "weight"]))
    whole = rows.agg(F.sum(F.col("source_size").cast("double")), F.sum("weight")).first()
    level = (F.lit((whole[0] or 0.0) * share) - F.col("before_limit")) / (F.lit(whole[1] or 0.0) - F.col("before_weight"))
    rows = rows.withColumn("level", level)
    free = rows.where(F.col("level") <= F.col("unit")).agg(F.min(F.struct("place", "level"))).first()[0]
    target = F.col("limit")
    if free is not None:
        target = F.when(F.col("place") >= F.lit(free["place"]), F.lit(free["level"]) * F.col("weight")).otherwise(target)
    return rows.select("source", "number", "source_size", "weight", target.alias("target"))


def _blocks(block: int) -> Column:
    return F.ceil(F.floor("target") / F.lit(block)).cast("long")


def total_slots(sources: DataFrame, block: int = BLOCK) -> int:
    return sources.agg(F.sum(_blocks(block))).first()[0] or 0


def schedule(sources: DataFrame, block: int = BLOCK, total: int | None = None) -> DataFrame:
    """(slot, number, block): which block of which source each slot takes; ``sources`` as ``targets`` gives them.

    Slots are numbered from 0 on; a source's last block may be cut short.
    ``total``: as ``total_slots`` gives it.
    """
    spark = sources.sparkSession
    total = total_slots(sources, block) if total is None else total
    counted = running(sources.select("number", _blocks(block).alias("blocks")).where("blocks > 0"), ["number"], ["blocks"])
    step = golden_step(total) if total else 1
    back = pow(step, -1, total) if total > 1 else 0
    # points of a source, dealt out in short runs so that a large source isn't one task
    dealt = counted.select(
        "number", "blocks", "before_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / RUN))).alias("run")
    ).repartition(partitions(spark), "number", "run")
    low, high = F.col("run") * RUN, F.least(F.col("blocks"), (F.col("run") + 1) * RUN) - 1
    points = F.sequence(F.col("before_blocks") + low, F.col("before_blocks") + high)
    # a product of two numbers below the total
    kind = "long" if total < 3_000_000_000 else "decimal(19,0)"
    slot = F.pmod(F.col("point").cast(kind) * F.lit(back).cast(kind), F.lit(max(total, 1)).cast(kind)).cast("long")
    slots = dealt.select("number", F.explode(points).alias("point")).select("number", slot.alias("slot"))
    width = max(1, -(-total // (4 * partitions(spark))))
    slots = slots.withColumn("_bucket", F.floor(F.col("slot") / width)).withColumn("one", F.lit(1))
    return _running(slots, "one", "number", "_bucket", ["slot"]).select("slot", "number", F.col("before").alias("block"))


def _mark(name: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(name.cast("string"), F.lit(""))))


def _placed(sized: DataFrame, weights, share, most) -> tuple[DataFrame, DataFrame]:
    """``sized`` (id, source, size, mark and more) with ``start``, the words before it in its source's order, and the sources."""
    sources = cut(targets(sized, weights, share, most))
    named = sized.join(sources, sized.source.eqNullSafe(sources.source)).drop("source")
    lead = F.conv(F.substring("mark", 1, 8), 16, 10).cast("long")
    rows = named.withColumn("_bucket", F.shiftright(lead * F.lit(4 * partitions(sized.sparkSession)), 32))
    rows = _running(rows, "size", "number", "_bucket", ["mark", "id", "size"])
    return rows.withColumnRenamed("before", "start").drop("_bucket", "mark", "weight"), sources


def _spans(rows: DataFrame, most: int, block: int) -> DataFrame:
    """(number, block, id, start, pass, skip, words): the parts of the blocks of each source, document by document.

    ``skip`` counts the document's words before the part.
    """
    passes = F.explode(F.array(*[F.lit(p) for p in range(most)])).alias("pass")
    runs = rows.where("size > 0").select("*", passes)
    low = F.col("pass") * F.col("source_size") + F.col("start")
    runs = runs.withColumn("low", low).withColumn("high", F.least(low + F.col("size"), F.floor("target")))
    cut_up = runs.where("low < high").select(
        "*", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))).alias("block")
    )
    begin = F.greatest("low", F.col("block") * block)
    end = F.least("high", (F.col("block") + 1) * block)
    return cut_up.select("number", "block", "id", "start", "pass", (begin - F.col("low")).alias("skip"), (end - begin).alias("words"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block: int = BLOCK,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The mix and the documents.

    The mix has a row for each part of a document in a slot: (slot, number,
    block, id, start, pass, skip, words); ordered by slot, block and start it is
    the mixed corpus. The documents: (id, size, number, source_size, target,
    start), one for each row of ``docs``; (number, start) tells rows with words
    apart. A null text has no words, a null source is a source of its own, a
    null id takes part like any other. Ties in the order are broken by id and
    size, so equal rows are interchangeable. Other columns are not read.
    """
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("size"), _mark(F.col(id_col), seed).alias("mark")
    )
    rows, sources = _placed(cut(sized), weights, share, most)
    rows = cut(rows.select("id", "size", "number", "source_size", "target", "start"))
    # the optimiser takes the schedule, made from a row for each source, for a small table
    return schedule(sources, block).hint("merge").join(_spans(rows, most, block), ["number", "block"]), rows


def taken(mixed: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with what the mix takes of each: ``taken`` words, repeats counted, in ``n_parts`` parts from ``first_slot`` to ``last_slot``.

    A document that isn't taken has no parts and null slots.
    """
    words = mixed.groupBy(F.col("number").alias("_number"), F.col("start").alias("_start")).agg(
        F.sum("words").alias("taken"), F.count("*").alias("n_parts"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")
    )
    same = (rows.number == F.col("_number")) & (rows.start == F.col("_start")) & (rows.size > 0)
    return rows.join(words, same, "left").select(
        *rows.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_parts")], "first_slot", "last_slot"
    )


#: Copies of one row that are kept in one list.
COPIES = 1024


def whole_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block: int = BLOCK,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` as often as the mix takes them, 0 to ``most`` times, none cut, in the order of the mix.

    A copy is there if the middle of its words lies within its source's target,
    so a source misses its target by half a document at most. It stands in the
    slot of the block that has its middle, within a slot by its place in its
    source; partitions are contiguous runs of slots, so files in the order of
    their names are the mixed corpus. Rows that are equal in all columns follow
    one another in their source's order and are counted each; rows that only
    share an id are different ones. A document without words isn't in any mix;
    null ids, sources and texts are as in ``mix``. Columns stay as they are,
    whatever their names. A very long text takes its one slot.
    """
    spark = docs.sparkSession
    names = fresh(docs, "_text_hash", "_more_hash", "_rest_hash", "_place", "_copies")
    marks, place, copies = names[:3], *names[3:]
    marked = docs.select("*", *[m.alias(n) for m, n in zip(row_marks(docs, id_col, text_col), marks)])
    sized = marked.select(
        *marks, F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("unit")
    )
    # equal rows are one row that is longer
    sized = sized.groupBy(*marks).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("id", "source", "unit")])
    sized = cut(sized.withColumn("size", F.col("n") * F.col("unit")).withColumn("mark", _mark(F.col("id"), seed)))
    rows, sources = _placed(sized, weights, share, most)
    total = total_slots(sources, block)
    if not total:
        return docs.limit(0)
    runs = rows.where("size > 0").select("*", F.explode(F.array(*[F.lit(p) for p in range(most)])).alias("pass"))
    runs = runs.withColumn("low", F.col("pass") * F.col("source_size") + F.col("start"))
    # copies whose middle is within the target: 2 (low + k unit) + unit <= 2 target
    room = 2 * F.floor("target") - F.col("unit") - 2 * F.col("low")
    runs = runs.withColumn("here", F.when(room >= 0, F.least("n", F.floor(room / (2 * F.col("unit"))) + 1)).otherwise(0)).where("here > 0")
    each = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("here") - 1)).alias("k"))
    each = each.withColumn("at", F.col("low") + F.col("k") * F.col("unit"))
    middle = F.floor((2 * F.col("at") + F.col("unit") - 1) / (2 * block))
    each = each.select(*marks, "number", "k", "at", middle.alias("block"))
    slotted = each.join(schedule(sources, block, total).hint("merge"), ["number", "block"])
    listed = slotted.groupBy(*marks, F.floor(F.col("k") / COPIES)).agg(F.collect_list(F.struct("slot", "at", "number")).alias(copies))
    first = Window.partitionBy(*marks).orderBy(*marks)
    one = marked.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    found = one.join(listed.select(*marks, copies), marks).withColumn(place, F.explode(copies))
    parts = partitions(spark)
    where = F.floor(F.col(place)["slot"] * F.lit(parts) / F.lit(total)).cast("int")
    return found.repartitionById(parts, where).sortWithinPartitions(F.col(place)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken, n_parts, first_slot, last_slot) of each document.

    Null texts and ids, repeated rows, ties and an empty table are as in
    ``mix``; a very long text is counted in its row and takes many slots.
    """
    found = taken(*mix(read_table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "n_parts", "first_slot", "last_slot")


OP10_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS mark
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE number % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size::DOUBLE * 2 AS most
  FROM totals),
levels AS (
  SELECT *, row_number() OVER o AS place,
         ((SELECT sum(source_size)::DOUBLE FROM totals) * 1.5::DOUBLE
          - coalesce(sum(most) OVER (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY most / weight, number)),
free AS (SELECT min(place) AS place FROM levels WHERE level <= most / weight),
aims AS (
  SELECT source, number, source_size,
         CASE WHEN l.place >= f.place THEN (SELECT level FROM levels x WHERE x.place = f.place) * weight ELSE most END AS target
  FROM levels l, free f),
placed AS (
  SELECT s.doc_id, s.size, a.number, a.source_size, a.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY mark, doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
blocks AS (SELECT number, ceil(floor(target) / 1024)::BIGINT AS blocks FROM aims),
bounds AS (
  SELECT *, coalesce(sum(blocks) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM blocks WHERE blocks > 0),
total AS (SELECT sum(blocks)::BIGINT AS n, round_even(sum(blocks) * 0.6180339887498949::DOUBLE, 0)::BIGINT AS near FROM bounds),
euclid(a, x, y, q) AS (
  SELECT a, a, n, 0::BIGINT FROM total, LATERAL (SELECT unnest(generate_series(greatest(1, near - 99), least(n, near + 99))) AS a)
  UNION ALL SELECT a, y, x % y, greatest(q, x // y) FROM euclid WHERE y > 0),
step AS (SELECT a FROM euclid, total WHERE y = 0 AND x = 1 ORDER BY q, abs(a - near), a LIMIT 1),
slots AS (SELECT slot, (slot * a) % n AS point FROM total, step, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS slot)),
scheduled AS (
  SELECT slot, number, row_number() OVER (PARTITION BY number ORDER BY slot) - 1 AS block
  FROM slots JOIN bounds ON point >= first AND point < first + blocks),
runs AS (
  SELECT number, start, p * source_size + start AS low, least(p * source_size + start + size, floor(target)::BIGINT) AS high
  FROM placed, (VALUES (0), (1)) v(p) WHERE size > 0),
parts AS (SELECT number, start, low, high, unnest(generate_series(low // 1024, (high - 1) // 1024)) AS block FROM runs WHERE low < high),
found AS (
  SELECT number, start, sum(least(high, (block + 1) * 1024) - greatest(low, block * 1024))::BIGINT AS taken,
         count(*) AS n_parts, min(slot) AS first_slot, max(slot) AS last_slot
  FROM parts JOIN scheduled USING (number, block) GROUP BY number, start)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(n_parts, 0) AS n_parts, first_slot, last_slot
FROM placed p LEFT JOIN found f ON p.number = f.number AND p.start = f.start AND size > 0
"""
