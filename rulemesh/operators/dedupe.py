"""Set operations and deduplication."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import spread, tasks
from .steps import cut

#: Items and classes of a chunk of a block at most, about; rows and words that are multiplied at once.
MET_ITEMS, MET_ROWS, MET_SLICE = 1 << 20, 1 << 12, 1 << 10


def first_seen(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Each key once with its first position."""
    return rows.groupBy(key).agg(F.min(position).alias(position))


def near_duplicates(rows: DataFrame, group: Column, key: str) -> DataFrame:
    """Groups of more than one row: (group, n, keys)."""
    found = rows.groupBy(group.alias("group_key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("keys"))
    return found.where("n > 1")


def merge_map(rows: DataFrame, group: Column, key: str, order: list[Column]) -> DataFrame:
    """(key, canonical) of each row: its group's first by ``order``."""
    marked = rows.select(F.col(key), group.alias("_group"), F.struct(*order, F.col(key)).alias("_order"))
    best = marked.groupBy("_group").agg(F.min_by(key, "_order").alias("canonical"))
    return marked.join(best, "_group").select(key, "canonical")


def remap(rows: DataFrame, column: str, merged: DataFrame, key: str) -> DataFrame:
    """``rows`` with ids in ``column`` replaced by their canonical ones."""
    names = merged.select(F.col(key).alias("_old"), F.col("canonical").alias("_new"))
    joined = rows.join(names, rows[column] == names["_old"], "left")
    return joined.withColumn(column, F.coalesce("_new", F.col(column))).drop("_old", "_new")


def similar_pairs(rows: DataFrame, block: str, key: str, items: str, least: float) -> DataFrame:
    """Pairs of one block with a Jaccard similarity of their arrays of at least ``least``.

    Rows of a block with the same set are one class. Classes of a block are cut
    into chunks by size, and chunks whose sizes allow such a similarity meet, each
    two once; what classes share is counted there for all pairs at once (see
    ``overlaps``). What is found is then spread over the rows of both classes.
    """
    # a null is no shared item but counts in the size
    listed = F.sort_array(F.array_distinct(items))
    sets = rows.select(block, F.col(key).alias("key"), listed.alias("_d")).where(F.size(F.array_compact("_d")) > 0).dropna(subset=[block])
    sets = sets.withColumn("d", F.to_json(F.transform("_d", lambda x: x.cast("string")))).withColumn("kind", F.unhex(F.sha2("d", 256)))
    # sets are found anew rather than written out: only what tells them apart is
    members = cut(sets.select(block, "kind", "key", F.size("_d").alias("n"), F.size(F.array_compact("_d")).alias("known")))
    classes = members.groupBy(block, "kind").agg(F.first("n").alias("n"), F.first("known").alias("known"))
    order = Window.partitionBy(block).orderBy("n", "kind").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.greatest("n", F.lit(MET_ITEMS // MET_ROWS))).over(order), F.lit(0))
    dealt = cut(classes.withColumn("_c", F.floor(before / MET_ITEMS).cast("int")))
    chunks = dealt.groupBy(block, "_c").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("rows"))
    reach = chunks.select(block, F.col("_c").alias("_k"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    near = (F.col("hi") >= least * F.col("_lo")) & (F.col("_hi") >= least * F.col("lo")) & ((F.col("_c") != F.col("_k")) | (F.col("rows") > 1))
    places = chunks.join(reach.hint("merge"), block).where(near).groupBy(block, "_c").agg(F.collect_list("_k").alias("_with"))
    meeting = dealt.join(places.hint("merge"), [block, "_c"]).select(block, "kind", "n", "_c", "_with")
    whole = sets.select(block, "kind", "d").groupBy(block, "kind").agg(F.first("d").alias("d")).join(meeting.hint("merge"), [block, "kind"])
    whole = whole.select("*", F.explode("_with").alias("_k"))
    whole = whole.select(block, F.least("_c", "_k").alias("_i"), F.greatest("_c", "_k").alias("_j"), (F.col("_c") > F.col("_k")).alias("_late"), "kind", "n", "d")
    n = tasks(rows)
    kind = rows.schema[block].dataType.simpleString()
    met = whole.repartition(n, block, "_i", "_j").sortWithinPartitions(block, "_i", "_j")
    met = met.mapInArrow(lambda batches: overlaps(batches, block, least), f"`{block}` {kind}, a_kind binary, b_kind binary, jaccard double")
    same = dealt.select(block, F.col("kind").alias("a_kind"), F.col("kind").alias("b_kind"), (F.col("known").cast("double") / (2 * F.col("n") - F.col("known"))).alias("jaccard"))
    found = same.where(F.col("jaccard") >= least).unionByName(met)
    # a class and itself once, two classes once: in either order of their rows' keys
    twice = (F.col("a_kind") != F.col("b_kind")) | (F.col("a_key") < F.col("b_key"))
    pairs = spread(found, members.select(block, "kind", "key"), [block], ["key"], twice & (F.col("a_key") != F.col("b_key")))
    return pairs.select(F.least("a_key", "b_key").alias(key), F.greatest("a_key", "b_key").alias("other"), "jaccard")


def overlaps(batches: Iterator[pa.RecordBatch], block: str, least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of classes of each place (``block``, _i, _j), whose rows follow each other, that are ``least`` alike or more."""
    held: list[pa.RecordBatch] = []

    def place(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        late = np.array(rows["_late"].to_pylist(), bool)
        words = [[x for x in json.loads(d) if x is not None] for d in rows["d"].to_pylist()]
        kinds, n = rows["kind"].combine_chunks(), rows["n"].to_numpy().astype(np.int64)
        alone = rows["_i"][0].as_py() == rows["_j"][0].as_py()
        left, right = (np.arange(len(n)),) * 2 if alone else (np.flatnonzero(~late), np.flatnonzero(late))
        for k, shared in _shared(words, left, right):
            some_ = left[k : k + len(shared)]
            alike = shared / (n[some_, None] + n[None, right] - shared)
            at, to = np.nonzero(alike >= least)
            if alone:
                at, to = at[k + at < to], to[k + at < to]
            if len(at):
                name = pa.array([rows[block][0].as_py()] * len(at), rows.schema.field(block).type)
                yield pa.RecordBatch.from_arrays([name, kinds.take(pa.array(some_[at])), kinds.take(pa.array(right[to])), pa.array(alike[at, to])], names=[block, "a_kind", "b_kind", "jaccard"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (block, "_i", "_j"))))
        at = 0
        for k, one in enumerate(keys):
            if one != last:
                if k > at:
                    held.append(batch.slice(at, k - at))
                if held:
                    yield from place(pa.Table.from_batches(held))
                held, at, last = [], k, one
        held.append(batch.slice(at))
    if held:
        yield from place(pa.Table.from_batches(held))


def _shared(words: list[list[str]], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of ``left`` (where each begins) with how many words each row shares with each of ``right``.

    Words of many rows are counted by a product of matrices, in which numbers up
    to 2 ** 24 are exact, others by their rows.
    """
    index: dict[str, int] = {}
    ids = [np.fromiter((index.setdefault(w, len(index)) for w in row), np.int64, len(row)) for row in words]

    def by_word(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word = np.concatenate([ids[r] for r in rows]) if len(rows) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(rows)), [len(ids[r]) for r in rows])
        order = np.argsort(word, kind="stable")
        return word[order], row[order], np.bincount(word, minlength=len(index))

    word_b, row_b, count_b = by_word(right)
    first_b = np.cumsum(count_b) - count_b
    for k in range(0, len(left), MET_SLICE):
        part = left[k : k + MET_SLICE]
        word_a, row_a, count_a = by_word(part)
        dense = count_a * count_b * 256 > len(part) * len(right)
        shared = np.zeros((len(part), len(right)), np.float32)
        column = np.cumsum(dense) - 1
        for c in range(0, int(dense.sum()), MET_SLICE):
            sides = []
            for word, row, size in ((word_a, row_a, len(part)), (word_b, row_b, len(right))):
                mine = dense[word] & (column[word] >= c) & (column[word] < c + MET_SLICE)
                sides.append(side := np.zeros((size, MET_SLICE), np.float32))
                side[row[mine], column[word[mine]] - c] = 1
            shared += sides[0] @ sides[1].T
        rare = ~dense[word_a] & (count_b[word_a] > 0)
        word, row = word_a[rare], row_a[rare]
        ends = np.cumsum(count_b[word])
        at = 0
        while at < len(word):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), "right")))
            times = count_b[word[at:to]]
            begin = np.repeat(first_b[word[at:to]] - (np.cumsum(times) - times), times)
            np.add.at(shared, (np.repeat(row[at:to], times), row_b[begin + np.arange(len(begin))]), np.float32(1))
            at = to
        yield k, shared.astype(np.int64)


def unordered_pairs(rows: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """One row for each unordered pair: the first by ``order``."""
    low, high = F.least(a, b), F.greatest(a, b)
    w = Window.partitionBy(low, high).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def by_content(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Rows with the same content once, with a hash of it and the keys that share it."""
    content = F.to_json(F.struct(*columns))
    hashed = rows.withColumn("content_hash", F.substring(F.sha1(content), 1, 16))
    return hashed.groupBy("content_hash").agg(F.min(key).alias(key), F.count("*").alias("n"))


def admitted_singletons(groups: DataFrame, units: DataFrame, least: int = 2) -> DataFrame:
    """Groups of a single run that are verified and cover a unit no consensus group covers.

    ``groups``: (group, runs, verified); ``units``: (group, unit).
    """
    consensus = units.join(groups.where(F.col("runs") >= least).select("group"), "group", "left_semi").select("unit").distinct()
    alone = groups.where((F.col("runs") < least) & F.col("verified")).select("group")
    return units.join(alone, "group", "left_semi").join(consensus, "unit", "left_anti").select("group").distinct()


def symmetric_parts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key with where it is: a, b or both."""
    rows = a.select(key, F.lit(1).alias("_w")).union(b.select(key, F.lit(2).alias("_w"))).distinct()
    where = F.sum("_w")
    return rows.groupBy(key).agg(F.when(where == 3, "both").when(where == 1, "a").otherwise("b").alias("side"))
