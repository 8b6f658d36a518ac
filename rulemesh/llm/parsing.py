"""Fingerprints by locally consistent parsing.

A text's characters are the lowest level of names. At each level runs of one
name are drawn together, deterministic coin tossing gives every name a small
label that differs from its neighbours' and depends on the name and its few left
neighbours only, and the names are cut into phrases at the labels' local maxima.
A phrase's name is a hash of the names in it, so equal phrases have equal names
everywhere, and the names of the next level are the phrases' names. What stands
well inside a substring is therefore cut and named alike wherever the substring
occurs; only phrases near its ends can differ.

A fingerprint is a sketch of the set of phrase names from level ``FIRST_LEVEL``
up (about 15 characters a phrase and more): for each of ``SLOTS`` classes of
names the lowest hash. The likeness of two fingerprints estimates the Jaccard
similarity of the sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import map_arrow, partitions, read_table
from ._text import slices, text_column

FIRST_LEVEL = 3
SLOTS = 64
#: Rounds of coin tossing: 64-bit names become labels below 128, 14, 8, and then 6.
ROUNDS = 4
_EMPTY = np.uint16(0xFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _bounds(size: int, first: np.ndarray) -> np.ndarray:
    """Which of ``size`` places starts a text; ``first`` has no empty texts."""
    out = np.zeros(size, bool)
    out[first] = True
    return out


def draw_together(names: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one name as one name; ``head`` marks where texts start."""
    start = head.copy()
    start[1:] |= names[1:] != names[:-1]
    if start.all():
        return names, head
    at = np.flatnonzero(start)
    length = np.diff(np.append(at, len(names)))
    out = names[at].astype(np.uint64)
    long = length > 1
    out[long] = _mix(out[long] + _mix(length[long].astype(np.uint64) + np.uint64(1 << 50)))
    return out, head[at]


def labels(names: np.ndarray, head: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Coin tossing: twice the lowest place in which a name differs from the one before, plus its bit there."""
    now = names
    for _ in range(rounds):
        before = np.empty_like(now)
        before[1:] = now[:-1]
        before[head] = ~now[head]  # a text's first name differs in the lowest bit
        differ = now ^ before
        one = np.ones(1, now.dtype)
        place = np.bitwise_count((differ & (~differ + one)) - one)
        now = (2 * place + ((now >> place.astype(now.dtype)) & one).astype(np.uint8)).astype(np.uint8)
    return now


def cut_phrases(label: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Where phrases start: at local maxima of the labels, and at texts' starts."""
    peak = np.zeros(len(label), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    # a text's first two names stand together, and its last is never alone
    tail = np.zeros(len(label), bool)
    tail[:-1] = head[1:]
    if len(label):
        tail[-1] = True
    peak[1:] &= ~head[:-1]
    return (peak & ~tail) | head


def phrase_names(names: np.ndarray, start: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(start)
    length = np.diff(np.append(at, len(names)))
    place = np.arange(len(names)) - np.repeat(at, length)
    power = _powers(int(length.max(initial=1)))
    total = np.add.reduceat(_mix(names.astype(np.uint64)) * power[place], at)
    return _mix(total + _mix(length.astype(np.uint64)))


def levels(codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(names, text of each name) of each level from 0 up; ends when every text is one name.

    ``codes``: characters of all texts, ``first``, ``size``: where each text
    starts and how long it is. A text that is one name leaves the next levels.
    """
    owner = np.repeat(np.arange(len(size)), size)
    names = codes
    head = _bounds(len(codes), first[size > 0])
    while len(names):
        yield names, owner
        if head.all():
            return
        # texts that are one name already are done
        end = np.append(np.flatnonzero(head)[1:], len(names))
        alone = np.zeros(len(names), bool)
        alone[np.flatnonzero(head)[end - np.flatnonzero(head) == 1]] = True
        if alone.any():
            names, owner, head = names[~alone], owner[~alone], head[~alone]
        drawn, drawn_head = draw_together(names, head)
        owner = owner[head][np.cumsum(drawn_head) - 1]
        start = cut_phrases(labels(drawn, drawn_head), drawn_head)
        names = phrase_names(drawn, start)
        owner, head = owner[start], drawn_head[start]


def sketches(texts: list[str], first_level: int = FIRST_LEVEL, slots: int = SLOTS) -> np.ndarray:
    """A row of ``slots`` numbers for each text; a text that ends below ``first_level`` has its last name only."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum(size) - size
    out = np.full(len(texts) * slots, _EMPTY)

    def note(names: np.ndarray, owner: np.ndarray) -> None:
        value = _mix(names.astype(np.uint64) + np.uint64(0xD1B54A32D192ED03))
        slot = (value >> np.uint64(48)).astype(np.int64) % slots
        low = np.minimum(value & np.uint64(0xFFFF), np.uint64(0xFFFE)).astype(np.uint16)
        np.minimum.at(out, owner * slots + slot, low)

    for level, (names, owner) in enumerate(levels(codes, first, size)):
        if level >= first_level:
            note(names, owner)
        else:
            single = np.bincount(owner, minlength=len(texts))[owner] == 1
            if single.any():
                note(names[single] + np.zeros(1, names.dtype), owner[single])
    return out.reshape(len(texts), slots)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of sketches, row by row: equal slots of those that either has; 1 if both are empty."""
    either = (a != _EMPTY) | (b != _EMPTY)
    equal = ((a == b) & either).sum(1)
    return np.where(either.any(1), equal / np.maximum(either.sum(1), 1), 1.0)


def written(sketch: np.ndarray) -> list[str]:
    """Four hexadecimal digits a slot."""
    return [row.astype(">u2").tobytes().hex() for row in sketch]


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_chars, fingerprint) of each row. A null text is empty and has the empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = text_column(part).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(written(sketches(texts)), pa.string())],
                    names=["id", "n_chars", "fingerprint"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(chosen, run, f"id {kind}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


# --------------------------------------------------------- texts and their next


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, tail, id, text) by ranges of ids of any type that has an order, for reading each document with the next one.

    Within a bucket documents ascend by id (null first; equal ids by the text's
    hash), then comes, marked ``tail``, the next bucket's first document, after
    the last bucket the very first. Ranges are of ids and hashes, so rows of one
    much repeated id are dealt out too. Texts are moved once. The driver sees
    the first id and hash of each range, one for each shuffle partition; a
    document finds its range among every n-th of them and then among the n from
    there on, n being about the root of their number.
    """
    spark = docs.sparkSession
    order = ["some", "id", "hash"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).isNotNull().alias("some"), F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    place = F.struct(*order)
    ranges = rows.select(*order).repartitionByRange(partitions(spark), *order).groupBy(F.spark_partition_id().alias("range"))
    firsts = sorted((r["range"], r["first"]) for r in ranges.agg(F.min(place).alias("first")).collect())
    firsts = [first for _, first in firsts]
    if not firsts:
        return rows.select(F.lit(0).alias("bucket"), F.lit(False).alias("tail"), "id", "text").limit(0)
    kind = docs.schema[id_col].dataType
    as_array = F.array(*[F.struct(F.lit(f["some"]).alias("some"), F.lit(f["id"]).cast(kind).alias("id"), F.lit(f["hash"]).alias("hash")) for f in firsts])
    step = math.isqrt(len(firsts)) + 1
    coarse = F.filter(F.transform(F.sequence(F.lit(1), F.lit(len(firsts)), F.lit(step)), lambda k: F.element_at(as_array, k)), lambda f: f <= place)
    rows = rows.withColumn("coarse", (F.size(coarse) - 1) * step)
    near = F.filter(F.slice(as_array, F.col("coarse") + 1, F.lit(step)), lambda f: f <= place)
    rows = rows.withColumn("bucket", F.col("coarse") + F.size(near) - 1).drop("coarse")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("tail"))
    also = F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(firsts))).alias("bucket"), F.lit(True).alias("tail"))
    first = F.get(as_array, "bucket")
    is_first = first["some"].eqNullSafe(F.col("some")) & first["id"].eqNullSafe(F.col("id")) & (first["hash"] == F.col("hash"))
    to = F.explode(F.when(is_first, F.array(own, also)).otherwise(F.array(own))).alias("to")
    sent = rows.select(to, *order, "text").select("to.bucket", "to.tail", *order, "text")
    dealt = sent.repartitionById(len(firsts), "bucket").sortWithinPartitions("bucket", "tail", *order)
    return dealt.select("bucket", "tail", "id", "text")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, its edited text and their likeness, and that to the next text.

    The next of the last document is the first; a single document is its own
    next. Ids may be of any type that has an order; null ids come first, rows
    that share an id stand by their text's hash, repeated rows stay repeated.
    Null texts are empty; a very long text is one step of its worker. Other
    columns, whatever their names, are not read; an empty table gives an empty
    one.
    """

    def pairs(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        """Results of all rows but the last, which is only a next one."""
        texts = [r[3] for r in rows]
        changed = [edited(t, u) for t, u in zip(texts, texts[1:])]
        a, b = sketches(texts), sketches(changed)
        columns = [
            pa.array([r[2] for r in rows[:-1]], id_type),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array(written(a[:-1]), pa.string()),
            pa.array(written(b), pa.string()),
            pa.array(likeness(a[:-1], b)),
            pa.array(likeness(a[:-1], a[1:])),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            kind = batch.column(2).type
            for part in slices(batch):
                columns = [part.column(k).to_pylist() for k in (0, 1, 2)]
                for row in zip(*columns, text_column(part).to_pylist()):
                    if held and held[-1][0] != row[0]:
                        if len(held) > 1:  # the last is the bucket's tail
                            yield pairs(held, kind)
                        held = []
                    if not (held and held[-1][1]):  # equal first documents are sent on more than once
                        held.append(row)
                # all but the last row can be done now
                if len(held) > 1:
                    yield pairs(held, kind)
                    held = held[-1:]

    rows = in_order(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(rows, run, schema).withColumnRenamed("id", id_col)


def op5_locally_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``with_next`` for each document; nulls, repeated rows, ties and long texts as there."""
    return with_next(read_table(spark, sf_dir, "documents"))
