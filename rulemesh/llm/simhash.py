"""SimHash near-duplicates by a self-join of binary tries.

A text's fingerprint has a bit set if that bit is set in over half the XXH64
values of its word shingles. Two fingerprints link if at most ``budget`` of
their 64 bits differ; a component is a set of documents joined by links.

The join first deals the distinct fingerprints out: of six blocks of bits, two
fingerprints that differ in at most four bits agree on at least two, so every
pair of blocks is a key under which such fingerprints meet. What meets under a
key is a sorted array, which is a binary trie whose nodes are ranges; pairs of
nodes are walked together from the top bit, differing bits add up, and a pair
is pruned when they exceed the budget, or when all below it is already one
component. Each task reports a spanning forest instead of all pairs, and the
forests are joined by alternating stars over tables, none of which the driver
collects.

A key with more than ``hot`` fingerprints is dealt out anew by further bits,
under which all its links meet again; what then still is too many is put into
chunks, and every pair of chunks is a task of its own, so no pair is lost and
no task grows with the group.

``keep_one`` looks for texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Such fingerprints differ in about 15 % of their
bits, so 64 bits can't tell them from others and no block of bits is surely
equal. Its candidates therefore have 512 bits, of which ``WIDE_BUDGET`` may
differ, and are dealt out by the lowest of several hashes of the shingles
(bands), under one of which similar texts almost surely meet; the join under a
key is the same walk over tries. What it draws together are groups of
candidates only: the texts of a group are then walked once more, and a pair is
linked where its whole sets are as similar as that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, fresh, map_arrow, partitions, read_table, row_marks
from ._text import LOWER, slices, spaced, text_column, utf8, xxh64

SHINGLE = 4
BUDGET = 4
#: Fingerprints under one key that a single task takes.
HOT = 50_000
#: Keys beyond HOT that are broadcast; more of them are joined by a shuffle.
HOT_BROADCAST = 10_000
#: Node pairs walked at once.
FRONTIER = 1 << 18
#: Rows of complete keys that are joined in one go.
CHUNK = 1 << 18

#: Of ``keep_one``: least similarity, words of a shingle, 64-bit words of a fingerprint, and bits that candidates may
#: differ in. Jaccard 0.8 makes 77.5 of 512 bits differ on average, give or take 8: four times that is allowed for.
SIMILAR, WIDE_SHINGLE, WIDE_WORDS, WIDE_BUDGET = 0.8, 5, 8, 112
#: Bytes of a candidate group's texts that a single task takes, and pairs compared before what they settle is let go.
HOT_BYTES, PAIRS = 1 << 24, 4096
#: Keys of a text, and lowest hashes in each: sets of similarity s share a key with the chance 1 - (1 - s^3)^8, 0.997 at 0.8.
BANDS, BAND_ROWS = 8, 3

_BLOCKS = (11, 11, 11, 11, 10, 10)
_SPREAD = np.array([[(i >> k) & 1 for k in range(8)] for i in range(256)], np.uint8).view("<u8").ravel()


# ---------------------------------------------------------------- fingerprints


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits that are set in over half of them; 0 for none."""
    counts = np.diff(first)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    # runs of at most 255 hashes keep eight counters in the bytes of one word
    parts = -(-counts[full] // 255)
    owner = np.repeat(np.arange(len(full)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = first[:-1][full][owner] + 255 * nth
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    begin = np.searchsorted(owner, np.arange(len(full)))
    half = counts[full]
    bits = np.zeros(len(full), np.uint64)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[lanes[:, k]], at).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(sums.astype(np.int64), begin, axis=0)
        for j in range(8):
            bits |= (2 * total[:, j] > half).astype(np.uint64) << np.uint64(8 * k + j)
    out[full] = bits
    return out


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's shingles, repeats included, and where each text's begin (n + 1 values)."""
    raw, offs = utf8(texts)
    data, starts, ends, first = spaced(LOWER[raw], offs)
    words = np.diff(first)
    # a text of fewer words than a shingle is one shingle of them all
    shingles = np.where(words >= shingle, words - shingle + 1, (words > 0).astype(np.int64))
    bound = np.zeros(len(words) + 1, np.int64)
    np.cumsum(shingles, out=bound[1:])
    owner = np.repeat(np.arange(len(words)), shingles)
    begin = first[:-1][owner] + (np.arange(bound[-1]) - bound[:-1][owner])
    last = begin + np.minimum(shingle, words[owner]) - 1
    return xxh64(data, starts[begin], ends[last]), bound


def simhash(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of large strings without nulls."""
    return majority(*shingle_hashes(texts, shingle))


def _stream(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th of many independent hashes of hashes."""
    x = x + np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingle_hashes``, ascending in each text and each once."""
    hashes, bound = shingle_hashes(texts, shingle)
    owner = np.repeat(np.arange(len(texts)), np.diff(bound))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


class ShingleSets:
    """The whole shingle sets of some texts, for comparing pairs of them."""

    def __init__(self, texts: pa.Array, shingle: int = WIDE_SHINGLE, similarity: float = SIMILAR):
        hashes, self.bound = shingle_sets(texts, shingle)
        self.similarity, self.size = similarity, np.diff(self.bound)
        values, rank = np.unique(hashes, return_inverse=True)
        self.rank, self.width = rank.astype(np.int64), max(1, len(values))
        #: Text and rank of each member in one number, ascending.
        self.member = np.repeat(np.arange(len(texts)), self.size) * self.width + self.rank

    def similar(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs have a Jaccard similarity of ``similarity`` or more; two empty sets have."""
        i, j = np.where(self.size[i] <= self.size[j], i, j), np.where(self.size[i] <= self.size[j], j, i)
        small, big = self.size[i], self.size[j]
        out = small >= self.similarity * big - 1e-9
        at = np.flatnonzero(out & (small > 0))
        if len(at):
            ends = np.cumsum(small[at])
            rank = self.rank[np.repeat(self.bound[i[at]] - (ends - small[at]), small[at]) + np.arange(ends[-1])]
            wanted = np.repeat(j[at], small[at]) * self.width + rank
            place = np.minimum(np.searchsorted(self.member, wanted), len(self.member) - 1)
            common = np.add.reduceat((self.member[place] == wanted).astype(np.int64), ends - small[at])
            out[at] = common >= self.similarity * (small[at] + big[at] - common) - 1e-9
        return out


def wide_simhash(
    texts: pa.Array, shingle: int = WIDE_SHINGLE, words: int = WIDE_WORDS, bands: int = BANDS, rows: int = BAND_ROWS
) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (texts by 64-bit words) and keys (texts by bands) of the texts' sets of shingles."""
    n = len(texts)
    hashes, bound = shingle_sets(texts, shingle)
    prints = np.stack([majority(_stream(hashes, k), bound) for k in range(words)], 1)
    full = np.flatnonzero(np.diff(bound))
    keys = np.zeros((n, bands), np.uint64)
    for band in range(bands):
        key = np.full(n, band, np.uint64)
        for row in range(rows):
            low = np.zeros(n, np.uint64)
            if len(full):
                low[full] = np.minimum.reduceat(_stream(hashes, words + band * rows + row), bound[:-1][full])
            key = _stream(key ^ low, row)
        keys[:, band] = key
    return prints, keys


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row (``id_col``, fingerprint) for each document; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values = simhash(text_column(part), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values)], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(chosen, run, f"id {kind}, fingerprint long").withColumnRenamed("id", id_col)


# ------------------------------------------------------------------- trie join


def components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index of each index's component; ``label``: of links known before."""
    label = np.arange(n) if label is None else label
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            shorter = label[label]
            if np.array_equal(shorter, label):
                break
            label = shorter
    return label


class Trie:
    """Tries of several groups as one sorted array; ``group`` ascends, ``bits`` ascends in a group, pairs are distinct."""

    def __init__(self, group: np.ndarray, bits: np.ndarray, budget: int, sets: ShingleSets | None = None):
        #: Where given, what is near by its bits is only linked if its sets are similar.
        self.sets = sets
        # texts by 64-bit words, the first word on top
        self.bits, self.budget = bits.reshape(len(bits), -1), budget
        self.n = len(bits)
        cuts = np.flatnonzero(np.diff(group)) + 1
        self.lo = np.concatenate([[0], cuts]).astype(np.int64)
        self.hi = np.concatenate([cuts, [self.n]]).astype(np.int64)
        self.label = np.arange(self.n)

    def _apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(1, dtype=np.int32)

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Link pairs that are near; a pair that others have drawn together needs no comparison of sets."""
        if self.sets is None:
            self.label = components(self.n, i, j, self.label)
            return
        while len(i):
            open_ = self.label[i] != self.label[j]
            i, j = i[open_], j[open_]
            a, b = i[:PAIRS], j[:PAIRS]
            alike = self.sets.similar(a, b)
            self.label = components(self.n, a[alike], b[alike], self.label)
            i, j = i[PAIRS:], j[PAIRS:]

    def _near_first(self) -> None:
        """Links that cost one pass: sorted neighbours, and members within half the budget of a group's majority."""
        i = np.arange(self.n - 1)
        i = i[self._apart(i, i + 1) <= self.budget]
        i = i[~np.isin(i + 1, self.lo)]
        self._link(i, i + 1)
        for g in np.flatnonzero(self.hi - self.lo >= 64):
            lo, hi = self.lo[g], self.hi[g]
            own = self.bits[lo:hi]
            centre = [majority(np.ascontiguousarray(word), np.array([0, hi - lo]))[0] for word in own.T]
            apart = np.bitwise_count(own ^ np.array(centre, np.uint64)).sum(1, dtype=np.int32)
            close = lo + np.flatnonzero(apart <= self.budget // 2)
            if len(close) > 1:
                first = close[np.argmin(apart[close - lo])]
                self._link(close, np.full(len(close), first))

    def join(self) -> np.ndarray:
        """The components' labels after all links within a group."""
        if self.n > 1:
            self._near_first()
            size = self.hi - self.lo
            lo, hi = self.lo[size > 1], self.hi[size > 1]
            self._walk((lo, hi, lo, hi, np.zeros(len(lo), np.int16)), 0)
        return self.label

    def _settled(self, f: tuple) -> np.ndarray:
        change = np.zeros(self.n, np.int64)
        np.cumsum(self.label[1:] != self.label[:-1], out=change[1:])
        alo, ahi, blo, bhi, _ = f
        return (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo]) & (self.label[alo] == self.label[blo])

    def _walk(self, f: tuple, level: int) -> None:
        while len(f[0]):
            open_ = ~self._settled(f)
            f = tuple(x[open_] for x in f)
            alo, ahi, blo, bhi, err = f
            leaf = (ahi - alo == 1) & (bhi - blo == 1)
            if leaf.any():
                i, j = alo[leaf], blo[leaf]
                near = self._apart(i, j) <= self.budget
                self._link(i[near], j[near])
                f = tuple(x[~leaf] for x in f)
            if len(f[0]) > FRONTIER:
                half = len(f[0]) // 2
                self._walk(tuple(x[:half] for x in f), level)
                f = tuple(x[half:] for x in f)
                continue
            if level == 64 * self.bits.shape[1] or not len(f[0]):
                return
            f = self._down(f, level)
            level += 1

    def _down(self, f: tuple, level: int) -> tuple:
        alo, ahi, blo, bhi, err = f
        ones = np.zeros(self.n + 1, np.int64)
        word, bit = divmod(level, 64)
        np.cumsum((self.bits[:, word] >> np.uint64(63 - bit)) & np.uint64(1), out=ones[1:])
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = alo == blo
        kids = [
            (alo, amid, blo, bmid, err),
            (amid, ahi, bmid, bhi, err),
            (alo, amid, bmid, bhi, err + 1),
            tuple(x[~same] for x in (amid, ahi, blo, bmid, err + 1)),
        ]
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*kids))
        alive = (ahi > alo) & (bhi > blo) & (err <= self.budget) & ((alo != blo) | (ahi - alo > 1))
        return tuple(x[alive] for x in (alo, ahi, blo, bhi, err))


_TOP = np.uint64(1 << 63)


def _decoded(column: pa.Array) -> np.ndarray:
    """Fingerprints (longs, or binaries of one length) as rows of words whose order is Spark's order of the column."""
    if not pa.types.is_binary(column.type):
        return (column.to_numpy().view(np.uint64) ^ _TOP)[:, None]
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, ">u8", (offs[-1] - offs[0]) // 8, offs[0]).reshape(len(column), -1).astype(np.uint64)


def _encoded(bits: np.ndarray, binary: bool) -> pa.Array:
    if not binary:
        return pa.array((bits[:, 0] ^ _TOP).view(np.int64))
    width = 8 * bits.shape[1]
    offsets = np.arange(len(bits) + 1, dtype=np.int32) * np.int32(width)
    data = np.ascontiguousarray(bits, ">u8")
    return pa.Array.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _linker(budget: int, binary: bool):
    """A spanning forest of each key's links: linked fingerprints and the one that stands for their component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held = [], [], 0

        def take(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal keys, values, held
            key, value = np.concatenate(keys), np.concatenate(values)
            end = len(key) if final else int(np.searchsorted(key, key[-1]))
            keys, values, held = [key[end:]], [value[end:]], len(key) - end
            key, value = key[:end], value[:end]
            alone = np.ones(len(key), bool)
            alone[1:] &= key[1:] != key[:-1]
            alone[:-1] &= key[1:] != key[:-1]
            if not alone.all():
                key, value = key[~alone], value[~alone]
                label = Trie(key, value, budget).join()
                linked = np.flatnonzero(label != np.arange(len(label)))
                columns = [_encoded(value[linked], binary), _encoded(value[label[linked]], binary)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                keys.append(batch.column(0).to_numpy())
                values.append(_decoded(batch.column(1)))
                held += batch.num_rows
                if held >= CHUNK:
                    yield from take(False)
        if held:
            yield from take(True)

    return run


def _exact_linker(budget: int, similarity: float, shingle: int):
    """As ``_linker``, for (key, fingerprint, text) with wide fingerprints, linked where the texts' sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            value = _decoded(rows.column(1))
            label = Trie(rows.column(0).to_numpy(), value, budget, ShingleSets(text_column(rows), shingle, similarity)).join()
            linked = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([_encoded(value[linked], True), _encoded(value[label[linked]], True)], names=["a", "b"])

        for batch in batches:
            key = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
                if held and len(part) and held[-1].column(0)[0].as_py() != key[part[0]] and sum(b.nbytes for b in held) >= HOT_BYTES:
                    yield from joined()
                    held = []
                if len(part):
                    held.append(batch.slice(part[0], len(part)))
        if held:
            yield from joined()

    return run


def _bits(place: tuple[int, int]):
    return F.shiftrightunsigned("fingerprint", place[0]).bitwiseAND(F.lit((1 << place[1]) - 1))


def _places() -> list[tuple[int, int]]:
    """Lowest bit and width of each block."""
    at = [sum(_BLOCKS[:n]) for n in range(len(_BLOCKS))]
    return list(zip(at, _BLOCKS))


def _keyed(distinct: DataFrame) -> DataFrame:
    """Each fingerprint under each pair of blocks: the pair's number above the bits of both."""
    keys = [
        F.lit(n << 40).cast("long") + F.shiftleft(_bits(p), 11) + _bits(q)
        for n, (p, q) in enumerate(combinations(_places(), 2))
    ]
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fingerprint")


def _rekeyed(hot: DataFrame) -> DataFrame:
    """Rows of hot keys under seven further keys each.

    Of the eight halves of the four blocks that a key leaves open, two linked
    fingerprints agree on four or more, hence on two of one of three groups.
    """
    out = None
    for n, pair in enumerate(combinations(_places(), 2)):
        halves = [h for at, width in _places() if (at, width) not in pair for h in ((at, width // 2), (at + width // 2, width - width // 2))]
        groups = (halves[:3], halves[3:6], halves[6:])
        keys = F.array(*[F.xxhash64("key", F.lit(p[0]), F.lit(q[0]), _bits(p), _bits(q)) for g in groups for p, q in combinations(g, 2)])
        mine = F.shiftright("key", 40) == n
        out = F.when(mine, keys) if out is None else out.when(mine, keys)
    return hot.select(F.explode(out).alias("key"), "fingerprint")


def _large(keyed: DataFrame, hot: int) -> tuple[DataFrame | None, int]:
    """Keys of more than ``hot`` fingerprints with their number of chunks, if there are any; broadcast if they are few."""
    large = keyed.groupBy("key").count().where(F.col("count") > hot)
    n = large.limit(HOT_BROADCAST + 1).count()
    if not n:
        return None, 0
    large = large.select("key", F.ceil(F.col("count") / (hot // 2)).cast("int").alias("chunks"))
    return F.broadcast(large) if n <= HOT_BROADCAST else large, n


def _chunked(keyed: DataFrame, large: DataFrame) -> DataFrame:
    """``keyed`` with the rows of ``large`` keys under a key for each pair of chunks that has the row's own."""
    own = F.pmod(F.xxhash64("fingerprint"), F.col("chunks"))
    pair = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1), lambda o: F.xxhash64(F.col("key"), F.least(o, own), F.greatest(o, own))
    )
    keys = F.when(F.col("chunks").isNull(), F.array("key")).otherwise(pair)
    rest = [c for c in keyed.columns if c != "key"]
    return keyed.join(large, "key", "left").select(F.explode(keys).alias("key"), *rest)


def join_keys(keyed: DataFrame, budget: int, hot: int = HOT) -> DataFrame:
    """Rows (a, b) that join the fingerprints under each key of ``keyed`` (key, fingerprint) that are within ``budget``."""
    spark = keyed.sparkSession
    large, n_large = _large(keyed, hot)
    if n_large:
        keyed = _chunked(keyed, large)
    dealt = keyed.repartition(partitions(spark), "key").sortWithinPartitions("key", "fingerprint")
    kind = keyed.schema["fingerprint"].dataType.simpleString()
    return map_arrow(dealt, _linker(budget, kind == "binary"), f"a {kind}, b {kind}")


def links(distinct: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """Rows (a, b) that join all fingerprints within ``budget`` of each other into components.

    ``distinct`` has each fingerprint, a long, once and is read more than once.
    """
    if not 0 <= budget <= 4:
        raise ValueError("two of six blocks agree only up to a budget of four bits")
    keyed = _keyed(distinct)
    large, n_large = _large(keyed, hot)
    if n_large:
        cold = keyed.join(large, "key", "left_anti")
        again = keyed.join(large.select("key"), "key", "left_semi")
        keyed = cold.unionByName(cut(_rekeyed(again)))
    return join_keys(keyed, budget, hot)


# ------------------------------------------------------------ joining the links


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component, by alternating large and small stars."""

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written out, so that the join can split the rows of a node with very many links
        low = cut(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    budget: int = BUDGET,
    hot: int = HOT,
) -> DataFrame:
    """(``id_col``, fingerprint as a long, component_id) for each row of ``docs``.

    ``component_id`` is the smallest id that can be reached over links; rows
    with a null id take part and get their component's smallest id, null if it
    has none. Null and empty texts have fingerprint 0. Repeated rows stay
    repeated. Other columns of ``docs``, whatever their names, are not read; an
    empty table gives an empty one. A very long text is one step of its worker.
    """
    own = cut(fingerprints(docs, id_col, text_col, shingle).toDF("id", "fingerprint"))
    distinct = cut(own.groupBy("fingerprint").agg(F.min("id").alias("least")))
    rooted = star_components(links(distinct, budget, hot))
    rooted = distinct.join(rooted, distinct.fingerprint == rooted.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = cut(rooted)
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # a root with a third of all fingerprints: the join below can split it
    named = cut(rooted.join(cut(lowest), "root").select("fingerprint", "component_id"))
    return own.join(named, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def wide_fingerprints(rows: DataFrame, text_col: str, **settings) -> DataFrame:
    """``rows`` with fingerprint (binary) and keys (array of longs) in place of ``text_col``, which comes last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                prints, keys = wide_simhash(text_column(part, text_col), **settings)
                offsets = np.arange(len(keys) + 1, dtype=np.int32) * np.int32(keys.shape[1])
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _encoded(prints, True), listed], names=names)

    fields = [f for f in rows.schema if f.name != text_col]
    names = [*(f.name for f in fields), "fingerprint", "keys"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "fingerprint binary", "keys array<long>"])
    return map_arrow(rows, run, schema)


def similar_components(own: DataFrame, budget: int = WIDE_BUDGET, hot: int = HOT) -> DataFrame:
    """(fingerprint, root, best) of the distinct fingerprints of ``own`` (fingerprint, keys, best).

    ``root`` names the component, ``best`` is the lowest of the fingerprint's rows.
    """
    distinct = cut(own.groupBy("fingerprint").agg(F.min("keys").alias("keys"), F.min("best").alias("best")))
    linked = join_keys(distinct.select(F.explode("keys").alias("key"), "fingerprint"), budget, hot)
    rooted = star_components(linked)
    return distinct.join(rooted, distinct.fingerprint == rooted.node, "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "best"
    )


def exact_links(texts: DataFrame, budget: int = WIDE_BUDGET, similarity: float = SIMILAR, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Rows (a, b) that join the fingerprints under each key of ``texts`` (key, fingerprint, text) whose texts are similar.

    A pair is compared by its whole sets of shingles unless its fingerprints are
    further than ``budget`` apart or other pairs have joined it. A key with more
    than ``hot_bytes`` of text is dealt out by pairs of chunks.
    """
    size = texts.groupBy("key").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("bytes")).where(F.col("bytes") > hot_bytes)
    large = cut(size.select("key", F.ceil(F.col("bytes") / (hot_bytes // 2)).cast("int").alias("chunks")))
    if large.limit(1).count():
        texts = _chunked(texts, large)
    dealt = texts.repartition(partitions(texts.sparkSession), "key").sortWithinPartitions("key", "fingerprint")
    return map_arrow(dealt.select("key", "fingerprint", "text"), _exact_linker(budget, similarity, WIDE_SHINGLE), "a binary, b binary")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = WIDE_BUDGET, hot: int = HOT, similarity: float = SIMILAR,
    hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """``docs`` with one row of each component of near-duplicates: that of the smallest id, null ids last.

    Texts are near-duplicates if their sets of five-word shingles have a Jaccard
    similarity of ``similarity`` or more, which is compared exactly for all that
    share a key and whose fingerprints differ in at most ``budget`` bits (see
    the module). Rows that share an id are told apart by their text and other
    columns; of rows that are equal in all columns one stays. Null and empty
    texts are alike; a very long text is one step of its worker. Columns stay as
    they are, whatever their names; an empty table gives an empty one.
    """
    names = fresh(docs, "_text_hash", "_more_hash", "_rest_hash")
    text = F.col(text_col).cast("string")
    marks = [m.alias(n) for m, n in zip(row_marks(docs, id_col, text_col), names)]
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *marks)
    own = cut(wide_fingerprints(docs.select(row.alias("best"), text.alias("text")), "text"))
    coarse = cut(similar_components(own, budget, hot))
    # the texts of groups of candidates, one for each fingerprint; equal rows fall together before they are moved, and
    # the groups are written out, so that the join can split a large one
    crowded = cut(coarse.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root"))
    wanted = coarse.join(crowded, "root").select(F.xxhash64("root").alias("key"), "fingerprint", *[F.col("best")[n].alias(n) for n in names])
    texts = docs.select(text.alias("text"), *marks).dropDuplicates(names).join(wanted, names).select("key", "fingerprint", "text")
    exact = star_components(exact_links(cut(texts), budget, similarity, hot_bytes))
    rooted = coarse.drop("root").join(exact, coarse.fingerprint == exact.node, "left")
    best = rooted.groupBy(F.coalesce("root", "fingerprint").alias("root")).agg(F.min("best").alias("best"))
    kept = best.select(*[F.col("best")[n].alias(n) for n in names])
    one = docs.select("*", *marks).dropDuplicates(names).join(kept, names, "left_semi")
    return one.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_simhash_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document; nulls, ties, repeated rows and long texts as in ``near_duplicates``."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
