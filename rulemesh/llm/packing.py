"""Best-fit packing of token sequences with large-item matching.

What a packing looks like depends only on how many pieces there are of each
length, so it is planned from that histogram: at most ``capacity`` numbers,
whatever the corpus. Pieces above a third of the capacity are matched first,
at most two to a bin, each with the largest that fits; smaller ones then go,
longest first, to the bin with the smallest gap that takes them. The plan lists
kinds of bins with how often each occurs, and a piece finds its bin by its
length and its rank among the pieces of that length.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import HELD, cut, map_arrow, read_table
from ._text import slices, text_column
from .stats import TextStats

CAPACITY = 2048
#: Ends each document.
END = 0
#: Bytes of text taken at once: more of them share their words.
SLICE = 1 << 20
#: Words that go through the whole tokenizer at once; what it gives for each is large.
BATCH = 1024
#: Words whose ids a Python worker keeps; about 40 bytes each.
CACHE_WORDS = 400_000


class WordIds:
    """Ids of white-space separated words, as the tokenizer of ``path`` gives them within a text.

    The tokenizer drops white space and its pieces never span any, so a text's
    ids are those of its words one after another. Words of ASCII letters, with
    or without punctuation after them, go to the merges directly; all others go
    through the whole tokenizer.
    """

    def __init__(self, path: str, keep: int = CACHE_WORDS):
        self.keep = keep
        # a task has one core; threads of its own would each keep their memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merges = self.whole.model
        #: Words seen lately, and where the ids of each begin in ``flat`` (one more value than words).
        self.words = pa.array([], pa.large_binary())
        self.flat, self.begin = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        #: Slices that had each word.
        self.uses = np.zeros(0, np.int32)

    def _merged(self, word: bytes) -> list[int]:
        return [t.id for t in self.merges.tokenize(word.decode("ascii"))]

    def _learn(self, words: list[bytes]) -> list[list[int]]:
        out, odd = [], []
        for n, word in enumerate(words):
            stem = word.rstrip(b".,;:!?")
            if stem.isalpha():
                found = self._merged(stem.lower())
                if len(stem) < len(word):
                    found += self._merged(word[len(stem) :])
                out.append(found)
            else:
                odd.append(n)
                out.append([])
        for k in range(0, len(odd), BATCH):
            part = odd[k : k + BATCH]
            for n, found in zip(part, self.whole.encode_batch_fast([words[n].decode() for n in part], add_special_tokens=False)):
                out[n] = found.ids
        return out

    def _forget(self, left: int) -> None:
        """Keep the ``left`` words that most slices had, and half their counts."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[:left])
        sizes = np.diff(self.begin)[kept]
        ends = np.cumsum(sizes)
        self.flat = self.flat[np.repeat(self.begin[kept] - (ends - sizes), sizes) + np.arange(ends[-1])]
        self.begin = np.concatenate([[0], ends])
        self.words, self.uses = self.words.take(pa.array(kept)), self.uses[kept] // 2

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each word begin in them and how many they are; ``words`` are distinct."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = words.filter(pa.array(at < 0))
        if len(new):
            learnt = self._learn(new.to_pylist())
            at[at < 0] = np.arange(len(self.words), len(self.words) + len(new))
            ends = self.begin[-1] + np.cumsum(np.fromiter(map(len, learnt), np.int64, len(learnt)))
            self.words = pa.concat_arrays([self.words, new])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(learnt), "<u4", int(ends[-1] - self.begin[-1]))])
            self.begin = np.concatenate([self.begin, ends])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
        self.uses[at] += 1
        found = self.flat, self.begin[at], self.begin[at + 1] - self.begin[at]
        if len(self.words) > self.keep:
            self._forget(self.keep // 2)
        return found


def opened(path: str) -> WordIds:
    if path not in HELD:
        HELD[path] = WordIds(path)
    return HELD[path]


def token_ids(texts: pa.Array, words, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, each with ``end`` last, and the n + 1 offsets; ``words`` is a WordIds or the like."""
    s = TextStats(texts)
    flat, begin, sizes = words.of(s.words.dictionary)
    lengths = sizes[s.ids]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    within = np.arange(total) - np.repeat(ends - lengths, lengths)
    ids = flat[np.repeat(begin[s.ids], lengths) + within]
    extra = 0 if end is None else 1
    bounds = np.zeros(len(ends) + 1, np.int64)
    bounds[1:] = ends
    offs = bounds[s.first] + extra * np.arange(s.n + 1)
    out = np.full(total + extra * s.n, end or 0, "<u4")
    out[np.arange(total) + extra * np.repeat(s.owner, lengths)] = ids
    return out, offs


# ------------------------------------------------------------------------ plan


class Plan:
    """Bins for ``counts[length]`` pieces of each length up to ``capacity``."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        #: Kinds of bins: how many, and (length, pieces) of each from the start on.
        self.bins: list[tuple[int, tuple[tuple[int, int], ...]]] = []
        left = {n: c for n, c in counts.items() if c}
        if left and not 0 < min(left) <= max(left) <= capacity:
            raise ValueError("lengths must lie between 1 and the capacity")
        gaps: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)
        self._match(left, gaps)
        self._fill(left, gaps)
        self._number()

    def _match(self, left: dict[int, int], gaps: dict) -> None:
        large = sorted(n for n in left if 3 * n > self.capacity)
        while large:
            a = large[-1]
            # the largest that still fits beside it, itself included if there are two
            k = bisect_left(large, self.capacity - a + 1) - 1
            b = large[k] if k >= 0 else None
            if b == a and left[a] == 1:
                b = large[k - 1] if k > 0 else None
            if b is None:
                gaps[self.capacity - a].append((left[a], ((a, 1),)))
                left[a] = 0
            elif b == a:
                gaps[self.capacity - 2 * a].append((left[a] // 2, ((a, 2),)))
                left[a] %= 2
            else:
                pairs = min(left[a], left[b])
                gaps[self.capacity - a - b].append((pairs, ((a, 1), (b, 1))))
                left[a] -= pairs
                left[b] -= pairs
                if not left[b]:
                    large.remove(b)
            if not left[a]:
                large.pop()

    def _fill(self, left: dict[int, int], gaps: dict) -> None:
        free = sorted(g for g in gaps if g)

        def put(gap: int, number: int, held: tuple) -> None:
            if gap and not gaps.get(gap):
                insort(free, gap)
            gaps[gap].append((number, held))

        for size in sorted((n for n in left if left[n] and 3 * n <= self.capacity), reverse=True):
            count = left[size]
            while count:
                k = bisect_left(free, size)
                if k == len(free):
                    each = self.capacity // size
                    if count >= each:
                        put(self.capacity - each * size, count // each, ((size, each),))
                    if count % each:
                        put(self.capacity - count % each * size, 1, ((size, count % each),))
                    break
                gap = free[k]
                number, held = gaps[gap].pop()
                if not gaps[gap]:
                    free.pop(k)
                each = gap // size
                full = min(number, count // each)
                if full:
                    put(gap - each * size, full, (*held, (size, each)))
                    number, count = number - full, count - full * each
                if number and count:
                    put(gap - count * size, 1, (*held, (size, count)))
                    number, count = number - 1, 0
                if number:
                    put(gap, number, held)
        for kinds in gaps.values():
            self.bins += kinds

    def _number(self) -> None:
        """Which ranks of a length go to which bins, as arrays that ``find`` searches."""
        rows, used, bin_ = [], defaultdict(int), 0
        for number, held in self.bins:
            at = 0
            for size, each in held:
                rows.append((size, used[size], bin_, each, at))
                used[size] += number * each
                at += size * each
            bin_ += number
        self.n_bins = bin_
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self._key = (table[:, 0] << 44) + table[:, 1]
        self._rank, self._bin, self._each, self._at = table[:, 1:].T.copy()

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and place in it of the pieces with these ranks among those of their length."""
        k = np.searchsorted(self._key, (length << 44) + rank, "right") - 1
        nth = rank - self._rank[k]
        return self._bin[k] + nth // self._each[k], self._at[k] + nth % self._each[k] * length


# -------------------------------------------------------------------- operator


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth): each document's ids, cut where they exceed ``capacity``.

    ``nth`` counts the pieces of one length within the task ``part``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words = TaskContext.get().partitionId(), opened(path)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in slices(batch, limit=SLICE):
                ids, offs = token_ids(text_column(rows), words)
                size = np.diff(offs)
                number = -(-size // capacity)
                owner = np.repeat(np.arange(len(size)), number)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                length = np.minimum(size[owner] - start, capacity)
                at = offs[:-1][owner] + start
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                nth = seen[length] + _occurrence(length)
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [piece.astype(np.int32), start, length, np.array(crc, np.int64), np.full(len(at), part, np.int32), nth]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(owner)), *map(pa.array, columns)],
                    names=["id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(chosen, run, f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long", path)


def _occurrence(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    begin = np.searchsorted(ordered, ordered)
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - begin
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, piece, start, length, ids_crc32, sequence_id, offset) of each piece.

    A null text is empty and has one token, the end. Repeated rows are packed
    each for itself. Null ids stay null; other columns, whatever their names,
    are not read; an empty table gives an empty one. A very long text is one
    step of its worker and many pieces. Pieces of one length are equal to the
    plan; which takes which place goes by task and place in it.
    """
    found = cut(pieces(docs, path, capacity, id_col, text_col))
    counts = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before"))
    ranked = found.join(places, ["part", "length"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("rank_before") + F.col("nth")).alias("rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            where, offset = plan.find(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(where), pa.array(offset)],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_arrow(ranked, run, schema).withColumnRenamed("id", id_col)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece; nulls, ties, repeated rows and long texts as in ``pack``."""
    return pack(read_table(spark, sf_dir, "documents"), str(tokenizer_path()))
