"""Statistics of many texts at once, shared by the quality operators."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa

from ._text import SPACE, runs, utf8

#: Classes of bytes; a character beyond ASCII counts once, by its first byte.
CLASSES = ("lower", "upper", "digit", "space", "stop", "quote", "symbol", "other", "wide")
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


def _classes() -> np.ndarray:
    out = np.full(256, CLASSES.index("other"), np.uint8)
    for name, members in (
        ("lower", range(97, 123)),
        ("upper", range(65, 91)),
        ("digit", range(48, 58)),
        ("space", np.flatnonzero(SPACE)),
        ("stop", b".,;:!?"),
        ("quote", b"\"'()[]{}-"),
        ("symbol", SYMBOLS),
        ("wide", range(192, 256)),
    ):
        out[list(members)] = CLASSES.index(name)
    out[128:192] = len(CLASSES)  # later bytes of a character
    return out


_CLASS = _classes()
#: Words in a window of which repetitions are counted.
WINDOW = 8


class TextStats:
    """Counts for each text of a slice. Words are runs of bytes other than ASCII white space."""

    def __init__(self, texts: pa.Array):
        self.n = len(texts)
        self.raw, self.offs = utf8(texts)
        self.starts, self.ends, self.first = runs(~SPACE[self.raw], self.offs)
        self.n_words = np.diff(self.first)

    def _sums(self, per_byte: np.ndarray) -> np.ndarray:
        total = np.zeros(len(per_byte) + 1, np.int64)
        np.cumsum(per_byte, out=total[1:])
        return np.diff(total[self.offs])

    @cached_property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), self.n_words)

    @cached_property
    def classes(self) -> np.ndarray:
        """Characters of each class, texts by classes."""
        width = len(CLASSES) + 1
        doc = np.repeat(np.arange(self.n) * width, np.diff(self.offs))
        return np.bincount(doc + _CLASS[self.raw], minlength=self.n * width).reshape(self.n, width)[:, :-1]

    @cached_property
    def n_chars(self) -> np.ndarray:
        return self.classes.sum(1)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.n_chars - self.classes[:, CLASSES.index("space")]

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.classes[:, CLASSES.index("symbol")]

    @cached_property
    def words(self) -> pa.DictionaryArray:
        """All words; equal ones have equal indices within the slice."""
        return _encoded(self.raw, self.starts, self.ends)

    @cached_property
    def ids(self) -> np.ndarray:
        return self.words.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and content number of each line that has a word."""
        starts, ends, first = runs(self.raw != 10, self.offs)
        filled = np.searchsorted(self.starts, starts) < np.searchsorted(self.starts, ends)
        owner = np.repeat(np.arange(self.n), np.diff(first))[filled]
        lines = _encoded(self.raw, starts[filled], ends[filled])
        return owner, lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[0], minlength=self.n)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of the text."""
        owner, line = self.lines
        distinct = np.unique(owner * (line.max(initial=0) + 1) + line) // (line.max(initial=0) + 1)
        return self.n_lines - np.bincount(distinct, minlength=self.n)

    @cached_property
    def n_distinct_words(self) -> np.ndarray:
        width = self.ids.max(initial=0) + 1
        return np.bincount(np.unique(self.owner * width + self.ids) // width, minlength=self.n)

    @cached_property
    def n_same_as_last(self) -> np.ndarray:
        """Words equal to the word before them."""
        same = np.zeros(len(self.ids), bool)
        same[1:] = (self.ids[1:] == self.ids[:-1]) & (self.owner[1:] == self.owner[:-1])
        return np.bincount(self.owner[same], minlength=self.n)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in windows of WINDOW words that the text has twice or more, the first included."""
        ids, owner = self.ids, self.owner
        out = np.zeros(self.n, np.int64)
        count = len(ids) - WINDOW + 1
        if count < 1:
            return out
        inside = owner[WINDOW - 1 :] == owner[:count]
        mixed = _mix(ids.astype(np.uint64))
        value = _mix(owner[:count].astype(np.uint64) + np.uint64(1 << 40))
        for k in range(WINDOW):
            value = value * np.uint64(0x9E3779B97F4A7C15) + mixed[k : k + count]
        at = np.flatnonzero(inside)
        at = at[_repeated(value[at])]
        if len(at):  # equal values are only likely to be equal windows
            rows = np.column_stack([owner[at], *(ids[at + k] for k in range(WINDOW))])
            _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            at = at[counts[inverse.ravel()] > 1]
        cover = np.zeros(len(ids) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        return np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=self.n)


def _encoded(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The slices of ``raw`` (ascending, disjoint) with equal ones numbered alike."""
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    data = raw[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return values.dictionary_encode()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    ordered = np.sort(values)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(twice, values), len(twice) - 1)
    return twice[place] == values


#: Names of the columns of ``features``.
FEATURES = (
    "log_words", "log_chars", "word_length", "lower", "upper", "digit", "space", "stop", "quote", "symbol", "other",
    "wide", "exclaim", "lines_per_word", "dup_lines", "repeat_words", "distinct_words", "same_as_last", "shouted",
    "symbol_tail", "class_entropy",
)


def features(texts: pa.Array) -> np.ndarray:
    """Statistics of each text as FEATURES; an empty text has zeros."""
    s = TextStats(texts)
    chars, words, lines = np.maximum(s.n_chars, 1), np.maximum(s.n_words, 1), np.maximum(s.n_lines, 1)
    share = s.classes / chars[:, None]
    last = s.raw[s.ends - 1]
    lead = s.raw[s.starts]
    upper = np.zeros(len(s.raw) + 1, np.int64)
    np.cumsum(_CLASS[s.raw] == CLASSES.index("upper"), out=upper[1:])
    capitals = upper[s.ends] - upper[s.starts]
    shouted = (capitals >= 2) & (2 * capitals >= s.ends - s.starts)
    logs = np.log(share, out=np.zeros_like(share), where=share > 0)
    columns = [
        np.log1p(s.n_words),
        np.log1p(s.n_chars),
        s.word_chars / words,
        *share.T,
        s._sums(s.raw == 33) / chars,
        s.n_lines / words,
        s.n_dup_lines / lines,
        s.n_repeat_words / words,
        s.n_distinct_words / words,
        s.n_same_as_last / words,
        np.bincount(s.owner[shouted], minlength=s.n) / words,
        np.bincount(s.owner[(_CLASS[last] == CLASSES.index("symbol")) & (lead != last)], minlength=s.n) / words,
        -(share * logs).sum(1),
    ]
    return np.column_stack(columns) if s.n else np.zeros((0, len(FEATURES)))
