"""A minimal acyclic transducer: words to the ids that they are written as.

The words are compiled, in order, into the smallest automaton that takes them
(equal suffixes share their states). Each arc carries how many words sort
before those that go through it, so the sum along a word's path is its number
among all words, and the numbers select runs of ids. All is kept in flat
arrays of one file, which readers map into memory.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Arrays of a file, in order, with their kinds.
PARTS = (("key", "<i8"), ("begin", "<i8"), ("target", "<i4"), ("output", "<i4"), ("ids", "<u4"), ("final", "u1"))


def compile_words(words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> bytes:
    """The file of ``words``, distinct and ascending, and their ``ids``."""
    states: dict[tuple, int] = {}
    path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]
    before = b""

    def close(depth: int) -> None:
        """Number the states of the last word below ``depth``, each once for all that are alike."""
        while len(path) > depth + 1:
            final, arcs = path.pop()
            number = states.setdefault((final, *arcs), len(states))
            path[-1][1].append((before[len(path) - 1], number))

    for word in words:
        if word <= before and path != [(False, [])]:
            raise ValueError("words must be distinct and ascending")
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        close(same)
        path += [(False, []) for _ in word[same:]]
        path[-1] = (True, path[-1][1])
        before = word
    close(0)
    states.setdefault((path[0][0], *path[0][1]), len(states))  # the last one is the root
    key, target, output, final, taken = [], [], [], [], []
    for number, (ends, *arcs) in enumerate(states):
        passed = int(ends)
        for byte, to in arcs:
            key.append(number * 256 + byte)
            target.append(to)
            output.append(passed)
            passed += taken[to]
        taken.append(passed)
        final.append(ends)
    begin = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=begin[1:])
    flat = np.fromiter((i for x in ids for i in x), np.uint32, int(begin[-1]))
    arrays = {"key": key, "begin": begin, "target": target, "output": output, "ids": flat, "final": final}
    held = [np.asarray(arrays[name], kind) for name, kind in PARTS]
    return b"".join([np.array([len(a) for a in held], "<i8").tobytes(), *(a.tobytes() for a in held)])


class Transducer:
    """Looks words up in a file of ``compile_words``."""

    def __init__(self, data: np.ndarray):
        sizes = data[: 8 * len(PARTS)].view("<i8")
        at = 8 * len(PARTS)
        for (name, kind), size in zip(PARTS, sizes.tolist()):
            end = at + size * np.dtype(kind).itemsize
            setattr(self, name, data[at:end].view(kind))
            at = end

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        return cls(np.memmap(path, np.uint8, "r"))

    @property
    def n_words(self) -> int:
        return len(self.begin) - 1

    @property
    def n_states(self) -> int:
        return len(self.final)

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word ``raw[start:end]``, -1 where it isn't one; all words go a byte further together."""
        found = np.full(len(starts), -1, np.int64)
        alive, state, number = np.arange(len(starts)), np.full(len(starts), self.n_states - 1, np.int64), np.zeros(len(starts), np.int64)
        at = starts.astype(np.int64)
        while len(alive):
            over = at == ends[alive]
            done = over & (self.final[state] > 0)
            found[alive[done]] = number[done]
            alive, state, number, at = (x[~over] for x in (alive, state, number, at))
            if not len(alive) or not len(self.key):
                break
            wanted = state * 256 + raw[at]
            arc = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            on = self.key[arc] == wanted
            arc = arc[on]
            alive, state, number, at = alive[on], self.target[arc].astype(np.int64), number[on] + self.output[arc], at[on] + 1
        return found
