"""Vectorised text kernels over Arrow string columns.

All of them work on the UTF-8 bytes of many texts at once, so their memory is
a small multiple of the slice they are given; ``slices`` bounds that slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step of a kernel takes, unless one text is longer.
SLICE_BYTES = 1 << 20
#: Texts that one step takes.
SLICE_ROWS = 4096

_BYTES = np.arange(256, dtype=np.uint8)
SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)

#: Bytes of words of letters and digits, once lower-cased: ASCII ones and all of characters beyond ASCII.
ALNUM = (_BYTES >= 128) | np.isin(_BYTES, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8))


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as large strings, null as empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return pc.fill_null(column, "")


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with at most ``limit`` bytes of text and SLICE_ROWS rows, or one row."""
    column = batch.column(batch.schema.get_field_index(name))
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(ends, before + limit, "right"))))
        yield batch.slice(at, to - at)
        at, before = to, int(ends[to - 1])


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets of the texts in them."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true values that do not cross a text's end.

    Gives their starts, their ends, and for each text the index of its first
    run (n + 1 values).
    """
    size = len(inside)
    start, end = inside.copy(), inside.copy()
    if size:
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        bounds = offs[1:-1]
        bounds = bounds[(bounds > 0) & (bounds < size)]
        start[bounds] = inside[bounds]
        end[bounds - 1] = inside[bounds - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def spaced(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by one blank: bytes, word starts, word ends, first word of each text.

    Words are runs of bytes other than ASCII white space.
    """
    inside = ~SPACE[raw]
    starts, ends, first = runs(inside, offs)
    lengths = ends - starts
    keep = inside
    size = len(raw)
    after = ends[ends < size]
    after = after[~inside[after]]
    keep[after] = True
    data = raw.copy()
    data[after] = 32
    kept = data[keep]
    place = np.zeros(size + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    at = place[starts]
    return kept, at, at + lengths, first


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of letters and digits, A-Z lower-cased: bytes, word starts, word ends, first word of each text."""
    raw, offs = utf8(texts)
    data = LOWER[raw]
    return data, *runs(ALNUM[data], offs)


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1)).astype(np.uint32)


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of many slices of ``data``, all a byte further together."""
    order = np.argsort(starts - ends, kind="stable")  # the longest first, so those that go on are a prefix
    at, length = starts[order], (ends - starts)[order]
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    left = len(starts) - np.searchsorted(length[::-1], np.arange(length.max(initial=0)), "right")
    for p, n in enumerate(left.tolist()):
        out[:n] = _CRC[(out[:n] ^ data[at[:n] + p]) & np.uint32(255)] ^ (out[:n] >> np.uint32(8))
    done = np.empty_like(out)
    done[order] = ~out
    return done


_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of ``data``, those of one length at a time."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    sized = lengths[order]
    with np.errstate(over="ignore"):
        seeds = [np.uint64(seed) + _P1 + _P2, np.uint64(seed) + _P2, np.uint64(seed), np.uint64(seed) - _P1]
        for group in np.split(order, np.flatnonzero(np.diff(sized)) + 1):
            length, at, i = int(lengths[group[0]]), starts[group], 0
            if length >= 32:
                lanes = [np.full(len(group), s, np.uint64) for s in seeds]
                while i + 32 <= length:
                    for k in range(4):
                        lanes[k] = _round(lanes[k], words[at + (i + 8 * k)])
                    i += 32
                acc = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
                for k in range(4):
                    acc = (acc ^ _round(np.zeros(1, np.uint64), lanes[k])) * _P1 + _P4
            else:
                acc = np.full(len(group), np.uint64(seed) + _P5, np.uint64)
            acc = acc + np.uint64(length)
            while i + 8 <= length:
                acc = _rotl(acc ^ _round(np.zeros(1, np.uint64), words[at + i]), 27) * _P1 + _P4
                i += 8
            if i + 4 <= length:
                acc = _rotl(acc ^ ((words[at + i] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
                i += 4
            while i < length:
                acc = _rotl(acc ^ (padded[at + i].astype(np.uint64) * _P5), 11) * _P1
                i += 1
            acc ^= acc >> np.uint64(33)
            acc *= _P2
            acc ^= acc >> np.uint64(29)
            acc *= _P3
            acc ^= acc >> np.uint64(32)
            out[group] = acc
    return out
