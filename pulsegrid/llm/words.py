"""Columnar text helpers that run inside Arrow tasks.

Words are maximal runs of bytes outside {0x20, 0x09..0x0D}; those bytes never occur inside a
multi-byte UTF-8 character, so whole batches are split by array operations on the raw buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Odd 64-bit multipliers of the mixing function.
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of each batch with at most ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row (null: empty) with eight zero bytes after them, and each text's offsets."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64) if offsets else np.zeros(len(texts) + 1, np.int64)
    buf = np.zeros(int(off[-1] - off[0]) + 8, np.uint8)
    if len(buf) > 8:
        buf[:-8] = np.frombuffer(data, np.uint8, len(buf) - 8, int(off[0]))
    return buf, off - off[0]


def pieces(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """Ranges of the buffer as strings; the ranges ascend, don't overlap and aren't empty."""
    keep = np.zeros(len(buf) + 1, np.int8)
    keep[starts] = 1
    keep[ends] -= 1
    data = buf[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)]
    off = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=off[1:])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data)))


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, starts and ends of all words, and each text's offsets into them."""
    buf, off = raw(texts)
    if lower:
        buf = LOWER[buf]
    n = len(buf) - 8
    dark = ~WHITE[buf[:n]]
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n, bool)
    before[:1] = True
    before[1:] = ~dark[:-1]
    starts = np.flatnonzero(dark & (before | first[:n]))
    after = np.empty(n, bool)
    after[-1:] = True
    after[:-1] = ~dark[1:]
    ends = np.flatnonzero(dark & (after | first[1:])) + 1
    return buf, starts, ends, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on all."""
    h = h ^ (h >> np.uint64(32))
    h = h * M1
    h = h ^ (h >> np.uint64(29))
    h = h * M2
    return h ^ (h >> np.uint64(32))


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range, eight bytes at a time for all ranges together."""
    lanes = np.ndarray((max(len(buf) - 7, 0),), "<u8", buf, strides=(1,))
    size = (ends - starts).astype(np.int64)
    h = mix(size.astype(np.uint64) * M3 + M1)
    at, live = 0, np.arange(len(starts))
    while len(live):
        left = np.minimum(size[live] - at, 8).astype(np.uint64)
        live, left = (live, left) if at == 0 else (live[left > 0], left[left > 0])
        lane = lanes[starts[live] + at] & (~np.uint64(0) >> (np.uint64(64) - left * np.uint64(8)))
        h[live] = mix(h[live] * M3 + mix(lane + M2))
        at += 8
        live = live[size[live] > at]
    return h


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive entries (len(h) - k + 1 of them), from those of 1, 2, 4, ... entries."""
    n = max(0, len(h) - k + 1)
    out, done, power, size = np.full(n, M1 ^ np.uint64(k)), 0, h, 1
    while n and done < k:
        if k & size:
            out = (out ^ power[done : done + n]) * M3
            out ^= out >> np.uint64(31)
            done += size
        if done < k:
            power = (power[:-size] * M2) ^ (power[size:] >> np.uint64(27)) ^ power[size:]
            power = power * M1
            power ^= power >> np.uint64(32)
            size *= 2
    return mix(out)


def owners(offsets: np.ndarray) -> np.ndarray:
    """For consecutive groups with these offsets, the group of each entry."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ragged(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of groups ``codes``, group after group, and the offsets of the result."""
    size = np.diff(offsets)[codes]
    to = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    return np.arange(to[-1]) + np.repeat(offsets[codes] - to[:-1], size), to


#: Byte classes: white space, letter, digit, ASCII symbol, anything else.
SPACE_C, LETTER_C, DIGIT_C, SYMBOL_C, OTHER_C = range(5)
CLASS = np.full(256, OTHER_C, np.uint8)
CLASS[:128] = SYMBOL_C
CLASS[:32] = CLASS[127] = OTHER_C
CLASS[WHITE] = SPACE_C
CLASS[ord("0") : ord("9") + 1] = DIGIT_C
CLASS[ord("A") : ord("Z") + 1] = CLASS[ord("a") : ord("z") + 1] = LETTER_C
CLASS[ord("'")] = OTHER_C  # may open a contraction


def classes(buf: np.ndarray) -> np.ndarray:
    """The class of each byte; the two bytes of U+00C0..U+00FF without the signs D7 and F7 are letters."""
    out = CLASS[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    out[lead] = out[lead + 1] = LETTER_C
    return out


def flat_ids(each: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array and offsets."""
    off = np.zeros(len(each) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, each), np.int64, len(each)), out=off[1:])
    return np.fromiter((i for x in each for i in x), np.uint32, int(off[-1])), off
