"""Vectorised text kernels over Arrow string buffers: words, n-grams and their 64-bit hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Base of the polynomial hash over bytes and of the one over words; odd, so that they can be inverted modulo 2**64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Letters, digits and all bytes of characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, U64)
            done = 1
            while done < size:
                p[done : 2 * done] = p[:done] * U64(pow(b, done, 1 << 64))
                done *= 2
            out.append(p)
        have = _powers[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    """Hash of values[s:e] for each span, whatever its place."""
    p, inverse = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * p[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about `limit` bytes; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the letters U+00C0 to U+00DE, in UTF-8 bytes."""
    out = LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes that `inside` marks; a run never crosses rows."""
    is_in = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = is_in[:-1]
    starts = np.flatnonzero(is_in & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = is_in[1:]
    ends = np.flatnonzero(is_in & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 bytes, and where each row begins among them."""
    if not (data >= 0x80).any():
        return data.astype(np.uint32), offsets
    at = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    out = padded[at]
    for low, bits in ((0xC0, 0x1F), (0xE0, 0x0F), (0xF0, 0x07)):
        long = np.flatnonzero(padded[at] >= low)
        if len(long):  # one byte more than those before, so these start anew with fewer bits of the first
            more = {0xC0: 1, 0xE0: 2, 0xF0: 3}[low]
            value = padded[at[long]] & bits
            for k in range(1, more + 1):
                value = (value << np.uint32(6)) | (padded[at[long] + k] & 0x3F)
            out[long] = value
    return out, np.searchsorted(at, offsets)


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By character up to U+FFFF: its lower case, whether it is a letter, and whether it is one or a mark that goes with one."""
    every = [chr(i) for i in range(1 << 16)]
    low = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in every], np.uint32)
    kinds = [unicodedata.category(c)[0] for c in every]
    return low, np.array([k == "L" for k in kinds]), np.array([k in "LM" for k in kinds])


def letters(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower case, is a letter, is a letter or mark) of characters; beyond U+FFFF case is kept."""
    low, letter, part = _characters()
    near = np.minimum(points, 0xFFFF)
    low, letter, part = low[near], letter[near], part[near]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        some, back = np.unique(points[far], return_inverse=True)
        kinds = [unicodedata.category(chr(c))[0] for c in some.tolist()]
        low[far] = points[far]
        letter[far] = np.array([k == "L" for k in kinds])[back]
        part[far] = np.array([k in "LM" for k in kinds])[back]
    return low, letter, part


def script_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words() of letters and digits, where each character from U+0800 on is a word of its own, as scripts without spaces are
    there; marks of U+2000 to U+206F and U+3000 to U+303F part words and are none."""
    wide = data >= 0xE0
    if not wide.any():
        return words(data, offsets, ALNUM)
    lead = (data & 0xC0) != 0x80
    owner = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0))
    second = np.concatenate([data[1:], np.zeros(1, np.uint8)])
    mark = ((data == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((data == 0xE3) & (second == 0x80))
    inside = ALNUM[data] & ~mark[owner]
    alone = inside & wide[owner]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    parted = edge[:-1] | (alone & lead)  # a word begins here at the latest
    parted[1:] |= alone[:-1] & ~alone[1:]
    before = np.concatenate([np.zeros(1, bool), inside[:-1]])
    starts = np.flatnonzero(inside & (~before | parted))
    stops = ~inside | parted
    ends = np.flatnonzero(np.concatenate([stops[1:], np.ones(1, bool)]) & inside) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in `rows`, which ascends; n + 1 numbers."""
    return np.searchsorted(rows, np.arange(n + 1))


def ngram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words (over row ends too; the caller leaves those out)."""
    if len(word_hashes) < n:
        return np.zeros(0, U64)
    at = np.arange(len(word_hashes) - n + 1)
    return hash_spans(word_hashes, at, at + n, WORD_BASE)


# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U64(bits)) | (x >> U64(64 - bits))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[s:e] for each span, all spans in step."""
    with np.errstate(over="ignore"):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        fours = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
        at, size = starts.copy(), ends - starts
        acc = np.full(len(at), U64(seed) + _P5)
        long = np.flatnonzero(size >= 32)
        if len(long):
            v = [np.full(len(long), x) for x in (U64(seed) + _P1 + _P2, U64(seed) + _P2, U64(seed), U64(seed) - _P1)]
            live = np.arange(len(long))
            while len(live):
                here = at[long[live]]
                for k in range(4):
                    v[k][live] = _round(v[k][live], eights[here + 8 * k])
                at[long[live]] += 32
                live = live[ends[long[live]] - at[long[live]] >= 32]
            h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for x in v:
                h = (h ^ _round(np.zeros_like(x), x)) * _P1 + _P4
            acc[long] = h
        acc += size.astype(U64)
        left = ends - at
        for width, step in ((8, lambda a, i: _turn(a ^ _round(np.zeros_like(a), eights[i]), 27) * _P1 + _P4), (4, lambda a, i: _turn(a ^ fours[i].astype(U64) * _P1, 23) * _P2 + _P3), (1, lambda a, i: _turn(a ^ padded[i].astype(U64) * _P5, 11) * _P1)):
            live = np.flatnonzero(left >= width)
            while len(live):
                acc[live] = step(acc[live], at[live])
                at[live] += width
                left[live] -= width
                live = live[left[live] >= width]
        acc = (acc ^ (acc >> U64(33))) * _P2
        acc = (acc ^ (acc >> U64(29))) * _P3
        return acc ^ (acc >> U64(32))
