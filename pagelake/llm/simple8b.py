"""Token-id files in Simple-8b word-aligned coding.

A block holds up to 256 ids as 64-bit little-endian words. The top four bits of a word are its selector:

    selector      0   1       2   3   4   5   6   7   8  9  10  11  12  13  14  15
    ids in it     256 escape  60  30  20  15  12  10  8  7  6   5   4   3   2   1
    bits an id    0   64      1   2   3   4   5   6   7  8  10  12  15  20  30  60

Selector 1 is the escape: the whole word after it is one id of up to 64 bits. The first id stands in the lowest bits;
places of a block's last word beyond its ids are zero. A segment is

    magic "S8B1", uint32 documents D, uint64 ids T, uint32 blocks B, then
    int64 doc_id[D], uint8 known[D] (0: doc_id is null), uint32 n_ids[D], uint32 first word of each block [B + 1], the words.

All numbers are little-endian. Any block decodes alone; a segment's blocks decode together, selector by selector.
"""

from __future__ import annotations

import struct

import numpy as np

U64 = np.uint64
BLOCK = 256
COUNT = np.array([256, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([0, 64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_PACKED = [0, *range(2, 16)]
MAGIC = b"S8B1"


_SMALL = np.zeros(1 << 16, np.uint8)
for _b in sorted({0, *WIDTH[WIDTH < 60].tolist()}):
    _SMALL[min(1 << _b, 1 << 16) :] = _b + 1


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, rounded up to just above a selector's width."""
    if not len(ids) or ids.max() < 1 << 16:
        return _SMALL[ids]
    out = np.zeros(len(ids), np.uint8)
    for b in sorted({0, *WIDTH[WIDTH < 64].tolist()}):
        out[ids >= U64(1 << b)] = b + 1
    return out


def _selectors(need: np.ndarray) -> np.ndarray:
    """Best selector at each place, as if the ids from there on were packed; need has BLOCK zeros behind."""
    n = len(need) - BLOCK
    best = np.full(n, 1, np.uint8)
    span, most = 1, need
    by_count = {}
    while span <= BLOCK:  # by_count[c]: the largest need among c ids
        by_count[span] = most
        most = np.maximum(most[: len(most) - span], most[span:]) if span < BLOCK else most
        span *= 2
    for s in reversed(_PACKED):
        c = int(COUNT[s])
        p = 1 << (c.bit_length() - 1)
        m = by_count[p][:n] if p == c else np.maximum(by_count[p][:n], by_count[p][c - p : c - p + n])
        np.copyto(best, s, where=m <= WIDTH[s])
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block and their number). Greedy, all blocks in step; a word ends with its block."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, "<u8"), np.zeros(1, np.uint32)
    padded = np.zeros((blocks + 1) * BLOCK, U64)
    padded[:n] = ids
    best = _selectors(widths(padded))
    at = np.arange(blocks) * BLOCK
    end = np.minimum(at + BLOCK, n)
    chosen = np.zeros(blocks * BLOCK, bool)
    step = COUNT.astype(np.int64)
    while len(at):
        chosen[at] = True
        at = at + step[best[at]]
        go = at < end
        at, end = at[go], end[go]
    p = np.flatnonzero(chosen)
    s = best[p]
    first = np.concatenate([[0], np.cumsum(np.where(s == 1, 2, 1))])
    out = np.zeros(first[-1], U64)
    out[first[:-1]] = s.astype(U64) << U64(60)
    for k in _PACKED[1:]:
        mine = np.flatnonzero(s == k)
        if not len(mine):
            continue
        begin = p[mine]
        limit = (begin // BLOCK + 1) * BLOCK
        word = out[first[mine]]
        over = begin + int(COUNT[k]) > limit
        for i in range(int(COUNT[k])):
            v = padded[begin + i]
            v[over & (begin + i >= limit)] = 0
            word |= v << U64(i * int(WIDTH[k]))
        out[first[mine]] = word
    raw = np.flatnonzero(s == 1)
    out[first[raw] + 1] = padded[p[raw]]
    starts = np.append(first[np.searchsorted(p, np.arange(blocks) * BLOCK)], first[-1])
    return out.astype("<u8"), starts.astype(np.uint32)


def decode(out: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n ids of encode()'s words."""
    if not n:
        return np.zeros(0, U64)
    sel = (out >> U64(60)).astype(np.int64)
    is_raw = np.zeros(len(out), bool)
    for w in np.flatnonzero(sel == 1):  # an escaped id may itself look like an escape
        if not is_raw[w]:
            is_raw[w + 1] = True
    at = np.flatnonzero(~is_raw)
    s = sel[at]
    block = np.searchsorted(starts, at, "right") - 1
    count = COUNT[s]
    upto = np.cumsum(count) - count
    first = np.searchsorted(block, np.arange(len(starts) - 1))
    place = block * BLOCK + upto - upto[first][block]
    ids = np.zeros((len(starts)) * BLOCK + BLOCK, U64)
    for k in _PACKED[1:]:
        mine = np.flatnonzero(s == k)
        word, begin = out[at[mine]], place[mine]
        limit = (block[mine] + 1) * BLOCK
        for i in range(int(COUNT[k])):
            put = begin + i < limit
            ids[(begin + i)[put]] = ((word >> U64(i * int(WIDTH[k]))) & U64((1 << int(WIDTH[k])) - 1))[put]
    raw = np.flatnonzero(s == 1)
    ids[place[raw]] = out[at[raw] + 1]
    return ids[:n]


def pack_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    out, starts = encode(ids)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    numbers = np.array([0 if x is None else x for x in doc_ids], "<i8")
    head = struct.pack("<4sIQI", MAGIC, len(doc_ids), len(ids), len(starts) - 1)
    return b"".join([head, numbers.tobytes(), known.tobytes(), counts.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), out.tobytes()])


def read_segment(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, all ids) of pack_segment()'s bytes."""
    magic, d, t, b = struct.unpack_from("<4sIQI", blob)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b segment")
    at = struct.calcsize("<4sIQI")
    numbers = np.frombuffer(blob, "<i8", d, at)
    known = np.frombuffer(blob, np.uint8, d, at := at + 8 * d)
    counts = np.frombuffer(blob, "<u4", d, at := at + d).astype(np.int64)
    starts = np.frombuffer(blob, "<u4", b + 1, at := at + 4 * d).astype(np.int64)
    out = np.frombuffer(blob, "<u8", -1, at + 4 * (b + 1))
    return [int(x) if k else None for x, k in zip(numbers, known, strict=True)], counts, decode(out, starts, t)
