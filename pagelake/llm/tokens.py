"""Exact bulk tokenisation: known words come from a table of ids, the tokenizers library encodes each new one.

Both vocabularies here split a text into words before they merge, and a word's ids don't depend on its neighbours.
So a batch is cut into words by numpy over its bytes, each distinct word is encoded once by the library and its ids
are kept. The cut is only made for texts of ASCII and of the letters U+00C0 to U+00FF, whose classes are certain;
any other text goes to the library whole. A word of up to 16 bytes is told by its length, first and last 8 bytes, a longer one
by all its bytes, so no two words are ever taken for one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .text import U64, lower, mix, pieces

#: Places of a worker's table, which starts anew when half are taken, and words looked up at a time: so its memory is bounded and it never overflows.
SLOTS, FULL, WORDS_AT_ONCE = 1 << 22, 1 << 21, 1 << 20
#: Bytes that are left of a word of so many.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_A, _N, _O, _S = 1, 2, 3, 0
_CLASS = np.full(256, _O, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _A
_CLASS[48:58] = _N
_CLASS[[9, 10, 13, 32]] = _S
_SAFE = np.zeros(256, bool)
_SAFE[[9, 10, 13, *range(32, 127), 0xC3]] = True


def _contractions(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the apostrophes at `at`: which of them begin 's 't 'm 'd 're 've 'll, and how many letters follow."""
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b = padded[at + 1], padded[at + 2]
    two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
    one = np.isin(a, [115, 116, 109, 100])
    return one | two, np.where(one, 1, 2)


def cut_bytes(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans as the byte-level pattern cuts: a space goes with the word after it, other white space stands alone."""
    n = len(data)
    kind = _CLASS[data]
    prev = np.empty(n, np.uint8)
    prev[1:] = kind[:-1]
    prev[edge[:-1]] = 255
    last = edge[1:]
    after = np.empty(n, np.uint8)
    after[:-1] = kind[1:]
    after[last] = _S  # at the end of a text white space stays one run
    space = kind == _S
    start = kind != prev
    tail = space & (after != _S)  # last of a run with a word behind it
    start |= tail
    glue = tail & (data == 32)
    behind = np.zeros(n, bool)
    behind[1:] = glue[:-1]
    start[behind] = False
    at = np.flatnonzero((data == 39) & start & (after == _A) & ~last)
    if len(at):
        yes, letters = _contractions(data, at)
        at, letters = at[yes], letters[yes]
        inside = at + letters < n
        at, letters = at[inside], letters[inside]
        whole = np.ones(len(at), bool)
        whole[letters == 2] = ~edge[at[letters == 2] + 2]
        at, letters = at[whole], letters[whole]
        start[at + 1] = False
        behind = at + letters + 1
        behind = behind[behind < n]
        start[behind[kind[behind] == _A]] = True
    begins = np.flatnonzero(start)
    return begins, np.append(begins[1:], n)


def cut_words(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans as the lower-casing pattern cuts: runs of letters, single digits, runs of the rest; no white space."""
    n = len(data)
    kind = _CLASS[data]
    prev = np.empty(n, np.uint8)
    prev[1:] = kind[:-1]
    prev[edge[:-1]] = 255
    start = (kind != prev) | (kind == _N)
    at = np.flatnonzero((data == 39) & start & ~edge[1:])
    if len(at):
        yes, letters = _contractions(data, at)
        at, letters = at[yes], letters[yes]
        whole = np.ones(len(at), bool)
        whole[letters == 2] = ~edge[at[letters == 2] + 2]
        at, letters = at[whole], letters[whole]
        start[at + 1] = False
        behind = at + letters + 1
        behind = behind[behind < n]
        start[behind[kind[behind] == _A]] = True
    begins = np.flatnonzero(start)
    ends = np.append(begins[1:], n)
    real = kind[begins] != _S
    return begins[real], ends[real]


class BulkTokenizer:
    """Ids of many texts at a time, equal to those that the library gives with add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        state = __import__("json").loads(self.library.to_str())
        self.folds = state["normalizer"] is not None
        self.cut = cut_words if self.folds else cut_bytes
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(SLOTS, U64)
        self.entry = np.zeros(SLOTS, np.int32)
        self.lens = np.zeros(1024, np.int32)
        self.offs = np.zeros(1024, np.int64)
        self.told = np.zeros((1024, 3), U64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = self.n_flat = 0
        self.long: dict[bytes, int] = {}

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        slot = (h >> U64(42)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            got = self.keys[slot]
            hit = got == h[todo]
            out[todo[hit]] = self.entry[slot[hit]]
            go = ~hit & (got != 0)
            todo, slot = todo[go], (slot[go] + 1) & (SLOTS - 1)
        return out

    def append(self, ids: list[list[int]]) -> np.ndarray:
        """New entries, one for each list of ids."""
        k = len(ids)
        lens = np.array([len(x) for x in ids], np.int32)
        flat = np.array([y for x in ids for y in x], np.uint32)
        while self.used + k > len(self.lens):
            self.lens, self.offs, self.told = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lens, self.offs, self.told))
        while self.n_flat + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.lens[self.used : self.used + k] = lens
        self.offs[self.used : self.used + k] = self.n_flat + np.cumsum(lens) - lens
        self.flat[self.n_flat : self.n_flat + len(flat)] = flat
        self.used += k
        self.n_flat += len(flat)
        return np.arange(self.used - k, self.used, dtype=np.int32)

    def key(self, h: np.ndarray, entry: np.ndarray) -> None:
        """Let entries be found by hashes, which differ and aren't in the table."""
        slot = (h >> U64(42)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[todo[free]]
            mine = self.keys[slot] == h[todo]
            self.entry[slot[mine]] = entry[todo[mine]]
            todo, slot = todo[~mine], (slot[~mine] + 1) & (SLOTS - 1)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids, bounds of the rows in ids) of runs of rows; a null is an empty text."""
        for lo, hi, data, offsets in pieces(column):
            n = hi - lo
            latin = np.zeros(len(data), bool)
            latin[1:] = data[:-1] == 0xC3
            fine = np.where(latin, (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7), _SAFE[data])
            bad = np.unique(np.searchsorted(offsets, np.flatnonzero(~fine), "right") - 1)
            whole = {}
            if len(bad):
                texts = [bytes(data[offsets[r] : offsets[r + 1]]).decode("utf-8", "replace") for r in bad]
                for r, t in zip(bad, texts, strict=True):
                    whole[int(r)] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
                keep = np.ones(n, bool)
                keep[bad] = False
                data = data[np.repeat(keep, np.diff(offsets))]
                offsets = np.concatenate([[0], np.cumsum(np.where(keep, np.diff(offsets), 0))])
            if len(data):
                edge = np.zeros(len(data) + 1, bool)
                edge[offsets] = True
                data = lower(data) if self.folds else data
                ids, per = self._spans(data, *self.cut(data, edge), offsets)
            else:
                ids, per = np.zeros(0, np.uint32), np.zeros(n, np.int64)
            if whole:
                at = np.concatenate([[0], np.cumsum(per)])
                parts = [whole[r] if r in whole else ids[at[r] : at[r + 1]] for r in range(n)]
                ids, per = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
            yield lo, hi, ids, np.concatenate([[0], np.cumsum(per)])

    def _spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each row has."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        ids, lens = [], []
        for k in range(0, len(starts), WORDS_AT_ONCE):
            if self.used > FULL - WORDS_AT_ONCE:
                self.clear()
            entry = self._entries(data, starts[k : k + WORDS_AT_ONCE], ends[k : k + WORDS_AT_ONCE])
            many = self.lens[entry].astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(many)])
            ids.append(self.flat[np.arange(upto[-1]) + np.repeat(self.offs[entry] - upto[:-1], many)])
            lens.append(many)
        upto = np.concatenate([[0], np.cumsum(np.concatenate(lens))])
        return np.concatenate(ids), np.diff(upto[np.searchsorted(starts, offsets)])

    def _entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each word; those of new words are made."""
        size = ends - starts
        eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
        first = eights[starts] & _MASK[np.minimum(size, 8)]
        last = np.where(size > 8, eights[np.maximum(ends - 8, 0)], first)
        h = mix(first * U64(0x9E3779B97F4A7C15) + mix(last + size.astype(U64) * U64(0xC2B2AE3D27D4EB4F)))
        h[h == 0] = U64(1)
        long = np.flatnonzero(size > 16)
        entry = self.find(h)
        new = np.flatnonzero(entry < 0)
        if len(new) and len(long):
            new = new[size[new] <= 16]
        if len(new):
            fresh, at = np.unique(h[new], return_index=True)
            made = self._made(data, starts, ends, new[at])
            self.told[made] = np.stack([size[new[at]].astype(U64), first[new[at]], last[new[at]]], 1)
            self.key(fresh, made)
            entry[new] = self.find(h[new])
        told = self.told[entry]
        other = np.flatnonzero((told[:, 1] != first) | (told[:, 2] != last) | (told[:, 0] != size.astype(U64)))  # words whose hash is another's
        if len(other) and len(long):
            other = other[size[other] <= 16]
        if len(other):
            entry[other] = self._made(data, starts, ends, other)
        if len(long):
            texts = [data[s:e].tobytes() for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            fresh = {t: i for i, t in zip(long.tolist(), texts, strict=True) if t not in self.long}
            if fresh:
                made = self._made(data, starts, ends, np.array(list(fresh.values())))
                self.long.update(zip(fresh, made.tolist(), strict=True))
            entry[long] = [self.long[t] for t in texts]
        return entry

    def _made(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """New entries for words, as the library encodes them."""
        out = []
        for k in range(0, len(at), 4096):
            some = at[k : k + 4096]
            texts = [data[s:e].tobytes().decode("utf-8") for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
            out.append(self.append([e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]))
        return np.concatenate(out)


_made: dict[str, BulkTokenizer] = {}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str) -> BulkTokenizer:
    """This worker's tokenizer for the vocabulary, made once: a file's path, or the bare name of one of public_tokenizers, found on this machine."""
    if path not in _made:
        _made.clear()
        _made[path] = BulkTokenizer(path if os.sep in path else public_path(path))
    return _made[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id behind each row."""
    n = len(bounds) - 1
    out = np.insert(ids, bounds[1:], np.uint32(end_id))
    return out, bounds + np.arange(n + 1)
