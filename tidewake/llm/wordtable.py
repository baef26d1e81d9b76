"""Words of plain texts and their token ids, looked up many at once.

A text is plain where it holds ASCII and those letters of Latin-1 that have one lower-case form only: normalising it is
lower-casing then, and it is one byte a character. Words are what the vocabulary's pre-tokeniser makes of it:

    's|'t|'re|'ve|'m|'ll|'d|[letters]+|[digit]|[neither, nor white space]+

They are found by comparing each byte's class with the class before. A word of at most 32 bytes is four 64-bit numbers,
exactly; an open-addressing table of such words gives the place of its ids in one pool, for all words of a batch at
once, so that a text's ids are gathered by numpy without a Python object for each word. Words met first are handed to
`encode`, longer words each time. A table holds at most LIMIT words, hence at most about 80 MB, and is emptied when full.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np

PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
LIMIT, BITS, WIDTH = 800_000, 21, 32
#: Bytes of text looked up at once.
STRETCH = 1 << 21
SPACE, LETTER, DIGIT, OTHER = range(4)
_kinds = np.full(256, OTHER, np.uint8)
_kinds[[0, *range(9, 14), 32]] = SPACE
_kinds[[*range(ord("a"), ord("z") + 1), *(c for c in range(0xDF, 0x100) if c != 0xF7)]] = LETTER
_kinds[[*range(ord("0"), ord("9") + 1)]] = DIGIT
_masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_mix = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
#: Letters after a quote that make a contraction alone, and those that do with a certain second one.
_alone, _second = np.zeros(256, bool), np.zeros(256, np.uint8)
_alone[list(b"stmd")] = True
_second[list(b"rvl")] = list(b"eel")
_blank = re.compile(rb"[\t-\r ]")


def _starts(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of data[:n] start and end."""
    kind = _kinds[data[: n + 1]]
    kind[n] = SPACE
    before = np.empty(n + 1, np.uint8)
    before[0], before[1:] = SPACE, kind[:-1]
    border = (kind != before) | (kind == DIGIT)
    quotes = np.flatnonzero(data[:n] == 39)
    quotes = quotes[before[quotes] != OTHER]
    one, two = data[quotes + 1], data[quotes + 2]
    size = np.where(_alone[one], 2, np.where((_second[one] == two) & (two > 0), 3, 0))
    quotes, size = quotes[size > 0], size[size > 0]
    border[quotes + 1] = False
    border[quotes + size] = True
    at = np.flatnonzero(border)
    word = np.flatnonzero(kind[at[:-1]] != SPACE)
    return at[word], at[word + 1]


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    return [data[a:b].tobytes().decode("latin-1") for a, b in zip(start.tolist(), end.tolist(), strict=True)]


class WordTable:
    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.entry = np.full(1 << BITS, -1, np.int32)
        self.tag = np.zeros(1 << BITS, np.uint64)
        self.keys = np.zeros((LIMIT, WIDTH // 8), np.uint64)
        self.first, self.count = np.zeros(LIMIT, np.int64), np.zeros(LIMIT, np.int64)
        self.pool, self.used, self.held, self.size = np.zeros(1 << 16, "<u4"), 0, 0, 0

    def _add(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Put the words' ids at the end of the pool: where each begins, and its number."""
        ids = self.encode(words)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        end = self.used + int(count.sum())
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(end, len(self.pool) * 2) - self.used, "<u4")])
        self.pool[self.used : end] = np.fromiter(chain.from_iterable(ids), np.int64, end - self.used)
        first = self.used + np.cumsum(count) - count
        self.used = end
        return first, count

    def _find(self, tag: np.ndarray, keys: list[np.ndarray], wide: np.ndarray) -> np.ndarray:
        """The entry of each word: -1 where there is none, -2 where another word has its tag. keys: the words at the places in wide."""
        at = ((tag * _mix[3]) >> np.uint64(64 - BITS)).astype(np.int64)
        seen, out = self.tag[at], self.entry[at]
        out[seen != tag] = -1
        again = np.flatnonzero((seen != tag) & (seen != 0))
        while len(again):
            at[again] = (at[again] + 1) & ((1 << BITS) - 1)
            seen = self.tag[at[again]]
            hit = seen == tag[again]
            out[again[hit]] = self.entry[at[again[hit]]]
            again = again[~hit & (seen != 0)]
        # a tag tells a word of up to 7 bytes; of longer ones all bytes are compared
        out[wide] = np.where((out[wide] >= 0) & ~self._same(out[wide], keys), -2, out[wide])
        return out

    def _same(self, entries: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([self.keys[entries, k] == key for k, key in enumerate(keys)])

    def _learn(self, words: list[str], tag: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """New entries for words of different tags."""
        first, count = self._add(words)
        new = np.arange(self.size, self.size + len(words))
        self.keys[new], self.first[new], self.count[new] = keys, first, count
        self.size, self.held = self.size + len(words), self.used
        at = ((tag * _mix[3]) >> np.uint64(64 - BITS)).astype(np.int64)
        left = np.arange(len(words))
        while len(left):
            free = left[self.tag[at[left]] == 0]
            self.entry[at[free]] = new[free]
            placed = free[self.entry[at[free]] == new[free]]
            self.tag[at[placed]] = tag[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << BITS) - 1)
        return new

    def _lookup(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids begin in the pool, and their number."""
        size = end - start
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        tag = eight[start] & _masks[np.minimum(size, 8)]
        wide = np.flatnonzero(size > 7)
        wide = wide[size[wide] <= WIDTH]
        at, rest = start[wide], size[wide]
        keys = [eight[at + 8 * k] & _masks[np.clip(rest - 8 * k, 0, 8)] for k in range(WIDTH // 8)]
        h = keys[0]
        for k in range(1, WIDTH // 8):
            h = ((h ^ (h >> np.uint64(29))) * _mix[0] + keys[k]) * _mix[1]
        tag[wide] = ((h ^ (h >> np.uint64(31))) * _mix[2]) | np.uint64(1 << 63)
        out = self._find(tag, keys, wide)
        long = size > WIDTH
        out[long] = -2
        new = np.flatnonzero(out == -1)
        if len(new):
            unique, one, which = np.unique(tag[new], return_index=True, return_inverse=True)
            one = new[one]
            if len(unique) > LIMIT:
                return self._apart(data, start, end)
            if self.size + len(unique) > LIMIT:
                self.clear()
                return self._lookup(data, start, end)
            full = np.stack([eight[start[one] + 8 * k] & _masks[np.clip(size[one] - 8 * k, 0, 8)] for k in range(WIDTH // 8)], axis=1)
            out[new] = self._learn(_strings(data, start[one], end[one]), unique, full)[which]
            out[wide] = np.where((out[wide] >= 0) & ~self._same(out[wide], keys), -2, out[wide])
        first, count = self.first[out], self.count[out]
        odd = np.flatnonzero(out == -2)
        if len(odd):
            first[odd], count[odd] = self._apart(data, start[odd], end[odd])
        return first, count

    def _apart(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that the table can't hold; their ids stay in the pool until the stretch is done."""
        words = _strings(data, start, end)
        names = {w: k for k, w in enumerate(dict.fromkeys(words))}
        first, count = self._add(list(names))
        which = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
        return first[which], count[which]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of plain texts."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        borders = np.cumsum(sizes + 1)  # after each text's separator
        joined = " ".join(texts).lower().encode("latin-1")
        ids, counts, a = [], np.zeros(len(texts), np.int64), 0
        while a < len(joined):
            blank = _blank.search(joined, a + STRETCH)
            b = blank.start() if blank else len(joined)
            # zeros after the end, as words are read eight bytes at a time
            data = np.frombuffer(joined[a:b] + bytes(WIDTH + 8), np.uint8)
            start, end = _starts(data, b - a)
            first, count = self._lookup(data, start, end)
            ends = np.cumsum(count)
            ids.append(self.pool[np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)])
            counts += np.bincount(np.searchsorted(borders, start + a, "right"), count, len(texts)).astype(np.int64)
            self.used = self.held
            a = b
        whole = np.concatenate(ids) if ids else np.empty(0, "<u4")
        cuts = np.cumsum(counts)
        return [whole[y - n : y] for y, n in zip(cuts.tolist(), counts.tolist(), strict=True)]
