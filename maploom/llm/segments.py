"""Encode texts by their distinct segments.

A tokenizer whose merges never cross certain places can encode the segments
between them one by one.  Segments repeat a lot, so each distinct one is encoded
once per worker, and the ids of a text are gathered with numpy.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from . import textnum as tn

#: Distinct segments kept per worker (and eight times as many ids); new ones are encoded so many at once.
KEEP, AT_ONCE = 1_000_000, 8192


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start .. start+length-1 of each pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - begin, lengths)


class SegmentEncoder:
    """Ids of whole chunks, from an encoder of lists of byte strings to lists of ids.

    Known segments are found in an open-addressing table of numpy arrays, so a
    worker holds about 30 bytes a segment besides its ids, which are of the given kind.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], kind: type = np.uint32):
        self.encode, self.kind = encode, kind
        self._clear(KEEP)

    def _clear(self, room: int) -> None:
        """An empty table for ``room`` segments, at most half full."""
        self.room, self.n, self.used = room, 0, 0
        slots = 1 << (2 * room - 1).bit_length()
        self.mask = tn.U64(slots - 1)
        self.key, self.at = np.zeros(slots, tn.U64), np.zeros(slots, np.int32)
        self.start, self.length = np.empty(room, np.int64), np.empty(room, np.int32)
        self.ids = np.empty(1 << 16, self.kind)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each segment, -1 for unknown ones."""
        out = np.full(len(h), -1, np.int32)
        open_, slot = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(open_):
            key = self.key[slot]
            hit = key == h[open_]
            out[open_[hit]] = self.at[slot[hit]]
            go = ~hit & (key != 0)
            open_, slot = open_[go], (slot[go] + 1) & int(self.mask)
        return out

    def _add(self, h: np.ndarray, parts: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        need = self.used + int(sizes.sum())
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(need, len(self.ids)), self.kind)])
        number = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.start[number], self.length[number] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used : need] = np.fromiter(chain.from_iterable(parts), self.kind, need - self.used)
        self.used, self.n = need, self.n + len(h)
        slot = (h & self.mask).astype(np.int64)
        while len(h):  # of those that want a free slot the first one gets it
            free = np.flatnonzero(self.key[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            got = free[first]
            self.key[slot[got]], self.at[slot[got]] = h[got], number[got]
            rest = np.ones(len(h), bool)
            rest[got] = False
            h, number, slot = h[rest], number[rest], (slot[rest] + 1) & int(self.mask)

    def __call__(self, texts: tn.Texts, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the segments, in order, and the number of ids of each document."""
        h = texts.span_hash(start, end)
        h[h == 0] = 1
        index = self._find(h)
        miss = np.flatnonzero(index < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            if self.n + len(new) > self.room or self.used > 8 * KEEP:  # anew, with what this chunk needs
                miss = np.arange(len(h))
                new, first = np.unique(h, return_index=True)
                self._clear(max(KEEP, len(new)))
            raw, at = texts.data.tobytes(), miss[first]
            for k in range(0, len(new), AT_ONCE):
                part = at[k : k + AT_ONCE]
                self._add(new[k : k + AT_ONCE], self.encode([raw[a:b] for a, b in zip(start[part].tolist(), end[part].tolist(), strict=True)]))
            index[miss] = self._find(h[miss])
        length = self.length[index].astype(np.int64)
        return self.ids[ragged(self.start[index], length)], np.bincount(doc, length, minlength=len(texts)).astype(np.int64)


def spans(texts: tn.Texts, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of the segments between the cuts (a flag per byte: a segment starts here)."""
    n = len(texts.data)
    begin = cut.copy()
    begin[texts.offsets[:-1][texts.offsets[:-1] < n]] = True
    start = np.flatnonzero(begin)
    end = np.r_[start[1:], n] if len(start) else start
    return start, end, np.searchsorted(texts.offsets, start, "right") - 1
