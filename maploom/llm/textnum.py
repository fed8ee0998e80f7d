"""Vectorised tokenising and hashing of UTF-8 text held in Arrow buffers.

All routines work on a :class:`Texts` chunk: the concatenated bytes of some
documents with their offsets.  Words are maximal runs of bytes other than
space and ``\\x09``-``\\x0D``; these separators are ASCII, so byte positions
never cut a code point.  Hashes are 64-bit and identical on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
#: Bytes of text worked on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_P))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK_BYTES + 1), base & (2**64 - 1), U64)
        step[0] = 1
        have = _POWERS[base] = np.cumprod(step, dtype=U64)
    return have[:n]


class Texts:
    """Bytes and offsets of consecutive documents; null texts are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._words: tuple | None = None

    @classmethod
    def of(cls, array: pa.Array) -> Texts:
        array = array.cast(pa.large_string())
        if array.null_count:
            array = array.fill_null("")
        _, offsets, data = array.buffers()
        if len(array) == 0:
            return cls(np.empty(0, np.uint8), np.zeros(1, np.int64))
        offs = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
        raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.empty(0, np.uint8)
        return cls(raw, offs - offs[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Texts:
        """A-Z lower-cased, all else as it is."""
        out = Texts(_LOWER[self.data], self.offsets)
        out._words = self._words
        return out

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def runs(self, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each maximal run without separators; words are found once."""
        if separator is _SEPARATOR:
            if self._words is None:
                self._words = self._runs(separator)
            return self._words
        return self._runs(separator)

    def _runs(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.data)
        if n == 0:
            z = np.empty(0, np.int64)
            return z, z, z
        inside = ~separator[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, np.searchsorted(self.offsets, start, "right") - 1

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each span; equal bytes, equal hash."""
        n = len(self.data)
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[self.data] * _powers(_P, n), out=total[1:], dtype=U64)
        h = (total[end] - total[start]) * _powers(_PINV, n + 1)[start]
        return mix(h ^ (end - start).astype(U64) * _M2)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches with about ``size`` bytes of text in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = Texts.of(batch.column(column))
        at = 0
        while at < len(whole):
            stop = int(np.searchsorted(whole.offsets, whole.offsets[at] + size, "right")) - 1
            stop = min(max(stop, at + 1), len(whole))
            lo, hi = whole.offsets[at], whole.offsets[stop]
            yield batch.slice(at, stop - at), Texts(whole.data[lo:hi], whole.offsets[at : stop + 1] - lo)
            at = stop


def windows(words: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and first word of each run of ``size`` words in a document."""
    m = len(words) - size + 1
    if m <= 0:
        z = np.empty(0, np.int64)
        return z.astype(U64), z, z
    total = np.zeros(m, U64)
    for k in range(size):
        total += mix(words[k : k + m] + U64(k + 1) * U64(_P)) * U64(2 * k + 3)
    at = np.flatnonzero(doc[:m] == doc[size - 1 :])
    return mix(total[at]), doc[at], at


def shingle_sets(texts: Texts, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct ``size``-word shingle hashes of each document.

    Texts are lower-cased first (A-Z).  A document of fewer words, but at least
    one, has the hash of its whole sequence; one without words has none.
    """
    texts = texts.lower()
    start, end, doc = texts.runs()
    words = texts.span_hash(start, end)
    n_docs = len(texts)
    h, owner, _ = windows(words, doc, n_docs, size)
    cut = np.searchsorted(owner, np.arange(n_docs + 1))
    word_cut = np.searchsorted(doc, np.arange(n_docs + 1))
    out = []
    for k in range(n_docs):
        n = word_cut[k + 1] - word_cut[k]
        if n >= size:
            out.append(np.unique(h[cut[k] : cut[k + 1]]))
        elif n:
            few = words[word_cut[k] : word_cut[k + 1]]
            total = U64(n) * _M1
            for i, w in enumerate(few):
                total = total + mix(np.array([w + U64(i + 1) * U64(_P)], U64))[0] * U64(2 * i + 3)
            out.append(mix(np.array([total], U64)))
        else:
            out.append(np.empty(0, U64))
    return out
