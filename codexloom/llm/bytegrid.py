"""Vectorised words and shingles over the bytes of many texts at once.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Those bytes never occur inside a multi-byte UTF-8
character, so cutting at byte level equals cutting at character level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes other than ASCII letters and digits and those of longer characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
_EXACT = _table(17, 256)
_FOLDED = _EXACT.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _EXACT[ord("a") : ord("z") + 1]
_STEP = _table(99, 16)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_P, SLICE_BYTES + 1)
_INV = _powers(_PINV, SLICE_BYTES + 1)


@dataclass
class Words:
    """Words of a slice of texts: byte ranges [start, end), a 64-bit hash each, and the first word of each text."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # n_texts + 1
    sums: np.ndarray  # running sums of the bytes' terms, and what undoes the place of a word's start
    undo: np.ndarray

    def prefix(self, size: int) -> np.ndarray:
        """A hash of each word's first ``size`` bytes, or of the whole word if it is shorter."""
        end = np.minimum(self.end, self.start + size)
        return mix((self.sums[end] - self.sums[self.start]) * self.undo[self.start] + np.uint64(size << 32))

    def suffix(self, size: int) -> np.ndarray:
        """A hash of each word's last ``size`` bytes, or of the whole word if it is shorter."""
        start = np.maximum(self.start, self.end - size)
        return mix((self.sums[self.end] - self.sums[start]) * self.undo[start] + np.uint64(size << 40))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, folded: bool = False, apart: np.ndarray = _IS_BLANK) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; ``folded`` hashes A-Z as a-z, ``apart`` marks the bytes between words."""
    n = len(data)
    inside = ~apart[data]
    starts, ends = inside.copy(), inside.copy()
    if n:
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts[edge] = inside[edge]
        edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[edge] = inside[edge]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    pw, inv = (_POW, _INV) if n < len(_POW) else (_powers(_P, n + 1), _powers(_PINV, n + 1))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED if folded else _EXACT)[data] * pw[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))
    return Words(data, offsets, start, end, hashes, np.searchsorted(start, offsets), total, inv)


def shingles(w: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``size``-word shingles; of a shorter text, its whole sequence as one."""
    h, n = w.hashes, len(w.hashes)
    grams = np.zeros(0, np.uint64)
    if n >= size:
        grams = sum((h[k : n - size + 1 + k] * _STEP[k] for k in range(size)), np.zeros(n - size + 1, np.uint64))
        grams = mix(grams)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            one = (h[a:b] * _STEP[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(one + _STEP[15:] * np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(column: pa.Array | pa.ChunkedArray, size: int = 5) -> list[np.ndarray]:
    """Of each text of a column, A-Z lower-cased, the sorted distinct shingle hashes."""
    data, offsets = buffers(column)
    out: list[np.ndarray] = []
    for i, j in slices(offsets):
        a, b = offsets[i], offsets[j]
        out += shingles(words(data[a:b], offsets[i : j + 1] - a, folded=True), size)
    return out
