"""Vectorised word spans and hashes over the UTF-8 buffer of an Arrow string column.

A word is a maximal run of bytes outside ``0x20`` and ``0x09-0x0D``; it never spans two documents.
Everything works on slices of whole documents (a few MB each), so memory does not follow the size of
a partition; a single document longer than the limit is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift), so that all bits depend on all others."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers, the same on every machine."""
    at = np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed * 0x5851F42D4C957F2D % 2**64)
    return mix(at) | _U(1)


_BYTE = [randoms(256, s) for s in (1, 2)]
_BASE = [_U(0x2545F4914F6CDD1D), _U(0xD1342543DE82EF95)]
_POWERS = [np.ones(1, dtype=np.uint64) for _ in _BASE]


def _powers(n: int, which: int) -> np.ndarray:
    p = _POWERS[which]
    if len(p) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        p = np.full(size, _BASE[which], dtype=np.uint64)
        p[0] = 1
        p = np.cumprod(p, dtype=np.uint64)
        if size <= 1 << 20:  # one huge word must not stay in memory
            _POWERS[which] = p
    return p


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as an empty text."""
    col = pc.fill_null(col, "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type)
    if len(col) == 0 or col.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8), offs.astype(np.int64)


@dataclass
class Words:
    """Words of some whole documents: byte spans, and for each document the range of its words."""

    data: np.ndarray  # bytes of these documents
    offs: np.ndarray  # documents' byte offsets in data
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # document of each word
    first: np.ndarray  # index of each document's first word; one more entry at the end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def pos(self) -> np.ndarray:
        """Each word's place in its document."""
        return np.arange(len(self.starts)) - self.first[self.doc]

    def hashes(self, which: int = 0, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``which`` (0 or 1) picks one of two independent hashes."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        b = self.data[IS_WORD[self.data]]
        if lower:
            b = np.where((b >= 65) & (b <= 90), b + 32, b)
        lens = self.ends - self.starts
        head = np.cumsum(lens) - lens
        at = np.arange(len(b)) - np.repeat(head, lens)
        v = _BYTE[which][b] * _powers(int(lens.max()), which)[at]
        return mix(np.add.reduceat(v, head) + lens.astype(np.uint64) * _U(0x9E3779B97F4A7C15))

    def windows(self, k: int) -> np.ndarray:
        """True for each word that starts a run of ``k`` words of its document."""
        return np.arange(len(self.starts)) + k <= self.first[self.doc + 1]


def chained(h: np.ndarray, k: int, at: np.ndarray, seed: int = 7) -> np.ndarray:
    """Hash of the ``k`` consecutive word hashes starting at each index of ``at``."""
    out = np.zeros(len(at), np.uint64)
    for j, c in enumerate(randoms(k, seed)):
        out += h[at + j] * c
    return mix(out)


def words_of(data: np.ndarray, offs: np.ndarray) -> Words:
    w = IS_WORD[data]
    heads = offs[1:-1]
    heads = heads[heads < len(data)]
    first = w.copy()
    first[1:] &= ~w[:-1]
    first[heads] = w[heads]
    last = w.copy()
    last[:-1] &= ~w[1:]
    tails = heads[heads > 0] - 1
    last[tails] = w[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offs, starts, "right") - 1
    begin = np.zeros(len(offs), np.int64)
    np.cumsum(np.bincount(doc, minlength=len(offs) - 1), out=begin[1:])
    return Words(data, offs, starts, ends, doc, begin)


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for runs of rows of at most ``limit`` bytes (one row at least)."""
    data, offs = buffers(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, words_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j
