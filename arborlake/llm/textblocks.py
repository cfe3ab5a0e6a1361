"""Words of whole texts as NumPy arrays: what Arrow tasks share.

A block is about a megabyte of consecutive texts. Its words are found on the bytes of all texts at
once, and each word gets a 64-bit hash, so that nothing is done word by word in Python. Arrays of
a block have an entry per word, or one byte per byte, so a block needs some ten times its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text in a block; a longer text is a block of its own, unless it may be cut.
BLOCK_BYTES = 1 << 20
#: Words up to this size are read in steps of eight bytes; longer ones, which are few, one by one.
_STEPPED = 64
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits (a one-to-one map)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@dataclass
class Words:
    """Words of a block: ``start`` and ``end`` in ``data``, and ``first[i]:first[i + 1]`` of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def _eights(self) -> np.ndarray:
        """The eight bytes from each place of ``data`` on, as a number; unaligned, so index it, don't compute with it."""
        padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
        return np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))

    def hashes(self, salt: int = 0, prefix: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``prefix`` bytes.

        Every eight bytes are mixed in by a map that isn't linear, so that no pattern of bytes cancels out.
        """
        size = self.end - self.start
        if prefix is not None:
            size = np.minimum(size, prefix)
        h = mixed(size.astype(U64) + U64((salt + 1) * 0x632BE59BD9B4E019 % (1 << 64)))
        if not len(h):
            return h
        eights = self._eights()
        longest = int(size.max())
        rows = np.flatnonzero(size <= _STEPPED) if longest > _STEPPED else np.arange(len(size))
        at, left = self.start[rows], size[rows]
        while len(rows):
            h[rows] = mixed((h[rows] ^ (eights[at] & _LOW_BYTES[np.minimum(left, 8)])) * U64(0xD6E8FEB86659FD93) + U64(0x9E3779B97F4A7C15))
            more = left > 8
            rows, at, left = rows[more], at[more] + 8, left[more] - 8
        key = salt.to_bytes(8, "little")
        for i in np.flatnonzero(size > _STEPPED) if longest > _STEPPED else ():
            a = self.start[i]
            h[i] = int.from_bytes(hashlib.blake2b(self.data[a : a + size[i]], digest_size=8, key=key).digest(), "little")
        return h

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words ``a[i]`` and ``b[i]`` have the same bytes."""
        size = self.end[a] - self.start[a]
        found = size == self.end[b] - self.start[b]
        if not len(size):
            return found
        eights = self._eights()
        rows = np.flatnonzero(found & (size <= _STEPPED))
        x, y, left = self.start[a[rows]], self.start[b[rows]], size[rows]
        while len(rows):
            keep = _LOW_BYTES[np.minimum(left, 8)]
            found[rows] &= (eights[x] & keep) == (eights[y] & keep)
            more = (left > 8) & found[rows]
            rows, x, y, left = rows[more], x[more] + 8, y[more] + 8, left[more] - 8
        for i in np.flatnonzero(found & (size > _STEPPED)):
            x, y = self.start[a[i]], self.start[b[i]]
            found[i] = np.array_equal(self.data[x : x + size[i]], self.data[y : y + size[i]])
        return found

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A representative of each distinct word, and for each word which one is its own.

    Words are grouped by hash and then compared by their bytes; words that share a hash with another word
    are told apart one by one.
    """
    _, at, of = np.unique(words.hashes(), return_index=True, return_inverse=True)
    odd = np.flatnonzero(~words.same(at[of], np.arange(len(of)))) if len(of) else at
    if len(odd):
        extra: dict[bytes, int] = {}
        for i in odd.tolist():
            of[i] = extra.setdefault(words.word(i), len(at) + len(extra))
        firsts = {k: i for i, k in zip(odd[::-1].tolist(), of[odd[::-1]].tolist(), strict=True)}
        at = np.concatenate((at, [firsts[k] for k in sorted(firsts)]))
    return at, of


def split_words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACES) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``: runs of bytes that don't part words."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    np.logical_not(between[data], out=inside[:n])
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    edges = offsets[offsets < n]
    begins[edges] = inside[edges]
    start = np.flatnonzero(begins)
    ends = inside[:n] & (~inside[1:] | np.append(begins[1:], False))
    return spans(data, offsets, start, np.flatnonzero(ends) + 1)


def spans(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray) -> Words:
    """Words given by where they start and end, in order."""
    return Words(data, start, end, np.searchsorted(start, offsets), offsets)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text starts; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a text column in blocks: first row, bytes, offsets. Null is the empty text."""
    data, offsets = text_bytes(column)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        last = min(last, len(column))
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def windows(hashes: np.ndarray, first: np.ndarray, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside one text, and the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = np.full(n, salt, U64)
    for j in range(size):
        h = h * U64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    whole = np.ones(len(hashes) + 1, bool)
    for j in range(1, size):
        at = first[1:] - j
        whole[at[at >= first[:-1]]] = False
    at = np.flatnonzero(whole[:n])
    return mixed(h[at]), at
