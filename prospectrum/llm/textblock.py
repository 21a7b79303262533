"""Vectorised word and line statistics over Arrow string columns.

A batch is handled in blocks of about a megabyte of UTF-8, so that memory
stays bounded whatever a batch holds; a longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

#: Word separators: space and the controls 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_RANDOM = np.random.default_rng(20240131)
_BYTE_VALUE = _RANDOM.integers(0, 2**64, 256, np.uint64, endpoint=False)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_DOC = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null has no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, TextBlock]]:
    """(first row, end row, block) for runs of rows of about ``most`` bytes."""
    data, offsets = string_buffers(column)
    row, n = 0, len(column)
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, TextBlock(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


class TextBlock:
    """Some texts as one byte array, with features made when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1

    def take(self, keep: np.ndarray) -> TextBlock:
        """The block of the texts that keep marks."""
        lengths = np.diff(self.offsets)
        return TextBlock(self.data[np.repeat(keep, lengths)], np.concatenate([[0], np.cumsum(lengths[keep])]))

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a value of each byte, by text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])

    @cached_property
    def in_word(self) -> np.ndarray:
        return ~SEPARATOR[self.data]

    @cached_property
    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        inside, n = self.in_word, len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        first = self.offsets[:-1]
        first = first[first < n]
        starts[first] = inside[first]
        last = self.offsets[1:] - 1
        last = last[last >= 0]
        ends[last] = inside[last]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    @property
    def word_starts(self) -> np.ndarray:
        return self._edges[0]

    @property
    def word_ends(self) -> np.ndarray:
        return self._edges[1]

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(np.searchsorted(self.word_starts, self.offsets))

    @cached_property
    def word_docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words)

    @cached_property
    def _prefix(self) -> np.ndarray:
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * _power_tables(len(self.data) + 1)[0][:-1], out=total[1:])
        return total

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal spans have equal hashes."""
        inverse = _power_tables(len(self.data) + 1)[1]
        return mix((self._prefix[ends] - self._prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.word_starts, self.word_ends)

    @cached_property
    def word_chars(self) -> np.ndarray:
        """Code points inside words, by text."""
        return self.sums(self.in_word & ((self.data & 0xC0) != 0x80))

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each line with a word; lines end at newlines."""
        breaks = np.flatnonzero(self.data == 10)
        docs = np.searchsorted(self.offsets, breaks, "right") - 1
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        ends = np.concatenate([breaks, self.offsets[1:]])
        of = np.concatenate([np.arange(self.n_docs), docs])
        starts = starts[np.lexsort((starts, of))]
        of_end = np.concatenate([docs, np.arange(self.n_docs)])
        ends = ends[np.lexsort((ends, of_end))]
        of = np.sort(of)
        filled = np.searchsorted(self.word_starts, ends) > np.searchsorted(self.word_starts, starts)
        return starts[filled], ends[filled], of[filled]

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[2], minlength=self.n_docs)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        starts, ends, of = self.lines
        keys = mix(self.hashes(starts, ends) ^ (of.astype(np.uint64) * _DOC))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        return np.bincount(of[order][1:][same], minlength=self.n_docs)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in 3-word windows that their text holds twice or more."""
        words, of = self.word_hashes, self.word_docs
        if len(words) < 4:
            return np.zeros(self.n_docs, np.int64)
        inside = of[2:] == of[:-2]
        keys = mix(words[:-2] + mix(words[1:-1] + np.uint64(1)) * _K1 + mix(words[2:] + np.uint64(2)) * _K2 + of[:-2].astype(np.uint64) * _DOC)
        ordered = np.sort(keys[inside])
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(twice):
            return np.zeros(self.n_docs, np.int64)
        at = np.searchsorted(twice, keys)
        hit = (twice[np.minimum(at, len(twice) - 1)] == keys) & inside
        covered = np.zeros(len(words), bool)
        covered[:-2] |= hit
        covered[1:-1] |= hit
        covered[2:] |= hit
        return np.bincount(of[covered], minlength=self.n_docs)

    def count_bytes(self, table: np.ndarray) -> np.ndarray:
        """Bytes that a table of 256 marks, by text."""
        return self.sums(table[self.data])
