"""Vectorised views of Arrow text columns, shared by the text operators.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; those are
ASCII, so UTF-8 bytes can be cut without decoding.  Everything here is numpy over
the column's own buffer: no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
CHUNK_BYTES = 1 << 19
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LONG_WORD = 64

_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_OTHER_BYTES = np.random.default_rng(20250117).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[int, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
SETTLE_BYTES = 1 << 20


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base & (2**64 - 1), U64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of splitmix64 over unsigned 64-bit values."""
    h = h + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def settle() -> None:
    """Give back to the machine what freed arrays have left: workers outlive their tasks, and what each keeps adds up."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of text, one row at least; null texts become empty."""
    i = batch.schema.get_field_index(column)
    batch = batch.set_column(i, column, pc.fill_null(batch.column(i), ""))
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.binary_length(batch.column(i)), dtype=np.int64)
    start, total = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    yield batch.slice(start)
    if sizes.sum() >= SETTLE_BYTES:
        settle()


class Flat:
    """A slice's texts as one run of bytes, with hashes of spans and sums by document."""

    def __init__(self, column: pa.Array, table: np.ndarray | None = None):
        """``table`` maps bytes, as for lower case."""
        if not pa.types.is_string(column.type):
            column = column.cast(pa.string())
        off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        self.data, self.off = data[off[0] : off[-1]], off - off[0]
        if table is not None:
            self.data = table[self.data]
        self.n_docs = len(column)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per document, the sum of a value for each byte."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span; spans over LONG_WORD bytes get xxh3 instead."""
        n = len(self.data)
        if not hasattr(self, "_prefix"):
            self._prefix = np.zeros(n + 1, U64)
            np.cumsum(_BYTES[self.data] * _power(_BASE, n), out=self._prefix[1:])
        h = (self._prefix[ends] - self._prefix[starts]) * _power(_UNBASE, n + 1)[starts]
        h = mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
        for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.data[starts[i] : ends[i]])
        return h


class Texts(Flat):
    """The words of a slice's texts as well."""

    def __init__(self, column: pa.Array, table: np.ndarray | None = None):
        super().__init__(column, table)
        n = len(self.data)
        gap = SPACES[self.data]
        self.gap = gap
        first, last = ~gap, ~gap
        if n:
            first[1:] &= gap[:-1]
            last[:-1] &= gap[1:]
            edge = self.off[:-1]
            edge = edge[edge < n]
            first[edge] = ~gap[edge]
            edge = self.off[1:]
            edge = edge[edge > 0] - 1
            last[edge] = ~gap[edge]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words of document d are woff[d]:woff[d + 1]
        self.woff = np.searchsorted(self.starts, self.off)
        self.n_words = np.diff(self.woff)

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words)

    def word_hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def other_hashes(self) -> np.ndarray:
        """Hashes of the words' bytes by other values of bytes than ``word_hashes``: words that collide there do not collide here."""
        n = len(self.data)
        prefix = np.zeros(n + 1, U64)
        np.cumsum(_OTHER_BYTES[self.data] * _power(_BASE, n), out=prefix[1:])
        h = (prefix[self.ends] - prefix[self.starts]) * _power(_UNBASE, n + 1)[self.starts]
        h = mix(h ^ ((self.ends - self.starts).astype(U64) * U64(0xA24BAED4963EE407)), 77)
        for i in np.flatnonzero(self.ends - self.starts > LONG_WORD).tolist():
            h[i] = xxhash.xxh64_intdigest(self.data[self.starts[i] : self.ends[i]], 77)
        return h


class Numbers:
    """Consecutive numbers for 64-bit hashes: an open-addressed table that looks up whole arrays."""

    def __init__(self, bits: int = 22):
        self.bits, self.count = bits, 0
        self.keys, self.values = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return ((h * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it has none."""
        slot, mask = self._slots(h), (1 << self.bits) - 1
        have = self.keys[slot]
        out = np.where(have == h, self.values[slot], -1)
        open_ = np.flatnonzero((have != h) & (have != 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & mask
            have = self.keys[slot]
            hit = have == h[open_]
            out[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (have != 0)
            open_, slot = open_[go], slot[go]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Number hashes that are distinct and new."""
        own = np.arange(self.count, self.count + len(h), dtype=np.int32)
        self.count += len(h)
        slot, left, mask = self._slots(h), np.arange(len(h)), (1 << self.bits) - 1
        while len(left):
            free = self.keys[slot] == 0
            _, first = np.unique(slot, return_index=True)
            one = np.zeros(len(slot), bool)
            one[first] = True
            put = free & one
            self.keys[slot[put]], self.values[slot[put]] = h[left[put]], own[left[put]]
            left, slot = left[~put], (slot[~put] + 1) & mask
        return own


def windows(hashes: np.ndarray, woff: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words that lies in one document, and each one's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    base = U64((0xA0761D6478BD642F + 2 * seed * 0x8EBC6AF09C88C6E3) & (2**64 - 1) | 1)
    if seed:
        hashes = mix(hashes, seed)
    h = hashes[:n].copy()
    for j in range(1, size):
        h *= base
        h += hashes[j : n + j]
    count = np.maximum(np.diff(woff) - size + 1, 0)
    first = np.repeat(woff[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    return mix(h[first], seed + size), first


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each start, ``length`` of each, in one array."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
