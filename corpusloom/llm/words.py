r"""Words of whole Arrow columns as arrays: their places and hashes, without a Python object for each word.

Words are parted by ``[\x20\x09-\x0D]``. A word's hash is a polynomial of its bytes modulo 2^64, taken
from running sums over a block of bytes, and then mixed; equal words have equal hashes wherever they stand.
A word longer than a block is hashed by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes that are hashed at once, and bytes of the rows that make up a slice (a longer row is a slice of its own).
BLOCK, SLICE = 1 << 18, 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ONE_SPACE = bytes(0x20 if _SPACE[b] else b for b in range(256))

_rng = np.random.default_rng(20240311)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = int(_rng.integers(0, 1 << 61)) * 8 + 5  # odd, and of the longest period


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base % (1 << 64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of some rows: ``starts`` and ``ends`` in ``data``, ``hashes``, and each row's place in ``first``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool):
        self.data, self.offsets = data, offsets
        low, high = int(offsets[0]), int(offsets[-1])
        space = _SPACE[data[low:high]]
        inner = offsets[(offsets < high) & (offsets > low)] - low
        begins, stops = ~space, ~space
        begins[1:] &= space[:-1]
        stops[:-1] &= space[1:]
        # rows follow one another without a blank between
        begins[inner] = ~space[inner]
        stops[inner - 1] = ~space[inner - 1]
        self.starts, self.ends = np.flatnonzero(begins) + low, np.flatnonzero(stops) + low + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.lengths = np.concatenate(([0], np.cumsum(self.ends - self.starts)))
        self.hashes = np.empty(len(self.starts), np.uint64)
        table, at = _FOLDED if fold else _BYTE, 0
        while at < len(self.starts):
            base = int(self.starts[at])
            to = int(np.searchsorted(self.ends, base + BLOCK, side="right"))
            if to <= at:
                word = data[base : self.ends[at]].tobytes()
                self.hashes[at] = xxhash.xxh3_64_intdigest(word.lower() if fold else word)
                at += 1
                continue
            span = data[base : self.ends[to - 1]]
            sums = np.zeros(len(span) + 1, np.uint64)
            np.cumsum(table[span] * _UP[: len(span)], out=sums[1:])
            s, e = self.starts[at:to] - base, self.ends[at:to] - base
            self.hashes[at:to] = mix((sums[e] - sums[s]) * _DOWN[s])
            at = to

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, n: int) -> np.ndarray:
        """The words at which n consecutive words of one row begin."""
        ends = np.repeat(self.first[1:], np.diff(self.first))
        return np.flatnonzero(np.arange(len(ends)) + n <= ends)

    def joined(self, a: int, z: int) -> bytes:
        """Words a up to but not including z, joined by one space each."""
        if a >= z:
            return b""
        text = self.data[self.starts[a] : self.ends[z - 1]].tobytes()
        gaps = len(text) - int(self.lengths[z] - self.lengths[a])
        return text.translate(_ONE_SPACE) if gaps == z - a - 1 else b" ".join(text.split())


def slices(column: pa.Array, fold: bool = False) -> Iterator[tuple[int, Words]]:
    """(first row, words) of stretches of rows of a string or binary column; nulls have no words."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind, (_, places, data) = np.int64 if wide else np.int32, column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, Words(raw, offsets[at : to + 1], fold)
        at = to


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes."""
    size = len(h) - n + 1
    total = np.full(max(size, 0), n, np.uint64)
    for j in range(n if size > 0 else 0):
        total += h[j : j + size] * _RUN[j]
    return mix(total)


_RUN = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
