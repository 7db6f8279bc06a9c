"""Words of a column of texts as numpy arrays: positions, counts and 64-bit hashes.

A column is worked on in blocks of whole texts of about one MiB, so that memory follows the block
or the longest single text. Words are runs of bytes outside a set of separator bytes; as every
separator is ASCII, this equals splitting the decoded text. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)

SPACES = bytes([0x20, *range(0x09, 0x0E)])
# everything outside 0-9, a-z and non-ASCII, once A-Z are lower case
NOT_ALPHANUMERIC = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < n:
            size = max(n, BLOCK)
            back = U(pow(int(BASE), -1, 1 << 64))
            both = []
            for factor in (BASE, back):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                both.append(np.multiply.accumulate(steps))
            self.power, self.inverse = both
        return self.power[:n], self.inverse[:n]


@dataclass
class Words:
    """Words of the texts ``first`` to ``first + len(bounds) - 1`` of a column.

    ``data`` holds the lower-cased bytes, ``start`` and ``end`` the words' places in it, and
    ``bounds[i]:bounds[i + 1]`` are the words of the i-th text; ``place`` are the texts' borders in data.
    """

    first: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    place: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self, powers: _Powers) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):
            origin = int(self.start[at])
            upto = max(at + 1, int(np.searchsorted(self.end, origin + BLOCK, "right")))
            width = int(self.end[upto - 1]) - origin
            power, inverse = powers.upto(width + 1)
            sums = np.zeros(width + 1, np.uint64)
            values = self.data[origin : origin + width].astype(np.uint64)
            values += U(1)
            np.cumsum(values * power[:width], out=sums[1:])
            s, e = self.start[at:upto] - origin, self.end[at:upto] - origin
            out[at:upto] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93))
            at = upto
        return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls have no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(texts):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    places = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return places, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def blocks(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``BLOCK`` bytes; a longer text is a range of its own."""
    at, n = 0, len(places) - 1
    while at < n:
        upto = max(at + 1, int(np.searchsorted(places, places[at] + BLOCK, "right")) - 1)
        yield at, min(upto, n)
        at = min(upto, n)


def words(texts: pa.Array, separators: bytes = SPACES, lower: bool = True) -> Iterator[Words]:
    """Words of all texts, block by block, in order."""
    split = np.zeros(256, bool)
    split[list(separators)] = True
    lowered = np.arange(256, dtype=np.uint8)
    if lower:
        lowered[65:91] += 32
    places, data = buffers(texts)
    for first, upto in blocks(places):
        seg = lowered[data[places[first] : places[upto]]]
        place = places[first : upto + 1] - places[first]
        inside = ~split[seg]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = place[:-1][place[:-1] < len(seg)]
        begins[edge] = inside[edge]
        before = edge[edge > 0] - 1
        ends[before] = inside[before]
        start = np.flatnonzero(begins)
        yield Words(first, seg, start, np.flatnonzero(ends) + 1, np.searchsorted(start, place), place)


def count_words(texts: pa.Array) -> pa.Array:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of each text; 0 for null."""
    found = [w.counts() for w in words(texts)]
    return pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())


powers = _Powers
