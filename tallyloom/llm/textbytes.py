"""Words of UTF-8 texts found and hashed with numpy, straight from Arrow buffers.

All word classes used here are bounded by ASCII characters, so that bytes may stand for characters: every byte of a
non-ASCII character is 0x80 or more. Work goes over slices of about ``SLICE`` bytes; one longer text makes a slice of
its own, hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit numbers (the finaliser of the public splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _table(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)])


# Words between white space: [^\x20\x09-\x0D]+
SPACED = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
# Runs of digits, letters a-z and non-ASCII characters: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE + 1)
            inverse = pow(_BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up, self.down = (
                    np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, dtype=np.uint64)), dtype=np.uint64)
                    for b in (_BASE, inverse)
                )
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


@dataclass
class Slice:
    """Consecutive texts as one byte array: text i is ``data[bounds[i]:bounds[i + 1]]``, row ``first + i``."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[Slice]:
    """Cut a string column into slices of about ``limit`` bytes; a NULL counts as an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=column.offset * 8)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        yield Slice(at, data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at])
        at = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return _LOWER[data]


def find_words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and how many words stand before each text (one more entry than texts)."""
    mask = inside[data]
    n = len(data)
    edge = bounds[:-1][bounds[:-1] < n]
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = mask[:-1]
        before[edge] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(n, dtype=bool)
    if n:
        after[-1] = False
        after[:-1] = mask[1:]
        after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random byte values, scrambled."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            end = max(at + 1, int(np.searchsorted(ends, low + SLICE, side="right")))
            part = data[low : ends[end - 1]]
            up, down = _POWERS.get(len(part) + 1)
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
            s, e = starts[at:end] - low, ends[at:end] - low
            out[at:end] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _ODD
            at = end
    return mix64(out)


def chain(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive word hashes, order included; runs may cross texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(size) * _ODD, dtype=np.uint64)
        for k in range(size):
            out = mix64(out * _ODD + hashes[k : k + n])
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as each size."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])
