"""Words of many texts at once as numpy arrays: where they are, and 64-bit hashes of them and of runs of them.

Texts are scanned as UTF-8 bytes. A word class is a set of bytes, so it can tell ASCII characters apart and take or
leave all others together. Hashes are polynomials modulo 2^64 over random values of the bytes, mixed at the end.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from quillon.llm.runtime import bytes_and_offsets, slices

SLICE_BYTES = 1 << 19
U = np.uint64
_BASE = 0x9E3779B97F4A7C55
_VALUES = np.random.default_rng(20240917).integers(1, 2**64, 256, U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Everything but space and the control characters from tab to carriage return.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Digits, lower-case letters, and every character beyond ASCII; texts are in lower case by then.
ALPHANUMERIC = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 18))
        bases = (_BASE, pow(_BASE, -1, 2**64))
        made = [np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)]), dtype=U) for b in bases]
        if size > 8 * SLICE_BYTES:  # for one very long text only
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts, A-Z in lower case
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray  # words of text i: at[i] to at[i + 1]
    hash: np.ndarray
    begin: np.ndarray  # where the bytes of each text begin

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def scan(column: pa.Array, word: np.ndarray) -> Words:
    """The words of a text column; null texts have none."""
    raw, offsets = bytes_and_offsets(column)
    data = _LOWER[raw]
    inside = word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[offsets[(offsets < len(data))]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[(ends := offsets[1:])[ends > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_VALUES[data] * power[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U))
    return Words(data, start, end, np.searchsorted(start, offsets), hashes, offsets)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words; run i begins at word i."""
    count = max(0, len(hashes) - n + 1)
    out = np.full(count, U(n * 0x632BE59BD9B4E019 % 2**64), U)
    for k in range(n):
        out = out * U(_BASE) + hashes[k : k + count]
    return mix(out)


def batches(column: pa.Array, most_bytes: int = SLICE_BYTES):
    """Ranges of rows of which the texts come to about most_bytes."""
    return slices(column, most_bytes)


def prefixes(w: Words, k: int) -> np.ndarray:
    """Hashes of the first k bytes of each word that is longer than that; 0 for the others."""
    long = np.flatnonzero(w.end - w.start > k)
    total = np.zeros(len(long), U)
    for j in range(k):
        total = total * U(_BASE) + _VALUES[w.data[w.start[long] + j]]
    out = np.zeros(len(w.start), U)
    out[long] = mix(total ^ U(0xA5A5A5A5A5A5A5A5)) | U(1)
    return out
