"""Sets of word shingles, and the rule by which two sets link."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from quillon.llm.bytescan import NOT_SPACE, U, mix, runs, scan


class Rule(NamedTuple):
    """Links at intersection / union >= num / den over shingles of so many words."""

    words: int
    num: int
    den: int

    def need(self, total):
        """The least overlap of two sets whose sizes come to total."""
        return -(-self.num * total // (self.den + self.num))

    def tiles(self, largest: int) -> tuple[np.ndarray, np.ndarray]:
        """Where bands begin, up to one beyond the largest size, and D of the tile that begins with each band."""
        starts = [1]
        while starts[-1] <= largest:
            starts.append(max(starts[-1] + 1, self.den * (starts[-1] - 1) // self.num + 1))
        most = []
        for low, high in zip(starts, [*starts[1:], starts[-1] + 1], strict=True):
            top = high - 1 + self.den * (high - 1) // self.num
            totals = np.arange(max(2 * low, top - 2 * (self.den + self.num)), top + 1)  # D grows with the total, but for rounding
            most.append(int((totals - 2 * self.need(totals)).max()))
        return np.array(starts), np.array(most)


class Sets(NamedTuple):
    shingles: np.ndarray
    at: np.ndarray  # set i: at[i] to at[i + 1], sorted
    high: np.ndarray  # two sums of hashes tell sets apart
    low: np.ndarray


def sets_of(column: pa.Array, words: int) -> Sets:
    """The set of each text: distinct shingles, or the whole sequence if there are fewer words, or nothing."""
    w = scan(column, NOT_SPACE)
    count = np.diff(w.at)
    first = np.maximum(0, count - words + 1)
    whole = np.flatnonzero((count > 0) & (first == 0))
    all_runs, out = runs(w.hash, words), []
    short = {int(i): mix(runs(w.hash[w.at[i] : w.at[i + 1]], int(count[i])) ^ U(int(count[i]))) for i in whole}
    for i in range(len(count)):
        out.append(short[i] if i in short else np.unique(all_runs[w.at[i] : w.at[i] + first[i]]))
    sizes = np.array([len(x) for x in out], np.int64)
    shingles = np.concatenate(out) if out else np.zeros(0, U)
    at = np.concatenate([[0], np.cumsum(sizes)])
    sums = lambda x: np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)])
    a, b = sums(mix(shingles)), sums(mix(shingles ^ U(0xD6E8FEB86659FD93)))
    return Sets(shingles, at, a[at[1:]] - a[at[:-1]], b[at[1:]] - b[at[:-1]])
