"""Anchors of fixed-length windows over a sequence, in numpy.

A window is ``length`` consecutive units of one document. Its anchor is the
gram of ``gram`` units in it with the smallest hash, the leftmost of equal
ones. Equal windows have equal anchors at equal places, so windows can be
compared within the group of their anchor's hash. Neighbouring windows mostly
have the same anchor; a *run* is a maximal range of starts with one anchor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from playtally.llm.shared import mix

# Odd, hence invertible modulo 2^64.
_BASE = 0xA0761D6478BD642F
_POSITION_BITS = 26


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


class Sums:
    """Hash of any stretch of a sequence in constant time."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        self.back = _powers(pow(_BASE, -1, 1 << 64), n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(units * _powers(_BASE, n + 1)[:n], out=self.total[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.total[stop] - self.total[start]) * self.back[start]

    def all(self, length: int) -> np.ndarray:
        """Hashes of all stretches of ``length``, by start."""
        n = len(self.total) - length
        return (self.total[length:] - self.total[:n]) * self.back[:n]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, values.max(), values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


@dataclass
class Runs:
    """Runs of window starts: document, range of starts within it, anchor's hash, hash of the span."""

    doc: np.ndarray
    low: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    span: np.ndarray
    first: np.ndarray  # low as a place in the whole array
    offset: np.ndarray  # of the anchor from the first start


def runs(units: np.ndarray, ends: np.ndarray, length: int, gram: int, sums: Sums | None = None) -> Runs:
    """Runs of all windows of the documents that lie end to end in ``units``."""
    n = len(units)
    if n >= 1 << _POSITION_BITS:
        raise ValueError("too many units in one slice")
    lens = np.diff(ends)
    have = np.flatnonzero(lens >= length)
    if not len(have):
        empty, hashes = np.empty(0, np.int64), np.empty(0, np.uint64)
        return Runs(empty, empty, empty, hashes, hashes, empty, empty)
    sums = sums or Sums(units)
    grams = mix(sums.all(gram))
    place = np.uint64((1 << _POSITION_BITS) - 1)
    anchors = sliding_min((grams & ~place) | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & place
    anchors = anchors.astype(np.int64)
    edge = np.zeros(len(anchors) + 1, np.int8)
    edge[ends[have]] = 1
    edge[ends[have] + lens[have] - length + 1] = -1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    changed = np.ones(len(anchors) + 1, bool)
    changed[1:-1] = (anchors[1:] != anchors[:-1]) | (inside[1:] != inside[:-1])
    bounds = np.flatnonzero(changed)
    first, last = bounds[:-1], bounds[1:] - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    doc = np.searchsorted(ends, first, "right") - 1
    offset = anchors[first] - first
    shape = (offset.astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64)
    span = mix(sums(first, last + length) ^ mix(shape + np.uint64(1)))
    return Runs(doc, first - ends[doc], last - first + 1, grams[anchors[first]], span, first, offset)
