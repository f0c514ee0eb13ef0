"""Vectorised byte-level text kernels, run inside Spark tasks on Arrow buffers."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from tagframe.llm.common import ragged, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MULT = 0x9E3779B97F4A7C15


def space_table() -> np.ndarray:
    """True for ``[\\x20\\x09-\\x0D]``."""
    t = np.zeros(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = True
    return t


def lower_table() -> np.ndarray:
    """A-Z to a-z, every other byte to itself."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True that do not cross a text's edge: (starts, ends, index of the text)."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offs[(offs > 0) & (offs < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    if len(x) < 2:
        return x
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    have = worker_cache("powers", lambda: [np.ones(1, np.uint64)])
    if len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have[0] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, MULT, np.uint64))])
    return have[0]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
    """64-bit hash of every (non-empty) span of bytes; about ``chunk`` bytes are worked on at a time."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + chunk, "right")))
        n = ends[i:j] - starts[i:j]
        first = np.cumsum(n) - n
        at = ragged(starts[i:j], n)
        inner = np.arange(len(at)) - np.repeat(first, n)
        value = (buf[at].astype(np.uint64) + np.uint64(0x1F3)) * _powers(int(n.max()))[inner]
        out[i:j] = np.add.reduceat(value, first) + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix64(out)


def per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by text."""
    return np.bincount(owner, weights=values, minlength=n)[:n]
