"""Exact memo of byte spans: what a span of a text was turned into before, looked up for whole arrays of spans.

Spans of at most 16 bytes are compared as two words of eight bytes in an open
table of numpy arrays, longer ones as ``bytes`` in a dict, those over ``LONG``
bytes are not kept. The first spans a worker sees, which are the frequent ones,
stay for good up to a bound; beyond it the recent ones are kept in a second
level that starts anew when it is full.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle

from tagframe.llm.common import ragged
from tagframe.llm.kernels import mix64

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONG = 256
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

#: White space of Unicode beyond ASCII, in UTF-8, by its first byte.
_WIDE = {0xC2: re.compile(rb"\xc2[\x85\xa0]"), 0xE1: re.compile(rb"\xe1\x9a\x80"),
         0xE2: re.compile(rb"\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)"), 0xE3: re.compile(rb"\xe3\x80\x80")}


def wide_space(buf: np.ndarray) -> list[tuple[int, int]]:
    """Places (start, end) of white space beyond ASCII."""
    if not len(buf) or buf.max() < 0x80:
        return []
    raw = buf.tobytes()
    return [m.span() for first, pattern in _WIDE.items() if bytes([first]) in raw for m in pattern.finditer(raw)]


def keys(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second eight bytes of spans of at most 16 bytes; ``buf`` has 16 bytes to spare."""
    words = np.ndarray(len(buf) - 7, "<u8", buffer=buf, strides=(1,))
    lo = words[starts] & _MASK[np.minimum(lens, 8)]
    hi = words[starts + 8] & _MASK[np.clip(lens - 8, 0, 8)]
    return lo, hi


class SpanTable:
    """Numbers of distinct short spans, ``0 .. limit - 1`` in order of arrival."""

    def __init__(self, limit: int):
        self.limit, self.n = limit, 0
        self.mask = np.uint64((1 << (2 * limit - 1).bit_length()) - 1)
        self.slot = np.full(int(self.mask) + 1, -1, np.int32)
        self.lo, self.hi = np.zeros(limit, np.uint64), np.zeros(limit, np.uint64)
        self.meta = np.zeros(limit, np.uint16)

    def _home(self, lo, hi, meta) -> np.ndarray:
        return (mix64(lo * np.uint64(0x9E3779B97F4A7C15) ^ mix64(hi + meta.astype(np.uint64))) & self.mask).astype(np.int64)

    def find(self, lo, hi, meta) -> np.ndarray:
        """The number of each span, -1 for unknown ones."""
        out = np.full(len(lo), -1, np.int64)
        if not self.n:
            return out
        live, pos = np.arange(len(lo)), self._home(lo, hi, meta)
        while len(live):
            s = self.slot[pos]
            used = s >= 0
            live, s, pos = live[used], s[used], pos[used]
            same = (self.lo[s] == lo[live]) & (self.hi[s] == hi[live]) & (self.meta[s] == meta[live])
            out[live[same]] = s[same]
            live, pos = live[~same], (pos[~same] + 1) & int(self.mask)
        return out

    def put(self, number, lo, hi, meta) -> None:
        """Distinct new keys into free slots."""
        self.lo[number], self.hi[number], self.meta[number] = lo, hi, meta
        pos = self._home(lo, hi, meta)
        while len(number):
            free = self.slot[pos] < 0
            self.slot[pos[free]] = number[free]
            rest = self.slot[pos] != number
            number, pos = number[rest], (pos[rest] + 1) & int(self.mask)


def distinct_keys(lo: np.ndarray, hi: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys stand together and, in that order, whether a key is the first of its kind."""
    order = np.lexsort((lo, hi, meta))
    head = np.ones(len(order), bool)
    x, y = order[1:], order[:-1]
    head[1:] = (lo[x] != lo[y]) | (hi[x] != hi[y]) | (meta[x] != meta[y])
    return order, head


class _Level(SpanTable):
    """A table with the ids of every span; long spans are in ``long``."""

    def __init__(self, limit: int, dtype):
        super().__init__(limit)
        self.dtype = dtype
        self.at = np.zeros(limit + 1, np.int64)
        self.ids = np.zeros(1 << 16, dtype)
        self.long: dict[bytes, int] = {}

    def add_ids(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Numbers of new entries; their keys are added by ``put`` or in ``long``."""
        used, k = int(self.at[self.n]), len(lens)
        if used + len(ids) > len(self.ids):
            room = np.zeros(max(used + len(ids), len(self.ids) * 3 // 2), self.dtype)
            room[:used] = self.ids[:used]
            self.ids = room
        self.ids[used:used + len(ids)] = ids
        self.at[self.n + 1:self.n + 1 + k] = used + np.cumsum(lens)
        self.n += k
        return np.arange(self.n - k, self.n)


class SpanMemo:
    """``make(spans, kinds)`` turns new distinct spans (``bytes``) into ``(flat ids, ids per span)``."""

    def __init__(self, make: Callable, dtype=np.uint32, keep: int = 400_000, recent: int = 400_000):
        self.make, self.dtype, self.sizes = make, dtype, (keep, recent)
        self.keep, self.recent = _Level(max(keep, 1), dtype), None

    def lookup(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all spans in order and the number of ids of each.

        ``kind`` (0 to 3) tells equal spans in different places apart. ``buf`` ends with 16 spare bytes.
        """
        n = len(starts)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        levels = [self.keep] + ([self.recent] if self.recent is not None else [])
        where, code = np.full(n, -1, np.int8), np.zeros(n, np.int64)
        short = np.flatnonzero(lens <= 16)
        lo, hi = keys(buf, starts[short], lens[short])
        meta = (lens[short] | kind[short].astype(np.int64) << 8).astype(np.uint16)
        left = np.arange(len(short))
        for i, level in enumerate(levels):
            got = level.find(lo[left], hi[left], meta[left])
            hit = got >= 0
            where[short[left[hit]]], code[short[left[hit]]] = i, got[hit]
            left = left[~hit]
        wide = np.flatnonzero(lens > 16)
        raw = {}
        for j in wide.tolist():
            key = bytes([kind[j]]) + buf[starts[j]:starts[j] + lens[j]].tobytes()
            for i, level in enumerate(levels):
                if (c := level.long.get(key)) is not None:
                    where[j], code[j] = i, c
                    break
            else:
                raw.setdefault(key, []).append(j)
        if len(left) or raw:
            levels.append(self._new(buf, starts, lens, kind, lo, hi, meta, short, left, raw, where, code, len(levels)))
        out_lens = np.zeros(n, np.int64)
        masks = [where == i for i in range(len(levels))]
        for level, m in zip(levels, masks):
            out_lens[m] = level.at[code[m] + 1] - level.at[code[m]]
        first = np.cumsum(out_lens) - out_lens
        flat = np.zeros(int(out_lens.sum()), self.dtype)
        for level, m in zip(levels, masks):
            if m.all():
                flat[:] = level.ids[ragged(level.at[code], out_lens)]
            elif m.any():
                flat[ragged(first[m], out_lens[m])] = level.ids[ragged(level.at[code[m]], out_lens[m])]
        return flat, out_lens

    def _new(self, buf, starts, lens, kind, lo, hi, meta, short, left, raw, where, code, number) -> _Level:
        order, head = distinct_keys(lo[left], hi[left], meta[left])
        order = left[order]
        one = order[head]
        text = buf.tobytes()
        at, size = starts[short[one]], lens[short[one]]
        spans = [text[a:a + k] for a, k in zip(at.tolist(), size.tolist())] + [k[1:] for k in raw]
        kinds = np.concatenate([kind[short[one]], np.array([k[0] for k in raw], kind.dtype)]).astype(np.int64)
        ids, n_ids = self.make(spans, kinds.tolist())
        n_new = len(spans)
        if self.recent is None and self.keep.n + n_new <= self.sizes[0]:
            level = self.keep
        elif self.recent is not None and self.recent.n + n_new <= self.recent.limit:
            level = self.recent
        else:
            level = self.recent = _Level(max(self.sizes[1], n_new), self.dtype)
        got = level.add_ids(ids, n_ids)
        level.put(got[:len(one)], lo[one], hi[one], meta[one])
        code[short[order]] = got[np.cumsum(head) - 1]
        where[short[order]] = number
        for (key, places), c in zip(raw.items(), got[len(one):].tolist()):
            if len(key) <= LONG:
                level.long[key] = c
            where[places], code[places] = number, c
        return level
