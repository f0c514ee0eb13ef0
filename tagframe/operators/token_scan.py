"""The token tagger's scan: one Arrow function over the bytes of a batch of texts.

Token borders, token numbers and offsets are counts over the byte array (spaces
and code points before a place), so the work is linear in the text; only tokens
that a rule may match are looked at one by one, each distinct word once a batch.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE = 2 << 20  # bytes whose counts are held at a time


def _borders(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens between single spaces that begin with A-Z or 0-9 or hold an ``@``: (first byte, end, text, number in the text)."""
    space = np.flatnonzero(buf == 32)
    border = np.zeros(len(buf) + 1, bool)
    border[offs] = border[space + 1] = True
    begins = np.flatnonzero(border[:-1])
    first = buf[begins]
    wanted = (first >= 65) & (first <= 90) | (first >= 48) & (first <= 57)
    mail = np.flatnonzero(buf == 64)
    if len(mail):
        wanted[np.searchsorted(begins, mail, "right") - 1] = True
    starts = begins[wanted]
    text = np.searchsorted(offs, starts, "right") - 1
    before = np.searchsorted(space, starts)
    ends = np.minimum(np.append(space, len(buf))[before], offs[text + 1])
    # a text that ends in a space has an empty last token; the border after it belongs to the next text
    return starts, ends, text, before - np.searchsorted(space, offs[text])


def scanner(rules: tuple[tuple[str, float, str], ...]) -> Callable:
    """``texts -> entity lists`` for rules ``(label, score, pattern)``; a null text has a null list."""
    compiled = [re.compile(pattern.replace("\\z", "\\Z")) for _, _, pattern in rules]

    def rule_of(word: bytes) -> int:
        text = word.decode()
        return next((i for i, rx in enumerate(compiled) if rx.search(text)), -1)

    def scan(texts: pa.Array) -> pa.Array:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        n = len(texts)
        whole = texts.cast(pa.large_string()).fill_null("")
        offs = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset:whole.offset + n + 1] if n else np.zeros(1, np.int64)
        data = whole.buffers()[2] if n else None
        every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        known: dict[bytes, int] = {}
        parts, counts, row = [], np.zeros(n, np.int64), 0
        while row < n:
            last = min(n, max(row + 1, int(np.searchsorted(offs, offs[row] + SLICE, "right")) - 1))
            buf, at = every[offs[row]:offs[last]], offs[row:last + 1] - offs[row]
            starts, ends, text, number = _borders(buf, at)
            raw = buf.tobytes()
            words = [raw[a:z] for a, z in zip(starts.tolist(), ends.tolist())]
            for w in set(words).difference(known):
                known[w] = rule_of(w)
            rule = np.array([known[w] for w in words], np.int64)
            hit = np.flatnonzero(rule >= 0)
            points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            a, z, base = starts[hit], ends[hit], at[text[hit]]
            counts[row:last] += np.bincount(text[hit], minlength=last - row)
            parts.append((number[hit], rule[hit], [words[i] for i in hit.tolist()], points[a] - points[base],
                          points[z] - points[base], a - base, z - base))
            row = last

        def joined(i):
            return pa.array(np.concatenate([p[i] for p in parts]).astype(np.int32) if parts else np.zeros(0, np.int32))

        kind = joined(1)
        words = pa.array([w for p in parts for w in p[2]], pa.binary()).cast(pa.string())
        entity = pa.array([r[0] for r in rules], pa.string()).take(kind)
        score = pa.array([float(r[1]) for r in rules], pa.float64()).take(kind)
        rows = pa.StructArray.from_arrays([joined(0), entity, score, words, joined(3), joined(4), joined(5), joined(6)],
                                          names=["pos", "entity", "score", "word", "start", "end", "bstart", "bend"])
        edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        null = np.append(np.asarray(texts.is_null()), False) if n else np.zeros(1, bool)
        return pa.ListArray.from_arrays(pa.array(edges, mask=null), rows)
    return scan
