"""Sequential word search in one text (T2, T3): Arrow functions over (text, words, labels).

The searches are inherently ordered and stop at the first match, which neither a
join nor a fold over SQL string functions does in linear time. They stay in the
document's row; spans carry code-point and UTF-8 byte offsets.
"""

from __future__ import annotations

import bisect
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from tagframe.operators import entities as E

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPANS = "array<struct<start:int,pos:int,end:int,entity:string,bstart:int,bend:int>>"


def cursor_matches(text: str, words: list[str], labels: list[str]) -> list[tuple[int, int, str]]:
    """In list order, the first exact occurrence that begins at or after the last match's end."""
    out, at = [], 0
    for word, label in zip(words, labels):
        found = text.find(word, at)
        if found >= 0:
            at = found + len(word)
            out.append((found, at, label))
    return out


def free_matches(text: str, words: list[str], labels: list[str]) -> list[tuple[int, int, str]]:
    """In list order, the first occurrence in any case, if no accepted span touches it.

    Accepted spans are kept in order of their start, so a clash is a neighbour's.
    A repeated word finds the same place again and is rejected.
    """
    out, begins, ends, first = [], [], [], {}
    for word, label in zip(words, labels):
        if word not in first:
            m = re.compile(re.escape(word), re.IGNORECASE).search(text)
            first[word] = m.span() if m else None
        if first[word] is None:
            continue
        a, z = first[word]
        i = bisect.bisect_left(begins, a)
        if (i and ends[i - 1] > a) or (i < len(begins) and begins[i] < z):
            continue
        begins.insert(i, a)
        ends.insert(i, z)
        out.append((a, z, label.lower()))
    return out


def _run(find):
    def udf(texts: pa.Array, words: pa.Array, labels: pa.Array) -> pa.Array:
        out = []
        for text, w, lab in zip(texts.to_pylist(), words.to_pylist(), labels.to_pylist()):
            spans = [] if text is None or not w else find(text, w, lab)
            size, at, made = 0, 0, {}
            for a, z, _ in sorted(spans):  # byte offsets by one walk
                begin = size + len(text[at:a].encode())
                size, at = begin + len(text[a:z].encode()), z
                made[a] = (begin, size)
            out.append([{"start": a, "pos": i, "end": z, "entity": e, "bstart": made[a][0], "bend": made[a][1]}
                        for i, (a, z, e) in enumerate(spans)])
        kind = pa.struct([(c, pa.string() if c == "entity" else pa.int32())
                          for c in ("start", "pos", "end", "entity", "bstart", "bend")])
        return pa.array(out, pa.list_(kind))
    return udf


def _searched(text: Column, entities: Column, find) -> Column:
    usable = F.filter(entities, lambda e: E.has_word({"word": e["word"], "entity": e["entity"]}))
    return F.arrow_udf(_run(find), SPANS, F.ArrowUDFType.SCALAR)(
        text, F.transform(usable, lambda e: e["word"]), F.transform(usable, lambda e: e["entity"]))


def by_cursor(text: Column, entities: Column) -> Column:
    """T2 search of an entity array ``(word, entity)``."""
    return _searched(text, entities, cursor_matches)


def anywhere(text: Column, entities: Column) -> Column:
    """T3 search of an entity array ``(word, entity)``; spans in the order of the list."""
    return _searched(text, entities, free_matches)
