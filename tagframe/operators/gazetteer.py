"""N1 by a name table: every name of a gazetteer found in a text, leftmost first and then longest.

A name occurs where its characters stand and neither the character before nor the
one after is a letter or digit. Of the occurrences the leftmost is taken, of those
that start together the longest, then the search goes on behind it. A name with
several labels has the smallest; null and empty names and null labels take no part.

Names up to ``limit`` bytes go to the tasks as one multi-pattern automaton, built
once a worker: texts are read once, without an exchange. A larger table is never
collected: the pieces of a text that start and end at such places and have a
length that some name has join the names by their text, and a document's matches
are gathered to choose among them. Document keys are distinct.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIMIT = 32 << 20
SLICE = 50_000  # pieces of texts written at a time
MATCH = "pos int, entity string, word string, `start` int, `end` int"


def clean_names(names: DataFrame) -> DataFrame:
    """``(name, label)`` with distinct names."""
    return names.where("name is not null and name <> '' and label is not null").groupBy("name").agg(F.min("label").alias("label"))


def _apart(text: str, a: int, z: int) -> bool:
    return not (a > 0 and text[a - 1].isalnum()) and not (z < len(text) and text[z].isalnum())


def chosen(found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Of ``(start, -length, label, name)``: leftmost, then longest, none overlapping."""
    out, free = [], 0
    for match in sorted(found):
        if match[0] >= free:
            out.append(match)
            free = match[0] - match[1]
    return out


def _rows(keys: list, found: list[list], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    flat = [(k, i, *m) for k, ms in zip(keys, found) for i, m in enumerate(chosen(ms))]
    columns = [pa.array([r[0] for r in flat], kind), pa.array([r[1] for r in flat], pa.int32()),
               pa.array([r[4] for r in flat], pa.string()), pa.array([r[5] for r in flat], pa.string()),
               pa.array([r[2] for r in flat], pa.int32()), pa.array([r[2] - r[3] for r in flat], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _by_automaton(pairs: list[tuple[str, str]], key: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for name, label in pairs:
            automaton.add_word(name, (name, label))
        automaton.make_automaton()
        for batch in batches:
            keys, found = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    keys.append(k)
                    found.append([(z + 1 - len(name), -len(name), label, name) for z, (name, label) in automaton.iter(text)
                                  if _apart(text, z + 1 - len(name), z + 1)])
            yield _rows(keys, found, [key, "pos", "entity", "word", "start", "end"], batch.schema.field(0).type)
    return run


def _pieces(lengths: list[int], key: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(0).type

            def written(part):
                return pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], kind), pa.array([p[1] for p in part], pa.int32()),
                                                   pa.array([p[2] for p in part], pa.string())], names=[key, "start", "name"])

            part = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a in range(len(text or "")):
                    if a and text[a - 1].isalnum():
                        continue
                    part += [(k, a, text[a:a + n]) for n in lengths if a + n <= len(text) and _apart(text, a, a + n)]
                    if len(part) >= SLICE:
                        yield written(part)
                        part = []
            yield written(part)
    return run


def _choose(key: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[(m["start"], -len(m["name"]), m["label"], m["name"]) for m in ms] for ms in batch.column(1).to_pylist()]
            yield _rows(batch.column(0).to_pylist(), found, [key, "pos", "entity", "word", "start", "end"], batch.schema.field(0).type)
    return run


def tag_gazetteer(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``(key, pos, entity, word, start, end)`` of every chosen match of ``names(name, label)``; offsets in code points."""
    names = clean_names(names)
    kind = docs.schema[key].dataType.simpleString()
    size = names.agg(F.sum(F.octet_length("name") + F.octet_length("label"))).first()[0] or 0
    if size <= limit:
        pairs = sorted((r["name"], r["label"]) for r in names.collect())
        if not pairs:
            return docs.sparkSession.createDataFrame([], f"`{key}` {kind}, {MATCH}")
        return docs.select(key, text).mapInArrow(_by_automaton(pairs, key), f"`{key}` {kind}, {MATCH}")
    # the distinct lengths of names: numbers up to the longest name's
    lengths = sorted(r[0] for r in names.select(F.length("name")).distinct().collect())
    pieces = docs.select(key, text).mapInArrow(_pieces(lengths, key), f"`{key}` {kind}, `start` int, name string")
    lists = pieces.join(names, "name").groupBy(key).agg(F.collect_list(F.struct("start", "name", "label")).alias("found"))
    return lists.mapInArrow(_choose(key), f"`{key}` {kind}, {MATCH}")
