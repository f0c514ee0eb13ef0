"""Batched tagging with a pluggable per-batch tagger (``mapInPandas``).

The only Python-side operator. The tagger is built once per task, before the
batch loop (a model would be loaded there); texts go to it in mini-batches of
``batch_size``; the key travels with each row so output order is irrelevant,
and every batch is checked to return one entity list per text.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagframe.operators.entities import TOKEN_RULES

# The task closure (tagger factory, rules) travels by value, so Python workers
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUT_SCHEMA = ("doc_id long, tagger string, pos int, entity string, score double, word string, "
              "start int, end int")

Tagger = Callable[[list[str]], list[list[dict]]]


def rule_tagger() -> Tagger:
    """Stand-in model: the native token rules, applied in Python (same output as N1)."""
    rules = [(name, score, re.compile(pat.replace("\\z", "\\Z"))) for name, score, pat in TOKEN_RULES]

    def tag(texts: list[str]) -> list[list[dict]]:
        out = []
        for text in texts:
            ents, start = [], 0
            for i, tok in enumerate(text.split(" ") if text is not None else []):
                for name, score, rx in rules:
                    if rx.search(tok):
                        ents.append({"entity": name, "score": float(score), "index": i + 1, "word": tok,
                                     "start": start, "end": start + len(tok)})
                        break
                start += len(tok) + 1
            out.append(ents)
        return out
    return tag


def tag_batched(docs: DataFrame, make_tagger: Callable[[], Tagger] = rule_tagger, batch_size: int = 8,
                key: str = "doc_id", text: str = "text", tagger_name: str = "A") -> DataFrame:
    """Apply a batch tagger to every document; long-form entity rows out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = make_tagger()  # once per task
        for pdf in batches:
            keys, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            results: list[list[dict]] = []
            for i in range(0, len(texts), batch_size):
                chunk = texts[i:i + batch_size]
                res = tagger(chunk)
                if len(res) != len(chunk):
                    raise ValueError(f"tagger returned {len(res)} lists for {len(chunk)} texts")
                results.extend(res)
            rows = [(k, tagger_name, e["index"] - 1, e["entity"], float(e["score"]), e["word"], e["start"], e["end"])
                    for k, ents in zip(keys, results) for e in ents]
            yield pd.DataFrame(rows, columns=["doc_id", "tagger", "pos", "entity", "score", "word", "start", "end"])

    out = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, OUT_SCHEMA)
    return out.withColumnRenamed("doc_id", key)
