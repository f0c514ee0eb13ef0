"""The pipeline's stages against brute force on the small tables."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from tagframe.llm import language_spans, queries, toxicity
from tagframe.llm.common import store

from .conftest import SF
from .test_dedup import shingle_set


def test_stages_reject_what_their_operators_decide(spark, small):
    lang_model = language_spans.fit(language_spans.training_rows(small))
    label = {r["doc_id"]: r["r"] for r in small.select("doc_id", language_spans.label(F.col("text"), lang_model).alias("r")).collect()}
    docs, kept = small, {r["doc_id"]: r["text"] for r in small.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "toxicity":
            lm, model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            score = {r[0]: r[1] for r in docs.select("doc_id", toxicity.toxicity(F.col("text"), lm, model)["score"]).collect()}
        out = store(stage(spark, docs, SF), name)
        assert out.columns == small.columns
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language":
            want = {k for k in kept if label[k]["lang"] != "und" and label[k]["score"] >= corpus_pipeline.MAIN_LANGUAGE}
        elif name == "toxicity":
            want = {k for k in kept if score[k] < 0.5}
        elif name == "exact_dedup":
            first = {}
            for k in sorted(kept):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[k]), k)
            want = set(first.values())
        else:
            sets = {k: shingle_set(t, 5) for k, t in kept.items()}
            root = {k: k for k in kept}
            for a in sorted(kept):
                for b in sorted(kept):
                    if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        x, y = root[a], root[b]
                        root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
            want = set(root.values())
        assert set(got) == want, name
        docs, kept = out, got
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(kept)


def test_run_equals_its_stages_and_is_registered(spark):
    rows = queries.QUERIES["pipeline"](spark, SF).collect()
    assert rows and {r["offset"] for r in rows if r["offset"] == 0} == {0}
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_rows_and_empty_tables(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = store(stage(spark, docs, SF), name)
            if name != "packing":
                assert out.columns == docs.columns
                if name == "exact_dedup" and docs is odd:
                    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in out.collect()]
                    assert len(texts) == len(set(texts))
            out.count()
