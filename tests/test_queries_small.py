"""Registered queries against their DuckDB SQL on the smallest driver tables,
plus equivalence of the Python batch tagger and the native tagger."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_mod
from tagframe.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
FAST = ["tag_xml", "tag_tokens", "tag_spans", "tag_inline_cursor", "find_offsets", "tag_xml_searched",
        "merge_adjacent", "merge_wordpiece", "merge_wordpiece_keep", "word_entity_counts", "top_entities",
        "entity_features", "error_tag_counts", "binary_metrics", "roc_curve", "auc", "class_balance",
        "mini_batches", "seeded_shuffle", "parse_entities", "tokenize_pad", "valid_entities", "preview", "error_sample",
        "features_aligned", "random_baseline", "knn_predict", "scoreboard_exact", "roc_curve_logit", "run_records", "clean_entity_counts",
        "epoch_stats", "early_stop", "best_run", "stream_tag_xml", "tag_batched",
        "subword_ids", "subword_batches", "tag_gazetteer"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=lambda t: tuple(str(x) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    df = entry_mod.queries()[name](spark, SF)
    res = con.execute(entry_mod.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["doc_id", "tagged_text", "n_spans"] and df.count() > 0


def test_every_query_has_sql_or_is_model(spark):
    rows_only = set(catalog.REGISTRY) - set(oracle.oracle_sql())
    assert rows_only == {"clf_logreg", "clf_svm", "clf_tree", "model_scoreboard", "text_classifier",
                         "tag_ablation", "sweep", "training_log", "bow_predictions"}
    assert set(oracle.oracle_sql()) <= set(catalog.REGISTRY) <= set(entry_mod.queries())


def test_every_sql_runs_and_names_match(spark, con):
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages",
              "benchmark", "conversations"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    qs = catalog.REGISTRY
    for name, sql in oracle.oracle_sql().items():
        if name == "stream_tag_xml":
            continue  # same SQL as tag_xml, compared above
        res = con.execute(f"SELECT * FROM ({sql}) LIMIT 0")
        dcols = sorted(d[0] for d in res.description)
        assert dcols == sorted(qs[name](spark, SF).columns), name
