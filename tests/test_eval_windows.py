"""Golden cases for metrics (E1-E4), grid/best/early stop (J6, W5, W6), logs."""

import math

import pytest
from pyspark.sql import functions as F

from tagframe.operators import evaluate as V
from tagframe.operators import windows as W

# Confusion matrices recovered from the published test metrics (2,296 rows).
PUBLISHED = {
    "transformer_untagged": ((616, 363, 357, 960), (0.6864, 0.6311, 0.6292, 0.6331)),
    "transformer_tagged": ((652, 389, 321, 934), (0.6908, 0.6475, 0.6263, 0.6701)),
    "bow_untagged": ((584, 368, 389, 955), (0.6703, 0.6068, 0.6134, 0.6002)),
    "bow_tagged": ((571, 381, 402, 942), (0.6590, 0.5932, 0.5998, 0.5868)),
}


# File name pattern and header of one sweep result.
RESULT_FILES = "result_exp_*.csv"


def _preds_from_counts(spark):
    rows = []
    for run, ((tp, fp, fn, tn), _) in PUBLISHED.items():
        rows += [(run, 1, 1)] * tp + [(run, 0, 1)] * fp + [(run, 1, 0)] * fn + [(run, 0, 0)] * tn
    return spark.createDataFrame(rows, "run string, label_binary int, prediction int")


def test_binary_metrics_reproduce_published(spark):
    got = {r.run: r for r in V.binary_metrics(_preds_from_counts(spark)).collect()}
    for run, (_, (acc, f1, prec, rec)) in PUBLISHED.items():
        r = got[run]
        assert round(r.accuracy, 4) == acc and round(r.f1, 4) == f1
        assert round(r.precision, 4) == prec and round(r.recall, 4) == rec
        assert r.tp + r.fp + r.fn + r.tn == 2296


def test_weighted_recall_is_accuracy_and_zero_precision(spark):
    p = _preds_from_counts(spark)
    for r in V.weighted_metrics(p).collect():
        assert abs(r.w_recall - r.accuracy) < 1e-9
    # no positive predictions: precision undefined → 0
    q = spark.createDataFrame([("r", 1, 0), ("r", 0, 0)], "run string, label_binary int, prediction int")
    m = V.binary_metrics(q).first()
    assert m.precision == 0.0 and m.f1 == 0.0 and m.accuracy == 0.5


def test_confusion_matrix_zero_fill(spark):
    q = spark.createDataFrame([("r", 1, 0)] * 4 + [("r", 0, 0)] * 6, "run string, label_binary int, prediction int")
    got = {r.outcome: r.n for r in V.confusion_matrix(q, spark).collect()}
    assert got == {"TP": 0, "FP": 0, "FN": 4, "TN": 6}


def test_roc_auc_against_brute_force(spark):
    import random
    rnd = random.Random(3)
    rows = [("r", rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "run string, label_binary int, confidence double")
    got = V.auc(V.roc_curve(df, buckets=7)).first().auc
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-6
    pts = V.roc_curve(df, buckets=7).orderBy(F.desc("score")).collect()
    assert pts[-1].tp == len(pos) and pts[-1].fp == len(neg)


def test_config_grid(spark):  # fixed values: the grid's lists and numbering
    g = {r.name: (r.epochs, r.batch_size, r.lr) for r in W.config_grid(spark).collect()}
    assert len(g) == 60
    assert g["exp_1"] == (10, 4, 1e-5) and g["exp_28"] == (15, 8, 4e-5) and g["exp_60"] == (20, 64, 4e-5)
    assert W.config_pick(W.config_grid(spark), 60).count() == 0
    assert W.config_pick(W.config_grid(spark), 0).first().name == "exp_1"


# Three published sweep results.
SWEEP = [("exp_41", 0.6974789915966386, 0.6865), ("exp_47", 0.6854, 0.7122333478450152), ("exp_44", 0.2108, 0.5)]


def test_best_run(spark):
    df = spark.createDataFrame(SWEEP, "name string, f1 double, accuracy double")
    assert W.best_run(df, "f1").first().name == "exp_41"
    assert W.best_run(df, "accuracy").first().name == "exp_47"
    tied = spark.createDataFrame([("x", "b", 1.0), ("x", "a", 1.0), ("y", "c", 0.5)], "g string, name string, f1 double")
    assert {(r.g, r.name) for r in W.best_run(tied, "f1", by=("g",)).collect()} == {("x", "a"), ("y", "c")}


def test_ranks_and_batches_do_not_depend_on_the_buckets(spark):
    import hashlib
    df = spark.createDataFrame([(i, "train" if i % 3 else "test") for i in range(700)], "doc_id long, split string")
    order = sorted(range(700), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
    for digits in (1, 2, 4):
        got = {r.doc_id: r.shuffle_rank for r in W.hash_rank(df, digits=digits).collect()}
        assert got == {k: n for n, k in enumerate(order)}
        batches = {}
        for r in W.mini_batches(df, digits=digits).collect():
            batches.setdefault((r.split, r.batch_no), []).append(r.doc_id)
        assert all(len(v) == 8 for (s, b), v in batches.items() if (s, b + 1) in batches)
        test = [k for k in order if not k % 3]
        assert sorted(batches["test", 0]) == sorted(test[:8])


def test_roc_without_exchange_reuse_equals_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    n = 200_000
    y, score = rng.integers(0, 2, n), np.round(rng.random(n), 5)
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({"run": "r", "label_binary": y, "confidence": score}))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        roc = V.roc_curve(df, buckets=16, start=True).toPandas()
        area = V.auc(V.roc_curve(df, buckets=16)).first().auc
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
    values = np.unique(score)[::-1]
    order = np.argsort(-score, kind="stable")
    upto = np.searchsorted(-score[order], -values, "right")
    tp = np.cumsum(y[order])[upto - 1]
    roc = roc.sort_values("score", ascending=False, na_position="first")
    assert roc["tp"].tolist() == [0, *tp] and roc["fp"].tolist() == [0, *(upto - tp)]
    p, q = np.append(0, tp) / y.sum(), np.append(0, upto - tp) / (n - y.sum())
    assert abs(area - ((q[1:] - q[:-1]) * (p[1:] + p[:-1]) / 2).sum()) < 1e-6


def test_early_stop(spark):
    # best at epoch 3 of 10 → stop at 8; steady improvement → final 10
    rows = [("a", e, [0.5, 0.6, 0.7, 0.6, 0.6, 0.6, 0.65, 0.66, 0.6, 0.6][e - 1], 10) for e in range(1, 9)]
    rows += [("b", e, 0.1 * e, 10) for e in range(1, 11)]
    df = spark.createDataFrame(rows, "run string, epoch int, eval_f1 double, max_epochs int")
    got = {r.run: (r.best_epoch, r.final_epoch) for r in W.early_stop(df).collect()}
    assert got == {"a": (3, 8), "b": (10, 10)}


def test_log_events_and_epoch_stats(spark, tmp_path):
    from tagframe.sources import files
    log = tmp_path / "run.out"
    log.write_text("banner line\n"
                   "{'loss': 0.9, 'step_size': 0.5, 'epoch': 1.0}\n"
                   "{'eval_loss': 0.8, 'eval_f1': 0.25, 'epoch': 1.0}\n"
                   "{'loss': 0.7, 'epoch': 2.0}\n"
                   "{'eval_loss': 0.6, 'eval_f1': 0.5, 'epoch': 2.0}\n"
                   "{'seconds': 12.5, 'mean_loss': 0.75, 'epoch': 2.0}\n")
    ev = files.log_metrics(files.read_log_events(spark, str(log), run="r"), ["loss", "eval_loss", "eval_f1"])
    assert ev.count() == 5
    st = {r.epoch: (r.loss, r.eval_loss, r.eval_f1) for r in W.epoch_stats(ev).collect()}
    assert st == {1.0: (0.9, 0.8, 0.25), 2.0: (0.7, 0.6, 0.5)}


def test_csv_quoting_and_sweep_results(spark, tmp_path):
    from tagframe.schemas import SWEEP_RESULT
    from tagframe.sources import files
    p = tmp_path / "raw.csv"
    p.write_text('statement,label\n"He said ""no, never"" today",1\n"plain",0\n')
    rows = files.read_statements(spark, str(p)).collect()
    assert rows[0].statement == 'He said "no, never" today' and rows[0].label == 1
    d = tmp_path / "sweep"
    d.mkdir()
    for i in range(1, 4):
        (d / f"result_exp_{i}.csv").write_text(
            "name,epochs,batch_size,lr,accuracy,f1,precision,recall,best_f1,final_epoch,best_checkpoint\n"
            f"exp_{i},10,4,1e-05,0.6,0.{i},0.5,0.5,0.{i},8.0,ckpt-{i}\n")
    res = files.read_sweep_results(spark, str(d / RESULT_FILES))
    assert res.count() == 3 and W.best_run(res, "f1").first().name == "exp_3"
    assert [f.name for f in res.schema.fields] == [f.name for f in SWEEP_RESULT.fields]


def test_run_record_append(spark, tmp_path):
    from tagframe.sources import files
    m = spark.createDataFrame([("xml", 0.69, 0.65)], "run string, accuracy double, f1 double")
    out = str(tmp_path / "runs")
    files.append_run_record(spark, out, {"epochs": 7, "lr": 3e-5}, m)
    files.append_run_record(spark, out, {"epochs": 7, "lr": 3e-5}, m.withColumn("run", F.lit("noxml")))
    back = spark.read.parquet(out)
    assert back.count() == 2 and set(back.columns) >= {"run", "epochs", "lr", "f1"}


def test_literal_table_melt_and_percent(spark):
    from tagframe.operators import reshape as R
    t = R.literal_table(spark, {"model": ["coin", "line"], "accuracy": [50.25, 60.5],
                                "f1": [40.75, 55.0]})
    long = R.metrics_long(t, ["model"], ["accuracy", "f1"], "metric", "percentage")
    got = {(r.model, r.metric): r.percentage for r in long.collect()}
    assert got == {("coin", "accuracy"): 50.25, ("coin", "f1"): 40.75, ("line", "accuracy"): 60.5, ("line", "f1"): 55.0}
    wide = {r.model: (r.accuracy, r.f1) for r in R.metrics_wide(long, "model", ["accuracy", "f1"], "metric", "percentage").collect()}
    assert wide["line"] == (60.5, 55.0)
    p = R.as_percent(spark.createDataFrame([(0.67034,)], "accuracy double"), ["accuracy"]).first()
    assert p.accuracy == 67.03


def test_write_csv_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F
    from tagframe.sources import files
    df = spark.createDataFrame([(1, "a, \"b\"", [1, 2])], "id int, text string, xs array<int>")
    out = str(tmp_path / "csv")
    files.write_table(df, out, fmt="csv")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(out).first()
    assert back.text == 'a, "b"' and back.xs == "[1,2]"


def test_run_record_is_idempotent(spark, tmp_path):
    from tagframe.sources import files
    m = spark.createDataFrame([("xml", 0.69)], "run string, f1 double")
    out = str(tmp_path / "runs2")
    for _ in range(2):  # a retried write
        files.append_run_record(spark, out, {"epochs": 7}, m)
    files.append_run_record(spark, out, {"epochs": 7}, m.withColumn("run", F.lit("noxml")))
    assert sorted(r.run for r in spark.read.parquet(out).collect()) == ["noxml", "xml"]
