"""Mini-batch training against a plain replay; the sweep against full refits; a restarted fit."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tagframe.operators import bag_of_words as B
from tagframe.operators import windows as W

SIZE = 1 << 10


def statements(spark, n, seed, noise=0.0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = rnd.randint(0, 1)
        words = [rnd.choice(["good", "fine"] if (y if rnd.random() >= noise else 1 - y) else ["bad", "poor"])]
        rows.append((i, " ".join(words + [rnd.choice("abcdefgh") for _ in range(6)]), y))
    rows += [(n, None, 1), (n + 1, "", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, label_binary int")


def replay(rows, epochs, batch, rate, shards, seed=B.SEED, dropout=B.DROPOUT):
    """Dense weights, one row and one feature after another."""
    w, b = np.zeros(SIZE), 0.0
    losses = []
    for epoch in range(1, epochs + 1):
        order = sorted((hashlib.md5(f"{k}:{seed * 1000 + epoch}".encode()).hexdigest(), k, y, ids) for k, y, ids in rows)
        total, total_b, lost = np.zeros(SIZE), 0.0, 0.0
        for s in range(shards):
            own = [r for r in order if int(r[0][:8], 16) % shards == s]
            v, c = w.copy(), b
            for i in range(0, len(own), batch):
                part, grad, grad_b = own[i:i + batch], np.zeros(SIZE), 0.0
                for _, k, y, ids in part:
                    n = Counter(ids)
                    norm = np.sqrt(sum(x * x for x in n.values()))
                    x = {j: m / norm / (1 - dropout) for j, m in n.items()
                         if B.kept(seed, epoch, np.array([k]), np.array([j]), dropout)[0]}
                    p = 1 / (1 + np.exp(-(sum(v[j] * m for j, m in x.items()) + c)))
                    lost -= np.log(p if y else 1 - p)
                    for j, m in x.items():
                        grad[j] += (p - y) * m / len(part)
                    grad_b += (p - y) / len(part)
                v -= rate * grad
                c -= rate * grad_b
            total += len(own) * v
            total_b += len(own) * c
        w, b = total / len(rows), total_b / len(rows)
        losses.append(lost / len(rows))
    return w, b, losses


@pytest.mark.parametrize("shards", [1, 3])
def test_training_equals_a_replay(spark, shards):
    rows = B.hashed(statements(spark, 60, 1), "text", features=SIZE)
    held = [(r.key, r.label, r.ids) for r in rows.collect()]
    got = []
    for epoch, _, state, losses in B.passes(rows.repartition(5), {8: (0.5, 1.5)}, shards=shards, features=SIZE):
        got.append(losses[8])
        if epoch == 3:
            break
    for i, rate in enumerate((0.5, 1.5)):
        w, b, losses = replay(held, 3, 8, rate, shards)
        assert np.allclose(state[8][0][:, i], w, atol=1e-9) and np.isclose(state[8][1][i], b)
        assert np.allclose([x[i] for x in got], losses)


def test_dropout_keeps_its_share():
    keep = B.kept(1, 2, np.arange(200_000) % 500, np.arange(200_000) // 500, 0.2)
    assert abs(keep.mean() - 0.8) < 0.005
    assert (B.kept(1, 2, np.array([7]), np.array([9]), 0.2) == B.kept(1, 2, np.array([7]), np.array([9]), 0.2)).all()


def test_sweep_equals_single_fits(spark):
    """Sixty configs: each ends as its own full fit with early stopping would, and only the passes up to its end count."""
    train, valid = statements(spark, 80, 1, 0.1), statements(spark, 60, 2, 0.3)
    grid = W.config_grid(spark, epochs=(3, 4, 6), batch_sizes=(4, 8, 16, 32, 64), lrs=(0.1, 0.5, 2.0, 8.0))
    got = {r.name: r for r in B.sweep(train, valid, "text", grid, patience=2, features=SIZE, shards=2).collect()}
    assert len(got) == 60
    for c in grid.where("name in ('exp_1', 'exp_8', 'exp_31', 'exp_60')").collect():
        log = B.training_log(train, valid, "text", c.name, max_epochs=c.epochs, batch_size=c.batch_size, rate=c.lr,
                             features=SIZE, shards=2)
        stop = W.early_stop(log.where("eval_f1 is not null").selectExpr("*", f"{c.epochs} as max_epochs"), patience=2).first()
        r = got[c.name]
        assert (r.best_epoch, r.final_epoch, r.passes) == (stop.best_epoch, stop.final_epoch, stop.final_epoch)
        best = log.where(f"epoch = {stop.best_epoch} and eval_f1 is not null").first()
        assert (r.best_f1, r.accuracy) == (best.eval_f1, best.eval_accuracy)


def test_a_restarted_fit_goes_on_after_its_last_pass(spark, tmp_path, monkeypatch):
    rows = B.hashed(statements(spark, 40, 3), "text", features=SIZE)
    kw = dict(epochs=3, features=SIZE, shards=2)
    whole = B.fit(rows, **kw)
    path = str(tmp_path / "state")
    B.fit(rows, path=path, **{**kw, "epochs": 2})
    ran, run = [], B.one_pass
    monkeypatch.setattr(B, "one_pass", lambda *a: ran.append(a[4]) or run(*a))
    again = B.fit(rows, path=path, **kw)
    assert ran == [3] and np.allclose(again[0], whole[0]) and np.allclose(again[1], whole[1])


def test_log_and_predictions(spark):
    train, valid = statements(spark, 120, 1), statements(spark, 60, 2)
    stats = sorted(W.epoch_stats(B.training_log(train, valid, "text", "r", max_epochs=6, rate=4.0, shards=1)).collect(), key=lambda r: r.epoch)
    assert [r.epoch for r in stats] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    assert stats[0].loss > stats[5].loss and stats[0].eval_loss > stats[5].eval_loss and stats[5].eval_f1 > 0.9
    got = B.predict(B.hashed(valid, "text"), B.fit(B.hashed(train, "text"), epochs=6, rate=4.0, shards=1)).toPandas()
    assert (got["prediction"] == got["label_binary"]).mean() > 0.9 and got["confidence"].between(0, 1).all()


def test_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, label_binary int")
    log = B.training_log(none, none, "text", "r", max_epochs=1, features=SIZE).collect()
    assert len(log) == 2 and log[0].loss is None and log[1].eval_f1 is None
    assert B.predict(B.hashed(none, "text"), B.fit(B.hashed(none, "text"), epochs=1)).count() == 0


def test_batch_sizes_share_the_features_of_a_frame(monkeypatch):
    """Features are worked out once a slice, whatever the batch sizes; each size trains as it would alone."""
    import pandas as pd
    rnd = np.random.default_rng(5)
    rows = pd.DataFrame({"shard": 0, "key": range(100), "label": rnd.integers(0, 2, 100),
                         "ids": [np.sort(rnd.integers(0, 50, rnd.integers(0, 9))) for _ in range(100)]})
    calls, made = [], B.sparse_rows
    monkeypatch.setattr(B, "sparse_rows", lambda ids: calls.append(len(ids)) or made(ids))

    def run(groups, frames):
        state = {b: (np.zeros((SIZE, len(r))), np.zeros(len(r))) for b, r in groups.items()}
        return {r.batch_size: r for r in pd.concat(B._pass(groups, state, 1, 1, 0.2)(iter(frames))).itertuples()}

    both = run({4: (0.5, 1.0), 6: (0.5, 1.0), 64: (2.0,)}, [rows])
    assert calls == [100, 100 % 64]
    for b, rates in ((4, (0.5, 1.0)), (6, (0.5, 1.0)), (64, (2.0,))):
        own = run({b: rates}, [rows.iloc[:37], rows.iloc[37:38], rows.iloc[38:]])[b]
        assert own.n_rows == both[b].n_rows == 100 and np.allclose(own.loss, both[b].loss)
        assert np.allclose(np.frombuffer(own.weights), np.frombuffer(both[b].weights))


def test_every_shard_is_a_task_of_its_own(spark):
    rows = spark.createDataFrame([(i, i % 2, [i % 7]) for i in range(400)], "key long, label int, ids array<int>")
    dealt = B.dealt(rows, 1, 1, 8)
    got = dealt.select("shard", B.F.spark_partition_id().alias("task")).distinct().collect()
    assert len(got) == len({r.task for r in got}) == len({r.shard for r in got}) == 8
