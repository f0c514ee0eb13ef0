"""The SVM's decision values against an independent solution of the same dual over plain rows."""

import numpy as np
import pytest

from tagframe.operators import kernel_svm as K

COLS = ["a", "b", "c"]
SCHEMA = "a long, b long, c long, label_binary int"


def projected_dual(x, y, gamma, c, steps=60_000):
    """The dual over single rows by projected gradient with momentum; the projection finds its multiplier by bisection."""
    k = np.exp(-gamma * ((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    q = k * np.outer(y, y)
    rate = 1.0 / np.linalg.eigvalsh(q).max()

    def project(v):
        lo, hi = -np.abs(v).max() - c - 1, np.abs(v).max() + c + 1
        for _ in range(45):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if y @ np.clip(v - mid * y, 0, c) > 0 else (lo, mid)
        return np.clip(v - (lo + hi) / 2 * y, 0, c)

    a = z = np.zeros(len(y))
    t = 1.0
    for _ in range(steps):
        new = project(z - rate * (q @ z - 1))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - a)
        if np.abs(new - a).max() < 1e-9:
            a = new
            break
        a, t = new, t_new
    f = k @ (a * y)
    inside = (a > 1e-6) & (a < c - 1e-6)
    return a, (y - f)[inside].mean()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 5, (180, 3)).astype(float)
    noisy = x[:, 0] * x[:, 1] - 2 * x[:, 2] + rng.normal(0, 2, 180)
    x = np.concatenate([x, np.tile([[1.0, 1, 1]], (60, 1))])  # one vector holds a quarter of all rows
    return x, np.concatenate([np.where(noisy > 0, 1.0, -1.0), np.tile([1.0, -1, -1], 20)])


@pytest.fixture(scope="module")
def dual(rows):
    return projected_dual(*rows, 0.2, 1.0)


@pytest.mark.parametrize("width", [1024, 16])
def test_decisions_equal_an_independent_dual_solution(spark, rows, dual, width):
    x, y = rows
    gamma = 0.2
    a, b = dual
    asked = np.array([[i, j, k] for i in range(-1, 7, 2) for j in range(0, 6, 2) for k in (0, 3)], float)
    want = np.exp(-gamma * ((asked[:, None, :] - x[None, :, :]) ** 2).sum(2)) @ (a * y) + b
    train = spark.createDataFrame([(*map(int, v), int(c > 0)) for v, c in zip(x, y)], SCHEMA)
    test = spark.createDataFrame([(*map(int, v), 0) for v in asked], SCHEMA)
    got = {(r.a, r.b, r.c): r.decision for r in K.decision(train, test, COLS, gamma, width=width, tol=1e-5).collect()}
    assert len(got) == len(asked)
    assert max(abs(got[tuple(v)] - w) for v, w in zip(asked, want)) < 1e-3


def test_variables_stay_in_their_box_and_balance(rows):
    x, y = rows
    box = np.ones(len(y))
    k = K.rbf(x, x, 0.2)
    alpha = K.solve(k, y, box, np.zeros(len(y)), np.zeros(len(y)), 1e-6)
    assert (alpha >= 0).all() and (alpha <= box).all() and abs(alpha @ y) < 1e-9
    gap = y - k @ (alpha * y)
    up = (y > 0) & (alpha < box) | (y < 0) & (alpha > 0)
    low = (y > 0) & (alpha > 0) | (y < 0) & (alpha < box)
    assert gap[up].max() - gap[low].min() < 1e-5


@pytest.mark.parametrize("labels,answer", [((1, 1), 1), ((0, 0), 0), ((), 0)])
def test_one_class_and_no_rows(spark, labels, answer):
    train = spark.createDataFrame([(i, 0, 0, v) for i, v in enumerate(labels)], SCHEMA)
    test = spark.createDataFrame([(7, 5, 0, 0, 1), (8, 5, 0, 0, 1)], "doc_id long, " + SCHEMA)
    got = K.svm_predict(train, test, COLS, 0.5).collect()
    assert [(r.prediction, r.label_binary) for r in got] == [(answer, 1)] * 2


def test_a_test_table_without_rows(spark):
    train = spark.createDataFrame([(1, 0, 0, 1), (0, 1, 0, 0)], SCHEMA)
    test = spark.createDataFrame([], "doc_id long, " + SCHEMA)
    assert K.svm_predict(train, test, COLS, 0.5).collect() == []
