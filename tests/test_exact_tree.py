"""The exact tree against a recursive one over plain rows, whatever the number of levels grown by DataFrame jobs."""

import random
from fractions import Fraction

import pytest

from tagframe.operators import exact_tree as X

COLS = ["a", "b", "c"]


def plain_tree(rows):
    """Exact fractions, one row at a time; ``rows`` (vector, class)."""
    ones = sum(y for _, y in rows)
    best = None
    if 0 < ones < len(rows):
        for f in range(len(COLS)):
            values = sorted({x[f] for x, _ in rows})
            for lo, hi in zip(values, values[1:]):
                parts = [[y for x, y in rows if x[f] <= lo], [y for x, y in rows if x[f] > lo]]
                score = sum(Fraction(sum(p) ** 2 + (len(p) - sum(p)) ** 2, len(p)) for p in parts)
                if best is None or score > best[0]:
                    best = (score, f, Fraction(lo + hi, 2))
    if best is None:
        return lambda x: int(2 * ones > len(rows))
    _, f, at = best
    low, high = plain_tree([r for r in rows if r[0][f] <= at]), plain_tree([r for r in rows if r[0][f] > at])
    return lambda x: low(x) if x[f] <= at else high(x)


@pytest.mark.parametrize("local", [20_000, 25, 3])
def test_tree_equals_a_plain_one(spark, local):
    rnd = random.Random(9)
    train = [(tuple(rnd.randint(0, 8) for _ in COLS), rnd.randint(0, 1)) for _ in range(300)]
    train += [((1, 1, 1), 0)] * 150  # one vector holds a third of all rows
    test = [tuple(rnd.randint(-1, 10) for _ in COLS) for _ in range(200)] + [(1, 1, 1)] * 3
    tdf = spark.createDataFrame([(*x, y) for x, y in train], "a long, b long, c long, label_binary int")
    qdf = spark.createDataFrame([(i, *x, 1) for i, x in enumerate(test)], "doc_id long, a long, b long, c long, label_binary int")
    got = {r.doc_id: r.prediction for r in X.tree_predict(tdf, qdf, COLS, local=local).collect()}
    want = plain_tree(train)
    assert got == {i: want(x) for i, x in enumerate(test)}


def test_a_tree_deeper_than_thirty_levels(spark):
    """Alternating classes along one feature: a chain that a depth limit would cut."""
    n = 120
    rows = [(i, i, 0, 0, i % 2) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, a long, b long, c long, label_binary int")
    got = X.tree_predict(df, df, COLS).collect()
    assert len(got) == n and all(r.prediction == r.label_binary for r in got)


def test_odd_training_sets(spark):
    kind = "doc_id long, a long, b long, c long, label_binary int"
    none = spark.createDataFrame([], kind)
    some = spark.createDataFrame([(1, 0, 0, 0, 1), (2, 0, 0, 0, 1), (3, 5, 0, 0, 1)], kind)
    tie = spark.createDataFrame([(1, 0, 0, 0, 1), (2, 0, 0, 0, 0)], kind)
    assert [r.prediction for r in X.tree_predict(some, some, COLS).collect()] == [1, 1, 1]
    assert {r.prediction for r in X.tree_predict(tie, some, COLS).collect()} == {0}
    assert X.tree_predict(some, none, COLS).count() == 0
    assert {r.prediction for r in X.tree_predict(none, some, COLS).collect()} == {0}
