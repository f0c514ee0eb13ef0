"""k-NN against brute force; classifiers against independent solutions; sweep and training log by their definitions."""

import random

import numpy as np
from pyspark.sql import functions as F

from tagframe.operators import knn as K
from tagframe.operators import models as M

COLS = ["a", "b"]


def _brute(train, test, k):
    """``train``: (vector..., label); ``test``: (id, vector..., label)."""
    tv = {}
    for *v, y in train:
        n = tv.setdefault(tuple(v), [0, 0])
        n[y] += 1
    out = {}
    for q in {tuple(t[1:-1]) for t in test}:
        order = sorted(tv.items(), key=lambda kv: (sum((x - z) ** 2 for x, z in zip(kv[0], q)), kv[0]))
        left, v0, v1 = k, 0, 0
        for _, (n0, n1) in order:
            take = max(0, min(n0 + n1, left))
            v0 += min(n0, take)
            v1 += take - min(n0, take)
            left -= take
        out[q] = 1 if v1 > v0 else 0
    return out


def test_knn_equals_brute_force(spark):
    rnd = random.Random(11)
    train = [(rnd.randint(0, 9), rnd.choice([0, 0, 1, 30]), rnd.randint(0, 1)) for _ in range(120)]
    test = [(i, rnd.randint(0, 12), rnd.randint(0, 35), rnd.randint(0, 1)) for i in range(40)]
    tr = spark.createDataFrame(train, "a long, b long, label_binary int")
    te = spark.createDataFrame(test, "doc_id long, a long, b long, label_binary int")
    got = {r.doc_id: r.prediction for r in K.knn_predict(tr, te, COLS, k=10).collect()}
    want = _brute(train, test, 10)
    assert got == {i: want[(a, b)] for i, a, b, _ in test}


def test_knn_in_eighteen_dimensions_and_with_few_rows(spark):
    rnd = random.Random(3)
    d = 18
    cols = [f"c{i}" for i in range(d)]
    kind = ", ".join(f"{c} long" for c in cols)
    for n, k in ((90, 10), (4, 10)):
        train = [(*[rnd.choice([0, 0, 0, 1, 2, 25]) for _ in range(d)], rnd.randint(0, 1)) for _ in range(n)]
        test = [(i, *[rnd.choice([0, 0, 1, 3, 30]) for _ in range(d)], 0) for i in range(25)]
        tr = spark.createDataFrame(train, f"{kind}, label_binary int")
        te = spark.createDataFrame(test, f"doc_id long, {kind}, label_binary int")
        got = {r.doc_id: r.prediction for r in K.knn_predict(tr, te, cols, k=k).collect()}
        want = _brute(train, test, k)
        assert got == {t[0]: want[tuple(t[1:-1])] for t in test}


def _points(seed, n=300):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (n, 2))
    y = (x @ [1.0, -0.7] + rng.normal(0, 1.5, n) > 0.8).astype(int)
    return x, y


def test_logistic_regression_equals_newton(spark):
    """Coefficients of the summed loss with a unit L2 penalty, the intercept free."""
    x, y = _points(1)
    df = spark.createDataFrame([(int(a), int(b), int(c)) for (a, b), c in zip(x, y)], "a long, b long, label_binary int")
    model = M.logreg(len(y)).fit(M.assemble(COLS).transform(df))
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(3)
    ridge = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
    assert np.allclose([*model.coefficients.toArray(), model.intercept], w, atol=1e-3)


def test_models_fit_separable_rows(spark):
    rows = [(i, i % 40, (i * 7) % 13, int(i % 40 >= 20)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, a long, b long, label_binary int")
    got = M.fit_count_models(df, df, COLS).toPandas()
    right = (got["prediction"] == got["label_binary"]).groupby(got["model"]).mean()
    assert set(right.index) == set(M.MODELS)
    assert right["tree"] == 1.0 and right["logreg"] > 0.95 and right["svm"] > 0.95 and right["knn"] > 0.95
    board = {r.model: r for r in M.scoreboard(M.fit_count_models(df, df, COLS, models=("tree",))).collect()}
    assert board["tree"].f1 == 1.0 and board["tree"].w_f1 == 1.0


def _statements(spark, n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = rnd.randint(0, 1)
        words = [rnd.choice(["good", "fine"] if y else ["bad", "poor"])] + [rnd.choice("abcdefgh") for _ in range(6)]
        rows.append((i, " ".join(words), y))
    return spark.createDataFrame(rows, "doc_id long, text string, label_binary int")


def test_text_classifier_learns_words(spark):
    got = M.text_classifier(_statements(spark, 120, 1), _statements(spark, 60, 2), "text", "v").toPandas()
    assert (got["prediction"] == got["label_binary"]).all() and got["confidence"].between(0, 1).all()


def test_batch_tagger_with_another_key(spark):
    from tagframe.operators import batch as B
    df = spark.createDataFrame([("k1", "Ann met Bob", 1)], "id string, body string, doc long")
    got = B.tag_batched(df.withColumn("id", F.col("doc")), key="id", text="body").select("id", "word").collect()
    assert [(r.id, r.word) for r in got] == [(1, "Ann"), (1, "Bob")]


def test_knn_prunes_by_pivots_and_splits_dense_rings(spark):
    """Clustered vectors, one dense cluster: exact votes, few pairs met, whatever the pivots and the grid."""
    rng = np.random.default_rng(5)
    d, cols = 18, [f"c{i}" for i in range(18)]
    kind = ", ".join(f"{c} long" for c in cols)
    centres = rng.integers(0, 400, (12, d))
    which = np.where(rng.random(1500) < 0.4, 0, rng.integers(0, 12, 1500))
    points = centres[which] + rng.integers(0, 6, (1500, d))
    train = [(*map(int, p), int(rng.integers(0, 2))) for p in points[:1200]]
    test = [(i, *map(int, p), 0) for i, p in enumerate(points[1200:])]
    tr = spark.createDataFrame(train, f"{kind}, label_binary int")
    te = spark.createDataFrame(test, f"doc_id long, {kind}, label_binary int")
    want = _brute(train, test, 10)
    for pivots, grid in ((64, 4096), (3, 7), (1, 50)):
        votes = K.knn_vector_votes(tr, te, cols, 10, pivots=pivots, grid=grid)
        assert {tuple(r[c] for c in cols): r.prediction for r in votes.collect()} == want
    tv = tr.groupBy(*cols).agg(F.lit(0).cast("long").alias("n0"), F.count("*").alias("n1")).cache()
    centre = K.choose_pivots(tv, cols)
    ringed = K.in_rings(K.in_cells(tv, cols, centre)).cache()
    table = K.ring_table(ringed)
    assert table["vectors"].sum() == tv.count() and table["n"].sum() == len(train)
    queries = te.select(F.col("doc_id").alias("_q"), *[F.col(c).alias(f"q_{c}") for c in cols])
    kth = {t[0]: sorted(sum((x - z) ** 2 for x, z in zip(p[:-1], t[1:-1])) for p in train)[9] for t in test}
    asking = queries.join(spark.createDataFrame(list(kth.items()), "_q long, kth long"), "_q")
    seen = K.probes(queries, cols, centre, table, 10, False).groupBy("ring").count().toPandas()
    more = K.probes(asking, cols, centre, table, 10, True).groupBy("ring").count().toPandas()
    size = dict(zip(table["ring"], table["vectors"]))
    met = sum(size[r] * n for part in (seen, more) for r, n in zip(part["ring"], part["count"]))
    assert met < 0.5 * len(train) * len(test)


def test_knn_without_rows_and_with_equal_vectors(spark):
    te = spark.createDataFrame([(1, 2, 3, 0), (2, 2, 3, 1)], "doc_id long, a long, b long, label_binary int")
    none = te.where("false").select("a", "b", "label_binary")
    assert K.knn_predict(none, te, COLS).count() == 0
    same = spark.createDataFrame([(7, 7, 1)] * 30, "a long, b long, label_binary int")
    assert K.knn_predict(same, te.where("false"), COLS).count() == 0
    assert [r.prediction for r in K.knn_predict(same, te, COLS).collect()] == [1, 1]
