"""M3: a support vector machine with an RBF kernel, solved in its dual by decomposition.

Rows collapse to distinct (vector, class) pairs; ``n`` equal rows are one dual
variable in ``[0, C n]``. Training and test vectors are one table that carries
``f``, the sum of ``a_i y_i K(x_i, x)`` over the support vectors so far. A round
takes the ``width`` variables that violate the optimality conditions most (half of
them from either side), solves the dual over them alone by sequential minimal
optimisation, and one map over the table adds what they changed to every ``f``.
The worst pair is always among them, so the rounds end at the optimum of the whole
dual. The driver holds ``width`` vectors, however many rows or support vectors there
are: the kernel matrix is never built, and no task holds a group.

The conditions hold within ``tol`` (largest violation of a pair). A training set
without rows predicts class 0, one of a single class predicts that class; a
decision value of 0 is class 0.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagframe.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LABEL = "label_binary"
WIDTH = 1024
TOL = 1e-3
SLICE = 4096  # rows whose kernel values against the working set are held at a time
EPS = 1e-12


def rbf(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] + (z * z).sum(1)[None, :] - 2.0 * (x @ z.T)
    return np.exp(-gamma * np.maximum(d2, 0.0))


def solve(k: np.ndarray, y: np.ndarray, box: np.ndarray, alpha: np.ndarray, f: np.ndarray, tol: float) -> np.ndarray:
    """The dual over a working set: ``alpha`` after moving pairs until none violates by ``tol``; ``sum(alpha * y)`` stays."""
    alpha, gap = alpha.copy(), y - f
    own = np.diag(k)
    while True:
        up = np.where((y > 0) & (alpha < box) | (y < 0) & (alpha > 0), gap, -np.inf)
        low = np.where((y > 0) & (alpha > 0) | (y < 0) & (alpha < box), gap, np.inf)
        i = int(np.argmax(up))
        if up[i] - low.min() < tol:
            return alpha
        # of the variables that violate together with i, the one whose step gains most
        curve = np.maximum(own[i] + own - 2.0 * k[i], EPS)
        ahead = up[i] - low
        j = int(np.argmax(np.where(ahead > 0, ahead * ahead / curve, -np.inf)))
        room_i = box[i] - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else box[j] - alpha[j]
        step = min(ahead[j] / curve[j], room_i, room_j)
        alpha[i] = box[i] if y[i] > 0 and step == room_i else 0.0 if y[i] < 0 and step == room_i else alpha[i] + y[i] * step
        alpha[j] = 0.0 if y[j] > 0 and step == room_j else box[j] if y[j] < 0 and step == room_j else alpha[j] - y[j] * step
        gap = gap - step * (k[i] - k[j])


def _advance(cols: list[str], x: np.ndarray, coef: np.ndarray, changed: dict[str, float], gamma: float):
    """One map over the table: the working set's new variables, and its part of every ``f``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            points = rows[cols].to_numpy(float)
            more = np.concatenate([rbf(points[a:a + SLICE], x, gamma) @ coef for a in range(0, len(points), SLICE)] or [np.zeros(0)])
            rows["f"] += more
            rows["alpha"] = [changed.get(i, a) for i, a in zip(rows["id"], rows["alpha"])]
            yield rows
    return run


def _sides(state: DataFrame, width: int):
    """The training rows whose variable may rise with their class's sign, worst first, and those whose may fall."""
    train = state.where(F.col("y") != 0).withColumn("gap", F.col("y") - F.col("f"))
    free_up, free_down = F.col("alpha") < F.col("box"), F.col("alpha") > 0
    up = train.where(F.when(F.col("y") > 0, free_up).otherwise(free_down)).orderBy(F.desc("gap"), "id").limit(width // 2)
    low = train.where(F.when(F.col("y") > 0, free_down).otherwise(free_up)).orderBy("gap", "id").limit(width // 2)
    return up.collect(), low.collect()


def decision(train: DataFrame, test: DataFrame, cols, gamma: float, c: float = 1.0, width: int = WIDTH,
             tol: float = TOL) -> DataFrame:
    """``(*cols, decision)`` of every distinct vector of ``test``; vectors without nulls."""
    cols = list(cols)
    doubles = [F.col(n).cast("double").alias(n) for n in cols]
    sign = F.when(F.col(LABEL) == 1, F.lit(1)).otherwise(F.lit(-1))
    mine = train.where(F.col(LABEL).isNotNull()).select(*doubles, sign.alias("y")).groupBy(*cols, "y") \
        .agg((F.count(F.lit(1)) * F.lit(float(c))).alias("box"))
    asked = test.select(*doubles).distinct().withColumns({"y": F.lit(0), "box": F.lit(0.0)})
    name = F.concat_ws(",", *[F.col(n).cast("string") for n in cols], F.col("y").cast("string"))
    state = stored(mine.unionByName(asked).withColumns({"id": name, "alpha": F.lit(0.0), "f": F.lit(0.0)}), "svm_rows")
    while True:
        up, low = _sides(state, width)
        if not up or not low or up[0]["gap"] - low[0]["gap"] < tol:
            break
        rows = list({r["id"]: r for r in [*up, *low]}.values())
        x = np.array([[r[n] for n in cols] for r in rows], float)
        y, box, old, f = (np.array([r[n] for r in rows], float) for n in ("y", "box", "alpha", "f"))
        new = solve(rbf(x, x, gamma), y, box, old, f, tol / 2)
        moved = new != old
        changed = dict(zip([r["id"] for r in rows], new.tolist()))
        state = stored(state.mapInPandas(_advance(cols, x[moved], ((new - old) * y)[moved], changed, gamma), state.schema), "svm_round")
    # the threshold: the mean over variables inside their box, else the middle between the two sides
    inside = state.where((F.col("y") != 0) & (F.col("alpha") > 0) & (F.col("alpha") < F.col("box"))) \
        .agg(F.avg(F.col("y") - F.col("f"))).first()[0]
    if inside is not None:
        b = inside
    elif up and low:
        b = (up[0]["gap"] + low[0]["gap"]) / 2
    else:
        b = 1.0 if up else -1.0  # one class, or no row at all
    return state.where(F.col("y") == 0).select(*cols, (F.col("f") + F.lit(float(b))).alias("decision"))


def svm_predict(train: DataFrame, test: DataFrame, cols, gamma: float, key: str = "doc_id", **params) -> DataFrame:
    """``(key, label, prediction)`` of every row of ``test``; class 1 where the decision value is above 0."""
    cols = list(cols)
    test = stored(test.select(key, LABEL, *cols), "svm_test")
    values = decision(train, test, cols, gamma, **params).select(
        *[F.col(n).alias(f"_{n}") for n in cols], (F.col("decision") > 0).cast("int").alias("prediction"))
    same = [F.col(n).cast("double") == F.col(f"_{n}") for n in cols]
    return test.join(values, same).select(key, LABEL, "prediction")
