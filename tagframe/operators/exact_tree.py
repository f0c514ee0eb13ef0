"""M5: a gini decision tree of unlimited depth with every threshold considered.

Rows collapse to distinct vectors with class counts. A node with more than
``local`` distinct vectors is split by DataFrame jobs, all such nodes of a level
together: counts by (node, feature, value), running sums over the values of a
feature, the best threshold of each node, children by comparing the rows with it.
A smaller node's whole subtree is grown in one task. The vectors to be predicted
travel with the training vectors, so no tree is ever collected.

A node is a leaf if it is pure or its vectors are all alike. The best split has
the largest ``(l0² + l1²) / l + (r0² + r1²) / r`` over the node's rows (least gini
impurity); ties go to the first feature in the given order, then to the smallest
threshold, the middle of two neighbouring values. A leaf predicts its majority, class 0 on a tie.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagframe.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LABEL = "label_binary"
LOCAL = 20_000
DIGITS = 12


def best_split(x: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[int, float] | None:
    """(feature, threshold) of the best split of vectors ``x`` with class counts; None if they are all alike."""
    best, found = -1.0, None
    t0, t1 = int(n0.sum()), int(n1.sum())
    for f in range(x.shape[1]):
        value, at = np.unique(x[:, f], return_inverse=True)
        if len(value) < 2:
            continue
        l0 = np.cumsum(np.bincount(at, n0, len(value)))[:-1]
        l1 = np.cumsum(np.bincount(at, n1, len(value)))[:-1]
        r0, r1 = t0 - l0, t1 - l1
        score = np.round(((l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)) / (t0 + t1), DIGITS)
        i = int(np.argmax(score))
        if score[i] > best:
            best, found = score[i], (f, (value[i] + value[i + 1]) / 2)
    return found


def grow(x: np.ndarray, n0: np.ndarray, n1: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Predictions of the vectors ``asked`` by the tree on ``x``; a stack, so depth is not limited by Python's."""
    out = np.zeros(len(asked), np.int64)
    todo = [(np.arange(len(x)), np.arange(len(asked)))]
    while todo:
        own, q = todo.pop()
        if not len(q):
            continue
        zero, one = n0[own].sum(), n1[own].sum()
        split = best_split(x[own], n0[own], n1[own]) if zero and one else None
        if split is None:
            out[q] = int(one > zero)
            continue
        f, at = split
        low, q_low = x[own, f] <= at, asked[q, f] <= at
        todo += [(own[low], q[q_low]), (own[~low], q[~q_low])]
    return out


def _finish(cols: list[str]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        train, test = rows[~rows["asked"]], rows[rows["asked"]]
        got = grow(train[cols].to_numpy(float), train["n0"].to_numpy(float), train["n1"].to_numpy(float), test[cols].to_numpy(float))
        return test[cols].assign(prediction=got.astype("int32"))
    return run


def _level(rows: DataFrame, large: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of the large nodes with their child's number as ``node``."""
    own = rows.join(large, "node", "left_semi")
    values = own.where(~F.col("asked")).select("node", "n0", "n1", F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])))
    sums = values.groupBy("node", F.col("pos").alias("f"), F.col("col").alias("v")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    w = Window.partitionBy("node", "f").orderBy("v")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("node", "f")
    t = sums.select("node", "f", "v", F.lead("v").over(w).alias("next"),
                    *[F.sum(c).over(upto).cast("double").alias(f"l{c}") for c in ("n0", "n1")],
                    *[F.sum(c).over(all_).cast("double").alias(f"t{c}") for c in ("n0", "n1")]).where("next is not null")
    l0, l1, r0, r1 = F.col("ln0"), F.col("ln1"), F.col("tn0") - F.col("ln0"), F.col("tn1") - F.col("ln1")
    score = F.round(((l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)) / (l0 + l1 + r0 + r1), DIGITS)
    split = t.groupBy("node").agg(F.min(F.struct((-score).alias("s"), F.col("f"), F.col("v"), F.col("next"))).alias("best"))
    split = split.select("node", F.col("best.f").alias("f"), ((F.col("best.v") + F.col("best.next")) / 2).alias("at"))
    value = F.element_at(F.array(*[F.col(c).cast("double") for c in cols]), F.col("f") + 1)
    return own.join(split, "node").withColumn("node", F.concat("node", F.when(value <= F.col("at"), F.lit("0")).otherwise(F.lit("1")))) \
              .select(*rows.columns)


def tree_votes(train: DataFrame, test: DataFrame, cols, local: int = LOCAL) -> DataFrame:
    """``(*cols, prediction)`` of every distinct vector of ``test``; without training rows class 0."""
    cols = list(cols)
    none = F.lit(0).cast("long")
    mine = train.groupBy(*cols).agg(F.sum((F.col(LABEL) == 0).cast("long")).alias("n0"), F.sum((F.col(LABEL) == 1).cast("long")).alias("n1"))
    rows = mine.withColumn("asked", F.lit(False)).unionByName(
        test.select(*cols).distinct().withColumns({"n0": none, "n1": none, "asked": F.lit(True)}))
    rows = stored(rows.withColumn("node", F.lit("")), "tree_rows")
    done = None
    while True:
        sizes = rows.where(~F.col("asked")).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        large = sizes.where((F.col("n") > local) & (F.col("n0") > 0) & (F.col("n1") > 0)).select("node")
        if large.isEmpty():
            break
        small = rows.join(large, "node", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = stored(_level(rows, large, cols), "tree_level")
    rows = rows if done is None else done.unionByName(rows)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    # a pure node needs no tree, however many vectors it has: its rows predict by its class alone
    one = F.max(F.when(~F.col("asked"), F.col("n1"))).over(Window.partitionBy("node"))
    zero = F.max(F.when(~F.col("asked"), F.col("n0"))).over(Window.partitionBy("node"))
    pure = rows.withColumns({"has1": one, "has0": zero}) if done is not None else rows.withColumns({"has1": F.lit(1), "has0": F.lit(1)})
    mixed = (F.coalesce("has1", none) > 0) & (F.coalesce("has0", none) > 0)
    grown = pure.where(mixed).groupBy("node").applyInPandas(_finish(cols), ", ".join(f"{c} {kinds[c]}" for c in cols) + ", prediction int")
    plain = pure.where(~mixed & F.col("asked")).select(*cols, (F.coalesce("has1", none) > 0).cast("int").alias("prediction"))
    return grown.unionByName(plain)


def tree_predict(train: DataFrame, test: DataFrame, cols, key: str = "doc_id", local: int = LOCAL) -> DataFrame:
    """``(key, label, prediction)`` of every row of ``test``; equal vectors share one prediction."""
    test = stored(test.select(key, LABEL, *cols), "tree_test")
    return test.join(tree_votes(train, test, cols, local), list(cols)).select(key, LABEL, "prediction")
