"""Operator 11: hard-negative mining by slot-decomposed selection.

Every anchor has positives (the best rows of its own label); every positive asks
for the best rows of other labels whose score lies in a window that ends at the
positive's own score. The windows of an anchor overlap. Their upper limits split
the scores into disjoint slots: slot ``j`` holds the scores at most the ``j``-th
largest upper limit and above the next one. Combiners keep the first ``k`` rows of
each slot, in the task and again over all tasks. A window then is a run of
whole slots from its own downwards, cut at its lower limit: the slots' rows,
merged in descending order from the window's slot on, begin with its answer.

Rows and anchors meet in cells (anchor block, row block): rows are dealt into
blocks by their key's hash and packed to matrices, anchor blocks are replicated to
the row blocks and row blocks to the anchor blocks, and a cell is one matrix
product, a few hundred anchors at a time. The anchors are the stated query set.

Defined results: rows with a null key, label or vector, or a null or non-finite
component take no part; of rows that repeat a key one takes part, the least by
(label, vector); equal scores rank by the smaller key, so ties are whole; vectors
of different lengths are compared as if the shorter ended in zeros; scores are
exact and, beyond the range of a long, end at its ends; anchors without positives
and positives without negatives give no rows; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagframe.llm.common import documents, store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 5
ROW_BLOCK, ANCHOR_BLOCK = 16_384, 8_192
STRIP = 4 << 20  # scores held at a time by a task
LEAST = -(1 << 63)
BLOCK = "row_block int, ids binary, labels binary, vecs binary, width int, wide boolean"


def quantized(vec: Column) -> Column:
    """``floor(256 x)`` of every component, as whole doubles."""
    def whole(x):
        y = x.cast("double") * F.lit(256.0)
        # beyond 2^53 every double is whole, and floor() returns a long
        return F.when(F.abs(y) >= F.lit(9007199254740992.0), y).otherwise(F.floor(y).cast("double"))
    return F.transform(vec, whole)


def usable(rows: DataFrame) -> DataFrame:
    """``(vec_id, label, vec)`` of the rows that take part, one a key, of ``rows(vec_id, label, embedding)``."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    ok = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                     quantized(F.col("embedding")).alias("vec"))


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block's rows as matrices, in key order; of rows that repeat a key the least one."""
    order = sorted(range(len(pdf)), key=lambda i: (pdf["vec_id"].iat[i], pdf["label"].iat[i], tuple(pdf["vec"].iat[i]))) \
        if pdf["vec_id"].duplicated().any() else np.argsort(pdf["vec_id"].to_numpy(), kind="stable")
    pdf = pdf.iloc[order].drop_duplicates("vec_id")
    width = max(len(v) for v in pdf["vec"])
    vecs = np.zeros((len(pdf), width))
    for i, v in enumerate(pdf["vec"]):
        vecs[i, :len(v)] = v
    big = float(np.abs(vecs).max(initial=0.0))
    return pd.DataFrame({"row_block": pdf["row_block"].iloc[:1].to_numpy(), "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()],
                         "labels": [pdf["label"].to_numpy("<i8").tobytes()], "vecs": [vecs.astype("<f8").tobytes()],
                         "width": np.int32(width), "wide": bool(big * big * max(width, 1) >= 2.0 ** 53)})


def packed(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows dealt by their key's hash into ``blocks`` blocks, one row a block."""
    dealt = rows.withColumn("row_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("row_block").applyInPandas(_pack, BLOCK)


def _arrays(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(r["ids"], "<i8")
    width = int(r["width"])
    vecs = np.frombuffer(r["vecs"], "<f8") if width else np.zeros(0)
    return ids, np.frombuffer(r["labels"], "<i8"), vecs.reshape(len(ids), width)


def scores(a: np.ndarray, b: np.ndarray, wide: bool) -> np.ndarray:
    """Exact integer inner products, as long; ``wide`` says that a sum may leave the whole numbers of a double."""
    d = min(a.shape[1], b.shape[1])
    if not wide:
        return (a[:, :d] @ b[:, :d].T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a[:, :d]], object).reshape(len(a), d).dot(
        np.array([[int(x) for x in row] for row in b[:, :d]], object).reshape(len(b), d).T) if d else np.zeros((len(a), len(b)), object)
    return np.array([[min(max(x, LEAST + 1), -LEAST - 1) for x in row] for row in exact], np.int64).reshape(len(a), len(b))


def first_k(score: np.ndarray, open_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` largest scores among the open places; of equal ones the first columns."""
    s = np.where(open_, score, LEAST)
    if s.shape[1] > k:
        edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        above, level = s > edge[:, None], s == edge[:, None]
        room = k - above.sum(axis=1)
        take = above | level & (np.cumsum(level, axis=1) <= room[:, None])
    else:
        take = np.ones(s.shape, bool)
    return np.nonzero(take & open_)


def _strips(a: np.ndarray, n_rows: int):
    step = max(1, STRIP // max(1, n_rows))
    for i in range(0, len(a), step):
        yield slice(i, i + step)


def _positives(k: int):
    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in right.to_dict("records"):
            ids, labels, vecs = _arrays(r)
            for x in left.to_dict("records"):
                own, own_label, a = _arrays(x)
                for part in _strips(a, len(ids)):
                    s = scores(a[part], vecs, bool(r["wide"] or x["wide"]))
                    at, to = first_k(s, (own_label[part, None] == labels) & (own[part, None] != ids), k)
                    out.append(pd.DataFrame({"anchor_id": own[part][at], "row_id": ids[to], "score": s[at, to]}))
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "row_id": [], "score": []}, dtype="int64")
    return cell


def _negatives(k: int):
    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in right.to_dict("records"):
            ids, labels, vecs = _arrays(r)
            for x in left.to_dict("records"):
                own, own_label, a = _arrays(x)
                upper = np.frombuffer(x["uppers"], "<i8").reshape(len(own), -1)
                for part in _strips(a, len(ids)):
                    s = scores(a[part], vecs, bool(r["wide"] or x["wide"]))
                    other = own_label[part, None] != labels
                    u = upper[part]
                    for j in range(u.shape[1]):
                        # the slot's floor: the next upper limit, below the last one nothing
                        low = u[:, j + 1] if j + 1 < u.shape[1] else np.full(len(u), LEAST, np.int64)
                        slot = other & (s <= u[:, j, None]) & (s > low[:, None])
                        at, to = first_k(s, slot, k)
                        out.append(pd.DataFrame({"anchor_id": own[part][at], "slot": np.int32(j), "row_id": ids[to],
                                                 "score": s[at, to]}))
        if not out:
            return pd.DataFrame({"anchor_id": [], "slot": [], "row_id": [], "score": []}).astype(
                {"anchor_id": "int64", "slot": "int32", "row_id": "int64", "score": "int64"})
        return pd.concat(out)
    return cell


def _pack_anchors(n_uppers: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _pack(pdf)
        pdf = pdf.sort_values("vec_id").drop_duplicates("vec_id")
        # absent upper limits close their slots: no score is at most LEAST
        uppers = np.array([list(u)[:n_uppers] + [LEAST] * (n_uppers - len(u)) for u in pdf["uppers"]], "<i8")
        return out.assign(uppers=[uppers.tobytes()])
    return pack


def _cells(anchors: DataFrame, rows: DataFrame, blocks: int, anchor_blocks: int, cell, schema: str) -> DataFrame:
    """Every anchor block with every row block, one group each."""
    a = anchors.withColumnRenamed("row_block", "anchor_block").withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    r = rows.withColumn("anchor_block", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    key = ["anchor_block", "row_block"]
    return a.groupBy(*key).cogroup(r.groupBy(*key)).applyInPandas(cell, schema)


def _ranked(df: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "row_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, k_positives: int = K, k: int = K, percent: int = 80,
         row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """Hard negatives of ``rows(vec_id long, label long, vec array<double> of whole numbers)``.

    ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for each anchor
    and each of its first ``k_positives`` rows of its label, the first ``k`` rows of other labels with
    ``percent * positive_score <= 100 * negative_score <= 100 * positive_score``.
    """
    spark = rows.sparkSession
    rows = store(rows.select("vec_id", "label", "vec"), "vectors")
    n, n_anchors = rows.select(F.count(F.lit(1)), F.count(F.when(is_anchor, 1))).first()
    blocks = max(1, math.ceil(n / row_block), min(spark.sparkContext.defaultParallelism, n // 256))
    anchor_blocks = max(1, math.ceil(n_anchors / anchor_block))
    matrix = store(packed(rows, blocks), "row_blocks")
    # the anchors of a block come from its packed rows' keys, so of repeated keys the same row takes part
    own = rows.where(is_anchor)
    best = _ranked(_cells(packed(own, anchor_blocks), matrix, blocks, anchor_blocks, _positives(k_positives),
                          "anchor_id long, row_id long, score long"), ["anchor_id"], k_positives)
    best = store(best.select("anchor_id", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    limits = best.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score"), asc=False).alias("uppers"))
    asked = own.join(limits, own["vec_id"] == limits["anchor_id"]).drop("anchor_id")
    dealt = asked.withColumn("row_block", F.pmod(F.xxhash64("vec_id"), F.lit(anchor_blocks)).cast("int"))
    asked = dealt.groupBy("row_block").applyInPandas(_pack_anchors(k_positives), BLOCK + ", uppers binary")
    slots = _ranked(_cells(asked, matrix, blocks, anchor_blocks, _negatives(k),
                           "anchor_id long, slot int, row_id long, score long"), ["anchor_id", "slot"], k)
    # at most k_positives slots of k rows, in descending order: a suffix from a window's slot on begins with its answer
    merged = slots.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("slot"), F.col("rank"), F.col("row_id"), F.col("score")))).alias("found"))
    windows = best.join(limits, "anchor_id").withColumn("slot", (F.array_position("uppers", F.col("positive_score")) - 1).cast("int"))
    hits = windows.join(merged, "anchor_id").withColumn("hit", F.slice(F.filter("found", lambda e: (
        e["slot"] >= F.col("slot")) & within(F.col("positive_score"), e["score"], percent)), 1, k))
    return hits.select("anchor_id", "positive_id", F.posexplode("hit").alias("at", "e"), "positive_score").select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.row_id").alias("negative_id"),
        "positive_score", F.col("e.score").alias("negative_score"))


def within(positive: Column, negative: Column, percent: int) -> Column:
    """``percent * positive <= 100 * negative``; decimals, so that no product overflows."""
    return positive.cast("decimal(20,0)") * F.lit(percent).cast("decimal(5,0)") <= \
        negative.cast("decimal(20,0)") * F.lit(100).cast("decimal(5,0)")


def op11_slot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(documents(spark, sf_dir, "embeddings"))
    noisy = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(noisy, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS row_id, b.label,
  list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, row_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, row_id)
QUALIFY row_number() OVER w <= 5
"""
