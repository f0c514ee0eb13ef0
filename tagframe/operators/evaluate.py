"""Binary classification metrics, confusion matrix, ROC and AUC.

One ``groupBy`` computes TP/FP/FN/TN for every run at once; metrics are
column expressions over those four counts. The ROC is exact and distributed:
points are aggregated per distinct score, range-partitioned by score (sampled,
balanced bounds) and stored, range totals give each range's starting offset,
and the running sums are windows within one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagframe.functions import labels as L
from tagframe.session import materialize

METRIC_DIGITS = 9


def _safe_div(a, b):
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def outcome_counts(preds: DataFrame, by=("run",), label: str = "label_binary",
                   prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label), F.col(prediction)
    return preds.groupBy(*by).agg(
        F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"),
        F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
        F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
        F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn"))


def metrics_from_counts(counts: DataFrame, by=("run",), weighted: bool = False) -> DataFrame:
    """Accuracy; precision, recall, F1 of class 1; 0 when undefined. ``weighted`` adds E2's columns."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    prec = _safe_div(tp, tp + fp)
    rec = _safe_div(tp, tp + fn)
    f1 = _safe_div(2 * tp, 2 * tp + fp + fn)
    acc = _safe_div(tp + tn, tp + fp + fn + tn)
    r = METRIC_DIGITS
    return counts.select(*by, "tp", "fp", "fn", "tn", F.round(acc, r).alias("accuracy"),
                         F.round(prec, r).alias("precision"), F.round(rec, r).alias("recall"),
                         F.round(f1, r).alias("f1"), *(_weighted() if weighted else []))


def _weighted() -> list:
    """E2's support-weighted columns from the four counts."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    # class 1: tp/fp/fn; class 0: tn (as tp), fn (as fp), fp (as fn); support1 = tp+fn, support0 = tn+fp
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f1_1, f1_0 = _safe_div(2 * tp, 2 * tp + fp + fn), _safe_div(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    r = METRIC_DIGITS
    return [F.round(_safe_div(p1 * s1 + p0 * s0, n), r).alias("w_precision"),
            F.round(_safe_div(r1 * s1 + r0 * s0, n), r).alias("w_recall"),
            F.round(_safe_div(f1_1 * s1 + f1_0 * s0, n), r).alias("w_f1")]


def binary_metrics(preds: DataFrame, by=("run",), label: str = "label_binary",
                   prediction: str = "prediction") -> DataFrame:
    return metrics_from_counts(outcome_counts(preds, by, label, prediction), by)


def weighted_metrics(preds: DataFrame, by=("run",), label: str = "label_binary",
                     prediction: str = "prediction") -> DataFrame:
    """Support-weighted precision, recall, F1 over the two classes."""
    c = outcome_counts(preds, by, label, prediction)
    return metrics_from_counts(c, by, weighted=True).select(*by, "w_precision", "w_recall", "w_f1", "accuracy")


def confusion_matrix(preds: DataFrame, spark: SparkSession, by=("run",), label: str = "label_binary",
                     prediction: str = "prediction") -> DataFrame:
    """The four cells per group, zero filled."""
    cells = F.array(*[F.struct(F.lit(y).alias(label), F.lit(p).alias(prediction)) for y, p in ((1, 1), (0, 1), (1, 0), (0, 0))])
    counts = preds.groupBy(*by, label, prediction).agg(F.count("*").alias("n"))
    frame = preds.select(*by).distinct().select(*by, F.inline(cells))
    return frame.join(counts, [*by, label, prediction], "left").select(
        *by, label, prediction, L.outcome(label, prediction).alias("outcome"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def roc_curve(preds: DataFrame, score: str = "confidence", by=("run",), label: str = "label_binary",
              buckets: int | None = None, start: bool = False) -> DataFrame:
    """One point per distinct score in descending order: cumulative TP/FP, TPR, FPR.

    Exact for any number of distinct scores and any score distribution: the
    distinct points are range-partitioned by (group, score desc) with Spark's
    sampled range bounds (balanced by construction) and stored with the number of
    their range, so that totals and running sums read the same ranges. Range
    totals are at most ``buckets`` rows per group; their running sum gives each
    range's starting offset. With ``start`` every group also has its (0, 0)
    point, whose score is null.
    """
    by = list(by)
    spark = preds.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    pts = preds.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("dtp"),
        F.sum((F.col(label) == 0).cast("long")).alias("dfp"))
    pts = materialize(pts.repartitionByRange(n, *by, F.desc("score")).withColumn("bucket", F.spark_partition_id()))
    tot = pts.groupBy(*by, "bucket").agg(F.sum("dtp").alias("btp"), F.sum("dfp").alias("bfp"))
    wb = Window.partitionBy(*by).orderBy("bucket")
    off = tot.select(*by, "bucket",
                     F.coalesce(F.sum("btp").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("otp"),
                     F.coalesce(F.sum("bfp").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ofp"),
                     F.sum("btp").over(Window.partitionBy(*by)).alias("P"),
                     F.sum("bfp").over(Window.partitionBy(*by)).alias("N"))
    pts = pts.join(off, [*by, "bucket"])
    w = Window.partitionBy(*by, "bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    pts = pts.select(*by, "score", "P", "N", "dtp", "dfp",
                     (F.col("otp") + F.sum("dtp").over(w)).alias("tp"),
                     (F.col("ofp") + F.sum("dfp").over(w)).alias("fp"))
    r = METRIC_DIGITS
    zero = F.lit(0).cast("long")
    if start:
        first = off.groupBy(*by).agg(F.max("P").alias("P"), F.max("N").alias("N"))
        pts = pts.unionByName(first.select(*by, F.lit(None).cast("double").alias("score"), "P", "N",
                                           *[zero.alias(c) for c in ("dtp", "dfp", "tp", "fp")]))
    return pts.select(*by, "score", "P", "N", "dtp", "dfp",
                      F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
                      F.round(_safe_div(F.col("tp").cast("double"), F.col("P")), r).alias("tpr"),
                      F.round(_safe_div(F.col("fp").cast("double"), F.col("N")), r).alias("fpr"))


def auc(roc: DataFrame, by=("run",)) -> DataFrame:
    """Trapezoid area under the ROC, starting from (0, 0).

    Each point knows its own step (``dtp``, ``dfp``), so the previous point is
    ``(tp - dtp, fp - dfp)``: the area is a plain sum, no window over all scores.
    """
    by = list(by)
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    area = (F.col("dfp") / F.col("N")) * (2 * tp - F.col("dtp")) / (2 * F.col("P"))
    return roc.groupBy(*by).agg(F.round(F.coalesce(F.sum(area), F.lit(0.0)), 6).alias("auc"),
                                F.count("*").alias("n_points"))
