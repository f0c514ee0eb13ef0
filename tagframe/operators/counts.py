"""Class counts, entity counts, top-k, zero-filled tag tables, run comparison.

All aggregates are hash aggregates with a map-side partial step, so a hot
word or tag is pre-aggregated per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagframe.functions import labels as L
from tagframe.operators.entities import TAGS_A

# The four error kinds of the run comparison, in report order.
RUN_OUTCOMES = ("FP", "FN")


def class_counts(df: DataFrame, label: str = "label_binary") -> DataFrame:
    """A1: rows per class."""
    return df.groupBy(label).agg(F.count("*").alias("n"))


def class_balance(df: DataFrame, label: str = "label_binary", split: str = "split") -> DataFrame:
    """A2 (show_balance): total, ones, zeros and percentages to 2 decimals per split."""
    g = df.groupBy(split).agg(
        F.count("*").alias("total"),
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("ones"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).cast("long").alias("zeros"))
    return g.select(split, "total", "ones", "zeros",
                    F.round(F.col("ones") * 100.0 / F.col("total"), 2).alias("pct_ones"),
                    F.round(F.col("zeros") * 100.0 / F.col("total"), 2).alias("pct_zeros"))


def class_priors(df: DataFrame, label: str = "label_binary", by: str | None = None) -> DataFrame:
    """Share of each class."""
    aggs = [F.avg(F.when(F.col(label) == 0, 1.0).otherwise(0.0)).alias("p0"),
            F.avg(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("p1")]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def word_entity_counts(ents: DataFrame, labels: DataFrame, key: str = "doc_id",
                       label: str = "label_binary") -> DataFrame:
    """A3 (count_word_entities): count per (tagger, class, word, entity)."""
    j = ents.select(key, "tagger", "word", "entity").join(labels.select(key, label), key)
    return j.groupBy("tagger", label, "word", "entity").agg(F.count("*").alias("n"))


def top_k(counts: DataFrame, k: int, by=("tagger", "label_binary")) -> DataFrame:
    """Top k per group by count desc; ties broken by word, entity."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "word", "entity")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tag_frequency(ents: DataFrame) -> DataFrame:
    """A4: entity label frequency over all rows."""
    return ents.where(F.col("entity").isNotNull()).groupBy("entity").agg(F.count("*").alias("n"))


def tag_dim(spark: SparkSession, tags=TAGS_A) -> DataFrame:
    """Fixed tag dimension with its report order."""
    return spark.createDataFrame([(t, i) for i, t in enumerate(tags)], "entity string, tag_order int")


def _tag_structs(tags=TAGS_A):
    return F.array(*[F.struct(F.lit(t).alias("entity"), F.lit(i).alias("tag_order")) for i, t in enumerate(tags)])


def zero_fill_tags(counts: DataFrame, spark: SparkSession, tags=TAGS_A, by: list[str] | None = None) -> DataFrame:
    """Align counts to the fixed tag list; missing tags get 0, other tags are dropped.

    The scaffold is the fixed tag list exploded per distinct group (no join
    product); the counts are then left-joined to it.
    """
    if by:
        frame = counts.select(*by).distinct().select(*by, F.inline(_tag_structs(tags)))
        on = by + ["entity"]
    else:
        frame, on = F.broadcast(tag_dim(spark, tags)), ["entity"]
    return frame.join(counts, on, "left").select(*on, "tag_order", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def error_tag_counts(preds: DataFrame, ents: DataFrame, spark: SparkSession, key: str = "doc_id") -> DataFrame:
    """A5: tag counts of FP and FN rows per run, fixed tag order, zero fill."""
    errs = preds.select("run", key, L.outcome("label_binary", "prediction").alias("outcome")) \
                .where(F.col("outcome").isin(*RUN_OUTCOMES))
    per_doc = ents.groupBy(key, "entity").agg(F.count("*").alias("c"))
    j = errs.join(per_doc, key)
    counts = j.groupBy("run", "outcome", "entity").agg(F.sum("c").cast("long").alias("n"))
    frame = (preds.select("run").distinct()
             .select("run", F.explode(F.array(*[F.lit(o) for o in RUN_OUTCOMES])).alias("outcome"))
             .select("run", "outcome", F.inline(_tag_structs())))
    return frame.join(counts, ["run", "outcome", "entity"], "left").select(
        "run", "outcome", "entity", "tag_order", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def run_comparison(error_counts: DataFrame, runs=("tagged", "untagged")) -> DataFrame:
    """Both runs side by side per tag and error kind (one row per tag)."""
    keyed = error_counts.withColumn("run_outcome", F.concat_ws("_", "run", "outcome"))
    cols = [f"{r}_{o}" for r in runs for o in RUN_OUTCOMES]
    wide = keyed.groupBy("entity", "tag_order").pivot("run_outcome", cols).agg(F.sum("n"))
    return wide.select("entity", "tag_order", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in cols])
