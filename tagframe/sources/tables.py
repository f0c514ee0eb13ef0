"""Stand-in inputs derived from the driver tables.

| concept              | derivation                                                    |
|----------------------|---------------------------------------------------------------|
| statement            | ``documents(doc_id, text)``                                   |
| label_binary         | ``labels.quality``                                            |
| raw 0-9 label        | ``embeddings.label`` keyed by ``vec_id``                      |
| split                | first hex digit of ``md5(doc_id)``: 0-b train, c-d valid, e-f test |
| run predictions      | two logits per run and labelled document, from its key's hash and its label |
| training logs        | per embedding a run of ``LOG_EPOCHS`` epochs whose metrics are its elements |

All readers prune columns at the scan; the split is a pure function of the
key, so it is identical under any partitioning and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.functions import scores

# Split assignment by the first hex digit of md5(doc_id).
VALID_DIGITS = ("c", "d")
TEST_DIGITS = ("e", "f")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(key: Column) -> Column:
    digit = F.substring(F.md5(key.cast("string")), 1, 1)
    return (F.when(digit.isin(*VALID_DIGITS), F.lit("valid"))
            .when(digit.isin(*TEST_DIGITS), F.lit("test"))
            .otherwise(F.lit("train")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)``, pruned at the scan."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled statements ``(doc_id, text, label_binary, split)``."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label_binary"))
    return docs.join(labels, "doc_id").withColumn("split", split_of(F.col("doc_id")))


def labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, label_binary, split)`` without the text."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label_binary"))
    return labels.withColumn("split", split_of(F.col("doc_id")))


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw multi-class labels ``(row_id, label)`` with out-of-range values."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label")


# The runs, the seeds of their two logits and how far the label moves the second.
RUN_LOGITS = (("untagged", 11, 12, 0.6), ("tagged", 13, 14, 1.0))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction table of two runs over every labelled document:
    ``(run, doc_id, label_binary, logit0, logit1, prediction, confidence)``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label_binary"))

    def run(name, seed0, seed1, shift):
        logit0 = scores.uniform("doc_id", seed0) * 4.0 - 2.0
        logit1 = scores.uniform("doc_id", seed1) * 4.0 - 2.0 + F.lit(shift) * (F.col("label_binary") - F.lit(0.5))
        return F.struct(F.lit(name).alias("run"), logit0.alias("logit0"), logit1.alias("logit1"))

    out = labels.select("doc_id", "label_binary", F.inline(F.array(*[run(*r) for r in RUN_LOGITS])))
    return out.select("run", "doc_id", "label_binary", "logit0", "logit1",
                      scores.argmax2("logit0", "logit1").alias("prediction"),
                      scores.softmax_p1("logit0", "logit1").alias("confidence"))


LOG_EPOCHS = 10


def epoch_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training logs in the shape of per-event logs, one run per embedding.

    Epoch ``e`` has a train event (``loss`` = |element e|) and an eval event (``eval_loss`` =
    |element 10 + e|, ``eval_f1`` = |element 20 + e|); a metric that an event lacks is null.
    """
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("run"), "label", "embedding")

    def value(at):
        return F.abs(F.element_at("embedding", at).cast("double"))

    none = F.lit(None).cast("double")
    events = []
    for e in range(1, LOG_EPOCHS + 1):
        events += [F.struct(F.lit(2 * e - 1).alias("event_no"), F.lit(e).alias("epoch"), value(e).alias("loss"),
                            none.alias("eval_loss"), none.alias("eval_f1")),
                   F.struct(F.lit(2 * e).alias("event_no"), F.lit(e).alias("epoch"), none.alias("loss"),
                            value(10 + e).alias("eval_loss"), value(20 + e).alias("eval_f1"))]
    return emb.select("run", "label", F.inline(F.array(*events)))
