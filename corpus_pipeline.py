"""Training-data pipeline: language, toxicity, exact copies, near copies, packing.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)``
and returns a DataFrame that is written as Parquet and reread as the next one's
``docs``. All but the last return rows of ``docs`` with their columns unchanged,
so extra columns travel along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.llm import best_fit, chosen_path, exact_dedup, language_spans, toxicity
from tagframe.llm.common import SPACE, documents, fresh, store

#: A document stays if its main language has at least this share of its words' bytes.
MAIN_LANGUAGE = 0.3
TOXIC_FROM = 0.5


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those in which no language prevails."""
    model = language_spans.fit(language_spans.training_rows(docs))
    got = fresh(docs, "language")
    labelled = docs.withColumn(got, language_spans.label(F.col("text"), model))
    if not model["langs"]:  # nothing to learn from: nothing is rejected
        return docs
    return labelled.where((F.col(f"{got}.lang") != "und") & (F.col(f"{got}.score") >= MAIN_LANGUAGE)).drop(got)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose deobfuscated text scores as toxic."""
    lm, model = toxicity.train(docs, documents(spark, sf_dir, "labels"))
    got = fresh(docs, "toxicity")
    return docs.withColumn(got, toxicity.toxicity(F.col("text"), lm, model)).where(F.col(f"{got}.score") < TOXIC_FROM).drop(got)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest ``doc_id`` of each group of equal texts, one row of repeated ones."""
    members = exact_dedup.dedup(docs.select("doc_id", "text"))
    id_, sha = fresh(docs, "kept_id"), fresh(docs, "kept_sha")
    winners = (members.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
               .groupBy(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).agg(F.count(F.lit(1)).alias("n")))
    winners = store(winners, "winners")
    norm = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE, " ")
    keyed = docs.withColumn(fresh(docs, "sha"), exact_dedup.sha256_hex(norm))
    own = fresh(docs, "sha")

    def of(some: DataFrame) -> DataFrame:
        return keyed.join(some, keyed["doc_id"].eqNullSafe(some[id_]) & (keyed[own] == some[sha]), "left_semi")

    kept = of(winners.where("n = 1"))
    repeated = winners.where("n > 1")
    if not repeated.isEmpty():
        kept = kept.unionByName(of(repeated).dropDuplicates(["doc_id", own]))
    return kept.select(docs.columns)


def keep_unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest ``doc_id``, of each group of near copies.

    Shingles of five words, similarity 0.8 or more.
    """
    found = chosen_path.near_duplicates(docs.select("doc_id", "text"), size=5, percent=80)
    id_ = fresh(docs, "kept_id")
    kept = store(found.where("kept").select(F.col("doc_id").alias(id_)).distinct(), "kept")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[id_]), "left_semi")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the remaining documents in sequences of at most 2048 tokens."""
    slots = best_fit.pack(docs.select("doc_id", "text")).slots
    return slots.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


STAGES = [("language", keep_language), ("toxicity", keep_civil), ("exact_dedup", keep_distinct),
          ("near_dedup", keep_unlike), ("packing", pack_sequences)]

#: Tokenizers and learned models cannot be expressed in SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
