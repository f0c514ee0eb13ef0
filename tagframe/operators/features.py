"""Entity-count features per document (multi-hot counts, alignment, fill)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagframe.operators.windows import hash_rank


def entity_pivot(ents: DataFrame, vocab, key: str = "doc_id") -> DataFrame:
    """Entity counts per document, one column per label of ``vocab``.

    The vocabulary is the tagger's label set, known without reading data.
    Documents without entities do not appear (see ``entity_features``).
    """
    wide = ents.groupBy(key).pivot("entity", list(vocab)).count()
    return wide.select(key, *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(v) for v in vocab])


def entity_features(labels: DataFrame, ents: DataFrame, vocab, key: str = "doc_id",
                    extra: tuple[str, ...] = ("label_binary",)) -> DataFrame:
    """Every labelled row with its counts over ``vocab``; missing → 0, extra labels dropped.

    Passing the training vocabulary aligns a test set to the training columns (J2).
    """
    counts = entity_pivot(ents.where(F.col("entity").isin(*vocab)), vocab, key)
    j = labels.select(key, *extra).join(counts, key, "left")
    return j.select(key, *extra, *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(v) for v in vocab])


def fit_vocabulary(ents: DataFrame, label: str = "entity") -> DataFrame:
    """The label dictionary of a training set, ``(label, feature_id)``: every distinct non-empty label, numbered from 0.

    The numbers follow the labels' hash order, exact at any size (``hash_rank``); the
    dictionary is a table, so it may grow with the data.
    """
    found = ents.where(F.col(label).isNotNull() & (F.col(label) != "")).select(F.col(label).alias("label")).distinct()
    return hash_rank(found, "label", out="feature_id")


def sparse_features(rows: DataFrame, ents: DataFrame, vocabulary: DataFrame, key: str = "doc_id", label: str = "entity",
                    extra: tuple[str, ...] = ("label_binary",)) -> DataFrame:
    """Every row of ``rows`` with its counts over the training vocabulary as a sparse vector.

    ``features`` is an array of ``(feature_id, n)`` in order of the id. Labels that the
    dictionary lacks are dropped, rows without a known label have an empty array. Counts
    are added by (row, label) before they meet the dictionary.
    """
    counts = ents.groupBy(key, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    known = counts.join(vocabulary.select("label", "feature_id"), "label")
    lists = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("feature_id", "n"))).alias("features"))
    return rows.select(key, *extra).join(lists, key, "left").select(key, *extra, F.coalesce("features", F.array()).alias("features"))
