"""Unions and reshaping: split union, melt, transpose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train_full(df: DataFrame, split: str = "split", parts=("train", "valid")) -> DataFrame:
    """Train ∪ valid (UNION ALL) as a predicate on the split column; rows keep their key."""
    return df.where(F.col(split).isin(*parts))


def metrics_long(df: DataFrame, ids, metrics, var: str = "metric", value: str = "value") -> DataFrame:
    """R1 (melt): one row per (ids, metric)."""
    return df.unpivot(list(ids), list(metrics), var, value)


def metrics_wide(long: DataFrame, id_col: str, metrics, var: str = "metric", value: str = "value") -> DataFrame:
    """R2: long metrics → one row per ``id_col`` with one column per metric (fixed list)."""
    return long.groupBy(id_col).pivot(var, list(metrics)).agg(F.first(value))


def literal_table(spark, columns: dict) -> DataFrame:
    """A small literal table from column lists (as a dict of lists), one row per position."""
    names = list(columns)
    rows = list(zip(*[columns[n] for n in names]))
    return spark.createDataFrame(rows, names)


def as_percent(df: DataFrame, cols, digits: int = 2) -> DataFrame:
    """E5/A10: metrics scaled to percent and rounded."""
    return df.withColumns({c: F.round(F.col(c) * 100.0, digits) for c in cols})
