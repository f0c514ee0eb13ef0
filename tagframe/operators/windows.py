"""Ordering operators: seeded shuffle, mini-batches, best run, early stopping, log stats.

Global numbers are exact at any size without a global sort in one task: the order
key is a hash of the row key (repeatable under any partitioning and in SQL), its
first digits are the bucket, bucket sizes give each bucket's offset and rows are
numbered within their bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(key, seed: int):
    """Hex order key ``md5(key || ':' || seed)``; sorting by it is a seeded shuffle."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")))


#: Leading hex digits of the order key that make a bucket: 65,536 buckets, of equal share whatever the keys.
BUCKET_DIGITS = 4


def hash_rank(df: DataFrame, key: str = "doc_id", seed: int = 42, by=(), out: str = "shuffle_rank",
              digits: int = BUCKET_DIGITS) -> DataFrame:
    """0-based position of every row in shuffle order, within ``by``. Rows must have distinct keys."""
    by = list(by)
    t = df.withColumn("_sk", shuffle_key(key, seed)).withColumn("_b", F.substring("_sk", 1, digits))
    sizes = t.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, "_b").orderBy("_sk", key)
    return (t.join(offsets, [*by, "_b"]).withColumn(out, F.col("_before") + F.row_number().over(within) - 1)
            .drop("_sk", "_b", "_before"))


def seeded_shuffle(df: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """The rows with their position in the seeded order."""
    return hash_rank(df, key, seed)


def mini_batches(df: DataFrame, key: str = "doc_id", seed: int = 42, size: int = 8, by=("split",),
                 digits: int = BUCKET_DIGITS) -> DataFrame:
    """Consecutive groups of ``size`` rows in shuffle order within ``by``; only the last may be smaller."""
    ranked = hash_rank(df, key, seed, by, "_rank", digits)
    return ranked.withColumn("batch_no", F.floor(F.col("_rank") / size).cast("long")).drop("_rank")


def best_run(results: DataFrame, metric: str = "f1", run: str = "name", by=()) -> DataFrame:
    """The run with the highest metric (greater is better); ties → lowest run name."""
    if not by:
        return results.orderBy(F.desc(metric), run).limit(1)
    w = Window.partitionBy(*by).orderBy(F.desc(metric), run)
    return results.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def early_stop(log: DataFrame, metric: str = "eval_f1", run: str = "run", epoch: str = "epoch",
               patience: int = 5, max_epochs: str | None = "max_epochs") -> DataFrame:
    """Early stopping on a per-epoch log, greater is better.

    The running best epoch moves only on a strict improvement; training stops at
    the first epoch ``patience`` epochs past it, so ``final = min(best + patience, epochs)``.
    Windows are per run and bounded by its number of epochs.
    """
    w = Window.partitionBy(run).orderBy(epoch)
    prev_best = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = log.withColumn("_improved", prev_best.isNull() | (F.col(metric) > prev_best))
    t = t.withColumn("_rb", F.max(F.when(F.col("_improved"), F.col(epoch)))
                     .over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.col(epoch) - F.col("_rb") >= patience
    epochs = F.first(max_epochs) if max_epochs else F.max(epoch)
    g = t.groupBy(run).agg(F.min_by("_rb", F.when(stop, F.col(epoch))).alias("stop_rb"),
                           F.max_by("_rb", F.col(epoch)).alias("last_rb"),
                           epochs.alias("epochs"))
    best = F.coalesce(F.col("stop_rb"), F.col("last_rb"))
    return g.select(run, best.alias("best_epoch"), "epochs",
                    F.least(best + patience, F.col("epochs")).alias("final_epoch"))


def epoch_stats(log: DataFrame, by=("run",), seq: str = "event_no",
                metrics=("loss", "eval_loss", "eval_f1")) -> DataFrame:
    """Last non-null value of each metric per (run, epoch), order by event number.

    ``max_by(value, event_no)`` over non-null rows is order-independent after a shuffle,
    unlike ``last(ignorenulls)``.
    """
    t = log.where(F.col("epoch").isNotNull())
    aggs = [F.max_by(F.col(m), F.when(F.col(m).isNotNull(), F.col(seq))).alias(m) for m in metrics]
    return t.groupBy(*by, "epoch").agg(*aggs)


def config_grid(spark, epochs=(10, 15, 20), batch_sizes=(4, 8, 16, 32, 64),
                lrs=(1e-5, 2e-5, 3e-5, 4e-5)) -> DataFrame:
    """Product of the three value lists, numbered ``exp_1..`` in nested-loop order.

    Three tiny literal tables; the 60-row product is numbered by the ordinals.
    """
    def lst(vals, name, cast):
        return F.array(*[F.struct(F.lit(v).cast(cast).alias(name), F.lit(i).alias(f"{name}_i"))
                         for i, v in enumerate(vals)])
    g = (spark.range(1).select(F.inline(lst(epochs, "epochs", "int")))
         .select("*", F.inline(lst(batch_sizes, "batch_size", "int")))
         .select("*", F.inline(lst(lrs, "lr", "double"))))
    g = g.withColumnsRenamed({"epochs_i": "e_i", "batch_size_i": "b_i", "lr_i": "l_i"})
    n_b, n_l = len(batch_sizes), len(lrs)
    exp_id = F.col("e_i") * (n_b * n_l) + F.col("b_i") * n_l + F.col("l_i") + 1
    return g.select(F.concat(F.lit("exp_"), exp_id.cast("string")).alias("name"),
                    exp_id.cast("int").alias("exp_id"), "epochs", "batch_size", "lr")


def config_pick(grid: DataFrame, index: int) -> DataFrame:
    """the config at a 0-based index; out of range gives no rows."""
    return grid.where(F.col("exp_id") == index + 1)
