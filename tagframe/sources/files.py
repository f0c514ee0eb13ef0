"""Delimited files, training logs, run records and sweep results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagframe.schemas import PREDICTION_EXPORT, RAW_STATEMENTS, SWEEP_RESULT
from tagframe.sources.literals import literal_of
from tagframe.sources import literals


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Quoted CSV with a header; columns are found by the header's names, in any order, then cast.

    ``escape='"'`` keeps doubled quotes inside a field. Columns that the schema does not name are dropped;
    a file without one that it names is an error.
    """
    raw = (spark.read.option("header", True).option("inferSchema", False).option("multiLine", True)
           .option("escape", '"').csv(path))
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_predictions(spark: SparkSession, path: str, run: str) -> DataFrame:
    """A prediction export (``statement, ..., label_binary, prediction, confidence``) as one run."""
    df = read_csv(spark, path, PREDICTION_EXPORT)
    return df.select(F.lit(run).alias("run"), *[f.name for f in PREDICTION_EXPORT.fields])


def read_statements(spark: SparkSession, path: str, schema: T.StructType = RAW_STATEMENTS) -> DataFrame:
    return read_csv(spark, path, schema)


def read_tagged(spark: SparkSession, path: str, list_columns=("A_raw_entities", "B_raw_entities"),
                mode: str = "keep") -> DataFrame:
    """Tagged split whose list columns hold Python-literal text; lists parsed by S7."""
    schema = T.StructType([T.StructField("statement", T.StringType()), T.StructField("label", T.IntegerType()),
                           T.StructField("label_binary", T.IntegerType())]
                          + [T.StructField(c, T.StringType()) for c in list_columns])
    df = read_csv(spark, path, schema)
    for c in list_columns:
        df = literals.parse_entities(df, c, f"{c}_parsed", mode)
    return df


def read_log_events(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """A training log of one dict per line → ``(run, event_no, metric columns)``.

    Lines that are not dicts (banners) parse to null and are dropped; ``event_no``
    comes from the file position so the order survives any shuffle.
    """
    lines = spark.read.text(path).withColumn("_file", F.input_file_name())
    parsed = lines.select(F.col("_file"), F.from_json("value", "map<string,double>").alias("m"),
                          F.monotonically_increasing_id().alias("event_no"))
    parsed = parsed.where(F.col("m").isNotNull())
    return parsed.select(F.coalesce(F.lit(run), F.col("_file")).alias("run"), "event_no", "m")


def log_metrics(events: DataFrame, metrics) -> DataFrame:
    """Expand the event map into nullable metric columns."""
    return events.select("run", "event_no", *[F.col("m")[k].alias(k) for k in ("epoch", *metrics)])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite") -> None:
    """Write a result table; CSV export writes lists, structs and maps in the literal form that S2 and S7 read."""
    if fmt == "csv":
        cols = [literal_of(F.col(f.name), f.dataType).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
                else F.col(f.name) for f in df.schema.fields]
        w = df.select(*cols).write.mode(mode).option("header", True).option("escape", '"')
    else:
        w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


def append_run_record(spark: SparkSession, path: str, config: dict, metrics: DataFrame) -> None:
    """One row per run = config literals + metric columns, stored under ``run=``.

    Dynamic partition overwrite replaces only the partitions of the runs being
    written, so a retried job leaves one record per run instead of appending twice.
    """
    rec = metrics.withColumns({k: F.lit(v) for k, v in config.items()})
    rec.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_sweep_results(spark: SparkSession, glob: str) -> DataFrame:
    """The one-row result files of a sweep as one table."""
    return read_csv(spark, glob, SWEEP_RESULT)

