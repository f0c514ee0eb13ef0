"""Shared folder, staged tables and worker-side helpers of the training-data operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.session import ensure_checkpoint_dir

# Task functions travel by value: Python workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below this application's scratch folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clean(spark: SparkSession) -> None:
    """Delete this application's scratch tables (results that still read them must be written first)."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and return the written table.

    A lost executor then costs a reread of its files, not the work behind them,
    and every later reader sees the same rows whatever the order of recomputation.
    """
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def worker_cache(key: str, make: Callable):
    """One object per Python worker process, kept between its tasks."""
    store_ = sys.modules.setdefault("_tagframe_worker_cache", types.ModuleType("_tagframe_worker_cache")).__dict__
    if key not in store_:
        store_[key] = make()
    return store_[key]


def text_slices(arr: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into runs of rows of about ``limit`` bytes: (first row, last row, bytes, offsets).

    Zero-copy views of the Arrow buffers; a null is an empty text. A row longer
    than the limit is a run of its own.
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return
    arr = arr.cast(pa.large_string()) if arr.type != pa.large_string() else arr
    if arr.null_count:
        arr = arr.fill_null("")
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + n + 1]
    data = arr.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, buf[offs[row]:offs[end]], offs[row:end + 1] - offs[row]
        row = end


def held_out(key: Column, parts: int, fold: int) -> Column:
    """crc32 of the key's decimal text, modulo ``parts``, equals ``fold``; a null key counts as 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts, F.lit(0)) == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, name: str) -> DataFrame:
    """``(doc_id, text, label)`` of at most about ``rows`` rows of ``labels(doc_id, label)``, stored.

    Keys are drawn by their hash from the label table alone; they are few enough to
    broadcast whatever the input, so only the sample's text is shuffled. Of the
    documents and labels that repeat a drawn key one is taken.
    """
    n = labels.count()
    if n > rows:
        draw = F.pmod(F.xxhash64(F.lit(name), "doc_id"), F.lit(1 << 20))
        labels = labels.where(draw < int((1 << 20) * rows / n))
    found = docs.select("doc_id", "text").join(F.broadcast(labels.select("doc_id", "label")), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("r"))
    return store(one.select("doc_id", "r.text", "r.label"), name)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + len)."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lens) - lens
    return np.repeat(starts - first, lens) + np.arange(total)
