"""Tagging documents as they arrive.

Every text operator is local to the document's row, so it runs on a streaming
DataFrame as it is: no state, no per-batch code, and the file sink writes each
micro-batch exactly once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tagframe.operators import entities as E
from tagframe.operators import tagging as T
from tagframe.session import ensure_checkpoint_dir

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def document_stream(spark: SparkSession, src: str, table: str = "documents.parquet", max_files: int | None = None) -> DataFrame:
    """Documents arriving as Parquet files of the table: a folder of part files, or a single file.

    ``max_files`` bounds the files of a micro-batch; by default it takes all that are new.
    """
    reader = spark.readStream.schema(DOC_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if _is_folder(spark, f"{src}/{table}"):
        return reader.parquet(f"{src}/{table}")
    return reader.option("pathGlobFilter", table).parquet(src)


def stream_phrases(stream: DataFrame) -> DataFrame:
    """N6 on a stream."""
    return E.tag_phrases(stream.select("doc_id", "text"))


def stream_tag_xml(stream: DataFrame) -> DataFrame:
    """T6 on a stream."""
    return T.tag_xml_rows(stream, E.token_entities("text"))


def run_tag_xml(spark: SparkSession, src: str, out: str | None = None) -> str:
    """Run T6 over a document stream to completion (``availableNow``); return the sink folder, the caller's to delete.

    Sink and stream checkpoint live under the session's shared checkpoint folder unless ``out`` names another.
    """
    run_dir = out or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-tag-xml-{uuid.uuid4().hex}"
    q = (stream_tag_xml(document_stream(spark, src)).writeStream.format("parquet").outputMode("append")
         .option("path", f"{run_dir}/data").option("checkpointLocation", f"{run_dir}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{run_dir}/data"
