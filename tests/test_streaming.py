"""Tagging on a document stream equals the batch result."""

import os

import pytest

from tagframe.operators import entities as E
from tagframe.operators import tagging as T
from tagframe.sources import tables as TB
from tagframe.streaming import tagging as ST

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_phrase_stream_equals_batch(spark):
    stream = ST.stream_phrases(ST.document_stream(spark, SF))
    q = stream.writeStream.format("memory").queryName("phr_stream").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT doc_id, pos, entity, word FROM phr_stream").collect())
    want = sorted(tuple(r) for r in E.tag_phrases(TB.documents(spark, SF)).select("doc_id", "pos", "entity", "word").collect())
    assert got == want and len(got) > 0


@pytest.mark.parametrize("parts", [0, 3])
def test_tag_xml_stream_equals_batch(spark, tmp_path, parts):
    """The table as one file, and as a folder of part files."""
    src = SF
    if parts:
        src = str(tmp_path)
        spark.read.parquet(f"{SF}/documents.parquet").repartition(parts).write.parquet(f"{src}/documents.parquet")
    out = spark.read.parquet(ST.run_tag_xml(spark, src, str(tmp_path / "out")))
    want = T.tag_xml_rows(TB.documents(spark, SF), E.token_entities("text"))
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in want.collect())
    assert out.count() == 200
