"""Operator 7: exact duplicates by skew-safe combining.

Three stages, each comparing whole normalised texts, not digests alone: copies
meet within a task (partial aggregation), then within (digest, salt) where the
salt comes from the task, then the salt winners meet by digest. A group that
holds a third of all rows reaches the second stage as one row per task, spread
over the salts, and the last stage as one row per salt.

Documents find their group by digest. The last stage counts the different
contents of each digest; the documents of a digest with more than one are
grouped by content instead.

Defined results: a null text counts as empty; texts are equal when identical
after each ``[\\x20\\x09-\\x0D]+`` became one space; ``keep_id`` is the smallest
non-null ``doc_id`` of the group (null if all are null); of rows that repeat
that ``doc_id`` within the group one is kept; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.llm.common import SPACE, documents, store

SALTS = 16


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def dedup(docs: DataFrame, salts: int = SALTS, digest=sha256_hex) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, row)``: one row per row of ``docs``.

    ``row`` numbers the rows of ``docs`` (its partition and place). ``digest``
    may be weaker than SHA-256; results stay right, only more contents meet.
    """
    norm = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE, " ")
    rows = docs.select("doc_id", norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    salted = (rows.withColumn("salt", F.spark_partition_id() % salts).groupBy("digest", "salt", "norm")
              .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
    contents = (salted.repartition("digest").groupBy("digest", "norm")
                .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")))
    groups = store(contents.groupBy("digest").agg(F.count(F.lit(1)).alias("n_contents"), F.min("keep_id").alias("keep_id"),
                                                  F.sum("group_size").alias("group_size")), "exact_groups")
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    sha = sha256_hex(F.col("norm"))
    members = (numbered.withColumn("text_sha256", F.col("digest") if digest is sha256_hex else sha).drop("norm")
               .join(groups.where("n_contents = 1").drop("n_contents"), "digest"))
    shared = groups.where("n_contents > 1").select("digest")
    if not shared.isEmpty():
        several = numbered.withColumn("text_sha256", sha).join(shared, "digest", "left_semi")
        by_text = (several.groupBy("digest", "norm")
                   .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
        members = members.unionByName(several.join(by_text, ["digest", "norm"]).drop("norm"))
    members = store(members.select("row", "doc_id", "keep_id", "group_size", "text_sha256"), "exact_members")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # rows that repeat the winner's doc_id: the first of them stays
    first = (members.where(stays).groupBy("text_sha256").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("text_sha256", "first_row"))
    if first.isEmpty():
        return members.withColumn("kept", stays)
    return (members.join(first, "text_sha256", "left")
            .withColumn("kept", stays & (F.col("first_row").isNull() | (F.col("row") == F.col("first_row")))).drop("first_row"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
