"""Exact dedup against a persistent digest index (DataFrame functions only).

The index is a table bucketed and sorted by digest: ``digest, keep_id, batch``. A batch is
deduplicated by a sort-merge anti-join of its distinct digests with the index, and the
digests that are new are appended; the stored side needs no shuffle.

Defined results: NULL text counts as empty; NULL ids lose against any id, and a text that
only rows without id hold has ``keep_id`` NULL and ``kept`` false; rows that repeat id and
text are all kept or all dropped together; an empty batch gives no rows and adds nothing.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alloy.llm.common import join_hot, staged, text_or_empty

#: runs of white space other than one single space; replacing them by one space is the
#: same as replacing every run
ODD_SPACE = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"
BUCKETS = 32


def normal_digest(text_col: str) -> Column:
    """SHA-256 (binary) of the text with every run of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text_col), ODD_SPACE, " "), 256))


class DigestIndex:
    """Persistent digest -> keep_id table in the session's warehouse."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets

    def read(self) -> DataFrame:
        if self.spark.catalog.tableExists(self.name):
            return self.spark.table(self.name)
        return self.spark.createDataFrame([], "digest binary, keep_id long, batch string")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the digests of ``groups`` (digest, keep_id) that the index does not hold.
        A batch that is run again after a failure adds only what is still missing."""
        fresh = (groups.select("digest", "keep_id").hint("merge").join(self.read().select("digest"), "digest", "left_anti")
                 .withColumn("batch", F.lit(batch)))
        (fresh.repartition(self.buckets, "digest").write.format("parquet").mode("append")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def dedup_batch(index: DigestIndex, df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                batch: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep_id`` is the id that the index keeps for the text (of an earlier batch, or the
    smallest of this one); ``group_size`` counts the rows of this batch with that text."""
    rows = staged(df.select(F.col(id_col).cast("long").alias("doc_id"), normal_digest(text_col).alias("digest")),
                  "digests")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    index.append(groups, batch or uuid.uuid4().hex)
    entries = groups.drop("keep_id").hint("merge").join(index.read().select("digest", "keep_id"), "digest")
    out = join_hot(rows, entries, "digest", "group_size", rows.count())
    return out.select("doc_id", "keep_id", "group_size",
                      F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))
