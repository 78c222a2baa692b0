"""Corpus pipeline: quality classifier, exact dedup, near-dedup, secret scan, packing.

Stages take (spark, docs, sf_dir) and all but the last return the columns of their input.
Rows without doc_id pass the two dedup stages, which decide by id; rows that repeat an id and
its text stay or go together. Other columns of any name or value are carried along.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alloy.llm import digest_index, near_dedup, packing, quality_rank, secret_scan
from alloy.llm.common import staged, table
from alloy.llm.queries import BYTE_RANKS, WORD_BPE, held_out, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def chosen(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``kept`` (doc_id), and those without id."""
    ids = kept.select(F.col("doc_id").alias("_kept_id")).distinct()
    with_id = docs.filter(F.col("doc_id").isNotNull())
    found = with_id.join(ids, with_id["doc_id"].cast("long") == ids["_kept_id"], "left_semi")
    return found.unionByName(docs.filter(F.col("doc_id").isNull()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the pairwise ranking puts below its cut."""
    model = quality_rank.fit(docs, table(spark, sf_dir, "labels"), train=~held_out())
    return docs.filter(quality_rank.score(F.col("text"), model) >= 0.5)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the document with the smallest id."""
    index = digest_index.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    return chosen(docs, digest_index.dedup_batch(index, docs).filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component keep the document with the smallest id."""
    return chosen(docs, near_dedup.near_duplicates(docs).filter("kept"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets in every text; ``n_chars`` follows the text."""
    clean = docs.withColumn("text", secret_scan.redacted(F.col("text"), vocabulary(BYTE_RANKS)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                                 .otherwise(F.length("text")).cast(kind))
    return clean.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences."""
    return packing.pack_documents(docs, vocabulary(WORD_BPE))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("pack", pack),
]

#: the classifier and the tokenizer are beyond SQL; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``; what each stage keeps is written to the
    shared folder, so none is computed again by the next one's jobs."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
