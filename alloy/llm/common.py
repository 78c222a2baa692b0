"""Helpers shared by the operators: tables, staged results, worker-wide caches."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alloy.session import scratch_path

#: white space of the word and normalisation rules: space and \x09-\x0D
ASCII_SPACE = r"[\x20\x09-\x0D]+"
#: a key with at least 1/HOT_SHARE of all rows is hot, so there are at most HOT_SHARE hot keys
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: the lineage
    ends at files that every executor can read, and file sizes are known."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def worker_cached(key: str, make: Callable[[], Any]) -> Any:
    """One object per Python worker process, kept over the tasks that it runs until one of
    another key is asked for, so that the caches of several stages do not add up."""
    held = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    if getattr(held, "key", None) != key:
        held.key = held.value = None
        held.key, held.value = key, make()
    return held.value


def join_hot(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined to ``groups`` (one row per ``key``, ``size`` = its number of rows).

    Keys with at least 1/HOT_SHARE of ``total`` rows, at most HOT_SHARE many, are broadcast,
    so their rows stay where they are; all others meet in a sort-merge join. Exact for
    every key; rows with a NULL key find no partner."""
    is_hot = F.col(size) * HOT_SHARE >= F.lit(total)
    hot = F.broadcast(groups.filter(is_hot))
    cold = rows.join(F.broadcast(groups.filter(is_hot).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(groups.filter(~is_hot), key))


#: bytes of text that a task turns into arrays at a time (a longer text goes alone)
SLICE_BYTES = 8 << 20


def text_slices(batch: pa.RecordBatch, text: int = 1, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``size`` bytes of text, so memory follows the longest text only."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class Words(NamedTuple):
    """Words of a slice of texts: ``distinct[codes[ends[i-1]:ends[i]]]`` are those of text i."""
    codes: np.ndarray
    ends: np.ndarray
    distinct: np.ndarray


def coded(lists: pa.ListArray, drop_empty: bool = True, lower: bool = False) -> Words:
    """``lower``: A-Z as a-z, so that entries of ``distinct`` may be equal."""
    flat = lists.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    entries = pc.ascii_lower(flat.dictionary) if lower else flat.dictionary
    distinct = entries.to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    if drop_empty and (empty := np.flatnonzero(distinct == "")).size:
        keep = codes != empty[0]
        kept = np.concatenate([[0], np.cumsum(keep)])
        codes, ends = codes[keep], kept[ends]
    return Words(codes, ends, distinct)


def space_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words between runs of space and \\x09-\\x0D."""
    return coded(pc.ascii_split_whitespace(texts.cast(pa.large_string())), lower=lower)


def word_hashes(distinct: np.ndarray) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), dtype=np.uint64, count=len(distinct))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values, by the position of its first."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + len(out)]
    return mixed(out)
