"""Sinks: create-or-replace, guarded write decision table, clustered and routed writes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists_with_rows(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).limit(1).isEmpty()
    except AnalysisException:
        return False


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Create-or-replace a Parquet table. The new table is written whole to a folder beside
    the old one, which is only then dropped and replaced by a rename: a job that fails
    leaves the old table as it was, and ``df`` may read the table that it replaces."""
    path = path.rstrip("/")
    staging = f"{path}__staging_{uuid.uuid4().hex}"
    spark = df.sparkSession
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    try:
        writer.parquet(staging)
        fs.delete(hadoop_path(path), True)
        if not fs.rename(hadoop_path(staging), hadoop_path(path)):
            raise OSError(f"cannot rename {staging} to {path}")
    except Exception:
        if fs.exists(hadoop_path(path)):  # else the staged table is the only one left
            fs.delete(hadoop_path(staging), True)
        raise
    return path


@dataclass
class WriteResult:
    status: str                 # ERROR | SKIPPED | ABORTED | DRY_RUN | COMPLETE
    lineage_status: str         # PENDING | EXISTING | COMPLETE
    reason: str = ""
    plan: str = ""
    schema: list[str] = field(default_factory=list)


def guarded_write(df: DataFrame, path: str, dry_run: bool = True, overwrite: bool = False,
                  brownfield: bool = False) -> WriteResult:
    """Decision table of the guarded CTAS.

    overwrite & dry_run -> ERROR (before anything); target has rows & !overwrite &
    brownfield -> SKIPPED/EXISTING; target has rows & !overwrite -> ABORTED; dry_run ->
    plan text only, nothing runs; else write -> COMPLETE.
    """
    if overwrite and dry_run:
        return WriteResult("ERROR", "PENDING", "OVERWRITE_WITH_DRY_RUN")
    has_rows = _exists_with_rows(df.sparkSession, path)
    if has_rows and not overwrite:
        if brownfield:
            return WriteResult("SKIPPED", "EXISTING", "TARGET_EXISTS_BROWNFIELD")
        return WriteResult("ABORTED", "PENDING", "TARGET_EXISTS_NO_OVERWRITE")
    schema = [f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields]
    if dry_run:
        plan = df._jdf.queryExecution().simpleString()
        return WriteResult("DRY_RUN", "PENDING", "", plan, schema)
    write_table(df, path)
    return WriteResult("COMPLETE", "COMPLETE", "", "", schema)


def write_clustered(df: DataFrame, path: str, date_col: str | None, cluster_cols: list[str],
                    num_partitions: int | None = None) -> str:
    """Layout for pruning: directory per ingest date, files range-clustered on keys.

    ``repartitionByRange`` samples the key distribution, so hot values are split
    across files instead of landing in one task.
    """
    keys = ([date_col] if date_col else []) + list(cluster_cols)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    writer = laid.write.mode("overwrite")
    if date_col:
        writer = writer.partitionBy(date_col)
    writer.parquet(path)
    return path


def interleaved(df: DataFrame, cols: list[str], bits: int = 6) -> Column:
    """A Z-order key: the columns' ranks, in ``2 ** bits`` ranges of equal size each, with their bits
    taken in turns. Rows near in all columns have near keys, so a range of keys is narrow in every
    one of them. The range bounds are quantiles (one pass; ``2 ** bits`` numbers a column reach
    the driver), so skewed columns are cut evenly; NULLs are the first range, and a value that
    fills several ranges by itself is in the last of them."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    # texts are ranked by a number that keeps their order as far as six bytes go
    ranked = {c: F.conv(F.rpad(F.substring(F.hex(F.col(c).cast("string")), 1, 12), 12, "0"), 16, 10).cast("double")
              if isinstance(df.schema[c].dataType, T.StringType) else
              F.unix_micros(F.col(c).cast("timestamp")).cast("double")
              if isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.col(c).cast("double")
              for c in cols}
    bounds = df.agg(*[F.percentile_approx(v, shares, 10_000).alias(f"b{i}") for i, v in enumerate(ranked.values())]).first()
    # the bits of each rank, spread to their places in the key
    spread = [[sum((rank >> bit & 1) << (bit * len(cols) + i) for bit in range(bits)) for rank in range(1 << bits)] for i in range(len(cols))]

    def part(i: int, value: Column) -> Column:
        rank = F.size(F.filter(F.lit(bounds[i] or shares), lambda low: low <= value))
        return F.coalesce(F.get(F.lit(spread[i]), F.when(value.isNotNull(), rank)), F.lit(0)).cast("long")

    return reduce(Column.__add__, [part(i, value) for i, value in enumerate(ranked.values())])


def write_interleaved(df: DataFrame, path: str, cols: list[str], num_partitions: int | None = None, bits: int = 6) -> str:
    """Layout for filters on any of several columns: files are ranges of a Z-order key
    (``interleaved``), so each file, and each row group in it, is narrow in all of ``cols``."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_z", interleaved(df, cols, bits))
    keyed.repartitionByRange(n, "_z", *cols).sortWithinPartitions("_z", *cols).drop("_z").write.mode("overwrite").parquet(path)
    return path


def write_routed(routed: DataFrame, path: str, table_col: str = "gold_table", rows_per_file: int = 1_000_000) -> str:
    """Fan-out in one pass: one directory per Gold target (not one scan per target). Rows are
    dealt by target and a salt; a target has as many salts, so files and tasks, as its rows
    fill files of ``rows_per_file`` (one small row per target is counted first)."""
    sizes = routed.groupBy(F.col(table_col).alias("_target")).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    dealt = routed.join(F.broadcast(sizes), F.col(table_col).eqNullSafe(F.col("_target")))
    salt = F.pmod(F.xxhash64(*routed.columns), F.col("_files"))
    parts = max(int(routed.sparkSession.conf.get("spark.sql.shuffle.partitions")), sizes.agg(F.sum("_files")).first()[0] or 1)
    dealt.repartition(parts, F.col(table_col), salt).drop("_target", "_files").write.mode("overwrite").partitionBy(table_col).parquet(path)
    return path
