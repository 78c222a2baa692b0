"""Set operations and table mutation as set-based DataFrame plans.

Parquet tables are immutable, so a mutation returns the *new version* of the
target; callers write it to a new directory and switch to it (see
``alloy.streaming.incremental``), never rewriting the table they read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alloy.operators.dedup import Order, keep_one


def _norm(c: Column, dtype: T.DataType) -> Column:
    """Case-insensitive key part for strings, raw value otherwise."""
    return F.upper(c) if isinstance(dtype, T.StringType) else c


def _key_cond(left: DataFrame, right: DataFrame, keys: Sequence[str], rprefix: str) -> Column:
    cond = None
    for k in keys:
        dt = left.schema[k].dataType
        part = _norm(F.col(k), dt) == _norm(F.col(f"{rprefix}{k}"), dt)
        cond = part if cond is None else cond & part
    return cond


def _prefixed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{prefix}{k}") for k in keys]).distinct()


def insert_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target plus the batch rows whose (case-insensitive) key is not yet present."""
    existing = _prefixed(target, keys, "_t_")
    new = batch.join(existing, _key_cond(batch, existing, keys, "_t_"), "left_anti")
    return target.unionByName(new.select(*target.columns))


def one_per_key(source: DataFrame, keys: Sequence[str], order: Sequence[Order] = (), fold_case: bool = False) -> DataFrame:
    """Of source rows with equal keys the first by ``order``, then by all columns ascending.
    Rows with a NULL key equal no other and all stay."""
    parts = [_norm(F.col(k), source.schema[k].dataType) if fold_case else F.col(k) for k in keys]
    own = F.when(reduce(lambda a, b: a | b, [p.isNull() for p in parts]), F.monotonically_increasing_id())
    tagged = source.withColumns({f"_k{i}": p for i, p in enumerate(parts)} | {"_own": own})
    helpers = [*(f"_k{i}" for i in range(len(parts))), "_own"]
    return keep_one(tagged, helpers, [*order, *(Order(c) for c in source.columns)]).drop(*helpers)


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], when: Column,
                assignments: dict[str, str], order: Sequence[Order] = ()) -> DataFrame:
    """UPDATE target SET col = source.expr WHERE key matches AND ``when`` holds.

    ``assignments`` maps target column -> source column. Of source rows with equal
    (case-insensitive) keys the first by ``order`` counts, so target rows never multiply;
    non-matching or non-qualifying rows keep values.
    """
    source = one_per_key(source, keys, order, fold_case=True)
    src = source.select(*[F.col(k).alias(f"_s_{k}") for k in keys],
                        *[F.col(v).alias(f"_v_{c}") for c, v in assignments.items()],
                        F.lit(True).alias("_hit"))
    joined = target.join(src, _key_cond(target, src, keys, "_s_"), "left")
    apply = F.coalesce(F.col("_hit"), F.lit(False)) & F.coalesce(when, F.lit(False))
    out = [F.when(apply, F.col(f"_v_{c}").cast(target.schema[c].dataType))
           .otherwise(F.col(c)).alias(c) if c in assignments else F.col(c)
           for c in target.columns]
    return joined.select(*out)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str],
           update_cols: Sequence[str], order: Sequence[Order] = ()) -> DataFrame:
    """MERGE on a natural key: matched rows take the listed columns from the source and
    keep the others; unmatched source rows are inserted; untouched rows stay.

    One full outer join on the key. Of source rows with equal keys the first by ``order``
    counts (map-side, before the join), so no key is updated or inserted twice; a row with a
    NULL key matches nothing and is inserted.
    """
    source = one_per_key(source, keys, order)
    s = source.select(*[F.col(c).alias(f"_s_{c}") for c in source.columns],
                      F.lit(True).alias("_in_s"))
    t = target.withColumn("_in_t", F.lit(True))
    cond = None
    for k in keys:
        part = F.col(k) == F.col(f"_s_{k}")
        cond = part if cond is None else cond & part
    j = t.join(s, cond, "full_outer")
    in_t = F.coalesce(F.col("_in_t"), F.lit(False))
    in_s = F.coalesce(F.col("_in_s"), F.lit(False))
    out = []
    for c in target.columns:
        src_c = F.col(f"_s_{c}") if c in source.columns else F.lit(None)
        if c in keys:
            val = F.when(in_t, F.col(c)).otherwise(src_c)
        elif c in update_cols:
            val = F.when(in_s, src_c).otherwise(F.col(c))
        else:
            val = F.when(in_t, F.col(c)).otherwise(src_c)
        out.append(val.cast(target.schema[c].dataType).alias(c))
    return j.select(*out)


def replace_by_key(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Delete every target row whose key (case-insensitive) is in the batch, insert the batch."""
    keys = batch.select(F.upper(F.col(key).cast("string")).alias("_k")).distinct()
    kept = target.join(keys, F.upper(F.col(key).cast("string")) == F.col("_k"), "left_anti")
    return kept.unionByName(batch.select(*target.columns))


def remove_by_key(target: DataFrame, keys_to_remove: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Remove rows by key. Returns (remaining rows, report) where the report has one row
    per requested key: deleted count and REMOVED / NOT_FOUND."""
    req = keys_to_remove.select(F.upper(F.col(key).cast("string")).alias("_k")).distinct()
    tk = target.select(F.upper(F.col(key).cast("string")).alias("_k"))
    counts = tk.groupBy("_k").agg(F.count(F.lit(1)).alias("deleted"))
    report = (req.join(counts, "_k", "left")
              .select(F.col("_k").alias(key), F.coalesce(F.col("deleted"), F.lit(0)).alias("deleted"))
              .withColumn("status", F.when(F.col("deleted") > 0, F.lit("REMOVED"))
                          .otherwise(F.lit("NOT_FOUND"))))
    remaining = target.join(req, F.upper(F.col(key).cast("string")) == F.col("_k"), "left_anti")
    return remaining, report


def union_like(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL of unlike sources into one shape (by name, missing columns NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
