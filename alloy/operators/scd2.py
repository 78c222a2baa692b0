"""SCD Type 2 history, its incremental apply, flatten and normalize strategies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alloy.operators.dedup import Order, keep_one
from alloy.operators.windows import with_neighbors

FROM, TO, CURRENT, DELETED = "EFFECTIVE_FROM", "EFFECTIVE_TO", "IS_CURRENT", "IS_DELETED"


def scd2(df: DataFrame, keys: Sequence[str], ts: str, tracked: Sequence[str],
         op_col: str | None = None, delete_value: str = "DELETE", seq: str | None = None,
         bucket_seconds: int = 3_600) -> DataFrame:
    """Version history per key.

    1. collapse to the last row per (key, ts) by ``seq``;
    2. a row is a delete when ``op_col = delete_value``;
    3. drop a live row whose tracked columns equal (NULL-safe) the previous row's
       while the previous row is live; drop a delete that follows a delete or has no
       predecessor;
    4. EFFECTIVE_FROM = ts; EFFECTIVE_TO = next surviving ts (live) or ts (delete);
    5. IS_CURRENT = EFFECTIVE_TO IS NULL.
    Neighbours are found per (key, time bucket) so a hot key is not one task.
    """
    tie = [seq] if seq else []
    # equal times: the last by ``seq``, then the first by all columns, so one row is left
    df = keep_one(df, [*keys, ts], [Order(seq, desc=True)] if seq else [])
    is_del = (F.col(op_col) == delete_value) if op_col else F.lit(False)
    base = df.withColumn(DELETED, F.coalesce(is_del, F.lit(False)))
    nb = with_neighbors(base, keys, ts, tie, prev_cols=[*tracked, DELETED], bucket_seconds=bucket_seconds)
    same = F.lit(True)
    for c in tracked:
        same = same & F.col(c).eqNullSafe(F.col(f"prev_{c}"))
    prev_del = F.coalesce(F.col(f"prev_{DELETED}"), F.lit(False))
    has_prev = ~F.col("is_first")
    keep = F.when(F.col(DELETED), has_prev & ~prev_del).otherwise(~(has_prev & same & ~prev_del))
    kept = nb.filter(keep).select(*base.columns)
    nx = with_neighbors(kept, keys, ts, tie, next_cols=[ts], bucket_seconds=bucket_seconds)
    to = F.when(F.col(DELETED), F.col(ts)).otherwise(F.col(f"next_{ts}"))
    return (nx.withColumn(FROM, F.col(ts)).withColumn(TO, to)
            .withColumn(CURRENT, F.col(TO).isNull())
            .select(*base.columns, FROM, TO, CURRENT))


def scd2_apply(current: DataFrame, changes: DataFrame, log: DataFrame, keys: Sequence[str], ts: str,
               tracked: Sequence[str], op_col: str | None = None, seq: str | None = None,
               bucket_seconds: int = 3_600, delete_value: str = "DELETE") -> DataFrame:
    """Incremental SCD2: re-derive only the keys touched by ``changes``.

    ``log`` holds the earlier changes (the Bronze table that ``current`` was built from).
    A touched key's history is derived from all its logged and new changes, so changes may
    come in any order and more than once: a row that was dropped as a repeat survives when
    a late change comes between. Untouched keys pass through unchanged.
    """
    touched = changes.select(*keys).distinct()
    untouched = current.join(touched, list(keys), "left_anti").select(*current.columns)
    events = log.join(touched, list(keys), "left_semi").select(*changes.columns).unionByName(changes).distinct()
    fresh = scd2(events, keys, ts, tracked, op_col, delete_value=delete_value, seq=seq,
                 bucket_seconds=bucket_seconds)
    return untouched.unionByName(fresh.select(*current.columns))


def flatten_and_type(df: DataFrame, col: str, schema: T.StructType | str | None = None,
                     prefix: str = "") -> DataFrame:
    """Expand a JSON text column into typed top-level columns.

    With no schema, the schema is inferred by a distributed aggregate over the whole
    column (``schema_of_variant_agg``); only the schema string reaches the driver.
    """
    if schema is None:
        inferred = df.select(F.expr(f"schema_of_variant_agg(parse_json(`{col}`))").alias("s")).first()["s"]
        schema = inferred.replace("OBJECT<", "STRUCT<")
    parsed = F.from_json(F.col(col), schema)
    struct_t = df.select(parsed.alias("_p")).schema["_p"].dataType
    others = [F.col(c) for c in df.columns if c != col]
    return df.select(*others, *[parsed[f.name].alias(f"{prefix}{f.name}") for f in struct_t.fields])


def normalize(df: DataFrame, key: str, array_col: str,
              value_name: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split an array column into a child table (parent key, position, value)."""
    parent = df.select(*[c for c in df.columns if c != array_col],
                       F.size(F.col(array_col)).alias(f"n_{array_col}"))
    child = df.select(F.col(key), F.posexplode_outer(F.col(array_col)).alias("pos", value_name))
    return parent, child
