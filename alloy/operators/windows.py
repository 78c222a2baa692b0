"""Per-entity time windows that stay distributed when one entity is hot.

A plain ``Window.partitionBy(entity)`` sends every row of an entity to one task,
so an entity holding a third of the data becomes a single-task stage. The helpers
here partition by ``(entity, time bucket)`` instead:

* ``range_frames`` — RANGE frames of all lengths by one sweep over the times at which the
  entity's values enter and leave them; no task holds more than one time block of one entity.
* ``with_neighbors`` — lag/lead: computed inside (entity, bucket), then the first
  and last row of every bucket are fixed from a per-bucket summary (one row per
  non-empty bucket) that carries the previous bucket's last row and the next
  bucket's first row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alloy.operators.dedup import ntz_micros

MICROS = 1_000_000


def micros(df: DataFrame, ts: str) -> Column:
    dt = df.schema[ts].dataType
    if isinstance(dt, T.TimestampNTZType):
        return ntz_micros(F.col(ts))
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(F.col(ts))
    return F.col(ts).cast("long")


def with_neighbors(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str],
                   prev_cols: Sequence[str] = (), next_cols: Sequence[str] = (),
                   bucket_seconds: int = 3_600, prefix_prev: str = "prev_",
                   prefix_next: str = "next_") -> DataFrame:
    """``lag`` of ``prev_cols`` and ``lead`` of ``next_cols`` per entity ordered by
    ``(ts, *tiebreak)``, computed per (entity, time bucket) plus a boundary fix."""
    cols = df.columns
    width = bucket_seconds * MICROS
    order = ["_t", *tiebreak]
    base = (df.withColumn("_t", micros(df, ts))
            .withColumn("_b", F.floor(F.col("_t") / F.lit(width))))
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    inner = base.withColumn("_first", F.lag(F.lit(1)).over(w).isNull()) \
                .withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    for c in prev_cols:
        inner = inner.withColumn(f"_lag_{c}", F.lag(F.col(c)).over(w))
    for c in next_cols:
        inner = inner.withColumn(f"_lead_{c}", F.lead(F.col(c)).over(w))

    # one row per non-empty (entity, bucket): its first and last rows
    summ = base.groupBy(*keys, "_b").agg(
        F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in next_cols])).alias("_fr"),
        F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in prev_cols])).alias("_lr"))
    sw = Window.partitionBy(*keys).orderBy("_b")
    summ = (summ.withColumn("_prev_last", F.lag("_lr").over(sw))
            .withColumn("_next_first", F.lead("_fr").over(sw))
            .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"),
                    "_prev_last", "_next_first"))
    cond = F.col("_b") == F.col("_kb")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = inner.join(summ, cond, "left")
    out = [F.col(c) for c in cols]
    for c in prev_cols:
        out.append(F.when(F.col("_first"), F.col(f"_prev_last.{c}"))
                   .otherwise(F.col(f"_lag_{c}")).alias(f"{prefix_prev}{c}"))
    for c in next_cols:
        out.append(F.when(F.col("_last"), F.col(f"_next_first.{c}"))
                   .otherwise(F.col(f"_lead_{c}")).alias(f"{prefix_next}{c}"))
    out.append(F.col("_first").alias("_bucket_first"))
    joined = joined.withColumn("_is_first_overall",
                               F.col("_first") & F.col("_prev_last").isNull())
    out.append(F.col("_is_first_overall").alias("is_first"))
    return joined.select(*out).drop("_bucket_first")


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    rank_name: str = "rank") -> DataFrame:
    """Top-k rows per group (``row_number() <= k``).

    The filter sits directly on the rank, so Catalyst plans a ``WindowGroupLimit`` both
    before the shuffle (each map task keeps its own top k per group) and after it: a
    group holding a third of all rows reaches its final task as at most k rows per map
    task. ``order`` must be a total order (end it in a unique column).
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w)).filter(F.col(rank_name) <= k)


def range_frames(df: DataFrame, keys: Sequence[str], ts: str,
                 specs: Sequence[tuple[str, Column | None, int]],
                 block_seconds: int = 3_600) -> DataFrame:
    """RANGE-frame sums with no task holding more than one time block of one entity.

    For each ``(name, value, length_seconds)`` (``value`` None = row count) adds the sum
    of ``value`` over the entity's rows with time in ``[t - length, t]`` (peers at ``t``
    included), by one sweep for all lengths:

    1. rows are pre-aggregated to points, one per (entity, time) (map-side combine);
    2. a point enters all frames at its time and leaves those of a length L just after
       ``t + L``: an event each, with the point's sums, negative on leaving;
    3. events are sorted per (entity, ``block_seconds`` block) once and summed up; what the
       entity's earlier blocks add up to is a prefix over one row per block (as many rows as
       the entity has hours with events, whatever its number of rows), joined to the sorted
       events without moving them;
    4. the sums at the entering events join back to the rows on (entity, time).

    As SQL has it, rows with NULL keys are one entity, rows with NULL time are each
    other's only peers, and a frame without non-NULL values sums to NULL. Sums must be
    exact (integers or decimals), as leaving takes away what entering added.
    """
    width = block_seconds * MICROS
    names = [s[0] for s in specs]
    base = df.withColumn("_t", micros(df, ts)).withColumn("_key", F.struct(*[F.col(k) for k in keys]))
    # each sum, and beside it the number of its values
    aggs, lengths_of = [], {}
    for i, (_, value, length) in enumerate(specs):
        total = F.count(F.lit(1)) if value is None else F.sum(value)
        aggs.append(F.coalesce(total, F.lit(0)).alias(f"_s{i}"))
        aggs.append(F.count(F.lit(1) if value is None else value).alias(f"_n{i}"))
        lengths_of[f"_s{i}"] = lengths_of[f"_n{i}"] = length
    sums = list(lengths_of)

    def named(part: DataFrame) -> list[Column]:
        return [(F.col(f"_s{i}") if value is None else F.when(F.col(f"_n{i}") > 0, F.col(f"_s{i}"))).alias(name)
                for i, (name, value, _) in enumerate(specs)]

    timed, untimed = base.filter(F.col("_t").isNotNull()), base.filter(F.col("_t").isNull())
    points = timed.groupBy("_key", "_t").agg(*aggs)
    # one event per point and length, and the entering one (length NULL), as rows of one scan
    leaving = [F.struct(F.lit(length).cast("long").alias("_len"), (F.col("_t") + length * MICROS + 1).alias("_e"),
                        *[(-F.col(s) if lengths_of[s] == length else F.lit(0)).cast(points.schema[s].dataType).alias(s) for s in sums])
               for length in sorted(set(lengths_of.values()))]
    entering = F.struct(F.lit(None).cast("long").alias("_len"), F.col("_t").alias("_e"), *[F.col(s) for s in sums])
    events = points.select("_key", F.explode(F.array(entering, *leaving)).alias("_x")).select(
        "_key", F.floor(F.col("_x._e") / F.lit(width)).alias("_blk"), "_x.*")
    earlier = Window.partitionBy("_key").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = events.groupBy("_key", "_blk").agg(*[F.sum(s).alias(f"_b{s}") for s in sums])
    blocks = blocks.select("_key", "_blk", *[F.coalesce(F.sum(f"_b{s}").over(earlier), F.lit(0)).alias(f"_o{s}") for s in sums])
    # what leaves at a time has left before what enters then is counted
    inside = Window.partitionBy("_key", "_blk").orderBy("_e", F.col("_len").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    swept = events.select("_key", "_blk", "_e", "_len", *[F.sum(s).over(inside).alias(s) for s in sums])
    swept = swept.filter(F.col("_len").isNull()).join(blocks, ["_key", "_blk"]).select(
        "_key", F.col("_e").alias("_t"), *[(F.col(s) + F.col(f"_o{s}")).alias(s) for s in sums])
    res = swept.select("_key", "_t", *named(swept))
    peers = untimed.groupBy("_key").agg(*aggs)
    peers = peers.select("_key", *[c.cast(res.schema[n].dataType).alias(n) for c, n in zip(named(peers), names, strict=True)])
    return (timed.join(res, ["_key", "_t"]).select(*df.columns, *names)
            .unionByName(untimed.join(peers, "_key").select(*df.columns, *names)))
