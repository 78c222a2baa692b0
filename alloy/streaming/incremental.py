"""Incremental (streaming) versions of the main operators on Structured Streaming.

A stream appends its micro-batches to a change log: plain Parquet, one ``batch_id=<n>``
folder per micro-batch, written in overwrite mode, so a replayed batch replaces itself and
nothing else is read or rewritten. The table's state is the batch operator over the log,
which makes it independent of the order and the lateness of the changes:

* ``stream_keep_latest`` (ST1): each batch is reduced to its own latest rows first;
* ``stream_immutable`` (ST2): rows later than the bound go to a log of their own and count;
* ``stream_scd2`` (ST3): the log holds every change, the history is derived from it;
* ``stream_aggregate`` (ST4): each batch is reduced to partial sums per window;
* ``refresh_stream`` (SNK3): the generic lag-refreshed target, last batch per key wins.

``compact`` folds a log into a base table that later reads take in place of the batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from alloy.operators.dedup import Order, immutable_fact, keep_latest, keep_one
from alloy.operators.scd2 import scd2

BATCH = "batch_id"
# fixed refresh lags offered for continuously refreshed targets
LAGS = {"1 minute": "1 minute", "5 minutes": "5 minutes", "1 hour": "1 hour", "1 day": "1 day"}


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType,
                   max_files_per_trigger: int | None = None, base_path: str | None = None) -> DataFrame:
    """File stream over a folder (or a single file inside ``base_path``)."""
    reader = spark.readStream.schema(schema)
    if base_path:
        reader = reader.option("basePath", base_path)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


# ---- the change log ------------------------------------------------------------------
def append_batch(batch: DataFrame, log: str, batch_id: int) -> None:
    batch.write.mode("overwrite").parquet(f"{log}/{BATCH}={batch_id}")


def read_log(spark: SparkSession, log: str, base: str | None = None) -> DataFrame | None:
    """All logged rows with their ``batch_id``; with ``base`` (made by ``compact``) its rows
    and the batches after it. None while nothing is logged."""
    parts = []
    for path in filter(None, (log, base)):
        try:
            parts.append(spark.read.parquet(path))
        except AnalysisException:
            continue
    if len(parts) < 2:
        return parts[0] if parts else None
    last = parts[1].agg(F.max(BATCH)).first()[0]
    return parts[0].filter(F.col(BATCH) > (-1 if last is None else last)).unionByName(parts[1])


def compact(spark: SparkSession, log: str, base: str, state: Callable[[DataFrame], DataFrame],
            old_base: str | None = None) -> None:
    """Write the state of all logged batches as a new base table, one folder named after the
    last of them. The log itself is left alone; its folders up to there may be dropped."""
    rows = read_log(spark, log, old_base)
    if rows is None:
        return
    last = rows.agg(F.max(BATCH)).first()[0]
    state(rows).drop(BATCH).write.mode("overwrite").parquet(f"{base}/{BATCH}={last}")


def _start(df: DataFrame, checkpoint: str, trigger: str | None, fn: Callable, mode: str = "append") -> StreamingQuery:
    w = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    w = w.trigger(availableNow=True) if trigger is None else w.trigger(processingTime=trigger)
    return w.foreachBatch(fn).start()


def _log_stream(src: DataFrame, log: str, checkpoint: str, trigger: str | None,
                reduce: Callable[[DataFrame], DataFrame] = lambda b: b) -> StreamingQuery:
    return _start(src, checkpoint, trigger, lambda batch, batch_id: append_batch(reduce(batch), log, batch_id))


# ---- operators -----------------------------------------------------------------------
def stream_keep_latest(src: DataFrame, keys: Sequence[str], order_cols: Sequence[str], log: str,
                       checkpoint: str, deleted: Callable[[], Column] | None = None,
                       trigger: str | None = None) -> StreamingQuery:
    """ST1: the log of a keep-latest Silver table; ``latest_state`` reads it."""
    return _log_stream(src, log, checkpoint, trigger,
                       lambda b: keep_latest(b, keys, order_cols, deleted() if deleted else None))


def latest_state(rows: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    return keep_latest(rows.drop(BATCH), keys, order_cols, None)


def stream_scd2(src: DataFrame, log: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """ST3: the log of every change; ``scd2_state`` derives the history."""
    return _log_stream(src, log, checkpoint, trigger)


def scd2_state(rows: DataFrame, keys: Sequence[str], ts: str, tracked: Sequence[str],
               op_col: str | None = None, seq: str | None = None) -> DataFrame:
    return scd2(rows.drop(BATCH).distinct(), keys, ts, tracked, op_col, seq=seq)


def stream_immutable(src: DataFrame, ts: str, late_seconds: int, log: str, late_log: str,
                     checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """ST2: the log of an immutable fact table. Rows more than ``late_seconds`` behind the
    latest time of the earlier batches are logged apart (``late_log``), not lost."""
    spark = src.sparkSession

    def split(batch: DataFrame, batch_id: int) -> None:
        seen = read_log(spark, log)
        newest = None if seen is None else seen.filter(F.col(BATCH) < batch_id).agg(F.max(ts)).first()[0]
        late = F.lit(False)
        if newest is not None:
            bound = F.lit(newest) - F.make_dt_interval(secs=F.lit(late_seconds))
            late = F.coalesce(F.col(ts) < bound, F.lit(False))
        append_batch(batch.filter(late), late_log, batch_id)
        append_batch(batch.filter(~late), log, batch_id)

    return _start(src, checkpoint, trigger, split)


def immutable_state(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key of the logged rows (of both logs, if their union is given)."""
    return immutable_fact(rows.drop(BATCH), keys, money=False)


def stream_aggregate(src: DataFrame, ts: str, window: str, dims: Sequence[str],
                     measures: dict[str, Callable[[], Column]], log: str, checkpoint: str,
                     trigger: str | None = None) -> StreamingQuery:
    """ST4: the log of a tumbling-window Gold aggregate. ``measures`` are sums or counts, so
    the batches' parts add up in ``aggregate_state`` however late their rows are."""
    def parts(batch: DataFrame) -> DataFrame:
        timed = batch.withColumn("_w", F.window(F.col(ts).cast("timestamp"), window))
        agg = timed.groupBy("_w", *dims).agg(*[m().alias(n) for n, m in measures.items()])
        return agg.select(F.col("_w.start").cast("timestamp_ntz").alias("window_start"),
                          F.col("_w.end").cast("timestamp_ntz").alias("window_end"), *dims, *measures)

    return _log_stream(src, log, checkpoint, trigger, parts)


def aggregate_state(rows: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return rows.groupBy("window_start", "window_end", *dims).agg(*[F.sum(m).alias(m) for m in measures])


def refresh_stream(src: DataFrame, transform: Callable[[DataFrame], DataFrame],
                   log: str, checkpoint: str, lag: str | None = None) -> StreamingQuery:
    """SNK3: a target refreshed every ``lag`` (``None`` = run what is available, then stop):
    each micro-batch is transformed and logged; ``refreshed_state`` upserts by key."""
    return _log_stream(src, log, checkpoint, LAGS.get(lag, lag) if lag else None, transform)


def refreshed_state(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return keep_one(rows, keys, [Order(BATCH, desc=True)]).drop(BATCH)
