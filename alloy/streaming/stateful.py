"""Streaming operators whose state lives in the state store.

Each operator is one query. Event time has a bound (``withWatermark``): state behind it is
dropped, results behind it are final and written once, and rows that come later than it are
written to a log of their own instead of vanishing. A micro-batch writes one folder
``batch_id=<n>`` in overwrite mode, split by ``kind`` (``emitted`` or ``late``), so a repeated
batch replaces itself; a reader's cost is that of what was emitted, not of the input.

* ``stream_latest`` (ST1, SNK3): the state holds the best row per key, a micro-batch emits the keys
  that it touched; every ``fold_every`` batches the emitted rows become a new base table;
* ``stream_facts`` (ST2): natural keys seen within the bound are in the state, each fact is
  emitted once;
* ``stream_history`` (ST3, S3i): the state holds a key's last version and the changes that the
  bound has not passed; a version is emitted when it opens and when it closes;
* ``stream_windows`` (ST4): a window is emitted once, when the bound passes its end.

What is late follows Spark's own rule, which each micro-batch can compute alone: in batch n an
event time is late if it is not after W(n - 1), where W(n) is the largest event time of the
batches before n less the delay, in milliseconds; a window is late if its end is. The
largest times are kept in one tiny file per batch. Rows without event time count as late.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from alloy.operators.dedup import Order, keep_one
from alloy.operators.scd2 import CURRENT, DELETED, FROM, TO
from alloy.streaming.incremental import BATCH, LAGS, compact, read_log

EVENT = "_event_time"
EMITTED, LATE = "emitted", "late"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


# ---- the bound -----------------------------------------------------------------------
def _newest(spark: SparkSession, clock: str, batch_id: int) -> int | None:
    """Largest event time (microseconds) of the batches up to ``batch_id``."""
    if batch_id < 0:
        return None
    row = spark.read.schema("newest long").json(f"{clock}/{BATCH}={batch_id}").first()
    return row["newest"] if row else None


def late_bound(spark: SparkSession, clock: str, batch_id: int, delay_seconds: int) -> int | None:
    """W(n - 1) for n = ``batch_id``, in microseconds; None while there is no bound."""
    newest = _newest(spark, clock, batch_id - 2)
    return None if newest is None else (newest // 1000 - delay_seconds * 1000) * 1000


def passed_bound(spark: SparkSession, log: str, delay_seconds: int) -> int | None:
    """Microseconds up to which the last batch made results final: changes after it wait in the
    state. None while there is no bound."""
    try:
        clocks = spark.read.schema(f"newest long, {BATCH} long").json(f"{log}/clock")
    except AnalysisException:
        return None
    last = clocks.agg(F.max(BATCH)).first()[0]
    return None if last is None else late_bound(spark, f"{log}/clock", last + 1, delay_seconds)


def _timed(src: DataFrame, ts: str) -> DataFrame:
    return src.withColumn(EVENT, F.col(ts).cast("timestamp"))


def _run(src: DataFrame, ts: str, delay_seconds: int, build: Callable[[DataFrame], DataFrame], late_time: Callable[[Column], Column],
         log: str, checkpoint: str, trigger: str | None) -> StreamingQuery:
    """One query: what ``build`` makes of the timely rows, and beside it the rows themselves, of
    which each batch keeps the late ones. Both branches read the same micro-batch."""
    spark = src.sparkSession
    timed = _timed(src, ts)
    out = build(timed.filter(F.col(EVENT).isNotNull()).withWatermark(EVENT, f"{delay_seconds} seconds"))
    emitted = out.select(F.struct(*out.columns).alias("out"), F.lit(None).cast(src.schema).alias("row"),
                         F.lit(None).cast("timestamp").alias(EVENT))
    plain = timed.select(F.lit(None).cast(out.schema).alias("out"), F.struct(*src.columns).alias("row"), EVENT)

    def sink(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        bound = late_bound(session, f"{log}/clock", batch_id, delay_seconds)
        time = F.col(EVENT)
        late = time.isNull() if bound is None else time.isNull() | (F.unix_micros(late_time(time)) <= bound)
        seen = Observation()
        watched = batch.observe(seen, F.max(F.unix_micros(EVENT)).alias("newest"), F.count(F.lit(1)).alias("n"))
        kept = watched.withColumn("kind", F.when(F.col("out").isNotNull(), EMITTED).when(F.col("row").isNotNull() & late, LATE))
        kept.filter(F.col("kind").isNotNull()).drop(EVENT).write.mode("overwrite").partitionBy("kind").parquet(f"{log}/rows/{BATCH}={batch_id}")
        newest = [x for x in (_newest(session, f"{log}/clock", batch_id - 1), seen.get["newest"]) if x is not None]
        (session.createDataFrame([(max(newest, default=None),)], "newest long").coalesce(1)
         .write.mode("overwrite").json(f"{log}/clock/{BATCH}={batch_id}"))

    stream = emitted.unionByName(plain).writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    stream = stream.trigger(availableNow=True) if trigger is None else stream.trigger(processingTime=trigger)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return stream.foreachBatch(sink).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _read(spark: SparkSession, log: str, kind: str, column: str) -> DataFrame | None:
    try:
        rows = spark.read.parquet(f"{log}/rows")
    except AnalysisException:  # no batch has written a row yet
        return None
    if column not in rows.columns:
        return None
    return rows.filter(F.col("kind") == kind).select(f"{column}.*")


def read_emitted(spark: SparkSession, log: str) -> DataFrame | None:
    """All emitted rows; None while nothing is written."""
    return _read(spark, log, EMITTED, "out")


def read_late(spark: SparkSession, log: str) -> DataFrame | None:
    """The late rows as they came in; None while nothing is written."""
    return _read(spark, log, LATE, "row")


# ---- facts and windows ---------------------------------------------------------------
def stream_facts(src: DataFrame, keys: Sequence[str], ts: str, delay_seconds: int, log: str, checkpoint: str,
                 trigger: str | None = None) -> StreamingQuery:
    """ST2: each natural key once (the first row to come); a key leaves the state when the
    bound passes its event time by the delay."""
    columns = src.columns
    return _run(src, ts, delay_seconds, lambda s: s.dropDuplicatesWithinWatermark(list(keys)).select(*columns),
                lambda time: time, log, checkpoint, LAGS.get(trigger, trigger) if trigger else None)


def stream_windows(src: DataFrame, ts: str, seconds: int, dims: Sequence[str], measures: dict[str, Callable[[], Column]],
                   delay_seconds: int, log: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """ST4: tumbling windows of ``seconds``, each emitted once when it is closed."""
    def build(timely: DataFrame) -> DataFrame:
        agg = timely.groupBy(F.window(EVENT, f"{seconds} seconds").alias("_w"), *dims).agg(*[m().alias(n) for n, m in measures.items()])
        return agg.select(F.col("_w.start").cast("timestamp_ntz").alias("window_start"),
                          F.col("_w.end").cast("timestamp_ntz").alias("window_end"), *dims, *measures)

    def end(time: Column) -> Column:
        width = seconds * 1_000_000
        return F.timestamp_micros((F.floor(F.unix_micros(time) / width) + 1) * width)

    return _run(src, ts, delay_seconds, build, end, log, checkpoint, LAGS.get(trigger, trigger) if trigger else None)


# ---- keep-latest ---------------------------------------------------------------------
def _descending(c: Column, dtype: T.DataType) -> Column:
    """An expression that orders a number or a time the other way round."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.bitwise_not(F.unix_micros(c.cast("timestamp")))
    if isinstance(dtype, T.TimestampType):
        return F.bitwise_not(F.unix_micros(c))
    if isinstance(dtype, T.DateType):
        return F.bitwise_not(F.unix_date(c))
    if isinstance(dtype, T.IntegralType):
        return F.bitwise_not(c)
    if isinstance(dtype, T.DecimalType):
        return -c
    raise TypeError(f"{dtype.simpleString()} does not order by descent; order by whole or decimal numbers, dates or times")


def stream_latest(src: DataFrame, keys: Sequence[str], order_cols: Sequence[str], log: str, checkpoint: str,
                  deleted: Callable[[], Column] | None = None, trigger: str | None = None, fold_every: int = 8) -> StreamingQuery:
    """ST1: the state holds one row per key, the one that ``keep_latest`` keeps (order columns
    descending, then all columns ascending, NULLs last). Partial states combine map-side, so a
    hot key is one row per task."""
    types = {f.name: f.dataType for f in src.schema.fields}
    rows = src if deleted is None else src.filter(~F.coalesce(deleted(), F.lit(False)))
    terms: list[Column] = []
    for i, c in enumerate(order_cols):
        terms += [F.col(c).isNull().alias(f"n{i}"), _descending(F.col(c), types[c]).alias(f"o{i}")]
    for i, c in enumerate(src.columns):
        terms += [F.col(c).isNull().alias(f"m{i}"), F.col(c).alias(f"v{i}")]
    best = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(F.struct(*terms)).alias("best"))
    latest = best.select(*[F.col(f"best.v{i}").alias(c) for i, c in enumerate(src.columns)])

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/rows/{BATCH}={batch_id}")
        if (batch_id + 1) % fold_every == 0:
            compact(batch.sparkSession, f"{log}/rows", f"{log}/base-{batch_id}", lambda r: latest_rows(r, keys), _last_base(batch.sparkSession, log, batch_id))
            (batch.sparkSession.createDataFrame([(f"{log}/base-{batch_id}",)], "base string").coalesce(1)
             .write.mode("overwrite").json(f"{log}/bases/{BATCH}={batch_id}"))

    stream = latest.writeStream.option("checkpointLocation", checkpoint).outputMode("update")
    stream = stream.trigger(availableNow=True) if trigger is None else stream.trigger(processingTime=LAGS.get(trigger, trigger))
    return stream.foreachBatch(sink).start()


def latest_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of each key's last batch, with its ``batch_id``."""
    return keep_one(rows, keys, [Order(BATCH, desc=True)])


def _last_base(spark: SparkSession, log: str, before: int) -> str | None:
    try:
        bases = spark.read.schema(f"base string, {BATCH} long").json(f"{log}/bases")
    except AnalysisException:
        return None
    found = bases.filter(F.col(BATCH) < before).agg(F.max_by("base", BATCH)).first()
    return found[0] if found else None


def read_latest(spark: SparkSession, log: str, keys: Sequence[str]) -> DataFrame | None:
    """The table: the last base and the batches after it."""
    rows = read_log(spark, f"{log}/rows", _last_base(spark, log, 1 << 62))
    return None if rows is None else latest_rows(rows, keys).drop(BATCH)


# ---- history -------------------------------------------------------------------------
class Versions(StatefulProcessor):
    """SCD2 of one key: changes wait until the bound has passed them, then join the history in
    order of time. ``last`` is the last change seen, kept or dropped, and the open version."""

    def __init__(self, columns: list[str], ts_micros: str, seq: str | None, tracked: list[str], change_ddl: str, last_ddl: str):
        self.columns, self.ts, self.seq, self.tracked = columns, ts_micros, seq, tracked
        self.change_ddl, self.last_ddl = change_ddl, last_ddl
        self.version = Row(*columns, "to_micros")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.change_ddl)
        self.last = handle.getValueState("last", self.last_ddl)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [tuple(r[c] for c in self.columns) for r in rows]
        self.waiting.appendList(new)
        at = self.columns.index(self.ts)
        self.handle.registerTimer(-(min(r[at] for r in new) // -1000))
        return iter(())

    def better(self, row: tuple, than: tuple | None) -> bool:
        """Of changes at one time: the last by ``seq``, then the first by all columns."""
        if than is None:
            return True
        if self.seq is not None:
            i = self.columns.index(self.seq)
            a, b = row[i], than[i]
            if a != b:
                return b is None or (a is not None and a > b)
        return _orderable(row) < _orderable(than)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        bound = timerValues.getCurrentWatermarkInMs() * 1000
        at, gone = self.columns.index(self.ts), self.columns.index(DELETED)
        of_time: dict[int, tuple] = {}
        later = []
        for r in self.waiting.get():
            row = tuple(r)
            if row[at] > bound:
                later.append(row)
            elif self.better(row, of_time.get(row[at])):
                of_time[row[at]] = row
        if not of_time:
            return
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(-(min(r[at] for r in later) // -1000))
        else:
            self.waiting.clear()
        held = self.last.get() if self.last.exists() else None
        seen = tuple(held)[:len(self.columns)] if held else None      # the last change
        kept = tuple(held)[len(self.columns):-1] if held and held[-1] else None   # the open version
        places = [self.columns.index(c) for c in self.tracked]
        for time in sorted(of_time):
            row = of_time[time]
            if row[gone]:
                keep = seen is not None and not seen[gone]
            else:
                keep = seen is None or seen[gone] or any(row[i] != seen[i] for i in places)
            seen = row
            if not keep:
                continue
            if kept is not None:
                yield self.version(*kept, time)
            if row[gone]:
                yield self.version(*row, time)
                kept = None
            else:
                yield self.version(*row, None)
                kept = row
        blank = (None,) * len(self.columns)
        self.last.update((*seen, *(kept or blank), kept is not None))


def _orderable(row: tuple) -> list[tuple]:
    """NULLs after all values."""
    return [(1, 0) if v is None else (0, v) for v in row]


def stream_history(src: DataFrame, keys: Sequence[str], ts: str, tracked: Sequence[str], delay_seconds: int, log: str, checkpoint: str,
                   op_col: str | None = None, delete_value: str = "DELETE", seq: str | None = None,
                   trigger: str | None = None) -> StreamingQuery:
    """ST3: ``scd2`` as a stream; ``read_history`` reads it. A key's state is its last change, its
    open version and the changes of the last ``delay_seconds``."""
    columns = src.columns
    micros = "_micros"
    changes = [f for f in src.schema.fields]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in changes), f"{DELETED} boolean", f"{micros} long"])
    names = [f.name for f in changes] + [DELETED, micros]
    last = ", ".join([ddl, *(f"`open_{f.name}` {f.dataType.simpleString()}" for f in changes), f"open_{DELETED} boolean",
                      f"open_{micros} long", "is_open boolean"])

    def build(timely: DataFrame) -> DataFrame:
        is_del = F.coalesce(F.col(op_col) == delete_value, F.lit(False)) if op_col else F.lit(False)
        rows = timely.withColumn(DELETED, is_del).withColumn(micros, F.unix_micros(F.timestamp_micros(F.unix_micros(EVENT))))
        out = rows.groupBy(*keys).transformWithState(
            Versions(names, micros, seq, list(tracked), ddl, last), f"{ddl}, to_micros long", "Append", "EventTime")
        ended = F.timestamp_micros("to_micros").cast(src.schema[ts].dataType)
        return out.select(*columns, DELETED, F.col(ts).alias(FROM), ended.alias(TO))

    return _run(src, ts, delay_seconds, build, lambda time: time, log, checkpoint, LAGS.get(trigger, trigger) if trigger else None)


def read_history(spark: SparkSession, log: str, keys: Sequence[str]) -> DataFrame | None:
    """The versions emitted so far: of a version's opening and its closing the latter."""
    rows = read_emitted(spark, log)
    if rows is None:
        return None
    return keep_one(rows, [*keys, FROM], [Order(TO)]).withColumn(CURRENT, F.col(TO).isNull())
