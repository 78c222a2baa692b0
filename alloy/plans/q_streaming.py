"""Streaming queries: each writes its table as several files, in no order of time, under the
shared checkpoint dir, streams it one file per micro-batch (more of a large table, of some FILE_BYTES
each), and returns the resulting state.
Their oracles are the batch operators' SQL: streaming must equal batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from alloy.operators.dedup import Order, keep_one
from alloy.operators.scd2 import scd2_apply
from alloy.plans.fixtures import t
from alloy.plans.q_history import SCD2_SQL
from alloy.plans.q_silver import LINEITEM_COLS, LINEITEM_TIEBREAK
from alloy.plans.registry import query
from alloy.session import planned_bytes, scratch_path
from alloy.streaming import incremental as ST
from alloy.streaming import stateful as SF

MICRO_BATCHES = 3
#: estimated bytes of a file of a stream
FILE_BYTES = 32 << 20


def _stream(spark, name: str, df):
    """(stream of ``df`` in MICRO_BATCHES micro-batches, log folder, late log, checkpoint)."""
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex}")
    files = files_each(df)
    df.repartition(MICRO_BATCHES * files, F.xxhash64(*df.columns)).write.parquet(f"{base}/in")
    return ST.parquet_stream(spark, f"{base}/in", df.schema, files), f"{base}/log", f"{base}/late", f"{base}/_checkpoint"


def files_each(df) -> int:
    """Files of a micro-batch: no task writes or reads more than a file, however large the table."""
    return max(1, -(-planned_bytes(df) // (MICRO_BATCHES * FILE_BYTES)))


@query("stream_keep_latest", f"""
SELECT {LINEITEM_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY l_shipdate DESC NULLS LAST, {LINEITEM_TIEBREAK}) AS rn
  FROM lineitem WHERE NOT coalesce(l_returnflag = 'R', false)) WHERE rn = 1""", ("ST1",))
def q_stream_keep_latest(spark, sf):
    keys = ["l_orderkey", "l_linenumber"]
    src, log, _, ck = _stream(spark, "keep_latest", t(spark, sf, "lineitem"))
    ST.stream_keep_latest(src, keys, ("l_shipdate",), log, ck, deleted=lambda: F.col("l_returnflag") == "R").awaitTermination()
    return ST.latest_state(ST.read_log(spark, log), keys, ("l_shipdate",))


@query("stream_immutable", "SELECT * FROM events", ("ST2",))
def q_stream_immutable(spark, sf):
    """Every fifth event arrives twice; files hold all times, so later batches hold late rows."""
    e = t(spark, sf, "events")
    twice = e.unionByName(e.filter(F.col("event_id") % 5 == 0)).withColumn("_copy", F.monotonically_increasing_id())
    src, log, late, ck = _stream(spark, "immutable", twice)
    ST.stream_immutable(src.drop("_copy"), "ts", 3600, log, late, ck).awaitTermination()
    rows = ST.read_log(spark, log).unionByName(ST.read_log(spark, late))
    return ST.immutable_state(rows, ["event_id"])


@query("stream_scd2", f"""
WITH {SCD2_SQL}
SELECT user_id, event_id, event_type, EFFECTIVE_FROM, EFFECTIVE_TO, EFFECTIVE_TO IS NULL AS IS_CURRENT, IS_DELETED
FROM v""", ("ST3", "S3i"))
def q_stream_scd2(spark, sf):
    e = t(spark, sf, "events").select(
        "user_id", "ts", "event_id", "event_type",
        F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE")
        .otherwise("UPDATE").alias("_OPERATION"))
    src, log, _, ck = _stream(spark, "scd2", e)
    ST.stream_scd2(src, log, ck).awaitTermination()
    return ST.scd2_state(ST.read_log(spark, log), ["user_id"], "ts", ["event_type"], "_OPERATION", "event_id").select(
        "user_id", "event_id", "event_type", "EFFECTIVE_FROM", "EFFECTIVE_TO", "IS_CURRENT", "IS_DELETED")


@query("stream_aggregate", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       event_type, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total_value
FROM events GROUP BY 1, 2, 3""", ("ST4",))
def q_stream_aggregate(spark, sf):
    src, log, _, ck = _stream(spark, "aggregate", t(spark, sf, "events"))
    measures = {"n_events": lambda: F.count(F.lit(1)), "total_value": lambda: F.sum(F.col("value").cast("decimal(18,4)"))}
    ST.stream_aggregate(src, "ts", "1 hour", ["event_type"], measures, log, ck).awaitTermination()
    return ST.aggregate_state(ST.read_log(spark, log), ["event_type"], list(measures))


@query("stream_refresh", """
SELECT user_id, count(*) AS n_events, max(ts) AS last_ts
FROM events GROUP BY user_id""", ("SNK3",))
def q_stream_refresh(spark, sf):
    """A refreshed target of one row per user and batch, folded into a base and read back."""
    e = t(spark, sf, "events")
    src, log, base, ck = _stream(spark, "refresh", e.select("event_id", "user_id", "ts"))
    ST.refresh_stream(src, lambda b: keep_one(b, ["event_id"], [Order("ts", desc=True)]), log, ck).awaitTermination()
    ST.compact(spark, log, base, lambda rows: ST.refreshed_state(rows, ["event_id"]))
    rows = ST.refreshed_state(ST.read_log(spark, log, base), ["event_id"])
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("last_ts"))


# ---- state in the state store ----------------------------------------------------------
# Events arrive by weeks; one in fifty two weeks late, one in five a second time a week later.
ARRIVALS, DELAY = 6, 3600
WEEK_SQL = "least((dayofmonth(ts) - 1) // 7, 3)"
ARRIVALS_SQL = f"""weeks AS (SELECT *, {WEEK_SQL} AS week FROM events),
once AS (SELECT *, week + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END AS arrival FROM weeks),
twice AS (SELECT * FROM once UNION ALL SELECT * REPLACE (arrival + 1 AS arrival) FROM once WHERE event_id % 5 = 1 AND arrival < {ARRIVALS - 1}),
newest AS (SELECT b, (SELECT max(epoch_us(ts)) FROM once WHERE arrival <= b - 2) // 1000 * 1000 AS seen FROM range({ARRIVALS}) r(b))"""


def _arrivals(spark, name: str, events, again: bool):
    """Stream of the events, one file per arrival in this order; log folder and checkpoint."""
    week = F.least(F.floor((F.dayofmonth("ts") - 1) / 7), F.lit(3))
    rows = events.withColumn("arrival", week + F.when(F.col("event_id") % 50 == 0, 2).otherwise(0))
    if again:
        more = rows.filter((F.col("event_id") % 5 == 1) & (F.col("arrival") < ARRIVALS - 1))
        rows = rows.unionByName(more.withColumn("arrival", F.col("arrival") + 1))
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex}")
    for i in range(ARRIVALS):
        rows.filter(F.col("arrival") == i).drop("arrival").coalesce(1).write.mode("append").parquet(f"{base}/in")
    return ST.parquet_stream(spark, f"{base}/in", events.schema, 1), f"{base}/log", f"{base}/_checkpoint"


@query("stream_facts_once", f"""
WITH {ARRIVALS_SQL},
timely AS (SELECT twice.* EXCLUDE (week, arrival), coalesce(epoch_us(ts) <= seen - {DELAY * 1_000_000}, false) AS late
           FROM twice JOIN newest ON b = arrival)
SELECT * EXCLUDE (late), bool_and(late) AS was_late FROM timely GROUP BY ALL""", ("ST2",))
def q_stream_facts_once(spark, sf):
    """Each event once, though some come twice; those that came behind the bound are marked."""
    src, log, ck = _arrivals(spark, "facts", t(spark, sf, "events"), again=True)
    SF.stream_facts(src, ["event_id"], "ts", DELAY, log, ck).awaitTermination()
    facts, late = SF.read_emitted(spark, log), SF.read_late(spark, log)
    missed = keep_one(late.join(facts, "event_id", "left_anti").select(*facts.columns), ["event_id"], [])
    return facts.withColumn("was_late", F.lit(False)).unionByName(missed.withColumn("was_late", F.lit(True)))


@query("stream_windows_closed", f"""
WITH {ARRIVALS_SQL},
w AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end FROM once),
l AS (SELECT w.*, coalesce(epoch_us(window_end) <= seen - {DELAY * 1_000_000}, false) AS late FROM w JOIN newest ON b = arrival),
g AS (SELECT window_start, window_end, event_type, count(*) FILTER (NOT late) AS n_events,
             CAST(sum(CAST(value AS DECIMAL(18,4))) FILTER (NOT late) AS DOUBLE) AS total_value, count(*) FILTER (late) AS n_late
      FROM l GROUP BY 1, 2, 3)
SELECT window_start, window_end, event_type, n_events, total_value, n_late FROM g
WHERE n_events > 0 AND epoch_us(window_end) <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - {DELAY * 1_000_000}""", ("ST4",))
def q_stream_windows_closed(spark, sf):
    """Windows that the bound has passed, each emitted once, and how many rows came too late for them."""
    src, log, ck = _arrivals(spark, "windows", t(spark, sf, "events"), again=False)
    measures = {"n_events": lambda: F.count(F.lit(1)), "total_value": lambda: F.sum(F.col("value").cast("decimal(18,4)"))}
    SF.stream_windows(src, "ts", 3600, ["event_type"], measures, DELAY, log, ck).awaitTermination()
    late = SF.read_late(spark, log)
    missed = late.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour")["start"].cast("timestamp_ntz").alias("window_start"), "event_type").agg(
        F.count(F.lit(1)).alias("n_late"))
    return SF.read_emitted(spark, log).join(missed, ["window_start", "event_type"], "left").fillna(0, ["n_late"])


@query("stream_latest_state", f"""
SELECT {LINEITEM_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY l_shipdate DESC NULLS LAST, {LINEITEM_TIEBREAK}) AS rn
  FROM lineitem WHERE NOT coalesce(l_returnflag = 'R', false)) WHERE rn = 1""", ("ST1", "SNK3"))
def q_stream_latest_state(spark, sf):
    keys = ["l_orderkey", "l_linenumber"]
    src, log, _, ck = _stream(spark, "latest", t(spark, sf, "lineitem"))
    SF.stream_latest(src, keys, ["l_shipdate"], log, ck, deleted=lambda: F.col("l_returnflag") == "R", fold_every=2).awaitTermination()
    return SF.read_latest(spark, log, keys)


@query("stream_history_state", f"""
WITH {SCD2_SQL}
SELECT user_id, event_id, event_type, EFFECTIVE_FROM, EFFECTIVE_TO, EFFECTIVE_TO IS NULL AS IS_CURRENT, IS_DELETED
FROM v""", ("ST3", "S3i"))
def q_stream_history_state(spark, sf):
    """Versions as the state emitted them; keys with changes that came late, or that the bound has
    not passed yet, are derived again."""
    e = t(spark, sf, "events").select(
        "user_id", "ts", "event_id", "event_type",
        F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE")
        .otherwise("UPDATE").alias("_OPERATION"))
    src, log, ck = _arrivals(spark, "history", e, again=False)
    SF.stream_history(src, ["user_id"], "ts", ["event_type"], DELAY, log, ck, op_col="_OPERATION", seq="event_id").awaitTermination()
    waiting = e.filter(F.unix_micros(F.col("ts").cast("timestamp")) > SF.passed_bound(spark, log, DELAY))
    history = scd2_apply(SF.read_history(spark, log, ["user_id"]), SF.read_late(spark, log).unionByName(waiting), e, ["user_id"], "ts",
                         ["event_type"], "_OPERATION", "event_id")
    return history.select("user_id", "event_id", "event_type", "EFFECTIVE_FROM", "EFFECTIVE_TO", "IS_CURRENT", "IS_DELETED")
