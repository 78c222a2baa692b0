"""Streams on the state store: final results once, late rows logged, state dropped, equal to batch."""

from __future__ import annotations

import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from alloy.operators.dedup import keep_latest
from alloy.operators.scd2 import scd2, scd2_apply
from alloy.streaming import incremental as ST
from alloy.streaming import stateful as SF

START = datetime(2024, 1, 1)
SCHEMA = "k string, id long, ts timestamp_ntz, v double, op string"


@pytest.fixture()
def tmp(spark):
    return tempfile.mkdtemp(prefix="alloy-test-")


def row(k, id_, minute, v=1.0, op="UPDATE", micro=0):
    return k, id_, None if minute is None else START + timedelta(minutes=minute, microseconds=micro), v, op


def arriving(spark, tmp, batches):
    """Stream of the batches, one file each, in this order."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    schema = spark.createDataFrame([], SCHEMA).schema
    return ST.parquet_stream(spark, f"{tmp}/in", schema, 1), f"{tmp}/log", f"{tmp}/ck"


def ids(df):
    return sorted(r["id"] for r in df.collect())


BATCHES = [[row("a", 1, 0), row("a", 2, 5), row("b", 3, 100)], [row("a", 4, 90), row("b", 3, 100), row("b", 5, 200)],
           # behind 100 - 30 minutes, the bound that this batch goes by
           [row("a", 6, 69), row("a", 7, 71), row("a", 8, None), row("b", 5, 200)], [row("c", 9, 500), row("c", 10, 169), row("c", 11, 171)]]


def test_facts_once_and_late_rows_logged(spark, tmp):
    src, log, ck = arriving(spark, tmp, BATCHES)
    q = SF.stream_facts(src, ["id"], "ts", 1800, log, ck)
    q.awaitTermination()
    assert ids(SF.read_emitted(spark, log)) == [1, 2, 3, 4, 5, 7, 9, 11]
    assert ids(SF.read_late(spark, log)) == [6, 8, 10]
    state = [op for p in q.recentProgress for op in p.stateOperators]
    assert sum(op.numRowsDroppedByWatermark for op in state) == 2          # the rest of the log has no time at all
    assert state[-1].numRowsTotal == 1                                     # the key of minute 500; all others are dropped
    again = SF.read_emitted(spark, log).count()
    SF.stream_facts(src, ["id"], "ts", 1800, log, ck).awaitTermination()   # nothing new: nothing changes
    assert SF.read_emitted(spark, log).count() == again


def test_windows_are_emitted_once_when_closed(spark, tmp):
    src, log, ck = arriving(spark, tmp, BATCHES)
    q = SF.stream_windows(src, "ts", 3600, ["k"], {"n": lambda: F.count(F.lit(1)), "total": lambda: F.sum(F.col("v").cast("decimal(18,4)"))},
                          1800, log, ck)
    q.awaitTermination()
    got = sorted((r["k"], int((r["window_start"] - START).total_seconds() // 3600), r["n"]) for r in SF.read_emitted(spark, log).collect())
    # hour 0 closes before minute 69 comes, hour 1 is open then; minute 169 is in time for hour 2
    assert got == [("a", 0, 2), ("a", 1, 3), ("b", 1, 2), ("b", 3, 2), ("c", 2, 2)]
    assert ids(SF.read_late(spark, log)) == [8]
    assert [op for p in q.recentProgress for op in p.stateOperators][-1].numRowsTotal == 1
    rows = [r for b in BATCHES for r in b if r[2] is not None]
    assert sum(n for *_, n in got) + 1 == len(rows)                        # minute 500 is in an open window


def test_history_opens_and_closes_versions(spark, tmp):
    batches = [[row("a", 1, 0, 1.0), row("a", 2, 10, 1.0), row("a", 3, 20, 2.0), row("b", 4, 0, op="DELETE"), row(None, 5, 1, 7.0)],
               [row("a", 6, 20, 3.0), row("b", 7, 300, 5.0), row(None, 8, 40, 7.0)],
               [row("a", 9, 280, None, op="DELETE"), row("a", 10, 290, 4.0), row("a", 11, 600, 4.0), row("a", 12, 5, 9.0)],
               [row("b", 13, 700, 5.0), row("b", 14, 700, 6.0), row("b", 15, 800, op="DELETE"), row("c", 16, 900, micro=7)]]
    src, log, ck = arriving(spark, tmp, batches)
    every = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    args = (["k"], "ts", ["v"])
    SF.stream_history(src, *args, 600, log, ck, op_col="op", seq="id").awaitTermination()
    emitted, late = SF.read_emitted(spark, log), SF.read_late(spark, log)
    assert ids(late) == [12]
    opened = emitted.groupBy("k", "EFFECTIVE_FROM").agg(F.count_if(F.col("EFFECTIVE_TO").isNull()).alias("o"), F.count("EFFECTIVE_TO").alias("c"))
    assert opened.filter("o > 1 OR c > 1").count() == 0                    # each opens once and closes once
    bound = SF.passed_bound(spark, log, 600)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    timely = every.join(late.select("id"), "id", "left_anti").select(*every.columns)
    key = ["k", "id", "EFFECTIVE_FROM", "EFFECTIVE_TO", "IS_CURRENT", "IS_DELETED"]

    def listed(df):
        return sorted((tuple(r) for r in df.select(*key).collect()), key=repr)

    history = SF.read_history(spark, log, ["k"])
    assert listed(history) == listed(scd2(timely.filter(micros <= bound), *args, "op", seq="id"))
    # the late row and those that still wait: their keys are derived again
    more = late.unionByName(every.filter(micros > bound))
    full = scd2_apply(history, more.filter(F.col("k").isNotNull()), every, *args, "op", "id")
    assert listed(full) == listed(scd2(every, *args, "op", seq="id"))


@pytest.mark.parametrize("fold_every", [1, 2, 100])
def test_latest_state_equals_batch(spark, tmp, fold_every):
    """Ties, NULL times and deletes; the table is read from the last base and the batches after it."""
    batches = [[row("a", 1, 5), row("a", 2, None), row("b", 3, 5, 2.0), row("b", 4, 5, 1.0)],
               [row("a", 5, 4), row("c", 6, 1, op="DELETE"), row("b", 7, 5, None)], [row("a", 8, 6, op="DELETE"), row("d", 9, 7), row(None, 10, 7)],
               [row("d", 11, 7, 0.5), row("a", 12, 9)], [row("b", 13, 1), row(None, 14, 6)]]
    src, log, ck = arriving(spark, tmp, batches)
    SF.stream_latest(src, ["k"], ["ts"], log, ck, deleted=lambda: F.col("op") == "DELETE", fold_every=fold_every).awaitTermination()
    every = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    want = keep_latest(every, ["k"], ("ts",), F.col("op") == "DELETE")
    assert sorted(SF.read_latest(spark, log, ["k"]).collect(), key=repr) == sorted(want.collect(), key=repr)


def test_nothing_has_come(spark, tmp):
    src, log, ck = arriving(spark, tmp, [[]])
    SF.stream_facts(src, ["id"], "ts", 60, log, ck).awaitTermination()
    assert SF.read_emitted(spark, log) is None and SF.read_late(spark, log) is None


def test_text_does_not_order_latest_rows(spark, tmp):
    src, log, ck = arriving(spark, tmp, [[row("a", 1, 1)]])
    with pytest.raises(TypeError):
        SF.stream_latest(src, ["k"], ["op"], log, ck)


def test_a_large_stream_has_several_files_a_batch(spark, monkeypatch):
    """As many micro-batches as for a small table, each of several files, and the same table."""
    from alloy.plans import q_streaming as Q
    monkeypatch.setattr(Q, "FILE_BYTES", 1 << 12)
    df = spark.range(20_000).select(F.col("id"), (F.col("id") % 7).alias("n")).repartition(2)
    assert Q.files_each(df) > 3
    src, log, _, ck = Q._stream(spark, "files", df)
    ST.stream_scd2(src, log, ck).awaitTermination()
    rows = ST.read_log(spark, log)
    assert rows.select("batch_id").distinct().count() == Q.MICRO_BATCHES
    assert rows.count() == 20_000 and rows.select("id").distinct().count() == 20_000
