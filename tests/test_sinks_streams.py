"""Sinks (guarded write decision table, routed / clustered writes), sources, streaming = batch,
and reference goldens re-created with spark.range."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from alloy.operators import gold, quality, setops
from alloy.sources import readers, writers
from alloy.streaming import incremental as ST
from tests.conftest import SF_MID, SF_SMALL


@pytest.fixture()
def tmp(spark):
    return tempfile.mkdtemp(prefix="alloy-test-")


def test_guarded_write_decision_table(spark, tmp):
    df = spark.range(10)
    target = f"{tmp}/t"
    r = writers.guarded_write(df, target, dry_run=True, overwrite=True)          # T-04b
    assert r.status == "ERROR" and not os.path.exists(target)
    r = writers.guarded_write(df, target)                                        # T-02 defaults: dry run
    assert (r.status, r.lineage_status) == ("DRY_RUN", "PENDING") and r.plan and not os.path.exists(target)
    r = writers.guarded_write(df, target, dry_run=False)
    assert r.status == "COMPLETE" and spark.read.parquet(target).count() == 10
    r = writers.guarded_write(spark.range(3), target, dry_run=False)             # T-04 existing target
    assert r.status == "ABORTED" and r.reason == "TARGET_EXISTS_NO_OVERWRITE"
    assert spark.read.parquet(target).count() == 10
    r = writers.guarded_write(spark.range(3), target, dry_run=False, brownfield=True)
    assert (r.status, r.lineage_status) == ("SKIPPED", "EXISTING")
    r = writers.guarded_write(spark.range(3), target, dry_run=False, overwrite=True)
    assert r.status == "COMPLETE" and spark.read.parquet(target).count() == 3


def test_read_sources_skips_missing(spark):
    df, skipped = readers.read_sources(spark, SF_SMALL, "nation, region, nope")
    assert skipped == ["nope"]
    assert df.count() == 30 and "source_table" in df.columns


def test_read_documents(spark, tmp):
    for i in range(3):
        with open(f"{tmp}/doc{i}.txt", "w") as f:
            f.write(f"para {i}\n\nsecond")
    d = readers.read_documents(spark, tmp)
    rows = sorted(d.collect())
    assert [r["doc_name"] for r in rows] == ["doc0.txt", "doc1.txt", "doc2.txt"]
    assert rows[0]["doc_type"] == "txt" and rows[0]["text"] == "para 0\n\nsecond"


def test_routed_and_clustered_writes(spark, tmp):
    from alloy.plans.q_gold import routed_orders
    routed = routed_orders(spark, SF_SMALL)
    writers.write_routed(routed, f"{tmp}/gold")
    dirs = sorted(d for d in os.listdir(f"{tmp}/gold") if d.startswith("gold_table="))
    assert dirs == sorted(f"gold_table={r['gold_table']}" for r in routed.select("gold_table").distinct().collect())
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").withColumn("d", F.to_date("o_orderdate"))
    writers.write_clustered(o, f"{tmp}/clustered", "d", ["o_custkey"], 4)
    back = spark.read.parquet(f"{tmp}/clustered")
    assert back.count() == o.count()
    plan = back.filter(F.col("d") == "1995-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_remove_by_key_report(spark):
    t = spark.createDataFrame([("A", 1), ("a", 2), ("b", 3)], "k string, v long")
    remaining, report = setops.remove_by_key(t, spark.createDataFrame([("A",), ("zz",)], "k string"), "k")
    assert remaining.count() == 1
    assert sorted((r["k"], r["deleted"], r["status"]) for r in report.collect()) == \
        [("A", 2, "REMOVED"), ("ZZ", 0, "NOT_FOUND")]


# ---- streaming = batch ---------------------------------------------------------------
def _split_events(spark, tmp, parts=4):
    import time
    e = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    # one file per time slice, written one after another: the file source replays files
    # in modification-time order, so later micro-batches carry later events
    bounds = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-03-01"]
    for lo, hi in zip(bounds, bounds[1:]):
        e.filter((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.mode("append").parquet(f"{tmp}/events")
        time.sleep(1.1)
    return e


def test_stream_keep_latest_multi_batch_equals_batch(spark, tmp):
    from alloy.operators.dedup import keep_latest
    e = _split_events(spark, tmp)
    keys = ["user_id", "event_type"]
    src = ST.parquet_stream(spark, f"{tmp}/events", e.schema, max_files_per_trigger=1)
    ST.stream_keep_latest(src, keys, ("ts",), f"{tmp}/log", f"{tmp}/ck").awaitTermination()
    rows = ST.read_log(spark, f"{tmp}/log")
    assert rows.select("batch_id").distinct().count() >= 3
    want = sorted(keep_latest(e, keys, ("ts",)).collect())
    assert sorted(ST.latest_state(rows, keys, ("ts",)).collect()) == want
    ST.append_batch(spark.read.parquet(f"{tmp}/log/batch_id=1"), f"{tmp}/log2", 1)   # a batch again: replaces itself
    ST.append_batch(spark.read.parquet(f"{tmp}/log/batch_id=1"), f"{tmp}/log2", 1)
    assert ST.read_log(spark, f"{tmp}/log2").count() == rows.filter("batch_id = 1").count()


def test_stream_scd2_late_batches_and_compaction(spark, tmp):
    """Files in reverse order of time, a batch twice: the history is that of all changes."""
    from alloy.operators.scd2 import scd2
    e = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    x = e.select("user_id", "ts", "event_id", "event_type", op.alias("_OPERATION"))
    for i, (lo, hi) in enumerate([("2024-01-22", "2024-03-01"), ("2024-01-08", "2024-01-22"), ("2024-01-01", "2024-01-08"), ("2024-01-08", "2024-01-22")]):
        ST.append_batch(x.filter((F.col("ts") >= lo) & (F.col("ts") < hi)), f"{tmp}/log", i)
    args = (["user_id"], "ts", ["event_type"], "_OPERATION", "event_id")
    want = sorted(scd2(x, *args[:4], seq="event_id").collect())
    assert sorted(ST.scd2_state(ST.read_log(spark, f"{tmp}/log"), *args).collect()) == want
    ST.compact(spark, f"{tmp}/log", f"{tmp}/base", lambda rows: rows.drop("batch_id").distinct())
    again = ST.read_log(spark, f"{tmp}/log", f"{tmp}/base")
    assert again.count() == x.count() and sorted(ST.scd2_state(again, *args).collect()) == want


def test_stream_immutable_keeps_late_rows(spark, tmp):
    e = _split_events(spark, tmp)
    e.limit(50).coalesce(1).write.mode("append").parquet(f"{tmp}/events")     # repeated, and late
    src = ST.parquet_stream(spark, f"{tmp}/events", e.schema, max_files_per_trigger=1)
    ST.stream_immutable(src, "ts", 3600, f"{tmp}/log", f"{tmp}/late", f"{tmp}/ck").awaitTermination()
    late = ST.read_log(spark, f"{tmp}/late")
    assert late.count() > 0
    rows = ST.read_log(spark, f"{tmp}/log").unionByName(late)
    assert rows.count() == e.count() + 50
    assert sorted(ST.immutable_state(rows, ["event_id"]).collect(), key=str) == sorted(e.collect(), key=str)


def test_stream_aggregate_multi_batch_equals_batch(spark, tmp):
    e = _split_events(spark, tmp)
    src = ST.parquet_stream(spark, f"{tmp}/events", e.schema, max_files_per_trigger=1)
    ST.stream_aggregate(src, "ts", "1 hour", ["event_type"], {"n": lambda: F.count(F.lit(1))}, f"{tmp}/log", f"{tmp}/ck").awaitTermination()
    got = ST.aggregate_state(ST.read_log(spark, f"{tmp}/log"), ["event_type"], ["n"])
    want = e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.cast("timestamp_ntz")
                     .alias("window_start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(got.select("window_start", "event_type", "n").collect()) == sorted(want.collect())


# ---- goldens from the reference's fixtures (FIXTURES.md A5, A2) ------------------------
def test_routing_goldens_three_rules(spark):
    ids = spark.range(1, 40001).withColumnRenamed("id", "product_id")
    banner = F.element_at(F.array(*[F.lit(x) for x in ("standard", "express", "premium")]),
                          (F.col("product_id") % 3 + 1).cast("int"))
    bronze = ids.select("product_id", banner.alias("banner"),
                        F.when(F.col("product_id") % 7 == 6, "Ancillary")
                        .otherwise(F.concat(F.lit("CAT"), (F.col("product_id") % 7).cast("string"))).alias("category"),
                        (F.col("product_id") % 200 == 0).alias("is_deleted"),
                        F.when(F.col("product_id") % 20 == 0, "UPDATE").otherwise("INSERT").alias("_operation"))
    silver = bronze.filter(~F.col("is_deleted") & (F.col("_operation") != "DELETE"))
    assert silver.count() == 39_800
    rules = spark.createDataFrame([(b, f"GOLD_{b.upper()}", None, "Ancillary") for b in ("standard", "express", "premium")],
                                  "value string, target_table string, merge_into string, exclusions string")
    routed = gold.route(silver, rules, "banner", "category")
    rep = {r["value"]: (r["silver_rows"], r["excluded_rows"], r["expected_rows"], r["status"])
           for r in quality.reconcile_routes(silver, routed, rules, "banner", "category").collect()}
    assert rep == {"standard": (13_267, 1_896, 11_371, "PASS"), "express": (13_267, 1_895, 11_372, "PASS"),
                   "premium": (13_266, 1_895, 11_371, "PASS")}


def test_completeness_goldens_five_provinces(spark):
    ids = spark.range(0, 18200)
    prov = F.element_at(F.array(*[F.lit(x) for x in ("ON", "QC", "BC", "AB", "MB")]), (F.col("id") % 5 + 1).cast("int"))
    df = ids.select(prov.alias("province"), F.when(F.col("id") % 5 == 1, F.lit("nom")).alias("name_fr"),
                    (F.col("id") % 100 < 64).alias("is_taxable"))
    comp = {r["province"]: (r["n_rows"], r["nonnull_name_fr"]) for r in
            quality.completeness(df, ["province"], ["name_fr"]).collect()}
    assert all(n == 3_640 for n, _ in comp.values())
    assert comp["QC"][1] == 3_640 and sum(v for _, v in comp.values()) == 3_640
    tax = {r["is_taxable"]: r["count"] for r in df.groupBy("is_taxable").count().collect()}
    assert tax == {True: 11_648, False: 6_552}


def test_scd2_apply_in_any_order(spark):
    """Changes in shuffled batches, some twice, some older than the history they meet."""
    import random

    from alloy.operators.scd2 import scd2, scd2_apply
    from alloy.session import cut_lineage
    rnd = random.Random(4)
    rows = [("a", f"2024-01-{d:02d} {h:02d}:00:00", i, v, "UPDATE") for i, (d, h, v) in enumerate(
        [(1, 0, "x"), (3, 0, "x"), (4, 0, "x"), (3, 12, "y"), (6, 0, "y"), (7, 0, "z")])]
    rows += [("b", f"2024-01-{rnd.randint(1, 20):02d} {rnd.randint(0, 23):02d}:00:00", 100 + i, rnd.choice("pq"),
              rnd.choice(["UPDATE", "UPDATE", "DELETE"])) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, s string, n long, v string, op string").select(
        "k", F.to_timestamp_ntz("s").alias("ts"), "n", "v", "op")
    args = (["k"], "ts", ["v"], "op")
    full = sorted(scd2(df, *args, seq="n").collect())
    for seed in range(2):
        ids = [r[2] for r in rows]
        random.Random(seed).shuffle(ids)
        current = log = None
        for part in (ids[:12], ids[12:24], ids[6:14], ids[24:]):
            batch = df.filter(F.col("n").isin(part))
            if current is None:
                current, log = cut_lineage(scd2(batch, *args, seq="n")), batch
            else:
                current = cut_lineage(scd2_apply(current, batch, log, *args, seq="n"))
                log = log.unionByName(batch)
        assert sorted(current.collect()) == full


def test_refresh_stream_upserts_per_batch(spark, tmp):
    from alloy.operators.dedup import Order, keep_one
    e = _split_events(spark, tmp)
    src = ST.parquet_stream(spark, f"{tmp}/events", e.schema, max_files_per_trigger=1)

    def latest_state(batch):
        return keep_one(batch.select("user_id", "ts", "event_id", "event_type"), ["user_id"],
                        [Order("ts", desc=True)])

    ST.refresh_stream(src, latest_state, f"{tmp}/log", f"{tmp}/ck").awaitTermination()   # lag None = available now
    got = ST.refreshed_state(ST.read_log(spark, f"{tmp}/log"), ["user_id"])
    want = latest_state(e)
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


def test_staged_replace_keeps_the_old_table(spark, tmp):
    """A write that fails leaves the table as it was; one that succeeds replaces it whole."""
    writers.write_table(spark.range(5), f"{tmp}/t")
    with pytest.raises(Exception):
        writers.write_table(spark.range(9).select(F.raise_error(F.lit("no")).alias("id")), f"{tmp}/t")
    assert spark.read.parquet(f"{tmp}/t").count() == 5
    writers.write_table(spark.read.parquet(f"{tmp}/t").filter("id > 1"), f"{tmp}/t")   # reads what it replaces
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp}/t").collect()) == [2, 3, 4]
    assert os.listdir(tmp) == ["t"]


def test_read_sources_lists_a_schema(spark, tmp):
    for name in ("a", "b"):
        spark.range(3).write.parquet(f"{tmp}/db/s/{name}.parquet")
    df, skipped = readers.read_sources(spark, tmp, "db.s, db.s.a, db.none")
    assert {(r["source_table"], r["count"]) for r in df.groupBy("source_table").count().collect()} == {("db.s.a", 6), ("db.s.b", 3)}
    assert skipped == ["db.none"]


def test_as_of_join_of_a_hot_key(spark):
    """One key holds half of the facts; NULL keys and times match nothing; also across days."""
    from alloy.operators.joins import as_of_join
    facts = spark.range(2000).select(
        F.col("id").alias("f"), F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 19 == 0, None).otherwise(F.col("id") % 7).cast("long").alias("fk"),
        F.when(F.col("id") % 23 != 0, F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.col("id").cast("int") % 400)).alias("at"))
    versions = spark.range(60).select(
        (F.col("id") % 6).alias("vk"), F.col("id").alias("version"),
        (F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'") + F.make_dt_interval((F.col("id") / 6).cast("int"))).alias("EFFECTIVE_FROM"),
        F.when(F.col("id") < 54, F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'")
               + F.make_dt_interval((F.col("id") / 6).cast("int"), F.when(F.col("id") % 5 == 0, 0).otherwise(20))).alias("EFFECTIVE_TO"))
    got = sorted(((r["f"], r["version"]) for r in as_of_join(facts, versions, "fk", "vk", "at").collect()))
    plain = facts.join(versions, (F.col("fk") == F.col("vk")) & (F.col("EFFECTIVE_FROM") <= F.col("at"))
                       & (F.col("EFFECTIVE_TO").isNull() | (F.col("at") < F.col("EFFECTIVE_TO"))), "left")
    assert got == sorted((r["f"], r["version"]) for r in plain.collect())


def test_pack_batches_with_nulls(spark):
    from alloy.operators import documents as D
    df = spark.createDataFrame([("a", 1, "x" * 400), ("a", 2, None), (None, 3, "y" * 40), (None, 4, "")], "g string, o long, txt string")
    got = {r["o"]: (r["g"], r["tokens"], r["batch_no"]) for r in D.pack_batches(df, "g", "o", text_col="txt").collect()}
    assert got == {1: ("a", 150, 0), 2: ("a", 50, 0), 3: (None, 60, 0), 4: (None, 50, 0)}


def test_profile_without_integers_or_texts(spark):
    from alloy.operators import profile as P
    floats = {"f": spark.createDataFrame([(1.5,)], "x double")}
    assert P.discover_fks(floats).collect() == []
    assert P.infer_types(floats["f"], "f").collect() == []
