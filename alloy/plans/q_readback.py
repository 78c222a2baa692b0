"""Queries that read back what a sink wrote, and the hard inputs of other operators: NULL keys,
times and values, long histories, look-alike names, numeric sentinels, multi-paragraph texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from alloy.functions import columns as C
from alloy.operators import documents as D
from alloy.operators import features as FE
from alloy.operators import gold
from alloy.operators import telemetry as TM
from alloy.plans.fixtures import t
from alloy.plans.q_docs import chunk_sql
from alloy.plans.q_gold import ROUTE_SQL, hk, routed_orders
from alloy.plans.registry import query
from alloy.session import scratch_path
from alloy.sources import readers, writers


def _folder(spark, name: str) -> str:
    return scratch_path(spark, f"sinks/{name}-{uuid.uuid4().hex}")


# ---- sinks ---------------------------------------------------------------------------
@query("sink_replace", "SELECT * FROM customer WHERE c_acctbal >= 0", ("SNK1",))
def q_sink_replace(spark, sf):
    """A table replaced by rows read from itself."""
    path = writers.write_table(t(spark, sf, "customer"), _folder(spark, "replace"))
    writers.write_table(spark.read.parquet(path).filter(F.col("c_acctbal") >= 0), path)
    return spark.read.parquet(path)


@query("sink_guarded", """
SELECT step, status, lineage_status, n_rows FROM (VALUES
  (1, 'ERROR', 'PENDING', NULL), (2, 'DRY_RUN', 'PENDING', NULL), (3, 'COMPLETE', 'COMPLETE', (SELECT count(*) FROM orders)),
  (4, 'ABORTED', 'PENDING', (SELECT count(*) FROM orders)), (5, 'SKIPPED', 'EXISTING', (SELECT count(*) FROM orders)),
  (6, 'COMPLETE', 'COMPLETE', (SELECT count(*) FROM orders WHERE o_orderstatus = 'O')))
  AS s(step, status, lineage_status, n_rows)""", ("SNK2",))
def q_sink_guarded(spark, sf):
    """The decision table step by step, with the rows that the target holds after each."""
    orders, path, out = t(spark, sf, "orders"), _folder(spark, "guarded"), None
    some = orders.filter(F.col("o_orderstatus") == "O")
    steps = [(orders, {"overwrite": True}), (orders, {}), (orders, {"dry_run": False}), (some, {"dry_run": False}),
             (some, {"dry_run": False, "brownfield": True}), (some, {"dry_run": False, "overwrite": True})]
    for i, (df, how) in enumerate(steps, start=1):
        r = writers.guarded_write(df, path, **how)
        rows = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows")) if i > 2 else spark.range(1).select(F.lit(None).cast("long").alias("n_rows"))
        rows = spark.createDataFrame(rows.collect(), "n_rows long")  # one number, before the next step writes
        part = rows.select(F.lit(i).alias("step"), F.lit(r.status).alias("status"), F.lit(r.lineage_status).alias("lineage_status"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("sink_clustered", """
SELECT * FROM orders WHERE year(o_orderdate) = 1995""", ("SNK4",))
def q_sink_clustered(spark, sf):
    days = t(spark, sf, "orders").withColumn("order_day", F.to_date("o_orderdate"))
    path = writers.write_clustered(days.withColumn("order_year", F.year("order_day")), _folder(spark, "clustered"), "order_year", ["o_custkey"])
    return spark.read.parquet(path).filter(F.col("order_year") == 1995).drop("order_year", "order_day")


@query("sink_interleaved", """
SELECT * FROM lineitem WHERE l_partkey BETWEEN 100 AND 140 OR l_shipdate >= TIMESTAMP '1998-06-01'""", ("SNK4",))
def q_sink_interleaved(spark, sf):
    """A layout by part and day, read back by filters on either."""
    path = writers.write_interleaved(t(spark, sf, "lineitem"), _folder(spark, "interleaved"), ["l_partkey", "l_shipdate"])
    rows = spark.read.parquet(path)
    return rows.filter(F.col("l_partkey").between(100, 140) | (F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ'1998-06-01 00:00:00'")))


@query("sink_routed", f"WITH {ROUTE_SQL} SELECT * FROM routed", ("SNK5",))
def q_sink_routed(spark, sf):
    return spark.read.parquet(writers.write_routed(routed_orders(spark, sf), _folder(spark, "routed")))


@query("read_documents", "SELECT 'txt' AS doc_type, n_name || chr(10) || chr(10) || n_nationkey || chr(10) AS text FROM nation", ("SRC6",))
def q_read_documents(spark, sf):
    """Every row written as a text file of its own, and the files read back whole."""
    path = _folder(spark, "documents")
    rows = t(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit("\n\n"), F.col("n_nationkey").cast("string")).alias("value"))
    rows.write.partitionBy("n_nationkey").text(path)
    return readers.read_documents(spark, f"{path}/*/").drop("doc_name")


# ---- hard inputs -----------------------------------------------------------------------
HOLES_SQL = """holes AS (
  SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 13 <> 0 THEN ts END AS ts,
         CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"""


@query("velocity_nulls", f"""
WITH {HOLES_SQL}
SELECT event_id, user_id, ts,
       count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS txn_count_24h,
       CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY ts
            RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS DOUBLE) AS spend_7d
FROM holes WHERE ts IS NOT NULL
UNION ALL
SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id),
       CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id) AS DOUBLE)
FROM holes WHERE ts IS NULL""", ("W5",))
def q_velocity_nulls(spark, sf):
    def hole(c: str, n: int):
        return F.when(F.col("event_id") % n != 0, F.col(c)).alias(c)

    e = t(spark, sf, "events").select("event_id", hole("user_id", 11), hole("ts", 13), hole("value", 7))
    return FE.velocity(e, "user_id", "ts", "value").drop("value")


@query("reinforce_long", """
WITH o AS (SELECT event_type, ts, event_id, CASE WHEN event_id % 7 <> 0 THEN least(value / 100.0, 1.0) END AS c,
                  CAST(event_id AS VARCHAR) AS note FROM events)
SELECT event_type, count(*) AS times_observed, max(ts) AS last_observed,
       round(list_reduce(list(c ORDER BY ts, event_id) FILTER (WHERE c IS NOT NULL),
                         lambda a, x: least((a + x) / 2.0 + 0.05, 1.0)), 6) AS confidence,
       arg_max(note, (ts, event_id)) AS note,
       round(list_reduce(list(c ORDER BY ts, event_id) FILTER (WHERE c IS NOT NULL),
                         lambda a, x: least((a + x) / 2.0 + 0.05, 1.0)), 6) >= 0.5 AS is_active
FROM o GROUP BY event_type""", ("K8",))
def q_reinforce_long(spark, sf):
    """Five signatures, so each has a long history; every seventh row has no confidence."""
    conf = F.when(F.col("event_id") % 7 != 0, F.least(F.col("value") / 100.0, F.lit(1.0)))
    o = t(spark, sf, "events").select("event_type", "ts", "event_id", conf.alias("c"), F.col("event_id").cast("string").alias("note"))
    return TM.reinforce(o, "event_type", "ts", "event_id", "c", text_cols=("note",))


@query("merge_learnings", """
WITH o AS (SELECT event_type || ':' || CAST(user_id % 5 AS VARCHAR) AS sig, ts, event_id, least(value / 100.0, 1.0) AS c FROM events),
e AS (SELECT * FROM o WHERE event_id % 2 = 0 AND sig NOT LIKE 'view:%'), l AS (SELECT * FROM o WHERE event_id % 2 = 1),
fold AS (SELECT sig, count(*) AS n, max(ts) AS last_ts, round(list_reduce(list(c ORDER BY ts, event_id), lambda a, x: least((a + x) / 2.0 + 0.05, 1.0)), 6) AS conf
         FROM e GROUP BY sig),
st AS (SELECT *, conf >= 0.5 AS active FROM fold),
nw AS (SELECT coalesce(l.sig) AS sig, count(*) AS n, max(l.ts) AS last_ts,
              list(l.c ORDER BY l.ts, l.event_id) AS cs FROM l GROUP BY l.sig)
SELECT coalesce(nw.sig, st.sig) AS sig, coalesce(st.n, 0) + coalesce(nw.n, 0) AS times_observed,
       greatest(coalesce(st.last_ts, nw.last_ts), coalesce(nw.last_ts, st.last_ts)) AS last_observed,
       CASE WHEN nw.sig IS NULL THEN st.conf
            ELSE round(list_reduce(CASE WHEN st.sig IS NULL THEN cs ELSE list_prepend(st.conf, cs) END,
                                   lambda a, x: least((a + x) / 2.0 + 0.05, 1.0)), 6) END AS confidence, true AS is_active
FROM nw FULL JOIN (SELECT * FROM st WHERE active) st ON nw.sig = st.sig
UNION ALL
SELECT sig, n, last_ts, conf, false FROM st WHERE NOT active""", ("K8", "U4"))
def q_merge_learnings(spark, sf):
    """Even events stored first, odd events merged into them; views are new signatures."""
    sig = F.concat("event_type", F.lit(":"), F.pmod("user_id", F.lit(5)).cast("string"))
    o = t(spark, sf, "events").select(sig.alias("sig"), "ts", "event_id", F.least(F.col("value") / 100.0, F.lit(1.0)).alias("c"))
    even, odd = o.filter((F.col("event_id") % 2 == 0) & ~F.col("sig").startswith("view:")), o.filter(F.col("event_id") % 2 == 1)
    return TM.merge_learnings(TM.reinforce(even, "sig", "ts", "event_id", "c"), odd, "sig", "ts", "event_id", "c")


@query("money_cast_names", """
SELECT c_custkey, c_mktsegment AS transformation_strategy, c_name AS corporate_name, CAST(CAST(c_acctbal AS DECIMAL(18,4)) AS DOUBLE) AS late_fee,
       CAST(CAST(c_nationkey AS DECIMAL(18,4)) AS DOUBLE) AS interest_rate, CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE CAST(c_custkey AS VARCHAR) END AS amount_text
FROM customer""", ("C4",))
def q_money_cast_names(spark, sf):
    """Look-alike names stay; numeric text is cast; a text column with one other word stays."""
    return C.money(t(spark, sf, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("transformation_strategy"), F.col("c_name").alias("corporate_name"),
        F.col("c_acctbal").alias("late_fee"), F.col("c_nationkey").cast("string").alias("interest_rate"),
        F.when(F.col("c_custkey") % 3 == 0, "n/a").otherwise(F.col("c_custkey").cast("string")).alias("amount_text")))


@query("null_policy_numeric", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price,
       CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS cust FROM orders""", ("C5",))
def q_null_policy_numeric(spark, sf):
    return C.null_policy(t(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit(-1.0)).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(9999)).otherwise(F.col("o_custkey")).alias("cust")), columns=("price", "cust"))


@query("vault_sat_numeric", f"""
WITH s AS (SELECT {hk('o_custkey')} AS HK, o_totalprice, o_orderstatus, {hk('o_totalprice', 'o_orderstatus')} AS HASHDIFF,
                  o_orderdate AS LOAD_DTS, o_orderkey FROM orders),
l AS (SELECT *, lag(HASHDIFF) OVER (PARTITION BY HK ORDER BY LOAD_DTS, o_orderkey) AS prev FROM s)
SELECT HK, o_totalprice, o_orderstatus, HASHDIFF, LOAD_DTS, o_orderkey, 'orders' AS RECORD_SOURCE
FROM l WHERE prev IS NULL OR prev <> HASHDIFF""", ("G3b",))
def q_vault_sat_numeric(spark, sf):
    return gold.satellite(t(spark, sf, "orders"), ["o_custkey"], ["o_totalprice", "o_orderstatus"], "o_orderdate",
                          tiebreak=["o_orderkey"], source="orders")


PARAGRAPHS_SQL = "(SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"


@query("chunk_paragraphs", f"WITH {chunk_sql(PARAGRAPHS_SQL, 'conv_id', ())} SELECT * FROM chunks", ("K1",))
def q_chunk_paragraphs(spark, sf):
    """Conversations as texts of one paragraph a turn, so that packing has work to do."""
    turns = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    texts = turns.select("conv_id", F.array_join(F.transform("x", lambda r: r["text"]), "\n\n").alias("text"))
    return D.chunk_documents(texts, "conv_id", "text")
