"""Bronze shapes derived from the driver tables (see FIXTURES.md, part B).

Each builder has a SQL twin (``*_SQL``) used inside oracle queries as a CTE, so
both engines start from the same derived input. Everything is derived from the
full tables; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alloy.sources.readers import table


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name)


# ---- CDC feed from events: signup -> INSERT, error -> DELETE, rest UPDATE ----------
def cdc_events(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    op = (F.when(F.col("event_type") == "signup", F.lit("INSERT"))
          .when(F.col("event_type") == "error", F.lit("DELETE"))
          .otherwise(F.lit("UPDATE")))
    return e.withColumn("_OPERATION", op)


CDC_EVENTS_SQL = """cdc AS (
  SELECT *, CASE WHEN event_type = 'signup' THEN 'INSERT'
                 WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPDATE' END AS _OPERATION
  FROM events)"""


# ---- lineage registry: one Bronze table per user, layers by event mix -------------
def lineage(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    name = F.concat(F.lit("T"), F.lpad(F.col("user_id").cast("string"), 5, "0"))
    agg = e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("bronze_rows"),
        F.count_if(F.col("event_type") == "view").alias("_views"),
        F.count_if(F.col("event_type") == "error").alias("_errors"),
        F.count_if(F.col("event_type") == "purchase").alias("_purchases"),
        F.count_if(F.col("event_type") == "click").alias("_clicks"))
    agg = agg.withColumn("bronze_table", name)
    silver = F.when(F.col("_views") > F.col("_errors"), F.concat(F.col("bronze_table"), F.lit("_SILVER")))
    gold = F.when(silver.isNotNull() & (F.col("_purchases") > F.col("_clicks")),
                  F.concat(F.col("bronze_table"), F.lit("_GOLD")))
    out = agg.select(
        "user_id", "bronze_table",
        F.concat(F.lit("BRONZE_"), F.pmod("user_id", F.lit(3)).cast("string")).alias("bronze_schema"),
        F.lit("DEMO").alias("bronze_database"), "bronze_rows",
        silver.alias("silver_table"),
        F.when(silver.isNotNull(), F.col("bronze_rows") - F.col("_errors")).alias("silver_rows"),
        gold.alias("gold_table"),
        F.when(gold.isNotNull(), F.col("_purchases")).alias("gold_rows"))
    status = (F.when(F.col("gold_table").isNotNull(), F.lit("COMPLETE"))
              .when(F.col("silver_table").isNotNull(), F.lit("EXISTING"))
              .otherwise(F.lit("PENDING")))
    own = F.when(F.col("user_id") % 4 == 0, F.lit("EXISTING")).otherwise(F.lit("COMPLETE"))
    return (out.withColumn("status", status)
            .withColumn("silver_status", F.when(F.col("silver_table").isNull(), "PENDING").otherwise(own))
            .withColumn("gold_status", F.when(F.col("gold_table").isNull(), "PENDING").otherwise(own)))


LINEAGE_SQL = """lin0 AS (
  SELECT user_id, 'T' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS bronze_table,
         count(*) AS bronze_rows,
         count_if(event_type = 'view') AS _views, count_if(event_type = 'error') AS _errors,
         count_if(event_type = 'purchase') AS _purchases, count_if(event_type = 'click') AS _clicks
  FROM events GROUP BY user_id),
lin1 AS (
  SELECT *, CASE WHEN _views > _errors THEN bronze_table || '_SILVER' END AS silver_table FROM lin0),
lineage AS (
  SELECT user_id, bronze_table, 'BRONZE_' || CAST(user_id % 3 AS VARCHAR) AS bronze_schema, 'DEMO' AS bronze_database, bronze_rows,
         CASE WHEN silver_table IS NULL THEN 'PENDING' WHEN user_id % 4 = 0 THEN 'EXISTING' ELSE 'COMPLETE' END AS silver_status,
         CASE WHEN silver_table IS NULL OR _purchases <= _clicks THEN 'PENDING' WHEN user_id % 4 = 0 THEN 'EXISTING'
              ELSE 'COMPLETE' END AS gold_status,
         silver_table,
         CASE WHEN silver_table IS NOT NULL THEN bronze_rows - _errors END AS silver_rows,
         CASE WHEN silver_table IS NOT NULL AND _purchases > _clicks THEN bronze_table || '_GOLD' END AS gold_table,
         CASE WHEN silver_table IS NOT NULL AND _purchases > _clicks THEN _purchases END AS gold_rows,
         CASE WHEN silver_table IS NOT NULL AND _purchases > _clicks THEN 'COMPLETE'
              WHEN silver_table IS NOT NULL THEN 'EXISTING' ELSE 'PENDING' END AS status
  FROM lin1)"""


# ---- run log and runs: run := user_id, phase := event_type, time := ts -------------
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    return e.select(F.col("user_id").alias("execution_id"), F.col("event_type").alias("phase"),
                    F.col("ts").alias("created_at"), "event_id",
                    F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("OK")).alias("status"),
                    F.least(F.col("value") / 100.0, F.lit(1.0)).alias("confidence"))


RUN_LOG_SQL = """runlog AS (
  SELECT user_id AS execution_id, event_type AS phase, ts AS created_at, event_id,
         CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status,
         least(value / 100.0, 1.0) AS confidence
  FROM events)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    log = run_log(spark, sf)
    last = F.max_by(F.col("phase"), F.struct("created_at", "event_id"))
    return log.groupBy("execution_id").agg(
        F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"),
        F.count(F.lit(1)).alias("n_events"),
        F.when(last == "error", F.lit("FAILED")).otherwise(F.lit("COMPLETE")).alias("status"))


RUNS_SQL = RUN_LOG_SQL + """,
runs AS (
  SELECT execution_id, min(created_at) AS started_at, max(created_at) AS ended_at,
         count(*) AS n_events,
         CASE WHEN arg_max(phase, (created_at, event_id)) = 'error' THEN 'FAILED' ELSE 'COMPLETE' END AS status
  FROM runlog GROUP BY execution_id)"""


# ---- learning observations: signature = event_type ':' (props.k mod 10) -------------
def observations(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.concat(F.col("event_type"), F.lit(":"), F.pmod(k, F.lit(10)).cast("string")).alias("pattern_signature"),
        F.col("user_id").alias("execution_id"), F.col("ts").alias("observed_at"), "event_id",
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("confidence"),
        F.concat(F.lit("observation "), F.col("event_id").cast("string")).alias("observation"),
        F.concat(F.lit("recommend "), F.col("event_type")).alias("recommendation"))


OBSERVATIONS_SQL = """obs AS (
  SELECT event_type || ':' || CAST((CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 + 10) % 10 AS VARCHAR) AS pattern_signature,
         user_id AS execution_id, ts AS observed_at, event_id,
         least(value / 100.0, 1.0) AS confidence,
         'observation ' || CAST(event_id AS VARCHAR) AS observation,
         'recommend ' || event_type AS recommendation
  FROM events)"""


# ---- routing rules derived from the data's own values ------------------------------
# fixed routing parameters: 3-MEDIUM merges into 2-HIGH, 5-LOW has no target,
# exclusions: order status P.
ROUTE_MERGES = {"3-MEDIUM": "2-HIGH"}
ROUTE_NO_TARGET = ("5-LOW",)
ROUTE_EXCLUSIONS = "P"


def routing_rules(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders")
    vals = o.select(F.col("o_orderpriority").alias("value")).distinct()
    slug = F.regexp_replace(F.upper(F.col("value")), "[^A-Z0-9]+", "_")
    merge = F.lit(None).cast("string")
    for src, dst in ROUTE_MERGES.items():
        merge = F.when(F.col("value") == src, F.lit(dst)).otherwise(merge)
    target = F.when(F.col("value").isin(*ROUTE_NO_TARGET), F.lit(None).cast("string")) \
        .otherwise(F.concat(F.lit("GOLD_ORDERS_"), slug))
    return vals.select(
        F.lit("o_orderpriority").alias("column_name"), "value",
        target.alias("target_table"), merge.alias("merge_into"),
        F.lit(ROUTE_EXCLUSIONS).alias("exclusions"), F.lit(30.0).alias("threshold_pct"))


ROUTING_RULES_SQL = """rules AS (
  SELECT 'o_orderpriority' AS column_name, value,
         CASE WHEN value IN ('5-LOW') THEN NULL
              ELSE 'GOLD_ORDERS_' || regexp_replace(upper(value), '[^A-Z0-9]+', '_', 'g') END AS target_table,
         CASE WHEN value = '3-MEDIUM' THEN '2-HIGH' END AS merge_into,
         'P' AS exclusions, 30.0::DOUBLE AS threshold_pct
  FROM (SELECT DISTINCT o_orderpriority AS value FROM orders))"""
