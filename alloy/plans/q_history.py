"""History (SCD2, as-of), nested data, and time-window feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alloy.operators import features as FE
from alloy.operators import joins, scd2
from alloy.plans.fixtures import CDC_EVENTS_SQL, cdc_events, t
from alloy.plans.registry import query

SCD2_SQL = f"""{CDC_EVENTS_SQL},
c AS (SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS rn FROM cdc) WHERE rn = 1),
p AS (SELECT *, _OPERATION = 'DELETE' AS is_del,
             lag(event_type) OVER w AS prev_type, lag(_OPERATION = 'DELETE') OVER w AS prev_del,
             row_number() OVER w AS pos
      FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT * FROM p WHERE CASE WHEN is_del THEN pos > 1 AND NOT prev_del
                                 ELSE NOT (pos > 1 AND prev_type IS NOT DISTINCT FROM event_type AND NOT prev_del) END),
v AS (SELECT user_id, event_id, event_type, ts AS EFFECTIVE_FROM,
             CASE WHEN is_del THEN ts ELSE lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS EFFECTIVE_TO,
             is_del AS IS_DELETED
      FROM k)"""


def events_scd2(spark, sf):
    e = cdc_events(spark, sf).select("user_id", "ts", "event_id", "event_type", "_OPERATION")
    return scd2.scd2(e, ["user_id"], "ts", ["event_type"], op_col="_OPERATION", seq="event_id")


@query("scd2", f"""
WITH {SCD2_SQL}
SELECT user_id, event_id, event_type, EFFECTIVE_FROM, EFFECTIVE_TO, EFFECTIVE_TO IS NULL AS IS_CURRENT, IS_DELETED
FROM v""", ("S3", "W4"))
def q_scd2(spark, sf):
    return events_scd2(spark, sf).select("user_id", "event_id", "event_type", "EFFECTIVE_FROM",
                                         "EFFECTIVE_TO", "IS_CURRENT", "IS_DELETED")


@query("as_of_join", f"""
WITH {SCD2_SQL},
f AS (SELECT o_orderkey, CAST(floor(o_custkey / 10) AS BIGINT) AS user_id,
             TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS event_time
      FROM orders)
SELECT f.o_orderkey, f.user_id, f.event_time, v.event_type, v.EFFECTIVE_FROM
FROM f LEFT JOIN v ON f.user_id = v.user_id AND v.EFFECTIVE_FROM <= f.event_time
                   AND (v.EFFECTIVE_TO IS NULL OR f.event_time < v.EFFECTIVE_TO)""", ("J9",))
def q_as_of_join(spark, sf):
    o = t(spark, sf, "orders")
    fact = o.select("o_orderkey", F.floor(F.col("o_custkey") / 10).cast("long").alias("fk_user"),
                    F.timestamp_add("DAY", F.pmod(F.col("o_orderkey"), F.lit(30)),
                                    F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")).alias("event_time"))
    versions = events_scd2(spark, sf).select("user_id", "event_type", "EFFECTIVE_FROM", "EFFECTIVE_TO")
    j = joins.as_of_join(fact, versions, "fk_user", "user_id", "event_time")
    return j.select("o_orderkey", F.col("fk_user").alias("user_id"), "event_time", "event_type", "EFFECTIVE_FROM")


@query("flatten", """
SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS props_k
FROM events""", ("S1",))
def q_flatten(spark, sf):
    return scd2.flatten_and_type(t(spark, sf, "events"), "props", "k INT", prefix="props_")


@query("normalize", """
SELECT vec_id, CAST(u.pos - 1 AS INTEGER) AS pos, u.value
FROM embeddings, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS pos,
                                 unnest(embedding) AS value) u""", ("S5",))
def q_normalize(spark, sf):
    _parent, child = scd2.normalize(t(spark, sf, "embeddings"), "vec_id", "embedding")
    return child


@query("velocity", """
SELECT event_id, user_id, ts,
       count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS txn_count_24h,
       CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY ts
            RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS DOUBLE) AS spend_7d
FROM events""", ("W5",))
def q_velocity(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return FE.velocity(e, "user_id", "ts", "value").drop("value")


ZSCORE_SQL = """z0 AS (
  SELECT *, count(value) OVER w AS _n,
         CAST(sum(CAST(value AS DECIMAL(18,4))) OVER w AS DOUBLE) AS _s1,
         CAST(sum(CAST(value AS DECIMAL(18,4)) * CAST(value AS DECIMAL(18,4))) OVER w AS DOUBLE) AS _s2
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)),
z AS (
  SELECT *, (_s2 - _s1 * _s1 / CAST(_n AS DOUBLE)) / (CAST(_n AS DOUBLE) - 1.0) AS _var FROM z0)"""


@query("amount_zscore", f"""
WITH {ZSCORE_SQL}
SELECT event_id, user_id, value,
       CASE WHEN _n >= 2 AND _var > 0 THEN round((value - _s1 / CAST(_n AS DOUBLE)) / sqrt(_var), 6) END AS amount_z
FROM z""", ("W6",))
def q_amount_zscore(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return FE.zscore(e, "user_id", "ts", "value").drop("ts")


@query("phase_durations", """
WITH d AS (
  SELECT event_id, user_id AS execution_id, event_type AS phase, ts,
         epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS dur_us,
         epoch_us(max(ts) OVER (PARTITION BY user_id)) - epoch_us(min(ts) OVER (PARTITION BY user_id)) AS total_us
  FROM events)
SELECT event_id, execution_id, phase, ts, dur_us / 1e6 AS duration_sec,
       round(CAST(dur_us AS DOUBLE) * 100.0 / CAST(nullif(total_us, 0) AS DOUBLE), 4) AS pct_of_run
FROM d""", ("W8", "TM7"))
def q_phase_durations(spark, sf):
    log = t(spark, sf, "events").select("event_id", F.col("user_id").alias("execution_id"),
                                        F.col("event_type").alias("phase"), "ts")
    return FE.phase_durations(log, "execution_id", "ts", "event_id")


@query("top_pct_label", """
WITH th AS (SELECT min(value) AS thr FROM (SELECT value, cume_dist() OVER (ORDER BY value) AS cd FROM events)
            WHERE cd >= 0.99)
SELECT event_id, value, coalesce(value >= thr, false) AS is_top FROM events, th""", ("W9",))
def q_top_pct_label(spark, sf):
    e = t(spark, sf, "events").select("event_id", "value")
    return FE.top_pct_label(e, "value", 1.0)


@query("features", f"""
WITH {ZSCORE_SQL},
m AS (SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / CAST(count(value) AS DOUBLE) AS merchant_avg
      FROM events GROUP BY event_type)
SELECT z.event_id,
       count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS txn_count_24h,
       CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY ts
            RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS DOUBLE) AS spend_7d,
       round(m.merchant_avg, 6) AS merchant_avg,
       CASE WHEN _n >= 2 AND _var > 0 THEN round((value - _s1 / CAST(_n AS DOUBLE)) / sqrt(_var), 6) END AS amount_z,
       hour(ts) AS hour_of_day, dayofweek(ts) AS day_of_week
FROM z JOIN m ON z.event_type = m.event_type""", ("G6",))
def q_features(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", "ts", "value", "event_type")
    return FE.transaction_features(e, "user_id", "ts", "value", "event_type", keep=("event_id",))


@query("hash_split", """
SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic,
       CASE WHEN CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80
            THEN 'train' ELSE 'test' END AS split
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""", ("G7",))
def q_hash_split(spark, sf):
    from alloy.operators.joins import label_join
    docs = t(spark, sf, "documents").select("doc_id")
    return FE.hash_split(label_join(docs, t(spark, sf, "labels"), "doc_id", ["quality", "toxic"]), "doc_id")


@query("risk_tier", """
SELECT event_id, least(value / 100.0, 1.0) AS score,
       CASE WHEN least(value / 100.0, 1.0) > 0.75 THEN 'HIGH'
            WHEN least(value / 100.0, 1.0) > 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS tier
FROM events""", ("G8",))
def q_risk_tier(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.least(F.col("value") / 100.0, F.lit(1.0)).alias("score"))
    return e.withColumn("tier", FE.risk_tier(F.col("score")))


@query("risk_top", """
SELECT event_id, least(value / 100.0, 1.0) AS score FROM events
ORDER BY score DESC, event_id ASC LIMIT 100""", ("G8", "T1"))
def q_risk_top(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.least(F.col("value") / 100.0, F.lit(1.0)).alias("score"))
    return e.orderBy(F.col("score").desc(), F.col("event_id").asc()).limit(100)
