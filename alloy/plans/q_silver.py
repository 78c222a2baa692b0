"""Sources, projections, filters, contract transforms and Silver dedup strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from alloy.functions import columns as C
from alloy.operators import dedup, filters
from alloy.operators import setops
from alloy.operators.dedup import Order
from alloy.plans.fixtures import CDC_EVENTS_SQL, cdc_events, t
from alloy.plans.registry import query
from alloy.sources.readers import read_sources

LINEITEM_COLS = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
                 "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")
LINEITEM_TIEBREAK = ", ".join(f"{c.strip()} ASC NULLS LAST" for c in LINEITEM_COLS.split(","))


@query("read_sources", """
SELECT 'customer' AS source_table, * FROM customer
UNION ALL BY NAME
SELECT 'supplier' AS source_table, * FROM supplier""", ("SRC1",))
def q_read_sources(spark, sf):
    df, _skipped = read_sources(spark, sf, "customer, supplier, missing_table")
    return df


@query("insert_absent", """
WITH tgt AS (SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')),
     b AS (SELECT c_custkey, upper(c_name) AS c_name, c_nationkey, c_acctbal, c_mktsegment
           FROM customer WHERE c_acctbal >= 5000)
SELECT * FROM tgt
UNION ALL
SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM tgt WHERE upper(tgt.c_name) = upper(b.c_name))""",
       ("SRC2", "J5", "FL4"))
def q_insert_absent(spark, sf):
    c = t(spark, sf, "customer")
    target = c.filter(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"))
    batch = c.filter(F.col("c_acctbal") >= 5000).withColumn("c_name", F.upper("c_name"))
    return setops.insert_absent(target, batch, ["c_name"])


@query("update_from", """
WITH s AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS line_total
           FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, o.o_custkey,
       CASE WHEN s.l_orderkey IS NOT NULL AND o.o_orderstatus = 'O' THEN 'F' ELSE o.o_orderstatus END AS o_orderstatus,
       CASE WHEN s.l_orderkey IS NOT NULL AND o.o_orderstatus = 'O' THEN s.line_total ELSE o.o_totalprice END AS o_totalprice,
       o.o_orderdate, o.o_orderpriority
FROM orders o LEFT JOIN s ON o.o_orderkey = s.l_orderkey""", ("SRC3",))
def q_update_from(spark, sf):
    o = t(spark, sf, "orders")
    li = t(spark, sf, "lineitem")
    src = li.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast(C.MONEY_TYPE)).cast("double").alias("line_total"),
        F.lit("F").alias("new_status")).withColumnRenamed("l_orderkey", "o_orderkey")
    return setops.update_from(o, src, ["o_orderkey"], F.col("o_orderstatus") == "O",
                              {"o_orderstatus": "new_status", "o_totalprice": "line_total"})


@query("passthrough", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate FROM lineitem""",
       ("PR1", "S6"))
def q_passthrough(spark, sf):
    return filters.passthrough(t(spark, sf, "lineitem"),
                               ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"])


@query("snake_upper", """
SELECT o_orderkey AS O_ORDERKEY, o_custkey AS O_CUSTKEY, o_orderstatus AS O_ORDERSTATUS,
       o_totalprice AS O_TOTALPRICE, o_orderdate AS O_ORDERDATE, o_orderpriority AS O_ORDERPRIORITY
FROM orders""", ("PR4",))
def q_snake_upper(spark, sf):
    return C.snake_upper(t(spark, sf, "orders"))


@query("soft_delete", f"""
SELECT {LINEITEM_COLS} FROM lineitem WHERE NOT coalesce(l_returnflag = 'R', false)""", ("FL1",))
def q_soft_delete(spark, sf):
    return filters.drop_deleted(t(spark, sf, "lineitem"), F.col("l_returnflag") == "R")


@query("cdc_filter", f"""
WITH {CDC_EVENTS_SQL}
SELECT * FROM cdc WHERE _OPERATION != 'DELETE'""", ("FL2",))
def q_cdc_filter(spark, sf):
    return filters.drop_cdc_deletes(cdc_events(spark, sf))


@query("exclude_categories", """
SELECT * FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('P', 'X')""", ("FL3",))
def q_exclude_categories(spark, sf):
    return filters.exclude_categories(t(spark, sf, "orders"), "o_orderstatus", " P , X ,")


@query("confidence_bucket", """
SELECT event_id, least(value / 100.0, 1.0) AS confidence,
       CASE WHEN least(value / 100.0, 1.0) >= 0.85 THEN 'high'
            WHEN least(value / 100.0, 1.0) >= 0.65 THEN 'medium' ELSE 'low' END AS bucket
FROM events""", ("FL5",))
def q_confidence_bucket(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.least(F.col("value") / 100.0, F.lit(1.0)).alias("confidence"))
    return e.withColumn("bucket", C.confidence_bucket("confidence"))


@query("quarantine", """
SELECT c.c_custkey, o.o_orderkey, o.o_orderkey IS NULL AS is_quarantined
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey""", ("FL6",))
def q_quarantine(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey")
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    joined = c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey")
    ok, bad = filters.quarantine_nulls(joined, ["o_orderkey"])
    return (ok.withColumn("is_quarantined", F.lit(False))
            .unionByName(bad.withColumn("is_quarantined", F.lit(True))))


@query("dedup_keep_latest", f"""
SELECT {LINEITEM_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY l_shipdate DESC NULLS LAST, {LINEITEM_TIEBREAK}) AS rn
  FROM lineitem WHERE NOT coalesce(l_returnflag = 'R', false)) WHERE rn = 1""", ("W1", "S2", "PR2"))
def q_dedup_keep_latest(spark, sf):
    return dedup.keep_latest(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"],
                             order_cols=("l_shipdate",), deleted=F.col("l_returnflag") == "R")


@query("dedup_priority", f"""
SELECT {LINEITEM_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY l_shipdate DESC NULLS LAST,
                                        CASE l_linestatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END ASC NULLS LAST,
                                        {LINEITEM_TIEBREAK}) AS rn
  FROM lineitem) WHERE rn = 1""", ("W2",))
def q_dedup_priority(spark, sf):
    pri = F.when(F.col("l_linestatus") == "O", 0).when(F.col("l_linestatus") == "F", 1).otherwise(2)
    return dedup.keep_best(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"],
                           [Order("l_shipdate", desc=True), Order(pri)])


@query("immutable_fact", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
       CAST(CAST(l_extendedprice AS DECIMAL(18,4)) AS DOUBLE) AS l_extendedprice,
       l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINEITEM_TIEBREAK}) AS rn
  FROM lineitem) WHERE rn = 1""", ("S7",))
def q_immutable_fact(spark, sf):
    out = dedup.immutable_fact(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], money=False)
    return C.money(out, extra=("l_extendedprice",))


@query("audit_trail", """
SELECT DISTINCT text, lang, source FROM documents""", ("S8",))
def q_audit_trail(spark, sf):
    return dedup.audit_trail(t(spark, sf, "documents").select("text", "lang", "source"))


@query("masking", """
SELECT c_custkey, 'XXXX-XXXX-XXXX-' || right(c_name, 4) AS c_name, c_nationkey,
       sha256('alloy-salt' || c_mktsegment) AS c_mktsegment
FROM customer""", ("C6", "C7", "S9"))
def q_masking(spark, sf):
    c = t(spark, sf, "customer").withColumnRenamed("c_acctbal", "CVV")
    return C.mask(c, mask_cols=["c_name"], drop_cols=["CVV"], hash_cols=["c_mktsegment"],
                  salt="alloy-salt")


@query("money_cast", """
SELECT c_custkey, c_name, c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(18,4)) AS DOUBLE) AS c_acctbal,
       c_mktsegment FROM customer""", ("C4",))
def q_money_cast(spark, sf):
    return C.money(t(spark, sf, "customer"), extra=("c_acctbal",))


@query("null_policy", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       coalesce(CASE WHEN trim(o_orderpriority) IN ('-1', '9999', 'N/A', '5-LOW') THEN NULL ELSE o_orderpriority END,
                'UNSPECIFIED') AS o_orderpriority
FROM orders""", ("C5",))
def q_null_policy(spark, sf):
    return C.null_policy(t(spark, sf, "orders"), sentinels=("-1", "9999", "N/A", "5-LOW"),
                         defaults={"o_orderpriority": "UNSPECIFIED"}, columns=["o_orderpriority"])


@query("upc_standard", """
SELECT p_partkey, lpad(trim(CAST(p_size * 1000003 + p_partkey AS VARCHAR)), 12, '0') AS upc,
       regexp_full_match(trim(CAST(p_size * 1000003 + p_partkey AS VARCHAR)), '\\d{12}') AS is_standard
FROM part""", ("C9", "V7"))
def q_upc_standard(spark, sf):
    p = t(spark, sf, "part")
    raw = F.col("p_size") * 1000003 + F.col("p_partkey")
    padded, ok = C.upc_standard(raw)
    return p.select("p_partkey", padded.alias("upc"), ok.alias("is_standard"))


@query("to_text", """
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(38,2)) AS VARCHAR) AS price_text,
       strftime(o_orderdate, '%Y-%m-%d') AS date_text FROM orders""", ("C8",))
def q_to_text(spark, sf):
    o = t(spark, sf, "orders")
    types = {f.name: f.dataType for f in o.schema.fields}
    return o.select("o_orderkey", C.to_text(F.col("o_totalprice"), types["o_totalprice"]).alias("price_text"),
                    C.to_text(F.col("o_orderdate"), types["o_orderdate"]).alias("date_text"))
