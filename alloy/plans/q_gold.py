"""Gold models, routing and layer validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alloy.functions import columns as C
from alloy.operators import dedup, filters, gold, quality
from alloy.operators.joins import Edge, enrich
from alloy.plans.fixtures import ROUTING_RULES_SQL, routing_rules, t
from alloy.plans.q_history import SCD2_SQL, events_scd2
from alloy.plans.registry import query


def hk(*cols: str) -> str:
    """SQL twin of ``hash_key`` for integer / string columns."""
    return "sha256(" + " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in cols) + ")"


@query("gold_flat", """
SELECT l_orderkey, l_linenumber, l_quantity,
       date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days_to_ship,
       CASE WHEN l_quantity >= 40 THEN 'bulk' WHEN l_quantity >= 10 THEN 'regular' ELSE 'small' END AS qty_band,
       coalesce(o_orderpriority, 'UNKNOWN') AS priority,
       CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) AS net_price
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""", ("G1",))
def q_gold_flat(spark, sf):
    li = t(spark, sf, "lineitem")
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    wide = enrich(li, [(o, Edge("l_orderkey", "o_orderkey"))])
    return gold.gold_flat(wide, ["l_orderkey", "l_linenumber", "l_quantity"], {
        "days_to_ship": F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")),
        "qty_band": F.when(F.col("l_quantity") >= 40, "bulk").when(F.col("l_quantity") >= 10, "regular")
        .otherwise("small"),
        "priority": F.coalesce(F.col("o_orderpriority"), F.lit("UNKNOWN")),
        "net_price": (F.col("l_extendedprice").cast(C.MONEY_TYPE)
                      * (F.lit(1).cast(C.MONEY_TYPE) - F.col("l_discount").cast(C.MONEY_TYPE))).cast("double")})


def _star(spark, sf):
    li = t(spark, sf, "lineitem")
    wide = enrich(li, [
        (t(spark, sf, "orders").select("o_orderkey", "o_custkey"), Edge("l_orderkey", "o_orderkey")),
        (t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), Edge("o_custkey", "c_custkey")),
        (t(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), Edge("l_partkey", "p_partkey"))])
    return gold.star(wide, {"customer": ["o_custkey", "c_name", "c_mktsegment"],
                            "part": ["l_partkey", "p_name", "p_brand"]},
                     ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"], date_col="l_shipdate")


STAR_BASE = """sb AS (SELECT * FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
                          LEFT JOIN customer ON o_custkey = c_custkey
                          LEFT JOIN part ON l_partkey = p_partkey)"""


@query("star_fact", f"""
WITH {STAR_BASE}
SELECT {hk('o_custkey')} AS customer_sk, {hk('l_partkey')} AS part_sk,
       year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS date_sk,
       l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM sb""", ("G2",))
def q_star_fact(spark, sf):
    return _star(spark, sf)["FACT"]


@query("star_dim_customer", f"""
WITH {STAR_BASE}
SELECT DISTINCT o_custkey, c_name, c_mktsegment, {hk('o_custkey')} AS customer_sk FROM sb""", ("G2",))
def q_star_dim_customer(spark, sf):
    return _star(spark, sf)["DIM_CUSTOMER"]


@query("star_dim_date", """
SELECT DISTINCT year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS date_sk,
       strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS calendar_date, year(l_shipdate) AS year,
       month(l_shipdate) AS month, day(l_shipdate) AS day, dayofweek(l_shipdate) AS day_of_week
FROM lineitem""", ("G2",))
def q_star_dim_date(spark, sf):
    d = _star(spark, sf)["DIM_DATE"]
    return d.withColumn("calendar_date", F.date_format("calendar_date", "yyyy-MM-dd"))


LOAD_DTS = "2025-01-01 00:00:00"


@query("vault_hub", f"""
SELECT {hk('c_custkey')} AS HK, c_custkey, TIMESTAMP '{LOAD_DTS}' AS LOAD_DTS, 'customer' AS RECORD_SOURCE
FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IS NOT NULL)""", ("G3a",))
def q_vault_hub(spark, sf):
    return gold.hub(t(spark, sf, "customer"), ["c_custkey"], LOAD_DTS, "customer")


@query("vault_sat", f"""
WITH s AS (SELECT {hk('o_custkey')} AS HK, o_orderstatus, o_orderpriority,
                  {hk('o_orderstatus', 'o_orderpriority')} AS HASHDIFF, o_orderdate AS LOAD_DTS, o_orderkey
           FROM orders),
l AS (SELECT *, lag(HASHDIFF) OVER (PARTITION BY HK ORDER BY LOAD_DTS, o_orderkey) AS prev FROM s)
SELECT HK, o_orderstatus, o_orderpriority, HASHDIFF, LOAD_DTS, o_orderkey, 'orders' AS RECORD_SOURCE
FROM l WHERE prev IS NULL OR prev <> HASHDIFF""", ("G3b",))
def q_vault_sat(spark, sf):
    return gold.satellite(t(spark, sf, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"],
                          "o_orderdate", tiebreak=["o_orderkey"], source="orders")


@query("vault_link", f"""
SELECT {hk('o_custkey', 'o_orderkey')} AS LINK_HK, {hk('o_custkey')} AS HK_A, {hk('o_orderkey')} AS HK_B,
       TIMESTAMP '{LOAD_DTS}' AS LOAD_DTS, 'orders' AS RECORD_SOURCE
FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL)""",
       ("G3c", "U3"))
def q_vault_link(spark, sf):
    return gold.link(t(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], LOAD_DTS, "orders")


@query("one_big_table", """
SELECT l.*, o_orderdate, o_orderpriority, c_name, c_mktsegment, n_name, r_name, p_name, p_brand, s_name
FROM lineitem l LEFT JOIN orders ON l_orderkey = o_orderkey
                LEFT JOIN customer ON o_custkey = c_custkey
                LEFT JOIN nation ON c_nationkey = n_nationkey
                LEFT JOIN region ON n_regionkey = r_regionkey
                LEFT JOIN part ON l_partkey = p_partkey
                LEFT JOIN supplier ON l_suppkey = s_suppkey""", ("G4",))
def q_one_big_table(spark, sf):
    li = t(spark, sf, "lineitem")
    wide = gold.one_big_table(li, [
        (t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"),
         Edge("l_orderkey", "o_orderkey")),
        (t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"),
         Edge("o_custkey", "c_custkey")),
        (t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), Edge("c_nationkey", "n_nationkey")),
        (t(spark, sf, "region"), Edge("n_regionkey", "r_regionkey")),
        (t(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), Edge("l_partkey", "p_partkey")),
        (t(spark, sf, "supplier").select("s_suppkey", "s_name"), Edge("l_suppkey", "s_suppkey"))])
    return wide.select(*li.columns, "o_orderdate", "o_orderpriority", "c_name", "c_mktsegment", "n_name",
                       "r_name", "p_name", "p_brand", "s_name")


EXCLUDED = ("coalesce(list_contains(list_filter(list_transform(string_split(coalesce({ex}, ''), ','), lambda x: trim(x)),"
            " lambda x: x <> ''), {cat}), false)")
ROUTE_SQL = f"""{ROUTING_RULES_SQL},
res AS (SELECT r.value, r.target_table, r.merge_into, r.exclusions,
               CASE WHEN r.merge_into IS NOT NULL THEN m.target_table ELSE r.target_table END AS gold_table
        FROM rules r LEFT JOIN rules m ON upper(r.merge_into) = upper(m.value)),
routed AS (SELECT o.*, res.gold_table FROM orders o JOIN res ON upper(o.o_orderpriority) = upper(res.value)
           WHERE res.gold_table IS NOT NULL AND NOT {EXCLUDED.format(ex='res.exclusions', cat='o.o_orderstatus')})"""


def routed_orders(spark, sf):
    return gold.route(t(spark, sf, "orders"), routing_rules(spark, sf), "o_orderpriority", "o_orderstatus")


@query("route", f"WITH {ROUTE_SQL} SELECT * FROM routed", ("G5", "SNK5", "FL4"))
def q_route(spark, sf):
    return routed_orders(spark, sf)


@query("reconcile_routes", f"""
WITH {ROUTE_SQL},
s AS (SELECT upper(o.o_orderpriority) AS v, count(*) AS silver_rows,
             count_if({EXCLUDED.format(ex='r.exclusions', cat='o.o_orderstatus')}) AS excluded_rows
      FROM orders o JOIN rules r ON upper(o.o_orderpriority) = upper(r.value) GROUP BY 1),
net AS (SELECT res.*, coalesce(s.silver_rows, 0) AS silver_rows, coalesce(s.excluded_rows, 0) AS excluded_rows,
               coalesce(s.silver_rows, 0) - coalesce(s.excluded_rows, 0) AS _net
        FROM res LEFT JOIN s ON upper(res.value) = s.v),
mi AS (SELECT upper(merge_into) AS v, sum(_net) AS merged_rows FROM net WHERE merge_into IS NOT NULL GROUP BY 1),
g AS (SELECT gold_table AS gt, count(*) AS gold_rows FROM routed GROUP BY 1),
x AS (SELECT net.*, coalesce(mi.merged_rows, 0) AS merged_rows, coalesce(g.gold_rows, 0) AS g_rows,
             net._net + coalesce(mi.merged_rows, 0) AS e_rows,
             target_table IS NOT NULL AND merge_into IS NULL AS active
      FROM net LEFT JOIN mi ON upper(net.value) = mi.v LEFT JOIN g ON net.target_table = g.gt),
y AS (SELECT *, CASE WHEN e_rows = 0 AND g_rows = 0 THEN 0.0 WHEN e_rows = 0 THEN 1.0
                     ELSE CAST(abs(g_rows - e_rows) AS DOUBLE) / CAST(e_rows AS DOUBLE) END AS var FROM x)
SELECT value, target_table, merge_into, silver_rows, excluded_rows, merged_rows,
       CASE WHEN active THEN e_rows END AS expected_rows, CASE WHEN active THEN g_rows END AS gold_rows,
       CASE WHEN active THEN round(var * 100.0, 2) END AS variance_pct,
       CASE WHEN target_table IS NULL THEN 'SKIPPED_NO_TARGET' WHEN merge_into IS NOT NULL THEN 'SKIPPED_MERGED'
            WHEN var <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS status
FROM y""", ("V3",))
def q_reconcile_routes(spark, sf):
    return quality.reconcile_routes(t(spark, sf, "orders"), routed_orders(spark, sf), routing_rules(spark, sf),
                                    "o_orderpriority", "o_orderstatus")


def _var_sql(a: str, e: str) -> str:
    return (f"CASE WHEN {e} = 0 AND {a} = 0 THEN 0.0 WHEN {e} = 0 THEN 1.0 "
            f"ELSE CAST(abs({a} - {e}) AS DOUBLE) / CAST({e} AS DOUBLE) END")


@query("row_parity", f"""
WITH pairs AS (
  SELECT 'lineitem' AS table_name,
         (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem
                                WHERE NOT coalesce(l_returnflag = 'R', false))) AS expected_rows,
         (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem
                                WHERE NOT coalesce(l_returnflag = 'R', false))) AS actual_rows
  UNION ALL SELECT 'orders', (SELECT count(*) FROM orders),
         (SELECT count(*) FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('P', 'X'))
  UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer))
SELECT table_name, expected_rows, actual_rows, round(({_var_sql('actual_rows', 'expected_rows')}) * 100.0, 2) AS variance_pct,
       CASE WHEN {_var_sql('actual_rows', 'expected_rows')} <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS status
FROM pairs""", ("V1", "V1b"))
def q_row_parity(spark, sf):
    li = t(spark, sf, "lineitem")
    deleted = F.col("l_returnflag") == "R"
    silver_li = dedup.keep_latest(li, ["l_orderkey", "l_linenumber"], ("l_shipdate",), deleted=deleted)
    o = t(spark, sf, "orders")
    c = t(spark, sf, "customer")
    expected = (quality.live_key_count(li, "lineitem", ["l_orderkey", "l_linenumber"], deleted)
                .unionByName(quality.layer_count(o, "orders", "BRONZE"))
                .unionByName(quality.layer_count(c, "customer", "BRONZE")))
    actual = (quality.layer_count(silver_li, "lineitem", "SILVER")
              .unionByName(quality.layer_count(filters.exclude_categories(o, "o_orderstatus", "P,X"), "orders", "SILVER"))
              .unionByName(quality.layer_count(C.money(c, extra=("c_acctbal",)), "customer", "SILVER")))
    return quality.row_parity(expected, actual)


@query("row_parity_scd2", f"""
WITH {SCD2_SQL},
pairs AS (SELECT 'events' AS table_name, (SELECT count(DISTINCT user_id) FROM events) AS expected_rows,
                 (SELECT count_if(EFFECTIVE_TO IS NULL) FROM v) AS actual_rows)
SELECT table_name, expected_rows, actual_rows, round(({_var_sql('actual_rows', 'expected_rows')}) * 100.0, 2) AS variance_pct,
       CASE WHEN {_var_sql('actual_rows', 'expected_rows')} <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS status
FROM pairs""", ("V2",))
def q_row_parity_scd2(spark, sf):
    e = t(spark, sf, "events")
    expected = quality.live_key_count(e, "events", ["user_id"])
    actual = quality.layer_count(events_scd2(spark, sf), "events", "SILVER")
    return quality.row_parity(expected, actual)


@query("null_expectations", """
WITH j AS (SELECT c.c_custkey, o.o_orderkey, o.o_orderstatus FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey),
n AS (SELECT 'c_custkey' AS column_name, 1 AS position, count_if(c_custkey IS NULL) AS null_count, true AS is_pk FROM j
      UNION ALL SELECT 'o_orderkey', 2, count_if(o_orderkey IS NULL), true FROM j
      UNION ALL SELECT 'o_orderstatus', 3, count_if(o_orderstatus IS NULL), false FROM j)
SELECT *, CASE WHEN NOT is_pk THEN 'INFO' WHEN null_count = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM n""", ("V4",))
def q_null_expectations(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey")
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    j = c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey", "o_orderstatus")
    return quality.null_expectations(j, ["c_custkey", "o_orderkey"])


@query("duplicate_groups", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_variants
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""", ("V5",))
def q_duplicate_groups(spark, sf):
    return quality.duplicate_groups(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey"])


@query("pk_unique", """
SELECT count(*) AS distinct_keys, sum(n) AS n_rows, count_if(n > 1) AS duplicate_keys
FROM (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY o_orderkey)""", ("V5", "T-07"))
def q_pk_unique(spark, sf):
    return quality.pk_unique(t(spark, sf, "orders"), ["o_orderkey"])


def _pres_side(side: str, src: str, exprs: dict[str, str]) -> str:
    parts = []
    for c, e in exprs.items():
        parts.append(f"SELECT '{c}' AS column_name, count({c}) AS {side}_nonnull, "
                     f"CAST(sum(CAST(('0x' || substr(md5({e}), 1, 12)) AS BIGINT)) AS VARCHAR) AS {side}_checksum FROM {src}")
    return "\nUNION ALL ".join(parts)


_PRES_B = {"c_custkey": "CAST(c_custkey AS VARCHAR)", "c_name": "c_name", "c_nationkey": "CAST(c_nationkey AS VARCHAR)",
           "c_acctbal": "CAST(c_acctbal AS VARCHAR)", "c_mktsegment": "c_mktsegment"}
_PRES_S = dict(_PRES_B, c_acctbal=r"regexp_replace(regexp_replace(CAST(c_acctbal AS VARCHAR), '0+$', ''), '\.$', '.0')")


@query("preservation", f"""
WITH s AS (SELECT c_custkey, 'XXXX-XXXX-XXXX-' || right(c_name, 4) AS c_name, c_nationkey,
                  CAST(c_acctbal AS DECIMAL(18,4)) AS c_acctbal, c_mktsegment FROM customer),
b AS (SELECT * FROM customer WHERE c_custkey IN (SELECT c_custkey FROM s)),
bs AS ({_pres_side('bronze', 'b', _PRES_B)}),
ss AS ({_pres_side('silver', 's', _PRES_S)})
SELECT bs.column_name, bronze_nonnull, bronze_checksum, silver_nonnull, silver_checksum,
       silver_nonnull IS NOT NULL AS present,
       CASE WHEN silver_nonnull IS NOT NULL AND bronze_nonnull = silver_nonnull AND bronze_checksum = silver_checksum
            THEN 'PASS' ELSE 'FAIL' END AS status
FROM bs LEFT JOIN ss ON bs.column_name = ss.column_name""", ("V8",))
def q_preservation(spark, sf):
    c = t(spark, sf, "customer")
    silver = C.mask(C.money(c, extra=("c_acctbal",)), mask_cols=["c_name"])
    return quality.preservation(c, silver, ["c_custkey"])


@query("completeness", """
SELECT d.lang, count(*) AS n_rows, count_if(l.quality IS NOT NULL) AS nonnull_quality,
       round(CAST(count_if(l.quality IS NOT NULL) AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE), 2) AS pct_quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""", ("V9",))
def q_completeness(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang")
    j = d.join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return quality.completeness(j, ["lang"], ["quality"])


@query("format_threshold", """
WITH u AS (SELECT regexp_full_match(trim(CAST(p_size * 1000003 + p_partkey AS VARCHAR)), '\\d{12}') AS ok FROM part)
SELECT count(*) AS n_rows, count_if(NOT ok) AS n_bad,
       round(CAST(count_if(NOT ok) AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE), 2) AS bad_pct,
       CASE WHEN round(CAST(count_if(NOT ok) AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE), 2) <= 30.0
            THEN 'PASS' ELSE 'FAIL' END AS status
FROM u""", ("V7",))
def q_format_threshold(spark, sf):
    p = t(spark, sf, "part")
    _padded, ok = C.upc_standard(F.col("p_size") * 1000003 + F.col("p_partkey"))
    return quality.format_threshold(p, ok, 30.0)
