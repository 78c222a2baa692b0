"""Flagship Silver -> Gold slice used by ``entry`` and the bench.

Bronze lineitem -> soft-delete filter (returnflag R) -> keep-latest dedup on
(l_orderkey, l_linenumber) -> money typing -> FK enrichment to orders, customer,
nation, region -> revenue by region x market segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alloy.functions.columns import MONEY_TYPE, money
from alloy.operators import dedup
from alloy.operators.joins import Edge, enrich
from alloy.plans.fixtures import t
from alloy.plans.registry import query


def silver_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem")
    latest = dedup.keep_latest(li, ["l_orderkey", "l_linenumber"], order_cols=("l_shipdate",),
                               deleted=F.col("l_returnflag") == "R")
    return money(latest, extra=("l_extendedprice", "l_discount", "l_tax"))


def revenue_by_region_segment(spark: SparkSession, sf: str) -> DataFrame:
    li = silver_lineitem(spark, sf).select("l_orderkey", "l_extendedprice", "l_discount", "l_quantity")
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cust = t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = t(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    region = t(spark, sf, "region").select("r_regionkey", "r_name")
    wide = enrich(li, [(orders, Edge("l_orderkey", "o_orderkey")),
                       (cust, Edge("o_custkey", "c_custkey")),
                       (nation, Edge("c_nationkey", "n_nationkey")),
                       (region, Edge("n_regionkey", "r_regionkey"))], how="inner")
    revenue = F.col("l_extendedprice") * (F.lit(1).cast(MONEY_TYPE) - F.col("l_discount"))
    return wide.groupBy("r_name", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("l_quantity").cast(MONEY_TYPE)).cast("double").alias("sum_qty"),
        F.sum(revenue).cast("double").alias("revenue"))


FLAGSHIP_SQL = """
WITH li AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC NULLS LAST, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
                 l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn
    FROM lineitem WHERE NOT coalesce(l_returnflag = 'R', false)) WHERE rn = 1)
SELECT r_name, c_mktsegment, count(*) AS n_lines,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4)))) AS DOUBLE) AS revenue
FROM li JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, c_mktsegment"""


query("revenue_by_region_segment", FLAGSHIP_SQL, ("FL1", "W1", "C4", "J1", "AG10"))(
    revenue_by_region_segment)
