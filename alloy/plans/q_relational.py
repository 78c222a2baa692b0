"""Joins, aggregations, set mutation and run-registry reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloy.functions.columns import MONEY_TYPE
from alloy.operators import aggregates as A
from alloy.operators import dedup, joins, setops
from alloy.operators.dedup import Order
from alloy.operators.pattern_index import match_rules_indexed
from alloy.plans.fixtures import (LINEAGE_SQL, OBSERVATIONS_SQL, ROUTING_RULES_SQL, RUNS_SQL,
                                  CDC_EVENTS_SQL, cdc_events, lineage, observations,
                                  routing_rules, run_log, runs, t)
from alloy.plans.registry import query
from alloy.sources.readers import TEST_TABLES  # noqa: F401 - documented input set


@query("enrich", """
SELECT l_orderkey, l_linenumber, o_orderdate, c_name, n_name, r_name
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
              LEFT JOIN customer ON o_custkey = c_custkey
              LEFT JOIN nation ON c_nationkey = n_nationkey
              LEFT JOIN region ON n_regionkey = r_regionkey""", ("J1",))
def q_enrich(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    wide = joins.enrich(li, [
        (t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), joins.Edge("l_orderkey", "o_orderkey")),
        (t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), joins.Edge("o_custkey", "c_custkey")),
        (t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), joins.Edge("c_nationkey", "n_nationkey")),
        (t(spark, sf, "region"), joins.Edge("n_regionkey", "r_regionkey"))])
    return wide.select("l_orderkey", "l_linenumber", "o_orderdate", "c_name", "n_name", "r_name")


@query("label_join", """
SELECT d.doc_id, d.lang, d.source, d.n_chars, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""", ("J2", "G7"))
def q_label_join(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return joins.label_join(docs, t(spark, sf, "labels"), "doc_id", ["quality", "toxic"])


FK_EDGES = [("lineitem", "l_orderkey", "orders", "o_orderkey"),
            ("lineitem", "l_partkey", "part", "p_partkey"),
            ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
            ("orders", "o_custkey", "customer", "c_custkey"),
            ("customer", "c_nationkey", "nation", "n_nationkey"),
            ("supplier", "s_nationkey", "nation", "n_nationkey"),
            ("nation", "n_regionkey", "region", "r_regionkey")]


@query("fk_orphans", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS child_table, '{cc}' AS child_column, '{p}' AS parent_table, '{pc}' AS parent_column,
       count(*) AS orphan_rows FROM {c} WHERE {cc} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} WHERE {p}.{pc} = {c}.{cc})"""
    for c, cc, p, pc in FK_EDGES), ("J11", "V6"))
def q_fk_orphans(spark, sf):
    return joins.fk_orphans([(c, t(spark, sf, c), cc, p, t(spark, sf, p), pc) for c, cc, p, pc in FK_EDGES])


@query("distribution", """
SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority""", ("AG3",))
def q_distribution(spark, sf):
    return A.distribution(t(spark, sf, "orders"), "o_orderpriority")


@query("pct_of_total", """
SELECT o_orderpriority, n, round(CAST(n AS DOUBLE) * 100.0 / CAST(sum(n) OVER () AS DOUBLE), 2) AS pct_of_total
FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority)""", ("AG9", "J10"))
def q_pct_of_total(spark, sf):
    return A.pct_of_total(A.distribution(t(spark, sf, "orders"), "o_orderpriority"), "n")


@query("conditional_counts", """
SELECT l_linestatus, count(*) AS n_rows, count_if(l_returnflag = 'R') AS n_returned,
       count_if(l_discount > 0.05) AS n_discounted, count_if(l_quantity >= 25) AS n_bulk
FROM lineitem GROUP BY l_linestatus""", ("AG2",))
def q_conditional_counts(spark, sf):
    return A.count_ifs(t(spark, sf, "lineitem"), ["l_linestatus"], {
        "n_returned": F.col("l_returnflag") == "R",
        "n_discounted": F.col("l_discount") > 0.05,
        "n_bulk": F.col("l_quantity") >= 25})


@query("banded", """
SELECT CASE WHEN value >= 80 THEN 'very_high' WHEN value >= 50 THEN 'high'
            WHEN value >= 20 THEN 'medium' ELSE 'low' END AS band,
       count(*) AS n, min(value) AS min_value
FROM events GROUP BY 1""", ("AG4", "TM5"))
def q_banded(spark, sf):
    return A.banded(t(spark, sf, "events"), "value",
                    [(80, "very_high"), (50, "high"), (20, "medium")], "low")


@query("distinct_keys", """
SELECT 'order' AS key_set, count(DISTINCT l_orderkey) AS distinct_keys FROM lineitem
UNION ALL SELECT 'line', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem
                                        WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL)
UNION ALL SELECT 'part_supp', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem
                                             WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL)""",
       ("AG5",))
def q_distinct_keys(spark, sf):
    return A.distinct_keys(t(spark, sf, "lineitem"), {
        "order": ["l_orderkey"], "line": ["l_orderkey", "l_linenumber"],
        "part_supp": ["l_partkey", "l_suppkey"]})


@query("ordered_text", """
SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ','
                              ORDER BY l_linenumber, l_partkey) AS text
FROM lineitem GROUP BY l_orderkey""", ("AG6",))
def q_ordered_text(spark, sf):
    li = t(spark, sf, "lineitem")
    txt = F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_partkey").cast("string"))
    return A.ordered_text(li, ["l_orderkey"], ["l_linenumber", "l_partkey"], txt)


@query("collect_objects", """
SELECT o_custkey, to_json(list({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus} ORDER BY o_orderkey)) AS objects
FROM orders GROUP BY o_custkey""", ("AG7",))
def q_collect_objects(spark, sf):
    return A.collect_objects(t(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"],
                             ["o_orderkey", "o_orderstatus"])


@query("pre_aggregate", """
SELECT c_mktsegment, o_orderpriority, count(*) AS n_rows,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total_price,
       count(DISTINCT o_custkey) AS n_customers,
       count(o_orderstatus) AS nonnull_o_orderstatus,
       round(CAST(count(o_orderstatus) AS DOUBLE) * 100.0 / CAST(nullif(count(*), 0) AS DOUBLE), 2) AS complete_o_orderstatus
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_mktsegment, o_orderpriority""", ("AG10", "S4"))
def q_pre_aggregate(spark, sf):
    o = t(spark, sf, "orders")
    c = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    wide = joins.enrich(o, [(c, joins.Edge("o_custkey", "c_custkey"))], how="inner")
    return A.pre_aggregate(wide, ["c_mktsegment", "o_orderpriority"], {
        "total_price": A.money_sum(F.col("o_totalprice")),
        "n_customers": F.count_distinct("o_custkey")}, ["o_orderstatus"])


@query("top_n", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC LIMIT 20""", ("T1",))
def q_top_n(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.orderBy(F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc()).limit(20)


# ---- run registry (lineage, runs, learnings) ------------------------------------
@query("coverage", f"""
WITH {LINEAGE_SQL}
SELECT bronze_database, bronze_schema, count(*) AS total_bronze_tables, count(silver_table) AS silver_covered,
       count(gold_table) AS gold_covered,
       round(CAST(count(silver_table) AS DOUBLE) * 100.0 / CAST(nullif(count(*), 0) AS DOUBLE), 1) AS silver_pct,
       round(CAST(count(gold_table) AS DOUBLE) * 100.0 / CAST(nullif(count(*), 0) AS DOUBLE), 1) AS gold_pct
FROM lineage GROUP BY bronze_database, bronze_schema""", ("AG1",))
def q_coverage(spark, sf):
    return A.coverage(lineage(spark, sf), ["bronze_database", "bronze_schema"],
                      {"silver": "silver_table", "gold": "gold_table"}, total="total_bronze_tables")


@query("layer_funnel", f"""
WITH {LINEAGE_SQL},
c AS (SELECT 'BRONZE' AS layer, 1 AS layer_order, sum(bronze_rows) AS rows FROM lineage
      UNION ALL SELECT 'SILVER', 2, sum(silver_rows) FROM lineage
      UNION ALL SELECT 'GOLD', 3, sum(gold_rows) FROM lineage)
SELECT layer, layer_order, rows, lag(rows) OVER (ORDER BY layer_order) AS prev_rows,
       round(CAST(lag(rows) OVER (ORDER BY layer_order) - rows AS DOUBLE) * 100.0
             / CAST(nullif(lag(rows) OVER (ORDER BY layer_order), 0) AS DOUBLE), 2) AS drop_pct
FROM c""", ("AG11",))
def q_layer_funnel(spark, sf):
    lin = lineage(spark, sf)
    sums = lin.agg(F.sum("bronze_rows").alias("b"), F.sum("silver_rows").alias("s"),
                   F.sum("gold_rows").alias("g"))
    counts = sums.select(F.explode(F.array(
        F.struct(F.lit("BRONZE").alias("layer"), F.lit(1).alias("layer_order"), F.col("b").alias("rows")),
        F.struct(F.lit("SILVER").alias("layer"), F.lit(2).alias("layer_order"), F.col("s").alias("rows")),
        F.struct(F.lit("GOLD").alias("layer"), F.lit(3).alias("layer_order"), F.col("g").alias("rows")))).alias("x")
    ).select("x.*")
    return A.layer_funnel(counts)


@query("lineage_report", f"""
WITH {LINEAGE_SQL}, {CDC_EVENTS_SQL},
bc AS (SELECT 'T' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS tbl, count(*) AS n FROM events GROUP BY user_id),
sc AS (SELECT 'T' || lpad(CAST(user_id AS VARCHAR), 5, '0') || '_SILVER' AS tbl, count(*) AS n
       FROM cdc WHERE _OPERATION != 'DELETE' GROUP BY user_id),
gc AS (SELECT 'T' || lpad(CAST(user_id AS VARCHAR), 5, '0') || '_GOLD' AS tbl, count(*) AS n
       FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT l.bronze_table, l.status, pd.strategy, coalesce(bc.n, 0) AS bronze_count, l.silver_table,
       coalesce(sc.n, 0) AS silver_count, l.gold_table, coalesce(gc.n, 0) AS gold_count
FROM lineage l LEFT JOIN bc ON l.bronze_table = bc.tbl
               LEFT JOIN sc ON l.silver_table = sc.tbl
               LEFT JOIN gc ON l.gold_table = gc.tbl
               LEFT JOIN (SELECT DISTINCT 'T' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS tbl, event_type AS strategy
                          FROM events WHERE value >= 95) pd ON l.bronze_table = pd.tbl""", ("J3",))
def q_lineage_report(spark, sf):
    lin = lineage(spark, sf)
    name = F.concat(F.lit("T"), F.lpad(F.col("user_id").cast("string"), 5, "0"))
    e = t(spark, sf, "events")
    bc = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("bronze_count")).select(name.alias("_b"), "bronze_count")
    sc = (cdc_events(spark, sf).filter(F.col("_OPERATION") != "DELETE").groupBy("user_id")
          .agg(F.count(F.lit(1)).alias("silver_count"))
          .select(F.concat(name, F.lit("_SILVER")).alias("_s"), "silver_count"))
    gc = (e.filter(F.col("event_type") == "purchase").groupBy("user_id")
          .agg(F.count(F.lit(1)).alias("gold_count"))
          .select(F.concat(name, F.lit("_GOLD")).alias("_g"), "gold_count"))
    pd = e.filter(F.col("value") >= 95).select(name.alias("_p"), F.col("event_type").alias("strategy")).distinct()
    j = (lin.join(bc, lin.bronze_table == bc._b, "left").join(pd, lin.bronze_table == pd._p, "left")
         .join(sc, lin.silver_table == sc._s, "left")
         .join(gc, lin.gold_table == gc._g, "left"))
    return j.select("bronze_table", "status", "strategy", F.coalesce("bronze_count", F.lit(0)).alias("bronze_count"),
                    "silver_table", F.coalesce("silver_count", F.lit(0)).alias("silver_count"),
                    "gold_table", F.coalesce("gold_count", F.lit(0)).alias("gold_count"))


@query("learnings_per_run", f"""
WITH {RUNS_SQL}, {OBSERVATIONS_SQL}
SELECT r.execution_id, r.status, count(o.pattern_signature) AS n_learnings
FROM runs r LEFT JOIN (SELECT * FROM obs WHERE confidence >= 0.9) o ON r.execution_id = o.execution_id
GROUP BY r.execution_id, r.status""", ("J8", "TM5"))
def q_learnings_per_run(spark, sf):
    r = runs(spark, sf).select("execution_id", "status")
    o = observations(spark, sf).filter(F.col("confidence") >= 0.9)
    return joins.children_per_parent(r, o, "execution_id", "pattern_signature", "n_learnings")


@query("latest_per_key", f"""
WITH {RUNS_SQL},
plans AS (SELECT l.* FROM runlog l JOIN runs r ON l.execution_id = r.execution_id
          WHERE r.status = 'COMPLETE' AND l.confidence >= 0.85),
ranked AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY created_at DESC NULLS LAST,
                                        execution_id, phase, created_at, event_id, status, confidence) AS rn
           FROM plans)
SELECT phase, execution_id, created_at, event_id, confidence, true AS reused FROM ranked WHERE rn = 1
UNION ALL
SELECT DISTINCT phase, NULL, NULL, NULL, NULL, false FROM runlog
WHERE phase NOT IN (SELECT phase FROM plans)""", ("W3", "J4"))
def q_latest_per_key(spark, sf):
    log = run_log(spark, sf)
    done = runs(spark, sf).filter(F.col("status") == "COMPLETE").select("execution_id")
    plans = log.join(done, "execution_id", "inner").filter(F.col("confidence") >= 0.85)
    latest = dedup.latest_per_key(plans.select(*log.columns), ["phase"], [Order("created_at", desc=True)])
    hits = latest.select("phase", "execution_id", "created_at", "event_id", "confidence",
                         F.lit(True).alias("reused"))
    misses = (log.select("phase").distinct().join(plans.select("phase").distinct(), "phase", "left_anti")
              .select("phase", F.lit(None).cast("long").alias("execution_id"),
                      F.lit(None).cast("timestamp_ntz").alias("created_at"),
                      F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("confidence"),
                      F.lit(False).alias("reused")))
    return hits.unionByName(misses)


@query("resolve_routes", f"""
WITH {ROUTING_RULES_SQL}
SELECT r.column_name, r.value, r.target_table, r.merge_into, r.exclusions, r.threshold_pct,
       CASE WHEN r.merge_into IS NOT NULL THEN m.target_table ELSE r.target_table END AS gold_table
FROM rules r LEFT JOIN rules m ON upper(r.merge_into) = upper(m.value)""", ("J7",))
def q_resolve_routes(spark, sf):
    return joins.resolve_merge_targets(routing_rules(spark, sf))


# ---- fixed directive rules for the theta join (configuration, not data) ---------
# pattern, layer, rule name, priority
DIRECTIVES = [("ECONOMY%", "SILVER", "economy_dedup", 10),
              ("%SMALL%", "BOTH", "small_items", 20),
              ("%widget", "SILVER", "widget_names", 30),
              ("%bolt%", "GOLD", "bolt_gold", 40),
              ("%gear", "BOTH", "gear_any", 25),
              ("LARGE%", "SILVER", "large_types", 15)]


def directives_df(spark):
    return spark.createDataFrame(DIRECTIVES, "pattern string, layer string, rule_name string, priority int")


DIRECTIVES_SQL = "directives AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{p}', '{l}', '{n}', {pr})" for p, l, n, pr in DIRECTIVES) + ") AS d(pattern, layer, rule_name, priority))"


@query("match_rules", f"""
WITH {DIRECTIVES_SQL},
m AS (SELECT p.p_partkey, d.rule_name, d.priority FROM part p JOIN directives d
      ON (p.p_type LIKE d.pattern OR p.p_name LIKE d.pattern) AND upper(d.layer) IN ('SILVER', 'BOTH'))
SELECT p_partkey, count(*) AS n_rules,
       string_agg(rule_name, ',' ORDER BY priority DESC, rule_name) AS rules,
       arg_max(rule_name, priority) AS top_rule
FROM m GROUP BY p_partkey""", ("J6", "AG6"))
def q_match_rules(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_type", "p_name")
    d = directives_df(spark)
    m = joins.match_rules(p, d, ["p_type", "p_name"], layer="SILVER").select("p_partkey", "rule_name", "priority")
    # a part matches each of the few rules once at most, so its list is as short as the table
    rules = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("o"), "rule_name")))
    return m.groupBy("p_partkey").agg(
        F.count(F.lit(1)).alias("n_rules"), F.array_join(F.transform(rules, lambda x: x["rule_name"]), ",").alias("rules"),
        F.max_by("rule_name", "priority").alias("top_rule"))


PARTS_OF_NAMES_SQL = """WITH rules AS (
  SELECT DISTINCT '%' || split_part(p_type, ' ', 1) || '%' || right(p_name, 3) AS pattern FROM part
  UNION SELECT '%' || substr(p_name, 2, 12) FROM part WHERE p_partkey % 7 = 0 UNION SELECT '_' || substr(p_type, 2, 4) || '%' FROM part
  UNION SELECT repeat('_', length(p_type)::INT) FROM part WHERE p_partkey % 50 = 0 UNION SELECT '%\\%%' UNION SELECT '')
SELECT p.p_partkey, r.pattern FROM part p JOIN rules r ON p.p_type LIKE r.pattern ESCAPE '\\' OR p.p_name LIKE r.pattern ESCAPE '\\'"""


@query("match_rules_indexed", PARTS_OF_NAMES_SQL, ("J6",))
def q_match_rules_indexed(spark, sf):
    """Rules made from the parts' own names and types: as many as there are parts of a kind."""
    p = t(spark, sf, "part").select("p_partkey", "p_type", "p_name")
    key, name, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    rules = [p.select(F.concat(F.lit("%"), F.split_part(kind, F.lit(" "), F.lit(1)), F.lit("%"), F.right(name, F.lit(3))).alias("pattern")),
             p.filter(key % 7 == 0).select(F.concat(F.lit("%"), F.substring(name, 2, 12)).alias("pattern")),
             p.select(F.concat(F.lit("_"), F.substring(kind, 2, 4), F.lit("%")).alias("pattern")),
             p.filter(key % 50 == 0).select(F.repeat(F.lit("_"), F.length(kind)).alias("pattern")),
             p.select(F.lit("%\\%%").alias("pattern")), p.select(F.lit("").alias("pattern"))]
    rules = reduce(DataFrame.unionByName, rules).distinct()
    return match_rules_indexed(p, rules, ["p_type", "p_name"]).select("p_partkey", "pattern")


@query("recon_summary", "\nUNION ALL\n".join(
    f"""SELECT '{tb}' AS table_name, count(*) AS n_rows,
       (SELECT count(*) FROM (SELECT DISTINCT {k} FROM {tb})) AS distinct_keys,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT {k} FROM {tb})) AS duplicate_rows FROM {tb}"""
    for tb, k in [("lineitem", "l_orderkey, l_linenumber"), ("orders", "o_orderkey"),
                  ("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey")]),
       ("U2", "V5"))
def q_recon_summary(spark, sf):
    out = None
    for tb, keys in [("lineitem", ["l_orderkey", "l_linenumber"]), ("orders", ["o_orderkey"]),
                     ("customer", ["c_custkey"]), ("part", ["p_partkey"]), ("supplier", ["s_suppkey"])]:
        df = t(spark, sf, tb)
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        part = per_key.agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("distinct_keys")) \
            .select(F.lit(tb).alias("table_name"), "n_rows", "distinct_keys",
                    (F.col("n_rows") - F.col("distinct_keys")).alias("duplicate_rows"))
        out = part if out is None else out.unionByName(part)
    return out


@query("upsert", """
WITH tgt AS (SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')),
     src AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal + 100 AS c_acctbal, 'VIP' AS c_mktsegment
             FROM customer WHERE c_acctbal > 5000)
SELECT coalesce(tgt.c_custkey, src.c_custkey) AS c_custkey,
       CASE WHEN tgt.c_custkey IS NOT NULL THEN tgt.c_name ELSE src.c_name END AS c_name,
       CASE WHEN tgt.c_custkey IS NOT NULL THEN tgt.c_nationkey ELSE src.c_nationkey END AS c_nationkey,
       CASE WHEN src.c_custkey IS NOT NULL THEN src.c_acctbal ELSE tgt.c_acctbal END AS c_acctbal,
       CASE WHEN tgt.c_custkey IS NOT NULL THEN tgt.c_mktsegment ELSE src.c_mktsegment END AS c_mktsegment
FROM tgt FULL OUTER JOIN src ON tgt.c_custkey = src.c_custkey""", ("U4",))
def q_upsert(spark, sf):
    c = t(spark, sf, "customer")
    target = c.filter(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY"))
    source = (c.filter(F.col("c_acctbal") > 5000)
              .withColumn("c_acctbal", F.col("c_acctbal") + 100).withColumn("c_mktsegment", F.lit("VIP")))
    return setops.upsert(target, source, ["c_custkey"], ["c_acctbal"])


@query("replace_by_key", """
WITH tgt AS (SELECT doc_id, source, lang, n_chars FROM documents),
     b AS (SELECT doc_id, upper(source) AS source, lang, n_chars + 1 AS n_chars FROM documents WHERE lang = 'de')
SELECT * FROM tgt WHERE upper(source) NOT IN (SELECT upper(source) FROM b)
UNION ALL SELECT * FROM b""", ("U5", "K5"))
def q_replace_by_key(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    batch = (d.filter(F.col("lang") == "de").withColumn("source", F.upper("source"))
             .withColumn("n_chars", F.col("n_chars") + 1))
    return setops.replace_by_key(d, batch, "source")


@query("remove_by_key", """
WITH req AS (SELECT DISTINCT upper(CAST(source AS VARCHAR)) AS k FROM documents WHERE lang = 'es'
             UNION SELECT upper(lang || '_missing') FROM documents WHERE lang = 'es'),
     cnt AS (SELECT upper(CAST(source AS VARCHAR)) AS k, count(*) AS n FROM documents GROUP BY 1)
SELECT req.k AS source, coalesce(cnt.n, 0) AS deleted,
       CASE WHEN coalesce(cnt.n, 0) > 0 THEN 'REMOVED' ELSE 'NOT_FOUND' END AS status
FROM req LEFT JOIN cnt ON req.k = cnt.k""", ("U6", "K5"))
def q_remove_by_key(spark, sf):
    d = t(spark, sf, "documents")
    es = d.filter(F.col("lang") == "es")
    req = es.select("source").unionByName(es.select(F.concat("lang", F.lit("_missing")).alias("source")))
    _remaining, report = setops.remove_by_key(d, req, "source")
    return report
