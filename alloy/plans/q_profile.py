"""Profiling, PK choice, FK discovery, type inference, fingerprints, patterns, strategy."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import functions as F

from alloy.functions.columns import ISO_TS_PATTERN, NUMBER_PATTERN, TRUE_STRINGS, FALSE_STRINGS
from alloy.operators import inclusion as IN
from alloy.operators import keys as K
from alloy.operators import digest_tree as DT
from alloy.operators import profile as P
from alloy.operators import profile_sketches as PS
from alloy.plans.fixtures import cdc_events, t
from alloy.plans.registry import query
from alloy.session import cut_lineage, scratch_path

# Schema of the driver tables (FIXTURES.md part B), used to spell out the SQL twins.
SCHEMAS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"),
                 ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"),
                 ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}
DISCOVERY_TABLES = tuple(SCHEMAS)
NUMERIC = ("int", "bigint", "double")
INTEGRALS = ("int", "bigint")


def _profile_sql(tables) -> str:
    parts = []
    for tb in tables:
        for pos, (c, ty) in enumerate(SCHEMAS[tb], start=1):
            is_str = ty == "string"
            num = ty in NUMERIC
            parts.append(
                f"SELECT '{tb}' AS table_name, '{c}' AS column_name, {pos} AS position, '{ty}' AS data_type, "
                f"count(*) AS n_rows, count_if({c} IS NULL) AS n_nulls, count(DISTINCT {c}) AS n_distinct, "
                f"{f'count_if({c} = {chr(39)}{chr(39)})' if is_str else 'CAST(NULL AS BIGINT)'} AS n_empty, "
                f"{f'round(avg(length({c})), 4)' if is_str else 'CAST(NULL AS DOUBLE)'} AS avg_len, "
                f"{f'CAST(min({c}) AS DOUBLE)' if num else 'CAST(NULL AS DOUBLE)'} AS min_value, "
                f"{f'CAST(max({c}) AS DOUBLE)' if num else 'CAST(NULL AS DOUBLE)'} AS max_value FROM {tb}")
    return "\nUNION ALL ".join(parts)


def _tables(spark, sf, names):
    return {n: t(spark, sf, n) for n in names}


@query("profile", _profile_sql(["orders", "lineitem"]), ("P1",))
def q_profile(spark, sf):
    return P.profile_tables(_tables(spark, sf, ["orders", "lineitem"]), exact=True)


def _pairs_sql(tables) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{tb}' AS table_name, '{a}' AS c1, '{b}' AS c2, count(DISTINCT ({a}, {b})) AS n, count(*) AS n_rows FROM {tb}"
        for tb in tables for a, b in itertools.combinations([c for c, _ in SCHEMAS[tb]], 2))


PK_SQL = f"""
WITH prof AS ({_profile_sql(DISCOVERY_TABLES)}),
p AS (SELECT *, regexp_matches(lower(column_name), '(_id|_key|key|id)$') AS is_key,
             regexp_replace(lower(column_name), '^[a-z]{{1,2}}_', '') AS stripped,
             regexp_replace(lower(table_name), 's$', '') AS sing,
             CASE WHEN n_rows > 0 THEN CAST(n_distinct AS DOUBLE) / CAST(n_rows AS DOUBLE) ELSE 0.0 END AS ratio
      FROM prof),
q AS (SELECT *, (SELECT coalesce(max(i), 0) FROM range(1, least(length(stripped), length(sing)) + 1) r(i)
                 WHERE substr(stripped, 1, i) = substr(sing, 1, i)) AS lcp,
             max(CAST(is_key AS INTEGER)) OVER (PARTITION BY table_name) AS has_key
      FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY
                 CAST(has_key = 1 AND data_type IN ('timestamp', 'timestamp_ntz', 'date') AS INTEGER),
                 CAST(is_key AS INTEGER) DESC, lcp DESC, ratio DESC, position) AS rn FROM q),
pairs AS ({_pairs_sql(DISCOVERY_TABLES)}),
pr AS (SELECT a.table_name, arg_min(a.column_name || ',' || b.column_name, a.rn * 100 + b.rn) AS pair
       FROM r a JOIN r b ON a.table_name = b.table_name AND a.rn < b.rn AND b.rn <= 5
                JOIN pairs p ON p.table_name = a.table_name
                            AND ((p.c1 = a.column_name AND p.c2 = b.column_name) OR (p.c1 = b.column_name AND p.c2 = a.column_name))
       WHERE p.n = p.n_rows GROUP BY a.table_name)
SELECT r.table_name, CASE WHEN ratio < 1.0 AND pair IS NOT NULL THEN pair ELSE column_name END AS pk_column,
       CASE WHEN ratio < 1.0 AND pair IS NOT NULL THEN 1.0 ELSE round(ratio, 6) END AS uniqueness, lcp AS name_match,
       ratio = 1.0 OR pair IS NOT NULL AS is_unique
FROM r LEFT JOIN pr ON r.table_name = pr.table_name WHERE rn = 1"""


@query("pk_candidates", PK_SQL, ("P2", "T-07"))
def q_pk_candidates(spark, sf):
    tables = _tables(spark, sf, DISCOVERY_TABLES)
    return P.pk_candidates(P.profile_tables(tables, exact=True), tables)


MEASURE = "|".join(P.MEASURE_PARTS)


def _plain_sql(c: str, ty: str) -> str:
    """Texts above a length are compared by digest."""
    if ty in INTEGRALS:
        return f"CAST({c} AS VARCHAR)"
    return f"CASE WHEN length({c}) <= {IN.MAX_PLAIN_CHARS} THEN {c} ELSE '{IN.DIGEST_MARK}' || sha256({c}) END"


def _similarity_sql(a: str, b: str) -> str:
    a, b = (f"regexp_replace(regexp_replace(lower({c}), '^[a-z]{{1,2}}_', ''), '(_id|_key|_code|_ref|_num|key|id)$', '')" for c in (a, b))
    return (f"round(1.0 - CAST(levenshtein({a}, {b}) AS DOUBLE) / CAST(greatest(length({a}), length({b}), 1) AS DOUBLE), 4)")


def _fk_sql(tables) -> str:
    vals, rows, cols = [], [], []
    for tb in tables:
        rows.append(f"SELECT '{tb}' AS table_name, count(*) AS table_rows FROM {tb}")
        for c, ty in SCHEMAS[tb]:
            if ty not in (*INTEGRALS, "string"):
                continue
            family, number = ("i", f"CAST({c} AS BIGINT)") if ty in INTEGRALS else ("s", "CAST(NULL AS BIGINT)")
            vals.append(f"SELECT DISTINCT '{tb}' AS table_name, '{c}' AS column_name, '{family}' AS family, {_plain_sql(c, ty)} AS v, "
                        f"{number} AS i FROM {tb} WHERE {c} IS NOT NULL")
            cols.append(f"SELECT '{tb}' AS table_name, '{c}' AS column_name, count({c}) AS n_nonnull FROM {tb}")
    return f"""vals AS ({' UNION ALL '.join(vals)}),
trows AS ({' UNION ALL '.join(rows)}),
cols AS ({' UNION ALL '.join(cols)}),
stats AS (SELECT s.*, trows.table_rows, cols.n_nonnull FROM
            (SELECT table_name, column_name, family, count(*) AS n_distinct, min(i) AS imin, max(i) AS imax,
                    min(v) AS smin, max(v) AS smax
             FROM vals GROUP BY 1, 2, 3) s
          JOIN trows USING (table_name) JOIN cols USING (table_name, column_name)),
targets AS (SELECT * FROM stats WHERE n_distinct = table_rows AND n_nonnull = table_rows),
src AS (SELECT * FROM stats WHERE NOT regexp_matches(upper(column_name), '{MEASURE}')),
shared AS (SELECT s.table_name AS source_table, s.column_name AS source_column,
                  g.table_name AS target_table, g.column_name AS target_column, count(*) AS shared_values
           FROM vals s JOIN (SELECT vals.* FROM vals JOIN targets USING (table_name, column_name)) g
                ON s.v = g.v AND s.family = g.family
           WHERE s.table_name <> g.table_name OR s.column_name <> g.column_name GROUP BY 1, 2, 3, 4),
cand AS (SELECT sh.*, src.n_distinct AS source_distinct, src.table_rows AS source_rows, tg.table_rows AS target_rows,
                {_similarity_sql('sh.source_column', 'sh.target_column')} AS name_similarity
         FROM shared sh JOIN src ON sh.source_table = src.table_name AND sh.source_column = src.column_name
                        JOIN targets tg ON sh.target_table = tg.table_name AND sh.target_column = tg.column_name
         WHERE CASE WHEN src.family = 'i' THEN src.imin >= tg.imin AND src.imax <= tg.imax
                    ELSE src.smin >= tg.smin AND src.smax <= tg.smax END),
edges AS (SELECT source_table, source_column, target_table, target_column, source_distinct, shared_values,
                 round(CAST(shared_values AS DOUBLE) / CAST(source_distinct AS DOUBLE), 4) AS containment,
                 name_similarity,
                 round(0.7 * (CAST(shared_values AS DOUBLE) / CAST(source_distinct AS DOUBLE)) + 0.3 * name_similarity, 4) AS confidence,
                 CASE WHEN shared_values = source_distinct AND name_similarity >= 0.5 THEN 'FK'
                      WHEN target_rows <= {P.LOOKUP_ROW_RATIO} * source_rows AND shared_values = source_distinct THEN 'LOOKUP'
                      ELSE 'SOFT_FK' END AS relationship_type,
                 name_similarity < 0.5 AS name_mismatch
          FROM cand WHERE name_similarity >= 0.5 OR source_distinct >= {P.MIN_COVERAGE} * target_rows)"""


FK_SQL = _fk_sql(DISCOVERY_TABLES)


@query("fk_containment", f"WITH {FK_SQL} SELECT * FROM edges WHERE confidence >= {P.FK_MIN_CONFIDENCE}", ("P3",))
def q_fk_containment(spark, sf):
    return P.discover_fks(_tables(spark, sf, DISCOVERY_TABLES))


# ---- keys of up to three columns, references by several columns, shared dimensions --------
KEY_TYPES = (*INTEGRALS, "string", "timestamp_ntz")


def _minimal_keys_sql(tables) -> str:
    parts = []
    for tb in tables:
        cols = [c for c, ty in SCHEMAS[tb] if ty in KEY_TYPES]
        for n in (1, 2, 3):
            for group in itertools.combinations(cols, n):
                whole = " AND ".join(f"count({c}) = count(*)" for c in group)
                parts.append(f"SELECT '{tb}' AS table_name, {list(group)} AS cols, count(DISTINCT ({', '.join(group)})) = count(*) "
                             f"AND {whole} AND count(*) > 0 AS is_key FROM {tb}")
    return f"""found AS ({' UNION ALL '.join(parts)}),
minimal AS (SELECT table_name, cols FROM found a WHERE is_key AND NOT EXISTS (
    SELECT 1 FROM found b WHERE b.is_key AND b.table_name = a.table_name AND len(b.cols) < len(a.cols) AND list_has_all(a.cols, b.cols)))"""


@query("minimal_keys", f"""WITH {_minimal_keys_sql(DISCOVERY_TABLES)}
SELECT table_name, array_to_string(cols, ',') AS key_columns, len(cols)::INT AS n_columns FROM minimal""", ("P2",))
def q_minimal_keys(spark, sf):
    return K.minimal_keys(_tables(spark, sf, DISCOVERY_TABLES))


def _shared_sql(tables) -> str:
    return f"""{_fk_sql(tables)},
plainly AS (SELECT * FROM stats WHERE n_distinct < table_rows AND NOT regexp_matches(upper(column_name), '{MEASURE}')),
meet AS (SELECT a.table_name AS table_a, a.column_name AS column_a, b.table_name AS table_b, b.column_name AS column_b, count(*) AS shared_values
         FROM vals a JOIN vals b ON a.v = b.v AND a.family = b.family AND a.table_name < b.table_name GROUP BY 1, 2, 3, 4),
both_sides AS (SELECT m.*, a.n_distinct + b.n_distinct - m.shared_values AS all_values,
                      {_similarity_sql('m.column_a', 'm.column_b')} AS name_similarity
               FROM meet m JOIN plainly a ON a.table_name = table_a AND a.column_name = column_a
                           JOIN plainly b ON b.table_name = table_b AND b.column_name = column_b)
SELECT table_a, column_a, table_b, column_b, shared_values, all_values,
       round(CAST(shared_values AS DOUBLE) / CAST(all_values AS DOUBLE), 4) AS likeness, name_similarity,
       round(0.7 * (CAST(shared_values AS DOUBLE) / CAST(all_values AS DOUBLE)) + 0.3 * name_similarity, 4) AS confidence
FROM both_sides
WHERE round(0.7 * (CAST(shared_values AS DOUBLE) / CAST(all_values AS DOUBLE)) + 0.3 * name_similarity, 4) >= {P.FK_MIN_CONFIDENCE}"""


@query("shared_dimensions", f"WITH {_shared_sql(DISCOVERY_TABLES)}", ("P3",))
def q_shared_dimensions(spark, sf):
    return IN.shared_dimensions(spark, _tables(spark, sf, DISCOVERY_TABLES), P.name_similarity, P.FK_MIN_CONFIDENCE,
                                lambda c: ~P.is_measure(F.col(c)))


# Bronze with a two-column key, a three-column key and rows that refer to them
SUPPLY_SQL = """supply AS (SELECT l_partkey AS part_no, l_suppkey AS supp_no, count(*) AS n FROM lineitem GROUP BY 1, 2),
shipments AS (SELECT l_orderkey AS order_no, l_partkey AS part_ref, l_suppkey AS supp_ref, l_linenumber AS line_no, l_returnflag AS flag
              FROM lineitem WHERE l_returnflag = 'R'),
lines AS (SELECT DISTINCT l_orderkey AS ord, l_linenumber AS line, l_returnflag AS rf, l_partkey % 7 AS lot FROM lineitem)"""
SUPPLY_SCHEMAS = {"supply": ["part_no", "supp_no", "n"], "shipments": ["order_no", "part_ref", "supp_ref", "line_no"],
                  "lines": ["ord", "line", "lot"]}
SUPPLY_KEYS = {"supply": [("part_no", "supp_no")], "lines": [("ord", "line"), ("ord", "line", "lot")]}


def supply_tables(spark, sf):
    line = t(spark, sf, "lineitem")
    supply = line.groupBy(F.col("l_partkey").alias("part_no"), F.col("l_suppkey").alias("supp_no")).agg(F.count(F.lit(1)).alias("n"))
    shipments = line.filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("order_no"), F.col("l_partkey").alias("part_ref"), F.col("l_suppkey").alias("supp_ref"),
        F.col("l_linenumber").alias("line_no"), F.col("l_returnflag").alias("flag"))
    lines = line.select(F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("rf"),
                        (F.col("l_partkey") % 7).alias("lot")).distinct()
    # each is scanned several times: they are made once
    path = scratch_path(spark, f"supply-{uuid.uuid4().hex}")
    tables = {"supply": supply, "shipments": shipments, "lines": lines}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    return {name: spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in tables.items()}


def _composite_sql() -> str:
    parts = []
    for tb, keys in SUPPLY_KEYS.items():
        for key in keys:
            inside = f"(SELECT DISTINCT {', '.join(key)} FROM {tb})"
            for src, cols in SUPPLY_SCHEMAS.items():
                for group in itertools.permutations(cols, len(key)):
                    if (src, group) != (tb, key):
                        tuples = f"(SELECT DISTINCT {', '.join(group)} FROM {src})"
                        parts.append(
                            f"SELECT '{src}' AS source_table, '{','.join(group)}' AS source_columns, '{tb}' AS target_table, "
                            f"'{','.join(key)}' AS target_columns, {len(key)}::INT AS n_columns, "
                            f"(SELECT count(*) FROM {tuples}) AS source_distinct, (SELECT count(*) FROM {inside}) AS target_distinct, "
                            f"(SELECT count(*) FROM ({tuples} EXCEPT {inside})) AS outside")
    return " UNION ALL ".join(parts)


@query("composite_references", f"WITH {SUPPLY_SQL} SELECT * EXCLUDE (outside) FROM ({_composite_sql()}) WHERE outside = 0", ("P3",))
def q_composite_references(spark, sf):
    return IN.composite_references(spark, supply_tables(spark, sf), SUPPLY_KEYS)


# two tables with long keys, and a table that refers to itself
def _long_sql() -> str:
    return """pages_url AS (SELECT page_id, url, 'https://archive.example/' || repeat('path/', 12) || page_id AS long_ref FROM pages),
hits AS (SELECT event_id, 'https://archive.example/' || repeat('path/', 12) || (event_id % (SELECT count(*) FROM pages)) AS long_ref FROM events),
staff AS (SELECT c_custkey AS employee_id, CASE WHEN c_custkey % 9 > 0 THEN c_custkey // 9 + (SELECT min(c_custkey) FROM customer) END
              AS manager_employee_id FROM customer)"""


LONG_SCHEMAS = {"pages_url": [("page_id", "bigint"), ("url", "string"), ("long_ref", "string")],
                "hits": [("event_id", "bigint"), ("long_ref", "string")],
                "staff": [("employee_id", "bigint"), ("manager_employee_id", "bigint")]}


def long_tables(spark, sf):
    pages, events, customer = (t(spark, sf, n) for n in ("pages", "events", "customer"))
    stem = F.lit("https://archive.example/" + "path/" * 12)
    n_pages = pages.agg(F.count(F.lit(1))).scalar()
    least = customer.agg(F.min("c_custkey")).scalar()
    return {"pages_url": pages.select("page_id", "url", F.concat(stem, F.col("page_id").cast("string")).alias("long_ref")),
            "hits": events.select("event_id", F.concat(stem, (F.col("event_id") % n_pages).cast("string")).alias("long_ref")),
            "staff": customer.select(F.col("c_custkey").alias("employee_id"), F.when(
                F.col("c_custkey") % 9 > 0, F.floor(F.col("c_custkey") / 9) + least).alias("manager_employee_id"))}


SCHEMAS.update(LONG_SCHEMAS)


@query("fk_long_and_self", f"WITH {_long_sql()}, {_fk_sql(LONG_SCHEMAS)} SELECT * FROM edges WHERE confidence >= {P.FK_MIN_CONFIDENCE}", ("P3",))
def q_fk_long_and_self(spark, sf):
    """References over texts of more than 64 characters, and within one table."""
    return P.discover_fks(long_tables(spark, sf))


# ---- profiles that merge, changes found by digests ---------------------------------------
PARTED = "lineitem"


def _merged_profile_sql() -> str:
    parts = []
    for pos, (c, ty) in enumerate(SCHEMAS[PARTED], start=1):
        text, num = ty == "string", ty in NUMERIC
        parts.append(
            f"SELECT '{c}' AS column_name, {pos} AS position, count(*) AS n_rows, count_if({c} IS NULL) AS n_nulls, "
            f"{f'count_if({c} = {chr(39)}{chr(39)})' if text else 'CAST(NULL AS BIGINT)'} AS n_empty, "
            f"{f'round(avg(length({c})), 4)' if text else 'CAST(NULL AS DOUBLE)'} AS avg_len, "
            f"{f'CAST(min({c}) AS DOUBLE)' if num else 'CAST(NULL AS DOUBLE)'} AS min_value, "
            f"{f'CAST(max({c}) AS DOUBLE)' if num else 'CAST(NULL AS DOUBLE)'} AS max_value, true AS distinct_in_bound, "
            f"{'true' if num else 'CAST(NULL AS BOOLEAN)'} AS median_in_bound FROM {PARTED}")
    return "\nUNION ALL ".join(parts)


@query("profile_merged", _merged_profile_sql(), ("P1",))
def q_profile_merged(spark, sf):
    """The profile of a table from those of its line statuses and months; estimates are held against
    exact counts and ranks."""
    df = t(spark, sf, PARTED)
    months = PS.profile_parts(df.filter(F.col("l_linestatus") == "O"), F.date_trunc("year", "l_shipdate"))
    rest = PS.profile_parts(df.filter(~F.coalesce(F.col("l_linestatus") == "O", F.lit(False))), F.col("l_linestatus"))
    # one row per column, read twice
    found = cut_lineage(PS.estimates(PS.merged(PS.merged(months, "open").unionByName(rest))))
    exact = P.profile(df, PARTED, exact=True).select("column_name", F.col("n_distinct").alias("exact"))
    numeric = [c for c, ty in SCHEMAS[PARTED] if ty in NUMERIC]
    middles = {r["column_name"]: r["q50"] for r in found.filter(F.col("q50").isNotNull()).select("column_name", "q50").collect()}
    ranks = df.agg(*[(F.count_if(F.col(c) < middles[c]) / F.count(c)).alias(f"b_{c}") for c in numeric],
                   *[(F.count_if(F.col(c) <= middles[c]) / F.count(c)).alias(f"u_{c}") for c in numeric])
    ranks = ranks.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), ((F.col(f"b_{c}") <= 0.517) & (F.col(f"u_{c}") >= 0.483)).alias(
        "median_in_bound")) for c in numeric])))
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= 0.098 * F.col("exact") + 1
    return (found.join(exact, "column_name").join(ranks, "column_name", "left")
            .select("column_name", "position", "n_rows", "n_nulls", "n_empty", "avg_len", "min_value", "max_value", near.alias("distinct_in_bound"),
                    "median_in_bound"))


@query("changed_keys", """
WITH later AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 997 = 5 THEN 1 ELSE 0 END AS o_totalprice,
                      o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 1009 <> 7
               UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
                         WHERE o_orderkey % 2003 = 11)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
       CASE WHEN a.o_orderkey IS NULL THEN 'ADDED' WHEN b.o_orderkey IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS status
FROM orders a FULL JOIN later b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice""", ("P6", "V8"))
def q_changed_keys(spark, sf):
    """Orders against a later version with changed, lost and new rows."""
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey")
    later = o.filter(k % 1009 != 7).withColumn("o_totalprice", F.col("o_totalprice") + F.when(k % 997 == 5, 1).otherwise(0))
    later = later.unionByName(o.filter(k % 2003 == 11).withColumn("o_orderkey", -k))
    return DT.changed_keys(o, later, "o_orderkey", 256)


# ---- string-typed Bronze for type inference -------------------------------------
def events_as_text(spark, sf):
    e = t(spark, sf, "events")
    return e.select(F.col("event_id").cast("string").alias("event_id"),
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
                    F.col("user_id").cast("string").alias("user_id"), "event_type",
                    F.col("value").cast("decimal(18,2)").cast("string").alias("value"),
                    F.when(F.col("event_type") == "error", "yes").otherwise("no").alias("is_error"), "props")


EVENTS_TEXT_SQL = """et AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
         CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value,
         CASE WHEN event_type = 'error' THEN 'yes' ELSE 'no' END AS is_error, props
  FROM events)"""
BOOLS = ", ".join(f"'{b}'" for b in (*TRUE_STRINGS, *FALSE_STRINGS))


def _like_sql(v: str) -> tuple[str, str, str]:
    return (f"regexp_matches(trim({v}), '{ISO_TS_PATTERN}')", f"lower(trim({v})) IN ({BOOLS})",
            f"regexp_matches(trim({v}), '{NUMBER_PATTERN}')")


def _infer_sql(cols) -> str:
    parts = []
    for c in cols:
        ts, bo, nu = _like_sql(c)
        present = f"{c} IS NOT NULL AND trim({c}) <> ''"
        parts.append(f"""SELECT '{c}' AS column_name, count_if({present}) AS n_present,
       CASE WHEN count_if({present}) > 0 THEN round(CAST(count_if({present} AND {ts}) AS DOUBLE) / CAST(count_if({present}) AS DOUBLE), 4) END AS ts_share,
       CASE WHEN count_if({present}) > 0 THEN round(CAST(count_if({present} AND {bo}) AS DOUBLE) / CAST(count_if({present}) AS DOUBLE), 4) END AS bool_share,
       CASE WHEN count_if({present}) > 0 THEN round(CAST(count_if({present} AND {nu}) AS DOUBLE) / CAST(count_if({present}) AS DOUBLE), 4) END AS num_share
FROM et""")
    body = "\nUNION ALL ".join(parts)
    return f"""WITH {EVENTS_TEXT_SQL}, s AS ({body})
SELECT *, CASE WHEN ts_share >= 1.0 THEN 'timestamp' WHEN bool_share >= 1.0 THEN 'boolean'
               WHEN num_share >= 1.0 THEN 'double' ELSE 'string' END AS inferred_type FROM s"""


TEXT_COLS = ("event_id", "ts", "user_id", "event_type", "value", "is_error", "props")


@query("infer_types", _infer_sql(TEXT_COLS), ("P4",))
def q_infer_types(spark, sf):
    return P.infer_types(events_as_text(spark, sf))


@query("type_cast", f"""
WITH {EVENTS_TEXT_SQL}
SELECT TRY_CAST(event_id AS DOUBLE) AS event_id, TRY_CAST(ts AS TIMESTAMP) AS ts, TRY_CAST(user_id AS DOUBLE) AS user_id,
       event_type, TRY_CAST(value AS DOUBLE) AS value,
       CASE WHEN lower(trim(is_error)) IN ('true', 't', 'yes', 'y', '1') THEN true
            WHEN lower(trim(is_error)) IN ('false', 'f', 'no', 'n', '0') THEN false END AS is_error,
       props
FROM et""", ("C1", "C2", "C3"))
def q_type_cast(spark, sf):
    et = events_as_text(spark, sf)
    return P.apply_types(et, P.infer_types(et))


def _canon_sql(c: str, ty: str) -> str:
    if ty == "timestamp_ntz":
        return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
    if ty == "string":
        return c
    return f"CAST({c} AS VARCHAR)"


def _fingerprint_sql(tables) -> str:
    parts = []
    for tb in tables:
        schema_text = ",".join(f"{c}:{ty}" for c, ty in SCHEMAS[tb])
        texts = [_canon_sql(c, ty) for c, ty in SCHEMAS[tb]]
        row = " || ".join(f"coalesce(length({x}) || ':' || {x}, '-')" for x in texts)
        parts.append(f"SELECT '{tb}' AS table_name, md5('{schema_text}') AS schema_fingerprint, "
                     f"CAST(sum(CAST(('0x' || substr(md5({row}), 1, 12)) AS BIGINT)) AS VARCHAR) AS content_checksum, "
                     f"count(*) AS n_rows FROM {tb}")
    return "\nUNION ALL ".join(parts)


FP_TABLES = ("orders", "customer", "part", "events")


@query("fingerprint", _fingerprint_sql(FP_TABLES), ("P6",))
def q_fingerprint(spark, sf):
    out = None
    for tb in FP_TABLES:
        f = P.fingerprint(t(spark, sf, tb), tb)
        out = f if out is None else out.unionByName(f)
    return out


PATTERN_KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
                "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
                "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"],
                "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"],
                "conversations": ["conv_id", "turn"]}


PATTERN_SOURCES = {"events_cdc": "(SELECT *, CASE WHEN event_type = 'signup' THEN 'INSERT' "
                                 "WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPDATE' END AS _OPERATION FROM events)"}
SCHEMAS["events_cdc"] = SCHEMAS["events"] + [("_OPERATION", "string")]


def _patterns_sql(tables) -> str:
    parts = []
    for tb in tables:
        cols = [c for c, _ in SCHEMAS[tb]]
        strs = [c for c, ty in SCHEMAS[tb] if ty == "string"]
        nested = " OR ".join(f"count_if(regexp_matches({c}, '^\\s*[{{\\[]')) > 0" for c in strs) or "false"
        cast_terms = []
        for c in strs:
            ts, bo, nu = _like_sql(c)
            present = f"{c} IS NOT NULL AND trim({c}) <> ''"
            cast_terms.append(f"(count_if({present}) > 0 AND count_if({present} AND NOT ({ts} OR {bo} OR {nu})) = 0)")
        castable = " OR ".join(cast_terms) or "false"
        anynull = " OR ".join(f"{c} IS NULL" for c in cols)
        keys = PATTERN_KEYS[tb]
        kexpr = keys[0] if len(keys) == 1 else "(" + ", ".join(keys) + ")"
        cdc = "true" if any(c.upper() in P.CDC_COLUMNS for c in cols) else "false"
        parts.append(f"""SELECT '{tb}' AS table_name, {nested} AS has_nested, count_if({anynull}) > 0 AS has_nulls,
       {castable} AS needs_casting, count(DISTINCT {kexpr}) < count(*) AS has_duplicates, {cdc} AS has_cdc
FROM {PATTERN_SOURCES.get(tb, tb)}""")
    return "\nUNION ALL ".join(parts)


PATTERNS_SQL = _patterns_sql(DISCOVERY_TABLES)


def _patterns(spark, sf):
    out = None
    for tb in DISCOVERY_TABLES:
        p = P.detect_patterns(t(spark, sf, tb), tb, PATTERN_KEYS[tb])
        out = p if out is None else out.unionByName(p)
    return out


@query("patterns", PATTERNS_SQL, ("P7",))
def q_patterns(spark, sf):
    return _patterns(spark, sf)


PATTERN_KEYS["events_cdc"] = ["event_id"]


@query("cdc_patterns", _patterns_sql(["events_cdc"]), ("P7",))
def q_cdc_patterns(spark, sf):
    return P.detect_patterns(cdc_events(spark, sf), "events_cdc", ["event_id"])


@query("inbound_fk", f"""
WITH {FK_SQL}, pat AS ({PATTERNS_SQL}),
inb AS (SELECT target_table AS table_name, count(*) AS inbound_fk FROM edges
        WHERE confidence >= {P.FK_MIN_CONFIDENCE} GROUP BY 1)
SELECT pat.table_name, coalesce(inb.inbound_fk, 0) AS inbound_fk,
       CASE WHEN has_nested THEN 'flatten_and_type' WHEN coalesce(inb.inbound_fk, 0) >= 3 THEN 'scd_type2'
            ELSE 'deduplicate' END AS strategy
FROM pat LEFT JOIN inb ON pat.table_name = inb.table_name""", ("P5",))
def q_inbound_fk(spark, sf):
    edges = P.discover_fks(_tables(spark, sf, DISCOVERY_TABLES))
    return P.choose_strategy(_patterns(spark, sf), edges)
