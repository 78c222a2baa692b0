"""Profiling and relationship discovery as Spark jobs.

* ``profile``: one aggregation pass over all columns (approximate distinct by
  default, exact on request), stacked to one row per column.
* ``discover_fks``: single-column inclusion dependencies, chosen by the columns' statistics and
  sketches (``inclusion``) and scored by containment and name.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alloy.functions.columns import (canonical_row, looks_like_boolean, looks_like_number,
                                     looks_like_timestamp)
from alloy.operators.inclusion import DISTINCT_ERROR, references
from alloy.operators.keys import repeated

# ---- fixed values ---------------------------------------------------------------
# Name fragments of measure / free-text columns that are never FK sources.
MEASURE_PARTS = ("PRICE", "QTY", "QUANTITY", "AMOUNT", "TOTAL", "BAL", "DISCOUNT", "TAX", "SIZE",
                 "TITLE", "NAME", "COMMENT", "VALUE")
# CDC / soft-delete column names.
CDC_COLUMNS = ("_OPERATION", "OPERATION", "OP", "IS_DELETED", "_DELETED", "DELETED_AT", "_CHANGE_TYPE")
FK_MIN_CONFIDENCE = 0.70
# A lookup table has at most this many rows per row of the table that refers to it; a
# reference whose name does not tell covers at least this share of the target's values.
LOOKUP_ROW_RATIO = 0.1
MIN_COVERAGE = 0.05
# ---------------------------------------------------------------------------------


def simple_type(dt: T.DataType) -> str:
    return dt.simpleString()


def profile(df: DataFrame, table_name: str, exact: bool = False) -> DataFrame:
    """One row per column: position, type, rows, nulls, distinct, empty strings, average
    length (strings), numeric min / max.

    Approximate mode is one aggregation pass (HyperLogLog distinct). Exact mode keeps that
    pass for the other statistics and counts distinct values with one single-distinct
    aggregate per column (each reads one column and deduplicates map-side) instead of
    Spark's multi-distinct Expand, which replicates every row once per column.
    """
    aggs: list[Column] = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f.name)
        aggs.append(F.count_if(c.isNull()).alias(f"n{i}"))
        if not exact:
            aggs.append(F.approx_count_distinct(c).alias(f"d{i}"))
        is_str = isinstance(f.dataType, T.StringType)
        aggs.append((F.count_if(c == "") if is_str else F.lit(None).cast("long")).alias(f"e{i}"))
        aggs.append((F.round(F.avg(F.length(c)), 4) if is_str else F.lit(None).cast("double")).alias(f"l{i}"))
        num = isinstance(f.dataType, T.NumericType)
        aggs.append((F.min(c).cast("double") if num else F.lit(None).cast("double")).alias(f"mn{i}"))
        aggs.append((F.max(c).cast("double") if num else F.lit(None).cast("double")).alias(f"mx{i}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(table_name).alias("table_name"), F.lit(f.name).alias("column_name"),
                     F.lit(i + 1).alias("position"), F.lit(simple_type(f.dataType)).alias("data_type"),
                     F.col("__rows").alias("n_rows"), F.col(f"n{i}").alias("n_nulls"),
                     (F.lit(None).cast("long") if exact else F.col(f"d{i}")).alias("n_distinct"),
                     F.col(f"e{i}").alias("n_empty"),
                     F.col(f"l{i}").alias("avg_len"), F.col(f"mn{i}").alias("min_value"),
                     F.col(f"mx{i}").alias("max_value"))
            for i, f in enumerate(df.schema.fields)]
    stacked = one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    if not exact:
        return stacked
    distinct = None
    for i, f in enumerate(df.schema.fields):
        part = df.agg(F.count_distinct(F.col(f.name)).alias("_d")).select(F.lit(i + 1).alias("_pos"), "_d")
        distinct = part if distinct is None else distinct.unionByName(part)
    cols = [c if c != "n_distinct" else "_d" for c in stacked.columns]
    return (stacked.join(F.broadcast(distinct), stacked.position == distinct._pos)
            .select(*[F.col(c).alias("n_distinct") if c == "_d" else F.col(c) for c in cols]))


def profile_tables(tables: dict[str, DataFrame], exact: bool = False) -> DataFrame:
    out = None
    for name, df in tables.items():
        p = profile(df, name, exact)
        out = p if out is None else out.unionByName(p)
    return out


def _lcp(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    idx = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(
        idx, F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (F.substring(a, i, 1) == F.substring(b, i, 1)), i).otherwise(acc)))


def base_name(col: Column) -> Column:
    """Lower-case column name without a short table prefix (``o_``) and key suffixes."""
    s = F.regexp_replace(F.lower(col), r"^[a-z]{1,2}_", "")
    return F.regexp_replace(s, r"(_id|_key|_code|_ref|_num|key|id)$", "")


def singular(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), r"s$", "")


def _ranked(prof: DataFrame) -> DataFrame:
    """``table_name, column_name, _ratio, _lcp, rn``: key candidates in order.

    Lexicographic score: not a date/timestamp when the table has an id/key column;
    id/key name; longest common prefix with the singular table name; distinct/rows
    ratio; earlier position."""
    name = F.lower(F.col("column_name"))
    is_key = name.rlike(r"(_id|_key|key|id)$")
    is_time = F.col("data_type").isin("timestamp", "timestamp_ntz", "date")
    stripped = F.regexp_replace(name, r"^[a-z]{1,2}_", "")
    p = (prof.withColumn("_is_key", is_key)
         .withColumn("_lcp", _lcp(stripped, singular(F.col("table_name"))))
         .withColumn("_ratio", F.when(F.col("n_rows") > 0,
                                      F.col("n_distinct").cast("double") / F.col("n_rows").cast("double"))
                     .otherwise(F.lit(0.0))))
    has_key = p.groupBy("table_name").agg(F.max(F.col("_is_key").cast("int")).alias("_has_key"))
    p = p.join(F.broadcast(has_key), "table_name")
    penalty = ((F.col("_has_key") == 1) & is_time).cast("int")
    w = Window.partitionBy("table_name").orderBy(penalty, (-F.col("_is_key").cast("int")), -F.col("_lcp"), -F.col("_ratio"),
                                                 F.col("position"))
    return p.withColumn("rn", F.row_number().over(w)).select("table_name", "column_name", "_ratio", "_lcp", "rn")


def pk_candidates(prof: DataFrame, tables: dict[str, DataFrame] | None = None, top: int = 5) -> DataFrame:
    """The best primary-key candidate per table. Where no best column is unique, the first
    pair of the ``top`` candidates that is unique in ``tables`` takes its place
    (``pk_column`` = ``a,b``); if there is none, ``is_unique`` stays false."""
    ranked = _ranked(prof).filter(F.col("rn") <= top).select(
        "table_name", F.col("column_name").alias("pk_column"), F.round("_ratio", 6).alias("uniqueness"),
        F.col("_lcp").alias("name_match"), (F.col("_ratio") == 1.0).alias("is_unique"), "rn")
    if not tables:
        return ranked.filter(F.col("rn") == 1).drop("rn")
    # ``top`` short rows per table come to the driver, so the profile is made once
    columns: dict[str, list] = {}
    for r in ranked.orderBy("table_name", "rn").collect():
        columns.setdefault(r["table_name"], []).append(r)
    best = prof.sparkSession.createDataFrame([tuple(cand[0])[:-1] for cand in columns.values()], ranked.drop("rn").schema)
    pairs = [(table, pair) for table, cand in columns.items() if not cand[0]["is_unique"] and table in tables
             for pair in itertools.combinations([c["pk_column"] for c in cand], 2)]
    again = repeated(tables, pairs)
    unique: dict[str, str] = {}
    for table, (a, b) in pairs:
        if (table, (a, b)) not in again:
            unique.setdefault(table, f"{a},{b}")
    if not unique:
        return best
    first = prof.sparkSession.createDataFrame(sorted(unique.items()), "pair_table string, pair string")
    out = best.join(F.broadcast(first), F.col("table_name") == F.col("pair_table"), "left")
    found = F.col("pair").isNotNull()
    return out.select("table_name", F.coalesce("pair", "pk_column").alias("pk_column"),
                      F.when(found, F.lit(1.0)).otherwise(F.col("uniqueness")).alias("uniqueness"), "name_match",
                      (F.col("is_unique") | found).alias("is_unique"))


EDGES = ("source_table string, source_column string, target_table string, target_column string, source_distinct long, "
         "shared_values long, containment double, name_similarity double, confidence double, relationship_type string, "
         "name_mismatch boolean")


def is_measure(name: Column) -> Column:
    """A name that tells a measure or free text."""
    found = F.lit(False)
    for part in MEASURE_PARTS:
        found = found | F.upper(name).contains(part)
    return found


def name_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length of two base names, 4 digits."""
    a, b = base_name(a), base_name(b)
    return F.round(F.lit(1.0) - F.levenshtein(a, b).cast("double") / F.greatest(F.length(a), F.length(b), F.lit(1)).cast("double"), 4)


def discover_fks(tables: dict[str, DataFrame], min_conf: float = FK_MIN_CONFIDENCE) -> DataFrame:
    """FK edges ``(source_table, source_column, target_table, target_column, containment,
    name_similarity, confidence, relationship_type)`` with confidence >= ``min_conf``.

    Sketches rule out the pairs that cannot reach the confidence; the values of the columns
    left are counted exactly (``alloy.operators.inclusion``). Any integral or text column may
    take part, however long its texts, also two of one table. One row per edge reaches the
    driver and becomes the result."""
    similarity = name_similarity(F.col("a_columns"), F.col("b_columns"))
    found = references(
        tables, lambda c: ~is_measure(F.col(c)),
        # 1e-4 for the rounding of the confidence
        lambda: (F.lit(min_conf - 1e-4) - 0.3 * similarity) / 0.7,
        lambda: (similarity >= 0.5) | (F.col("a_estimate") * (1 + DISTINCT_ERROR) >= MIN_COVERAGE * F.col("b_table_rows")))
    spark = next(iter(tables.values())).sparkSession
    e = spark.createDataFrame(
        [(r.source.table, r.source.columns[0], r.target.table, r.target.columns[0], r.source_distinct, r.shared_values, r.source_rows,
          r.target_rows) for r in found],
        "source_table string, source_column string, target_table string, target_column string, source_distinct long, shared_values long, "
        "source_rows long, target_rows long")
    e = e.withColumn("name_similarity", name_similarity(F.col("source_column"), F.col("target_column")))
    e = e.filter((F.col("name_similarity") >= 0.5) | (F.col("source_distinct") >= MIN_COVERAGE * F.col("target_rows")))
    containment = F.col("shared_values").cast("double") / F.col("source_distinct").cast("double")
    e = e.withColumn("containment", F.round(containment, 4))
    e = e.withColumn("confidence", F.round(F.lit(0.7) * containment + F.lit(0.3) * F.col("name_similarity"), 4))
    rtype = (F.when((F.col("shared_values") == F.col("source_distinct")) & (F.col("name_similarity") >= 0.5), F.lit("FK"))
             .when((F.col("target_rows") <= LOOKUP_ROW_RATIO * F.col("source_rows"))
                   & (F.col("shared_values") == F.col("source_distinct")), F.lit("LOOKUP"))
             .otherwise(F.lit("SOFT_FK")))
    return (e.filter(F.col("confidence") >= min_conf).withColumn("relationship_type", rtype)
            .withColumn("name_mismatch", F.col("name_similarity") < 0.5).select(*[c.split()[0] for c in EDGES.split(", ")]))


def infer_types(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Share of non-empty values of each string column that parse as timestamp / boolean /
    number (one pass), and the inferred type (ambiguous columns stay string)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column_name string, n_present long, ts_share double, bool_share double, num_share double, inferred_type string")
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c)
        present = v.isNotNull() & (F.trim(v) != "")
        aggs += [F.count_if(present).alias(f"p{i}"),
                 F.count_if(present & looks_like_timestamp(v)).alias(f"t{i}"),
                 F.count_if(present & looks_like_boolean(v)).alias(f"b{i}"),
                 F.count_if(present & looks_like_number(v)).alias(f"n{i}")]
    one = df.agg(*aggs)

    def share(k: str, i: int) -> Column:
        return F.when(F.col(f"p{i}") > 0, F.round(F.col(f"{k}{i}").cast("double") / F.col(f"p{i}").cast("double"), 4))

    rows = []
    for i, c in enumerate(cols):
        ts, bo, nu = share("t", i), share("b", i), share("n", i)
        inferred = (F.when(ts >= threshold, F.lit("timestamp")).when(bo >= threshold, F.lit("boolean"))
                    .when(nu >= threshold, F.lit("double")).otherwise(F.lit("string")))
        rows.append(F.struct(F.lit(c).alias("column_name"), F.col(f"p{i}").alias("n_present"),
                             ts.alias("ts_share"), bo.alias("bool_share"), nu.alias("num_share"),
                             inferred.alias("inferred_type")))
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def apply_types(df: DataFrame, inferred: DataFrame) -> DataFrame:
    """Cast columns to their inferred types in one projection. Only the per-column decision
    (one short row per column) is brought to the driver."""
    from alloy.functions.columns import to_boolean, to_number, to_timestamp_ntz

    decision = {r["column_name"]: r["inferred_type"] for r in inferred.collect()}
    out = []
    for c in df.columns:
        kind = decision.get(c, "string")
        col = F.col(c)
        if kind == "timestamp":
            col = to_timestamp_ntz(col)
        elif kind == "boolean":
            col = to_boolean(col)
        elif kind == "double":
            col = to_number(col)
        out.append(col.alias(c))
    return df.select(out)


def fingerprint(df: DataFrame, table_name: str) -> DataFrame:
    """Schema MD5 (ordered name:type list), order-independent content checksum and row
    count — kept apart so a new row does not change the schema fingerprint."""
    schema_text = ",".join(f"{f.name}:{simple_type(f.dataType)}" for f in df.schema.fields)
    row_hash = F.conv(F.substring(F.md5(canonical_row(df, df.columns)), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row_hash).cast("string").alias("content_checksum")) \
        .select(F.lit(table_name).alias("table_name"), F.md5(F.lit(schema_text)).alias("schema_fingerprint"),
                "content_checksum", "n_rows")


def detect_patterns(df: DataFrame, table_name: str, pk: Sequence[str]) -> DataFrame:
    """Per-table flags: nested JSON text, NULLs, castable strings, duplicate keys, CDC columns."""
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    nested = F.lit(False)
    castable = F.lit(False)
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct(*[F.col(k) for k in pk]).alias("n_keys")]
    for i, c in enumerate(strs):
        v = F.col(c)
        aggs.append(F.count_if(v.rlike(r"^\s*[\{\[]")).alias(f"j{i}"))
        aggs.append(F.count_if(v.isNotNull() & (F.trim(v) != "") & ~(
            looks_like_timestamp(v) | looks_like_boolean(v) | looks_like_number(v))).alias(f"x{i}"))
        aggs.append(F.count_if(v.isNotNull() & (F.trim(v) != "")).alias(f"q{i}"))
    aggs.append(F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in df.columns]) == 1).alias("n_null_rows")
                if len(df.columns) > 1 else F.count_if(F.col(df.columns[0]).isNull()).alias("n_null_rows"))
    one = df.agg(*aggs)
    for i, _c in enumerate(strs):
        nested = nested | (F.col(f"j{i}") > 0)
        castable = castable | ((F.col(f"q{i}") > 0) & (F.col(f"x{i}") == 0))
    cdc = any(c.upper() in CDC_COLUMNS for c in df.columns)
    return one.select(F.lit(table_name).alias("table_name"), nested.alias("has_nested"),
                      (F.col("n_null_rows") > 0).alias("has_nulls"), castable.alias("needs_casting"),
                      (F.col("n_keys") < F.col("n_rows")).alias("has_duplicates"), F.lit(cdc).alias("has_cdc"))


def choose_strategy(patterns: DataFrame, edges: DataFrame, master_min_inbound: int = 3) -> DataFrame:
    """nested -> flatten_and_type; inbound FK >= 3 (a master) -> scd_type2; else deduplicate."""
    inbound = edges.groupBy(F.col("target_table").alias("table_name")).agg(F.count(F.lit(1)).alias("inbound_fk"))
    j = patterns.join(inbound, "table_name", "left").fillna(0, ["inbound_fk"])
    strategy = (F.when(F.col("has_nested"), F.lit("flatten_and_type"))
                .when(F.col("inbound_fk") >= master_min_inbound, F.lit("scd_type2"))
                .otherwise(F.lit("deduplicate")))
    return j.select("table_name", "inbound_fk", strategy.alias("strategy"))
