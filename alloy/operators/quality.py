"""Validation and data-quality checks between layers.

Each check is one or two aggregations regardless of how many tables, rules or
columns it covers (the reference issued N+1 count queries).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alloy.functions.columns import canonical_text
from alloy.operators.filters import exclusion_flag
from alloy.operators.joins import resolve_merge_targets
from alloy.session import broadcast_if_small

TOLERANCE = 0.01  # fixed: 1 % row-count tolerance


def variance(actual: Column, expected: Column) -> Column:
    """0/0 -> 0, expected 0 -> 1, else |actual - expected| / expected."""
    return (F.when((expected == 0) & (actual == 0), F.lit(0.0))
            .when(expected == 0, F.lit(1.0))
            .otherwise(F.abs(actual - expected).cast("double") / expected.cast("double")))


def parity_status(var: Column, tol: float = TOLERANCE) -> Column:
    return F.when(var <= tol, F.lit("PASS")).otherwise(F.lit("FAIL"))


def layer_count(df: DataFrame, name: str, layer: str) -> DataFrame:
    """Row count of a layer table; SCD2-aware (only IS_CURRENT rows) when that column exists."""
    agg = F.count_if(F.col("IS_CURRENT")) if "IS_CURRENT" in df.columns else F.count(F.lit(1))
    return df.agg(agg.alias("rows")).select(F.lit(name).alias("table_name"), F.lit(layer).alias("layer"), "rows")


def live_key_count(df: DataFrame, name: str, keys: Sequence[str], deleted: Column | None = None) -> DataFrame:
    """Dedup-adjusted expectation: distinct keys of the live Bronze rows."""
    d = df.filter(~F.coalesce(deleted, F.lit(False))) if deleted is not None else df
    return (d.select(*keys).distinct().agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(name).alias("table_name"), F.lit("EXPECTED").alias("layer"), "rows"))


def row_parity(expected: DataFrame, actual: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """Pairs of one-row counts (``table_name, rows``) -> variance and PASS/FAIL per table."""
    e = expected.select("table_name", F.col("rows").alias("expected_rows"))
    a = actual.select("table_name", F.col("rows").alias("actual_rows"))
    j = e.join(a, "table_name", "full_outer").fillna(0, ["expected_rows", "actual_rows"])
    v = variance(F.col("actual_rows"), F.col("expected_rows"))
    return j.withColumn("variance_pct", F.round(v * 100.0, 2)).withColumn("status", parity_status(v, tol))


def null_expectations(df: DataFrame, pk: Sequence[str] | None = None) -> DataFrame:
    """NULL count of every column in one pass; PK columns (given, else NOT NULL ``*_ID``/
    ``*KEY`` columns) are expected to have 0."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    stacked = counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(i + 1).alias("position"), F.col(c).alias("null_count"))
        for i, c in enumerate(df.columns)])).alias("x")).select("x.*")
    if pk is None:
        pk = [c for c in df.columns if c.upper().endswith(("_ID", "KEY"))]
    is_pk = F.col("column_name").isin(*pk) if pk else F.lit(False)
    return stacked.withColumn("is_pk", is_pk).withColumn(
        "status", F.when(~F.col("is_pk"), F.lit("INFO"))
        .when(F.col("null_count") == 0, F.lit("PASS")).otherwise(F.lit("FAIL")))


def duplicate_groups(df: DataFrame, keys: Sequence[str], other: Sequence[str] = ()) -> DataFrame:
    """Keys holding more than one row, with row count and distinct values of ``other``."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if other:
        aggs.append(F.count_distinct(*[F.col(c) for c in other]).alias("n_variants"))
    return df.groupBy(*keys).agg(*aggs).filter(F.col("n_rows") > 1)


def pk_unique(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    return df.groupBy(*pk).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.count(F.lit(1)).alias("distinct_keys"), F.sum("_n").alias("n_rows"),
        F.count_if(F.col("_n") > 1).alias("duplicate_keys"))


def checksum(c: Column) -> Column:
    """Order-independent column checksum: sum of a 48-bit MD5 prefix as DECIMAL(38,0)."""
    return F.sum(F.conv(F.substring(F.md5(c), 1, 12), 16, 10).cast("decimal(38,0)"))


def preservation(bronze: DataFrame, silver: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Value-level preservation on surviving keys: every Bronze column present in Silver
    under its own name, with equal non-NULL count and equal checksum."""
    surviving = silver.select(*keys).distinct()
    b = bronze.join(surviving, list(keys), "left_semi")
    types_b = {f.name: f.dataType for f in bronze.schema.fields}
    types_s = {f.name: f.dataType for f in silver.schema.fields}

    def stats(df: DataFrame, types: dict[str, T.DataType], side: str) -> DataFrame:
        cols = [c for c in bronze.columns if c in types]
        agg = df.agg(*[x for c in cols for x in (
            F.count(F.col(c)).alias(f"n__{c}"),
            checksum(canonical_text(F.col(c), types[c])).alias(f"h__{c}"))])
        return agg.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"n__{c}").alias(f"{side}_nonnull"),
                     F.col(f"h__{c}").cast("string").alias(f"{side}_checksum")) for c in cols])).alias("x")).select("x.*")

    bs = stats(b, types_b, "bronze")
    ss = stats(silver, types_s, "silver")
    j = bs.join(ss, "column_name", "left")
    ok = (F.col("silver_nonnull").isNotNull() & (F.col("bronze_nonnull") == F.col("silver_nonnull"))
          & (F.col("bronze_checksum") == F.col("silver_checksum")))
    return (j.withColumn("present", F.col("silver_nonnull").isNotNull())
            .withColumn("status", F.when(ok, F.lit("PASS")).otherwise(F.lit("FAIL"))))


def completeness(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in cols:
        aggs.append(F.count_if(F.col(c).isNotNull()).alias(f"nonnull_{c}"))
    out = df.groupBy(*by).agg(*aggs)
    for c in cols:
        out = out.withColumn(f"pct_{c}", F.round(F.col(f"nonnull_{c}").cast("double") * 100.0
                                                 / F.col("n_rows").cast("double"), 2))
    return out


def format_threshold(df: DataFrame, flag: Column, threshold_pct: float) -> DataFrame:
    """Share of rows failing a format rule vs the rule's threshold."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~flag).alias("n_bad")) \
        .withColumn("bad_pct", F.round(F.col("n_bad").cast("double") * 100.0 / F.col("n_rows").cast("double"), 2)) \
        .withColumn("status", F.when(F.col("bad_pct") <= threshold_pct, F.lit("PASS")).otherwise(F.lit("FAIL")))


def reconcile_routes(silver: DataFrame, gold: DataFrame, rules: DataFrame, value_col: str,
                     category_col: str, table_col: str = "gold_table") -> DataFrame:
    """Routing reconciliation per rule with one conditional aggregation over Silver and
    one over Gold, joined to the (small) rule table.

    expected = silver - excluded + sum over rules merged into it (their silver - their own
    excluded); variance as in row parity; NULL target -> SKIPPED (no target), merged
    rule -> SKIPPED (merged).
    """
    r = resolve_merge_targets(rules)
    ex = r.select(F.upper("value").alias("_v"), F.col("exclusions").alias("_ex"))
    s = (silver.select(F.upper(F.col(value_col)).alias("_v"), F.col(category_col).alias("_c"))
         .join(broadcast_if_small(ex), "_v", "inner")
         .groupBy("_v").agg(F.count(F.lit(1)).alias("silver_rows"),
                            F.count_if(exclusion_flag(F.col("_c"), F.col("_ex"))).alias("excluded_rows")))
    g = gold.groupBy(F.col(table_col).alias("_gt")).agg(F.count(F.lit(1)).alias("gold_rows"))
    rr = r.withColumn("_v", F.upper("value")).join(s, "_v", "left").fillna(0, ["silver_rows", "excluded_rows"])
    net = rr.withColumn("_net", F.col("silver_rows") - F.col("excluded_rows"))
    merged_in = (net.filter(F.col("merge_into").isNotNull())
                 .groupBy(F.upper("merge_into").alias("_v"))
                 .agg(F.sum("_net").alias("merged_rows")))
    out = (net.join(merged_in, "_v", "left").fillna(0, ["merged_rows"])
           .join(g, F.col("target_table") == F.col("_gt"), "left").fillna(0, ["gold_rows"]))
    expected = F.col("_net") + F.col("merged_rows")
    v = variance(F.col("gold_rows"), expected)
    status = (F.when(F.col("target_table").isNull(), F.lit("SKIPPED_NO_TARGET"))
              .when(F.col("merge_into").isNotNull(), F.lit("SKIPPED_MERGED"))
              .when(v <= TOLERANCE, F.lit("PASS")).otherwise(F.lit("FAIL")))
    active = F.col("target_table").isNotNull() & F.col("merge_into").isNull()
    return out.select(
        "value", "target_table", "merge_into", "silver_rows", "excluded_rows", "merged_rows",
        F.when(active, expected).alias("expected_rows"),
        F.when(active, F.col("gold_rows")).alias("gold_rows"),
        F.when(active, F.round(v * 100.0, 2)).alias("variance_pct"),
        status.alias("status"))
