"""Aggregations: coverage, conditional counts, distributions, bands, distinct keys,
ordered text / object lists per group, percent of total, pre-aggregation, funnels.

All of them are ``groupBy().agg`` with built-in aggregate functions, which Spark
runs as partial (map-side) + final hash aggregation around one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alloy.functions.columns import MONEY_TYPE


def safe_pct(part: Column, whole: Column, scale: int = 1) -> Column:
    """``round(100 * part / nullif(whole, 0), scale)`` — NULL for an empty whole."""
    return F.round(part.cast("double") * 100.0 / F.nullif(whole, F.lit(0)).cast("double"), scale)


def coverage(df: DataFrame, by: Sequence[str], covered: dict[str, str], total: str = "total", scale: int = 1) -> DataFrame:
    """Rows per group, and per ``{name: column}`` the rows with a value (``<name>_covered``)
    and their zero-safe percentage (``<name>_pct``)."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias(total), *[F.count(c).alias(f"{n}_covered") for n, c in covered.items()])
    return out.withColumns({f"{n}_pct": safe_pct(F.col(f"{n}_covered"), F.col(total), scale) for n in covered})


def count_ifs(df: DataFrame, by: Sequence[str], conds: dict[str, Column]) -> DataFrame:
    """Several COUNT_IF in one pass."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"),
                               *[F.count_if(c).alias(n) for n, c in conds.items()])


def distribution(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def banded(df: DataFrame, value: str, cuts: Sequence[tuple[float, str]], other: str) -> DataFrame:
    """Bands by descending cut points ``[(lower_bound, label), ...]``; report count and the
    band's minimum; callers order by ``min_value desc``."""
    band = None
    for bound, label in cuts:
        band = (F.when(F.col(value) >= bound, F.lit(label)) if band is None
                else band.when(F.col(value) >= bound, F.lit(label)))
    band = band.otherwise(F.lit(other))
    return (df.withColumn("band", band).groupBy("band")
            .agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min_value")))


def distinct_keys(df: DataFrame, keysets: dict[str, Sequence[str]]) -> DataFrame:
    """Exact COUNT(DISTINCT ...) per named key set (composite keys skip rows with a NULL
    part, as SQL does); one row per key set."""
    out = None
    for name, cols in keysets.items():
        part = df.select(*cols).dropna().distinct().agg(F.count(F.lit(1)).alias("distinct_keys"))
        part = part.select(F.lit(name).alias("key_set"), "distinct_keys")
        out = part if out is None else out.unionByName(part)
    return out


def ordered_text(df: DataFrame, by: Sequence[str], order: Sequence[str], text: Column,
                 sep: str = ",", name: str = "text") -> DataFrame:
    """LISTAGG(text, sep) WITHIN GROUP (ORDER BY order) — sorted struct list then join."""
    items = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], text.alias("_t"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(items, lambda x: x["_t"]), sep).alias(name))


def collect_objects(df: DataFrame, by: Sequence[str], order: Sequence[str],
                    fields: Sequence[str], name: str = "objects") -> DataFrame:
    """Array of objects per group, ordered, serialised as JSON."""
    items = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order],
                                                 F.struct(*[F.col(c) for c in fields]).alias("_o"))))
    return df.groupBy(*by).agg(F.to_json(F.transform(items, lambda x: x["_o"])).alias(name))


def pct_of_total(df: DataFrame, value: str, name: str = "pct_of_total", scale: int = 2) -> DataFrame:
    """Percent of the grand total, which is a scalar subquery: no row leaves its task."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(name, F.round(F.col(value).cast("double") * 100.0 / total.cast("double"), scale))


def pre_aggregate(df: DataFrame, dims: Sequence[str], measures: dict[str, Column],
                  completeness_cols: Sequence[str] = ()) -> DataFrame:
    """``aggregate`` strategy: dims x measures, plus non-NULL share per listed column.

    Money measures should be DECIMAL(18,4) before summing (exact, order-independent).
    """
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [m.alias(n) for n, m in measures.items()]
    aggs += [F.count(F.col(c)).alias(f"nonnull_{c}") for c in completeness_cols]
    out = df.groupBy(*dims).agg(*aggs)
    for c in completeness_cols:
        out = out.withColumn(f"complete_{c}", safe_pct(F.col(f"nonnull_{c}"), F.col("n_rows"), 2))
    return out


def money_sum(c: Column) -> Column:
    """Exact money sum, returned as DOUBLE after the exact decimal total."""
    return F.sum(c.cast(MONEY_TYPE)).cast("double")


def layer_funnel(counts: DataFrame, layer_col: str = "layer", rows_col: str = "rows",
                 order_col: str = "layer_order") -> DataFrame:
    """Row volume per layer and the drop from the previous layer (percent of it)."""
    w = Window.partitionBy().orderBy(order_col)
    prev = F.lag(F.col(rows_col)).over(w)
    return counts.withColumn("prev_rows", prev).withColumn(
        "drop_pct", F.round((prev - F.col(rows_col)).cast("double") * 100.0
                            / F.nullif(prev, F.lit(0)).cast("double"), 2))
