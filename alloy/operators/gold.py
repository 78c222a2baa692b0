"""Gold models: FLAT, STAR_SCHEMA, DATA_VAULT (hub / satellite / link), ONE_BIG_TABLE,
and rule-driven routing of one Silver table into many Gold tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloy.functions.columns import hash_key
from alloy.operators.filters import exclusion_flag
from alloy.operators.joins import Edge, enrich, resolve_merge_targets
from alloy.operators.windows import with_neighbors
from alloy.session import broadcast_if_small


def gold_flat(df: DataFrame, keep: Sequence[str], derivations: dict[str, Column]) -> DataFrame:
    """Explicit columns plus derived ones (DATEDIFF, CASE, COALESCE, arithmetic)."""
    return df.select(*[F.col(c) for c in keep], *[e.alias(n) for n, e in derivations.items()])


def surrogate(df: DataFrame, cols: Sequence[str]) -> Column:
    """Reproducible surrogate key: SHA-256 of the natural key (no global row_number)."""
    return hash_key(df, cols)


def star(fact: DataFrame, dims: dict[str, Sequence[str]], measures: Sequence[str],
         date_col: str | None = None) -> dict[str, DataFrame]:
    """FACT with measures and one surrogate FK per dimension; one DIM per entity
    (distinct natural keys + attributes) and DIM_DATE from the fact's dates."""
    out: dict[str, DataFrame] = {}
    fact_cols = []
    for name, cols in dims.items():
        key, attrs = cols[0], list(cols[1:])
        sk = f"{name.lower()}_sk"
        out[f"DIM_{name.upper()}"] = (fact.select(key, *attrs).dropDuplicates([key])
                                      if not attrs else _dim(fact, key, attrs)) \
            .withColumn(sk, surrogate(fact.select(key), [key]))
        fact_cols.append(surrogate(fact.select(key), [key]).alias(sk))
    if date_col:
        d = F.to_date(F.col(date_col))
        fact_cols.append((F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).alias("date_sk"))
        dates = fact.select(d.alias("calendar_date")).distinct()
        out["DIM_DATE"] = dates.select(
            (F.year("calendar_date") * 10000 + F.month("calendar_date") * 100
             + F.dayofmonth("calendar_date")).alias("date_sk"),
            "calendar_date", F.year("calendar_date").alias("year"), F.month("calendar_date").alias("month"),
            F.dayofmonth("calendar_date").alias("day"), (F.dayofweek("calendar_date") - 1).alias("day_of_week"))
    out["FACT"] = fact.select(*fact_cols, *[F.col(m) for m in measures])
    return out


def _dim(fact: DataFrame, key: str, attrs: list[str]) -> DataFrame:
    """One row per natural key; attributes from the smallest attribute tuple (deterministic)."""
    picked = fact.groupBy(key).agg(F.min(F.struct(*[F.col(a) for a in attrs])).alias("_a"))
    return picked.select(key, *[F.col(f"_a.{a}").alias(a) for a in attrs])


def hub(df: DataFrame, bk: Sequence[str], load_dts: str, source: str, name: str = "HK") -> DataFrame:
    """HUB: distinct business keys with their hash key, load time and record source."""
    keys = df.select(*bk).dropna().distinct()
    return keys.select(surrogate(keys, bk).alias(name), *bk,
                       F.to_timestamp_ntz(F.lit(load_dts)).alias("LOAD_DTS"),
                       F.lit(source).alias("RECORD_SOURCE"))


def satellite(df: DataFrame, bk: Sequence[str], attrs: Sequence[str], load_col: str,
              tiebreak: Sequence[str] = (), source: str = "", name: str = "HK") -> DataFrame:
    """SATELLITE: descriptive attributes with HASHDIFF; a row only when HASHDIFF changes
    from the previous load of the same hash key."""
    s = (df.withColumn(name, surrogate(df, bk)).withColumn("HASHDIFF", hash_key(df, attrs))
         .select(name, *attrs, "HASHDIFF", F.col(load_col).alias("LOAD_DTS"), *tiebreak))
    nb = with_neighbors(s, [name], "LOAD_DTS", list(tiebreak), prev_cols=["HASHDIFF"])
    changed = F.col("prev_HASHDIFF").isNull() | (F.col("prev_HASHDIFF") != F.col("HASHDIFF"))
    return nb.filter(changed).select(name, *attrs, "HASHDIFF", "LOAD_DTS", *tiebreak) \
        .withColumn("RECORD_SOURCE", F.lit(source))


def link(df: DataFrame, bk_a: Sequence[str], bk_b: Sequence[str], load_dts: str, source: str) -> DataFrame:
    """LINK: distinct pairs of hub keys, with the link hash over both business keys."""
    pairs = df.select(*bk_a, *bk_b).dropna().distinct()
    return pairs.select(surrogate(pairs, [*bk_a, *bk_b]).alias("LINK_HK"),
                        surrogate(pairs, bk_a).alias("HK_A"), surrogate(pairs, bk_b).alias("HK_B"),
                        F.to_timestamp_ntz(F.lit(load_dts)).alias("LOAD_DTS"), F.lit(source).alias("RECORD_SOURCE"))


def one_big_table(fact: DataFrame, dims: Sequence[tuple[DataFrame, Edge]]) -> DataFrame:
    """One wide denormalised table: the enrichment chain over every dimension."""
    return enrich(fact, dims, how="left")


def route(df: DataFrame, rules: DataFrame, value_col: str, category_col: str,
          table_col: str = "gold_table") -> DataFrame:
    """Add the Gold target per row: rule matched on ``upper(value)``; a merged rule sends
    its rows to the merge target's table; rows without a rule, with a NULL target or
    with an excluded category (the matched rule's own exclusions) are dropped.

    Rules are configuration (one row per routed value) and are broadcast after the
    size check; the data side is scanned once.
    """
    resolved = resolve_merge_targets(rules).select(
        F.upper(F.col("value")).alias("_rv"), F.col("gold_table").alias("_gt"),
        F.col("exclusions").alias("_ex"))
    j = df.join(broadcast_if_small(resolved), F.upper(F.col(value_col)) == F.col("_rv"), "inner")
    keep = F.col("_gt").isNotNull() & ~exclusion_flag(F.col(category_col), F.col("_ex"))
    return j.filter(keep).withColumn(table_col, F.col("_gt")).drop("_rv", "_gt", "_ex")
