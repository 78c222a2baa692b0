"""Deduplication: keep-latest, custom priority, immutable facts, exact-duplicate trails.

Keep-one-row-per-key is ``row_number() over (partition by key order by ...) = 1``
with the filter directly on the rank. Catalyst turns that into a ``WindowGroupLimit``
that runs *before* the shuffle as well (partial) as after it (final): every map task
sorts its own rows and forwards at most one row per key, so a key holding a third
of all rows is reduced map-side, like a combiner, and never reaches one task whole.
Measured at sf0.1 this is 1.5-2.7x faster than the equivalent ``min(struct)``
aggregation, which needs a partial *sort*-aggregate over wide structs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alloy.functions.columns import money as money_cast

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


@dataclass(frozen=True)
class Order:
    """One ordering term: a column name or expression, direction and null placement."""

    expr: str | Column
    desc: bool = False
    nulls_last: bool = True

    def column(self) -> Column:
        return F.col(self.expr) if isinstance(self.expr, str) else self.expr


def ntz_micros(c: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), c)


def _sort_col(o: Order) -> Column:
    c = o.column()
    if o.desc:
        return c.desc_nulls_last() if o.nulls_last else c.desc_nulls_first()
    return c.asc_nulls_last() if o.nulls_last else c.asc_nulls_first()


def keep_one(df: DataFrame, keys: Sequence[str], orders: Sequence[Order]) -> DataFrame:
    """One row per key: the first row under ``orders`` then every column ascending
    (NULLS LAST). The trailing all-column tie-break makes the survivor deterministic."""
    total = list(orders) + [Order(c) for c in df.columns]
    w = Window.partitionBy(*keys).orderBy(*[_sort_col(o) for o in total])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def _find(df: DataFrame, name: str) -> str | None:
    for c in df.columns:
        if c.upper() == name.upper():
            return c
    return None


def keep_latest(df: DataFrame, keys: Sequence[str],
                order_cols: Sequence[str] = ("UPDATED_AT", "CREATED_AT"),
                deleted: str | Column | None = None) -> DataFrame:
    """Keep-latest dedup: soft deletes removed *before* ranking, then the newest row per key
    by the order columns that exist (DESC NULLS LAST), then all columns ascending."""
    if deleted is not None:
        flag = F.col(deleted) if isinstance(deleted, str) else deleted
        df = df.filter(~F.coalesce(flag, F.lit(False)))
    present = [c for c in (_find(df, n) for n in order_cols) if c is not None]
    return keep_one(df, keys, [Order(c, desc=True) for c in present])


def keep_best(df: DataFrame, keys: Sequence[str], orders: Sequence[Order]) -> DataFrame:
    """Dedup with a custom priority (e.g. newest VALID_FROM, then unit EA > KG > other)."""
    return keep_one(df, keys, orders)


def immutable_fact(df: DataFrame, keys: Sequence[str], money: bool = True) -> DataFrame:
    """One row per natural key, survivor = first by all columns ascending; nothing filtered."""
    out = keep_one(df, keys, [])
    return money_cast(out) if money else out


def audit_trail(df: DataFrame) -> DataFrame:
    """Compliance trail: only exact duplicate rows go; every transition is kept."""
    return df.dropDuplicates()


def latest_per_key(df: DataFrame, keys: Sequence[str], orders: Sequence[Order],
                   where: Column | None = None) -> DataFrame:
    """QUALIFY row_number() = 1 over an optional filter (filter first)."""
    if where is not None:
        df = df.filter(where)
    return keep_one(df, keys, orders)
