"""Row filters: soft deletes, CDC deletes, category exclusion, null quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def passthrough(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Explicit-column projection (never ``*``): Catalyst prunes the scan to these."""
    return df.select(*[F.col(c) for c in (cols or df.columns)])


def drop_deleted(df: DataFrame, flag: str | Column) -> DataFrame:
    """Soft-delete filter; a NULL flag means *not* deleted."""
    c = F.col(flag) if isinstance(flag, str) else flag
    return df.filter(~F.coalesce(c, F.lit(False)))


def drop_cdc_deletes(df: DataFrame, op_col: str = "_OPERATION") -> DataFrame:
    """CDC filter with SQL semantics (``op != 'DELETE'``; NULL operations drop too)."""
    return df.filter(F.col(op_col) != F.lit("DELETE"))


def parse_rule_list(rules: str | None) -> list[str]:
    """Comma-separated rule text -> trimmed, non-empty values."""
    if not rules:
        return []
    return [r.strip() for r in rules.split(",") if r.strip()]


def exclude_categories(df: DataFrame, col: str, rules: str | None) -> DataFrame:
    """Remove rows whose category is in the rule list; NULL categories are kept."""
    values = parse_rule_list(rules)
    if not values:
        return df
    return df.filter(~F.coalesce(F.col(col).isin(*values), F.lit(False)))


def exclusion_flag(col: Column, rules: Column) -> Column:
    """Per-row variant when the rule text is itself a column (joined routing rules)."""
    items = F.transform(F.split(F.coalesce(rules, F.lit("")), ","), lambda x: F.trim(x))
    return F.coalesce(F.array_contains(F.filter(items, lambda x: x != ""), col), F.lit(False))


def quarantine_nulls(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split rows into (ok, bad) where bad has a NULL in any required column.

    Both sides are filters over the same plan; persist the input first when both
    are written, so the source is read once.
    """
    bad_cond = F.lit(False)
    for c in cols:
        bad_cond = bad_cond | F.col(c).isNull()
    return df.filter(~bad_cond), df.filter(bad_cond)
