"""Minimal unique column combinations, level by level.

The lattice of column sets is walked from single columns up. A set is not read at all if it
holds a known key (it is unique, but not minimal), if it lies in a set known not to be unique
(all eligible columns of a table are tried first), or if the product of its columns' distinct
counts is below the number of rows. The rest of a level gets approximate distinct counts, one
scan per table for all of them; only sets whose count may equal the rows are decided exactly,
by looking for one tuple that repeats: first among the tuples whose hash falls in one slice of
SLICES, where one repeat settles that a set is no key, then, for the sets without one, among all.
All tuples of a set move only if it is a key, or nearly.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: types whose values identify rows; floating-point and decimal columns are measures
KEY_TYPES = (T.IntegralType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
#: relative deviation of the approximate counts, and how many of them a key may be off
DEVIATION, DEVIATIONS = 0.02, 6
SLICES = 64
KEYS = "table_name string, key_columns string, n_columns int"

Columns = tuple[str, ...]


def distinct_counts(tables: dict[str, DataFrame], sets: dict[str, Sequence[Columns]]) -> dict[tuple[str, Columns], tuple[int, int]]:
    """(approximate distinct tuples, rows without a NULL) of column sets; one scan per table."""
    parts = []
    for name, own in sets.items():
        if own:
            rows = tables[name].agg(*itertools.chain.from_iterable(
                (F.approx_count_distinct(F.xxhash64(*c), DEVIATION).alias(f"d{i}"),
                 F.count_if(reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in c])).alias(f"n{i}")) for i, c in enumerate(own)))
            parts.append(rows.select(F.lit(name).alias("name"), F.inline(F.array(*[
                F.struct(F.lit(i).alias("i"), F.col(f"d{i}").alias("d"), F.col(f"n{i}").alias("n")) for i in range(len(own))]))))
    if not parts:
        return {}
    return {(r["name"], sets[r["name"]][r["i"]]): (r["d"], r["n"]) for r in reduce(DataFrame.unionByName, parts).collect()}


def repeated(tables: dict[str, DataFrame], sets: Sequence[tuple[str, Columns]]) -> set[tuple[str, Columns]]:
    """Those of the sets that have a tuple twice (exact; counts are combined map-side)."""
    found = _repeated(tables, sets, lambda columns: F.pmod(F.xxhash64(*columns), F.lit(SLICES)) == 0)
    return found | _repeated(tables, [s for s in sets if s not in found], lambda columns: F.lit(True))


def _repeated(tables: dict[str, DataFrame], sets: Sequence[tuple[str, Columns]], which: Callable[[Columns], Column]) -> set[tuple[str, Columns]]:
    """Those of the sets that have a tuple twice among the tuples that ``which`` takes."""
    if not sets:
        return set()
    parts = [tables[name].filter(which(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1).select(F.lit(i).alias("i"))
             for i, (name, columns) in enumerate(sets)]
    return {sets[r["i"]] for r in reduce(DataFrame.unionByName, parts).collect()}


def minimal_keys(tables: dict[str, DataFrame], max_columns: int = 3) -> DataFrame:
    """``table_name, key_columns, n_columns``: every set of up to ``max_columns`` columns that
    identifies the rows and of which no part does. Columns with NULLs and an empty table have no
    keys. One row per key reaches the driver and becomes the result."""
    spark = next(iter(tables.values())).sparkSession
    eligible = {name: [f.name for f in df.schema.fields if isinstance(f.dataType, KEY_TYPES)] for name, df in tables.items()}
    rows = {r["name"]: r["n"] for r in reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]).collect()}
    singles = distinct_counts(tables, {name: [(c,) for c in cols] for name, cols in eligible.items() if rows[name]})
    whole = {name: [c for c in cols if rows[name] and singles[name, (c,)][1] == rows[name]] for name, cols in eligible.items()}

    def may_be_key(name: str, distinct: int) -> bool:
        return distinct >= rows[name] * (1 - DEVIATIONS * DEVIATION)

    # tables whose rows repeat in all columns that could tell them apart have no key at all
    everything = distinct_counts(tables, {name: [tuple(cols)] for name, cols in whole.items() if len(cols) > 1})
    alive = {name: cols for name, cols in whole.items()
             if cols and (len(cols) == 1 or may_be_key(name, everything[name, tuple(cols)][0]))}
    most = {key: distinct * (1 + DEVIATIONS * DEVIATION) for key, (distinct, _) in singles.items()}
    found: dict[str, list[Columns]] = {name: [] for name in alive}
    for size in range(1, max_columns + 1):
        level = {name: [c for c in itertools.combinations(cols, size)
                        if not any(set(k) <= set(c) for k in found[name])
                        and math.prod(most[name, (x,)] for x in c) >= rows[name]] for name, cols in alive.items()}
        counts = singles if size == 1 else distinct_counts(tables, level)
        near = [(name, c) for name, sets in level.items() for c in sets if may_be_key(name, counts[name, c][0])]
        again = repeated(tables, near)
        for name, c in near:
            if (name, c) not in again:
                found[name].append(c)
    return spark.createDataFrame([(name, ",".join(k), len(k)) for name, keys in found.items() for k in keys], KEYS)
