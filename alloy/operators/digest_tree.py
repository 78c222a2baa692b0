"""Change detection by a tree of checksums over key ranges.

``leaves`` cuts a table by an integral key into ranges of ``width`` keys and gives each the
number of its rows and the sum of their row hashes, whatever their order: one scan, combined
map-side, one row per range. ``rolled_up`` adds ``FANOUT`` neighbours to their parent. Two
tables are compared from the root down, and only children of nodes that differ are looked at;
the rows of the ranges that differ are read again, with a filter on the key that reaches the
scan, and compared key by key. The leaves of a snapshot are worth keeping: comparing
it with a new version reads the new version once and a few ranges of both.

NULL keys are a range of their own. Repeated rows count as often as they occur. Rows are equal
if the texts of their columns are (``columns.canonical_row``), NULLs being equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloy.functions.columns import canonical_row

FANOUT = 64
#: ranges of keys that a filter spells out; more are one range from the least to the greatest
SPELLED = 200


def row_hash(df: DataFrame) -> Column:
    """60 bits of the hash of a whole row, as a decimal that sums without overflow."""
    return F.conv(F.substring(F.md5(canonical_row(df, sorted(df.columns))), 1, 15), 16, 10).cast("decimal(38,0)")


def node_of(key: Column, width: int) -> Column:
    """Range i has the number 2 i + 1, negative ones too; 0 is for NULL keys."""
    return F.coalesce(F.floor(key / F.lit(width)) * 2 + 1, F.lit(0)).cast("long")


def leaves(df: DataFrame, key: str, width: int) -> DataFrame:
    """``node, n_rows, checksum`` of every range with rows."""
    return df.groupBy(node_of(F.col(key), width).alias("node")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row_hash(df)).alias("checksum"))


def rolled_up(level: DataFrame) -> DataFrame:
    """The parents of a level's nodes."""
    return level.groupBy(parent(F.col("node")).alias("node")).agg(F.sum("n_rows").alias("n_rows"), F.sum("checksum").alias("checksum"))


def parent(node: Column) -> Column:
    return F.when(node == 0, 0).otherwise(F.floor((node - 1) / 2 / FANOUT) * 2 + 1).cast("long")


def differing_nodes(a: DataFrame, b: DataFrame, levels: int = 2) -> DataFrame:
    """Leaves of ``a`` and ``b`` that differ, found from ``levels`` levels above them down."""
    tower = [(a, b)]
    for _ in range(levels):
        tower.append((rolled_up(tower[-1][0]), rolled_up(tower[-1][1])))
    found = None
    for x, y in reversed(tower):
        if found is not None:
            x, y = (t.join(F.broadcast(found.withColumnRenamed("node", "_up")), parent(F.col("node")) == F.col("_up"), "left_semi") for t in (x, y))
        joined = x.join(y.select(F.col("node").alias("_node"), F.col("n_rows").alias("_n"), F.col("checksum").alias("_c")),
                        F.col("node") == F.col("_node"), "full")
        found = joined.filter(~(F.col("n_rows").eqNullSafe(F.col("_n")) & F.col("checksum").eqNullSafe(F.col("_c")))).select(
            F.coalesce("node", "_node").alias("node"))
    return found


def within(key: str, width: int, nodes: list[int]) -> Column:
    """A filter on the key that a Parquet scan understands."""
    spans: list[list[int]] = []
    for node in sorted(n for n in nodes if n):
        low = (node - 1) // 2 * width
        if spans and spans[-1][1] == low:
            spans[-1][1] = low + width
        else:
            spans.append([low, low + width])
    if len(spans) > SPELLED:
        spans = [[spans[0][0], spans[-1][1]]]
    chosen = F.col(key).isNull() if 0 in nodes else F.lit(False)
    for low, high in spans:
        chosen = chosen | ((F.col(key) >= low) & (F.col(key) < high))
    return chosen


def changed_keys(old: DataFrame, new: DataFrame, key: str, width: int = 1024, old_leaves: DataFrame | None = None) -> DataFrame:
    """``key, status``: keys whose rows were ADDED, REMOVED or CHANGED between two tables of the
    same columns. The numbers of the ranges that differ reach the driver, to become the filter
    of the second read; with very many of them the filter only bounds the keys, and a semi-join
    picks the ranges."""
    kept = leaves(old, key, width) if old_leaves is None else old_leaves
    ids = [r["node"] for r in differing_nodes(kept, leaves(new, key, width)).collect()]
    picked = old.sparkSession.createDataFrame([(i,) for i in ids], "node long")

    def of(df: DataFrame, name: str) -> DataFrame:
        rows = df.filter(within(key, width, ids)).withColumn("_node", node_of(F.col(key), width))
        rows = rows.join(F.broadcast(picked), F.col("_node") == F.col("node"), "left_semi").drop("_node")
        return rows.groupBy(F.col(key).alias(f"{name}_key")).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.sum(row_hash(df)).alias(f"{name}_c"))

    both = of(old, "a").join(of(new, "b"), F.col("a_key").eqNullSafe(F.col("b_key")), "full")
    status = (F.when(F.col("a_n").isNull(), "ADDED").when(F.col("b_n").isNull(), "REMOVED")
              .when((F.col("a_n") != F.col("b_n")) | (F.col("a_c") != F.col("b_c")), "CHANGED"))
    return both.select(F.coalesce("a_key", "b_key").alias(key), status.alias("status")).filter("status IS NOT NULL")
