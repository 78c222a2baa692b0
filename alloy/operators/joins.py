"""Joins: FK enrichment, label join, rule matching, as-of join, referential checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alloy.operators.windows import MICROS, micros
from alloy.session import DEFAULT_BROADCAST_BYTES, FILE_TO_MEMORY, broadcast_if_small, planned_bytes


@dataclass(frozen=True)
class Edge:
    """FK edge: ``fact.source_col -> dim.target_col``."""

    source_col: str
    target_col: str


def is_small(dim: DataFrame) -> bool:
    return planned_bytes(dim) * FILE_TO_MEMORY <= DEFAULT_BROADCAST_BYTES


def enrich(fact: DataFrame, dims: Sequence[tuple[DataFrame, Edge]], how: str = "left") -> DataFrame:
    """Equi-joins along FK edges. Each dimension is broadcast only when its estimated
    size is under the threshold; otherwise AQE picks sort-merge / shuffled hash. A left join to a
    large dimension of a large dimension is made there, and the fact meets the large dimensions
    first, the narrowest before the others, so its rows are moved as seldom and as narrow as can be."""
    every = [fact, *(d for d, _ in dims)]
    names = [c for df in every for c in df.columns]
    large = [not is_small(d) for d, _ in dims]
    if how != "left" or not any(large) or len(set(names)) < len(names):
        return _chain(fact, dims, how)
    root = list(range(len(dims)))  # the large dimension that a dimension is joined to, or itself
    for i, (_, edge) in enumerate(dims):
        owner = next((j for j in range(i) if edge.source_col in dims[j][0].columns), None)
        if large[i] and owner is not None and large[owner]:
            root[i] = root[owner]
    folded = {i: (_chain(dims[i][0], [dims[j] for j, r in enumerate(root) if r == i and j != i], how), dims[i][1])
              for i, r in enumerate(root) if i == r}
    first = sorted((i for i in folded if large[i] and dims[i][1].source_col in fact.columns), key=lambda i: len(folded[i][0].columns))
    return _chain(fact, [folded[i] for i in [*first, *(i for i in folded if i not in first)]], how).select(names)


def _chain(fact: DataFrame, dims: Sequence[tuple[DataFrame, Edge]], how: str) -> DataFrame:
    out = fact
    for dim, edge in dims:
        d = F.broadcast(dim) if is_small(dim) else dim
        if edge.source_col == edge.target_col:
            out = out.join(d, on=edge.source_col, how=how)
        else:
            out = out.join(d, out[edge.source_col] == d[edge.target_col], how)
    return out


def label_join(features: DataFrame, labels: DataFrame, key: str,
               label_cols: Sequence[str]) -> DataFrame:
    """Left join of labels; a missing label is 0."""
    joined = features.join(labels.select(key, *label_cols), on=key, how="left")
    return joined.select(*[F.col(c) for c in features.columns],
                         *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in label_cols])


def match_rules(df: DataFrame, rules: DataFrame, value_cols: Sequence[str], layer: str | None = None,
                pattern_col: str = "pattern", layer_col: str = "layer") -> DataFrame:
    """Theta join ``value LIKE pattern`` (of any value column, once for each rule) against a
    (small, size-checked) rule table.

    The rule table is configuration (tens of rows); it is broadcast behind the size
    check so the data side is never shuffled. A layer filter keeps rules for the
    layer plus BOTH.
    """
    r = rules
    if layer is not None:
        r = r.filter(F.upper(F.col(layer_col)).isin(layer.upper(), "BOTH"))
    r = broadcast_if_small(r)
    return df.join(r, F.expr(" OR ".join(f"`{c}` LIKE `{pattern_col}`" for c in value_cols)), "inner")


def as_of_join(fact: DataFrame, versions: DataFrame, fact_key: str, version_key: str,
               fact_ts: str, valid_from: str = "EFFECTIVE_FROM",
               valid_to: str = "EFFECTIVE_TO", bucket_seconds: int = 86_400) -> DataFrame:
    """Point-in-time join to SCD2 versions: ``from <= t < to`` (open end = NULL).

    By the SCD2 invariant the version of a fact is the last one that begins at or before
    it, if that one has not ended. Facts and versions are laid together per (key, time
    bucket) and the last version is carried along; a bucket begins with the last version
    of the buckets before it (one row per bucket). No fact meets more than one version,
    and no task holds more than one bucket of one key. Empty versions (``from = to``)
    never match, nor do NULL keys and times.
    """
    width = bucket_seconds * MICROS
    f = fact.select(F.struct(*fact.columns).alias("_f"), F.col(fact_key).alias("_k"), micros(fact, fact_ts).alias("_t"))
    v = versions.filter(F.col(valid_from).isNotNull() & F.col(version_key).isNotNull()
                        & (F.col(valid_to).isNull() | (F.col(valid_to) > F.col(valid_from))))
    v = v.select(F.struct(*versions.columns).alias("_v"), F.col(version_key).alias("_k"), micros(versions, valid_from).alias("_t"))
    both = f.unionByName(v, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / F.lit(width)))
    last = F.last("_v", ignorenulls=True)
    # RANGE frames: a version that begins at the time of a fact counts
    inside = Window.partitionBy("_k", "_b").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_in", last.over(inside)).filter(F.col("_f").isNotNull()).select("_f", "_k", "_t", "_b", "_in")
    ends = both.groupBy("_k", "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_v"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_k").alias("_ck"), F.col("_b").alias("_cb"), last.over(before).alias("_carry"))
    found = held.join(carried, (F.col("_k") == F.col("_ck")) & (F.col("_b") == F.col("_cb")), "left")
    version = F.coalesce("_in", "_carry")
    open_ = version[valid_to].isNull() | (F.col("_f")[fact_ts] < version[valid_to])
    found = found.select("_f", F.when(F.col("_t").isNotNull() & open_, version).alias("_v"))
    return found.select(*[F.col("_f")[c].alias(c) for c in fact.columns], *[F.col("_v")[c].alias(c) for c in versions.columns])


def orphans(child: DataFrame, parent: DataFrame, child_col: str, parent_col: str) -> DataFrame:
    """Child rows whose non-NULL FK value has no parent (NOT EXISTS)."""
    keys = parent.select(F.col(parent_col).alias("_pk"))
    return (child.filter(F.col(child_col).isNotNull())
            .join(keys, F.col(child_col) == F.col("_pk"), "left_anti"))


def fk_orphans(pairs: Sequence[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """Orphan count per edge ``(child_name, child, child_col, parent_name, parent, parent_col)``,
    one row per edge, unioned into one result."""
    out = None
    for child_name, child, ccol, parent_name, parent, pcol in pairs:
        part = orphans(child.select(ccol), parent.select(pcol), ccol, pcol).agg(
            F.count(F.lit(1)).alias("orphan_rows"))
        part = part.select(F.lit(child_name).alias("child_table"), F.lit(ccol).alias("child_column"),
                           F.lit(parent_name).alias("parent_table"),
                           F.lit(pcol).alias("parent_column"), "orphan_rows")
        out = part if out is None else out.unionByName(part)
    return out


def children_per_parent(parents: DataFrame, children: DataFrame, key: str,
                        child_key: str, name: str = "n_children") -> DataFrame:
    """Left join + count of non-NULL child key; children are pre-aggregated before the join."""
    counts = children.groupBy(F.col(key)).agg(F.count(F.col(child_key)).alias(name))
    return (parents.join(counts, on=key, how="left")
            .withColumn(name, F.coalesce(F.col(name), F.lit(0))))


def resolve_merge_targets(rules: DataFrame, value_col: str = "value",
                          table_col: str = "target_table",
                          merge_col: str = "merge_into") -> DataFrame:
    """Self left join of routing rules: a rule merged into another value takes that
    rule's target table (case-insensitive)."""
    tgt = rules.select(F.upper(F.col(value_col)).alias("_mv"),
                       F.col(table_col).alias("_merged_table"))
    joined = rules.join(broadcast_if_small(tgt), F.upper(F.col(merge_col)) == F.col("_mv"), "left")
    return joined.withColumn(
        "gold_table",
        F.when(F.col(merge_col).isNotNull(), F.col("_merged_table")).otherwise(F.col(table_col)),
    ).drop("_mv", "_merged_table")

