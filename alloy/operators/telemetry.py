"""Run telemetry and the learning store: reinforcement fold, KPIs, flattened run
results, coverage levels, ranked learnings and the saved semantic-model queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloy.operators.windows import MICROS, micros

# ---- fixed values ---------------------------------------------------------------
# Reinforcement: conf' = least((conf + observed) / 2 + 0.05, 1)
REINFORCE_BONUS = 0.05
ACTIVE_MIN_CONFIDENCE = 0.7
# ---------------------------------------------------------------------------------


def _blocks(observations: DataFrame, key: str, ts: str, seq: str, conf: str, block_seconds: int) -> DataFrame:
    """``key, steps``: per key its time blocks in order, each as the first confidence folded
    over the rest (``alone``) and as one step ``x -> least(a * x + d, m)`` (``after``)."""
    block = F.floor(micros(observations, ts) / F.lit(block_seconds * MICROS))
    rows = observations.filter(F.col(conf).isNotNull()).select(
        F.col(key), block.alias("_b"), F.col(ts).alias("_ts"), F.col(seq).alias("_seq"), F.col(conf).cast("double").alias("_c"))
    held = rows.groupBy(key, "_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("_ts", "_seq", "_c"))),
                                                   lambda x: x["_c"]).alias("_h"))

    def bonus(c: Column) -> Column:
        return c / F.lit(2.0) + F.lit(REINFORCE_BONUS)

    alone = F.aggregate(F.slice("_h", 2, F.size("_h")), F.element_at("_h", 1),
                        lambda v, c: F.least((v + c) / F.lit(2.0) + F.lit(REINFORCE_BONUS), F.lit(1.0)))
    same = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("d"), F.lit(float("inf")).alias("m"))
    after = F.aggregate("_h", same, lambda f, c: F.struct(
        (f["a"] / F.lit(2.0)).alias("a"), (f["d"] / F.lit(2.0) + bonus(c)).alias("d"),
        F.least(f["m"] / F.lit(2.0) + bonus(c), F.lit(1.0)).alias("m")))
    return held.groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct("_b", alone.alias("alone"), after.alias("after")))).alias("steps"))


def _through(steps: Column, start: Column) -> Column:
    """``start`` taken through the blocks' steps."""
    return F.aggregate(steps, start, lambda v, s: F.least(s["after"]["a"] * v + s["after"]["d"], s["after"]["m"]))


def _observed(observations: DataFrame, key: str, ts: str, seq: str, text_cols: Sequence[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("times_observed"), F.max(ts).alias("last_observed")]
    if text_cols:
        aggs.append(F.max_by(F.struct(*[F.col(c) for c in text_cols]), F.struct(ts, seq)).alias("_t"))
    return observations.groupBy(key).agg(*aggs)


def _beside(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``more``, NULL keys being equal."""
    return rows.join(more.withColumnRenamed(key, "_more"), F.col(key).eqNullSafe(F.col("_more")), "left").drop("_more")


def reinforce(observations: DataFrame, key: str, ts: str, seq: str, conf: str,
              text_cols: Sequence[str] = (), block_seconds: int = 3_600) -> DataFrame:
    """Fold all observations per signature in time order.

    First observation inserts (count 1, confidence as observed); each later one adds 1
    to the count, sets ``conf = least((conf + c) / 2 + 0.05, 1)`` and replaces the texts.
    A step is ``x -> least(a * x + d, m)``, and such steps compose to one of their kind:
    rows are folded per (key, time block), then a key's blocks in order, so no task holds
    more of a key than one block's rows or one row per block. Observations without
    confidence count and set the texts, and leave the confidence as it is. Observations
    with NULL signature are one signature, here and in ``merge_learnings``.
    """
    folded = _blocks(observations, key, ts, seq, conf, block_seconds).select(
        key, _through(F.slice("steps", 2, F.size("steps")), F.element_at("steps", 1)["alone"]).alias("confidence"))
    out = _beside(_observed(observations, key, ts, seq, text_cols), folded, key)
    cols = [key, "times_observed", "last_observed", F.round("confidence", 6).alias("confidence")]
    cols += [F.col(f"_t.{c}").alias(c) for c in text_cols]
    return out.select(*cols).withColumn("is_active", F.coalesce(F.col("confidence") >= F.lit(0.5), F.lit(False)))


def merge_learnings(stored: DataFrame, observations: DataFrame, key: str, ts: str, seq: str, conf: str,
                    text_cols: Sequence[str] = (), block_seconds: int = 3_600) -> DataFrame:
    """Merge observations into stored learnings ``key, times_observed, last_observed,
    confidence, *text_cols, is_active``: the active row of a signature is reinforced by
    each of them, a signature without one gets a new active row; all other rows stay."""
    columns = [key, "times_observed", "last_observed", "confidence", *text_cols, "is_active"]
    new = _beside(_observed(observations, key, ts, seq, text_cols), _blocks(observations, key, ts, seq, conf, block_seconds), key)
    old = stored.filter("is_active").select(F.col(key).alias("_key"), F.struct(*columns[1:]).alias("_old"))
    both = old.join(new, F.col("_key").eqNullSafe(F.col(key)), "full")
    steps = F.coalesce("steps", F.array())
    first = F.coalesce(F.col("_old")["confidence"], F.get(F.col("steps"), F.lit(0))["alone"])
    rest = F.when(F.col("_old")["confidence"].isNotNull(), steps).otherwise(F.slice(steps, 2, F.greatest(F.size(steps), F.lit(1))))
    merged = both.select(
        F.coalesce(key, "_key").alias(key),
        (F.coalesce(F.col("_old")["times_observed"], F.lit(0)) + F.coalesce("times_observed", F.lit(0))).alias("times_observed"),
        F.greatest(F.col("_old")["last_observed"], F.col("last_observed")).alias("last_observed"),
        F.when(F.col("times_observed").isNull(), F.col("_old")["confidence"]).otherwise(F.round(_through(rest, first), 6)).alias("confidence"),
        *[F.when(F.col("times_observed").isNull(), F.col("_old")[c]).otherwise(F.col(f"_t.{c}")).alias(c) for c in text_cols],
        F.lit(True).alias("is_active"))
    return merged.unionByName(stored.filter(~F.coalesce(F.col("is_active"), F.lit(False))).select(columns))


def top_learnings(learnings: DataFrame, n: int = 5, min_conf: float = ACTIVE_MIN_CONFIDENCE,
                  key: str = "pattern_signature") -> DataFrame:
    """Active learnings above the confidence floor, ranked by confidence then times seen."""
    return (learnings.filter(F.col("is_active") & (F.col("confidence") > min_conf))
            .orderBy(F.col("confidence").desc(), F.col("times_observed").desc(), F.col(key).asc()).limit(n))


def kpis(runs: DataFrame, lineage: DataFrame, learnings: DataFrame) -> DataFrame:
    """One-row KPI frame: one aggregate plus scalar subqueries (no join)."""
    return runs.agg(F.count(F.lit(1)).alias("runs")).select(
        "runs",
        lineage.agg(F.count("silver_table")).scalar().alias("silver_complete"),
        lineage.agg(F.count("gold_table")).scalar().alias("gold_complete"),
        learnings.agg(F.count_if(F.col("is_active"))).scalar().alias("active_learnings"))


def run_results(runs_nested: DataFrame, run_col: str, results_col: str) -> DataFrame:
    """Flatten the nested per-run result array to one row per (run, table)."""
    return runs_nested.select(run_col, F.explode(results_col).alias("r")).select(run_col, "r.*")


def coverage_level(lineage: DataFrame) -> DataFrame:
    level = (F.when(F.col("gold_status") == "COMPLETE", F.lit("Bronze+Silver+Gold"))
             .when(F.col("silver_status") == "COMPLETE", F.lit("Bronze+Silver"))
             .otherwise(F.lit("Bronze Only")))
    return lineage.groupBy(level.alias("coverage_level")).agg(F.count(F.lit(1)).alias("n_tables"))


def gaps(lineage: DataFrame) -> DataFrame:
    """Silver gaps (no Silver yet) and Gold gaps (Silver but no Gold)."""
    silver = lineage.filter(F.col("silver_table").isNull()).select(F.lit("SILVER").alias("layer"), "bronze_table")
    gold = (lineage.filter(F.col("silver_table").isNotNull() & F.col("gold_table").isNull())
            .select(F.lit("GOLD").alias("layer"), "bronze_table"))
    return silver.unionByName(gold)


def metric(table: DataFrame, measures: dict[str, Column], dims: Sequence[str] = (),
           where: Column | None = None) -> DataFrame:
    """Semantic-model query: measures by dimensions over a filtered table."""
    if where is not None:
        table = table.filter(where)
    return table.groupBy(*dims).agg(*[m.alias(n) for n, m in measures.items()])
