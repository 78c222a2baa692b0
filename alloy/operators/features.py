"""Feature tables: velocity, z-score, phase durations, top-percent labels, splits, tiers."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloy.functions.columns import MONEY_TYPE
from alloy.operators.windows import range_frames, with_neighbors
from alloy.session import broadcast_if_small

DAY = 86_400
# fixed risk tiers: > 0.75 HIGH, > 0.40 MEDIUM, else LOW
RISK_HIGH, RISK_MEDIUM = 0.75, 0.40


def velocity(df: DataFrame, key: str, ts: str, amount: str) -> DataFrame:
    """Count in the last 24 h and exact spend in the last 7 d (both include the row).

    ``windows.range_frames``: prefix sums, no task holds more than an hour of one entity."""
    out = range_frames(df, [key], ts, [
        ("txn_count_24h", None, DAY),
        ("_spend_7d", F.col(amount).cast(MONEY_TYPE), 7 * DAY)])
    return out.withColumn("spend_7d", F.col("_spend_7d").cast("double")).drop("_spend_7d")


def zscore(df: DataFrame, key: str, ts: str, amount: str, days: int = 30,
           name: str = "amount_z") -> DataFrame:
    """(x - mean) / stddev_samp over the entity's last ``days`` (row included); NULL when
    fewer than 2 rows or zero spread. Sums are exact decimals, final math in DOUBLE."""
    x = F.col(amount).cast(MONEY_TYPE)
    out = range_frames(df, [key], ts, [
        ("_n", F.when(F.col(amount).isNotNull(), F.lit(1)).otherwise(F.lit(0)), days * DAY),
        ("_s1", x, days * DAY),
        ("_s2", x * x, days * DAY)])
    n = F.col("_n").cast("double")
    s1 = F.col("_s1").cast("double")
    s2 = F.col("_s2").cast("double")
    var = (s2 - s1 * s1 / n) / (n - F.lit(1.0))
    mean = s1 / n
    z = F.when((F.col("_n") >= 2) & (var > 0), F.round((F.col(amount) - mean) / F.sqrt(var), 6))
    return out.withColumn(name, z).drop("_n", "_s1", "_s2")


def phase_durations(log: DataFrame, run: str, ts: str, tiebreak: str) -> DataFrame:
    """Seconds from each step to the next step of the same run, and its share of the run.

    The run total telescopes to ``max(ts) - min(ts)``, so it is one grouped aggregate
    joined back instead of a window over the whole run. Steps with NULL run are one run.
    """
    nb = with_neighbors(log, [run], ts, [tiebreak], next_cols=[ts])
    nxt = F.timestamp_diff("MICROSECOND", F.col(ts), F.col(f"next_{ts}"))
    spans = log.groupBy(run).agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1")).select(
        F.col(run).alias("_r"), F.timestamp_diff("MICROSECOND", F.col("_t0"), F.col("_t1")).alias("_total_us"))
    out = nb.withColumn("_dur_us", nxt).join(broadcast_if_small(spans), F.col(run).eqNullSafe(F.col("_r")), "left")
    return (out.withColumn("duration_sec", F.col("_dur_us") / F.lit(1e6))
            .withColumn("pct_of_run", F.round(F.col("_dur_us").cast("double") * 100.0
                                              / F.nullif(F.col("_total_us"), F.lit(0)).cast("double"), 4))
            .drop("_r", "_total_us", "_dur_us", f"next_{ts}", "is_first"))


#: rows that are sorted in one task; buckets of the histogram that narrows down to them
SORT_ROWS, SKETCH_BUCKETS = 100_000, 10_000


def nth_smallest(df: DataFrame, col: str, rank: int) -> object:
    """The exact ``rank``-th smallest non-NULL value (from 1; None without values).

    A quantile sketch brackets the rank, counting verifies the bracket, and the rows inside
    go through the same again until few enough are left to sort: a few passes over one
    column for any number of rows, each leaving about 4 / SKETCH_BUCKETS of the last."""
    left = df.select(F.col(col).alias("v")).filter(F.col("v").isNotNull())
    n, margin = left.count(), 2.0 / SKETCH_BUCKETS
    if not 1 <= rank <= n:
        return None
    while n > SORT_ROWS:
        share = rank / n
        low, high = left.agg(F.percentile_approx("v", [max(0.0, share - margin), min(1.0, share + margin)], SKETCH_BUCKETS)).first()[0]
        below, upto = left.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v") <= high)).first()
        if not below < rank <= upto:
            margin *= 4
        elif low == high:
            return low
        elif upto - below == n:  # the bracket holds everything: halve the values instead
            pivot = left.agg(F.percentile_approx("v", 0.5)).first()[0]
            less, upto = left.agg(F.count_if(F.col("v") < pivot), F.count_if(F.col("v") <= pivot)).first()
            if less < rank <= upto:
                return pivot
            if rank <= less:
                left, n = left.filter(F.col("v") < pivot), less
            else:
                left, rank, n = left.filter(F.col("v") > pivot), rank - upto, n - upto
        else:
            left, rank, n = left.filter(F.col("v").between(low, high)), rank - below, upto - below
    return left.orderBy("v").offset(rank - 1).first()[0]


def top_pct_label(df: DataFrame, score: str, pct: float = 1.0, name: str = "is_top") -> DataFrame:
    """Label rows whose score is at or above the exact (100 - pct) percentile: the smallest
    score with at least that share of the non-NULL scores at or below it."""
    n = df.select(score).filter(F.col(score).isNotNull()).count()
    rank = max(1, math.ceil(Fraction(str(100 - pct)) * n / 100))
    threshold = nth_smallest(df, score, rank)
    if threshold is None:
        return df.withColumn(name, F.lit(False))
    return df.withColumn(name, F.coalesce(F.col(score) >= F.lit(threshold), F.lit(False)))


def hash_split(df: DataFrame, key: str, train_pct: int = 80, name: str = "split") -> DataFrame:
    """Deterministic split by key hash (independent of partitioning, unlike randomSplit)."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn(name, F.when(bucket < train_pct, F.lit("train")).otherwise(F.lit("test")))


def risk_tier(score: Column) -> Column:
    return (F.when(score > RISK_HIGH, F.lit("HIGH")).when(score > RISK_MEDIUM, F.lit("MEDIUM"))
            .otherwise(F.lit("LOW")))


def transaction_features(df: DataFrame, key: str, ts: str, amount: str, merchant: str,
                         keep: tuple[str, ...] = ()) -> DataFrame:
    """Feature table: 24 h count, 7 d spend, merchant mean, 30 d z-score, hour, weekday
    (0 = Sunday). PII (the entity key) is not carried unless listed in ``keep``.
    All five range sums share one pass (``windows.range_frames``)."""
    x = F.col(amount).cast(MONEY_TYPE)
    w = range_frames(df, [key], ts, [
        ("txn_count_24h", None, DAY),
        ("_spend_7d", x, 7 * DAY),
        ("_n", F.when(F.col(amount).isNotNull(), F.lit(1)).otherwise(F.lit(0)), 30 * DAY),
        ("_s1", x, 30 * DAY),
        ("_s2", x * x, 30 * DAY)])
    n, s1, s2 = (F.col(c).cast("double") for c in ("_n", "_s1", "_s2"))
    var = (s2 - s1 * s1 / n) / (n - F.lit(1.0))
    z = F.when((F.col("_n") >= 2) & (var > 0), F.round((F.col(amount) - s1 / n) / F.sqrt(var), 6))
    w = w.withColumn("spend_7d", F.col("_spend_7d").cast("double")).withColumn("amount_z", z)
    m = df.groupBy(merchant).agg(
        (F.sum(F.col(amount).cast(MONEY_TYPE)).cast("double")
         / F.count(F.col(amount)).cast("double")).alias("merchant_avg"))
    out = w.join(broadcast_if_small(m), merchant, "left")
    return out.select(*keep, "txn_count_24h", "spend_7d", F.round("merchant_avg", 6).alias("merchant_avg"),
                      "amount_z", F.hour(ts).alias("hour_of_day"),
                      (F.dayofweek(ts) - 1).alias("day_of_week"))
