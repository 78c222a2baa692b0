"""LIKE rules matched through an index on their literals.

The longest literal piece of a pattern, cut to ``GRAM`` characters, must occur in every value
that the pattern matches. So each rule has one key (length, gram), the distinct values are cut
into their grams of the lengths that occur (at most GRAM of them), rules and values meet in an
equi-join, and only those pairs are tested with LIKE. Patterns without a literal (``%``, ``_%``)
ask for a length only: they are reduced to it, and each distinct one meets the values apart. Work
grows with the values and the pairs that share a gram, not with values times rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloy.session import broadcast_if_small

GRAM = 8


def pieces(pattern: Column) -> Column:
    """The literal pieces of a LIKE pattern, its escapes (a backslash before ``%``, ``_`` or itself)
    resolved."""
    # escaped characters become private ones, the wildcards one separator
    hidden = pattern
    for escaped, held in ((r"\\\\", "\ue000"), (r"\\%", "\ue001"), (r"\\_", "\ue002")):
        hidden = F.regexp_replace(hidden, escaped, held)
    return F.transform(F.split(F.translate(hidden, "_", "%"), "%"), lambda p: F.translate(p, "\ue000\ue001\ue002", "\\%_"))


def longest(pattern: Column) -> Column:
    """The longest literal piece (the first of equal ones), '' if there is none."""
    return F.aggregate(pieces(pattern), F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))


def grams(value: Column, lengths: Sequence[int]) -> Column:
    """All (length, gram) of a value, each once."""
    def of(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(value) - n + 1),
                          lambda i: F.struct(F.lit(n).alias("n"), F.substr(value, i, F.lit(n)).alias("gram")))
        return F.when(F.length(value) >= n, cut).otherwise(F.array().cast("array<struct<n:int,gram:string>>"))

    each = [of(n) for n in lengths]
    return F.array_distinct(F.flatten(F.array(*each)))


def matching_values(values: DataFrame, rules: DataFrame, value_col: str, pattern_col: str) -> DataFrame:
    """``value, pattern``: which distinct values match which distinct patterns."""
    values = values.select(F.col(value_col).alias("value")).filter(F.col("value").isNotNull()).distinct()
    patterns = rules.select(F.col(pattern_col).alias("pattern")).filter(F.col("pattern").isNotNull()).distinct()
    patterns = patterns.withColumn("gram", F.left(longest(F.col("pattern")), F.lit(GRAM))).withColumn("n", F.length("gram"))
    # the lengths that occur, at most GRAM numbers
    lengths = sorted(r["n"] for r in patterns.filter("n > 0").select("n").distinct().collect())
    keyed = patterns.filter("n > 0")
    cut = values.select("value", F.explode(grams(F.col("value"), lengths)).alias("g")).select("value", "g.*") if lengths else \
        values.select("value", F.lit(0).alias("n"), F.lit("").alias("gram")).filter(F.lit(False))
    found = cut.join(broadcast_if_small(keyed), ["n", "gram"]).filter(F.expr("value LIKE pattern")).select("value", "pattern")
    # a pattern of wildcards asks for a length: exactly so many characters, or at least
    wild = patterns.filter("n = 0").select("pattern", F.length(F.regexp_replace("pattern", "[^_]", "")).alias("least"),
                                           F.contains("pattern", F.lit("%")).alias("more"))
    kinds = wild.groupBy("least", "more").agg(F.collect_set("pattern").alias("patterns"))
    size = F.length("value")
    plain = values.join(broadcast_if_small(kinds), F.when(F.col("more"), size >= F.col("least")).otherwise(size == F.col("least")))
    return found.unionByName(plain.select("value", F.explode("patterns").alias("pattern")))


def match_rules_indexed(df: DataFrame, rules: DataFrame, value_cols: Sequence[str], layer: str | None = None,
                        pattern_col: str = "pattern", layer_col: str = "layer") -> DataFrame:
    """As ``joins.match_rules``, for any number of rules: each row with each rule that one of its
    values matches. Values are matched once however many rows hold them; NULLs match nothing."""
    if layer is not None:
        rules = rules.filter(F.upper(F.col(layer_col)).isin(layer.upper(), "BOTH"))
    rules = rules.withColumn("_rule", F.monotonically_increasing_id())
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    held = rows.select("_row", F.explode(F.array_distinct(F.array(*[F.col(c).cast("string") for c in value_cols]))).alias("value"))
    matched = matching_values(held, rules, "value", pattern_col)
    pairs = (held.join(matched, "value").join(broadcast_if_small(rules.select("_rule", F.col(pattern_col).alias("pattern"))), "pattern")
             .select("_row", "_rule").distinct())
    return rows.join(pairs, "_row").join(broadcast_if_small(rules), "_rule").select(*df.columns, *[c for c in rules.columns if c != "_rule"])
