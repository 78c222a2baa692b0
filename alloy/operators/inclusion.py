"""Inclusion dependencies between column groups: mergeable sketches first, values last.

A *group* is one or more columns of a table; its values are the tuples without a NULL.
``group_statistics`` reads each table once and gives one row per group: rows, extremes and a
theta sketch of the distinct values (merged from partial sketches per task). Two sketches bound
the containment of one group in another; a pair that cannot reach the containment asked for is
dropped before any value moves. What is left is decided exactly by one shuffle of the
surviving groups' values (integers as integers, texts above MAX_PLAIN_CHARS as SHA-256): each
value becomes one row with the set of groups that hold it, so no value, however frequent, meets
itself, and the number of values per set gives distinct and shared counts of all pairs at once.

On that stand ``references`` (one column in a unique one, self-references included),
``composite_references`` (several columns in a key of several, grown level by level from
single columns) and ``shared_dimensions`` (two columns, neither unique, with like values).

The bound. Where sketches sample, a pair with containment c shows, among m sampled values, a
share below c - sqrt(ln(1e9) / 2m) with probability 1e-9 at most (Hoeffding), and a sketch
of 4,096 entries misses a distinct count by more than DISTINCT_ERROR (six deviations) about
once in 1e9: that is how often a pair is lost. Sketches of up to 4,096 values are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alloy.functions.columns import canonical_row
from alloy.session import cut_lineage

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: texts above this length are compared by digest
MAX_PLAIN_CHARS = 64
DIGEST_MARK = "sha256:"
#: entries of a sketch, as a power of two
SKETCH_BITS = 12
DISTINCT_ERROR = 0.1
#: partial sketches of a table are merged in so many groups before the last step
MERGE_GROUPS = 64


class Group(NamedTuple):
    table: str
    columns: tuple[str, ...]


def plain_text(c: Column) -> Column:
    """A text, or its marked digest if it is long: equal texts have equal results."""
    return F.when(F.length(c) <= MAX_PLAIN_CHARS, c).otherwise(F.concat(F.lit(DIGEST_MARK), F.sha2(c, 256)))


def families(df: DataFrame) -> dict[str, str]:
    """Columns that may hold keys, and what they are compared as: integer or text."""
    return {f.name: "i" if isinstance(f.dataType, INTEGRAL) else "s" for f in df.schema.fields
            if isinstance(f.dataType, (*INTEGRAL, T.StringType))}


def family(tables: dict[str, DataFrame], group: Group) -> str:
    kinds = families(tables[group.table])
    return "".join(kinds[c] for c in group.columns)


def _value(df: DataFrame, group: Group) -> tuple[Column, Column]:
    """(integer, text) of a group's value; one of them is NULL, both if a column is."""
    kinds = families(df)
    if len(group.columns) == 1:
        (c,) = group.columns
        return ((F.col(c).cast("long"), F.lit(None).cast("string")) if kinds[c] == "i"
                else (F.lit(None).cast("long"), plain_text(F.col(c))))
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in group.columns])
    return F.lit(None).cast("long"), F.when(whole, plain_text(canonical_row(df, group.columns)))


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _by_table(groups: Sequence[Group]) -> dict[str, list[tuple[int, Group]]]:
    out: dict[str, list[tuple[int, Group]]] = {}
    for i, g in enumerate(groups):
        out.setdefault(g.table, []).append((i, g))
    return out



def group_statistics(tables: dict[str, DataFrame], groups: Sequence[Group]) -> DataFrame:
    """One row per group (``id``: its place): rows of the table, non-NULL values, extremes, sketch and
    the distinct count it estimates. One scan per table; kept (reliable checkpoint)."""
    def of(table: str, members: list[tuple[int, Group]]) -> DataFrame:
        df = tables[table]
        partial: list[Column] = [F.count(F.lit(1)).alias("rows")]
        merged: list[Column] = [F.sum("rows").alias("rows")]
        # each value is made once, digests above all
        values = []
        for i, g in members:
            number, text = _value(df, g)
            values.append((number if family(tables, g) == "i" else text).alias(f"v{i}"))
        for i, _ in members:
            value = F.col(f"v{i}")
            partial += [F.count(value).alias(f"n{i}"), F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}"),
                        F.theta_sketch_agg(value, SKETCH_BITS).alias(f"k{i}")]
            merged += [F.sum(f"n{i}").alias(f"n{i}"), F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}"),
                       F.theta_union_agg(f"k{i}", SKETCH_BITS).alias(f"k{i}")]
        step = df.select(*values).groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("_part")).agg(*partial)
        one = step.agg(*merged)

        def row(i: int, g: Group) -> Column:
            integer = family(tables, g) == "i"
            none = F.lit(None)
            low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
            return F.struct(F.lit(i).alias("id"), F.coalesce("rows", F.lit(0).cast("long")).alias("table_rows"),
                            F.coalesce(f"n{i}", F.lit(0).cast("long")).alias("n_values"),
                            (low if integer else none.cast("long")).alias("imin"), (high if integer else none.cast("long")).alias("imax"),
                            (none.cast("string") if integer else low).alias("smin"), (none.cast("string") if integer else high).alias("smax"),
                            F.col(f"k{i}").alias("sketch"), F.theta_sketch_estimate(f"k{i}").alias("estimate"))

        return one.select(F.inline(F.array(*[row(i, g) for i, g in members])))

    return cut_lineage(_union(of(table, members) for table, members in _by_table(groups).items()))


def containment_bound(estimate: Column, other: Column, both: Column) -> Column:
    """The largest containment of a group with ``estimate`` values in one with ``other`` that the
    estimate ``both`` of their common values leaves possible (see the module's head)."""
    entries = float(1 << SKETCH_BITS)
    largest = F.greatest(estimate, other).cast("double")
    share = both.cast("double") / estimate.cast("double")
    sampled = estimate.cast("double") * F.least(F.lit(1.0), F.lit(entries) / largest)
    wide = share * (1 + DISTINCT_ERROR) + F.sqrt(F.lit(math.log(1e9) / 2) / sampled)
    return F.when(largest < entries, share).otherwise(wide)


#: bits of a word of the masks that tell which groups hold a value
WORD = 62


def value_groups(tables: dict[str, DataFrame], groups: Sequence[Group]) -> DataFrame:
    """``ids, n``: which groups hold a value, and of how many distinct values of all ``groups`` that
    is so. A value's groups are bits of a few whole numbers, OR-ed map-side by a hash
    aggregate, so a frequent value is one row per task when it is shuffled."""
    words = range(-(-len(groups) // WORD))

    def of(i: int, g: Group) -> DataFrame:
        number, text = _value(tables[g.table], g)
        masks = [F.lit(1 << i % WORD if i // WORD == w else 0).cast("long").alias(f"m{w}") for w in words]
        rows = tables[g.table].select(F.lit(family(tables, g)).alias("family"), number.alias("i"), text.alias("s"), *masks)
        return rows.filter(F.col("i").isNotNull() | F.col("s").isNotNull())

    names = [f"m{w}" for w in words]
    values = _union(of(i, g) for i, g in enumerate(groups)).groupBy("family", "i", "s").agg(*[F.bit_or(m).alias(m) for m in names])
    kinds = values.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    held = [F.when(F.col(f"m{i // WORD}").bitwiseAND(F.lit(1 << i % WORD).cast("long")) != 0, F.lit(i)) for i in range(len(groups))]
    return kinds.select(F.array_compact(F.array(*held)).alias("ids"), "n")


class Counts(NamedTuple):
    """Exact numbers of distinct values by group, and of shared ones by pair."""
    distinct: dict[Group, int]
    shared: dict[tuple[Group, Group], int]


def exact_counts(tables: dict[str, DataFrame], pairs: Sequence[tuple[Group, Group]]) -> Counts:
    """Of the groups in ``pairs``, by one shuffle of their values; one number per group and pair
    reaches the driver."""
    groups = sorted({g for pair in pairs for g in pair})
    if not groups:
        return Counts({}, {})
    place = {g: i for i, g in enumerate(groups)}
    spark = next(iter(tables.values())).sparkSession
    wanted: dict[int, list[int]] = {}
    for a, b in pairs:
        wanted.setdefault(place[a], []).append(place[b])
    # a group is its own partner too: that counts its distinct values
    partners = spark.createDataFrame([(i, [i, *wanted.get(i, [])]) for i in range(len(groups))], "id int, partners array<int>")
    holders = value_groups(tables, groups).select(F.explode("ids").alias("id"), "ids", "n")
    met = (holders.join(F.broadcast(partners), "id").select("id", F.explode(F.array_intersect("ids", "partners")).alias("other"), "n")
           .groupBy("id", "other").agg(F.sum("n").alias("n")))
    found = {(r["id"], r["other"]): r["n"] for r in met.collect()}
    return Counts({g: found.get((i, i), 0) for g, i in place.items()},
                  {(a, b): found.get((place[a], place[b]), 0) for a, b in pairs})


def candidate_pairs(stats: DataFrame, groups: Sequence[Group], tables: dict[str, DataFrame],
                    choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs ``a``, ``b`` of different groups of one family (``a_*``, ``b_*``: their names and
    statistics) that ``choose`` keeps, with ``bound``: how much of a may lie in b. Sketches are
    joined to chosen pairs only."""
    spark = stats.sparkSession
    names = spark.createDataFrame([(i, g.table, ",".join(g.columns), family(tables, g)) for i, g in enumerate(groups)],
                                  "id int, table string, columns string, family string")
    known = stats.join(F.broadcast(names), "id")

    def side(name: str) -> DataFrame:
        return known.drop("sketch").select("family", *[F.col(c).alias(f"{name}_{c}") for c in known.columns if c not in ("family", "sketch")])

    pairs = side("a").join(side("b"), "family").filter(F.col("a_id") != F.col("b_id")).filter((F.col("a_n_values") > 0) & (F.col("b_n_values") > 0))
    pairs = choose(pairs)
    for name in ("a", "b"):
        pairs = pairs.join(stats.select(F.col("id").alias(f"{name}_id"), F.col("sketch").alias(f"{name}_sketch")), f"{name}_id")
    both = F.theta_sketch_estimate(F.theta_intersection("a_sketch", "b_sketch"))
    return (pairs.withColumn("both", both).withColumn("bound", containment_bound(F.col("a_estimate"), F.col("b_estimate"), F.col("both")))
            .drop("a_sketch", "b_sketch"))


def within_extremes() -> Column:
    """All of a lies between the least and the greatest value of b."""
    integer = (F.col("a_imin") >= F.col("b_imin")) & (F.col("a_imax") <= F.col("b_imax"))
    text = (F.col("a_smin") >= F.col("b_smin")) & (F.col("a_smax") <= F.col("b_smax"))
    return F.when(F.col("a_imin").isNotNull(), integer).otherwise(text)


def may_be_unique(side: str) -> Column:
    """No NULL, and as many distinct values as rows as far as the sketch can tell."""
    rows, estimate = F.col(f"{side}_table_rows"), F.col(f"{side}_estimate")
    near = F.when(rows < (1 << SKETCH_BITS), estimate == rows).otherwise(estimate >= rows * (1 - DISTINCT_ERROR))
    return (F.col(f"{side}_n_values") == rows) & near


# ---- one column in a unique one ------------------------------------------------------
class Reference(NamedTuple):
    source: Group
    target: Group
    source_rows: int
    target_rows: int
    source_distinct: int
    shared_values: int


def references(tables: dict[str, DataFrame], source_ok: Callable[[str], Column], least_containment: Callable[[], Column],
               worth: Callable[[], Column]) -> list[Reference]:
    """Pairs of columns whose target is unique and that share a value: sources whose name
    ``source_ok`` takes, pairs that ``worth`` takes and whose containment may reach
    ``least_containment`` (both over ``a_columns``, ``b_columns``, ``a_estimate``,
    ``b_table_rows``). Columns of one table refer to each other as those of two do."""
    groups = [Group(t, (c,)) for t, df in tables.items() for c in families(df)]
    if not groups:
        return []
    stats = group_statistics(tables, groups)
    pairs = candidate_pairs(stats, groups, tables, lambda p: p.filter(
        source_ok("a_columns") & may_be_unique("b") & within_extremes() & worth()))
    rows = pairs.filter(F.col("bound") >= least_containment()).select("a_id", "b_id", "a_table_rows", "b_table_rows", "b_n_values").collect()
    counts = exact_counts(tables, [(groups[r["a_id"]], groups[r["b_id"]]) for r in rows])
    out = []
    for r in rows:
        a, b = groups[r["a_id"]], groups[r["b_id"]]
        if counts.distinct[b] == r["b_table_rows"] and counts.shared[a, b]:
            out.append(Reference(a, b, r["a_table_rows"], r["b_table_rows"], counts.distinct[a], counts.shared[a, b]))
    return out


# ---- several columns in a key of several ---------------------------------------------
COMPOSITE = ("source_table string, source_columns string, target_table string, target_columns string, n_columns int, "
             "source_distinct long, target_distinct long")


def composite_references(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, Sequence[tuple[str, ...]]],
                         source_ok: Callable[[str], bool] = lambda c: True) -> DataFrame:
    """Groups of columns whose every tuple is a tuple of a key of two or more columns.

    ``keys`` holds the keys of each table. Level 1 are the single columns that lie in a key's
    column altogether; each level adds the next column of the key to the groups that still lie
    in it, so a group is only read if all it grew from did. Sources need distinct columns that
    ``source_ok`` takes; a group never refers to itself."""
    targets = [Group(t, tuple(k)) for t, ks in keys.items() for k in ks if len(k) > 1]
    singles = [Group(t, (c,)) for t, df in tables.items() for c in families(df)]
    parts = sorted({Group(k.table, (c,)) for k in targets for c in k.columns})
    unary = _included(tables, [(a, b) for b in parts for a in singles if a != b and source_ok(a.columns[0])])
    sources = {b: [b, *(a for a, other in unary if other == b)] for b in parts}
    out: list[tuple] = []
    # groups that so far lie in the first columns of a key, with that key
    alive = [(a, k) for k in targets for a in sources[Group(k.table, k.columns[:1])]]
    for size in range(2, max((len(k.columns) for k in targets), default=1) + 1):
        grown = [(Group(a.table, (*a.columns, b.columns[0])), k) for a, k in alive if len(k.columns) >= size
                 for b in sources[Group(k.table, (k.columns[size - 1],))] if b.table == a.table and b.columns[0] not in a.columns]
        first = {k: Group(k.table, k.columns[:size]) for _, k in grown}
        found = _included(tables, [(a, first[k]) for a, k in grown if a != first[k]])
        alive = [(a, k) for a, k in grown if a == first[k] or (a, first[k]) in found]
        out += [(a.table, ",".join(a.columns), k.table, ",".join(k.columns), size, *found[a, k])
                for a, k in alive if len(k.columns) == size and a != k]
    return spark.createDataFrame(sorted(out), COMPOSITE)


def _included(tables: dict[str, DataFrame], pairs: Sequence[tuple[Group, Group]]) -> dict[tuple[Group, Group], tuple[int, int]]:
    """The pairs whose first group lies in the second altogether, with both distinct counts."""
    pairs = [(a, b) for a, b in pairs if family(tables, a) == family(tables, b)]
    groups = sorted({g for p in pairs for g in p})
    if not groups:
        return {}
    place = {g: i for i, g in enumerate(groups)}
    spark = tables[groups[0].table].sparkSession
    wanted = spark.createDataFrame(sorted({(place[a], place[b]) for a, b in pairs}), "a_id int, b_id int")
    near = candidate_pairs(group_statistics(tables, groups), groups, tables,
                           lambda p: p.join(F.broadcast(wanted), ["a_id", "b_id"], "left_semi").filter(within_extremes()))
    chosen = [(groups[r["a_id"]], groups[r["b_id"]]) for r in near.filter("bound >= 1").select("a_id", "b_id").collect()]
    counts = exact_counts(tables, chosen)
    return {(a, b): (counts.distinct[a], counts.distinct[b]) for a, b in chosen if counts.shared[a, b] == counts.distinct[a]}


# ---- two columns with like values ----------------------------------------------------
SHARED = ("table_a string, column_a string, table_b string, column_b string, shared_values long, all_values long, likeness double, "
          "name_similarity double, confidence double")


def shared_dimensions(spark: SparkSession, tables: dict[str, DataFrame], similarity: Callable[[Column, Column], Column],
                      min_conf: float, column_ok: Callable[[str], Column]) -> DataFrame:
    """Pairs of columns of two tables, neither unique, whose value sets are alike:
    ``confidence`` = 0.7 * likeness (shared values over all values) + 0.3 * name similarity, from
    ``min_conf`` on. Each pair once, the lesser table name first."""
    groups = [Group(t, (c,)) for t, df in tables.items() for c in families(df)]
    if not groups:
        return spark.createDataFrame([], SHARED)
    stats = group_statistics(tables, groups)
    alike = similarity(F.col("a_columns"), F.col("b_columns"))
    pairs = candidate_pairs(stats, groups, tables, lambda p: p.filter(
        (F.col("a_table") < F.col("b_table")) & column_ok("a_columns") & column_ok("b_columns")).withColumn("name_similarity", alike))
    # a likeness of x needs a containment of x on either side
    least = (F.lit(min_conf - 1e-4) - 0.3 * F.col("name_similarity")) / 0.7
    back = containment_bound(F.col("b_estimate"), F.col("a_estimate"), F.col("both"))
    rows = pairs.filter((F.col("bound") >= least) & (back >= least)).select("a_id", "b_id", "a_table_rows", "b_table_rows", "name_similarity").collect()
    counts = exact_counts(tables, [(groups[r["a_id"]], groups[r["b_id"]]) for r in rows])
    out = []
    for r in rows:
        a, b = groups[r["a_id"]], groups[r["b_id"]]
        shared = counts.shared[a, b]
        if counts.distinct[a] < r["a_table_rows"] and counts.distinct[b] < r["b_table_rows"]:
            out.append((a.table, a.columns[0], b.table, b.columns[0], shared, counts.distinct[a] + counts.distinct[b] - shared, r["name_similarity"]))
    likeness = F.col("shared_values").cast("double") / F.col("all_values").cast("double")
    found = spark.createDataFrame(out, "table_a string, column_a string, table_b string, column_b string, shared_values long, all_values long, "
                                       "name_similarity double")
    return (found.withColumn("confidence", F.round(F.lit(0.7) * likeness + F.lit(0.3) * F.col("name_similarity"), 4))
            .withColumn("likeness", F.round(likeness, 4)).filter(F.col("confidence") >= min_conf)
            .select(*[c.split()[0] for c in SHARED.split(", ")]))
