"""Inclusion dependencies, keys and shared dimensions against brute force over all values."""

from __future__ import annotations

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from alloy.operators import inclusion as IN
from alloy.operators import keys as K
from alloy.operators import profile as P
from alloy.plans.q_profile import DISCOVERY_TABLES
from tests.conftest import SF_SMALL


def values(rows, columns):
    return {t for t in (tuple(r[c] for c in columns) for r in rows) if None not in t}


def kinds(df):
    return IN.families(df)


def slow_references(tables, min_conf):
    """Every pair of columns, all values in sets."""
    rows = {n: df.collect() for n, df in tables.items()}
    cols = [(n, c, k) for n, df in tables.items() for c, k in kinds(df).items()]
    names = next(iter(tables.values())).sparkSession.createDataFrame(
        [(a[1], b[1]) for a in cols for b in cols], "a string, b string").distinct()
    like = {(r["a"], r["b"]): r["s"] for r in names.select("a", "b", P.name_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    out = set()
    for (ta, ca, ka), (tb, cb, kb) in itertools.product(cols, cols):
        a, b = values(rows[ta], [ca]), values(rows[tb], [cb])
        if (ta, ca) == (tb, cb) or ka != kb or any(p in ca.upper() for p in P.MEASURE_PARTS) or not a or not b or len(b) < len(rows[tb]):
            continue
        plain = [[x[0] if ka == "i" or len(x[0]) <= 64 else "sha256:" + hashlib.sha256(x[0].encode()).hexdigest() for x in s]
                 for s in (a, b)]
        if min(plain[0]) < min(plain[1]) or max(plain[0]) > max(plain[1]):
            continue
        if like[ca, cb] < 0.5 and len(a) < P.MIN_COVERAGE * len(rows[tb]):
            continue
        shared = len(a & b)
        conf = 0.7 * (shared / len(a)) + 0.3 * like[ca, cb]
        if shared and conf >= min_conf - 5e-5:
            out.add((ta, ca, tb, cb, len(a), shared))
    return out


def edges(df):
    return {(r["source_table"], r["source_column"], r["target_table"], r["target_column"], r["source_distinct"], r["shared_values"])
            for r in df.collect()}


def hard_tables(spark):
    """Long keys, a reference within a table, a hot value, partial containment, NULLs, an empty table."""
    rng = random.Random(4)
    url = "https://a.example/" + "x/" * 40
    pages = spark.createDataFrame([(i, url + str(i)) for i in range(200)], "page_id long, url string")
    # half of all rows refer to one page; one value in ten is unknown
    hits = spark.createDataFrame([(i, url + str(7 if i % 2 else rng.randrange(220)), rng.choice([None, "a", "b"])) for i in range(2000)],
                                 "hit_id long, page_url string, kind string")
    staff = spark.createDataFrame([(i, None if i < 3 else i // 5, f"n{i}") for i in range(300)], "employee_id long, manager_employee_id long, nick string")
    empty = spark.createDataFrame([], "employee_id long, url string")
    return {"pages": pages, "hits": hits, "staff": staff, "empty": empty}


@pytest.mark.parametrize("bits", [12, 5])
def test_references_equal_all_pairs(spark, monkeypatch, bits):
    """Also with sketches that are far smaller than the columns."""
    monkeypatch.setattr(IN, "SKETCH_BITS", bits)
    if bits < 12:  # what six deviations of a small sketch are
        monkeypatch.setattr(IN, "DISTINCT_ERROR", 6 / 2 ** (bits / 2))
        monkeypatch.setattr(P, "DISTINCT_ERROR", 6 / 2 ** (bits / 2))
    tables = hard_tables(spark)
    got = edges(P.discover_fks(tables, 0.6))
    assert got == slow_references(tables, 0.6)
    assert any(e[:4] == ("staff", "manager_employee_id", "staff", "employee_id") for e in got)
    assert any(e[:4] == ("hits", "page_url", "pages", "url") for e in got)


def test_references_of_the_given_tables(spark):
    tables = {n: spark.read.parquet(f"{SF_SMALL}/{n}.parquet") for n in DISCOVERY_TABLES}
    assert edges(P.discover_fks(tables)) == slow_references(tables, P.FK_MIN_CONFIDENCE)


def test_sketches_rule_pairs_out_before_values_move(spark):
    """Disjoint columns of one range do not reach the value shuffle."""
    even = spark.range(0, 40_000, 2).select(F.col("id").alias("even_id"))
    odd = spark.range(1, 40_001, 2).select(F.col("id").alias("odd_id"))
    part = spark.range(0, 30_000, 6).select(F.col("id").alias("part_id"))
    tables = {"even": even, "odd": odd, "part": part}
    groups = [IN.Group("even", ("even_id",)), IN.Group("odd", ("odd_id",)), IN.Group("part", ("part_id",))]
    pairs = IN.candidate_pairs(IN.group_statistics(tables, groups), groups, tables, lambda p: p)
    bound = {(r["a_table"], r["b_table"]): r["bound"] for r in pairs.collect()}
    assert bound["part", "even"] > 0.9 and bound["even", "odd"] < 0.3 and bound["odd", "even"] < 0.3


def test_a_hot_value_is_one_row_per_task(spark):
    df = spark.range(50_000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"))
    pairs = [(IN.Group("a", ("k",)), IN.Group("b", ("k",)))]
    counts = IN.exact_counts({"a": df, "b": df.filter("k < 100")}, pairs)
    n = df.distinct().count()
    assert counts.distinct[pairs[0][0]] == n and counts.shared[pairs[0]] == df.filter("k < 100").distinct().count()
    grouped = IN.value_groups({"a": df}, [IN.Group("a", ("k",))])
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_bit_or") >= 1


def slow_composites(tables, keys):
    rows = {n: df.collect() for n, df in tables.items()}
    out = set()
    for tb, ks in keys.items():
        for key in ks:
            if len(key) < 2:
                continue
            target = values(rows[tb], key)
            for ta, df in tables.items():
                for group in itertools.permutations(kinds(df), len(key)):
                    source = values(rows[ta], group)
                    if (ta, group) != (tb, tuple(key)) and source and source <= target and \
                            [kinds(df)[c] for c in group] == [kinds(tables[tb])[c] for c in key]:
                        out.add((ta, ",".join(group), tb, ",".join(key), len(key), len(source), len(target)))
    return out


def test_composite_references_equal_all_permutations(spark):
    """Keys of two and three columns, also within the key's own table, with NULLs and long texts."""
    rng = random.Random(5)
    long = "p" * 80
    lines = spark.createDataFrame([(o, n, f"{long}{o % 4}", rng.randrange(3)) for o in range(40) for n in range(5)],
                                  "ord long, line long, lot string, grade long")
    notes = spark.createDataFrame([(rng.randrange(40), rng.choice([None, 0, 1, 2]), f"{long}{i % 4}", i) for i in range(300)],
                                  "order_no long, line_no long, lot_no string, note long")
    exact = spark.createDataFrame([(o, n, f"{long}{o % 4}") for o in range(0, 40, 3) for n in range(2)], "a long, b long, c string")
    swapped = spark.createDataFrame([(n, o) for o in range(5) for n in range(4)], "x long, y long")
    tables = {"lines": lines, "notes": notes, "exact": exact, "swapped": swapped}
    keys = {"lines": [("ord", "line"), ("ord", "line", "lot")], "exact": [("a", "b", "c")], "notes": [("note",)]}
    got = {tuple(r) for r in IN.composite_references(spark, tables, keys).collect()}
    assert got == slow_composites(tables, keys)
    assert ("exact", "a,b,c", "lines", "ord,line,lot", 3, 28, 200) in got and any(r[0] == "notes" for r in got)
    assert IN.composite_references(spark, tables, {"notes": [("note",)]}).collect() == []


def test_shared_dimensions(spark):
    stores = spark.createDataFrame([(i, f"prov{i % 9}", f"c{i % 4}") for i in range(200)], "store_id long, province string, category string")
    sales = spark.createDataFrame([(i, f"prov{i % 10}", f"k{i % 4}") for i in range(500)], "sale_id long, store_province string, category string")
    got = IN.shared_dimensions(spark, {"sales": sales, "stores": stores}, P.name_similarity, 0.7, lambda c: ~P.is_measure(F.col(c))).collect()
    assert [(r["table_a"], r["column_a"], r["table_b"], r["column_b"], r["shared_values"], r["all_values"]) for r in got] == \
        [("sales", "store_province", "stores", "province", 9, 10)]


def slow_keys(df, most):
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, K.KEY_TYPES)]
    rows = df.collect()
    found = []
    for n in range(1, most + 1):
        for group in itertools.combinations(cols, n):
            if rows and not any(set(k) <= set(group) for k in found) and len(values(rows, group)) == len(rows):
                found.append(group)
    return {(",".join(k), len(k)) for k in found}


def test_minimal_keys_equal_all_subsets(spark):
    """Three-column keys, keys with NULLs, repeated rows, no rows, and the given tables."""
    rng = random.Random(6)
    cube = [(a, b, c, a * b % 7, rng.random()) for a in range(12) for b in range(10) for c in range(9)]
    tables = {
        "cube": spark.createDataFrame(cube, "a long, b long, c string, d long, e double"),
        "nulls": spark.createDataFrame([(1, 1, None), (1, 2, "x"), (2, 1, "y")], "a long, b long, c string"),
        "twice": spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a long, b string"),
        "none": spark.createDataFrame([], "a long, b string"),
        "measures": spark.createDataFrame([(1.5,), (2.5,)], "x double"),
        "two": spark.createDataFrame([(i % 50, i // 50, i % 7, i) for i in range(2000)], "a long, b long, c long, d long")}
    got = {(r["table_name"], r["key_columns"], r["n_columns"]) for r in K.minimal_keys(tables).collect()}
    assert got == {(n, *k) for n, df in tables.items() for k in slow_keys(df, 3)}
    assert ("cube", "a,b,c", 3) in got and ("two", "a,b", 2) in got
    given = {n: spark.read.parquet(f"{SF_SMALL}/{n}.parquet") for n in ("orders", "lineitem", "conversations", "labels", "nation")}
    got = {(r["table_name"], r["key_columns"], r["n_columns"]) for r in K.minimal_keys(given).collect()}
    assert got == {(n, *k) for n, df in given.items() for k in slow_keys(df, 3)}


def test_one_slice_settles_what_repeats(spark):
    """A set with repeats in the first slice of its tuples is not read whole; one repeat outside it is still found."""
    rows = [(i, i // 2, i) for i in range(4000)]
    hashes = spark.createDataFrame(rows, "a long, half long, late long").select("late", F.pmod(F.xxhash64("late"), F.lit(K.SLICES)).alias("s"))
    outside = next(r["late"] for r in hashes.collect() if r["s"] != 0)
    tables = {"t": spark.createDataFrame([*rows[:-1], (3999, 1999, outside)], "a long, half long, late long")}
    seen, real = [], K._repeated

    def watched(tables, sets, which):
        seen.append(list(sets))
        return real(tables, sets, which)

    K._repeated = watched
    try:
        assert K.repeated(tables, [("t", ("a",)), ("t", ("half",)), ("t", ("late",))]) == {("t", ("half",)), ("t", ("late",))}
    finally:
        K._repeated = real
    assert seen == [[("t", ("a",)), ("t", ("half",)), ("t", ("late",))], [("t", ("a",)), ("t", ("late",))]]


def test_key_pairs_are_decided_by_slices_and_the_profile_is_made_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(i // 3, i % 3, None if i % 2 else 1) for i in range(300)], "a_id long, b long, c long")
    prof = P.profile_tables({"t": df}, exact=True)
    watched = prof.mapInArrow(count, prof.schema)
    monkeypatch.setattr(P, "repeated", lambda tables, sets: K.repeated(tables, sets))
    (got,) = P.pk_candidates(watched, {"t": df}).collect()
    assert (got["pk_column"], got["uniqueness"], got["is_unique"]) == ("a_id,b", 1.0, True)
    once = made.value
    P.pk_candidates(watched).collect()
    assert once == made.value - once


def test_derived_supply_tables_are_made_once(spark):
    from alloy.plans.q_profile import supply_tables
    for name, df in supply_tables(spark, "/root/testdata/sf0.001").items():
        assert "Aggregate" not in df._jdf.queryExecution().toString(), name


def test_left_joins_of_a_large_snowflake(spark, monkeypatch):
    """The large dimension of a large dimension is joined there; rows are those of the plain chain."""
    from alloy.operators import joins as J
    monkeypatch.setattr(J, "is_small", lambda dim: "p_name" in dim.columns)
    fact = spark.createDataFrame([(1, 1, 5), (2, 2, 6), (3, None, 5), (4, 9, None), (5, 1, 7)], "f long, a_ref long, p_ref long")
    a = spark.createDataFrame([(1, 10, "x"), (1, 11, "y"), (2, None, "z"), (None, 10, "n")], "a_id long, b_ref long, a_name string")
    b = spark.createDataFrame([(10, "b10"), (10, "again"), (None, "none")], "b_id long, b_name string")
    p = spark.createDataFrame([(5, "five"), (6, "six"), (None, "none")], "p_id long, p_name string")
    dims = [(a, J.Edge("a_ref", "a_id")), (p, J.Edge("p_ref", "p_id")), (b, J.Edge("b_ref", "b_id"))]
    got, want = J.enrich(fact, dims), J._chain(fact, dims, "left")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    lines = got._jdf.queryExecution().analyzed().toString().splitlines()
    depth = {key: next(x.index("Join") for x in lines if "Join" in x and key in x) for key in ("b_id", "a_id", "p_id")}
    assert depth["b_id"] > depth["a_id"] > depth["p_id"]
