"""Z-order layout, routed files, digest tree, pattern index, mergeable profiles, composed batches."""

from __future__ import annotations

import glob
import random
import re
import tempfile

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alloy.operators import batching, features, setops
from alloy.operators import digest_tree as DT
from alloy.operators import documents as D
from alloy.operators import pattern_index as PI
from alloy.operators import profile_sketches as PS
from alloy.operators import telemetry as TM
from alloy.operators.dedup import Order
from alloy.sources import writers
from tests.conftest import SF_SMALL


@pytest.fixture()
def tmp(spark):
    return tempfile.mkdtemp(prefix="alloy-test-")


# ---- layout ------------------------------------------------------------------------------
def groups_read(path, column, low, high):
    """Row groups whose extremes meet [low, high], and all of them."""
    read = total = 0
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        at = meta.schema.names.index(column)
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            total += 1
            read += stats is not None and stats.has_min_max and stats.max >= low and stats.min <= high
    return read, total


def test_interleaved_layout_skips_on_either_column(spark, tmp):
    df = spark.range(40_000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5000)).alias("b"), "id")
    writers.write_clustered(df, f"{tmp}/one", None, ["a", "b"], 16)
    writers.write_interleaved(df, f"{tmp}/both", ["a", "b"], 16)
    assert sorted(spark.read.parquet(f"{tmp}/both").collect()) == sorted(df.collect())
    a, b = ("a", 300, 340), ("b", 2000, 2100)
    before = [groups_read(f"{tmp}/one", *x) for x in (a, b)]
    after = [groups_read(f"{tmp}/both", *x) for x in (a, b)]
    assert before[1] == (16, 16)                       # sorted by a: a filter on b reads everything
    assert all(read <= 10 and total == 16 for read, total in after), after


def test_interleaved_with_texts_nulls_and_a_hot_value(spark, tmp):
    rows = [(None if i % 10 == 0 else f"k{7 if i % 3 else i:05d}", None if i % 7 == 0 else float(i % 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, x double, id long")
    writers.write_interleaved(df, f"{tmp}/z", ["k", "x"], 8)
    assert sorted(spark.read.parquet(f"{tmp}/z").collect(), key=repr) == sorted(df.collect(), key=repr)
    writers.write_interleaved(df.limit(0), f"{tmp}/none", ["k", "x"], 8)
    assert spark.read.parquet(f"{tmp}/none").count() == 0


def test_routed_files_follow_the_rows(spark, tmp):
    df = spark.range(10_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("small").alias("gold_table"), "id")
    writers.write_routed(df, f"{tmp}/r", rows_per_file=1000)
    files = {t: len(glob.glob(f"{tmp}/r/gold_table={t}/*.parquet")) for t in ("hot", "small")}
    assert 5 <= files["hot"] <= 9 and files["small"] == 1 and spark.read.parquet(f"{tmp}/r").count() == 10_000


# ---- changes -----------------------------------------------------------------------------
def test_changed_keys_equal_full_comparison(spark):
    rng = random.Random(2)
    old = [(k, f"v{rng.randrange(5)}", rng.choice([None, 1.0])) for k in [*range(-500, 3000), 7, 7, None, None]]
    new = [r for r in old if r[0] is None or r[0] % 401] + [(9001, "x", None), (7, "again", 1.0), (None, "late", None)]
    new = [(k, "changed" if k in (5, 1500, -3) else v, x) for k, v, x in new]
    a, b = (spark.createDataFrame(x, "k long, v string, x double") for x in (old, new))

    def by_key(rows):
        out = {}
        for k, v, x in rows:
            out.setdefault(k, []).append((v, x))
        return {k: sorted(v, key=repr) for k, v in out.items()}

    x, y = by_key(old), by_key(new)
    want = {(k, "ADDED" if k not in x else "REMOVED" if k not in y else "CHANGED") for k in x.keys() | y.keys() if x.get(k) != y.get(k)}
    assert {tuple(r) for r in DT.changed_keys(a, b, "k", 64).collect()} == want
    assert {tuple(r) for r in DT.changed_keys(a, b.select("x", "v", "k"), "k", 64, DT.leaves(a, "k", 64).checkpoint()).collect()} == want
    assert DT.changed_keys(a, a.repartition(7), "k", 64).collect() == []
    empty = a.limit(0)
    assert {r["status"] for r in DT.changed_keys(empty, b, "k", 64).collect()} == {"ADDED"} and DT.changed_keys(empty, empty, "k").collect() == []


def test_few_ranges_are_read(spark, tmp):
    spark.range(100_000).withColumn("v", F.col("id") % 13).write.parquet(f"{tmp}/old")
    old = spark.read.parquet(f"{tmp}/old")
    new = old.withColumn("v", F.when(F.col("id").isin(17, 60_000), -1).otherwise(F.col("v")))
    assert DT.differing_nodes(DT.leaves(old, "id", 512), DT.leaves(new, "id", 512)).count() == 2
    plan = old.filter(DT.within("id", 512, [1, 2 * (60_000 // 512) + 1]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan


# ---- rules -------------------------------------------------------------------------------
def like(pattern, value):
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        i += 1
    return re.fullmatch(out, value, re.DOTALL) is not None


def test_indexed_rules_equal_all_pairs(spark):
    """Escapes, wildcards only, the empty pattern, NULLs, repeated rules and rows, a hot value."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gam%ma", "de_lta", "back\\slash", "é한", "x", "longer literal than a gram", ""]
    values = [" ".join(rng.choices(words, k=rng.randint(0, 3))) for _ in range(120)]
    rows = [(i, values[0] if i % 2 else rng.choice(values), None if i % 5 == 0 else rng.choice(values)) for i in range(200)] + [(1, values[0], None)]
    patterns = ["%", "", "_", "___%", "%_", "alpha%", "%beta", "%gam\\%ma%", "%de\\_lta%", "de_lta", "%back\\\\slash%", "%a%b%", "%literal than a gram%", "%한",
                "longer%gram", "_lpha", "nothing", "%x", None, "alpha%"]
    rules = [(p, ["SILVER", "BOTH", "GOLD"][i % 3], f"r{i}") for i, p in enumerate(patterns)]
    df, r = spark.createDataFrame(rows, "id long, a string, b string"), spark.createDataFrame(rules, "pattern string, layer string, rule string")
    got = sorted((x["id"], x["a"], x["rule"]) for x in PI.match_rules_indexed(df, r, ["a", "b"], "SILVER").collect())
    want = sorted((i, a, rule) for i, a, b in rows for p, layer, rule in rules
                  if layer != "GOLD" and p is not None and any(v is not None and like(p, v) for v in (a, b)))
    assert got == want and len({x[2] for x in got}) > 8
    plan = PI.match_rules_indexed(df, r, ["a"])._jdf.queryExecution().optimizedPlan().toString()
    assert "LIKE" in plan
    assert PI.match_rules_indexed(df, r.limit(0), ["a", "b"]).collect() == []


# ---- profiles ----------------------------------------------------------------------------
def test_merged_profiles_hold_their_bounds(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["d1", "d2", None]), rng.randrange(5000), rng.choice(["", "hot", "hot", f"w{rng.randrange(900)}", None]), rng.gauss(0, 1))
            for _ in range(20_000)]
    df = spark.createDataFrame(rows, "day string, n long, w string, x double")
    parts = PS.profile_parts(df, F.col("day"))
    got = {r["column_name"]: r for r in PS.estimates(PS.merged(parts), (0.1, 0.5)).collect()}
    assert got["n"]["n_rows"] == 20_000 and got["w"]["n_nulls"] == sum(r[2] is None for r in rows) and got["w"]["n_empty"] == sum(r[2] == "" for r in rows)
    for i, c in enumerate(df.columns):
        exact = len({r[i] for r in rows} - {None})
        assert abs(got[c]["n_distinct"] - exact) <= 0.098 * exact + 1
    for c, i in (("n", 1), ("x", 3)):
        values = np.array([r[i] for r in rows])
        for q, share in (("q10", 0.1), ("q50", 0.5)):
            assert (values < got[c][q]).mean() <= share + 0.02 and (values <= got[c][q]).mean() >= share - 0.02
        assert (got[c]["min_value"], got[c]["max_value"]) == (values.min(), values.max())
    hot = sum(r[2] == "hot" for r in rows)
    assert hot - len(rows) / PS.TOP <= got["w"]["top"]["hot"] <= hot
    # one day after the other, merged at the end, is all at once
    days = [PS.merged(PS.profile_parts(df.filter(F.col("day").eqNullSafe(d)), F.col("day")), str(d)) for d in ("d1", "d2", None)]
    late = {r["column_name"]: r for r in PS.estimates(PS.merged(days[0].unionByName(days[1]).unionByName(days[2])), (0.1, 0.5)).collect()}
    assert all(late[c]["n_distinct"] == got[c]["n_distinct"] and late[c]["n_rows"] == 20_000 for c in df.columns)
    assert PS.merged(PS.profile_parts(df.limit(0), F.col("day"))).collect() == []


# ---- batches -----------------------------------------------------------------------------
def slow_batches(tokens, room):
    out, batch, fill = [], -1, None
    for t in tokens:
        if fill is None or fill + t > room:
            batch, fill = batch + 1, t
        else:
            fill += t
        out.append(batch)
    return out


@given(st.lists(st.one_of(st.integers(0, 60), st.sampled_from([0, 0, 100, 101, 250])), max_size=80), st.lists(st.integers(1, 9), min_size=1, max_size=20),
       st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_composed_tables_equal_the_fold(tokens, cuts, run):
    """Whatever the blocks and the runs of blocks."""
    room, blocks, at, i = 100, [], 0, 0
    while at < len(tokens):
        blocks.append(np.array(tokens[at:at + cuts[i % len(cuts)]], np.int64))
        at, i = at + cuts[i % len(cuts)], i + 1
    tables = [batching.block_table(b, room) for b in blocks]
    runs = []
    for j in range(0, len(tables), run):
        whole = tables[j]
        for more in tables[j + 1:j + run]:
            whole = batching.composed(whole, more)
        runs.append(whole)
    got, fill, batch = [], batching.UNOPENED, -1
    for j, whole in enumerate(runs):
        inner, number = fill, batch
        for b, table in zip(blocks[j * run:(j + 1) * run], tables[j * run:(j + 1) * run], strict=True):
            got += batching.numbers(b, inner, number, room).tolist()
            more, inner = table.after(inner)
            number += more
        more, fill = whole.after(fill)
        batch += more
        assert (fill, batch) == (inner, number)
    assert got == slow_batches(tokens, room)


def test_batches_of_a_hot_group_with_zeros(spark):
    rng = random.Random(8)
    rows = [("hot" if i % 10 else None, i, rng.choice([None, 0, 0, 50, 300, 5200, 6000]), f"t{i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, o long, n long, txt string")
    got = {r["o"]: (r["batch_no"], r["txt"], r["batch_tokens"]) for r in D.pack_batches(df, "g", "o", tokens_col="n", block_width=64).collect()}
    for g in ("hot", None):
        own = [r for r in rows if r[0] == g]
        batches = slow_batches([r[2] or 0 for r in own], 5100)
        total = {b: 900 + sum(r[2] or 0 for r, x in zip(own, batches, strict=True) if x == b) for b in set(batches)}
        assert [got[r[1]] for r in own] == [(b, r[3], total[b]) for r, b in zip(own, batches, strict=True)]


def test_batches_of_many_small_and_sparse_groups(spark):
    """Groups whose order numbers lie far apart: no group or block of its own costs a call."""
    rng = random.Random(11)
    rows = [(f"g{rng.randrange(300)}", i * 5000 + 17, rng.choice([None, 0, 40, 700, 5200])) for i in range(3000)]
    rows += [("sparse", 10**12 + i * 999, rng.choice([0, 40, 700, 5200])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long, n long")
    small = D.pack_batches(df.filter("g != 'sparse'"), "g", "o", tokens_col="n", block_width=64)
    assert "FlatMapGroups" not in small._jdf.queryExecution().toString()
    got = {(r["g"], r["o"]): (r["batch_no"], r["batch_tokens"]) for r in D.pack_batches(df, "g", "o", tokens_col="n", block_width=64).collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        batches = slow_batches([r[2] or 0 for r in own], 5100)
        total = {b: 900 + sum(r[2] or 0 for r, x in zip(own, batches, strict=True) if x == b) for b in set(batches)}
        assert [got[g, r[1]] for r in own] == [(b, total[b]) for b in batches]


# ---- NULL keys and repeated source rows ---------------------------------------------------
def test_null_signatures_and_runs(spark):
    obs = spark.createDataFrame([(None, 1, 1, 0.8, "a"), (None, 2, 2, 0.8, "b"), ("s", 1, 3, 0.4, "c")], "sig string, ts long, seq long, c double, txt string")
    got = {r["sig"]: (r["times_observed"], r["confidence"], r["txt"]) for r in TM.reinforce(obs, "sig", "ts", "seq", "c", ("txt",)).collect()}
    assert got == {None: (2, 0.85, "b"), "s": (1, 0.4, "c")}
    stored = spark.createDataFrame([(None, 1, 0, 0.7, "old", True)], "sig string, times_observed long, last_observed long, confidence double, txt string, is_active boolean")
    merged = {r["sig"]: (r["times_observed"], r["confidence"]) for r in TM.merge_learnings(stored, obs, "sig", "ts", "seq", "c", ("txt",)).collect()}
    assert merged == {None: (3, 0.85), "s": (1, 0.4)}
    log = spark.createDataFrame([(None, 0, 1), (None, 4_000_000, 2), (None, 8_000_000, 3)], "run string, us long, id long").select(
        "run", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "id")
    shares = sorted((r["id"], r["pct_of_run"]) for r in features.phase_durations(log, "run", "ts", "id").collect())
    assert shares == [(1, 50.0), (2, 50.0), (3, None)]


def test_one_source_row_per_key(spark):
    target = spark.createDataFrame([("A", 1, "x"), ("b", 2, "y")], "k string, v long, w string")
    source = spark.createDataFrame([("A", 5, "p"), ("A", 6, "q"), ("c", 7, "r"), ("c", 7, "r"), (None, 8, "s"), (None, 8, "s")], "k string, v long, w string")
    latest = [Order("v", desc=True)]
    got = sorted((tuple(r) for r in setops.upsert(target, source, ["k"], ["v"], latest).collect()), key=repr)
    assert got == sorted([("A", 6, "x"), ("b", 2, "y"), ("c", 7, "r"), (None, 8, "s"), (None, 8, "s")], key=repr)
    folded = source.withColumn("k", F.lower("k"))
    out = setops.update_from(target, folded.unionByName(source), ["k"], F.lit(True), {"v": "v"}, latest).collect()
    assert sorted(tuple(r) for r in out) == [("A", 6, "x"), ("b", 2, "y")]


def test_exact_rank_where_a_sketch_cannot_bracket(spark, monkeypatch):
    """Many distinct values and brackets that widen to all of them: no value list in the driver."""
    monkeypatch.setattr(features, "SORT_ROWS", 50)
    monkeypatch.setattr(features, "SKETCH_BUCKETS", 2)
    values = sorted(random.Random(1).choices(range(4000), k=3000) + [7] * 900)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for rank in (3, 2500):
        assert features.nth_smallest(df, "v", rank) == values[rank - 1]
