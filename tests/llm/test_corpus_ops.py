"""Operators over the whole corpus against brute-force versions, and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from alloy.llm import common, digest_index, near_dedup, quality_rank, substring_dedup
from alloy.llm.queries import ORACLES, QUERIES, held_out
from tests.conftest import SF_SMALL
from tests.llm.test_documents_ops import check_packing, edge_rows, rows, slow_base
from tests.oracle_harness import compare, duck

SPACE = b" \t\n\x0b\x0c\r"


def corpus(n=150, seed=0):
    """Texts with exact copies, near copies, shared passages and odd white space."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Étude", "THE", "the"]
    passages = [[rng.choice(words) for _ in range(rng.randint(10, 60))] for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            text = rng.choice(texts)
        elif texts and kind < 0.45:
            own = rng.choice(texts).split()
            for _ in range(rng.randint(1, 4)):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
        else:
            own = [rng.choice(words) for _ in range(rng.randint(0, 150))]
            for _ in range(rng.randint(0, 2)):
                at = rng.randint(0, len(own))
                own[at:at] = rng.choice(passages)
            text = "".join(w + rng.choice([" ", " ", "\n", " \t "]) for w in own)
        texts.append(text)
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, texts, strict=True))


# ---- op3 ---------------------------------------------------------------------------
def test_digest_query_matches_sql(spark):
    r = compare(spark, duck(SF_SMALL), "op3_digest_index", QUERIES["op3_digest_index"], ORACLES["op3_digest_index"], SF_SMALL)
    assert r["status"] == "OK", r


def test_digest_index_over_batches(spark):
    index = digest_index.DigestIndex(spark, "digest_index_test", buckets=4)
    index.drop()
    first = digest_index.dedup_batch(index, rows(spark, [(3, "a  b"), (1, "a\tb"), (2, "c"), (9, None)], extra=True), batch="one").collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in first} == {(3, 1, 2, False), (1, 1, 2, True), (2, 2, 1, True), (9, 9, 1, True)}
    assert all(r["text_sha256"] == hashlib.sha256({3: b"a b", 1: b"a b", 2: b"c", 9: b""}[r["doc_id"]]).hexdigest() for r in first)
    for _ in range(2):  # the second batch again, as after a failure: nothing is added twice
        again = digest_index.dedup_batch(index, rows(spark, [(0, "a b"), (5, "new"), (4, "new"), (7, "")]), batch="two").collect()
        assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in again} == {(0, 1, False), (5, 4, False), (4, 4, True), (7, 9, False)}
        assert index.read().count() == 4
    stored = spark.sql("DESCRIBE EXTENDED digest_index_test").collect()
    assert {r["data_type"] for r in stored if r["col_name"] in ("Bucket Columns", "Sort Columns")} == {"[`digest`]"}
    index.drop()


def test_digest_edges(spark):
    index = digest_index.DigestIndex(spark, "digest_index_edges", buckets=2)
    index.drop()
    df = edge_rows(spark)
    got = digest_index.dedup_batch(index, df).collect()
    assert len(got) == df.count()
    by_id = {r["doc_id"]: r for r in got}
    assert (by_id[1]["keep_id"], by_id[2]["keep_id"], by_id[3]["keep_id"], by_id[5]["group_size"]) == (1, 1, 3, 2)
    assert all(not r["kept"] for r in got if r["doc_id"] is None)
    before = index.read().count()
    assert digest_index.dedup_batch(index, df.limit(0)).count() == 0 and index.read().count() == before
    index.drop()


def test_hot_groups_join_whole(spark):
    """One key with half of the rows, and keys on both sides of the share that counts as hot."""
    df = spark.range(20_000).select("id", F.when(F.col("id") < 10_000, F.lit(-1)).otherwise(F.pmod("id", F.lit(3_000))).alias("k"))
    groups = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    got = common.join_hot(df, groups, "k", "n", 20_000)
    assert got.count() == 20_000 and got.select("id").distinct().count() == 20_000
    assert got.filter("least != case when k = -1 then 0 else least end").count() == 0


# ---- op7 ---------------------------------------------------------------------------
def slow_repeats(pairs, window=13):
    first = {}
    split = [(doc, (text or "").encode().split()) for doc, text in pairs]
    for doc, words in split:
        if doc is not None:
            for i in range(len(words) - window + 1):
                w = tuple(words[i:i + window])
                first[w] = min(doc, first.get(w, doc))
    out = []
    for doc, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if doc is not None and first[tuple(words[i:i + window])] < doc:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeats(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(df).collect()), key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_repeats_by_brute_force(spark, seed):
    pairs = corpus(200, seed)
    assert repeats(rows(spark, pairs, extra=True).repartition(4)) == slow_repeats(pairs)


def test_repeats_of_a_hot_minimizer(spark, monkeypatch):
    """Minimizers over the shard size go on as single windows, with the same result."""
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", 10)
    pairs = corpus(120, 5)
    line = " ".join(f"l{i}" for i in range(14))
    pairs += [(5000 + i, f"a{i} b{i} {line} c{i} d{i}") for i in range(40)]
    assert repeats(rows(spark, pairs)) == slow_repeats(pairs)


def test_repeats_edges(spark):
    text = " ".join(f"x{i}" for i in range(30))
    pairs = [(1, None), (2, ""), (3, " \n"), (None, text), (7, text), (8, text + " more"), (8, text), (8, text), (9, "y " + text), (4, "long text " * 9_000)]
    assert repeats(rows(spark, pairs, extra=True)) == slow_repeats(pairs)
    assert substring_dedup.remove_repeats(rows(spark, [])).count() == 0


def test_repeats_query(spark):
    pairs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op7_fm_index"](spark, SF_SMALL).collect()), key=str)
    assert got == slow_repeats(pairs)


def test_index_counts_and_statistics():
    """Backward search against a plain scan of the text."""
    rng = np.random.default_rng(0)
    text = np.append(rng.integers(0, 4, 400), 0)
    docs = rng.integers(0, 50, len(text))
    index = substring_dedup.FmIndex(text, docs)
    ends = np.flatnonzero(text > 0)
    length, low, high = index.matching_statistics(text, ends, 8)
    for e, n, lo, hi in zip(ends, length, low, high, strict=True):
        run = 0
        while run < 8 and e - run >= 0 and text[e - run] > 0:
            run += 1
        assert n == run  # every run of the text itself occurs
        pattern = text[e - n + 1:e + 1]
        places = [i for i in range(len(text) - n + 1) if (text[i:i + n] == pattern).all()]
        assert hi - lo == len(places) and index.docs[lo:hi].min() == min(docs[i] for i in places)
    plain = rng.integers(0, 11, 300)
    wavelet = substring_dedup.WaveletMatrix(plain, 11)
    at, symbols = rng.integers(0, 301, 200), rng.integers(0, 11, 200)
    assert wavelet.rank(symbols, at).tolist() == [int((plain[:i] == s).sum()) for s, i in zip(symbols, at, strict=True)]


# ---- op8 ---------------------------------------------------------------------------
def slow_components(pairs):
    sets = []
    for _, text in pairs:
        words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
        sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    parent = list(range(len(pairs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted([(doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(pairs)], key=str)


def linked(df):
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()], key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_components_by_brute_force(spark, seed):
    pairs = corpus(220, seed)
    assert linked(rows(spark, pairs, extra=True).repartition(3)) == slow_components(pairs)


def test_components_of_dense_and_large_nodes(spark, monkeypatch):
    """Nodes far above the leaf size: a group of near copies, and texts that share a passage."""
    monkeypatch.setattr(near_dedup, "LEAF", 6)
    rng = random.Random(2)
    base, passage = [f"b{i}" for i in range(120)], [f"p{i}" for i in range(60)]
    pairs = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(1000)}"
        pairs.append((1000 + i, " ".join(own)))
    pairs += [(2000 + i, " ".join(passage + [f"q{i}x{j}" for j in range(rng.randint(5, 80))])) for i in range(60)]
    assert linked(rows(spark, pairs)) == slow_components(pairs)


def test_components_edges(spark):
    text = " ".join(f"x{i}" for i in range(40))
    pairs = [(1, None), (2, ""), (3, " \n"), (None, text), (7, text + " y"), (8, text.upper()), (8, "other words here"), (8, text), (11, "Other words HERE"),
             (12, "two words"), (13, "two  words"), (4, "long text " * 9_000), (None, "no id at all in this one")]
    assert linked(rows(spark, pairs, extra=True)) == slow_components(pairs)
    assert near_dedup.near_duplicates(rows(spark, [])).count() == 0
    alone = near_dedup.near_duplicates(rows(spark, [(5, "some words")])).collect()
    assert [tuple(r) for r in alone] == [(5, 1, 5, True)]


def test_components_query(spark):
    pairs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = QUERIES["op8_chosen_path"](spark, SF_SMALL).collect()
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=str) == slow_components(pairs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def made_classes(spark, n, share, like, seed=5):
    """Classes whose tokens and sketch values are the common ones with probabilities share and like."""
    rng = np.random.default_rng(seed)
    tokens = np.where(rng.random((n, near_dedup.TOKENS)) < share, -1, rng.integers(0, 1 << 31, (n, near_dedup.TOKENS)))
    marks = np.where(rng.random((n, near_dedup.SKETCH)) < like, 0, rng.integers(1, 256, (n, near_dedup.SKETCH))).astype(np.uint8)
    return spark.createDataFrame([(i.to_bytes(16, "big"), t, bytearray(m.tobytes())) for i, (t, m) in enumerate(zip(tokens.tolist(), marks, strict=True))],
                                 "key binary, tokens array<int>, sketch binary")


def test_only_alike_members_are_dense(spark, monkeypatch):
    """A shared passage without links is branched down to leaves, a group of near copies is dense."""
    monkeypatch.setattr(near_dedup, "LEAF", 64)
    leaves, dense = near_dedup.tree_groups(made_classes(spark, 900, 0.6, 0.6))
    assert dense is None
    assert leaves.groupBy("grp").count().agg(F.max("count")).first()[0] <= 64
    _, dense = near_dedup.tree_groups(made_classes(spark, 300, 0.95, 0.95))
    assert dense is not None and dense.agg(F.min("size")).first()[0] > 64


def test_no_path_uses_a_token_twice(spark):
    nodes = spark.range(200).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("used"), F.lit(b"k").alias("key"),
                                    F.sequence(F.lit(1), F.lit(near_dedup.TOKENS)).alias("tokens"))
    for depth in range(near_dedup.MAX_DEPTH - 1):
        nodes = near_dedup.branch(nodes, near_dedup.unused_choices()).groupBy("parent").agg(
            F.first("node").alias("node"), F.first("used").alias("used"), F.first("key").alias("key")).withColumn(
            "tokens", F.sequence(F.lit(1), F.lit(near_dedup.TOKENS)))
        nodes = spark.createDataFrame(nodes.select("node", "used", "key", "tokens").collect(), "node long, used long, key binary, tokens array<int>")
        assert {r[0] for r in nodes.select(F.bit_count("used")).distinct().collect()} == {depth + 1}


def test_outsiders_meet_all_members_in_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 32)
    keys = [i.to_bytes(2, "big") for i in range(500)]
    dense = spark.createDataFrame([(7, 500, k) for k in keys], "node long, size long, key binary")
    out = dense.select("node", "key").limit(300)
    groups = {}
    for r in near_dedup.block_pairs(dense, out).collect():
        groups.setdefault(r["grp"], set()).add(bytes(r["key"]))
    assert max(map(len, groups.values())) <= 4 * 32
    met = {(a, b) for g in groups.values() for a in g for b in g}
    outside = {bytes(r["key"]) for r in out.collect()}
    assert all((a, b) in met for a in outside for b in keys)


def test_pairs_far_below_the_threshold_are_candidates():
    """A linked pair has at least 64 of 128 equal sketch values, but for 1 in 10^9."""
    marks = np.zeros((3, near_dedup.SKETCH), np.uint8)
    marks[1, 64:] = 1
    marks[2] = 2
    assert near_dedup.spanning_forest(marks) == near_dedup.spanning_forest(marks[:2]) == [(0, 1)]
    assert near_dedup.between(marks, [b"a", b"b", b"c"]) == [(0, 1)]


def test_undecided_members_go_on_as_members(spark, monkeypatch):
    """Texts that are half alike but not linked: rows in proportion to the members, not to their pairs;
    two groups with the same members are decided once, and large texts in blocks give the same links."""
    rng = random.Random(4)
    shared = [f"c{i}" for i in range(170)]
    texts = [" ".join(shared + [f"o{i}x{j}" for j in range(50)]) for i in range(40)]
    for i in range(0, 10, 2):
        texts[i + 1] = texts[i].replace(f"o{i}x{rng.randrange(49)} ", "")
    sketch = near_dedup.sketches(rows(spark, list(enumerate(texts)))).filter("key is not null")
    classes = common.staged(sketch, "sketches")
    keys = [bytes(r["key"]) for r in classes.select("key").collect()]
    groups = spark.createDataFrame([(g, bytearray(k)) for g in (1, 2) for k in keys] + [(3, bytearray(keys[0]))], "grp long, key binary")
    roots = classes.select("key", F.col("key").alias("root"))
    late = near_dedup.undecided(groups, classes, roots)
    assert late.count() == len(keys) == 40
    packed = near_dedup.packed_texts(rows(spark, list(enumerate(texts))), classes, late.select("key"))
    own = {r["doc_id"]: bytes(r["key"]) for r in classes.collect()}
    want = {tuple(sorted((own[i], own[i + 1]))) for i in range(0, 10, 2)}
    for size in (near_dedup.SLICE_BYTES, 3000):
        monkeypatch.setattr(near_dedup, "SLICE_BYTES", size)
        assert {(bytes(r["a"]), bytes(r["b"])) for r in near_dedup.linked_within(late, packed).collect()} == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(60)] + [(b"\xf0", b"\xf1")], "a binary, b binary")
    got = {bytes(r["key"]): bytes(r["root"]) for r in near_dedup.components(links).collect()}
    assert got == {bytes([i]): b"\x00" for i in range(61)} | {b"\xf0": b"\xf0", b"\xf1": b"\xf0"}


def group_of_edits(n, most, seed=6):
    """Texts that are one text with up to ``most`` of its 150 words replaced: about half are linked with others."""
    rng = random.Random(seed)
    pairs = []
    for i in range(n):
        own = [f"b{j}" for j in range(150)]
        for j in rng.sample(range(150), rng.randint(0, most)):
            own[j] = f"n{rng.randrange(30)}"
        pairs.append((i, " ".join(own)))
    return pairs


def test_a_group_of_like_texts_is_compared_a_few_times(spark, monkeypatch):
    """Not once for each node that it makes in the trees; few tables are written, whatever the depth."""
    monkeypatch.setattr(near_dedup, "LEAF", 32)
    written = []

    def counted(df, tag):
        out = common.staged(df, tag)
        written.append((tag, out.count()))
        return out

    monkeypatch.setattr(near_dedup, "staged", counted)
    pairs = group_of_edits(160, 9)
    got = linked(rows(spark, pairs))
    assert got == slow_components(pairs)
    sizes = {}
    for _, _, component in got:
        sizes[component] = sizes.get(component, 0) + 1
    alone = len(pairs) - max(sizes.values())
    assert 40 <= alone <= 120
    assert sum(n for tag, n in written if tag == "outside") <= 6 * alone
    assert len(written) <= 30


def test_nodes_of_one_hub_are_one(spark):
    """Members of like nodes meet in one node, those of other nodes stay apart; every pair still meets."""
    nodes = {n: {k for k in range(100) if (k * 7 + n) % 10} for n in range(20)} | {50: set(range(200, 260))}
    dense = spark.createDataFrame([(n, len(own), bytearray([k >> 8, k & 255])) for n, own in nodes.items() for k in own], "node long, size long, key binary")
    got = {}
    for r in near_dedup.merged(dense).collect():
        got.setdefault((r["node"], r["size"]), set()).add(int.from_bytes(r["key"], "big"))
    assert len(got) <= 6 and all(size == len(own) for (_, size), own in got.items())
    assert all(any(own <= whole for whole in got.values()) for own in nodes.values())
    assert set(range(200, 260)) in got.values()


def test_nodes_are_branched_alike_in_tasks_and_in_spark(spark, monkeypatch):
    """Both ways, and both ways of joining links, give the same components."""
    monkeypatch.setattr(near_dedup, "LEAF", 16)
    pairs = group_of_edits(70, 9) + [(1000 + i, t.replace("b", "c")) for i, t in group_of_edits(50, 3, 7)]
    want = slow_components(pairs)
    assert linked(rows(spark, pairs)) == want
    monkeypatch.setattr(near_dedup, "SUBTREE", 0)
    monkeypatch.setattr(near_dedup, "FEW_LINKS", 0)
    assert linked(rows(spark, pairs)) == want


def test_leaves_of_a_subtree_hold_like_pairs(monkeypatch):
    """Members with the same tokens share every leaf or dense node; leaves are small, and none comes twice."""
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    rng = np.random.default_rng(3)
    tokens = np.repeat(rng.integers(0, 3, (100, near_dedup.TOKENS)), 2, axis=0)
    marks = rng.integers(0, 256, (200, near_dedup.SKETCH)).astype(np.uint8)
    found = [own.tolist() for _, own in near_dedup.ends_of_tree(5, 1, False, 1, tokens, marks)]
    assert len({tuple(x) for x in found}) == len(found) and max(map(len, found)) <= 8
    assert all((i ^ 1) in own for own in found for i in own)
    assert {i for own in found for i in own} == set(range(200))


def test_counts_of_shared_values():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64) << np.uint64(55 - n % 5)) for n in range(1, 40)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:30]])
    for wide in (7, 4096):
        assert (near_dedup.shared(sets[:30], sets[10:], wide) == want).all()
    both = near_dedup.shared(sets, sets, 7)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(39) for j in range(39) if i != j)
    assert (near_dedup.shared(sets[:1], [np.array([9], np.uint64)]) == 0).all()


def test_components_of_more_links(spark, monkeypatch):
    """Links between roots join what they stand for, by one task and by steps."""
    for few in (near_dedup.FEW_LINKS, 0):
        monkeypatch.setattr(near_dedup, "FEW_LINKS", few)
        links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in (1, 2, 7, 20, 30)], "a binary, b binary")
        roots = common.staged(near_dedup.components(links), "roots")
        more = spark.createDataFrame([(b"\x01", b"\x07"), (b"\x00", b"\x07"), (b"\x40", b"\x1e")], "a binary, b binary")
        got = {r["key"][0]: r["root"][0] for r in near_dedup.joined_roots(roots, more).collect()}
        assert got == dict.fromkeys((0, 1, 2, 3, 7, 8), 0) | {20: 20, 21: 20} | dict.fromkeys((30, 31, 64), 30)


# ---- pipeline ----------------------------------------------------------------------
def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    model = quality_rank.fit(docs, labels, train=~held_out())
    rows_ = [r.asDict() for r in docs.collect()]
    want = [r for r in rows_ if model.score([r["text"]])[0] >= 0.5]
    assert 0 < len(want) < len(rows_)
    stages = dict(corpus_pipeline.STAGES)
    now = stages["quality"](spark, docs, SF_SMALL)
    assert now.columns == docs.columns
    assert {r["doc_id"] for r in now.collect()} == {r["doc_id"] for r in want}
    seen, unique = {}, []
    for r in sorted(want, key=lambda r: r["doc_id"]):
        key = b" ".join(r["text"].encode().replace(b"\x00", b"\x01").split()), r["text"][:1] in " \n", r["text"][-1:] in " \n"
        if key not in seen:
            seen[key] = r
            unique.append(r)
    now = common.staged(stages["exact_dedup"](spark, now, SF_SMALL), "t")
    assert now.columns == docs.columns
    assert {r["doc_id"] for r in now.collect()} == {r["doc_id"] for r in unique}
    least = {doc: c for doc, _, c in slow_components([(r["doc_id"], r["text"]) for r in unique])}
    near = [r for r in unique if least[r["doc_id"]] == r["doc_id"]]
    now = common.staged(stages["near_duplicates"](spark, now, SF_SMALL), "t")
    assert now.columns == docs.columns
    assert {r["doc_id"] for r in now.collect()} == {r["doc_id"] for r in near}
    now = common.staged(stages["secrets"](spark, now, SF_SMALL), "t")
    assert now.columns == docs.columns and now.schema == docs.schema
    masked = {r["doc_id"]: r for r in now.collect()}
    assert set(masked) == {r["doc_id"] for r in near}
    for r in near:
        text = masked[r["doc_id"]]["text"]
        assert not slow_base(text) and masked[r["doc_id"]]["n_chars"] == len(text)
        if not slow_base(r["text"]) and "[secret]" not in text:
            assert text == r["text"]
    got = stages["pack"](spark, now, SF_SMALL).collect()
    check_packing(got, {d: r["text"] for d, r in masked.items()})
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF_SMALL).collect()} == set(masked)


def test_stages_on_odd_rows(spark):
    """NULLs, repeated ids, and columns that the operators use by name themselves."""
    docs = edge_rows(spark).withColumn("n_chars", F.length("text")).withColumn("_kept_id", F.lit(0))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        got = stage(spark, docs, SF_SMALL)
        assert got.columns == docs.columns, name
        assert {None} <= {r["doc_id"] for r in got.collect()}
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0
    assert corpus_pipeline.quality(spark, docs, SF_SMALL).columns == docs.columns
    assert corpus_pipeline.pack(spark, docs.limit(0), SF_SMALL).count() == 0


def test_slices_of_arrays_are_read_right():
    """Tasks work on slices of batches; kernels must respect where a slice begins."""
    import pyarrow as pa
    texts = [t for _, t in corpus(60, 9)]
    whole = pa.array(["padding Text " * 9, *texts], pa.string())
    for part, own in ((whole.slice(1), texts), (whole.slice(31, 20), texts[30:50])):
        for lower in (False, True):
            words = common.space_words(part, lower)
            got = [words.distinct[words.codes[a:b]].tolist() for a, b in zip([0, *words.ends[:-1]], words.ends, strict=True)]
            assert got == [[w.decode() for w in (t.encode().lower() if lower else t.encode()).split()] for t in own]
        assert [s.tolist() for s in near_dedup.shingle_sets(part)] == [s.tolist() for s in near_dedup.shingle_sets(pa.array(own))]
