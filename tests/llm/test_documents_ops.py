"""Operators on single documents against brute-force versions."""

import dataclasses
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from alloy.llm import bpe_automaton, fingerprint, packing, pseudo_lm, quality_rank, secret_scan, style_tree
from alloy.llm.queries import QUERIES, vocabulary
from tests.conftest import SF_MID, SF_SMALL

WORDS = "the of andre password token thing AKIA deadbeef 0123 é straße naïve 한국 x=1 'll don't".split()
ODD = ["", " ", "\n\t ", "a", "a\x1cb", "\xa0x　y", "İΣ", "é e ́", "<|endoftext|>", "😀" * 40, "word " * 5000]


def rows(spark, pairs, extra=False):
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("key", "part", "spans", "start", "length", "digest", "score")}) if extra else df


def edge_rows(spark, extra=True):
    pairs = [(1, None), (2, ""), (3, " \n\t"), (None, "text without id " * 30), (4, "long text " * 60_000), (5, "same"), (5, "same"),
             (6, "password=hunter2222"), (None, None)]
    return rows(spark, pairs, extra)


def random_texts(n, seed=0):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 300))) for _ in range(n)] + ODD


# ---- op1 ---------------------------------------------------------------------------
def slow_fingerprint(text):
    """One byte after the other."""
    raw = text.encode()
    hasher_mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & hasher_mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & hasher_mask
        return x ^ (x >> 31)

    def value(b):
        return b + 1 if b else 0

    rolls = []
    for i in range(len(raw)):
        roll, weight = 0, 1
        for back in range(7):
            if i >= back:
                roll += value(raw[i - back]) * weight
            weight = weight * 0x01000193 & 0xFFFFFFFF
        rolls.append((mix(roll & 0xFFFFFFFF) & 0xFFFFFFFF) + 1)

    def signature(block, most):
        out, start = "", 0
        for i, r in enumerate(rolls):
            if r % block == 0 and len(out) < most - 1:
                out += digit(raw[start:i + 1])
                start = i + 1
        return out + (digit(raw[start:]) if start < len(raw) else "")

    def digit(piece):
        total, power = 0, 1
        for b in piece:
            total = (total + value(b) * power) & hasher_mask
            power = power * 0x9E3779B97F4A7C15 & hasher_mask
        return chr(fingerprint.DIGITS[mix(total) & 63])

    block = 3
    while block * 64 < len(raw):
        block *= 2
    while block > 3 and sum(r % block == 0 for r in rolls) + 1 < 32:
        block //= 2
    return f"{block}:{signature(block, 64)}:{signature(2 * block, 32)}"


def test_fingerprints_equal_byte_by_byte():
    texts = random_texts(30)
    assert fingerprint.Hasher().fingerprints(texts) == [slow_fingerprint(t) for t in texts]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow_likeness(a, b):
    (n, *x), (m, *y) = a.split(":"), b.split(":")
    by_size = [(int(n), x[0]), (2 * int(n), x[1])], [(int(m), y[0]), (2 * int(m), y[1])]
    found = [1 - levenshtein(s, t) / max(len(s), len(t)) if s or t else 0.0 for i, s in by_size[0] for j, t in by_size[1] if i == j]
    return 1.0 if a == b else max(found, default=0.0)


def test_edited_texts_and_likeness(spark):
    texts = random_texts(60, 1)
    pairs = [(i * 7 % 71, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in fingerprint.compare_edited(rows(spark, pairs, extra=True).repartition(5)).collect()}
    assert len(got) == len(pairs)
    order = sorted(pairs, reverse=True)
    for (doc, text), (_, follower) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        edited = text[:len(text) - half] + follower[:half]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        marks = [slow_fingerprint(t) for t in (text, edited, follower)]
        assert [r["fingerprint"], r["edited_fingerprint"]] == marks[:2]
        assert r["near_edited"] == pytest.approx(slow_likeness(marks[0], marks[1]))
        assert r["near_next"] == pytest.approx(slow_likeness(marks[0], marks[2]))


def test_fingerprint_edges(spark):
    df = edge_rows(spark)
    got = fingerprint.compare_edited(df).collect()
    assert len(got) == df.count()
    one = fingerprint.compare_edited(rows(spark, [(1, "alone here")])).collect()[0]
    assert one["near_next"] == 1.0
    assert fingerprint.compare_edited(rows(spark, [])).count() == 0
    assert fingerprint.fingerprints(df).count() == df.count()


def test_edits_are_nearer_than_strangers(spark):
    got = QUERIES["op1_piecewise_hash"](spark, SF_SMALL).toPandas()
    assert got["near_edited"].mean() > got["near_next"].mean() + 0.25
    assert ((got["near_edited"] >= 0) & (got["near_edited"] <= 1)).all()


# ---- op2 ---------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home">
<header>Site</header><nav><ul><li><a href="/a">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<script>var t="</p><article>";</script><!-- <article>no</article> -->
<article class="post"><header><h1>Title &amp; more</h1></header><p>One <b>bold
 word<p>Two &lt;tag&gt; a < b<br>line&nbsp;three<div class="ad"><p>Buy</div><ul><li>x<li>y</ul>
<form><input>Sign up</form><section id="comments"><p>nice</section></article>
<aside>Related</aside><footer>&copy; me</footer></body>"""


def test_main_text():
    assert style_tree.main_text(PAGE) == "Title & more\nOne bold word\nTwo <tag> a < b line three\nx\ny"
    assert style_tree.main_text("") == ""
    assert style_tree.main_text("just text &amp; more") == "just text & more"
    assert style_tree.main_text("<p>a<p>b<script>x") == "a\nb"


def test_noise_by_entropy(spark):
    """Without telling labels, what repeats over a host's pages goes."""
    pages = [(i, f"http://plain.example/{i}", f"<body><div class=top>Welcome to us</div><div class=x><p>story {i} of its own</div>"
              f"<div class=end><p>All rights kept</div>") for i in range(12)]
    pages += [(90, "http://single.example/", "<div>only page</div><div>its end</div>"), (91, None, None), (92, "no url", "<p>t")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("noise", F.lit(1))
    got = {r["page_id"]: r["text"] for r in style_tree.extract(df).collect()}
    assert [got[i] for i in range(12)] == [f"story {i} of its own" for i in range(12)]
    assert (got[90], got[91], got[92]) == ("only page\nits end", "", "t")
    assert style_tree.extract(df.limit(0)).count() == 0
    # copies of one page count once, so they are no noise
    same = spark.createDataFrame([(i, "http://copies.example/a", "<div class=q>same text</div>") for i in range(9)],
                                 "page_id long, url string, html string")
    assert {r["text"] for r in style_tree.extract(same).collect()} == {"same text"}


def test_entropy_decides_on_pages_with_articles(spark):
    """Notices that repeat inside an article go; main text beside a teaser stays, what repeats there goes."""
    pages = [(i, f"http://in.example/{i}", f"<article><div class=box><p>Read our other offers</div><p>story {i}</article>") for i in range(12)]
    pages += [(20 + i, f"http://beside.example/{i}", f"<article>teaser {i}</article><div class=x><p>long main text {i}</div><div class=y>All rights kept</div>")
              for i in range(12)]
    pages += [(50, "http://single.example/", "<article>own</article><div>beside</div>")]
    got = {r["page_id"]: r["text"] for r in style_tree.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(12)] == [f"story {i}" for i in range(12)]
    assert [got[20 + i] for i in range(12)] == [f"teaser {i}\nlong main text {i}" for i in range(12)]
    assert got[50] == "own"


def test_articles_of_the_pages_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    import html
    for r in QUERIES["op2_style_tree"](spark, SF_SMALL).collect():
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "br" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        want = "\n".join(" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        assert r["text"] == "\n".join(x for x in want.split("\n") if x), blocks
        assert r["n_chars"] == len(r["text"])


# ---- op4 ---------------------------------------------------------------------------
def slow_base(text):
    """Every match of the written patterns, then the ones that are too short away."""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(
        r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


PARTS = st.sampled_from(["password", "PassWd", "tOken", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCD1234EFGH5678",
                         "abcdef", "0123456789abcdef", "x", "é", "ſ", "K", ".", "\n", "token=ab", "Q7xZ2mK9vL4pR8wT"])


@given(st.lists(PARTS, max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_spans(text):
    scan = secret_scan.scanner(vocabulary("byte_bpe_50k.tiktoken"), frozenset(), 2.0)
    (spans,) = scan.scan(pa.array([text], pa.string()))
    assert [s for s in spans if s[1] < 3] == slow_base(text)
    base = slow_base(text)
    assert all(s[2] <= b[0] or b[2] <= s[0] for s in spans if s[1] == 3 for b in base)


def test_token_efficiency():
    rng = random.Random(0)
    scan = secret_scan.scanner(vocabulary("byte_bpe_50k.tiktoken"), frozenset({"Zq8vN3xK7mW2pL9tR4yB"}), 2.0)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    random_runs = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(200)]
    assert sum(scan.is_random(r) for r in random_runs) > 190
    for plain in ("international_standard_2024", "user-profile-settings-page-2", "123e4567-e89b-12d3-a456-426614174000", "d41d8cd98f00b204e9800998ecf8427e",
                  "12345678901234567890", "thisisaverylongwordwithoutdigits", "/usr/local/share/documents/file1", "Zq8vN3xK7mW2pL9tR4yB"):
        assert not scan.is_random(plain), plain


def test_parts_beside_base_spans_and_letters(spark):
    rng = random.Random(1)
    scan = secret_scan.scanner(vocabulary("byte_bpe_50k.tiktoken"), frozenset(), 2.0)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    tail = "".join(rng.choice(letters + "0123456789") for _ in range(40))
    text = f"key 0123456789abcdef01234567-{tail} end"
    assert scan.spans(text) == [(4, 2, 28), (28, 3, 69)]
    (got,) = rows(spark, [(1, text)]).select(secret_scan.redacted(F.col("text"), vocabulary("byte_bpe_50k.tiktoken"))).first()
    assert tail not in got
    runs = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(200)]
    assert sum(scan.is_random(x) for x in runs) > 180
    for plain in ("thisisaverylongwordwithoutdigits", "international-standard-organisation", "--------------------------", "getUserProfileSettingsFromPage",
                  "THE_QUICK_BROWN_FOX_JUMPS_OVER"):
        assert not scan.is_random(plain), plain


def test_secret_query_and_masking(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in QUERIES["op4_token_efficiency"](spark, SF_SMALL).collect():
        base = slow_base(texts[r["doc_id"]])
        line = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert [x for x in r["spans"].split(",") if x and "dense" not in x] == [x for x in line.split(",") if x]
    df = rows(spark, [(1, 'a token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" b'), (2, None), (3, "clean é text"), (4, "")])
    got = {r["doc_id"]: r["t"] for r in df.select("doc_id", secret_scan.redacted(F.col("text"), vocabulary("byte_bpe_50k.tiktoken")).alias("t")).collect()}
    assert got == {1: 'a [secret]" b', 2: None, 3: "clean é text", 4: ""}
    df = edge_rows(spark)
    assert secret_scan.find_secrets(df, vocabulary("byte_bpe_50k.tiktoken")).count() == df.count()
    assert secret_scan.find_secrets(df.limit(0), vocabulary("byte_bpe_50k.tiktoken")).count() == 0


# ---- op5 ---------------------------------------------------------------------------
def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    got = QUERIES["op5_pairwise_quality"](spark, SF_MID).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(judged) > 50
    assert np.mean([p == q for p, q in judged]) >= 0.95


def test_pairs_fit_by_brute_force():
    """The weights are where the loss over all pairs of labels is least."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, quality_rank.N_FEATURES)) * 0.5
    y = (x[:, 0] + rng.standard_normal(40) > 0).astype(int)
    model = quality_rank.fit_pairs(x, y, 0.5)
    s = model.linear(x)
    assert np.mean(s[y == 1][:, None] > s[y == 0][None, :]) > 0.8
    assert quality_rank.fit_pairs(x[:0], y[:0], 0.0).score(["a", None, ""]).tolist() == [0.5] * 3


def test_every_labelled_row_teaches(spark, monkeypatch):
    """More labelled rows than a block holds, one label rare: moments, pairs and cut are those of all rows."""
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["a", "bb", "ccc,", "Dd.", "12"]) for _ in range(rng.randrange(1, 40))) + ("!" if i % 9 == 0 else "")) for i in range(700)]
    df = rows(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 9 != 0)) for i, _ in texts], "doc_id long, quality int")
    monkeypatch.setattr(quality_rank, "LEAST", 20)
    model = quality_rank.fit(df, labels, block=100)
    x = quality_rank.feature_matrix([t for _, t in texts])
    assert np.allclose(model.centre, x.mean(0)) and np.allclose(model.scale, np.where(x.std(0) > 1e-12, x.std(0), 1))
    s, y = model.linear(x), np.array([int(i % 9 != 0) for i, _ in texts])
    right = [((s >= c) == y).sum() for c in (model.cut, *np.unique(s) + 1e-9, s.min() - 1)]
    assert right[0] == max(right)
    whole = quality_rank.fit(df, labels, block=1000)
    one = quality_rank.fit_pairs(x, y, 1 - y.mean())
    assert np.allclose(whole.weights, one.weights) and np.isclose(whole.cut, one.cut)
    assert np.mean(s[y == 1][:, None] > s[y == 0][None, :]) > 0.98


def test_quality_edges(spark):
    df = edge_rows(spark)
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (None, 1, 1), (4, 1, 0), (4, 0, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality_rank.fit(df, labels)
    got = [r[0] for r in df.select(quality_rank.score(F.col("text"), model)).collect()]
    assert len(got) == df.count() and all(0 <= s <= 1 for s in got)
    assert quality_rank.fit(df.limit(0), labels).cut == 0.0
    assert quality_rank.fit(df, labels.limit(0)).score([None]).tolist() == [0.5]


# ---- op6 ---------------------------------------------------------------------------
BYTE = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
WORD = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
TEXT = st.lists(st.one_of(st.sampled_from([" ", "  ", "\n", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", " the", "ing", "\x85", "\x1c", "\xa0", "́", "Σ"]),
                          st.text(max_size=6)), max_size=12).map("".join)


@given(TEXT)
@settings(max_examples=500, deadline=None)
def test_ids_are_the_tokenizers(text):
    text = text.encode("utf-8", "ignore").decode()
    bpe = bpe_automaton.codec(vocabulary("byte_bpe_50k.json"))
    want = BYTE.encode(text, add_special_tokens=False).ids
    assert bpe.encode(text) == want
    assert bpe.decode(want) == BYTE.decode(want, skip_special_tokens=False)
    digests = (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(bpe.decode(want).encode()).hexdigest())
    assert next(bpe.digests(pa.array([text]))) == digests
    chunks = packing.ChunkIds(vocabulary("word_bpe_49k.json")) if not hasattr(test_ids_are_the_tokenizers, "c") else test_ids_are_the_tokenizers.c
    test_ids_are_the_tokenizers.c = chunks
    ids = np.frombuffer(next(chunks.documents(pa.array([text]), 0)), "<u4").tolist()
    assert ids == [*WORD.encode(text, add_special_tokens=False).ids, 0]


def test_small_automaton_by_brute_force():
    """Random merge lists over three letters: the accepted path is what merging by rank gives."""
    rng = random.Random(3)
    for _ in range(60):
        labels = {i: bytes([97 + i]) for i in range(3)}
        merges = []
        while len(merges) < 12:
            u, v = rng.choice(list(labels)), rng.choice(list(labels))
            if labels[u] + labels[v] not in labels.values():
                labels[len(labels)] = labels[u] + labels[v]
                merges.append((u, v))
        auto = bpe_automaton.TokenAutomaton(labels, merges)
        made = {pair: 3 + i for i, pair in enumerate(merges)}
        for _ in range(40):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
            ids = [b - 97 for b in word]
            while (best := min(((made[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in made), default=None)):
                pair = (ids[best[1]], ids[best[1] + 1])
                out, i = [], 0
                while i < len(ids):
                    if tuple(ids[i:i + 2]) == pair:
                        out.append(best[0])
                        i += 2
                    else:
                        out.append(ids[i])
                        i += 1
                ids = out
            assert auto.encode(word) == ids, (word, merges)
            assert auto.decode(ids) == word


def test_encoding_edges(spark):
    df = edge_rows(spark)
    path = vocabulary("byte_bpe_50k.json")
    whole = {(r["doc_id"], len(r["ids"]), hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in bpe_automaton.encode_documents(df, path).collect()}
    digests = bpe_automaton.encoding_digests(df, path).collect()
    assert {(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in digests} == whole and len(digests) == df.count()
    assert bpe_automaton.encoding_digests(df.limit(0), path).count() == 0


# ---- op9 ---------------------------------------------------------------------------
def check_packing(got, texts, capacity=packing.CAPACITY):
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc, text in texts.items():
        ids = [*WORD.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert r["start"] == r["piece"] * capacity and len(part) == r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r["length"] for r in got) / capacity


def test_packing_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    n, least = check_packing(QUERIES["op9_sum_of_squares"](spark, SF_SMALL).collect(), texts)
    assert n <= 1.02 * least + 2


@given(st.lists(st.integers(1, 40), max_size=200))
@settings(max_examples=100, deadline=None)
def test_sum_of_squares_rule(sizes):
    """Each piece goes where the squared counts of open bins by gap become smallest."""
    capacity = 40
    bins, offsets, fill = packing.sum_of_squares(np.array(sizes, np.int64), capacity)
    levels = {}
    for i in np.argsort(-np.array(sizes, np.int64), kind="stable"):
        size, at = sizes[i], int(bins[i])

        def cost(choice):
            after = dict(levels)
            after[choice] = after.get(choice, 0) + size
            gaps = [capacity - x for x in after.values() if x < capacity]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        choices = [b for b, x in levels.items() if x + size <= capacity] + [max(levels, default=-1) + 1]
        assert cost(at) == min(map(cost, choices))
        assert offsets[i] == levels.get(at, 0)
        levels[at] = levels.get(at, 0) + size
    assert all(fill[i] == levels[int(b)] for i, b in enumerate(bins))


def test_equal_rows_are_packed_in_several_shards(spark):
    """50,000 rows without id and with one text are no hot key."""
    df = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("seven words make a row of ids here").alias("text"))
    got = packing.pack_documents(df, vocabulary("word_bpe_49k.json")).select("length", "offset", "sequence_id").collect()
    assert len(got) == 50_000 and len({r["length"] for r in got}) == 1
    # the shard is in the sequence number
    first = [r for r in got if r["sequence_id"] >> 56 == 0]
    assert len({r["sequence_id"] >> 32 for r in first}) >= 4
    per_bin = 2048 // got[0]["length"]
    assert len({r["sequence_id"] for r in got}) <= 1.12 * 50_000 / per_bin


def test_packing_edges(spark):
    df = edge_rows(spark)
    got = packing.pack_documents(df, vocabulary("word_bpe_49k.json")).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, 6, None}
    check_packing(got, {1: None, 2: "", 3: "", 4: "long text " * 60_000, 6: "password=hunter2222"})
    assert sum(r["doc_id"] == 5 for r in got) == 2
    assert packing.pack_documents(df.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


# ---- op10 --------------------------------------------------------------------------
def test_gradients_and_scores():
    rng = np.random.default_rng(0)
    weights = [rng.standard_normal(s) * 0.3 for s in pseudo_lm.SHAPES]
    model = pseudo_lm.MaskedLm(["the", "of"], weights)
    words = pseudo_lm.lower_words(pa.array(["The cat of the house", "", "of"]))
    classes, at = model.classes(words)
    got = model.log_probs(classes, at)
    embed, inner, bias, outer, prior = weights
    for i, place in enumerate(at):
        x = np.concatenate([embed[classes[place + o]] for o in pseudo_lm.OFFSETS])
        scores = np.tanh(x @ inner + bias) @ outer + prior
        assert got[i] == pytest.approx(scores[classes[place]] - np.log(np.exp(scores).sum()))
    # a small step along the gradient raises the likelihood
    adam = pseudo_lm.Adam([w.astype(np.float32) for w in weights])
    before = got.sum()
    for _ in range(20):
        adam.step(classes, at)
    assert pseudo_lm.MaskedLm(model.words, adam.weights).log_probs(classes, at).sum() > before


def test_training_beats_word_shares(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    plain, trained = pseudo_lm.fit(docs, rounds=0), pseudo_lm.fit(docs)
    mean = {k: pseudo_lm.score(docs, m).agg(F.sum("pseudo_log_likelihood") / F.sum("n_tokens")).first()[0] for k, m in (("plain", plain), ("trained", trained))}
    assert mean["trained"] > mean["plain"] + 0.01
    assert trained.words[0] == pseudo_lm.word_counts(pseudo_lm._rows(docs, "doc_id", "text")).orderBy(F.desc("n")).first()["word"]


def test_lm_edges(spark):
    df = edge_rows(spark)
    model = pseudo_lm.fit(df, rounds=1)
    got = pseudo_lm.score(df, model).collect()
    assert len(got) == df.count()
    assert all((r["n_tokens"] == 0) == (r["mean_log_prob"] is None) and r["pseudo_log_likelihood"] <= 0 for r in got)
    empty = pseudo_lm.fit(df.limit(0))
    assert empty.words == [] and pseudo_lm.score(df.limit(0), empty).count() == 0


def test_every_word_is_masked_once():
    words = pseudo_lm.lower_words(pa.array(["one", "", "a b c d e f g h i j k l m n o p q r s t", "x y z"]))
    for rounds in (1, 2, 3):
        seen = np.concatenate([pseudo_lm.masked_places(words, r, rounds) for r in range(rounds)])
        assert sorted(seen.tolist()) == list(range(24))


def test_each_words_own_probability_counts(spark):
    text = "the cat sat on the mat with a station nation nation Ration"
    class_ = [f"c{i}" for i in range(pseudo_lm.N_WORDS)]
    pairs = [(i, " ".join([*class_ * 3, text])) for i in range(4)] + [(7, "nation"), (7, "nation"), (None, "station Station"), (8, "xqtion"), (9, "c5")]
    df = rows(spark, pairs)
    model = pseudo_lm.fit(df.filter("doc_id is null or doc_id < 8").repartition(3))
    counts = Counter(w.lower() for d, t in pairs if d is None or d < 8 for w in t.split())
    by_class = {}
    for w, n in counts.items():
        by_class.setdefault(int(model.word_classes([w])[0]), []).append(n)

    def own(word):
        c = int(model.word_classes([word])[0])
        return 0.0 if word in model.words else np.log((counts[word] + 1) / (sum(by_class.get(c, [])) + len(by_class.get(c, [])) + 1))

    got = sorted(pseudo_lm.score(df.repartition(3), model).collect(), key=str)
    want = []
    for doc, t in pairs:
        words = pseudo_lm.lower_words(pa.array([t]))
        want.append((doc, model.log_probs(*model.classes(words)).sum() + sum(own(w.lower()) for w in t.split())))
    assert len(got) == len(want)
    for doc, score in want:
        assert any(r["doc_id"] == doc and r["pseudo_log_likelihood"] == pytest.approx(score, rel=1e-5) for r in got), (doc, score)
    # words that share a class: the frequent one is likelier than the rare, the rare than gibberish
    score = {r["doc_id"]: r["pseudo_log_likelihood"] for r in pseudo_lm.score(
        rows(spark, [(0, "nation"), (1, "station"), (2, "xqtion")]), model).collect()}
    assert score[0] > score[1] > score[2]
    assert pseudo_lm.class_words(1 << 30) > pseudo_lm.class_words(1 << 24) > pseudo_lm.class_words(0) == pseudo_lm.N_WORDS


def test_vocabulary_paths():
    assert vocabulary("byte_bpe_50k.json") == str(public_tokenizers.path("byte_bpe_50k.json"))


def test_frequent_words_are_scored_in_tasks(spark):
    """Only words that tasks lack are joined, and the scores are those of the join of all words."""
    texts = [" ".join(f"w{j}" for j in range(i, 400, i % 7 + 1)) for i in range(12)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "doc_id long, text string")
    model = pseudo_lm.fit(df, rounds=0)
    few = pseudo_lm.frequent_words(model.counts, 300)
    n = {r["word"]: r["n"] for r in model.counts.collect()}
    got = dict(zip(*(c.to_pylist() for c in few.columns), strict=True))
    assert 0 < len(got) <= 300 < len(n) == len(model.frequent) == 400
    assert got == {w: k for w, k in n.items() if k >= min(got.values())}
    want = pseudo_lm.score(df, dataclasses.replace(model, frequent=None)).orderBy("doc_id").collect()
    for known in (model.frequent, few):
        for a, b in zip(pseudo_lm.score(df, dataclasses.replace(model, frequent=known)).orderBy("doc_id").collect(), want, strict=True):
            assert a[:2] == b[:2] and a["pseudo_log_likelihood"] == pytest.approx(b["pseudo_log_likelihood"], rel=1e-9)
