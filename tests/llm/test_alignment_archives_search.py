"""Token alignment, WARC archives and ranked search against brute-force versions."""

import gzip
import hashlib
import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from alloy.llm import geometric_index, token_alignment, warc
from alloy.llm.queries import BYTE_BPE, BYTE_RANKS, PIECES, QUERIES, vocabulary
from alloy.session import scratch_path
from tests.conftest import SF_SMALL

WORDS = "the of andre naïve straße 한국어 日本語 x=1 'll don't <s> </s> <unk> <|endoftext|> ▁ á ﬁ 0123 AKIA deadbeef … 😀 don’t".split()
ODD = ["", " ", "\n\t ", "a", " a", "a ", "a  b", "a\x1cb", "\xa0x　y", "İΣ", "<|endoftext|>", "x<0x41>y", "\x00a\x00", "a\u0085b",
       "▁", "a▁b", "😀" * 40, "word " * 3000, "tab\there\nline\r\nend", "  two  two  "]


def random_texts(n, seed=0):
    rng = random.Random(seed)
    gaps = [" "] * 12 + ["  ", "\n", "\t", " \n", "　"]
    return ["".join(rng.choice(WORDS) + rng.choice(gaps) for _ in range(rng.randint(0, 60))).strip(" ") for _ in range(n)] + ODD


# ---- op11 --------------------------------------------------------------------------------
def letters():
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def slow_alignment(texts):
    """Token by token, with every pair of tokens looked at."""
    a_tok = Tokenizer.from_file(vocabulary(BYTE_BPE))
    a_tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    letter = letters()
    docs = []
    for text in texts:
        text = text or ""
        a = a_tok.encode(" " + text, add_special_tokens=False)
        b = sp.encode(text)
        a_bytes = [bytes(letter[c] for c in t) for t in a.tokens]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            docs.append(None)
            continue

        def spans(pieces):
            at, out = 0, []
            for p in pieces:
                out.append((at, at + len(p)))
                at += len(p)
            return out

        sa, sb = spans(a_bytes), spans(b_bytes)
        links, first = [], 0
        for i, (s, e) in enumerate(sa):
            while sb[first][1] <= s:
                first += 1
            j = first
            while j < len(sb) and sb[j][0] < e:
                links.append((a.ids[i], b[j]))
                j += 1
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = []
        left, right = iter(zip(a.ids, sa, strict=True)), iter(zip(b, sb, strict=True))
        for e in ends:
            sides = []
            for side in (left, right):
                sides.append([])
                while not sides[-1] or sides[-1][-1][1][1] < e:
                    sides[-1].append(next(side))
            groups.append("|".join(",".join(str(x) for x, _ in side) for side in sides))
        docs.append((len(sa), len(sb), len(groups), links, ";".join(groups)))
    count = Counter(pair for d in docs if d for pair in set(d[3]))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else
            (d[0], d[1], d[2], len(d[3]), sum(count[p] == best[p[0]] for p in d[3]), sum(count[p] for p in d[3]),
             hashlib.sha256(d[4].encode()).hexdigest()) for d in docs]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("hot_pairs", [1 << 20, 40, 0])
def test_alignment_equals_every_pair(spark, hot_pairs):
    """Also where most or all pairs are too many to be broadcast; repeated rows count each."""
    texts = [*random_texts(60), None, "same same", "same same"]
    pairs = [(None if i == 5 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "pair", "n", "times")})
    got = token_alignment.alignment_digests(df.repartition(4), vocabulary(BYTE_BPE), vocabulary(BYTE_RANKS), vocabulary(PIECES),
                                            hot_pairs=hot_pairs).collect()
    want = Counter((doc, *row) for (doc, _), row in zip(pairs, slow_alignment(texts), strict=True))
    assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got) == want


def test_alignment_of_the_given_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_galloping_alignment"](spark, SF_SMALL).collect()}
    want = slow_alignment([d["text"] for d in docs])
    assert got == {d["doc_id"]: w for d, w in zip(docs, want, strict=True)}


def test_alignment_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.alignment_digests(df, vocabulary(BYTE_BPE), vocabulary(BYTE_RANKS), vocabulary(PIECES)).collect() == []


@given(st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=40), min_size=1, max_size=6), st.randoms())
@settings(max_examples=150, deadline=None)
def test_galloping_finds_common_ends_and_overlaps(pieces, rng):
    sides = ([], [])
    for sizes in pieces:
        total = sum(sizes)
        for side in sides:
            cuts = sorted(rng.sample(range(1, total), rng.randint(0, total - 1))) + [total]
            side.append(cuts)

    def ends(side):
        return token_alignment.Ends(np.zeros(sum(map(len, side)), np.int64), np.array([x for t in side for x in t], np.int64),
                                    np.cumsum([0, *map(len, side)]))

    a, b = map(ends, sides)
    found = token_alignment.align(a, b)
    links, common, p, q = [], [], 0, 0
    for x, y in zip(*sides, strict=True):
        for i, e in enumerate(x):
            for j, f in enumerate(y):
                if e == f:
                    common.append((p + i, q + j))
                if (x[i - 1] if i else 0) < f and (y[j - 1] if j else 0) < e:
                    links.append((p + i, q + j))
        p, q = p + len(x), q + len(y)
    assert list(zip(*(c.tolist() for c in found.common), strict=True)) == common
    assert list(zip(*(c.tolist() for c in found.links), strict=True)) == links


# ---- op12 --------------------------------------------------------------------------------
PAGES = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (7, "http://a/7\r\nX: y", "<p>same</p>"), (3, None, None),
         (4, "", ""), (5, "http://b/ü", "<p>Grüße 한국 😀\r\n\r\nWARC/1.1</p>"), (None, "http://c", "<p>same</p>"), (None, "http://c", "alone"),
         (None, None, "alone"), (6, "http://d", "long " * 400_000), (8, "http://e", "twice"), (8, "http://e", "twice"), (9, "http://f", "x" * 70_000)]


def pages(spark, rows=PAGES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({c: F.lit("?") for c in ("id", "payload", "digest", "original", "archive")})


def place(spark):
    import uuid
    return scratch_path(spark, f"warc-test-{uuid.uuid4().hex}")


def slow_records(rows, least=0):
    import base64
    out = []
    for page, url, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        last = max(same) if same and len(raw) >= least else page
        original = None if last is None or last == page else last
        if url is not None:
            url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        out.append((page, url, len(raw), "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "response" if original is None else "revisit", original, None if original is not None else raw))
    return out


def as_rows(df):
    def page(x):
        return int(x.rsplit(":", 1)[1]) if x is not None and x.startswith("urn:page:") else None

    return Counter((page(r["record_id"]), r["uri"], r["payload_bytes"], r["payload_digest"], r["type"], page(r["refers_to"]),
                    None if r["payload"] is None else bytes(r["payload"])) for r in df.collect())


@pytest.mark.parametrize("least", [0, 8])
@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_archives_round_trip(spark, monkeypatch, least, bound):
    """Also where the digests that repeat are too many to be broadcast."""
    monkeypatch.setattr(warc, "DEFAULT_BROADCAST_BYTES", bound)
    folder = place(spark)
    archives = warc.write_archives(pages(spark).repartition(3), f"{folder}/whole", least_bytes=least, archive_bytes=100_000)
    index = warc.normalise(archives, f"{folder}/members")
    assert sum(r["n_records"] for r in archives.collect()) == len(PAGES) == index.count()
    assert as_rows(warc.read_records(index)) == Counter(slow_records(PAGES, least))


def test_each_record_is_a_member_and_found_by_its_offset(spark):
    folder = place(spark)
    archives = warc.write_archives(pages(spark).coalesce(1), f"{folder}/whole")
    (whole,) = [r["archive"] for r in archives.collect()]
    index = warc.normalise(archives, f"{folder}/members")
    rows = sorted(index.collect(), key=lambda r: r["offset"])
    (archive,) = {r["archive"] for r in rows}
    raw = open(archive, "rb").read()
    assert sum(r["length"] for r in rows) == len(raw) and gzip.decompress(raw) == gzip.decompress(open(whole, "rb").read())
    for r in rows:
        assert gzip.decompress(raw[r["offset"]:r["offset"] + r["length"]]).startswith(b"WARC/1.1\r\n")
    beside = [json.loads(line) for line in open(archive + ".idx", encoding="utf-8")]
    assert beside == [{k: r[k] for k in beside[0]} for r in rows]
    one = warc.read_records(index.filter(F.col("record_id") == "urn:page:9")).collect()
    assert len(one) == 1 and bytes(one[0]["payload"]) == b"x" * 70_000


def test_other_archives_are_normalised(spark):
    """Plain, one member per record, cut off, and broken ones; a normalised archive stays as it is."""
    folder = place(spark)
    records = [warc.record("response", f"urn:page:{i}", f"http://h/{i}", warc.base32_digest(hashlib.sha1(b"p%d" % i * 9999).digest()),
                           b"p%d" % i * 9999, None, "2020-01-01T00:00:00Z") for i in range(5)]
    noise = random.Random(1).randbytes(50_000)
    import os
    os.makedirs(folder)
    files = {"plain.warc": b"".join(records), "members.warc.gz": b"".join(map(gzip.compress, records)),
             "cut.warc.gz": gzip.compress(b"".join(records[:3]) + b"WARC/1.1\r\nContent-Length: 50000\r\n\r\n" + noise)[:-40_000],
             "broken.warc.gz": gzip.compress(records[0] + b"no record\r\n\r\n"), "empty.warc.gz": b"", "void.warc.gz": gzip.compress(b"")}
    for name, raw in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(raw)
    names = spark.createDataFrame([(f"{folder}/{n}",) for n in files], "archive string")
    index = warc.normalise(names, f"{folder}/out")
    assert Counter(r["record_id"] for r in index.collect()) == Counter(
        {"urn:page:0": 4, "urn:page:1": 3, "urn:page:2": 3, "urn:page:3": 2, "urn:page:4": 2, None: 2})
    assert Counter(r["type"] for r in index.collect()) == Counter(response=14, damaged=2)
    again = warc.normalise(index.filter("type <> 'damaged'").select("archive").distinct(), f"{folder}/again")
    assert as_rows(warc.read_records(again)) == as_rows(warc.read_records(index))


def test_no_pages(spark):
    folder = place(spark)
    archives = warc.write_archives(pages(spark, []), f"{folder}/whole")
    assert warc.read_records(warc.normalise(archives, f"{folder}/members")).collect() == []


# ---- op13 --------------------------------------------------------------------------------
TERMS = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TO_LOWER = {c: c + 32 for c in range(65, 91)}


def slow_ranking(docs, items, k=10):
    bags = [(d, Counter(TERMS.findall((t or "").translate(TO_LOWER)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(TERMS.findall((text or "").translate(TO_LOWER)))
        found = []
        for d, b in bags:
            m = 100 - 75 + (75 * sum(b.values()) * n_docs) // length
            score = sum(often * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m))
                        for t, often in asked.items() if t in b)
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def search_rows(seed, n):
    rng = random.Random(seed)
    topics = [[f"{w}{t}" for w in "alpha beta gamma delta naïve straße 한국 x1 y2".split()] for t in range(6)]
    docs = [(i, " ".join(rng.choice(rng.choice(topics[i % 6:i % 6 + 2])) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    docs += [(n + i, "alpha0 BETA0 Gamma0") for i in range(40)] + [(5, None), (6, ""), (7, " .,- "), (None, "alpha1 beta1"), (None, "alpha1 beta1"),
                                                                 (8, "delta3 " * 30_000), (8, "delta3 x13")]
    items = [(i, " ".join(rng.choice(topics[i % 6]) for _ in range(rng.randint(1, 12)))) for i in range(30)]
    items += [(3, "alpha0, beta0; BETA0"), (None, "alpha1"), (40, None), (41, ""), (42, "nowhere"), (43, "delta3"), (43, "delta3")]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"SEGMENT_DOCS": 30, "BLOCK_DOCS": 4, "TABLE": 64, "ENTRIES": 50, "SHORT_LIST": 1},
                                   {"SEGMENT_DOCS": 100, "SEGMENT_POSTINGS": 150, "BLOCK_DOCS": 8, "SHORT_LIST": 2}])
@pytest.mark.parametrize("at_once", [1 << 17, 40])
def test_ranking_equals_scoring_all(spark, monkeypatch, sizes, at_once):
    """Ties, repeated and missing ids, long texts; with segments and blocks of all sizes."""
    for name, value in sizes.items():
        monkeypatch.setattr(geometric_index, name, value)
    docs, items = search_rows(1, 400)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "n", "item", "score", "terms")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("item", "row", "rank", "doc_id")})
    got = geometric_index.rank_documents(d.repartition(5), q, question_terms_at_once=at_once).collect()
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == slow_ranking(docs, items)


def test_blocks_are_skipped_and_none_that_counts(spark, monkeypatch):
    """Questions about one of many kinds of documents read a part of the postings only."""
    monkeypatch.setattr(geometric_index, "SEGMENT_DOCS", 256)
    monkeypatch.setattr(geometric_index, "BLOCK_DOCS", 16)
    rng = random.Random(3)
    words = [[f"w{t}_{i}" for i in range(30)] for t in range(12)]
    docs = [(i, " ".join([*rng.choices(words[i % 12], k=40), *rng.choices(["is", "on", "at", "by", "w"], k=10)])) for i in range(3000)]
    items = [(i, " ".join([*rng.choices(words[i], k=6), "is", "on", "at"])) for i in range(12)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = geometric_index.rank_documents(d, q).collect()
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == slow_ranking(docs, items)
    terms = sorted({t for _, text in items for t in text.split()})
    index = geometric_index.index_documents(d, terms)
    ask = geometric_index.numbered([(i, t, n) for i, text in items for t, n in Counter(text.split()).items()], len(items), index)
    limits = geometric_index.limits_of(index, ask, len(items), 10)
    total, read = geometric_index.blocks_read(index.segments, ask, limits).agg(F.sum("postings"), F.sum("read")).first()
    assert 0 < read < 0.7 * total


def test_ranking_without_rows(spark):
    docs, items = (spark.createDataFrame([], f"{i} long, text string") for i in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for d, q in ((docs, items), (docs, some[1]), (some[0], items)):
        assert geometric_index.rank_documents(d, q).collect() == []
