"""Ranked lexical search over posting lists that are blocked by document similarity.

Documents become vectors: one coordinate for each term that may be asked for, the term's
weight times its saturated frequency, all integers. Random hyperplanes give every vector a
signature; Spark range-partitions by it, so that like documents share a segment (a bounded
run of documents, one row of the index). In a segment, documents are grouped around pivots;
the posting list of each term, in the order of the groups, is cut into blocks of like
documents, and each block stores the coordinatewise maximum of its vectors.

Terms are numbered from rare to frequent, and a document counts in a list only if it lacks
the question's rarer terms, because else the rarer list has it. So the summary of a block
needs the coordinates from its own term on, and its product with the question bounds the
scores of all documents that count there. A search goes over the segments twice: the blocks
with the largest bounds give scores, the tenth best of which over all segments is a lower
limit for the question; then blocks are skipped whose bound is below that limit, all others
are scored whole. Bounds are exact sums of integers, equal ones are not skipped, so the
result is that of scoring all documents.

Questions are taken in blocks of a bounded number of terms, each with an index over its own
terms, so what is broadcast (their terms, weights and limits) never grows with the input.

Defined results: a NULL or empty text has no terms and is neither counted nor found; rows
that repeat are documents of their own and may take several ranks; rows without id are
ranked before others of equal score; a question without terms, or NULL, finds nothing; each
row of questions is ranked on its own, also if ids repeat or are NULL; very long texts go
alone, whole; other columns, whatever their names, are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alloy.llm.common import staged, text_or_empty, text_slices

#: fixed value: the pattern of a term, all but ASCII other than letters and digits
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (question, term) pairs that are searched at a time
QUESTION_TERMS = 1 << 17
#: documents and postings of a segment, documents of a block
SEGMENT_DOCS, SEGMENT_POSTINGS, BLOCK_DOCS = 1024, 1 << 18, 128
#: lists of so few documents are read without a summary
SHORT_LIST = 16
#: documents that a task of the index build takes at least
TASK_DOCS = 8 * SEGMENT_DOCS
PIVOTS, PLANES = 32, 16
#: entries of the tables that summaries are made in
TABLE, ENTRIES = 1 << 22, 1 << 21
#: bytes of UTF-8 to those of terms, in lower case; all others are spaces
TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

COUNTED = "row long, doc_id long, n long, terms array<int>, tfs array<long>"
VECTORS = "row long, doc_id long, signature int, terms array<int>, coordinates array<long>"
#: columns of a segment, and how the numbers of the binary ones are written
LAYOUT = {"doc_first": "<i4", "doc_terms": "<i4", "doc_values": "<i8", "block_term": "<i4", "block_first": "<i4", "members": "<i4",
          "summary_first": "<i4", "summary_terms": "<i4", "summary_values": "<i8"}
SEGMENT = ", ".join(["doc_ids array<long>", *(f"{c} binary" for c in LAYOUT)])
FOUND = "item int, doc_id long, score long"


class Questions(NamedTuple):
    """Terms of each question: those of question i are ``[first[i]:first[i + 1]]``, ascending;
    ``of[t]`` are the questions with term t."""
    first: np.ndarray
    terms: np.ndarray
    often: np.ndarray
    of: dict[int, np.ndarray]


def pieces(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of some rows, one after the other, and where each row begins."""
    size = first[rows + 1] - first[rows]
    begin = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(first[rows] - begin, size), begin


# ---- the index -----------------------------------------------------------------------
def question_terms(questions: DataFrame, text_col: str) -> DataFrame:
    """``item, term, often`` of a table with a number ``item`` for each row."""
    words = F.regexp_extract_all(F.translate(text_or_empty(text_col), UPPER, LOWER), F.lit(TERM), 0)
    return (questions.select("item", F.explode(words).alias("term")).groupBy("item", "term")
            .agg(F.count(F.lit(1)).alias("often")))


def counted_terms(docs: DataFrame, vocabulary: dict[str, int], id_col: str, text_col: str) -> DataFrame:
    """Number of terms of every document, and how often it has each term of ``vocabulary``."""
    number = docs.sparkSession.sparkContext.broadcast({t.encode(): i for t, i in vocabulary.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in (part for whole in batches for part in text_slices(whole, text=2)):
            ns, terms, tfs = [], [], []
            for text in batch.column(2):
                words = text.as_buffer().to_pybytes().translate(TO_TERMS).split(b" ")
                often = Counter(words)
                ns.append(len(words) - often.pop(b"", 0))
                found = [(i, often[w]) for w in often.keys() & known.keys() for i in (known[w],)]
                terms.append([i for i, _ in found])
                tfs.append([n for _, n in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int64()))], ["row", "doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, COUNTED)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each row's begin and end."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def vectors(counted: DataFrame, order: np.ndarray, weights: np.ndarray, documents: int, length: int) -> DataFrame:
    """The vector of every document that has a term of positive weight, and its signature.
    ``order``: new number of each term, from rare to frequent; ``weights`` by new number."""
    fixed = counted.sparkSession.sparkContext.broadcast((order, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, weights = fixed.value
        planes = np.random.default_rng(0).choice(np.array([-1, 1], np.float32), (max(1, len(weights)), PLANES))
        for batch in batches:
            terms, first = flat(batch.column("terms"))
            tfs, _ = flat(batch.column("tfs"))
            m = np.array([25 + 75 * n * documents // length for n in batch.column("n").to_pylist()], np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
            number = order[terms]
            value = weights[number] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[owner]))
            keep = np.flatnonzero(value > 0)
            keep = keep[np.lexsort((number[keep], owner[keep]))]
            number, value, owner = number[keep], value[keep], owner[keep]
            rows, size = np.unique(owner, return_counts=True)
            if not rows.size:
                continue
            first = np.concatenate([[0], np.cumsum(size)])
            side = np.add.reduceat(planes[number] * value[:, None].astype(np.float32), first[:-1], axis=0) > 0
            signature = side @ (1 << np.arange(PLANES)[::-1])
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(at), batch.column("doc_id").take(at), pa.array(signature, pa.int32()),
                 lists(number, first, pa.int32()), lists(value, first, pa.int64())],
                ["row", "doc_id", "signature", "terms", "coordinates"])

    return counted.filter(F.size("terms") > 0).mapInArrow(run, VECTORS)


class Segment(NamedTuple):
    """Documents i, in the order of their groups, have entries ``[doc_first[i]:doc_first[i + 1]]``;
    block b of term ``block_term[b]`` has members ``[block_first[b]:block_first[b + 1]]`` and a
    summary ``[summary_first[b]:summary_first[b + 1]]`` (none for a list of up to SHORT_LIST)."""
    doc_ids: pa.Array
    doc_first: np.ndarray
    doc_terms: np.ndarray
    doc_values: np.ndarray
    block_term: np.ndarray
    block_first: np.ndarray
    members: np.ndarray
    summary_first: np.ndarray
    summary_terms: np.ndarray
    summary_values: np.ndarray


def grouped(first: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each document, that of the pivot with the largest cosine, and an order of the
    documents in which groups follow the order of their pivots."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    norm = np.sqrt(np.add.reduceat(values.astype(np.float64) ** 2, first[:-1]))
    unit = (values / norm[owner]).astype(np.float32)
    pivots = np.unique(np.linspace(0, n - 1, min(PIVOTS, n)).astype(np.int64))
    table = np.zeros((width, len(pivots)), np.float32)
    for k, p in enumerate(pivots.tolist()):
        table[terms[first[p]:first[p + 1]], k] = unit[first[p]:first[p + 1]]
    like = np.add.reduceat(table[terms] * unit[:, None], first[:-1], axis=0)
    group = like.argmax(axis=1)
    return group, np.lexsort((np.arange(n), -like.max(axis=1), group))


def build_segment(doc_ids: pa.Array, first: np.ndarray, terms: np.ndarray, values: np.ndarray) -> Segment:
    width = int(terms.max()) + 1
    group, order = grouped(first, terms, values, width)
    at, begin = pieces(first, order)
    doc_first, terms, values, group = np.append(begin, len(terms)), terms[at], values[at], group[order]
    owner = np.repeat(np.arange(len(order)), np.diff(doc_first))
    # postings by term, in the order of the groups
    by_term = np.argsort(terms, kind="stable")
    term, doc = terms[by_term], owner[by_term]
    place = np.arange(len(term))
    new_list = np.append(True, term[1:] != term[:-1])
    new_group = new_list | np.append(True, group[doc][1:] != group[doc][:-1])
    list_start = np.maximum.accumulate(np.where(new_list, place, 0))
    group_start = np.maximum.accumulate(np.where(new_group, place, 0))
    # small groups share a block, large ones are cut
    shared, cut = (group_start - list_start) // BLOCK_DOCS, (place - group_start) // BLOCK_DOCS
    new_block = new_list | np.append(True, (shared[1:] != shared[:-1]) | (cut[1:] != cut[:-1]))
    starts = np.flatnonzero(new_block)
    block_first = np.append(starts, len(term))
    list_size = np.diff(np.append(np.flatnonzero(new_list), len(term)))
    long_list = np.repeat(list_size > SHORT_LIST, list_size)[starts]
    # an entry of a summary: from the posting's own place to the end of its document
    block = np.cumsum(new_block) - 1
    entries = np.where(long_list[block], doc_first[doc + 1] - by_term, 0)
    total = np.concatenate([[0], np.cumsum(entries)])
    per_block = total[block_first]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    b, blocks, step = 0, len(starts), max(1, TABLE // width)
    while b < blocks:
        e = max(b + 1, min(b + step, int(np.searchsorted(per_block, per_block[b] + ENTRIES, "right")) - 1))
        p, q = block_first[b], block_first[e]
        size = entries[p:q]
        where = np.arange(size.sum()) + np.repeat(by_term[p:q] - (np.cumsum(size) - size), size)
        table = np.zeros((e - b) * width, np.int64)
        np.maximum.at(table, np.repeat(block[p:q] - b, size) * width + terms[where], values[where])
        key = np.flatnonzero(table)
        found.append((key // width + b, key % width, table[key]))
        b = e
    of_block, summary_terms, summary_values = map(np.concatenate, zip(*found, strict=True))
    summary_first = np.searchsorted(of_block, np.arange(blocks + 1))
    return Segment(doc_ids.take(pa.array(order)), doc_first, terms, values, term[starts], block_first, doc, summary_first,
                   summary_terms, summary_values)


def build_index(vectors_: DataFrame) -> DataFrame:
    """One row per segment of like documents (see ``Segment``), written to the shared folder."""
    spark = vectors_.sparkSession
    rows = vectors_.count()
    parts = min(-(-rows // SEGMENT_DOCS), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_DOCS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def segment(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            terms, first = flat(whole.column("terms"))
            built = build_segment(whole.column("doc_id"), first, terms.astype(np.int64), flat(whole.column("coordinates"))[0])
            ids = pa.ListArray.from_arrays(pa.array([0, len(built.doc_ids)], pa.int32()), built.doc_ids)
            rest = [pa.array([getattr(built, c).astype(kind).tobytes()], pa.binary()) for c, kind in LAYOUT.items()]
            return pa.RecordBatch.from_arrays([ids, *rest], ["doc_ids", *LAYOUT])

        held: list[pa.RecordBatch] = []
        docs = postings = 0
        for batch in batches:
            ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                done = ends[start - 1] if start else 0
                fits = int(np.searchsorted(ends, done + SEGMENT_POSTINGS - postings, "right"))
                stop = min(batch.num_rows, start + SEGMENT_DOCS - docs, fits)
                if stop > start or not held:
                    stop = max(stop, start + 1)
                    held.append(batch.slice(start, stop - start))
                    docs, postings = docs + stop - start, postings + int(ends[stop - 1] - done)
                    start = stop
                if start < batch.num_rows:  # full
                    yield segment(held)
                    held, docs, postings = [], 0, 0
        if held:
            yield segment(held)

    near = vectors_.repartitionByRange(max(1, parts), "signature", "row").sortWithinPartitions("signature", "row")
    return staged(near.select("doc_id", "terms", "coordinates").mapInArrow(run, SEGMENT), "segments")


# ---- searching -----------------------------------------------------------------------
def read_segments(batch: pa.RecordBatch) -> Iterator[Segment]:
    for i in range(batch.num_rows):
        yield Segment(batch.column("doc_ids")[i].values,
                      *(np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in LAYOUT.items()))


def bounds(seg: Segment, ask: Questions) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Term, its first block, the questions with that term, and the bound of each of its blocks for
    each of them; blocks without summary have the bound infinity."""
    new = np.flatnonzero(np.append(True, seg.block_term[1:] != seg.block_term[:-1]))
    for b, e in zip(new.tolist(), [*new[1:].tolist(), len(seg.block_term)], strict=True):
        t = int(seg.block_term[b])
        if (asked := ask.of.get(t)) is None:
            continue
        p, q = seg.summary_first[b], seg.summary_first[e]
        if p == q:
            yield t, b, asked, np.full((len(asked), e - b), np.inf)
            continue
        owner = np.repeat(np.arange(e - b), np.diff(seg.summary_first[b:e + 1]))
        width = int(seg.summary_terms[p:q].max()) - t + 1
        table = np.zeros((width, e - b))
        table[seg.summary_terms[p:q] - t, owner] = seg.summary_values[p:q]
        out = np.empty((len(asked), e - b))
        for k, i in enumerate(asked.tolist()):
            terms, often = ask.terms[ask.first[i]:ask.first[i + 1]], ask.often[ask.first[i]:ask.first[i + 1]]
            within = slice(*np.searchsorted(terms, (t, t + width)))
            out[k] = often[within] @ table[terms[within] - t]
        yield t, b, asked, out


def scores(seg: Segment, ask: Questions, item: int, docs: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Of some documents; ``often`` is a table of zeros, by term."""
    terms = ask.terms[ask.first[item]:ask.first[item + 1]]
    often[terms] = ask.often[ask.first[item]:ask.first[item + 1]]
    at, begin = pieces(seg.doc_first, docs)
    out = np.add.reduceat(seg.doc_values[at] * often[seg.doc_terms[at]], begin)
    often[terms] = 0
    return out


def best(seg: Segment, item: int, docs: np.ndarray, score: np.ndarray, k: int, least: int) -> list[tuple]:
    """The ``k`` best of some documents, from ``least`` on: by score, then id, those without first."""
    keep = np.flatnonzero(score >= max(1, least))
    if len(keep) > k:
        keep = keep[score[keep] >= np.partition(score[keep], -k)[-k]]
    rows = [(item, seg.doc_ids[int(docs[i])].as_py(), int(score[i])) for i in keep]
    return sorted(rows, key=lambda r: (-r[2], r[1] is not None, r[1] or 0))[:k]


def search_segments(index: DataFrame, ask: Questions, k: int, width: int, limits: np.ndarray | None) -> DataFrame:
    """The best of each segment. Without ``limits``: of the blocks with the largest bounds of each
    question, as many as hold ``k`` documents; with them: of all blocks whose bound is not below."""
    shared = index.sparkSession.sparkContext.broadcast((ask, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, limits = shared.value
        often = np.zeros(width, np.int64)
        for seg in (s for batch in batches for s in read_segments(batch)):
            chosen: dict[int, list[tuple[float, int]]] = {}
            for _, b, asked, bound in bounds(seg, ask):
                least = np.zeros(len(asked)) if limits is None else limits[asked]
                read = (bound >= least[:, None]) & (bound > 0)
                for i, j in zip(*np.nonzero(read), strict=True):
                    chosen.setdefault(int(asked[i]), []).append((float(bound[i, j]), b + int(j)))
            rows: list[tuple] = []
            for item, blocks in chosen.items():
                if limits is None:
                    # by bound; short lists, whose bound is unknown, last
                    blocks.sort(key=lambda x: (math.isinf(x[0]), -x[0]))
                    held, kept = 0, []
                    for _, b in blocks:
                        if held >= k:
                            break
                        held += int(seg.block_first[b + 1] - seg.block_first[b])
                        kept.append(b)
                else:
                    kept = [b for _, b in blocks]
                docs = np.unique(seg.members[pieces(seg.block_first, np.array(kept))[0]])
                rows += best(seg, item, docs, scores(seg, ask, item, docs, often), k, 0 if limits is None else int(limits[item]))
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)],
                                             ["item", "doc_id", "score"])

    return index.mapInArrow(run, FOUND)


def blocks_read(index: DataFrame, ask: Questions, limits: np.ndarray) -> DataFrame:
    """``postings, read``: of each segment, the postings of all lists that questions ask for, each
    counted once per question, and of those the ones in blocks that are not skipped."""
    shared = index.sparkSession.sparkContext.broadcast((ask, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, limits = shared.value
        for seg in (s for batch in batches for s in read_segments(batch)):
            size, total, read = np.diff(seg.block_first), 0, 0
            for _, b, asked, bound in bounds(seg, ask):
                own = size[b:b + bound.shape[1]]
                total += int(own.sum()) * len(asked)
                read += int(((bound >= limits[asked][:, None]) @ own).sum())
            yield pa.RecordBatch.from_pydict({"postings": [total], "read": [read]})

    return index.mapInArrow(run, "postings long, read long")


def k_best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Index(NamedTuple):
    """``segments``, and the terms they know: number of each (from rare to frequent)."""
    segments: DataFrame
    terms: dict[str, int]


def index_documents(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> Index | None:
    """Index every row of ``docs`` over ``terms``; None if no document has a term."""
    counted = staged(counted_terms(docs, {t: i for i, t in enumerate(terms)}, id_col, text_col), "counted")
    documents, length = counted.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    # one row per term asked for
    df = {r["term"]: r["n"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term")
          .agg(F.count(F.lit(1)).alias("n")).collect()}
    if not df:
        return None
    ordered = sorted(range(len(terms)), key=lambda t: (df.get(t, 0), terms[t]))
    order = np.empty(len(terms), np.int64)
    order[ordered] = np.arange(len(terms))
    weights = np.array([weight(documents, df.get(t, 0)) for t in ordered], np.int64)
    segments = build_index(staged(vectors(counted, order, weights, documents, length), "vectors"))
    return Index(segments, {terms[t]: i for i, t in enumerate(ordered)})


def numbered(pairs: list[tuple[int, str, int]], items: int, index: Index) -> Questions:
    """(question, term, how often) rows as ``Questions``."""
    rows = sorted((item, index.terms[term], often) for item, term, often in pairs)
    item, terms, often = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    by_term = np.argsort(terms, kind="stable")
    at, first = np.unique(terms[by_term], return_index=True)
    of = dict(zip(at.tolist(), np.split(item[by_term], first[1:]), strict=True))
    return Questions(np.searchsorted(item, np.arange(items + 1)), terms, often, of)


def limits_of(index: Index, ask: Questions, items: int, k: int) -> np.ndarray:
    """Of each question, the k-th best score of the documents in its most promising blocks, 0 if
    there are fewer; no document below it is among the k best of all."""
    first = k_best(search_segments(index.segments, ask, k, len(index.terms), None), k)
    limits = np.zeros(items)
    for r in first.filter(F.col("rank") == k).collect():  # one row per question
        limits[r["item"]] = r["score"]
    return limits


def rank_documents(docs: DataFrame, questions: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", question_terms_at_once: int = QUESTION_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``questions`` the ``k`` documents with the
    highest scores above 0, equal ones by ascending id."""
    spark = docs.sparkSession
    asked = staged(questions.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("long").alias("item_id"),
                                    F.col(item_text_col).alias("text")), "questions")
    pairs = staged(question_terms(asked, "text"), "question-terms")
    blocks = max(1, -(-pairs.count() // question_terms_at_once))
    out = None
    for block in range(blocks):
        rows = pairs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()  # QUESTION_TERMS on average
        items = sorted({r["item"] for r in rows})
        place = {item: i for i, item in enumerate(items)}
        index = index_documents(docs, sorted({r["term"] for r in rows}), id_col, text_col) if rows else None
        if index is None:
            continue
        ask = numbered([(place[r["item"]], r["term"], r["often"]) for r in rows], len(items), index)
        limits = limits_of(index, ask, len(items), k)
        found = k_best(search_segments(index.segments, ask, k, len(index.terms), limits), k)
        names = spark.createDataFrame([(i, item) for item, i in place.items()], "item int, row long")
        found = found.join(F.broadcast(names), "item").select("row", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    # the questions' own ids, which may repeat or be NULL
    return out.join(asked.select(F.col("item").alias("row"), "item_id"), "row").select("item_id", "rank", "doc_id", "score")
