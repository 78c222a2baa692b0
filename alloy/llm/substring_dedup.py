"""Substring dedup with a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words of one document. Every window has one minimizer, the
least hash of its ``GRAM``-word runs; equal windows have equal minimizers, so text is dealt to
shards by minimizer and no document has to be streamed against every shard. Only minimizers
that occur in several different documents matter: the runs of windows around them (segments)
go to their shard. There the distinct segments are indexed: suffix order, Burrows-Wheeler
transform, and a wavelet matrix of packed bits with block counts. Segments are then streamed
against the index: backward search gives the matching statistics, and each interval of
``WINDOW`` words or more reports the smallest document id among its suffixes. Words covered by
a window that also starts in a document with a smaller id are removed.

Documents with the same words are one class: its smallest id is searched for, the others have
every window in it. Minimizers with more than ``SHARD_SEGMENTS`` different segments are dealt on
by their single windows, so no shard holds more of them than another.

Words stand for their 64-bit hashes in the index. Defined results: NULL text has no words;
texts under WINDOW words lose nothing; rows without id lose nothing and take nothing from
others; rows that repeat an id are judged each by its own text, and never against each other;
an empty table gives no rows; columns other than id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloy.llm.common import drop_staged, join_hot, run_hashes, space_words, staged, text_or_empty, text_slices, word_hashes

WINDOW = 13
GRAM = 4
#: segments that a shard holds on average
SHARD_SEGMENTS = 20_000
#: order of the suffixes that backward search relies on: more than WINDOW symbols
SUFFIX_DEPTH = 16
NO_DOC = np.iinfo(np.int64).max


# ---- the index -------------------------------------------------------------------
class WaveletMatrix:
    """Rank of a symbol below a position, over bit planes packed in 64-bit words."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.n, self.levels = len(symbols), max(1, int(n_symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        starts, rest, s = np.zeros(n_symbols, np.int64), symbols, np.arange(n_symbols)
        for level in range(self.levels - 1, -1, -1):
            bits = (rest >> level) & 1
            packed = np.packbits(np.pad(bits.astype(np.uint8), (0, 64 + (-self.n) % 64)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(self.n - bits.sum()))
            starts = self._down(len(self.words) - 1, starts, (s >> level) & 1 == 1)
            rest = np.concatenate([rest[bits == 0], rest[bits == 1]])
        self.starts = starts

    def _down(self, k: int, at: np.ndarray, one: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        ones = self.counts[k][word] + np.bitwise_count(below)
        return np.where(one, self.zeros[k] + ones, at - ones)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            at = self._down(k, at, (symbols >> (self.levels - 1 - k)) & 1 == 1)
        return at - self.starts[symbols]


class FmIndex:
    """Index of ``text`` (symbols from 1 on; 0 ends a segment) with a document id by position."""

    def __init__(self, text: np.ndarray, docs: np.ndarray):
        n, n_symbols = len(text), int(text.max(initial=0)) + 1
        rank, depth = text.astype(np.int64), 1
        while depth < SUFFIX_DEPTH:  # doubles the prefix by which suffixes are ordered
            after = np.zeros(n, np.int64)
            after[:n - depth] = rank[depth:] + 1
            _, rank = np.unique(rank * (n + n_symbols + 1) + after, return_inverse=True)
            depth *= 2
        order = np.argsort(rank, kind="stable")
        self.docs = docs[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.bwt = WaveletMatrix(text[order - 1], n_symbols)

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end position in ``text``: length of the longest match that ends there (at
        most ``most``) and its interval of suffixes."""
        symbols = text[ends]
        low, high = self.first[symbols], self.first[symbols + 1]
        length = (high > low).astype(np.int64)
        open_ = np.flatnonzero(high > low)
        for back in range(1, most):
            open_ = open_[ends[open_] >= back]
            symbols = text[ends[open_] - back]
            inside = symbols > 0
            open_, symbols = open_[inside], symbols[inside]
            if not len(open_):
                break
            base = self.first[symbols]
            lo, hi = base + self.bwt.rank(symbols, low[open_]), base + self.bwt.rank(symbols, high[open_])
            found = hi > lo
            open_, lo, hi = open_[found], lo[found], hi[found]
            low[open_], high[open_] = lo, hi
            length[open_] += 1
        return length, low, high

    def least_doc(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest id in each interval; intervals are equal or disjoint."""
        edges, back = np.unique(np.stack([low, high], 1), axis=0, return_inverse=True)
        if not len(edges):
            return np.zeros(0, np.int64)
        least = np.minimum.reduceat(np.append(self.docs, NO_DOC), edges.ravel())[::2]
        return least[back.ravel()]


def first_docs(segments: list[np.ndarray], docs: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each window of each segment the smallest document id that it starts in."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    _, ids = np.unique(np.concatenate(segments), return_inverse=True)
    ends = np.cumsum(sizes + 1)  # a 0 follows each segment
    text = np.zeros(int(ends[-1]), np.int64)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = ids + 1
    index = FmIndex(text, np.repeat(docs, sizes + 1))
    begin = ends - 1 - sizes
    at = np.concatenate([np.arange(b + window - 1, b + n) for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)])
    length, low, high = index.matching_statistics(text, at, window)
    least = np.full(len(at), NO_DOC, np.int64)
    full = length >= window
    least[full] = index.least_doc(low[full], high[full])
    return np.split(least, np.cumsum(sizes - window + 1)[:-1])


# ---- texts as hashed words, minimizers, segments -----------------------------------
def minimizers(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``gram`` words, and for each window start where its minimizer is."""
    grams = run_hashes(hashes, gram)
    n = len(grams) - (window - gram)
    if n <= 0:
        return grams, np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    where = at.copy()
    for j in range(1, window - gram + 1):
        less = grams[j:j + n] < best
        best[less] = grams[j:j + n][less]
        where[less] = at[less] + j
    return grams, where


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = space_words(texts)
    return word_hashes(words.distinct)[words.codes], words.ends


def sequence_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def read_documents(rows: DataFrame) -> DataFrame:
    """Rows of documents (``anchor`` NULL): ``doc_id, key, n_words, full_sha256``; and of
    minimizers: ``doc_id, anchor, pos``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary())
        names = ["doc_id", "anchor", "pos", "key", "n_words", "full_sha256"]
        for batch in (part for whole in batches for part in text_slices(whole)):
            hashes, ends = hashed(batch.column(1))
            grams, where = minimizers(hashes, WINDOW, GRAM)
            keys, shas, sizes, docs, anchors, places = [], [], [], [], [], []
            start = 0
            for doc, text, end in zip(batch.column(0).to_pylist(), batch.column(1), ends.tolist(), strict=True):
                keys.append(sequence_key(hashes[start:end]))
                shas.append(hashlib.sha256(b" ".join(text.as_buffer().to_pybytes().split())).digest())
                sizes.append(end - start)
                own = where[start:max(start, end - WINDOW + 1)]
                if doc is not None and len(own):
                    own = own[np.flatnonzero(np.diff(own, prepend=-1))]
                    docs.append(np.full(len(own), doc, np.int64))
                    anchors.append(grams[own].view(np.int64))
                    places.append((own - start).astype(np.int32))
                start = end
            none = [None] * len(keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, k) for v, k in zip((none, none, keys, sizes, shas), kinds[1:], strict=True))], names)
            if docs:
                n = sum(map(len, docs))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(docs)), pa.array(np.concatenate(anchors)), pa.array(np.concatenate(places)),
                     *(pa.nulls(n, k) for k in kinds[3:])], names)

    return rows.mapInArrow(run, "doc_id long, anchor long, pos int, key binary, n_words long, full_sha256 binary")


def packed(rows: DataFrame) -> DataFrame:
    """``lender, packed``: texts compressed before they move."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in (part for whole in batches for part in text_slices(whole)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([pack.compress(t.as_buffer()) for t in batch.column(1)], pa.binary())],
                ["lender", "packed"])

    return rows.filter("doc_id is not null").mapInArrow(run, "lender long, packed binary")


def unpacked(batch: pa.RecordBatch, column: str) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(x).decode() for x in batch.column(column).to_pylist()], pa.large_string())


def segments(docs: DataFrame) -> DataFrame:
    """``anchor, seg, doc_id, key, start`` of the windows whose minimizer is one of ``places``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, 2)):
            hashes, ends = hashed(unpacked(batch, "packed"))
            anchors, words, sizes, docs, keys, starts = [], [], [], [], [], []
            start = 0
            for doc, key, places, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                             batch.column(3).to_numpy(zero_copy_only=False), ends.tolist(), strict=True):
                own = hashes[start:end]
                start = end
                if sequence_key(own) != key:  # another text under the same id
                    continue
                grams, where = minimizers(own, WINDOW, GRAM)
                first = np.flatnonzero(np.diff(where, prepend=-1))
                size = np.diff(first, append=len(where)) + WINDOW - 1
                chosen = np.isin(where[first], places)
                first, size = first[chosen], size[chosen]
                # the words of all chosen runs, one run after the other
                shift = np.repeat(first - np.cumsum(size) + size, size)
                words.append(own[np.arange(len(shift)) + shift])
                anchors.append(grams[where[first]].view(np.int64))
                sizes.append(size)
                starts.append(first.astype(np.int32))
                docs.append(np.full(len(first), doc, np.int64))
                keys += [key] * len(first)
            if not keys:
                continue
            offsets = np.concatenate([[0], np.cumsum(8 * np.concatenate(sizes))])
            seg = pa.Array.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.concatenate(words))])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors)), seg.cast(pa.binary()), pa.array(np.concatenate(docs)),
                                              pa.array(keys, pa.binary()), pa.array(np.concatenate(starts))],
                                             ["anchor", "seg", "doc_id", "key", "start"])

    return docs.select("doc_id", "key", "packed", "places").mapInArrow(
        run, "anchor long, seg binary, doc_id long, key binary, start int")


def with_id(segments: DataFrame) -> DataFrame:
    return segments.withColumn("seg_id", F.unhex(F.md5("seg")))


def distinct_segments(occurrences: DataFrame) -> DataFrame:
    """``seg_id, first_doc, seg, anchor`` of the different segments."""
    return staged(occurrences.groupBy("seg_id").agg(
        F.min("doc_id").alias("first_doc"), F.first("seg").alias("seg"), F.first("anchor").alias("anchor")), "distinct")


def split_hot(occurrences: DataFrame, hot: DataFrame) -> DataFrame:
    """Segments of the minimizers in ``hot``, which would fill a shard alone, become single
    windows, dealt by their own hash."""
    n = (F.length("seg") / 8 - WINDOW).cast("int")
    single = (occurrences.join(hot, "anchor", "left_semi").withColumn("i", F.explode(F.sequence(F.lit(0), n)))
              .withColumn("seg", F.substring(F.col("seg"), F.col("i") * 8 + 1, F.lit(8 * WINDOW)))
              .select(F.xxhash64("seg").alias("anchor"), "seg", "doc_id", "key", (F.col("start") + F.col("i")).alias("start")))
    rest = occurrences.join(hot, "anchor", "left_anti").select("anchor", "seg", "doc_id", "key", "start")
    return with_id(rest.unionByName(single))


def search_shards(distinct: DataFrame) -> DataFrame:
    """``seg_id, least array<long>``: for each window of a distinct segment the smallest id."""
    shards = max(1, -(-distinct.count() // SHARD_SEGMENTS))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seg_id")
        least = first_docs([np.frombuffer(s, np.uint64) for s in group["seg"]], group["first_doc"].to_numpy(np.int64))
        return pd.DataFrame({"seg_id": group["seg_id"], "least": least})

    by_anchor = F.pmod(F.xxhash64("anchor", F.lit(7)), F.lit(shards)).alias("shard")
    return distinct.select("seg_id", "seg", "first_doc", by_anchor).groupBy("shard").applyInPandas(
        run, "seg_id binary, least array<long>")


def repeated_windows(occurrences: DataFrame) -> DataFrame:
    """``doc_id, marks array<struct<key, starts>>``: starts of the windows to remove."""
    occurrences = staged(with_id(occurrences), "segments")
    distinct = distinct_segments(occurrences)
    sizes = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    hot = staged(sizes.filter(F.col("n") > SHARD_SEGMENTS).select("anchor"), "hot")
    if hot.take(1):
        occurrences = staged(split_hot(occurrences, hot), "segments")
        distinct = distinct_segments(occurrences)
    found = staged(search_shards(distinct), "least")
    own = occurrences.select("seg_id", "doc_id", "key", "start").join(found, "seg_id")
    early = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    hits = own.select("doc_id", "key", early.alias("starts")).filter(F.size("starts") > 0)
    return (hits.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("starts")).alias("starts"))
            .groupBy("doc_id").agg(F.collect_list(F.struct("key", "starts")).alias("marks")))


def cut_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n_removed, kept, kept_sha256`` of documents with their marks; ``kept`` is
    the text of the words that stay, joined by one space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, 2)):
            removed, texts, shas = [], [], []
            plain = unpacked(batch, "packed")
            hashes, ends = hashed(plain)
            start = 0
            for key, text, marks, end in zip(batch.column(1).to_pylist(), plain, batch.column(3).to_pylist(), ends.tolist(), strict=True):
                words = text.as_buffer().to_pybytes().split()
                cover = np.zeros(len(words) + 1, np.int64)
                own = sequence_key(hashes[start:end]) == key  # not another text under the same id
                start = end
                for mark in marks or ():
                    if own and mark["key"] == key:
                        starts = np.array(mark["starts"], np.int64)
                        np.add.at(cover, starts, 1)
                        np.add.at(cover, starts + WINDOW, -1)
                gone = np.cumsum(cover)[:-1] > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                removed.append(int(gone.sum()))
                texts.append(kept.decode())
                shas.append(hashlib.sha256(kept).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), pa.array(shas, pa.binary())],
                ["doc_id", "key", "n_removed", "kept", "kept_sha256"])

    return docs.select("doc_id", "key", "packed", "marks").mapInArrow(
        run, "doc_id long, key binary, n_removed long, kept string, kept_sha256 binary")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of every row; ``kept`` is NULL for
    rows that lose nothing (their words are those of the text)."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    read = staged(read_documents(rows), "anchors")
    docs = read.filter("anchor is null").select("doc_id", "key", "n_words", "full_sha256")
    anchors = read.filter("anchor is not null").select("anchor", "doc_id", "pos")
    # classes of documents with the same words
    classes = docs.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size"))
    docs = join_hot(docs, classes, "key", "size", docs.count())
    docs = staged(docs.withColumn("copy", F.coalesce((F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= WINDOW), F.lit(False))), "docs")
    copies = docs.groupBy("doc_id").agg(F.bool_and("copy").alias("copy")).filter("copy").select("doc_id")

    def shared(a: DataFrame) -> DataFrame:
        several = (a.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"))
                   .filter("x < y").select("anchor"))
        # written first, so that a hot minimizer's rows in the join can be split
        return a.join(staged(several, "several"), "anchor", "left_semi")

    # minimizers in several documents; then, of those, in several classes
    some = staged(shared(anchors), "shared").join(copies, "doc_id", "left_anti")
    drop_staged(read)
    places = (shared(some).groupBy("doc_id").agg(F.collect_set("pos").alias("places"))
              .join(docs.filter("not copy").select("doc_id", "key").distinct(), "doc_id"))
    # one text under an id that has several is found by its key
    lent = packed(rows).join(places, F.col("lender") == F.col("doc_id")).select("doc_id", "key", "packed", "places")
    lent = staged(lent, "lent")
    marks = repeated_windows(segments(lent))
    cut = cut_texts(lent.select("doc_id", "key", "packed").join(marks, "doc_id"))
    # a text of another key under the same id was not looked at
    cut = staged(cut.filter("n_removed > 0").dropDuplicates(["doc_id", "key"]), "cut")
    none = F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))
    out = docs.join(cut.select(F.col("doc_id").alias("cut_id"), F.col("key").alias("cut_key"), "n_removed", "kept", "kept_sha256"),
                    (F.col("doc_id") == F.col("cut_id")) & (F.col("key") == F.col("cut_key")), "left")
    return out.select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(F.col("copy"), none).otherwise(F.coalesce("kept_sha256", "full_sha256")))).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"))
