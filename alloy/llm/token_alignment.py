"""Alignment of two tokenizers by galloping intersection of their token ends.

Tokenizer A (byte-level BPE) reads space + text, tokenizer B (sentencepiece BPE) reads the
text and adds the space itself, so the tokens of both spell the same bytes. Each gives the
ascending list of byte offsets where its tokens end. The shorter list drives a galloping
search (exponential steps, then binary search) into the longer one; the common offsets slice
both token lists into groups, and the differences of the ranks found are the ranges of B
tokens that an A token overlaps.

Neither tokenizer lets a token run over a single space between two other characters, so a
text is a sequence of such space-headed parts, each of which is tokenised and aligned in the
same way wherever it stands. The distinct parts of a slice of texts are joined, tokenised in
blocks, and searched in one go; a text with other white space runs is one part.

Counts over the corpus are Spark aggregates: the distinct id pairs of every document, counted
by pair. The ``HOT_PAIRS`` most frequent pairs are broadcast (a fixed bound), so almost all
lookups stay where the document is; documents send their other pairs, if there are any, to a
join by pair.

Defined results: a text that is NULL or empty, or that the two tokenizers do not spell alike
(such as one with U+2581, which B takes for a space), has no tokens: zeros and ''; equal rows
are documents of their own and count once each; rows without id are aligned and counted as
others and keep their NULL; of pairs with equal counts all are best; special tokens' strings
are plain text; very long texts go alone, whole; columns other than id and text, whatever
their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloy.llm.bpe_automaton import IRREGULAR, byte_letters
from alloy.llm.common import coded, staged, text_or_empty, text_slices, worker_cached

#: most pairs that are broadcast
HOT_PAIRS = 1 << 20
#: bytes of text that a task aligns at a time
ALIGNED_BYTES = 2 << 20
#: characters that a tokenizer is given at a time
BLOCK_CHARS = 1 << 16
#: characters that every version of Unicode tables takes alike
PLAIN = re.compile("[\t\n\r -~¡-ſ]*")
#: parts of such characters that neither begin nor end with white space
JOINS = re.compile("[!-~¡-ſ](?:[\t\n\r -~¡-ſ]*[!-~¡-ſ])?")
PLAIN_COLUMNS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
ALIGNED = PLAIN_COLUMNS + ", pairs array<long>, times array<int>"


# ---- searching -----------------------------------------------------------------------
def gallop(short: np.ndarray, long: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each value of ``short``, the first place in ``long[start:stop]`` (ascending) whose
    value is not smaller, ``stop`` if none: steps that double, from ``start`` on, bracket it, a
    binary search ends it. All values are searched side by side."""
    low, step = start.copy(), np.ones_like(start)
    active = np.flatnonzero(low < stop)
    high = stop.copy()
    while active.size:
        probe = np.minimum(low[active] + step[active], stop[active]) - 1
        below = long[probe] < short[active]
        low[active[below]] = probe[below] + 1
        step[active] *= 2
        high[active[~below]] = probe[~below]
        active = active[below]
        active = active[low[active] < stop[active]]
    active = np.flatnonzero(low < high)
    while active.size:
        middle = (low[active] + high[active]) >> 1
        below = long[middle] < short[active]
        low[active[below]] = middle[below] + 1
        high[active[~below]] = middle[~below]
        active = active[low[active] < high[active]]
    return low


class Ends(NamedTuple):
    """Token ids of texts and where they end, text by text: those of text i are
    ``[first[i]:first[i + 1]]``; ends are bytes from the beginning of the text."""
    ids: np.ndarray
    ends: np.ndarray
    first: np.ndarray


class Alignment(NamedTuple):
    """``common``: (place in A, place in B) of tokens with equal ends; ``links``: (place in A,
    place in B) of all overlapping tokens, by A place."""
    common: tuple[np.ndarray, np.ndarray]
    links: tuple[np.ndarray, np.ndarray]


def align(a: Ends, b: Ends) -> Alignment:
    """Of texts that both spell alike. In each text the shorter list drives the search; where
    a search of its value ended is where the next one starts from."""
    n = len(a.first) - 1
    size_a, size_b = np.diff(a.first), np.diff(b.first)
    text_a, text_b = np.repeat(np.arange(n), size_a), np.repeat(np.arange(n), size_b)
    a_drives = size_a <= size_b
    rank_a = np.empty(len(a.ids), np.int64)  # first B token that ends at or after the end of the A token
    from_a = a_drives[text_a]
    rank_a[from_a] = gallop(a.ends[from_a], b.ends, b.first[text_a[from_a]], b.first[text_a[from_a] + 1])
    from_a_of_b = a_drives[text_b]
    driven = ~from_a_of_b
    place = gallop(b.ends[driven], a.ends, a.first[text_b[driven]], a.first[text_b[driven] + 1])
    # where B drives, an A token's rank is the number of B ends below its own
    upto = np.cumsum(np.bincount(place, minlength=len(a.ids)))
    met = np.bincount(place[a.ends[place] == b.ends[driven]], minlength=len(a.ids))
    rank_b = b.first[text_a] + upto - np.concatenate([[0], upto])[a.first[:-1]][text_a] - met
    rank_a[~from_a] = rank_b[~from_a]
    hit = b.ends[rank_a] == a.ends
    common = np.flatnonzero(hit)
    # an A token overlaps the B tokens from the one after the last end at or before its own beginning
    # up to the first that ends at or after its end
    start = np.empty(len(a.ids), np.int64)
    start[1:] = (rank_a + hit)[:-1]
    start[a.first[:-1][size_a > 0]] = b.first[:-1][size_a > 0]
    count = rank_a - start + 1
    link_a = np.repeat(np.arange(len(a.ids)), count)
    offset = np.cumsum(count) - count
    link_b = np.arange(len(link_a)) - np.repeat(offset - start, count)
    return Alignment((common, rank_a[common]), (link_a, link_b))


# ---- tokenising ----------------------------------------------------------------------
class Tokenizers:
    """Both vocabularies, with the byte length and the bytes of every entry."""

    def __init__(self, a_vocabulary: str, a_ranks: str, b_model: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_vocabulary)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(a_ranks, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.quick = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        letters = byte_letters()
        a_bytes = {i: bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode()
                   for t, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = {i: bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in enumerate(pieces)}
        #: whether B never runs over a single space
        self.cuttable = not any("▁" in p[1:] and p.strip("▁") for p in pieces)
        self.b_size = len(pieces)
        self.a_text, self.b_text = self.table(a_bytes), self.table(b_bytes)
        self.a_length, self.b_length = (np.array([len(x) for x in t], np.int64) for t in (self.a_text, self.b_text))

    @staticmethod
    def table(entries: dict[int, bytes]) -> np.ndarray:
        out = np.full(max(entries) + 1, b"", object)
        for i, x in entries.items():
            out[i] = x
        return out

    def a_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of space + text; plain ones by the quicker library, whose tables may be newer."""
        out: list[Any] = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if PLAIN.fullmatch(t):
                out[i] = self.quick.encode_to_numpy(" " + t).astype(np.int64)
            else:
                rest.append(i)
        found = self.a.encode_batch([" " + texts[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, found, strict=True):
            out[i] = np.array(e.ids, np.int64)
        return out

    def b_ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]

    def both(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B for each text, None where they do not both spell space + text."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, a, b in zip(texts, self.a_ids(texts), self.b_ids(texts), strict=True):
            raw = (" " + text).encode()
            alike = text and b"".join(self.a_text[a].tolist()) == raw and b"".join(self.b_text[b].tolist()) == raw
            out.append((a, b) if alike else None)
        return out

    def parts(self, parts: list[str]) -> tuple[Ends, Ends, np.ndarray]:
        """Ends of both in each part, and which parts both spell as space + part; others, and
        the empty one, have no tokens. Parts that JOINS matches are joined to blocks, which are
        cut again at the bytes where parts begin."""
        blocks: list[tuple[int, int]] = []
        start = chars = 0
        joins = [JOINS.fullmatch(p) is not None for p in parts] + [False]
        for i, p in enumerate(parts):
            chars += len(p) + 1
            if chars >= BLOCK_CHARS or not (joins[i] and joins[i + 1]):
                blocks.append((start, i + 1))
                start, chars = i + 1, 0
        ids = self.both([" ".join(parts[s:e]) for s, e in blocks])
        if any(found is None and e - s > 1 for (s, e), found in zip(blocks, ids, strict=True)):
            # some part of a block is not spelled alike: find out which
            again = [(i, i + 1) for (s, e), found in zip(blocks, ids, strict=True) if found is None for i in range(s, e)]
            kept = [(block, found) for block, found in zip(blocks, ids, strict=True) if found is not None]
            merged = sorted([*kept, *zip(again, self.both([parts[i] for i, _ in again]), strict=True)], key=lambda x: x[0])
            blocks, ids = [b for b, _ in merged], [found for _, found in merged]
        good = np.zeros(len(parts), bool)
        for (s, e), found in zip(blocks, ids, strict=True):
            good[s:e] = found is not None
        # bytes before each part, of good parts only, as the tokens are those of good blocks
        size = np.array([len(p.encode()) + 1 for p in parts], np.int64)
        before = np.concatenate([[0], np.cumsum(np.where(good, size, 0))])
        sides = []
        for side, length in enumerate((self.a_length, self.b_length)):
            flat = np.concatenate([found[side] for found in ids if found is not None] or [np.zeros(0, np.int64)])
            ends = np.cumsum(length[flat])
            first = np.searchsorted(ends, before, "right")
            sides.append(Ends(flat, ends - np.repeat(before[:-1], np.diff(first)), first))
        return sides[0], sides[1], good


class Slice:
    """The texts of a slice, cut into parts; the distinct parts aligned."""

    def __init__(self, tok: Tokenizers, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        odd = pc.or_(pc.match_substring_regex(texts, IRREGULAR), pc.equal(pc.binary_length(texts), 0))
        whole = odd.to_numpy(zero_copy_only=False) | (not tok.cuttable)
        words = coded(self.cut(texts, whole), drop_empty=False)
        distinct = words.distinct.tolist()
        # those that can be joined first, so that blocks are long
        order = sorted(range(len(distinct)), key=lambda i: JOINS.fullmatch(distinct[i]) is None)
        place = np.empty(len(distinct), np.int64)
        place[order] = np.arange(len(distinct))
        self.codes, self.ends = place[words.codes], words.ends
        self.a, self.b, self.good = tok.parts([distinct[i] for i in order])
        found = align(self.a, self.b)
        self.common = found.common
        self.pair = self.a.ids[found.links[0]] * tok.b_size + self.b.ids[found.links[1]]
        self.first_link = np.searchsorted(found.links[0], self.a.first)
        self.first_group = np.searchsorted(found.common[0], self.a.first)

    @staticmethod
    def cut(texts: pa.Array, whole: np.ndarray) -> pa.Array:
        """Each text's parts: some texts are one part, others are cut at single spaces."""
        lists = pc.split_pattern(texts, " ")
        if not whole.any():
            return lists
        count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pa.concat_arrays([lists.flatten(), texts])
        # a whole text stands behind the parts of all others
        take = np.where(np.repeat(whole, count), -1, np.arange(count.sum()))
        first = (np.cumsum(count) - count)[whole]
        take[first] = count.sum() + np.flatnonzero(whole)
        offsets = np.concatenate([[0], np.cumsum(np.where(whole, 1, count))])
        return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), flat.take(pa.array(take[take >= 0])))

    def groups(self) -> np.ndarray:
        """The groups of each part, written out."""
        ca, cb, first = self.common[0].tolist(), self.common[1].tolist(), self.first_group.tolist()
        ids_a, ids_b = (list(map(str, x.ids.tolist())) for x in (self.a, self.b))
        out = np.full(len(self.good), "", object)
        at_a, at_b = self.a.first.tolist(), self.b.first.tolist()
        for i in np.flatnonzero(self.good).tolist():
            p, q = at_a[i], at_b[i]
            line = []
            for k in range(first[i], first[i + 1]):
                x, y = ca[k] + 1, cb[k] + 1
                line.append(",".join(ids_a[p:x]) + "|" + ",".join(ids_b[q:y]))
                p, q = x, y
            out[i] = ";".join(line)
        return out

    def documents(self) -> Iterator[tuple]:
        """``n_a, n_b, n_groups, n_links, groups text or None, pairs, times`` of each text."""
        per_part = [np.diff(x) for x in (self.a.first, self.b.first, self.first_group, self.first_link)]
        written = self.groups()
        start = 0
        for end in self.ends.tolist():
            codes = self.codes[start:end]
            start = end
            if not self.good[codes].all():
                yield 0, 0, 0, 0, None, np.zeros(0, np.int64), np.zeros(0, np.int32)
                continue
            own, often = np.unique(codes, return_counts=True)
            size = per_part[3][own]
            at = np.repeat(self.first_link[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            pair, back = np.unique(self.pair[at], return_inverse=True)
            times = np.bincount(back, np.repeat(often, size), len(pair))
            yield (*(int((n[own] * often).sum()) for n in per_part), ";".join(written[codes].tolist()), pair, times.astype(np.int32))


# ---- the operator --------------------------------------------------------------------
def align_documents(df: DataFrame, a_vocabulary: str, a_ranks: str, b_model: str, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per document (and ``row``, a number of its own): tokens, groups and links, the digest of its
    groups, and its distinct id pairs (A id * size of B + B id) with how often each is linked.
    ``a_ranks`` holds the vocabulary of A as byte ranks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_cached(f"aligned {a_vocabulary} {b_model}", lambda: Tokenizers(a_vocabulary, a_ranks, b_model))
        for batch in (part for whole in batches for part in text_slices(whole, text=2, size=ALIGNED_BYTES)):
            rows = list(Slice(tok, batch.column(2)).documents())
            digests = ["" if r[4] is None else hashlib.sha256(r[4].encode()).hexdigest() for r in rows]
            offsets = pa.array(np.cumsum([0, *(len(r[5]) for r in rows)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[k] for r in rows]), kind))
                     for k, kind in ((5, pa.int64()), (6, pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)),
                 pa.array(digests, pa.string()), *lists],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                     text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """``pair, n, best``: in how many documents each id pair is linked, and whether no pair of
    its A id is in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = staged(counts.withColumn("a", F.floor(F.col("pair") / b_size)), "pair-counts")
    # one row per entry of A's vocabulary
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``aligned`` (a staged table) without its lists, with ``n_best`` and ``count_sum``."""
    counts = staged(counts.withColumn("size", F.length(F.bin("n"))), "pair-counts-best")
    # pairs by the number of binary digits of their counts: 64 rows at most
    least, hot_size = 65, 0
    for size, number in sorted(((r["size"], r["count"]) for r in counts.groupBy("size").count().collect()), reverse=True):
        if hot_size + number > hot_pairs:
            break
        least, hot_size = size, hot_size + number
    hot = counts.filter(F.col("size") >= least).toArrow()
    order = np.argsort(hot["pair"].to_numpy(), kind="stable")
    table = aligned.sparkSession.sparkContext.broadcast(tuple(hot[c].to_numpy()[order] for c in ("pair", "n", "best")))
    outside = counts.filter(F.col("size") < least).limit(1).count() > 0

    plain = [c.split()[0] for c in PLAIN_COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = table.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy(zero_copy_only=False)
            own = lists.flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            at = np.searchsorted(pairs, own)
            known = at < len(pairs)
            known[known] = pairs[at[known]] == own[known]
            here, owner = at[known], np.repeat(np.arange(len(lists)), np.diff(first))[known]
            sums = [np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)]
            np.add.at(sums[0], owner, times[known] * best[here].astype(np.int64))
            np.add.at(sums[1], owner, times[known] * n[here])
            cold = np.flatnonzero(~known)
            offsets = pa.array(np.searchsorted(cold, first), pa.int32())
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[cold])) for x in (own, times)]
            yield pa.RecordBatch.from_arrays([*batch.select(plain).columns, *map(pa.array, sums), *rest],
                                             [*plain, "n_best", "count_sum", "cold", "times"])

    summed = aligned.mapInArrow(run, f"{PLAIN_COLUMNS}, n_best long, count_sum long, cold array<long>, times array<int>")
    if not outside:
        return summed.drop("cold", "times")
    summed = staged(summed, "aligned-hot")
    cold = summed.select("row", F.explode(F.arrays_zip(F.col("cold").alias("pair"), F.col("times").alias("times"))).alias("x")).select("row", "x.*")
    more = cold.join(counts, "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"))
    return summed.drop("cold", "times").join(more, "row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
        "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}).drop("more", "more_best")


def alignment_digests(df: DataFrame, a_vocabulary: str, a_ranks: str, b_model: str, id_col: str = "doc_id",
                      text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    import sentencepiece
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_model).get_piece_size()
    aligned = staged(align_documents(df, a_vocabulary, a_ranks, b_model, id_col, text_col), "aligned")
    return with_counts(aligned, pair_counts(aligned, b_size), hot_pairs).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
