"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A document's ids come from the tokenizers library. Lower-casing, normalisation and word
splitting never cross ASCII white space, so the ids of a text are the ids of its
white-space-separated chunks in order; a task keeps the ids of chunks it has seen in a
bounded table. Packing places the pieces of one shard, longest first; each goes where the
sum over residual gaps of (number of open bins with that gap) squared becomes smallest.
Shards hold ``SHARD_PIECES`` pieces on average whatever the input size; the bins that stay
less than ``GOOD_FILL`` full are taken apart and packed again across shards.

Defined results: NULL text is empty, an empty document is the one closing id; rows without
id are packed like others; repeated rows are packed once each, dealt to all shards; of choices
with equal sums the open bin with the smallest gap is taken, an open bin before a new one, and
of the bins of one gap the last; an empty table gives no rows; columns of the input other than
id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloy.llm.bpe_automaton import byte_letters
from alloy.llm.common import space_words, staged, text_or_empty, text_slices, worker_cached

CAPACITY = 2048
SHARD_PIECES = 10_000
GOOD_FILL = 0.98
#: chunks that a task remembers
CACHE_WORDS = 250_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, fill long"


class ChunkIds(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, vocabulary: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.normalizer, self.splitter = (self.tokenizer.model, self.tokenizer.normalizer,
                                                      self.tokenizer.pre_tokenizer)
        self.special = list(self.tokenizer.get_added_tokens_decoder().values())
        # visible ASCII and the letters of Latin-1 and Latin Extended-A, but for the one that
        # two characters stand for in lower case
        self.latin = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
        self.words = re.compile("[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        self.pieces: dict[str, bytes] = {}

    def forget(self) -> None:
        self.clear()
        self.pieces.clear()

    def piece(self, piece: str) -> bytes:
        """Ids of one word of the splitter, in the letters of byte-level vocabularies."""
        ids = self.pieces.get(piece)
        if ids is None:
            found = [t.id for t in self.model.tokenize(piece)]
            if len(self.pieces) >= CACHE_WORDS:
                self.pieces.clear()
            ids = self.pieces[piece] = pack(f"<{len(found)}I", *found)
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():  # one word, which normalising only lower-cases
            ids = self.piece(chunk.lower())
        elif self.latin.fullmatch(chunk) and "'" not in chunk and "<|" not in chunk:
            # normalising only lower-cases; runs of letters, digits, and runs of the rest are words
            words = self.words.findall(chunk.lower())
            if not chunk.isascii():
                words = [w.encode().decode("latin-1").translate(self.letters) for w in words]
            ids = b"".join(map(self.piece, words))
        elif any(t.content in chunk for t in self.special):
            found = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            ids = pack(f"<{len(found)}I", *found)
        else:
            split = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))
            ids = b"".join(self.piece(p) for p, _ in split)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[chunk] = ids
        return ids

    def documents(self, texts: pa.Array, closing: int) -> Iterator[bytes]:
        """The ids of each text and the closing id."""
        words = space_words(texts)
        ids = np.empty(len(words.distinct), object)
        ids[:] = list(map(self.__getitem__, words.distinct.tolist()))
        start, last = 0, closing.to_bytes(4, "little")
        for end in words.ends.tolist():
            yield b"".join(ids[words.codes[start:end]].tolist()) + last
            start = end


def cut_pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
               capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """One row per piece: documents of more than ``capacity`` ids are cut, others stay whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = worker_cached(f"chunk ids {vocabulary}", lambda: ChunkIds(vocabulary))
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                            ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in (part for whole in batches for part in text_slices(whole)):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), chunks.documents(batch.column(1), closing), strict=True):
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    end = min(n, start + capacity)
                    rows.append((doc, piece, start, end - start, zlib.crc32(ids[4 * start:4 * end])))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)],
                                             schema=schema)
        chunks.forget()  # idle workers hold no more than the vocabulary

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final level of the bin for each piece, longest pieces placed first."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins = np.zeros(capacity + 1, np.int64)  # by residual gap
    at_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    level: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        gap = capacity  # a new bin, unless an open one is better
        held = open_bins[size:capacity]
        if held.any():
            # growth of the sum of squares by moving a bin from one gap to the next
            growth = 2 * (open_bins[:capacity - size] - held) + 2
            if size:
                growth[0] = 1 - 2 * held[0]  # filling a bin up leaves no gap to count
            growth[held == 0] = np.iinfo(np.int64).max
            best = int(growth.argmin())
            if growth[best] <= (2 * open_bins[capacity - size] + 1 if size < capacity else 0):
                gap = best + size
        if gap == capacity:
            bin_ = len(level)
            level.append(0)
        else:
            bin_ = at_gap[gap].pop()
            open_bins[gap] -= 1
        bins[i], offsets[i] = bin_, level[bin_]
        level[bin_] += size
        left = capacity - level[bin_]
        if left:
            open_bins[left] += 1
            at_gap[left].append(bin_)
    return bins, offsets, np.asarray(level, np.int64)[bins] if len(lengths) else bins


def pack_shards(pieces: DataFrame, capacity: int, round_: int) -> DataFrame:
    """Pack ``pieces`` (a staged table) shard by shard; ``fill`` is the bin's final level."""
    shards = max(1, -(-pieces.count() // SHARD_PIECES))
    # by place in the staged table, so that equal rows are dealt to all shards
    keyed = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        bins, offsets, fill = sum_of_squares(group["length"].to_numpy(np.int64), capacity)
        shard = int(group["shard"].iloc[0])
        return group.drop(columns="shard").assign(
            sequence_id=bins + (round_ * shards + shard) * (1 << 32) + (round_ << 56), offset=offsets, fill=fill)

    return keyed.groupBy("shard").applyInPandas(run, PACKED)


def pack_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    pieces = staged(cut_pieces(df, vocabulary, id_col, text_col, capacity, closing), "pieces")
    first = staged(pack_shards(pieces, capacity, 0), "packed")
    good = F.col("fill") >= F.lit(int(GOOD_FILL * capacity))
    again = pack_shards(first.filter(~good).select(*pieces.columns), capacity, 1)
    return first.filter(good).unionByName(again).drop("fill")
