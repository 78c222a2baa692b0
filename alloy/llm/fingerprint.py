"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes of the UTF-8 text ends a piece wherever its value
is -1 modulo the block size (3 * 2^k, chosen so that a text has some 32 to 64 pieces), so
pieces depend on their surroundings only and an edit changes the pieces it touches. The
fingerprint is ``block size:signature:signature at twice the block size``, one base-64 digit
for each piece. Fingerprints compare at equal or neighbouring block sizes, by edit distance.

Defined results: NULL text is empty; an empty text is ``3::``; rows without id come last in
the order, rows with equal ids by a hash of their text; the only row of a table is its own
next one; an empty table gives no rows; columns other than id and text, whatever their names,
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alloy.llm.common import mixed, staged, text_or_empty, text_slices, worker_cached

# ---- fixed values of the scheme ---------------------------------------------------
WINDOW = 7
LEAST_BLOCK = 3
PIECES = 64
DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
# -----------------------------------------------------------------------------------
ROLL = np.uint32(0x01000193)
PIECE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
#: bytes that are hashed together (a longer text goes alone)
TOGETHER = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Fingerprints of many texts at a time, over one buffer."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def fingerprints(self, texts: list[str]) -> list[str]:
        out: list[str] = []
        some: list[bytes] = []
        size = 0
        for text in texts:
            raw = text.encode("utf-8", "replace")
            if some and size + len(raw) > TOGETHER:
                out += self.together(some)
                some, size = [], 0
            some.append(raw)
            size += len(raw)
        return out + (self.together(some) if some else [])

    def together(self, raws: list[bytes]) -> list[str]:
        # zeros between texts: a window sees nothing of the text before
        data = np.frombuffer(bytes(WINDOW).join(raws), np.uint8)
        n = len(data)
        if len(self.up) <= n:
            size = max(n + 1, TOGETHER + WINDOW * 4096)
            self.up, self.down = powers(PIECE, size), powers(pow(PIECE, -1, 1 << 64), size)
        roll = np.zeros(n, np.uint32)
        weight = np.uint32(1)
        wide = data.astype(np.uint32) + np.uint32(1)
        wide[data == 0] = 0
        with np.errstate(over="ignore"):
            for back in range(WINDOW):
                roll[back:] += wide[:n - back] * weight
                weight *= ROLL
            value = (mixed(roll.astype(np.uint64)) & np.uint64(0xFFFFFFFF)) + np.uint64(1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide.astype(np.uint64) * self.up[:n])])
        ends = np.flatnonzero(value % np.uint64(LEAST_BLOCK) == 0)  # of pieces at the least block size
        value = value[ends]
        low = value & (~value + np.uint64(1))  # block sizes up to 3 * low end a piece here
        out, start = [], 0
        for raw in raws:
            stop = start + len(raw)
            a, b = np.searchsorted(ends, (start, stop))
            out.append(self.one(start, stop, ends[a:b], low[a:b], sums))
            start = stop + WINDOW
        if len(self.up) > 4 * TOGETHER:  # a very long text came by: give the memory back
            self.up = self.down = np.ones(0, np.uint64)
        return out

    def one(self, start: int, stop: int, ends: np.ndarray, low: np.ndarray, sums: np.ndarray) -> str:
        step = 1
        while LEAST_BLOCK * step * PIECES < stop - start:
            step *= 2
        while step > 1 and int((low >= step).sum()) + 1 < PIECES // 2:
            step //= 2
        first = self.signature(start, stop, ends[low >= step], sums, PIECES)
        second = self.signature(start, stop, ends[low >= 2 * step], sums, PIECES // 2)
        return f"{LEAST_BLOCK * step}:{first}:{second}"

    def signature(self, start: int, stop: int, ends: np.ndarray, sums: np.ndarray, most: int) -> str:
        """One digit for each piece; the last one covers all that is left."""
        cuts = ends[:most - 1] + 1
        edges = np.concatenate([[start], cuts, [stop] if not len(cuts) or cuts[-1] < stop else []]).astype(np.int64)
        if stop == start:
            return ""
        with np.errstate(over="ignore"):
            value = mixed((sums[edges[1:]] - sums[edges[:-1]]) * self.down[edges[:-1]])
        return DIGITS[(value & np.uint64(63)).astype(np.int64)].tobytes().decode()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = worker_cached("ctph", Hasher)
        for batch in (part for whole in batches for part in text_slices(whole)):
            marks = hasher.fingerprints([t.as_py() for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], ["doc_id", "fingerprint"])

    return _rows(df, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the best of 1 - edit distance / length over signatures of one block size."""
    def part(c: Column, i: int) -> Column:
        return F.element_at(F.split(c, ":"), i + 1)

    def alike(x: Column, y: Column) -> Column:
        longer = F.greatest(F.length(x), F.length(y))
        return F.when(longer == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(x, y) / longer)

    size_a, size_b = part(a, 0).cast("long"), part(b, 0).cast("long")
    return (F.when(a == b, F.lit(1.0))
            .when(size_a == size_b, F.greatest(alike(part(a, 1), part(b, 1)), alike(part(a, 2), part(b, 2))))
            .when(size_a == 2 * size_b, alike(part(a, 1), part(b, 2)))
            .when(size_b == 2 * size_a, alike(part(a, 2), part(b, 1)))
            .otherwise(F.lit(0.0)))


EDITED = ("part int, place string, doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, next_fingerprint string, text string")


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text, its edited text (the last half replaced by the start of the next document's,
    in descending order of ids, the first after the last) and how like they are.

    Texts move once, to ranges of ids sorted within a task. A task pairs the rows it has; the
    first and last row of each task meet in a second step, two rows for each task."""
    rows = (_rows(df, id_col, text_col).withColumn("tie", F.xxhash64("text"))
            .repartitionByRange(F.desc_nulls_last("doc_id"), F.asc("tie"))
            .sortWithinPartitions(F.desc_nulls_last("doc_id"), F.asc("tie")).drop("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, me = worker_cached("ctph", Hasher), TaskContext.get().partitionId()
        before: tuple | None = None  # the row whose next one has not come yet
        for batch in (part for whole in batches for part in text_slices(whole)):
            texts = [t.as_py() for t in batch.column(1)]
            own = list(zip(batch.column(0).to_pylist(), texts, hasher.fingerprints(texts), strict=True))
            out = [] if before else [head(me, own[0])]
            chain = [before, *own] if before else own
            out += pairs(hasher, me, chain)
            before = chain[-1]
            yield frame(out)
        if before:
            doc, text, mark = before
            yield frame([(me, "last", doc, len(text), None, mark, None, None, text)])

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = worker_cached("ctph", Hasher)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out += pairs(hasher, r["part"], [(r["doc_id"], r["text"], r["fingerprint"]),
                                                 (None, r["next_text"], r["next_fingerprint"])])
            yield frame(out)

    found = staged(rows.mapInArrow(run, EDITED), "edited")
    parts = found.filter(F.col("place") == "first").select("part")  # one row for each task
    everyone = Window.orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(everyone), F.first("part").over(everyone)).alias("next_part"))
    heads = found.filter(F.col("place") == "first").select(
        F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    tails = found.filter(F.col("place") == "last").select("part", "doc_id", "text", "fingerprint")
    edges = (tails.join(after, "part").join(heads, "next_part")
             .select("part", "doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(join_edges, EDITED))
    done = found.filter(F.col("place") == "done").unionByName(edges)
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def pairs(hasher: Hasher, part: int, chain: list[tuple]) -> list[tuple]:
    """A row for each document of the chain that has a next one."""
    edited = []
    for (_, text, _), (_, follower, _) in zip(chain, chain[1:], strict=False):
        half = len(text) // 2
        edited.append(text[:len(text) - half] + follower[:half])
    marks = hasher.fingerprints(edited)
    return [(part, "done", doc, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), mark, new_mark, next_mark, None)
            for (doc, text, mark), (_, _, next_mark), new, new_mark
            in zip(chain, chain[1:], edited, marks, strict=False)]


def head(part: int, row: tuple) -> tuple:
    doc, text, mark = row
    return (part, "first", doc, len(text), None, mark, None, None, text)


def frame(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())
    names = [x.split()[0] for x in EDITED.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
