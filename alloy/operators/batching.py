"""Greedy token-budget batching, computed block by block.

The greedy rule reads a group's rows in order and keeps one number, the tokens in the open
batch (its *fill*). What a block of rows does to it is a small table: a fill from which the
whole block still fits just grows by the block's total; any other fill decides only which row
is the first to open a new batch, and what follows depends on that row alone. As such chains
of batches soon meet, most first rows lead to the same number of batches and the same last
fill, so a table has at most as many pieces as rows fit into one batch, usually a few. Tables
of consecutive blocks compose to a table of their kind: blocks are composed to runs, a
group's runs are gone through once, and the fills found at their beginnings are handed down
to the blocks, which then number their rows. No task holds more rows than a block, however
large the group.

That is for groups of more than ``WHOLE`` blocks' rows. The others, often many and tiny, are
sorted side by side and gone through as one stream of rows that carries the open batch along:
what they cost depends on their rows, not on how many groups or blocks hold them. A large group
whose numbers lie far apart gets wider blocks, of no more rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alloy.functions.columns import canonical_row
from alloy.session import cut_lineage

#: blocks of a run
RUN = 512
#: groups of up to so many blocks' rows are gone through in order, whole
WHOLE = 32
#: the fill before the first row of a group: nothing fits
UNOPENED = 1 << 62
TABLE = "_g string, _blk long, total long, low array<long>, starts array<long>, fill array<long>"
ENTRY = "_g string, {} long, fill long, batch long"


class Fills(NamedTuple):
    """Fills up to ``low[0]`` grow by ``total``; a fill above ``low[k]``, up to ``low[k + 1]``, leads
    to ``starts[k]`` new batches and to ``fill[k]``."""
    total: int
    low: np.ndarray
    starts: np.ndarray
    fill: np.ndarray

    def after(self, fill: int) -> tuple[int, int]:
        """(new batches, fill at the end) for the fill at the beginning."""
        k = int(np.searchsorted(self.low, fill, "left")) - 1
        return (0, fill + self.total) if k < 0 else (int(self.starts[k]), int(self.fill[k]))


def compact(total: int, low: np.ndarray, starts: np.ndarray, fill: np.ndarray) -> Fills:
    """Neighbouring pieces with one outcome become one."""
    keep = np.append(True, (starts[1:] != starts[:-1]) | (fill[1:] != fill[:-1]))
    return Fills(total, low[keep], starts[keep], fill[keep])


def next_starts(sums: np.ndarray, room: int) -> np.ndarray:
    """For each row as the first of a batch, the row that opens the next one (the number of rows:
    none); ``sums`` are the running sums of the tokens, from 0."""
    n = len(sums) - 1
    fits = np.searchsorted(sums, sums[:-1] + room, "right") - 1
    return np.maximum(fits, np.arange(n) + 1)


def block_table(tokens: np.ndarray, room: int) -> Fills:
    sums = np.concatenate([[0], np.cumsum(tokens)])
    n = len(tokens)
    following = next_starts(sums, room).tolist()
    starts, last = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        j = following[i]
        starts[i], last[i] = (1, i) if j >= n else (starts[j] + 1, last[j])
    # the first row to open a batch, from the last row (small fills) to the first (large ones)
    first = np.arange(n - 1, -1, -1)
    first = first[((sums[first + 1] > sums[first]) & (sums[first] <= room)) | (first == 0)]
    end = sums[n] - sums[np.array(last)]
    return compact(int(sums[n]), room - sums[first + 1], np.array(starts)[first], end[first])


def composed(a: Fills, b: Fills) -> Fills:
    """``a``, then ``b``."""
    through = b.low - a.total < a.low[0]
    rest = [b.after(int(f)) for f in a.fill]
    return compact(a.total + b.total, np.concatenate([(b.low - a.total)[through], a.low]),
                   np.concatenate([b.starts[through], a.starts + np.array([s for s, _ in rest])]),
                   np.concatenate([b.fill[through], np.array([f for _, f in rest])]))


def _tables(part: pd.DataFrame) -> Iterator[tuple[int, Fills]]:
    """Block (or run) and table of each row, in order."""
    part = part.sort_values("_blk")
    for at, total, *lists in zip(*(part[c] for c in ("_blk", "total", "low", "starts", "fill")), strict=True):
        yield int(at), Fills(int(total), *(np.asarray(x, np.int64) for x in lists))


def _written(g: str, at: int, table: Fills) -> pd.DataFrame:
    return pd.DataFrame({"_g": [g], "_blk": [at], "total": [table.total], "low": [table.low], "starts": [table.starts], "fill": [table.fill]})


def _entries(part: pd.DataFrame, name: str, fill: int, batch: int) -> pd.DataFrame:
    """The fill and the batch at the beginning of each table, in order."""
    out = []
    for at, table in _tables(part):
        out.append((part["_g"].iloc[0], at, fill, batch))
        more, fill = table.after(fill)
        batch += more
    return pd.DataFrame(out, columns=["_g", name, "fill", "batch"])


def pack_batches(df: DataFrame, group: str, order: str, tokens: Column, room: int, base: int, block_width: int = 4096) -> DataFrame:
    """``df`` with ``tokens``, ``batch_no`` and ``batch_tokens`` (see ``documents.pack_batches``)."""
    rows = df.withColumn("tokens", tokens).withColumn("_g", canonical_row(df, [group]))
    kept = [*df.columns, "tokens", "batch_no", "batch_tokens"]
    large = cut_lineage(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > WHOLE * block_width).select("_g"))
    if large.isEmpty():
        return pack_whole(rows, order, room, base).select(kept)
    # at most one in WHOLE * block_width rows is such a group
    rest = rows.join(F.broadcast(large), "_g", "left_anti")
    hot = rows.join(F.broadcast(large), "_g", "left_semi")
    return pack_blocks(hot, order, room, base, block_width).select(kept).unionByName(pack_whole(rest, order, room, base).select(kept))


def pack_whole(rows: DataFrame, order: str, room: int, base: int) -> DataFrame:
    """``rows`` (with ``_g`` and ``tokens``) and their batches, by one pass over sorted groups."""
    sorted_rows = rows.repartition("_g").sortWithinPartitions("_g", F.col(order).asc_nulls_last(), "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fill, batch = None, 0, 0
        for b in batches:
            found = []
            for g, n in zip(b.column("_g").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                if g != now:
                    now, fill, batch = g, n, 0
                elif fill + n > room:
                    fill, batch = n, batch + 1
                else:
                    fill += n
                found.append(batch)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], [*b.schema.names, "batch_no"])

    out = sorted_rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("batch_no", T.LongType())]))
    return out.withColumn("batch_tokens", F.sum("tokens").over(Window.partitionBy("_g", "batch_no")) + F.lit(base))


def pack_blocks(rows: DataFrame, order: str, room: int, base: int, block_width: int) -> DataFrame:
    """``rows`` (with ``_g`` and ``tokens``) and their batches, by blocks. Rows move slim to the tables
    of their blocks, whole to their numbering, and by batch to its sum."""
    cell = F.floor(F.col(order) / F.lit(block_width)).cast("long")
    # cells of a sparse group are joined to blocks: as many as hold a block's rows if all are as full as the fullest
    widths = (rows.groupBy("_g", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n")).groupBy("_g")
              .agg(F.greatest(F.lit(1), F.floor(F.lit(block_width) / F.max("_n"))).cast("long").alias("_cells")))
    rows = (rows.join(F.broadcast(cut_lineage(widths)), "_g").withColumn("_blk", F.floor(cell / F.col("_cells")).cast("long"))
            .drop("_cells").select(*rows.columns, "_blk"))

    def table_of(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_o", "tokens"])
        return _written(key[0], int(key[1]), block_table(part["tokens"].to_numpy(np.int64), room))

    tables = rows.select("_g", "_blk", F.col(order).alias("_o"), "tokens").groupBy("_g", "_blk").applyInPandas(table_of, TABLE)
    run = F.floor(F.col("_blk") / RUN).cast("long")

    def run_of(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for row in _tables(part):
            whole = row[1] if whole is None else composed(whole, row[1])
        return _written(key[0], int(key[1]), whole)

    def run_entries(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return _entries(part, "_run", UNOPENED, -1)

    def block_entries(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _entries(left, "_blk", int(right["fill"].iloc[0]), int(right["batch"].iloc[0]))

    by_run = tables.withColumn("_run", run)
    runs = by_run.groupBy("_g", "_run").applyInPandas(run_of, TABLE)
    begun = runs.groupBy("_g").applyInPandas(run_entries, ENTRY.format("_run"))
    entries = by_run.groupBy("_g", "_run").cogroup(begun.groupBy("_g", "_run")).applyInPandas(block_entries, ENTRY.format("_blk"))

    def numbered(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left, [(order, "ascending"), ("tokens", "ascending")]))
        found = numbers(left.column("tokens").to_numpy().astype(np.int64), right.column("fill")[0].as_py(), right.column("batch")[0].as_py(), room)
        return left.drop_columns(["_blk"]).append_column("batch_no", pa.array(found, pa.int64()))

    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "_blk"), T.StructField("batch_no", T.LongType())])
    out = rows.groupBy("_g", "_blk").cogroup(entries.groupBy("_g", "_blk")).applyInArrow(numbered, schema)
    sums = out.groupBy("_g", "batch_no").agg((F.sum("tokens") + F.lit(base)).alias("batch_tokens"))
    return out.join(sums, ["_g", "batch_no"])


def numbers(tokens: np.ndarray, fill: int, batch: int, room: int) -> np.ndarray:
    """The batch of each row of a block that is entered with a fill and a batch."""
    sums = np.concatenate([[0], np.cumsum(tokens)])
    opens = np.zeros(len(tokens), np.int64)
    following = next_starts(sums, room)
    at = max(0, int(np.searchsorted(sums, room - fill, "right")) - 1)
    while at < len(tokens):
        opens[at] = 1
        at = int(following[at])
    return batch + np.cumsum(opens)
