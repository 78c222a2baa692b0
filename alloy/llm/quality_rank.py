"""Quality classifier: Bradley-Terry pairwise ranking of documents by form features.

Every pair (document of label 1, document of label 0) states a preference. The probability
that the first wins is the logistic function of the difference of two linear scores, and the
weights minimise the logistic loss over feature differences (Newton steps, L2). The cut is a
quantile of the training scores: the one that parts the labels best. A text's score is the
logistic function of its linear score less the cut, so 0.5 is the cut.

Every labelled row teaches. The rows are dealt to blocks of some BLOCK by the hash of the id; a
label so rare that blocks would lack it lends its rows to several. In its block a row is paired
with PAIRS_EACH rows of the other label or more. A Newton step adds up the blocks' gradients and curvatures,
one row a task, and the cut is found on the scores of all labelled rows in order, one row a range
of them. What reaches the driver at once are such rows, whatever the number of labels; every whole
text is scored, from its text alone.

Defined results: NULL text is empty; an empty text has the features of an empty text and a
score like any other; rows with NULL quality or id teach nothing; an id with several labels
counts with its largest; without both labels every score is 0.5; an empty table gives no rows; columns other than id and
text (and quality, of labels), whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloy.llm.common import staged, text_or_empty

#: labelled rows that are paired with each other, and rows of either label in a block at least
BLOCK, LEAST = 4096, 64
#: labels up to which their ids are broadcast to the documents
BROADCAST_IDS = 2_000_000
#: tasks that hold the blocks, at most
BLOCK_TASKS = 512
PAIRS_EACH = 16
L2 = 1e-3
#: groups of bytes whose share of a text is a feature
BYTE_GROUPS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t\x0b\x0c", b".", b",", b"!", b"?", b"|", b"#$%&*@^~",
    b"\"'`", b":;", b"<>{}[]()", b"/\\_=+-", bytes(range(128, 256)),
)
N_FEATURES = len(BYTE_GROUPS) + 11


def _group_of_byte() -> np.ndarray:
    out = np.full(256, len(BYTE_GROUPS), np.int64)
    for i, group in enumerate(BYTE_GROUPS):
        out[list(group)] = i
    return out


def features(text: str) -> np.ndarray:
    """Form features of one whole text (no ids, labels, languages or sources)."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    groups = np.bincount(_group_of_byte(), weights=counts, minlength=len(BYTE_GROUPS) + 1)[:-1] / n
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct, same_lines = len(set(words)), len(set(lines))
    letters = counts[counts > 0] / n
    return np.concatenate([groups, [
        np.log1p(len(raw)), sizes.mean(), sizes.std(), (sizes >= 16).mean(), (sizes <= 2).mean(),
        distinct / max(1, len(words)), np.log1p(distinct), same_lines / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        -(letters * np.log(letters)).sum(), float((raw[-1:] or b" ") in b".!?"),
    ]])


def feature_matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in texts]).reshape(-1, N_FEATURES)


@dataclass(frozen=True)
class RankModel:
    """Linear score of standardised features and the cut that 0.5 stands for."""
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    cut: float
    quantile: float

    def linear(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - np.array(self.centre)) / np.array(self.scale), -8, 8)
        return z @ np.array(self.weights)

    def score(self, texts: list[str | None]) -> np.ndarray:
        s = self.linear(feature_matrix(texts)) - self.cut
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def standardised(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - centre) / scale, -8, 8)


def pair_differences(z: np.ndarray, y: np.ndarray, seed: int = 0) -> np.ndarray:
    """Differences of pairs (label 1, label 0) in which every row takes part."""
    high, low = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(high) or not len(low):
        return z[:0]
    rng = np.random.default_rng(seed)
    n = PAIRS_EACH * max(len(high), len(low))
    return z[high[rng.permutation(n) % len(high)]] - z[low[rng.permutation(n) % len(low)]]


def pair_sums(diff: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of pairs, and the sums of their gradients and curvatures at ``w``."""
    p = 1 / (1 + np.exp(diff @ w))  # probability that the wrong one wins
    return np.concatenate([[len(diff)], diff.T @ p, ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()])


def newton(sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The weights where the mean loss of all pairs is least; ``sums`` adds ``pair_sums`` up. None
    without pairs."""
    w = np.zeros(N_FEATURES)
    for _ in range(30):
        n, grad, hess = np.split(sums(w), [1, 1 + N_FEATURES])
        if not n[0]:
            return None
        hess = hess.reshape(N_FEATURES, N_FEATURES) / n[0] + L2 * np.eye(N_FEATURES)
        step = np.linalg.solve(hess, L2 * w - grad / n[0])
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Cut(NamedTuple):
    """What a range of the scores in order tells: its first row, how much better its best cut is than
    one below the range, the score below that cut and the one above it (None: beyond the range), the
    weight below the cut, and the gain and weight of the whole range."""
    first: tuple[float, int]
    best: float
    below: float
    above: float | None
    weight_below: float
    gain: float
    weight: float


def cut_of(parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], low: float, high: float) -> Cut | None:
    """The best cut of a range: scores, ids and labels in order, in parts; ``low`` and ``high`` are the
    weights of rows of label 0 and 1. Rows below the cut are called 0: right for label 0, wrong for 1."""
    out = None
    for s, ids, y in parts:
        if not len(s):
            continue
        weight = np.where(y == 1, high, low)
        if out is None:
            out = Cut((float(s[0]), int(ids[0])), -np.inf, 0.0, None, 0.0, 0.0, 0.0)
        elif out.above is None:
            out = out._replace(above=float(s[0]))
        gain = np.cumsum(np.concatenate([[out.gain], np.where(y == 0, weight, -weight)]))[1:]
        weights = np.cumsum(np.concatenate([[out.weight], weight]))[1:]
        k = int(gain.argmax())
        if gain[k] > out.best:
            out = out._replace(best=float(gain[k]), below=float(s[k]), above=float(s[k + 1]) if k + 1 < len(s) else None, weight_below=float(weights[k]))
        out = out._replace(gain=float(gain[-1]), weight=float(weights[-1]))
    return out


def joined_cut(cuts: Sequence[Cut]) -> tuple[float, float]:
    """The best cut of all ranges, and the weight below it."""
    cuts = sorted(cuts, key=lambda c: c.first)
    best, gain, weight, cut, quantile = -np.inf, 0.0, 0.0, 0.0, 0.0
    for i, c in enumerate(cuts):
        if gain + c.best > best:
            following = cuts[i + 1].first[0] if i + 1 < len(cuts) else c.below + 2
            best, quantile = gain + c.best, weight + c.weight_below
            cut = (c.below + (following if c.above is None else c.above)) / 2
        gain, weight = gain + c.gain, weight + c.weight
    return cut, quantile


def spread(centre: np.ndarray, squares: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scale from mean and summed squared deviations of ``n`` rows."""
    if not n:
        return np.zeros(N_FEATURES), np.ones(N_FEATURES)
    scale = np.sqrt(squares / n)
    return centre, np.where(scale > 1e-12, scale, 1.0)


def fit_pairs(x: np.ndarray, y: np.ndarray, share_of_low: float, seed: int = 0) -> RankModel:
    """Bradley-Terry weights from the pairs of labels in ``y``, rows of one block; ``share_of_low``: share of
    label 0 among all labelled rows, which weighs the two labels when the cut is chosen."""
    mean = x.mean(0) if len(x) else np.zeros(N_FEATURES)
    centre, scale = spread(mean, ((x - mean) ** 2).sum(0), len(x))
    z = standardised(x, centre, scale)
    diff = pair_differences(z, y, seed)
    w = newton(lambda w: pair_sums(diff, w))
    if w is None:
        return RankModel((0.0,) * N_FEATURES, tuple(centre), tuple(scale), 0.0, 0.0)
    s = z @ w
    order = np.argsort(s, kind="stable")
    cut, quantile = joined_cut([cut_of([(s[order], order, y[order])], share_of_low / (y == 0).sum(), (1 - share_of_low) / (y == 1).sum())])
    return RankModel(tuple(w), tuple(centre), tuple(scale), cut, quantile)


def labelled_features(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, label, x`` of the documents in ``known`` (doc_id, label), one row per id."""
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
            .join(known, "doc_id").select("doc_id", "label", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = feature_matrix([t.as_py() for t in b.column(2)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))],
                                             ["doc_id", "label", "x"])

    found = rows.mapInArrow(run, "doc_id long, label int, x array<double>")
    # a repeated row teaches once, and of rows that share an id one
    once = found.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("row"))
    return once.select("doc_id", "row.label", "row.x")


def blocked(rows: DataFrame, counts: dict[int, int], block: int) -> DataFrame:
    """``rows`` (doc_id, label, x) in blocks: ``block, ids, labels, own, x``, arrays as bytes in order of
    ids. A row that is lent to more blocks is ``own`` in one."""
    n = max(1, -(-sum(counts.values()) // block))
    lent = {k: min(n, -(-LEAST * n // max(1, counts.get(k, 0)))) for k in (0, 1)}
    copies = F.when(F.col("label") == 1, lent[1]).otherwise(lent[0]).cast("long")
    dealt = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    stride = F.floor(F.lit(n) / copies).cast("long")
    dealt = dealt.withColumn("block", F.pmod(F.pmod(F.xxhash64("doc_id"), F.lit(n)) + F.col("copy") * stride, F.lit(n)).cast("long"))

    def gathered(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id", kind="stable")
        columns = {"ids": part["doc_id"].to_numpy(np.int64), "labels": part["label"].to_numpy(np.int8),
                   "own": (part["copy"] == 0).to_numpy(np.int8), "x": np.array([list(v) for v in part["x"]], np.float64)}
        return pd.DataFrame({"block": [key[0]], **{k: [v.tobytes()] for k, v in columns.items()}})

    return (dealt.repartition(min(n, BLOCK_TASKS), "block").groupBy("block")
            .applyInPandas(gathered, "block long, ids binary, labels binary, own binary, x binary"))


class Block(NamedTuple):
    block: int
    ids: np.ndarray
    labels: np.ndarray
    own: np.ndarray
    x: np.ndarray


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for number, ids, labels, own, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield Block(number, np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int8), np.frombuffer(own, np.int8) == 1,
                        np.frombuffer(x, np.float64).reshape(-1, N_FEATURES))


def per_task(blocks: DataFrame, of_block: Callable[[Block], np.ndarray], add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """``of_block`` of all blocks, added up in each task and then here, in order of the blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = None, None
        for block in read_blocks(batches):
            own = of_block(block)
            first, total = (block.block, own) if total is None else (first, add(total, own))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["block", "total"])

    parts = blocks.mapInArrow(run, "block long, total binary").collect()
    totals = [np.frombuffer(r["total"], np.float64) for r in sorted(parts, key=lambda r: r["block"])]
    return reduce(add, totals) if totals else None


def moments(block: Block) -> np.ndarray:
    """Rows of label 0 and of label 1, means and summed squared deviations of a block's own rows."""
    x, y = block.x[block.own], block.labels[block.own]
    mean = x.mean(0) if len(x) else np.zeros(N_FEATURES)
    return np.concatenate([[(y == 0).sum(), (y == 1).sum()], mean, ((x - mean) ** 2).sum(0)])


def joined_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n, m = a[:2].sum(), b[:2].sum()
    if not n or not m:
        return b if not n else a
    apart = b[2:2 + N_FEATURES] - a[2:2 + N_FEATURES]
    return np.concatenate([a[:2] + b[:2], a[2:2 + N_FEATURES] + apart * (m / (n + m)),
                           a[2 + N_FEATURES:] + b[2 + N_FEATURES:] + apart ** 2 * (n * m / (n + m))])


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", block: int = BLOCK) -> RankModel:
    """Fit on all labelled rows for which ``train`` (over ``doc_id``) holds."""
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)))
    if train is not None:
        known = known.filter(train)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    ids = F.broadcast(known) if total <= BROADCAST_IDS else known
    blocks = staged(blocked(labelled_features(docs, ids, id_col, text_col), counts, block), "labelled")
    found = per_task(blocks, moments, joined_moments)
    n_low, n_high, *rest = (0, 0, *np.zeros(2 * N_FEATURES)) if found is None else found
    centre, scale = spread(np.array(rest[:N_FEATURES]), np.array(rest[N_FEATURES:]), int(n_low + n_high))

    def sums(w: np.ndarray) -> np.ndarray:
        every = per_task(blocks, lambda b: pair_sums(pair_differences(standardised(b.x, centre, scale), b.labels, b.block), w), np.add)
        return np.zeros(1 + N_FEATURES + N_FEATURES ** 2) if every is None else every

    w = newton(sums) if n_low and n_high else None
    if w is None:
        return RankModel((0.0,) * N_FEATURES, tuple(centre), tuple(scale), 0.0, 0.0)
    share_of_low = counts.get(0, 0) / total
    low, high = share_of_low / n_low, (1 - share_of_low) / n_high

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in read_blocks(batches):
            s = standardised(b.x[b.own], centre, scale) @ w
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(b.ids[b.own]), pa.array(b.labels[b.own].astype(np.int32))], ["s", "doc_id", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = cut_of(([x.to_numpy(zero_copy_only=False) for x in b.columns] for b in batches), low, high)
        if c is not None:
            yield pa.RecordBatch.from_pylist([{"s": c.first[0], "doc_id": c.first[1], **c._asdict()}], pa.schema(
                [("s", pa.float64()), ("doc_id", pa.int64()), *((k, pa.float64()) for k in Cut._fields[1:])]))

    in_order = blocks.mapInArrow(scored, "s double, doc_id long, label int").repartitionByRange("s", "doc_id").sortWithinPartitions("s", "doc_id")
    cuts = in_order.mapInArrow(run, "s double, doc_id long, " + ", ".join(f"{k} double" for k in Cut._fields[1:])).collect()
    cut, quantile = joined_cut([Cut((r["s"], r["doc_id"]), *(r[k] for k in Cut._fields[1:])) for r in cuts])
    return RankModel(tuple(w), tuple(centre), tuple(scale), cut, quantile)


def score(text: Column, model: RankModel) -> Column:
    """Score (0 to 1) of each whole text."""
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()), dtype="float64")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(text)
