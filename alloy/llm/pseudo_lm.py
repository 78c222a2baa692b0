"""LM scoring by masked pseudo-likelihood.

Tokens are words, in classes: the most frequent words of the corpus (counted over all texts)
each, all other words by a hash of their ending. The number of class words grows by
``WORDS_PER_DOUBLING`` with each doubling of the corpus. A small network reads the classes of two
words on either side of a masked word, embeds them, and predicts the masked one's class:
embeddings, one tanh layer, softmax over all classes. P(word | class) is 1 for class words and
else (count(word) + 1) / (count(class) + distinct words of the class + 1), from the counts of all
words; a word that the corpus lacks counts as 0 times. The network is trained in numpy inside tasks: each task
takes its share of the texts through Adam steps from the common weights, and Spark averages
the tasks' weights by their number of words, round after round. Of R rounds, round r masks the
words r, r + R, r + 2R, ... of each document, so that every word of the corpus is the masked one
once. A document's score is the sum over all its words of
log P(word | words on both sides) = log P(class | both sides) + log P(word | class); the counts of
at most ``FREQUENT`` frequent words are with every task, those of all other words are joined in
Spark, a row for each distinct word of a slice of texts.

Only the class words, the frequent words, the totals of the classes and the averaged weights reach
the driver, sizes that are fixed or grow with the logarithm of the corpus; the word counts stay in a
table. Defined results: NULL text is empty; a text without words has 0 tokens, score 0
and NULL mean; words outside the text count as padding; a corpus without words gives the
uniform model; rows are scored one by one, repeated or without id; an empty table gives no rows; columns
other than id and text, whatever their names, are ignored. Words of equal counts are ranked by the
word itself. The weights of tasks are summed in no fixed order, so scores may differ in their last
digits from run to run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloy.llm.common import Words, space_words, staged, text_or_empty, text_slices

N_CLASSES = 256
#: classes of words by their ending; class 0 is padding
N_ENDINGS = 64
N_WORDS = N_CLASSES - N_ENDINGS - 1
#: class words that are added for each doubling of the corpus over LEAST_CORPUS words
WORDS_PER_DOUBLING, LEAST_CORPUS = 8, 1 << 20
SIDE = 2
OFFSETS = (-2, -1, 1, 2)
EMBED, HIDDEN = 16, 32
ROUNDS = 2
STEP_WORDS = 512
RATE = 0.005
#: words that are scored together
TOGETHER = 1024
#: words, at most, whose counts every task has
FREQUENT = 1 << 18


def shapes(n_classes: int) -> tuple[tuple[int, ...], ...]:
    return (n_classes, EMBED), (len(OFFSETS) * EMBED, HIDDEN), (HIDDEN,), (HIDDEN, n_classes), (n_classes,)


SHAPES = shapes(N_CLASSES)


def class_words(total: int) -> int:
    """The number of class words of a corpus of so many words."""
    return N_WORDS + WORDS_PER_DOUBLING * (max(total, LEAST_CORPUS) // LEAST_CORPUS).bit_length() - WORDS_PER_DOUBLING


@dataclass
class MaskedLm:
    """``words``: class words in order (classes 1, 2, ...); ``weights``: arrays of ``shapes``;
    ``unseen``: by class, log P(word | class) of a word that the corpus lacks; ``counts``: the
    table ``word, n`` of all words (left out where tasks need the model); ``frequent``: the rows of
    that table which tasks have."""
    words: list[str]
    weights: list[np.ndarray]
    unseen: np.ndarray | None = None
    counts: DataFrame | None = None
    frequent: pa.Table | None = None

    @property
    def first_ending(self) -> int:
        return len(self.weights[4]) - N_ENDINGS

    def word_classes(self, words: list[str] | np.ndarray) -> np.ndarray:
        texts, first = pa.array(words, pa.string()), self.first_ending
        endings = pc.utf8_slice_codeunits(texts, -3).dictionary_encode()
        by_ending = np.array([first + xxhash.xxh3_64_intdigest(e) % N_ENDINGS for e in endings.dictionary.to_pylist()], np.int64)
        own = pc.fill_null(pc.index_in(texts, pa.array(self.words, pa.string())), -1).to_numpy(zero_copy_only=False)
        return np.where(own >= 0, own + 1, by_ending[endings.indices.to_numpy()])

    def frequent_shares(self, words: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(word | class) of the frequent words (0 for all others), and which words have it."""
        if self.frequent is None or not len(words):
            return np.zeros(len(words)), np.zeros(len(words), bool)
        own = pc.index_in(pa.array(words, pa.string()), self.frequent.column("word").combine_chunks())
        n = pc.fill_null(self.frequent.column("n").combine_chunks().take(own), -1).to_numpy(zero_copy_only=False)
        found = (n >= 0) & (classes >= self.first_ending)
        return np.where(found, np.log1p(np.maximum(n, 0)) + self.unseen[classes], 0.0), found

    def classes(self, words: Words, by_code: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all words with padding between texts, and where the words are; ``by_code``: the
        classes of the distinct words, where they are known."""
        if by_code is None:
            by_code = self.word_classes(words.distinct)
        sizes = np.diff(words.ends, prepend=0)
        at = np.arange(len(words.codes)) + SIDE * (1 + np.repeat(np.arange(len(sizes)), sizes))
        out = np.zeros(len(words.codes) + SIDE * (1 + len(sizes)), np.int64)
        out[at] = by_code[words.codes]
        return out, at

    def log_probs(self, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log P(class | both sides) at each place."""
        embed, inner, bias, outer, prior = self.weights
        # what each class adds to the hidden layer from each side place
        adds = [embed @ inner[k * EMBED:(k + 1) * EMBED] for k in range(len(OFFSETS))]
        adds[0] = adds[0] + bias
        large = np.abs(prior).max() + np.abs(outer).sum(0).max() > 60  # scores that exp may not take
        out = np.empty(len(at), np.float64)
        for i in range(0, len(at), TOGETHER):
            own = at[i:i + TOGETHER]
            hidden = adds[0].take(classes[own + OFFSETS[0]], 0)
            for add, o in zip(adds[1:], OFFSETS[1:], strict=True):
                hidden += add.take(classes[own + o], 0)
            scores = np.tanh(hidden, out=hidden) @ outer
            scores += prior
            if large:
                scores -= scores.max(1, keepdims=True)
            right = scores[np.arange(len(own)), classes[own]]
            out[i:i + TOGETHER] = right - np.log(np.exp(scores, out=scores).sum(1))
        return out


def split(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    cuts = np.cumsum([w.size for w in like])[:-1]
    return [x.reshape(w.shape) for x, w in zip(np.split(flat, cuts), like, strict=True)]


class Adam:
    """``weights`` are views of ``flat``, which is updated as a whole."""

    def __init__(self, weights: list[np.ndarray]):
        self.flat = np.concatenate([w.ravel() for w in weights])
        self.weights = split(self.flat, weights)
        self.mean, self.square = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.steps = 0

    def step(self, classes: np.ndarray, at: np.ndarray) -> None:
        embed, inner, bias, outer, prior = self.weights
        n = len(at)
        sides = np.stack([classes[at + o] for o in OFFSETS], 1)
        x = embed.take(sides.ravel(), 0).reshape(n, -1)
        hidden = np.tanh(x @ inner + bias)
        scores = hidden @ outer
        scores += prior
        if np.abs(prior).max() + np.abs(outer).sum(0).max() > 60:  # scores that exp may not take
            scores -= scores.max(1, keepdims=True)
        wrong = np.exp(scores, out=scores)
        wrong *= 1 / (n * wrong.sum(1, keepdims=True))
        wrong[np.arange(n), classes[at]] -= 1 / n
        back = (wrong @ outer.T) * (1 - hidden * hidden)
        # the rows of each class added up: sorted by class, then summed run by run
        owners = sides.ravel().astype(np.int16)
        order = np.argsort(owners, kind="stable")
        owners = owners[order]
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        embed_grad = np.zeros_like(embed)
        embed_grad[owners[starts]] = np.add.reduceat((back @ inner.T).reshape(-1, EMBED).take(order, 0), starts)
        g = np.concatenate([x.ravel() for x in (embed_grad, x.T @ back, back.sum(0), hidden.T @ wrong, wrong.sum(0))])
        self.steps += 1
        self.mean += 0.1 * (g - self.mean)
        self.square += 0.01 * (g * g - self.square)
        self.flat -= RATE * (self.mean / (1 - 0.9 ** self.steps)) / (np.sqrt(self.square / (1 - 0.99 ** self.steps)) + 1e-8)


def lower_words(texts: pa.Array) -> Words:
    return space_words(texts, lower=True)


def word_counts(rows: DataFrame) -> DataFrame:
    """``word, n`` over all texts; words are counted in each task before they move."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole)):
            words = lower_words(batch.column(1))
            n = np.bincount(words.codes, minlength=len(words.distinct))
            yield pa.RecordBatch.from_arrays([pa.array(words.distinct, pa.string()), pa.array(n, pa.int64())],
                                             ["word", "n"]).filter(pa.array(n > 0))

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def first_model(counts: DataFrame, seed: int = 0) -> MaskedLm:
    """The class words and a network that predicts each class by its share of all words."""
    n_words = class_words(counts.agg(F.sum("n")).first()[0] or 0)
    words = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(n_words).collect()]
    n_classes = n_words + 1 + N_ENDINGS
    rng = np.random.default_rng(seed)
    weights = [(rng.standard_normal(s) * (0.3 if len(s) > 1 else 0)).astype(np.float32) for s in shapes(n_classes)]
    weights[1] *= np.float32(0.5)
    weights[3] *= np.float32(0.1)
    model = MaskedLm(words, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = model.word_classes(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(classes), batch.column(1)], ["class", "n"])

    share, distinct = np.zeros(n_classes), np.zeros(n_classes)
    for r in counts.select("word", "n").mapInArrow(run, "class long, n long").groupBy("class").agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).collect():
        share[r["class"]], distinct[r["class"]] = r["n"], r["distinct"]
    unseen = -np.log(share + distinct + 1)
    unseen[:model.first_ending] = 0
    share += 1
    share[0] = share.sum() * 1e-9
    weights[4] = np.log(share / share.sum()).astype(np.float32)
    return replace(model, unseen=unseen)


def masked_places(words: Words, round_: int, rounds: int) -> np.ndarray:
    """The words of a slice that a round masks: each word is in one of the rounds."""
    sizes = np.diff(words.ends, prepend=0)
    place = np.arange(len(words.codes)) - np.repeat(words.ends - sizes, sizes)
    return np.flatnonzero(place % rounds == round_)


def train_round(rows: DataFrame, model: MaskedLm, round_: int, rounds: int) -> MaskedLm:
    """One pass of every task over its texts, and the average of their weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adam, seen = Adam(model.weights), 0
        rng = np.random.default_rng(round_)
        for batch in (part for whole in batches for part in text_slices(whole)):
            words = lower_words(batch.column(1))
            classes, at = model.classes(words)
            at = rng.permutation(at[masked_places(words, round_, rounds)])
            for i in range(0, len(at), STEP_WORDS):
                adam.step(classes, at[i:i + STEP_WORDS])
            seen += len(at)
        if seen:
            flat = adam.flat.astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1)), pa.array(np.append(flat, seen))], ["place", "value"])

    sums = rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    if not len(sums):
        return model
    flat = sums.sort_values("place")["value"].to_numpy()
    flat = (flat[:-1] / flat[-1]).astype(np.float32)
    return replace(model, weights=split(flat, model.weights))


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> MaskedLm:
    rows = _rows(df, id_col, text_col)
    counts = staged(word_counts(rows), "words")
    model = first_model(counts)
    for round_ in range(rounds):
        model = train_round(rows, model, round_, rounds)
    return replace(model, counts=counts, frequent=frequent_words(counts))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> pa.Table:
    """``word, n`` of all words with at least 2^k occurrences, for the least k that leaves at most
    ``most`` words."""
    digits = F.length(F.bin("n"))
    least, total = 64, 0
    for r in counts.groupBy(digits.alias("digits")).count().orderBy(F.desc("digits")).collect():
        total += r["count"]
        if total > most:
            break
        least = r["digits"]
    return counts.filter(digits >= least).select("word", "n").toArrow()


def word_owners(words: Words, plain: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The codes of the words of a slice that are ``plain`` (by code) and, for each, the number of
    the text of every place where it is."""
    places = np.flatnonzero(plain[words.codes])
    texts = np.repeat(np.arange(len(words.ends), dtype=np.int32), np.diff(words.ends, prepend=0))[places]
    codes = words.codes[places]
    n = np.bincount(codes, minlength=len(plain))
    found = np.flatnonzero(n)
    starts = np.concatenate([[0], np.cumsum(n[found])]).astype(np.int32)
    return found, pa.ListArray.from_arrays(pa.array(starts), pa.array(texts[np.argsort(codes, kind="stable")]))


def score(df: DataFrame, model: MaskedLm, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, pseudo_log_likelihood, mean_log_prob`` of each whole text."""
    net = replace(model, counts=None)
    kinds = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("total", pa.float64()),
                       ("word", pa.string()), ("unseen", pa.float64()), ("texts", pa.list_(pa.int32()))])

    def batch_of(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in kinds], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33  # rows are numbered, as ids may repeat
        for batch in (part for whole in batches for part in text_slices(whole)):
            words = lower_words(batch.column(1))
            classes = net.word_classes(words.distinct)
            shares, known = net.frequent_shares(words.distinct, classes)
            sums = np.concatenate([[0.0], np.cumsum(net.log_probs(*net.classes(words, classes)) + shares[words.codes])])
            starts, ends = np.concatenate([[0], words.ends[:-1]]), words.ends
            yield batch_of(batch.num_rows, row=pa.array(first + np.arange(batch.num_rows)), doc_id=batch.column(0),
                           n_tokens=pa.array(ends - starts, pa.int64()), total=pa.array(sums[ends] - sums[starts]))
            found, texts = word_owners(words, (classes >= net.first_ending) & ~known)
            yield batch_of(len(found), row=pa.array(np.full(len(found), first)), word=pa.array(words.distinct[found], pa.string()),
                           unseen=pa.array(net.unseen[classes[found]]), texts=texts)
            first += batch.num_rows

    scored = staged(_rows(df, id_col, text_col).mapInArrow(
        run, "row long, doc_id long, n_tokens long, total double, word string, unseen double, texts array<int>"), "scored")
    share = F.log1p(F.coalesce("n", F.lit(0))) + F.col("unseen")
    in_class = (scored.filter("word is not null").join(model.counts, "word", "left")
                .select("row", share.alias("share"), F.explode("texts").alias("text"))
                .groupBy((F.col("row") + F.col("text")).alias("row")).agg(F.sum("share").alias("share")))
    total = F.col("total") + F.coalesce("share", F.lit(0.0))
    return (scored.filter("word is null").join(in_class, "row", "left")
            .select("doc_id", "n_tokens", total.alias("pseudo_log_likelihood"),
                    F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob")))
