"""BPE encoding and decoding by a deterministic tokenisation automaton.

The automaton reads tokens and accepts just the sequences that BPE produces. It starts as
one state with a loop for every byte and takes one gadget per merge (u, v) -> w, in order:
the state reached by u is split into a copy that lacks the arc v (u followed by v is w from
now on), all arcs u lead to the copy, and each state with an arc u gets an arc w to where v
led. All arcs of a label thus lead to one state, and a state is its parent less one arc, so
50,000 merges give 50,001 states with one record each. An arc (state, token) is present
unless an ancestor of the state cut it; the answers that texts ask for are kept in a
transition table.

A word has exactly one accepted path that spells it, its BPE encoding. It is found by
reading the longest token that fits and stepping back to shorter ones where an arc is
absent; spellings are read through a table too. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloy.llm.common import coded, text_or_empty, text_slices, worker_cached

#: words, parts of texts, and arcs that a worker remembers
CACHE_WORDS, CACHE_PARTS, CACHE_ARCS = 800_000, 500_000, 2_000_000
#: fixed value: the word pattern of byte-level BPE
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the same without the letters and numbers that the tokenizers library does not know yet
OLDER_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}--[NEWER]]+| ?[\p{N}--[NEWER]]+| ?(?:[^\s\p{L}\p{N}]|[NEWER])+"
                 r"|\s+(?!\S)|\s+")
#: RE2: texts whose words are not just the parts between single spaces
IRREGULAR = (r"[\s\x0b]{2}|^[\s\x0b]|[\s\x0b]$|[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
             r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
ROOT = 0


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter: the printable bytes of
    Latin-1 as themselves, the others as the letters from code point 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def newer_letters() -> str:
    """Letters and numbers of the regex module that the tokenizers library, whose Unicode tables
    are older, does not take for such. Both know what Python's tables know."""
    from tokenizers.pre_tokenizers import ByteLevel
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    new = [c for c in regex.findall(r"[\p{L}\p{N}]", everything) if unicodedata.category(c) == "Cn"]
    # a letter joins the letter before it, a number the digit before it
    line = "\n".join(f"a{c}\n1{c}" for c in new)
    ends = {end for _, (_, end) in ByteLevel(add_prefix_space=False).pre_tokenize_str(line)}
    return "".join(c for i, c in enumerate(new) if {6 * i + 1, 6 * i + 4} <= ends)


class TokenAutomaton:
    """Compiled from ``labels`` (token id -> bytes) and ``merges`` (pairs of ids, by rank)."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int]]):
        self.labels = labels
        self.token = {label: t for t, label in labels.items()}
        # by state: its parent, the arc it lacks, the rank of its merge, the token whose arcs it ends
        self.parent, self.cut, self.born, self.owner = [ROOT], [-1], [-1], [-1]
        self.target = dict.fromkeys(labels, ROOT)  # by token
        self.before: dict[int, int] = {}  # by token: its target before the first split
        self.made: dict[int, int] = {}
        self.first: dict[int, int] = {}
        self.cuts: dict[tuple[int, int], int] = {}
        self.lines: dict[int, tuple[tuple[int, int], ...]] = {}
        live = {t for t, label in labels.items() if len(label) == 1}
        for rank, (u, v) in enumerate(merges):
            w = self.token.get(labels[u] + labels[v])
            # no gadget where u is never followed by v any more: w is not made this way
            if w is not None and u in live and v in live and w not in live and self.find_arc(self.target[u], v):
                self.gadget(rank, u, v, w)
                live.add(w)
        self.read = {self.labels[t]: t for t in live}
        self.size = {t: len(label) for t, label in labels.items()}
        self.steps, self.longest, self.shorter = self.spelling()
        self.arcs: dict[int, bool] = {}

    def gadget(self, rank: int, u: int, v: int, w: int) -> None:
        self.made[w], self.first[w] = rank, u
        self.target[w] = self.target[v]
        self.before.setdefault(u, self.target[u])
        self.parent.append(self.target[u])
        self.cut.append(v)
        self.born.append(rank)
        self.owner.append(u)
        self.cuts[u, v] = rank
        self.target[u] = len(self.parent) - 1

    def line(self, state: int) -> tuple[tuple[int, int], ...]:
        """The ancestry of a state as (token whose arcs it ends, rank of its last split): the
        splits of one token follow each other, so one entry stands for all of them."""
        found = self.lines.get(state)
        if found is None:
            out, s = [], state
            while s != ROOT:
                out.append((self.owner[s], self.born[s]))
                s = self.before[self.owner[s]]
            found = self.lines[state] = tuple(out)
        return found

    def spelling(self) -> tuple[dict[int, int], list[int], dict[int, int]]:
        """Over the spellings of the tokens: table (place * 256 + byte) -> next place, the longest
        token on the way to each place (-1: none), and the next shorter one of each token."""
        steps: dict[int, int] = {}
        above, longest = [0], [-1]
        for label, token in self.read.items():
            place = 0
            for byte in label:
                key = place << 8 | byte
                if key not in steps:
                    steps[key] = len(above)
                    above.append(place)
                    longest.append(-1)
                place = steps[key]
            longest[place] = token
        shorter = {}
        for place in range(1, len(above)):  # a place comes after the one above it
            before = longest[above[place]]
            if longest[place] >= 0:
                shorter[longest[place]] = before
            else:
                longest[place] = before
        return steps, longest, shorter

    def find_arc(self, state: int, token: int) -> bool:
        # a token's arc was copied from its first part's when it was made; a split cut it if
        # it came later than the token and not later than the rest of the way allows
        limit = 1 << 40
        while True:
            for owner, last in self.line(state):
                rank = self.cuts.get((owner, token))
                if rank is not None and rank <= last and rank <= limit:
                    return False
            if token not in self.made:
                return True
            limit, token = self.made[token], self.first[token]

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-split word."""
        step, longest, shorter = self.steps.get, self.longest, self.shorter
        size, arcs, target = self.size, self.arcs, self.target
        out: list[int] = []
        dead: set[int] = set()  # places in the word that no accepted path goes on from
        start, n, state = 0, len(word), ROOT
        while start < n:
            place = 0
            for byte in word[start:]:
                after = step(place << 8 | byte)
                if after is None:
                    break
                place = after
            token = longest[place]
            while True:
                if token < 0:  # nothing fits: one token back, and on to the next shorter one
                    dead.add(start)
                    if not out:
                        raise ValueError("the vocabulary has no token for some byte")
                    token = out.pop()
                    start -= size[token]
                    state = target[out[-1]] if out else ROOT
                else:
                    key = state << 32 | token
                    arc = arcs.get(key)
                    if arc is None:
                        if len(arcs) >= CACHE_ARCS:
                            arcs.clear()
                        arc = arcs[key] = self.find_arc(state, token)
                    if arc and (not dead or start + size[token] not in dead):
                        break
                token = shorter[token]
            out.append(token)
            start += size[token]
            state = target[token]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class BpeCodec:
    """Whole texts as the tokenizers library encodes and decodes them."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        labels = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in added}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.automaton = TokenAutomaton(labels, [(vocab[a], vocab[b]) for a, b in pairs])
        self.labels = labels | {i: t.encode() for t, i in added.items()}
        self.added = added
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.words = regex.compile(WORD_PATTERN)
        newer = newer_letters() or "\0"
        self.first_newer = min(newer)
        self.newer = regex.compile(f"[{newer}]")
        self.older_words = regex.compile(OLDER_PATTERN.replace("NEWER", newer), regex.V1)
        self.seen: dict[str, tuple[str, int, bytes]] = {}
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def word(self, word: str) -> tuple[str, int, bytes]:
        """Decimal ids joined by commas, their number, and the labels of the arcs."""
        found = self.seen.get(word)
        if found is None:
            ids = self.automaton.encode(word.encode())
            if len(self.seen) >= CACHE_WORDS:
                self.seen.clear()
            found = self.seen[word] = (",".join(map(str, ids)), len(ids), self.automaton.decode(ids))
        return found

    def split(self, text: str) -> list[str]:
        words = self.words if text.isascii() or max(text) < self.first_newer or not self.newer.search(text) else self.older_words
        return words.findall(text)

    def part(self, part: str) -> tuple[str, int, bytes]:
        """As ``word``, of all words of a part."""
        found = self.known.get(part)
        if found is None:
            words = self.split(part)
            if len(words) == 1:
                found = self.word(words[0])
            else:
                each = [self.word(w) for w in words]
                found = ",".join([e[0] for e in each]), sum(e[1] for e in each), b"".join([e[2] for e in each])
            if len(self.known) >= CACHE_PARTS:
                self.known.clear()
            self.known[part] = found
        return found

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for i, piece in enumerate(self.at_added.split(text) if self.at_added else [text]):
            if i % 2:
                ids.append(self.added[piece])
            else:
                for w in self.split(piece):
                    ids += map(int, self.word(w)[0].split(","))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")

    def digests(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """Per text: number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded text.

        Texts with single spaces only are split at them: a part with the space before it has
        the same words wherever it stands."""
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, IRREGULAR)
        for content in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        odd = pc.or_(odd, pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        parts = coded(pc.split_pattern(texts, " "), drop_empty=False)
        by_code = [self.part(" " + p) for p in parts.distinct.tolist()]
        csv, count, label = (np.array([p[k] for p in by_code], kind) for k, kind in ((0, object), (1, np.int64), (2, object)))
        start = 0
        for i, end in enumerate(parts.ends.tolist()):
            if odd[i]:
                ids = self.encode(texts[i].as_py())
                decimal, n, plain = ",".join(map(str, ids)), len(ids), self.decode(ids).encode()
            else:
                first = self.part(parts.distinct[parts.codes[start]])
                own = parts.codes[start + 1:end]
                decimal = ",".join([first[0], *csv[own].tolist()])
                n = first[1] + int(count[own].sum())
                plain = (first[2] + b"".join(label[own].tolist())).decode("utf-8", "replace").encode()
            yield n, hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(plain).hexdigest()
            start = end


def codec(vocabulary: str) -> BpeCodec:
    return worker_cached(f"bpe codec {vocabulary}", lambda: BpeCodec(vocabulary))


def encode_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded`` of each whole text.

    Defined results: NULL text is empty and has no ids; a special token's string in a text is
    that token; repeated rows are encoded once each; an empty table gives no rows;
    columns other than id and text, whatever their names, are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in (part for whole in batches for part in text_slices(whole)):
            ids = [bpe.encode(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())),
                                              pa.array([bpe.decode(x) for x in ids], pa.string())],
                                             ["doc_id", "ids", "decoded"])

    return _rows(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoding_digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the digests of ``encode_documents``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in (part for whole in batches for part in text_slices(whole)):
            rows = list(bpe.digests(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[k] for r in rows], kind)
                                    for k, kind in enumerate((pa.int64(), pa.string(), pa.string())))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(df, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
