"""Secret scan: fixed base patterns, and runs of text that a token vocabulary compresses badly.

A run of key-like characters with letters and digits is a random string if it has fewer than
``MAX_RATIO`` characters per token of the vocabulary: prose, names and paths are made of long
tokens, random strings of tokens of one or two characters. Digests in the usual lengths,
UUIDs and strings given as known are identifiers, not secrets. Spans are in code points, end
exclusive, by start, then by kind in the order of ``KINDS``; of a run that overlaps base spans,
the parts outside them are judged, each as a run. A run of letters only needs fewer than
``MAX_LETTERS_RATIO`` characters per token.

Defined results: NULL text is empty and has no spans (``redacted`` leaves it NULL); rows are
scanned one by one, so repeated rows and ids repeat their spans; an empty table gives no rows; columns other than id and text, whatever their
names, are ignored. The ratio of a run of more than 4,096 characters is judged part by part, as it
is tokenised in such parts.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloy.llm.common import text_or_empty, text_slices, worker_cached

# ---- fixed values: the base patterns and their least lengths ---------------------
KINDS = ("assign", "access", "hex", "dense")
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# usual lengths of hexadecimal digests; the form of a UUID
DIGEST = r"(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"
UUID = r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
# ----------------------------------------------------------------------------------
RUN = r"[A-Za-z0-9+/=_-]{20,}"
RUN_LEAST = 20
MAX_RATIO = 2.0
#: of runs without digits, at least RUN_LEAST letters long
MAX_LETTERS_RATIO = 1.75
MASK = "[secret]"
SPANS = "array<struct<kind:string,start:int,end:int>>"
#: RE2 forms that hold wherever the patterns do, so that most texts need no closer look
HINTS = (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}", RUN)
#: characters of a run that are tokenised together at most
RUN_PART = 4096


class Scanner:
    def __init__(self, vocabulary: str, known: frozenset[str] = frozenset(), max_ratio: float = MAX_RATIO):
        import tiktoken
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        # a run is one word: no splitting before the merges
        self.tokens = tiktoken.Encoding("runs", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
        self.access, self.hex, self.run = re.compile(ACCESS), re.compile(HEX), re.compile(RUN)
        self.identifier = re.compile(f"{DIGEST}|{UUID}")
        self.letters = re.compile(r"(?:[^A-Za-z0-9]*[A-Za-z]){%d}[^0-9]*" % RUN_LEAST)
        self.mixed = re.compile(r"(?=[^0-9]*[0-9])[^A-Za-z]*[A-Za-z]")
        self.known, self.max_ratio = known, max_ratio

    def is_known(self, run: str) -> bool:
        return run in self.known or self.identifier.fullmatch(run) is not None

    def is_random(self, run: str) -> bool:
        if self.is_known(run):
            return False
        if self.mixed.match(run):
            ratio = self.max_ratio
        elif self.letters.fullmatch(run):
            ratio = min(self.max_ratio, MAX_LETTERS_RATIO)
        else:
            return False
        tokens = sum(len(self.tokens.encode_ordinary(run[i:i + RUN_PART])) for i in range(0, len(run), RUN_PART))
        return len(run) < ratio * tokens

    def spans(self, text: str, hints: tuple[bool, ...] = (True,) * 4) -> list[tuple[int, int, int]]:
        """(start, kind, end) of all spans in order."""
        found = []
        if hints[0]:
            found += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        if hints[1]:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text)]
        if hints[2]:
            found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        if hints[3]:
            base = covered(found)
            starts = [s for s, _ in base]
            for m in self.run.finditer(text):
                if self.is_known(m.group()):
                    continue
                # the parts of the run between the base spans that it meets
                at = m.start()
                first = max(0, int(np.searchsorted(starts, m.start(), "right")) - 1)
                met = base[first:int(np.searchsorted(starts, m.end()))]
                for start, end in [*met, (m.end(), m.end())]:
                    if start - at >= RUN_LEAST and self.is_random(text[at:start]):
                        found.append((at, 3, start))
                    at = max(at, end)
        return sorted(found)

    def scan(self, texts: pa.Array) -> Iterator[list[tuple[int, int, int]]]:
        hints = [pc.match_substring_regex(texts, h).to_numpy(zero_copy_only=False) for h in HINTS]
        for i, own in enumerate(zip(*hints, strict=True)):
            yield self.spans(texts[i].as_py(), own) if any(own) else []


def covered(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint (start, end) in order."""
    out: list[tuple[int, int]] = []
    for start, _, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def scanner(vocabulary: str, known: frozenset[str], max_ratio: float) -> Scanner:
    return worker_cached(f"scanner {vocabulary} {max_ratio} {sorted(known)}", lambda: Scanner(vocabulary, known, max_ratio))


def find_secrets(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 known: frozenset[str] = frozenset(), max_ratio: float = MAX_RATIO) -> DataFrame:
    """``doc_id, spans``: every base and added span of each whole text. ``known``: strings that
    are no secrets (a list that the caller keeps, sent to each task)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(vocabulary, known, max_ratio)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in (part for whole in batches for part in text_slices(whole)):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in own] for own in scan.scan(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans {SPANS}")


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, vocabulary: str, known: frozenset[str] = frozenset(),
             max_ratio: float = MAX_RATIO) -> Column:
    """The text with every span replaced by MASK; a text without secrets is unchanged."""
    def run(texts: pd.Series) -> pd.Series:
        scan = scanner(vocabulary, known, max_ratio)
        out = []
        for text, spans in zip(texts, scan.scan(pa.array(texts.fillna(""), pa.large_string())), strict=True):
            if text is not None and spans:
                parts, done = [], 0
                for start, end in covered(spans):
                    parts += [text[done:start], MASK]
                    done = end
                text = "".join([*parts, text[done:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(text)
