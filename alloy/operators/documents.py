"""Documents: chunking, HTML to text, document listing, token-budget batching.

Chunking and HTML extraction are column expressions (split / higher-order
``aggregate`` fold / regexp chain) evaluated per row inside whole-stage codegen;
whole texts are processed, never prefixes.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloy.operators import batching

# ---- fixed values ---------------------------------------------------------------
CHUNK_SIZE = 1500
CHUNK_OVERLAP = 100
# Whitespace removed by a paragraph strip (the characters Python's str.isspace accepts).
STRIP_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
               r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
PARAGRAPH_SPLIT = r"\n{2,}"
# Token estimate and prompt budget for batching: tokens = round(len / 4) + 50,
# every batch starts at 900, a batch never exceeds 6000 unless a single row does.
TOKEN_DIVISOR = 4.0
TOKEN_OVERHEAD = 50
BATCH_BASE = 900
BATCH_BUDGET = 6000
# ---------------------------------------------------------------------------------

STRIP_RE = f"^{STRIP_CLASS}+|{STRIP_CLASS}+$"
# the same character set spelled out, for btrim (a character-set trim, no regex)
STRIP_CHARS = ("\t\n\x0b\f\r" + "".join(chr(c) for c in range(0x1C, 0x20)) + " \x85\xa0\u1680"
               + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(STRIP_CHARS))


def chunk_array(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """array<string> of chunks: paragraphs (split on blank lines, stripped, empties
    dropped) packed greedily while ``len(cur) + len(p) + 1 <= size`` joined by a newline;
    a paragraph longer than ``size`` flushes and is sliced every ``size - overlap``."""
    step = size - overlap
    paras = F.filter(F.transform(F.split(text, PARAGRAPH_SPLIT), strip), lambda p: p != "")
    init = F.struct(F.array().cast("array<string>").alias("chunks"), F.lit("").alias("cur"))

    def fold(acc: Column, p: Column) -> Column:
        cur, chunks = acc["cur"], acc["chunks"]
        emitted = F.when(F.length(cur) > 0, F.array_append(chunks, cur)).otherwise(chunks)
        slices = F.transform(F.sequence(F.lit(0), F.length(p) - 1, F.lit(step)),
                             lambda i: F.substring(p, i + 1, size))
        return (F.when(F.length(cur) + F.length(p) + 1 <= size,
                       F.struct(chunks.alias("chunks"), strip(F.concat(cur, F.lit("\n"), p)).alias("cur")))
                .when(F.length(p) <= size, F.struct(emitted.alias("chunks"), p.alias("cur")))
                .otherwise(F.struct(F.concat(emitted, slices).alias("chunks"), F.lit("").alias("cur"))))

    def finish(acc: Column) -> Column:
        return F.when(F.length(acc["cur"]) > 0, F.array_append(acc["chunks"], acc["cur"])).otherwise(acc["chunks"])

    return F.aggregate(paras, init, fold, finish)


def chunk_documents(df: DataFrame, id_col: str, text_col: str, size: int = CHUNK_SIZE,
                    overlap: int = CHUNK_OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk: ``(id, *keep, chunk_index from 0, chunk_text, chunk_chars)``."""
    exploded = df.select(F.col(id_col), *keep,
                         F.posexplode(chunk_array(F.col(text_col), size, overlap)).alias("chunk_index", "chunk_text"))
    return exploded.withColumn("chunk_chars", F.length("chunk_text"))


def list_documents(chunks: DataFrame, doc_col: str, extra_first: str | None = None) -> DataFrame:
    """Per document: chunk count, total characters, first chunk index (and first-seen time)."""
    aggs = [F.count(F.lit(1)).alias("n_chunks"), F.sum("chunk_chars").alias("total_chars"),
            F.min("chunk_index").alias("first_chunk")]
    if extra_first:
        aggs.append(F.min(extra_first).alias("first_seen"))
    return chunks.groupBy(doc_col).agg(*aggs)


def entity_names() -> dict[str, str]:
    """Named character references of HTML 4 and ``apos``, from the standard library; a
    no-break space is read as a space."""
    return {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}


def windows_letters() -> dict[int, str]:
    """What pages mean by the numbers 128 to 159: the letters of Windows-1252, where it has one."""
    return {code: bytes([code]).decode("cp1252", "ignore") or "\ufffd" for code in range(128, 160)}


REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{0,31});"


def decode_references(text: Column) -> Column:
    """Character references as their characters, each read once (``&amp;lt;`` becomes ``&lt;``).
    Numbers that stand for no character become U+FFFD; unknown names stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in entity_names().items() for x in pair])
    windows = F.create_map(*[x for code, letter in windows_letters().items() for x in (F.lit(code).cast("long"), F.lit(letter))])

    def character(code: Column) -> Column:
        plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return (F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("\ufffd"))
                .when(code.between(128, 159), F.element_at(windows, code)).otherwise(plain))

    def read(piece: Column) -> Column:
        ref = F.regexp_extract(piece, REFERENCE, 1)
        rest = F.substr(piece, F.length(ref) + 2)
        code = F.when(F.lower(F.substring(ref, 2, 1)) == "x", F.conv(F.substr(ref, F.lit(3)), 16, 10)).otherwise(F.substr(ref, F.lit(2))).try_cast("long")
        found = F.when(F.startswith(ref, F.lit("#")), character(code)).otherwise(F.element_at(names, ref))
        return F.when((ref != "") & found.isNotNull(), F.concat(found, rest)).otherwise(F.concat(F.lit("&"), piece))

    parts = F.split(text, "&", -1)
    decoded = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), read), ""))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Drop script / style / comments, replace tags by spaces, decode character
    references, collapse whitespace."""
    s = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    s = F.regexp_replace(s, r"(?is)<style\b[^>]*>.*?</style\s*>", " ")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    s = F.regexp_replace(decode_references(s), r"[ \t\n\r\f]+", " ")
    return F.trim(s)


def token_estimate(text: Column) -> Column:
    return (F.round(F.coalesce(F.length(text), F.lit(0)) / F.lit(TOKEN_DIVISOR)).cast("int") + F.lit(TOKEN_OVERHEAD)).cast("long")


# ---- greedy batching ------------------------------------------------------------
def pack_batches(df: DataFrame, group: str, order: str, text_col: str | None = None,
                 tokens_col: str | None = None, budget: int = BATCH_BUDGET, base: int = BATCH_BASE,
                 block_width: int = 4096) -> DataFrame:
    """Greedy token-budget batching per group in ``order`` (whole numbers, unique per group).

    A row joins the current batch while ``base + batch tokens + t <= budget``; an empty
    batch always takes the row. Output: input columns + ``tokens``, ``batch_no`` (from 0 per
    group), ``batch_tokens``. Computed by composing blocks of ``block_width`` order numbers
    (``alloy.operators.batching``). Rows with NULL group are one group; a NULL text has the
    tokens of an empty one; a NULL token count is 0 tokens, and rows of 0 tokens join the
    batch before them, unless a single row overfills it."""
    tokens = F.coalesce(F.col(tokens_col), F.lit(0)).cast("long") if tokens_col else token_estimate(F.col(text_col))
    return batching.pack_batches(df, group, order, tokens, budget - base, base, block_width)
