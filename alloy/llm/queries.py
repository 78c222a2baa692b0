"""The registered query of each operator, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alloy.llm.common import table

#: kinds of token files that the queries use; their place is the tokenizers package's
BYTE_BPE, WORD_BPE, BYTE_RANKS = "byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op3_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of ``documents`` through a fresh persistent digest index."""
    import uuid

    from alloy.llm.digest_index import DigestIndex, dedup_batch
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    return dedup_batch(index, table(spark, sf_dir, "documents"))


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and their round trip, as digests."""
    from alloy.llm.bpe_automaton import encoding_digests
    return encoding_digests(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))


def op9_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    from alloy.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op1_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how like they are."""
    from alloy.llm.fingerprint import compare_edited
    return compare_edited(table(spark, sf_dir, "documents"))


def op2_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from alloy.llm.style_tree import extract
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, counted by base kind and written out."""
    from alloy.llm.secret_scan import KINDS, find_secrets, written
    found = find_secrets(table(spark, sf_dir, "documents"), vocabulary(BYTE_RANKS))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels of ids that are not held out."""
    from alloy.llm.quality_rank import fit, score
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), train=~held_out())
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op7_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stay when repeated passages go."""
    from alloy.llm.substring_dedup import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    from alloy.llm.near_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document under a model of the whole corpus."""
    from alloy.llm.pseudo_lm import fit, score
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))


def op11_galloping_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers in every document, aligned."""
    from alloy.llm.token_alignment import alignment_digests
    return alignment_digests(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), vocabulary(BYTE_RANKS), vocabulary(PIECES))


def op12_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives of one gzip stream each, normalised and read back."""
    import uuid

    from alloy.llm.warc import normalise, read_records, write_archives
    from alloy.session import scratch_path
    folder = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    index = normalise(write_archives(table(spark, sf_dir, "pages"), f"{folder}/whole"), f"{folder}/members")
    page = [F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long") for c in ("record_id", "refers_to")]
    return read_records(index).select(
        page[0].alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("type").alias("record_type"), page[1].alias("refers_to"))


def op13_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    from alloy.llm.geometric_index import rank_documents
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: fn
    for fn in (op1_piecewise_hash, op2_style_tree, op3_digest_index, op4_token_efficiency, op5_pairwise_quality, op6_bpe_automaton,
               op7_fm_index, op8_chosen_path, op9_sum_of_squares, op10_pseudo_likelihood, op11_galloping_alignment, op12_gzip_normaliser,
               op13_geometric_blocks)
}

ORACLES: dict[str, str] = {
    "op3_digest_index": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
            FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
        FROM d WINDOW w AS (PARTITION BY h)""",
    "op12_gzip_normaliser": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (SELECT page_id, h, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS last,
                     [('0x' || h[5 * i + 1:5 * i + 5])::INT for i in range(8)] AS parts FROM p)
        SELECT page_id, payload_bytes, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN last <> page_id THEN last END AS refers_to,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((parts[i // 4 + 1] >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1) for i in range(32)], '') AS payload_digest
        FROM d""",
    "op13_geometric_blocks": r"""
        WITH words AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
        docs AS (SELECT r, doc_id, t, len(t) AS n FROM words WHERE len(t) > 0),
        total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM docs),
        post AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) GROUP BY r, term),
        weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
                    FROM (SELECT term, count(*) AS df FROM post GROUP BY term), total),
        asked AS (SELECT i, item_id, term, count(*) AS often FROM (
            SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY i, item_id, term),
        scores AS (
            SELECT i, item_id, r, doc_id,
                   sum(often * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
            FROM asked JOIN post USING (term) JOIN weights USING (term) JOIN docs USING (r), total
            GROUP BY i, item_id, r, doc_id)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
        WHERE rank <= 10""",
}
