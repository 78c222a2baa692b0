"""Retrieval: BM25 text search over postings and exact cosine top-k over vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloy.operators.windows import top_k_per_group
from alloy.session import cut_lineage

# ---- fixed values: tokenizer and BM25 parameters ---------------------------------
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
BM25_K1 = 1.2
BM25_B = 0.75
# terms of queries up to which they are broadcast, and postings that a task scores
BROADCAST_TERMS, POSTINGS = 1_000_000, 200_000
# ---------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def bm25_topk(docs: DataFrame, doc_id: str, doc_text: str, queries: DataFrame, q_id: str,
              q_text: str, k: int = 10, k1: float = BM25_K1, b: float = BM25_B,
              filters: Column | None = None) -> DataFrame:
    """Top-k documents per query by BM25 (query terms counted once).

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); score summed over shared terms; rank by
    round(score, 6) desc then doc id.

    Plan: N and avgdl are scalar subqueries over per-document token counts; postings are
    restricted to the query vocabulary by a broadcast semi-join right after tokenising, carrying the
    document length along, so the full postings list is never shuffled or joined; per-term df over
    that vocabulary is broadcast back (all behind a count of the query terms, which decides what
    is broadcast). Postings meet the queries by document, POSTINGS a task, where a (query, doc)
    has all its terms: tasks grow in number, not in size, and scores are not moved. The rank-limited
    top-k is pre-limited map-side, so a hot term or a query with many candidates is never one task.
    """
    if filters is not None:
        docs = docs.filter(filters)
    qterms = cut_lineage(queries.select(F.col(q_id).alias("query"), F.explode(tokens(F.col(q_text))).alias("term")).distinct())
    few = qterms.count() <= BROADCAST_TERMS

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    vocab = qterms.select("term").distinct().withColumn("_in", F.lit(True))
    toks = docs.select(F.col(doc_id).alias("doc"), tokens(F.col(doc_text)).alias("_toks"))
    dl = F.when(F.col("_toks").isNull(), F.lit(0)).otherwise(F.size("_toks"))
    # explode_outer keeps token-less documents (they count in N) and avoids a second
    # regex evaluation in an inferred size() filter; out-of-vocabulary tokens collapse
    # into one NULL-term row per document
    tagged = (toks.select("doc", dl.alias("dl"), F.explode_outer("_toks").alias("term"))
              .join(small(vocab), "term", "left")
              .select("doc", "dl", F.when(F.col("_in"), F.col("term")).alias("term")))
    post_all = cut_lineage(tagged.groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    per_doc = post_all.groupBy("doc").agg(F.max("dl").alias("dl"))
    n_docs = per_doc.agg(F.count(F.lit(1))).scalar()
    avgdl = per_doc.agg(F.avg("dl")).scalar()
    post = post_all.filter(F.col("term").isNotNull())
    tasks = max(1, -(-post.count() // POSTINGS))
    dfreq = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(1.0) + (n_docs - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    weights = (post.repartition(tasks, "doc").join(small(dfreq), "term")
               .withColumn("w", idf * F.col("tf") * F.lit(k1 + 1) / (
                   F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / avgdl)))
               .select("term", "doc", "w"))
    hits = weights.join(small(qterms), "term")
    scores = hits.groupBy("query", "doc").agg(F.sum("w").alias("_s")).withColumn("score", F.round("_s", 6))
    top = top_k_per_group(scores, ["query"], [F.col("score").desc(), F.col("doc").asc()], k)
    return top.select(F.col("query").alias(q_id), F.col("doc").alias(doc_id), "score", "rank")


#: queries and vectors that one task multiplies at a time
QUERY_BLOCK, VECTOR_BLOCK = 4096, 50_000


def vector_topk(vectors: DataFrame, id_col: str, vec_col: str, queries: DataFrame, q_id: str,
                q_vec: str, k: int = 10) -> DataFrame:
    """Exact cosine top-k of a query batch of any size against all vectors.

    Queries and vectors are dealt to blocks; each pair of blocks meets in one task, which
    multiplies the two matrices and keeps the k best of each query (and their ties), so at
    most k rows per query and vector block are merged. A vector of length zero, or with a
    NULL, has no angle: its score is NULL and ranks last.
    """
    def dealt(df: DataFrame, key: str, vec: str, size: int, mine: str) -> tuple[DataFrame, int]:
        blocks = max(1, -(-df.count() // size))
        return df.select(F.col(key).alias(f"{mine}_id"), F.transform(F.col(vec), lambda x: x.cast("double")).alias(f"{mine}_vec"),
                         F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(f"{mine}_block")), blocks

    (q, n_q), (v, n_v) = dealt(queries, q_id, q_vec, QUERY_BLOCK, "q"), dealt(vectors, id_col, vec_col, VECTOR_BLOCK, "v")
    q = q.withColumn("v_block", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))))
    v = v.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    kinds = {f.name: f.dataType.simpleString() for f in (*q.schema.fields, *v.schema.fields)}

    def unit(rows: pd.Series, width: int) -> np.ndarray:
        out = np.full((len(rows), width), np.nan)
        for i, x in enumerate(rows):
            if x is not None and len(x) == width:
                out[i] = x
        with np.errstate(invalid="ignore", divide="ignore"):
            return out / np.sqrt((out * out).sum(1, keepdims=True))

    def best(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(vs):
            return pd.DataFrame({"query": [], "doc": [], "score": []})
        vs = vs.sort_values("v_id", kind="stable")
        width = max(len(x) for x in [*qs["q_vec"].dropna(), *vs["v_vec"].dropna(), ()])
        docs, right = vs["v_id"].to_numpy(), unit(vs["v_vec"], width).T
        out = []
        for query, row in zip(qs["q_id"], unit(qs["q_vec"], width), strict=True):
            scores = row @ right
            worth = np.where(np.isnan(scores), -np.inf, scores)
            if len(worth) > k:
                floor = np.partition(worth, -k)[-k] - 2e-6  # scores that round to one value tie
                chosen = np.flatnonzero(worth >= floor) if np.isfinite(floor) else np.argsort(-worth, kind="stable")[:k]
            else:
                chosen = np.arange(len(worth))
            out.append(pd.DataFrame({"query": query, "doc": docs[chosen], "score": scores[chosen]}))
        return pd.concat(out)

    found = q.groupBy("q_block", "v_block").cogroup(v.groupBy("q_block", "v_block")).applyInPandas(
        best, f"query {kinds['q_id']}, doc {kinds['v_id']}, score double")
    score = F.when(~F.isnan("score"), F.round("score", 6))
    top = top_k_per_group(found.withColumn("score", score), ["query"], [F.col("score").desc(), F.col("doc").asc()], k)
    return top.select(F.col("query").alias(q_id), F.col("doc").alias(id_col), "score", "rank")
