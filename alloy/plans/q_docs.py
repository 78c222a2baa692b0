"""Documents, retrieval, learning store and run-telemetry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alloy.functions.columns import confidence_bucket
from alloy.operators import documents as D
from alloy.operators import profile as P
from alloy.operators import search as S
from alloy.operators import telemetry as TM
from alloy.operators.setops import union_like
from alloy.plans.fixtures import (LINEAGE_SQL, OBSERVATIONS_SQL, RUNS_SQL, lineage, observations, run_log,
                                  runs, t)
from alloy.plans.q_profile import DISCOVERY_TABLES, FK_SQL, _tables
from alloy.plans.registry import query

STRIP_SQL = D.STRIP_RE


def chunk_sql(src: str, key: str, keep: tuple[str, ...]) -> str:
    """CTEs that end in ``chunks``: the chunks of ``src``'s texts."""
    cols = ", ".join([key, *keep])
    return f"""paras_t AS (
  SELECT {cols}, list_filter(list_transform(regexp_split_to_array(text, '\\n{{2,}}'),
                 lambda x: regexp_replace(x, '{STRIP_SQL}', '', 'g')), lambda x: x <> '') AS paras
  FROM {src}),
f AS (
  SELECT {cols}, list_reduce(paras, lambda acc, para: CASE
      WHEN length(acc.cur) + length(para) + 1 <= 1500
        THEN {{'chunks': acc.chunks, 'cur': regexp_replace(acc.cur || chr(10) || para, '{STRIP_SQL}', '', 'g')}}
      WHEN length(para) <= 1500
        THEN {{'chunks': CASE WHEN length(acc.cur) > 0 THEN list_append(acc.chunks, acc.cur) ELSE acc.chunks END,
              'cur': para}}
      ELSE {{'chunks': list_concat(CASE WHEN length(acc.cur) > 0 THEN list_append(acc.chunks, acc.cur) ELSE acc.chunks END,
                                  list_transform(range(0, length(para), 1400), lambda i: substr(para, i + 1, 1500))),
            'cur': ''}} END,
    {{'chunks': []::VARCHAR[], 'cur': ''}}) AS st
  FROM paras_t),
cc AS (SELECT {cols}, CASE WHEN length(st.cur) > 0 THEN list_append(st.chunks, st.cur) ELSE st.chunks END AS ch
       FROM f),
chunks AS (SELECT {cols}, chunk_index, chunk_text, length(chunk_text) AS chunk_chars
           FROM (SELECT {cols}, unnest(range(0, len(ch))) AS chunk_index, unnest(ch) AS chunk_text FROM cc))"""


CHUNK_SQL = chunk_sql("documents", "doc_id", ("source",))


def doc_chunks(spark, sf):
    return D.chunk_documents(t(spark, sf, "documents"), "doc_id", "text", keep=("source",))


@query("chunk_documents", f"WITH {CHUNK_SQL} SELECT * FROM chunks", ("K1", "SRC6"))
def q_chunk_documents(spark, sf):
    return doc_chunks(spark, sf)


@query("list_documents", f"""
WITH {CHUNK_SQL}
SELECT doc_id, count(*) AS n_chunks, sum(chunk_chars) AS total_chars, min(chunk_index) AS first_chunk
FROM chunks GROUP BY doc_id""", ("AG8", "K5"))
def q_list_documents(spark, sf):
    return D.list_documents(doc_chunks(spark, sf), "doc_id")


def _decode_sql(s: str) -> str:
    """Character references, piece by piece after each &."""
    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    names = "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in D.entity_names().items()) + "}"
    windows = "MAP {" + ", ".join(f"{k}: {text(v)}" for k, v in D.windows_letters().items()) + "}"
    ref = f"regexp_extract(p, '{D.REFERENCE}', 1)"
    code = (f"CASE WHEN lower({ref}[2:2]) = 'x' THEN CAST('0x' || {ref}[3:] AS BIGINT) ELSE CAST({ref}[2:] AS BIGINT) END")
    char = (f"CASE WHEN {code} = 0 OR {code} BETWEEN 55296 AND 57343 OR {code} > 1114111 THEN chr(65533) "
            f"WHEN {code} BETWEEN 128 AND 159 THEN {windows}[{code}] ELSE chr(CAST({code} AS INT)) END")
    read = (f"CASE WHEN {ref} = '' THEN '&' || p WHEN {ref}[1:1] = '#' THEN {char} || p[length({ref}) + 2:] "
            f"WHEN {names}[{ref}] IS NOT NULL THEN {names}[{ref}] || p[length({ref}) + 2:] ELSE '&' || p END")
    parts = f"string_split({s}, '&')"
    return f"({parts}[1] || array_to_string([{read} FOR p IN {parts}[2:]], ''))"


def _html_sql(col: str) -> str:
    s = f"regexp_replace({col}, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g')"
    s = f"regexp_replace({s}, '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g')"
    s = f"regexp_replace({s}, '(?s)<!--.*?-->', ' ', 'g')"
    s = f"regexp_replace({s}, '<[^>]*>', ' ', 'g')"
    s = _decode_sql(s)
    s = f"regexp_replace({s}, '[ \\t\\n\\r\\f]+', ' ', 'g')"
    return f"trim({s})"


@query("html_to_text", f"""
SELECT *, length(text) AS n_chars FROM (SELECT page_id, url, {_html_sql('html')} AS text FROM pages)""", ("K6",))
def q_html_to_text(spark, sf):
    p = t(spark, sf, "pages").select("page_id", "url", D.html_to_text(F.col("html")).alias("text"))
    return p.withColumn("n_chars", F.length("text"))


REFERENCES_SQL = """hard AS (SELECT page_id, url, '<p>caf&eacute; &#233;t&#xE9; &#8217;' || page_id || '&#150; &amp;lt; &bogus; &copy 2 & 3 &#0;&#xD800;&#x1F600;&nbsp;x</p>' AS html
         FROM pages)"""


@query("html_references", f"""
WITH {REFERENCES_SQL} SELECT page_id, {_html_sql('html')} AS text FROM hard""", ("K6",))
def q_html_references(spark, sf):
    """Numeric, named, unknown, unfinished and impossible character references."""
    html = F.concat(F.lit("<p>caf&eacute; &#233;t&#xE9; &#8217;"), F.col("page_id").cast("string"),
                    F.lit("&#150; &amp;lt; &bogus; &copy 2 & 3 &#0;&#xD800;&#x1F600;&nbsp;x</p>"))
    return t(spark, sf, "pages").select("page_id", D.html_to_text(html).alias("text"))


def _pack_sql(src: str, group: str, order: str, text: str) -> str:
    return f"""WITH RECURSIVE d AS (
  SELECT {group} AS grp, {order} AS ord, CAST(round(length({text}) / 4.0) AS BIGINT) + 50 AS tokens,
         row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn
  FROM {src}),
r AS (SELECT grp, rn, ord, tokens, 0 AS batch_no, 900 + tokens AS tot FROM d WHERE rn = 1
      UNION ALL
      SELECT d.grp, d.rn, d.ord, d.tokens,
             CASE WHEN r.tot + d.tokens > 6000 THEN r.batch_no + 1 ELSE r.batch_no END,
             CASE WHEN r.tot + d.tokens > 6000 THEN 900 + d.tokens ELSE r.tot + d.tokens END
      FROM r JOIN d ON d.grp = r.grp AND d.rn = r.rn + 1)
SELECT grp AS {group}, ord AS {order}, tokens, batch_no,
       900 + sum(tokens) OVER (PARTITION BY grp, batch_no) AS batch_tokens FROM r"""


@query("pack_batches", _pack_sql("documents", "source", "doc_id", "text"), ("K7",))
def q_pack_batches(spark, sf):
    d = t(spark, sf, "documents").select("source", "doc_id", "text")
    return D.pack_batches(d, "source", "doc_id", text_col="text").drop("text")


@query("pack_conversations", _pack_sql("conversations", "conv_id", "turn", "text"), ("K7",))
def q_pack_conversations(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", "turn", "text")
    return D.pack_batches(c, "conv_id", "turn", text_col="text").drop("text")


@query("pack_counts", """WITH RECURSIVE d AS (
  SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 41 = 0 THEN 5200 WHEN event_id % 7 > 0 THEN event_id % 700 ELSE 0 END AS tokens,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
r AS (SELECT user_id, rn, event_id, tokens, 0 AS batch_no, 900 + tokens AS tot FROM d WHERE rn = 1
      UNION ALL
      SELECT d.user_id, d.rn, d.event_id, d.tokens, CASE WHEN r.tot + d.tokens > 6000 THEN r.batch_no + 1 ELSE r.batch_no END,
             CASE WHEN r.tot + d.tokens > 6000 THEN 900 + d.tokens ELSE r.tot + d.tokens END
      FROM r JOIN d ON d.user_id = r.user_id AND d.rn = r.rn + 1)
SELECT user_id, event_id, tokens, batch_no, 900 + sum(tokens) OVER (PARTITION BY user_id, batch_no) AS batch_tokens FROM r""", ("K7",))
def q_pack_counts(spark, sf):
    """Given counts: rows of no tokens, of unknown numbers of them, and such that overfill a batch alone."""
    e = t(spark, sf, "events").select("user_id", "event_id")
    n = F.col("event_id")
    count = F.when(n % 3 == 0, 0).when(n % 41 == 0, 5200).when(n % 7 > 0, n % 700)
    return D.pack_batches(e.withColumn("n", count), "user_id", "event_id", tokens_col="n").drop("n")


TOK = "[\\p{L}\\p{N}_]+"


def bm25_sql(docs: str, doc_id: str, text: str, queries: str, q_id: str, q_text: str) -> str:
    """CTEs that end in ``r``: query, doc, score, rank."""
    return f"""post AS (SELECT doc, term, count(*) AS tf FROM
                (SELECT {doc_id} AS doc, unnest(regexp_extract_all(lower({text}), '{TOK}')) AS term FROM {docs})
              GROUP BY 1, 2),
dl AS (SELECT doc, sum(tf) AS dl FROM post GROUP BY 1),
st AS (SELECT count(*) AS n_docs, avg(coalesce(dl.dl, 0)) AS avgdl FROM {docs} d LEFT JOIN dl ON d.{doc_id} = dl.doc),
dfreq AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
q AS (SELECT DISTINCT query, term FROM
        (SELECT {q_id} AS query, unnest(regexp_extract_all(lower({q_text}), '{TOK}')) AS term FROM {queries})),
s AS (SELECT q.query, p.doc,
             sum(ln(1.0 + (CAST(st.n_docs - f.df AS DOUBLE) + 0.5) / (CAST(f.df AS DOUBLE) + 0.5)) * p.tf * 2.2
                 / (p.tf + 1.2 * (0.25 + 0.75 * dl.dl / st.avgdl))) AS s
      FROM q JOIN dfreq f ON q.term = f.term JOIN post p ON p.term = q.term JOIN dl ON dl.doc = p.doc CROSS JOIN st
      GROUP BY 1, 2),
r AS (SELECT query, doc, round(s, 6) AS score,
             row_number() OVER (PARTITION BY query ORDER BY round(s, 6) DESC, doc) AS rank FROM s)"""


@query("bm25_topk", f"""
WITH {bm25_sql('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text')}
SELECT query AS item_id, doc AS doc_id, score, rank FROM r WHERE rank <= 10""", ("K3", "T3"))
def q_bm25_topk(spark, sf):
    return S.bm25_topk(t(spark, sf, "documents"), "doc_id", "text", t(spark, sf, "benchmark"), "item_id", "text", k=10)


@query("vector_topk", """
WITH c AS (SELECT label, u.pos, avg(CAST(u.val AS DOUBLE)) AS m
           FROM embeddings, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS pos,
                                            unnest(embedding) AS val) u
           GROUP BY label, u.pos),
q AS (SELECT label AS query_id, list(m ORDER BY pos) AS qv FROM c GROUP BY label),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vv FROM embeddings),
s AS (SELECT query_id, vec_id,
             round(list_dot_product(qv, vv) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(vv, vv))), 6) AS score
      FROM q CROSS JOIN v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10""", ("K4", "T3"))
def q_vector_topk(spark, sf):
    """Nearest vectors to each label's centroid (the query batch is derived from the table)."""
    e = t(spark, sf, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("pos", "val"))
    cent = parts.groupBy("label", "pos").agg(F.avg(F.col("val").cast("double")).alias("m"))
    queries = cent.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_c")).select(
        F.col("label").cast("long").alias("query_id"), F.transform("_c", lambda x: x["m"]).alias("embedding"))
    return S.vector_topk(e, "vec_id", "embedding", queries, "query_id", "embedding", k=10)


REINFORCE_SQL = f"""{OBSERVATIONS_SQL},
lg AS (SELECT pattern_signature, count(*) AS times_observed, max(observed_at) AS last_observed,
              list_reduce(list(confidence ORDER BY observed_at, event_id),
                          lambda a, c: least((a + c) / 2.0 + 0.05, 1.0)) AS conf,
              arg_max(observation, (observed_at, event_id)) AS observation,
              arg_max(recommendation, (observed_at, event_id)) AS recommendation
       FROM obs GROUP BY 1),
learnings AS (SELECT pattern_signature, times_observed, last_observed, round(conf, 6) AS confidence,
                     observation, recommendation, round(conf, 6) >= 0.5 AS is_active FROM lg)"""


def learnings_df(spark, sf):
    return TM.reinforce(observations(spark, sf), "pattern_signature", "observed_at", "event_id", "confidence",
                        text_cols=("observation", "recommendation"))


@query("reinforce", f"WITH {REINFORCE_SQL} SELECT * FROM learnings", ("K8", "U4"))
def q_reinforce(spark, sf):
    return learnings_df(spark, sf)


@query("top_learnings", f"""
WITH {REINFORCE_SQL}
SELECT * FROM learnings WHERE is_active AND confidence > 0.7
ORDER BY confidence DESC, times_observed DESC, pattern_signature LIMIT 5""", ("TM6", "T1"))
def q_top_learnings(spark, sf):
    return TM.top_learnings(learnings_df(spark, sf), 5)


@query("kpis", f"""
WITH {RUNS_SQL}, {LINEAGE_SQL}, {REINFORCE_SQL}
SELECT (SELECT count(*) FROM runs) AS runs, (SELECT count(silver_table) FROM lineage) AS silver_complete,
       (SELECT count(gold_table) FROM lineage) AS gold_complete,
       (SELECT count_if(is_active) FROM learnings) AS active_learnings""", ("TM2", "J10"))
def q_kpis(spark, sf):
    return TM.kpis(runs(spark, sf), lineage(spark, sf), learnings_df(spark, sf))


@query("run_results", f"""
WITH {RUNS_SQL}
SELECT execution_id, phase AS table_name, count(*) AS rows,
       CASE WHEN phase = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status
FROM runlog GROUP BY execution_id, phase""", ("TM3",))
def q_run_results(spark, sf):
    log = run_log(spark, sf)
    per = log.groupBy("execution_id", "phase").agg(F.count(F.lit(1)).alias("rows"))
    nested = per.groupBy("execution_id").agg(F.collect_list(F.struct(
        F.col("phase").alias("table_name"), "rows",
        F.when(F.col("phase") == "error", "FAILED").otherwise("SUCCESS").alias("status"))).alias("results"))
    return TM.run_results(nested, "execution_id", "results")


@query("coverage_level", f"""
WITH {LINEAGE_SQL}
SELECT CASE WHEN gold_status = 'COMPLETE' THEN 'Bronze+Silver+Gold' WHEN silver_status = 'COMPLETE' THEN 'Bronze+Silver'
            ELSE 'Bronze Only' END AS coverage_level, count(*) AS n_tables
FROM lineage GROUP BY 1""", ("TM4",))
def q_coverage_level(spark, sf):
    return TM.coverage_level(lineage(spark, sf))


@query("gaps", f"""
WITH {LINEAGE_SQL}
SELECT 'SILVER' AS layer, bronze_table FROM lineage WHERE silver_table IS NULL
UNION ALL SELECT 'GOLD', bronze_table FROM lineage WHERE silver_table IS NOT NULL AND gold_table IS NULL""", ("TM1",))
def q_gaps(spark, sf):
    return TM.gaps(lineage(spark, sf))


# ---- knowledge corpus: learnings, plans, relationships, document chunks ----------------
# fixed values: the least confidences of the corpus, and what its texts look like
MIN_LEARNING, MIN_PLAN, MIN_RELATIONSHIP = 0.5, 0.6, 0.65


def plans_df(spark, sf):
    """One plan per logged step: table, strategy, confidence, reasoning, key columns."""
    return run_log(spark, sf).select(
        F.concat(F.lit("T"), F.lpad(F.col("execution_id").cast("string"), 5, "0")).alias("source_table"),
        F.col("phase").alias("transformation_strategy"), "confidence", "event_id",
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("step "), F.col("event_id").cast("string"))).alias("reasoning"),
        F.when(F.col("event_id") % 3 == 0, F.lit("event_id")).alias("pk_columns"))


PLANS_SQL = """plans AS (
  SELECT 'T' || lpad(CAST(execution_id AS VARCHAR), 5, '0') AS source_table, phase AS transformation_strategy, confidence, event_id,
         CASE WHEN event_id % 2 = 0 THEN 'step ' || CAST(event_id AS VARCHAR) END AS reasoning,
         CASE WHEN event_id % 3 = 0 THEN 'event_id' END AS pk_columns
  FROM runlog)"""


def corpus_df(spark, sf):
    lrn = learnings_df(spark, sf).filter(F.col("is_active") & (F.col("confidence") >= MIN_LEARNING)).select(
        F.lit("learning").alias("source_type"), F.col("pattern_signature").alias("source_id"),
        F.col("pattern_signature").alias("source_context"), "confidence",
        F.concat(F.lit("["), F.upper(F.split("pattern_signature", ":")[0]), F.lit("] "), "pattern_signature", F.lit(": "),
                 "observation", F.lit(" - Recommendation: "), "recommendation").alias("text_content"))
    plans = plans_df(spark, sf).filter(F.col("confidence") >= MIN_PLAN).select(
        F.lit("planner_decision").alias("source_type"), F.col("event_id").cast("string").alias("source_id"),
        F.col("source_table").alias("source_context"), "confidence",
        F.concat(F.lit("[PLAN] "), "source_table", F.lit(" ("), "transformation_strategy", F.lit("): "),
                 F.coalesce("reasoning", F.lit("")), F.lit(" | PK: "), F.coalesce("pk_columns", F.lit("unknown"))).alias("text_content"))
    edges = P.discover_fks(_tables(spark, sf, DISCOVERY_TABLES), MIN_RELATIONSHIP).select(
        F.lit("schema_relationship").alias("source_type"),
        F.concat_ws(".", "source_table", "source_column", "target_table", "target_column").alias("source_id"),
        F.col("source_table").alias("source_context"), "confidence",
        F.concat(F.lit("[FK] "), "source_table", F.lit("."), "source_column", F.lit(" -> "), "target_table", F.lit("."),
                 "target_column", F.lit(" ("), "relationship_type", F.lit(", "),
                 F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("% confidence)")).alias("text_content"))
    chunks = doc_chunks(spark, sf).select(
        F.lit("document_context").alias("source_type"),
        F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("chunk_index").cast("string")).alias("source_id"),
        F.col("source").alias("source_context"), F.lit(1.0).alias("confidence"),
        F.concat(F.lit("[DOC:TXT] "), "source", F.lit(" | "), "chunk_text").alias("text_content"))
    corpus = union_like([lrn, plans, edges, chunks])
    return corpus.withColumn("confidence_bucket", confidence_bucket("confidence")).drop("confidence")


CORPUS_SQL = f"""{CHUNK_SQL}, {REINFORCE_SQL}, {FK_SQL}, {RUNS_SQL}, {PLANS_SQL},
corpus0 AS (
  SELECT 'learning' AS source_type, pattern_signature AS source_id, pattern_signature AS source_context, confidence,
         '[' || upper(split_part(pattern_signature, ':', 1)) || '] ' || pattern_signature || ': ' || observation
           || ' - Recommendation: ' || recommendation AS text_content
  FROM learnings WHERE is_active AND confidence >= {MIN_LEARNING}
  UNION ALL
  SELECT 'planner_decision', CAST(event_id AS VARCHAR), source_table, confidence,
         '[PLAN] ' || source_table || ' (' || transformation_strategy || '): ' || coalesce(reasoning, '') || ' | PK: '
           || coalesce(pk_columns, 'unknown')
  FROM plans WHERE confidence >= {MIN_PLAN}
  UNION ALL
  SELECT 'schema_relationship', source_table || '.' || source_column || '.' || target_table || '.' || target_column, source_table, confidence,
         '[FK] ' || source_table || '.' || source_column || ' -> ' || target_table || '.' || target_column || ' ('
           || relationship_type || ', ' || CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '% confidence)'
  FROM edges WHERE confidence >= {MIN_RELATIONSHIP}
  UNION ALL
  SELECT 'document_context', CAST(doc_id AS VARCHAR) || '#' || CAST(chunk_index AS VARCHAR), source, 1.0::DOUBLE,
         '[DOC:TXT] ' || source || ' | ' || chunk_text FROM chunks),
corpus AS (SELECT * EXCLUDE (confidence),
                  CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.65 THEN 'medium' ELSE 'low' END AS confidence_bucket
           FROM corpus0)"""


@query("corpus", f"WITH {CORPUS_SQL} SELECT * FROM corpus", ("K2", "U1"))
def q_corpus(spark, sf):
    return corpus_df(spark, sf)


@query("corpus_mix", f"""
WITH {CORPUS_SQL}
SELECT source_type, count(*) AS n_items, count_if(confidence_bucket = 'high') AS n_high FROM corpus GROUP BY 1""",
       ("TM9", "AG2"))
def q_corpus_mix(spark, sf):
    c = corpus_df(spark, sf)
    return c.groupBy("source_type").agg(F.count(F.lit(1)).alias("n_items"),
                                        F.count_if(F.col("confidence_bucket") == "high").alias("n_high"))


@query("search_corpus", f"""
WITH {CORPUS_SQL},
docs AS (SELECT source_id, text_content FROM corpus
         WHERE source_type IN ('learning', 'planner_decision') AND confidence_bucket IN ('high', 'medium')),
{bm25_sql('docs', 'source_id', 'text_content', "(SELECT DISTINCT event_type, 'plan for ' || event_type || ' step' AS q FROM events)",
          'event_type', 'q')}
SELECT query AS event_type, doc AS source_id, score, rank FROM r WHERE rank <= 10""", ("K3",))
def q_search_corpus(spark, sf):
    """The corpus searched for each event type, by source type and confidence."""
    queries = t(spark, sf, "events").select(
        "event_type", F.concat(F.lit("plan for "), "event_type", F.lit(" step")).alias("q")).distinct()
    wanted = F.col("source_type").isin("learning", "planner_decision") & F.col("confidence_bucket").isin("high", "medium")
    return S.bm25_topk(corpus_df(spark, sf), "source_id", "text_content", queries, "event_type", "q", k=10, filters=wanted)


# ---- saved semantic-model questions ----------------------------------------------
@query("saved_coverage_status", f"""
WITH {LINEAGE_SQL}
SELECT bronze_table, silver_table, silver_status, gold_table, gold_status, bronze_rows, silver_rows, gold_rows
FROM lineage""", ("TM8",))
def q_saved_coverage_status(spark, sf):
    return lineage(spark, sf).select("bronze_table", "silver_table", "silver_status", "gold_table", "gold_status",
                                     "bronze_rows", "silver_rows", "gold_rows").orderBy("bronze_table")


@query("saved_silver_pct", f"""
WITH {LINEAGE_SQL}
SELECT count(DISTINCT bronze_table) AS total_tables, count_if(silver_status = 'COMPLETE') AS silver_complete,
       round(CAST(count_if(silver_status = 'COMPLETE') AS DOUBLE) * 100.0 / CAST(nullif(count(*), 0) AS DOUBLE), 1) AS silver_pct
FROM lineage""", ("TM8",))
def q_saved_silver_pct(spark, sf):
    complete = F.count_if(F.col("silver_status") == "COMPLETE")
    return TM.metric(lineage(spark, sf), {
        "total_tables": F.count_distinct("bronze_table"), "silver_complete": complete,
        "silver_pct": F.round(complete.cast("double") * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0)).cast("double"), 1)})


@query("saved_strategies_by_confidence", f"""
WITH {RUNS_SQL}, {PLANS_SQL}
SELECT source_table, transformation_strategy, confidence, pk_columns, event_id FROM plans""", ("TM8",))
def q_saved_strategies(spark, sf):
    return (plans_df(spark, sf).select("source_table", "transformation_strategy", "confidence", "pk_columns", "event_id")
            .orderBy(F.col("confidence").desc_nulls_last(), "event_id"))


@query("saved_active_learnings", f"""
WITH {REINFORCE_SQL}
SELECT split_part(pattern_signature, ':', 1) AS learning_type, pattern_signature AS source_context, observation, recommendation,
       confidence, times_observed
FROM learnings WHERE is_active""", ("TM8",))
def q_saved_active_learnings(spark, sf):
    lrn = learnings_df(spark, sf).filter("is_active")
    return (lrn.select(F.split("pattern_signature", ":")[0].alias("learning_type"), F.col("pattern_signature").alias("source_context"),
                       "observation", "recommendation", "confidence", "times_observed")
            .orderBy(F.col("confidence").desc(), "source_context"))


@query("saved_strong_fks", f"""
WITH {FK_SQL}
SELECT source_table, source_column, target_table, relationship_type, confidence FROM edges WHERE confidence >= 0.7""", ("TM8",))
def q_saved_strong_fks(spark, sf):
    edges = P.discover_fks(_tables(spark, sf, DISCOVERY_TABLES), 0.7)
    return (edges.select("source_table", "source_column", "target_table", "relationship_type", "confidence")
            .orderBy(F.col("confidence").desc(), "source_table", "source_column"))


@query("saved_runs_by_status", f"""
WITH {RUNS_SQL} SELECT status, count(*) AS n_runs FROM runs GROUP BY status""", ("TM8",))
def q_saved_runs_by_status(spark, sf):
    return TM.metric(runs(spark, sf), {"n_runs": F.count(F.lit(1))}, ["status"])
