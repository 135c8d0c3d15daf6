"""Registered queries on chunks, vectors, retrieval and log events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarspark.functions.columns import rounded
from bazaarspark.operators import retrieval as R
from bazaarspark.sources.tables import table, view, with_views
from bazaarspark.streaming import events as E


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def _asked(spark, d):
    """The query set: every vector whose identifier is divisible by 20."""
    return _vectors(spark, d).where("id % 20 = 0")


def _bm25(spark, d):
    return R.bm25(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), _docs(spark, d))


def _bm25_topk(spark, d):
    return R.bm25_topk(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), _docs(spark, d))


def _candidates(spark, d):
    """The ten documents of each benchmark item that are closest by vectors among its best hundred by words, with their texts."""
    best = _bm25_topk(spark, d).select("query_id", "doc_id")
    v = _vectors(spark, d).select("id", R.l2_normalize(F.col("v")).alias("v"))
    side = lambda name: v.select(F.col("id").alias("_" + name), F.col("v").alias(name + "_v"))
    rows = best.join(side("q"), F.pmod(F.col("query_id") * 11, F.lit(500)) == F.col("_q")).join(side("d"), F.pmod(F.col("doc_id"), F.lit(500)) == F.col("_d"))
    dot = F.aggregate(F.zip_with("q_v", "d_v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    rows = R.top_n(rows.select("query_id", "doc_id", F.round(dot, 6).alias("dense")), ["query_id"], [F.desc("dense"), F.asc("doc_id")], 10, "dense_rank")
    return rows.join(_docs(spark, d), "doc_id").join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")


def _lines(spark, d, changed=False):
    """Lines of documents as chunks; in the changed version every fifth loses its first words and spaces are doubled."""
    c = _docs(spark, d).select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("chunk_id", "content"))
    return c.withColumn("content", F.when(F.col("chunk_id") % 5 == 0, F.substring("content", 20, 100000)).otherwise(F.replace("content", F.lit(" "), F.lit("  ")))) if changed else c


def _numbered(spark, d):
    return R.assign_chunk_ids(R.chunk_documents(_docs(spark, d)))


def _events(spark, d):
    return view(spark, d, "log_events")


def _agent_events(spark, d):
    """Log events, some of which are completed agent runs and wrong choices of a tool."""
    return _events(spark, d).withColumn("event", F.when(F.col("event_id") % 5 == 0, "agent_completed").when(F.col("event_id") % 5 == 1, "agent_tool_selection_error").otherwise(F.col("event")))


def _sought(spark, d):
    """For every twentieth vector, its neighbours; what is sought is the next vector but one."""
    return R.cosine_topk(_asked(spark, d), _vectors(spark, d), 50).select((F.col("query_id") + 2).alias("chunk_id"), "id", "rank")


def _embedded(spark, d):
    v = table(spark, d, "embeddings")
    return R.embedding_audit(v.select((F.col("vec_id") + (F.col("vec_id") % 9 == 0).cast("int")).alias("chunk_id")), v.select(F.col("vec_id").alias("chunk_id")), table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id")), _sought(spark, d))




def _secrets():
    return F.concat(F.lit("user="), F.col("user_id"), F.lit(" API-key: k"), F.col("event_id"), F.lit(" token=abc"))



QUERIES = {
    "chunk_documents": lambda s, d: R.chunk_documents(_docs(s, d)),
    "assign_chunk_ids": lambda s, d: _numbered(s, d).select("page", "pos", "chunk_id"),
    "fixed_windows": lambda s, d: _docs(s, d).select("doc_id", F.posexplode(R.fixed_windows("text")).alias("pos", "piece")),
    "l2_normalize": lambda s, d: _vectors(s, d).select("id", F.transform(R.l2_normalize(F.transform("v", lambda x: x * 3)), lambda x: rounded(x, 6)).alias("v")),
    "embedding_batches": lambda s, d: R.embedding_batches(_docs(s, d), "doc_id", "text", kind="passage").select("doc_id", "lot", "batch", "nth", "input"),
    "cosine_topk": lambda s, d: R.cosine_topk(_asked(s, d), _vectors(s, d)),
    "ann_topk": lambda s, d: R.ann_topk(_asked(s, d), _vectors(s, d)),
    "bm25": _bm25,
    "bm25_topk": _bm25_topk,
    "bm25_local": lambda s, d: R.bm25_local(_candidates(s, d)).select("query_id", "doc_id", "lexical"),
    "hybrid_rerank": lambda s, d: R.hybrid_rerank(R.bm25_local(_candidates(s, d))).select("query_id", "doc_id", "score", "rank"),
    "align_chunks": lambda s, d: R.align_chunks(_lines(s, d), _lines(s, d, True)),
    "remap_labels": lambda s, d: R.remap_labels(table(s, d, "labels").select(F.col("doc_id").alias("key"), F.array(F.col("doc_id"), F.col("doc_id") + 1, F.col("doc_id")).alias("ids")), table(s, d, "labels").select(F.col("doc_id").alias("old_id"), (F.col("doc_id") * 10).alias("new_id"))),
    "chunks_identical": lambda s, d: R.chunks_identical(_lines(s, d), _lines(s, d, True)),
    "embedding_audit": _embedded,
    "api_metrics": lambda s, d: E.api_metrics(_events(s, d)),
    "agent_metrics": lambda s, d: E.agent_metrics(_agent_events(s, d)),
    "tool_metrics": lambda s, d: E.tool_metrics(_events(s, d)),
    "selection_errors": lambda s, d: E.selection_errors(_agent_events(s, d)),
    "llm_metrics": lambda s, d: E.llm_metrics(_events(s, d)),
    "search_metrics": lambda s, d: E.search_metrics(_events(s, d)),
    "search_metrics_hourly": lambda s, d: E.search_metrics(_events(s, d), "1 hour").select(F.col("window.start").alias("start"), "searches", "empty_results", "fallbacks", "fallback_failures"),
    "latency_histogram": lambda s, d: E.latency_histogram(_events(s, d)),
    "metric_series": lambda s, d: E.metric_series(_agent_events(s, d)),
    "parse_events": lambda s, d: E.parse_events(_events(s, d).select(F.when(F.col("event_id") % 13 == 0, "not json").otherwise(F.to_json(F.struct("event", "status", "latency_ms", "tool"))).alias("value"))).select("event", "status", "latency_ms", "tool"),
    "enrich_events": lambda s, d: _events(s, d).select("event_id", E.cost_estimate().alias("cost"), E.query_ref("event").alias("r"), _secrets().alias("line")).select("event_id", "cost", "r.sha", "r.chars", E.redact_secrets("line").alias("line")),
    "trace_ids": lambda s, d: _events(s, d).withColumn("tp", F.when(F.col("event_id") % 4 == 0, "00-bad").otherwise(F.concat(F.lit("00-"), F.md5(F.col("event_id").cast("string")), F.lit("-00f067aa0ba902b7-01")))).select("event_id", F.coalesce(E.trace_id("tp"), F.concat(F.lit("req-"), "event_id")).alias("trace_id"), E.valid_customer(F.when(F.col("event_id") % 3 == 0, "a b").otherwise(F.col("user_id"))).alias("valid")),
    "safe_arguments": lambda s, d: _events(s, d).select("event_id", E.safe_arguments(F.create_map(F.lit("customer_id"), F.col("user_id"), F.concat(F.lit(" Query"), F.col("event_id") % 3), F.lit("x"), F.lit("SQL"), F.lit("y"))).alias("m"), E.short_id(F.when(F.col("event_id") % 5 == 0, F.concat("user_id", F.lit("; x"))).otherwise(F.repeat("user_id", 40))).alias("short")).select("event_id", F.array_sort(F.map_keys("m")).alias("names"), "short"),
    "rate_limit_verdicts": lambda s, d: E.rate_limit_verdicts(_events(s, d).select("event_id", "user_id", "ts"), max_requests=3, window_s=6 * 3600.0),
}

AGENT = "ag AS (SELECT * REPLACE (CASE event_id % 5 WHEN 0 THEN 'agent_completed' WHEN 1 THEN 'agent_tool_selection_error' ELSE event END AS event) FROM log_events)"
TOK = "regexp_extract_all(lower(coalesce({c}, '')), '[0-9a-zA-Z؀-ۿ]+')"
BM25 = f"""t AS (SELECT item_id AS query_id, unnest({TOK.format(c='text')}) AS term FROM benchmark), q AS (SELECT query_id, term, count(*) AS qtf FROM t GROUP BY ALL),
w AS (SELECT doc_id, unnest({TOK.format(c='text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL),
l AS (SELECT doc_id, len({TOK.format(c='text')}) AS len FROM documents), c AS (SELECT count(*) AS n, greatest(avg(len), 1.0) AS avgdl FROM l), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl)) * qtf), 6) AS score FROM tf JOIN q USING (term) JOIN df USING (term) JOIN l USING (doc_id), c GROUP BY query_id, doc_id)"""
LOCAL = f"""bt AS (SELECT query_id, doc_id FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 100),
k0 AS (SELECT query_id, bt.doc_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dense FROM bt JOIN embeddings a ON a.vec_id = query_id * 11 % 500 JOIN embeddings b ON b.vec_id = bt.doc_id % 500),
k1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id) AS dense_rank FROM k0 QUALIFY dense_rank <= 10),
kd AS (SELECT k1.*, {TOK.format(c='d.text')} AS dw, {TOK.format(c='q.text')} AS qw FROM k1 JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = query_id),
kn AS (SELECT query_id, count(*) AS kn, avg(len(dw)) AS ka FROM kd GROUP BY 1),
kt AS (SELECT query_id, doc_id, term, len(list_filter(qw, lambda w: w = term)) AS kq, len(list_filter(dw, lambda w: w = term)) AS kf, len(dw) AS kl FROM (SELECT *, unnest(list_distinct(qw)) AS term FROM kd)),
kf AS (SELECT query_id, term, count(*) AS kdf FROM kt WHERE kf > 0 GROUP BY ALL),
kg AS (SELECT query_id, doc_id, round(sum(kq * ln(1 + (kn - kdf + 0.5) / (kdf + 0.5)) * kf * 2.5 / (kf + 1.5 * (0.25 + 0.75 * greatest(kl, 1) / ka))), 6) AS lexical FROM kt JOIN kf USING (query_id, term) JOIN kn USING (query_id) WHERE kt.kf > 0 GROUP BY ALL),
k AS (SELECT k1.*, coalesce(lexical, 0.0::DOUBLE) AS lexical FROM k1 LEFT JOIN kg USING (query_id, doc_id))"""
LINES = """old AS (SELECT doc_id AS page, unnest(range(len(x))) AS chunk_id, unnest(x) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
new AS (SELECT page, chunk_id, CASE WHEN chunk_id % 5 = 0 THEN substr(content, 20, 100000) ELSE replace(content, ' ', '  ') END AS content FROM old)"""
CHUNKN = r"trim(regexp_replace(replace(content, '‌', ' '), '\s+', ' ', 'g'), ' ')"

ORACLES = {
    "fixed_windows": "SELECT doc_id, CAST(i AS INT) AS pos, substr(text, i * 500 + 1, 600) AS piece FROM documents, unnest(range((greatest(length(text), 1) - 1) // 500 + 1)) AS u(i)",
    "l2_normalize": "SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(3 * x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: 9 * y * y))), 6)) AS v FROM embeddings",
    "cosine_topk": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
        s AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.x, b.x), 6) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""",
    "bm25": f"WITH {BM25} SELECT * FROM bm",
    "bm25_topk": f"WITH {BM25} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 100",
    "bm25_local": f"WITH {BM25}, {LOCAL} SELECT query_id, doc_id, lexical FROM k",
    "hybrid_rerank": f"""WITH {BM25}, {LOCAL},
        f AS (SELECT query_id, doc_id, dense_rank, round(0.6 * CASE WHEN max(dense) OVER w > min(dense) OVER w THEN (dense - min(dense) OVER w) / (max(dense) OVER w - min(dense) OVER w) ELSE 1 END
              + 0.4 * CASE WHEN max(lexical) OVER w > min(lexical) OVER w THEN (lexical - min(lexical) OVER w) / (max(lexical) OVER w - min(lexical) OVER w) ELSE 1 END, 6) AS score FROM k WINDOW w AS (PARTITION BY query_id))
        SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank) AS rank FROM f QUALIFY rank <= 3""",
    "embedding_batches": """WITH t AS (SELECT doc_id, 'passage: ' || text AS input, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % greatest(64, (SELECT count(*) FROM documents WHERE trim(text) <> '') // 50000) AS lot FROM documents WHERE trim(text) <> ''),
        n AS (SELECT *, row_number() OVER (PARTITION BY lot ORDER BY doc_id) - 1 AS i FROM t) SELECT doc_id, lot, i // 16 AS batch, i % 16 AS nth, input FROM n""",
    "rate_limit_verdicts": with_views(
        """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM log_events),
        v AS (SELECT event_id, user_id, ts, i, true AS allowed, [ts] AS held FROM e WHERE i = 1
         UNION ALL SELECT e.event_id, e.user_id, e.ts, e.i, len(list_filter(v.held, lambda t: t > e.ts - INTERVAL 6 HOUR)) < 3, CASE WHEN len(list_filter(v.held, lambda t: t > e.ts - INTERVAL 6 HOUR)) < 3 THEN list_append(list_filter(v.held, lambda t: t > e.ts - INTERVAL 6 HOUR), e.ts) ELSE list_filter(v.held, lambda t: t > e.ts - INTERVAL 6 HOUR) END
         FROM v JOIN e ON e.user_id = v.user_id AND e.i = v.i + 1)
        SELECT event_id, user_id, ts, allowed FROM v""",
        "log_events",
    ),
    "align_chunks": f"""WITH {LINES}, o AS (SELECT page, chunk_id AS old_id, {CHUNKN} AS ot, list_distinct({TOK.format(c='content')}) AS ow FROM old), n AS (SELECT page, chunk_id AS new_id, {CHUNKN} AS nt, list_distinct({TOK.format(c='content')}) AS nw FROM new),
        s AS (SELECT page, old_id, new_id, ot = nt AS eq, round(greatest(coalesce(len(list_intersect(ow, nw)) / nullif(len(ow) + len(nw) - len(list_intersect(ow, nw)), 0), 0.0), CASE WHEN (contains(ot, nt) OR contains(nt, ot)) AND ot <> '' AND nt <> '' THEN 0.99 ELSE 0.0 END), 6) AS score FROM o JOIN n USING (page)),
        e AS (SELECT page, old_id, new_id, 1.0::DOUBLE AS score FROM s WHERE eq)
        SELECT * FROM e UNION ALL (SELECT page, old_id, new_id, score FROM s WHERE score >= 0.45 AND NOT EXISTS (SELECT 1 FROM e WHERE e.page = s.page AND e.old_id = s.old_id) QUALIFY row_number() OVER (PARTITION BY page, old_id ORDER BY score DESC, new_id DESC) = 1)""",
    "remap_labels": """SELECT l.doc_id AS key, CASE WHEN m.doc_id IS NULL THEN [l.doc_id * 10] ELSE [l.doc_id * 10, (l.doc_id + 1) * 10] END AS ids FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM labels) m ON m.doc_id = l.doc_id + 1""",
    "chunks_identical": f"WITH {LINES} SELECT count(o.content) AS old_chunks, count(n.content) AS new_chunks, count(*) FILTER (o.content IS DISTINCT FROM n.content) AS differing, count(*) FILTER (o.content IS DISTINCT FROM n.content) = 0 AS identical FROM old o FULL JOIN new n ON o.page = n.page AND o.chunk_id = n.chunk_id",
    "embedding_audit": """WITH c AS (SELECT vec_id + CASE WHEN vec_id % 9 = 0 THEN 1 ELSE 0 END AS chunk_id FROM embeddings)
        SELECT (SELECT count(*) FROM c) AS chunks, (SELECT count(DISTINCT chunk_id) FROM c) AS distinct_chunks, (SELECT max(chunk_id) = count(*) - 1 AND min(chunk_id) = 0 FROM c) AS contiguous, (SELECT count(*) FROM embeddings) AS vectors,
        (SELECT count(DISTINCT chunk_id) FROM c WHERE chunk_id NOT IN (SELECT vec_id FROM embeddings)) AS without_vector, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT chunk_id FROM c)) AS dangling_labels,
        (SELECT avg(coalesce(p <= 10, false)::INT) FROM (SELECT a.vec_id, min(CASE WHEN b.vec_id = a.vec_id + 2 THEN r END) AS p FROM (SELECT a.vec_id AS q, b.vec_id AS x, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) JOIN embeddings a ON a.vec_id = q JOIN embeddings b ON b.vec_id = x GROUP BY 1)) AS hit_rate""",
    "api_metrics": with_views("SELECT endpoint, method, status, count(*) AS requests, count(*) FILTER (status >= 400) AS errors FROM log_events WHERE event = 'request_completed' AND endpoint NOT IN ('/health', '/ready', '/metrics') GROUP BY ALL", "log_events"),
    "agent_metrics": with_views(f"WITH {AGENT} SELECT count(*) AS runs, count(latency_ms) AS timed, CAST(sum(CAST(latency_ms AS DECIMAL(28, 6))) AS DOUBLE) AS total_ms FROM ag WHERE event = 'agent_completed'", "log_events"),
    "selection_errors": with_views(f"WITH {AGENT} SELECT tool, count(*) AS errors FROM ag WHERE event = 'agent_tool_selection_error' GROUP BY tool", "log_events"),
    "tool_metrics": with_views("SELECT tool, CAST(status AS VARCHAR) AS status, count(*) AS calls FROM log_events WHERE event = 'tool_execution' GROUP BY ALL", "log_events"),
    "llm_metrics": with_views("SELECT purpose, CAST(status AS VARCHAR) AS status, count(*) AS calls, count(*) FILTER (status >= 400) AS failures, count(*) FILTER (timeout) AS timeouts, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(CAST(round((input_tokens * 15 + output_tokens * 60) / 100000000, 8) AS DECIMAL(20, 8))) AS DOUBLE) AS cost_usd FROM log_events WHERE event = 'llm_call' GROUP BY ALL", "log_events"),
    "search_metrics": with_views("SELECT count(*) AS searches, count(*) FILTER (empty) AS empty_results, count(*) FILTER (llm_fallback_triggered) AS fallbacks, count(*) FILTER (llm_failure) AS fallback_failures FROM log_events WHERE event = 'product_search_completed'", "log_events"),
    "search_metrics_hourly": with_views("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS searches, count(*) FILTER (empty) AS empty_results, count(*) FILTER (llm_fallback_triggered) AS fallbacks, count(*) FILTER (llm_failure) AS fallback_failures FROM log_events WHERE event = 'product_search_completed' GROUP BY 1", "log_events"),
    "latency_histogram": with_views(
        """WITH g AS (SELECT event, count(latency_ms) AS n, CAST(sum(CAST(latency_ms AS DECIMAL(28, 6))) AS DOUBLE) AS total FROM log_events GROUP BY event),
        b AS (SELECT unnest([5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000]) AS bound)
        SELECT g.event, n, total, CAST(bound AS VARCHAR) AS le, (SELECT count(*) FROM log_events l WHERE l.event = g.event AND l.latency_ms <= bound) AS cumulative FROM g, b
        UNION ALL SELECT event, n, total, '+Inf', n FROM g""",
        "log_events",
    ),
    "metric_series": with_views(
        f"""WITH {AGENT}, a AS (SELECT * FROM ag WHERE event = 'request_completed' AND endpoint NOT IN ('/health', '/ready', '/metrics')), l AS (SELECT * FROM ag WHERE event = 'llm_call'), p AS (SELECT * FROM ag WHERE event = 'product_search_completed'),
        c AS (SELECT 'requests_total' AS metric, 'endpoint=' || endpoint || ',method=' || method || ',status=' || status AS labels, count(*)::DOUBLE AS value FROM a GROUP BY ALL
        UNION ALL SELECT 'errors_total', 'endpoint=' || endpoint || ',status=' || status, count(*) FROM a WHERE status >= 400 GROUP BY ALL UNION ALL SELECT 'agent_requests_total', '', count(*) FROM ag WHERE event = 'agent_completed'
        UNION ALL SELECT 'agent_tool_selection_errors_total', 'tool=' || tool, count(*) FROM ag WHERE event = 'agent_tool_selection_error' GROUP BY ALL UNION ALL SELECT 'tool_calls_total', 'status=' || status || ',tool=' || tool, count(*) FROM ag WHERE event = 'tool_execution' GROUP BY ALL
        UNION ALL SELECT 'llm_calls_total', 'purpose=' || purpose || ',status=' || status, count(*) FROM l GROUP BY ALL UNION ALL SELECT 'llm_failures_total', 'purpose=' || purpose, count(*) FROM l WHERE status >= 400 GROUP BY ALL UNION ALL SELECT 'llm_timeouts_total', 'purpose=' || purpose, count(*) FROM l WHERE timeout GROUP BY ALL
        UNION ALL SELECT 'llm_tokens_total', 'direction=input', sum(input_tokens) FROM l UNION ALL SELECT 'llm_tokens_total', 'direction=output', sum(output_tokens) FROM l UNION ALL SELECT 'llm_estimated_cost_usd_total', '', CAST(sum(CAST(round((input_tokens * 15 + output_tokens * 60) / 100000000, 8) AS DECIMAL(20, 8))) AS DOUBLE) FROM l
        UNION ALL SELECT 'product_search_total', '', count(*) FROM p UNION ALL SELECT 'product_search_empty_total', '', count(*) FILTER (empty) FROM p UNION ALL SELECT 'product_search_llm_fallback_total', '', count(*) FILTER (llm_fallback_triggered) FROM p
        UNION ALL SELECT 'product_search_llm_fallback_failures_total', '', count(*) FILTER (llm_failure) FROM p UNION ALL SELECT 'feedback_total', 'rating=' || rating, count(*) FROM ag WHERE event = 'feedback_recorded' GROUP BY ALL),
        t AS (SELECT 'api_request_latency_milliseconds' AS metric, 'endpoint=' || endpoint AS labels, latency_ms AS x FROM a UNION ALL SELECT 'agent_latency_milliseconds', '', latency_ms FROM ag WHERE event = 'agent_completed' UNION ALL SELECT 'product_search_latency_milliseconds', '', latency_ms FROM p UNION ALL SELECT 'llm_latency_milliseconds', 'purpose=' || purpose, latency_ms FROM l),
        g AS (SELECT metric, labels, count(x) AS n, CAST(sum(CAST(x AS DECIMAL(28, 6))) AS DOUBLE) AS total FROM t GROUP BY ALL), bd AS (SELECT unnest([5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000]) AS bound)
        SELECT * FROM c UNION ALL SELECT metric || '_count', labels, n FROM g UNION ALL SELECT metric || '_sum', labels, total FROM g UNION ALL SELECT metric || '_bucket', CASE WHEN labels = '' THEN '' ELSE labels || ',' END || 'le=+Inf', n FROM g
        UNION ALL SELECT g.metric || '_bucket', CASE WHEN g.labels = '' THEN '' ELSE g.labels || ',' END || 'le=' || bound, count(t.x) FILTER (t.x <= bound) FROM g JOIN t ON t.metric = g.metric AND t.labels = g.labels, bd GROUP BY g.metric, g.labels, bound""",
        "log_events",
    ),
    "parse_events": with_views("SELECT event, status, latency_ms, tool FROM log_events WHERE event_id % 13 <> 0", "log_events"),
    "enrich_events": with_views("SELECT event_id, round((input_tokens * 15 + output_tokens * 60) / 100000000, 8) AS cost, substr(sha256(event), 1, 16) AS sha, length(event) AS chars, 'user=' || user_id || ' API-key: [REDACTED] token=[REDACTED]' AS line FROM log_events", "log_events"),
    "safe_arguments": with_views("SELECT event_id, [' Query' || event_id % 3] AS names, CASE WHEN event_id % 5 = 0 THEN '' ELSE substr(repeat(user_id, 40), 1, 64) END AS short FROM log_events", "log_events"),
    "trace_ids": with_views("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'req-' || event_id ELSE md5(CAST(event_id AS VARCHAR)) END AS trace_id, event_id % 3 <> 0 AS valid FROM log_events", "log_events"),
}
