"""Meetings, usage and progress over the event and conversation tables."""

from pyspark.sql import functions as F

from ..operators import usage as U
from . import proxies as P
from .proxies import with_ctes
from .registry import query


@query("search_meetings", with_ctes("meet") + """,
h AS (SELECT * FROM meet WHERE contains(lower(title), 'the')), t AS (SELECT count(*) AS total FROM h)
SELECT meeting, title, total, CASE WHEN total > 15 THEN 15 END AS next_offset FROM h, t ORDER BY creation DESC, meeting LIMIT 10 OFFSET 5""")
def _(spark, sf):
    return U.search_meetings(P.meetings(spark, sf), "THE", offset=5, limit=10).select("meeting", "title", "total", "next_offset")


@query("meeting_detail", with_ctes("meet") + " SELECT meeting, title, status, meeting_summary FROM meet WHERE meeting = '12'")
def _(spark, sf):
    return U.meeting_detail(P.meetings(spark, sf), "12").select("meeting", "title", "status", "meeting_summary")


@query("reuse_by_content", """
WITH k AS (SELECT md5(text) AS hash, CAST(doc_id AS VARCHAR) AS meeting, doc_id, CASE doc_id % 6 WHEN 0 THEN 'Completed' WHEN 1 THEN 'Analyzed' WHEN 2 THEN 'Processing' WHEN 3 THEN 'Error' WHEN 4 THEN 'Partial Error' ELSE 'Draft' END AS status FROM documents),
r AS (SELECT *, CASE WHEN status IN ('Completed', 'Analyzed') THEN 0 WHEN status = 'Processing' THEN 1 WHEN status = 'Draft' THEN NULL ELSE 2 END AS kind FROM k),
b AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY kind, doc_id DESC) AS n FROM r WHERE kind IS NOT NULL)
SELECT d.doc_id AS upload, md5(text) AS hash, meeting, CASE kind WHEN 0 THEN 'reuse' WHEN 1 THEN 'wait' WHEN 2 THEN 'retry' ELSE 'new' END AS action FROM documents d LEFT JOIN b ON b.hash = md5(text) AND n = 1""")
def _(spark, sf):
    d = P.table(spark, sf, "documents")
    k = F.col("doc_id") % 6
    status = F.when(k == 0, "Completed").when(k == 1, "Analyzed").when(k == 2, "Processing").when(k == 3, "Error").when(k == 4, "Partial Error").otherwise("Draft")
    known = d.select(F.col("doc_id").cast("string").alias("meeting"), F.col("text").alias("content"), status.alias("status"), F.timestamp_seconds("doc_id").alias("creation"))
    return U.reuse_by_content(d.select(F.col("doc_id").alias("upload"), F.col("text").alias("content")), known)


@query("meeting_status", with_ctes("chunk_t") + """,
f AS (SELECT meeting, min(chunk_index) FILTER (status <> 'Completed') AS bad_at, arg_min(error_message, chunk_index) FILTER (status <> 'Completed') AS err FROM chunk_t GROUP BY meeting),
e AS (SELECT meeting, CAST(sum(segment_count) AS BIGINT) AS n FROM chunk_t JOIN f USING (meeting) WHERE status = 'Completed' AND (bad_at IS NULL OR chunk_index < bad_at) GROUP BY meeting)
SELECT meeting, CASE WHEN bad_at IS NULL THEN 'Completed' WHEN coalesce(n, 0) > 0 THEN 'Partial Error' ELSE 'Error' END AS status, coalesce(n, 0) AS usable_segments, bad_at,
  CASE WHEN bad_at IS NOT NULL THEN 'Lỗi ở chunk: ' || err END AS error FROM f LEFT JOIN e USING (meeting)""")
def _(spark, sf):
    return U.meeting_status(P.chunks(spark, sf))


@query("meeting_usage", with_ctes("chunk_t", "meet") + """,
s AS (SELECT meeting, sum(stt_prompt_tokens) AS p, sum(stt_completion_tokens) AS c, sum(stt_total_tokens) AS t, sum(stt_cost_usd) AS d FROM (SELECT * REPLACE (CASE WHEN conv_id % 4 = 1 THEN 0 ELSE stt_prompt_tokens END AS stt_prompt_tokens,
  CASE WHEN conv_id % 4 = 1 THEN 0 ELSE stt_completion_tokens END AS stt_completion_tokens, CASE WHEN conv_id % 4 = 1 THEN 0 ELSE stt_total_tokens END AS stt_total_tokens,
  CASE WHEN conv_id % 4 = 1 THEN 0 ELSE stt_cost_usd END AS stt_cost_usd) FROM chunk_t) GROUP BY meeting),
k AS (SELECT *, coalesce(t, 0) = 0 AND (coalesce(fallback_prompt, 0) <> 0 OR coalesce(fallback_completion, 0) <> 0) AS empty FROM meet LEFT JOIN s USING (meeting))
SELECT meeting, CAST(CASE WHEN empty THEN fallback_prompt ELSE coalesce(p, 0) END AS BIGINT) AS prompt_tokens, CAST(CASE WHEN empty THEN fallback_completion ELSE coalesce(c, 0) END AS BIGINT) AS completion_tokens,
  CAST(CASE WHEN empty THEN fallback_prompt + fallback_completion ELSE coalesce(t, 0) END AS BIGINT) AS total_tokens,
  round(CASE WHEN NOT empty THEN coalesce(d, 0) ELSE (fallback_prompt * (0.75::DOUBLE / 1000000) + fallback_completion * (3.75::DOUBLE / 1000000)) END, 9) AS cost_usd FROM k""")
def _(spark, sf):
    # the chunks of every fourth meeting came without counts
    c = P.chunks(spark, sf)
    for name in ("stt_prompt_tokens", "stt_completion_tokens", "stt_total_tokens", "stt_cost_usd"):
        c = c.withColumn(name, F.when(F.col("conv_id") % 4 == 1, 0).otherwise(F.col(name)))
    return U.meeting_usage(P.meetings(spark, sf), c).withColumn("cost_usd", F.round("cost_usd", 9))


@query("session_counters", with_ctes("call_t") + """,
c AS (SELECT session, count(*) AS ai_calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(chars_used) AS BIGINT) AS chars FROM call_t GROUP BY session),
a AS (SELECT session, count(DISTINCT action) AS actions FROM call_t GROUP BY session)
SELECT session, actions, ai_calls, prompt_tokens, completion_tokens, chars, prompt_tokens + completion_tokens AS tokens_used FROM c JOIN a USING (session)""")
def _(spark, sf):
    c = P.calls(spark, sf)
    return U.session_counters(c, c.select("session", "action").distinct())


@query("model_tokens", with_ctes("call_t") + " SELECT session, ai_model, CAST(sum(prompt_tokens) AS BIGINT) AS input, CAST(sum(completion_tokens) AS BIGINT) AS output FROM call_t WHERE prompt_tokens > 0 OR completion_tokens > 0 GROUP BY ALL")
def _(spark, sf):
    return U.model_tokens(P.calls(spark, sf))


@query("token_breakdown", with_ctes("call_t") + """,
m AS (SELECT session, ai_model, CAST(sum(prompt_tokens) AS BIGINT) AS i, CAST(sum(completion_tokens) AS BIGINT) AS o FROM call_t WHERE prompt_tokens > 0 OR completion_tokens > 0 GROUP BY ALL)
SELECT session, '{' || string_agg('"' || ai_model || '":{"input":' || i || ',"output":' || o || '}', ',' ORDER BY ai_model) || '}' AS token_breakdown FROM m GROUP BY session""")
def _(spark, sf):
    return U.token_breakdown(P.calls(spark, sf)).withColumn("token_breakdown", F.to_json("token_breakdown"))


@query("action_rows", with_ctes("call_t") + """
SELECT action, min(session) AS session, min(ts) FILTER (event_id % 3 = 0) AS started_at, coalesce(arg_max(status, ts) FILTER (event_id % 3 <> 0), 'running') AS status,
  coalesce(arg_max(error_message, ts) FILTER (event_id % 3 <> 0), '') AS summary, coalesce(arg_max(prompt_tokens, ts) FILTER (event_id % 3 <> 0), 0) AS prompt_tokens,
  coalesce(arg_max(completion_tokens, ts) FILTER (event_id % 3 <> 0), 0) AS completion_tokens,
  round(coalesce(arg_max(duration_seconds, ts) FILTER (event_id % 3 <> 0), 0), 3) AS duration_seconds,
  coalesce(arg_max(prompt_tokens, ts) FILTER (event_id % 3 <> 0), 0) + coalesce(arg_max(completion_tokens, ts) FILTER (event_id % 3 <> 0), 0) AS total_tokens
FROM call_t GROUP BY action""")
def _(spark, sf):
    c = P.calls(spark, sf).withColumn("kind", F.when(F.col("event_id") % 3 == 0, "start").otherwise("finish")).withColumn("summary", F.col("error_message"))
    return U.action_rows(c, max_chars=500)


@query("call_rows", with_ctes("call_t") + " SELECT session, action, 'stt' AS call_type, ai_model, status, ts, prompt_tokens, completion_tokens, prompt_tokens + completion_tokens AS total_tokens, round(duration_seconds, 3) AS duration_seconds, error_message FROM call_t")
def _(spark, sf):
    return U.call_rows(P.calls(spark, sf), max_chars=500)


@query("session_lifecycle", "SELECT CAST(user_id AS VARCHAR) AS session, min(ts) AS started_at, max(ts) AS last_active_at, CASE WHEN bool_or(event_type = 'purchase') THEN 'completed' ELSE 'active' END AS status FROM events GROUP BY user_id")
def _(spark, sf):
    e = P.table(spark, sf, "events")
    return U.session_lifecycle(e.select(F.col("user_id").cast("string").alias("session"), "ts", F.when(F.col("event_type") == "purchase", "finish").otherwise("active").alias("event")))


@query("meeting_progress", with_ctes("chunk_t") + " SELECT meeting, count(*) FILTER (status IN ('Completed', 'Error')) AS done, count(*) AS total, CAST(floor(100 * count(*) FILTER (status IN ('Completed', 'Error')) / count(*)) AS BIGINT) AS percent FROM chunk_t GROUP BY meeting")
def _(spark, sf):
    return U.progress(P.chunks(spark, sf))


@query("chunks_to_run", with_ctes("chunk_t") + " SELECT meeting, chunk_index, status FROM chunk_t WHERE status <> 'Completed' AND (meeting, chunk_index) NOT IN (SELECT (meeting, chunk) FROM seg WHERE speaker = 'Speaker 2')")
def _(spark, sf):
    done = P.segments(spark, sf).where("speaker = 'Speaker 2'")
    return U.chunks_to_run(P.chunks(spark, sf), done).select("meeting", "chunk_index", "status")


@query("patch_meetings", with_ctes("meet") + """
SELECT meeting, CASE WHEN status = 'Completed' THEN 'mới' ELSE title END AS title, conclusion AS conclusion, CASE WHEN status = 'Completed' THEN owner || '!' ELSE meeting_summary END AS meeting_summary FROM meet""")
def _(spark, sf):
    m = P.meetings(spark, sf)
    patch = m.where("status = 'Completed'").select("meeting", F.lit(" mới ").alias("title"), F.lit(None).cast("string").alias("conclusion"), F.concat("owner", F.lit("!")).alias("meeting_summary"))
    return U.patch_rows(m, patch, ["title", "conclusion", "meeting_summary"]).select("meeting", "title", "conclusion", "meeting_summary")


@query("lookup_sessions", """
SELECT c_custkey, session_id, session FROM (SELECT c_custkey, c_custkey AS session_id FROM customer) LEFT JOIN (
  SELECT user_id AS session_id, arg_min(event_id, (ts, event_id)) AS session FROM events GROUP BY user_id) USING (session_id)""")
def _(spark, sf):
    ids = P.table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("session_id"))
    sessions = P.table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("ts").alias("started_at"), F.col("event_id").alias("session"))
    return U.lookup_sessions(ids, sessions)


@query("transcription_totals", with_ctes("chunk_t") + """,
u AS (SELECT meeting, CAST(sum(stt_prompt_tokens) AS BIGINT) AS p, CAST(sum(stt_completion_tokens) AS BIGINT) AS c FROM chunk_t GROUP BY meeting)
SELECT meeting, count(*) AS segments, count(DISTINCT speaker_id) AS speakers, any_value(p + c) AS tokens,
  round(any_value(p * (0.75::DOUBLE / 1000000) + c * (3.75::DOUBLE / 1000000)), 9) AS cost_usd FROM seg JOIN u USING (meeting) GROUP BY meeting""")
def _(spark, sf):
    u = P.chunks(spark, sf).groupBy("meeting").agg(F.sum("stt_prompt_tokens").alias("prompt_tokens"), F.sum("stt_completion_tokens").alias("completion_tokens"))
    return U.transcription_totals(P.segments(spark, sf), u).withColumn("cost_usd", F.round("cost_usd", 9))


@query("character_quota", """
SELECT doc_id AS account, CASE WHEN n_chars % 500 > 0 THEN n_chars % 500 ELSE length(text) END AS used, greatest(0, 50000 - n_chars) AS remaining, round(n_chars / 50000.0::DOUBLE * 100, 6) AS percent FROM documents""")
def _(spark, sf):
    d = P.table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("account"), (F.col("n_chars") - F.col("n_chars") % 500).alias("before"), F.col("n_chars").alias("after"), F.lit(50000).cast("long").alias("limit"), "text")
    return U.character_quota(rows).withColumn("percent", F.round("percent", 6)).withColumn("used", F.col("used").cast("long"))


@query("first_projects", with_ctes("proj") + " SELECT name FROM proj ORDER BY name LIMIT 100")
def _(spark, sf):
    from ..operators import tasks as K
    return K.first_of(P.projects(spark, sf).select("name"), "name", 100)
