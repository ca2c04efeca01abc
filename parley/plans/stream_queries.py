"""Streams over the event table, read as files that arrive."""

from pyspark.sql import functions as F

from ..streaming import progress as S
from . import proxies as P
from .proxies import with_ctes
from .registry import query


def arriving(spark, sf):
    return S.file_stream(spark, f"{sf}/events*.parquet", P.table(spark, sf, "events").schema)


@query("stream_session_counters", with_ctes("call_t") + """
SELECT session, count(*) AS ai_calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens_used, CAST(sum(chars_used) AS BIGINT) AS chars, max(ts) AS last_active_at FROM call_t GROUP BY session""")
def _(spark, sf):
    return S.run_to_table(S.session_counters(P.calls_from(arriving(spark, sf))), ["session"])


@query("stream_chunk_status", "SELECT CAST(user_id AS VARCHAR) AS meeting, CAST(event_id % 5 AS INTEGER) AS chunk_index, arg_max(event_type, ts) AS status, max(ts) AS updated_at FROM events GROUP BY ALL")
def _(spark, sf):
    updates = arriving(spark, sf).select(F.col("user_id").cast("string").alias("meeting"), (F.col("event_id") % 5).cast("int").alias("chunk_index"), F.col("event_type").alias("status"), "ts")
    return S.run_to_table(S.chunk_status(updates), ["meeting", "chunk_index"])


PROGRESS = """
SELECT CAST(user_id AS VARCHAR) AS meeting, count(*) FILTER (event_type IN ('purchase', 'error')) AS done, count(*) AS total,
  CAST(floor(100 * count(*) FILTER (event_type IN ('purchase', 'error')) / count(*)) AS BIGINT) AS percent FROM events GROUP BY user_id HAVING count(*) FILTER (event_type IN ('purchase', 'error')) > 0"""


def reported(spark, sf):
    status = F.when(F.col("event_type") == "purchase", "Completed").when(F.col("event_type") == "error", "Error").otherwise("Processing")
    # every fifth result comes twice
    again = F.explode(F.when(F.col("event_id") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    results = arriving(spark, sf).select(F.col("user_id").cast("string").alias("meeting"), F.col("event_id").alias("chunk_index"), status.alias("status"), "ts", again.alias("time"))
    planned = P.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("meeting")).agg(F.count(F.lit(1)).alias("total"))
    return results, planned


@query("stream_meeting_progress", PROGRESS)
def _(spark, sf):
    return S.run_to_table(S.meeting_progress(*reported(spark, sf)), ["meeting"])


@query("stream_expiring_progress", PROGRESS)
def _(spark, sf):
    return S.run_to_table(S.expiring_progress(*reported(spark, sf)), ["meeting"])
