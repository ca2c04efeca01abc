"""Meetings, token usage, sessions and progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, text

# Prices per million tokens and status names.
PRICE_IN, PRICE_OUT = 0.75, 3.75
FINISHED, ACTIVE, RETRY = ["Completed", "Analyzed", "Synced"], ["Processing", "Pending"], ["Error", "Partial Error"]
TO_RUN = ["Pending", "Error", "Processing"]
# End of fixed values.


def token_cost(prompt: str | Column, completion: str | Column, price_in: float = PRICE_IN, price_out: float = PRICE_OUT) -> Column:
    """Dollars for a call; prices are per million tokens."""
    return (F.coalesce(text.col(prompt), F.lit(0)) * F.lit(price_in / 1_000_000)
            + F.coalesce(text.col(completion), F.lit(0)) * F.lit(price_out / 1_000_000))


def billable_output(total: str | Column, prompt: str | Column, candidates: str | Column, thoughts: str | Column) -> Column:
    return F.greatest(text.col(total) - text.col(prompt), text.col(candidates) + text.col(thoughts))


def billable_usage(calls: DataFrame) -> DataFrame:
    """Completion and total tokens set right, and the cost."""
    out = calls.withColumn("completion_tokens", billable_output("total_tokens", "prompt_tokens", "candidate_tokens", "thought_tokens"))
    return (out.withColumn("total_tokens", F.greatest("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")))
            .withColumn("cost_usd", token_cost("prompt_tokens", "completion_tokens")))


def search_meetings(meetings: DataFrame, needle: str = "", offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of meetings whose title holds the text, newest first, with the total and the next offset."""
    hits = meetings.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(needle.lower())))
    total = hits.agg(F.count(F.lit(1))).scalar()
    page = hits.orderBy(F.desc("creation"), "meeting").offset(offset).limit(limit)
    return page.withColumn("total", total).withColumn(
        "next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit)))


def meeting_detail(meetings: DataFrame, meeting: str) -> DataFrame:
    return meetings.where(F.col("meeting") == meeting)


def reuse_by_content(uploads: DataFrame, meetings: DataFrame) -> DataFrame:
    """The meeting to reuse for each uploaded content: finished first, then running, then failed; newest of its kind.

    ``uploads`` is (upload, content); ``meetings`` has ``content`` of its file, ``status`` and ``creation``.
    """
    rank = F.when(F.col("status").isin(*FINISHED), 0).when(F.col("status").isin(*ACTIVE), 1).when(F.col("status").isin(*RETRY), 2)
    known = (meetings.select(F.md5("content").alias("hash"), "meeting", "status", "creation", rank.alias("kind")).where("kind is not null")
             .groupBy("hash").agg(F.min_by(F.struct("meeting", "status"), F.struct("kind", (-F.unix_micros(F.col("creation").cast("timestamp"))).alias("t"), "meeting")).alias("m")))
    action = F.when(F.col("m.status").isin(*FINISHED), "reuse").when(F.col("m.status").isin(*ACTIVE), "wait") \
        .when(F.col("m.status").isin(*RETRY), "retry").otherwise("new")
    return uploads.select("upload", F.md5("content").alias("hash")).join(known, "hash", "left").select(
        "upload", "hash", F.col("m.meeting").alias("meeting"), action.alias("action"))


def meeting_status(chunks: DataFrame) -> DataFrame:
    """Status from chunks: with an unfinished chunk, Partial Error if earlier chunks gave segments, else Error."""
    bad = F.coalesce(F.col("status"), F.lit("")) != "Completed"
    at = F.when(bad, F.col("chunk_index"))
    firsts = chunks.groupBy("meeting").agg(F.min(at).alias("bad_at"), F.min_by("error_message", at).alias("_err"))
    early = (chunks.where(~bad).join(firsts, "meeting").where(F.col("bad_at").isNull() | (F.col("chunk_index") < F.col("bad_at")))
             .groupBy("meeting").agg(F.sum("segment_count").alias("usable_segments")))
    n = F.coalesce("usable_segments", F.lit(0))
    status = F.when(F.col("bad_at").isNull(), "Completed").when(n > 0, "Partial Error").otherwise("Error")
    return firsts.join(early, "meeting", "left").select(
        "meeting", status.alias("status"), n.alias("usable_segments"), "bad_at",
        F.when(F.col("bad_at").isNotNull(), F.concat(F.lit("Lỗi ở chunk: "), F.coalesce("_err", F.lit("None")))).alias("error"))


def meeting_usage(meetings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Token and cost sums of a meeting's chunks; when they are empty, the counts known for the meeting itself."""
    sums = chunks.groupBy("meeting").agg(*[F.sum(c).alias(f"_{c}") for c in ("stt_prompt_tokens", "stt_completion_tokens", "stt_total_tokens", "stt_cost_usd")])
    rows = meetings.join(sums, "meeting", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    empty = (z("_stt_total_tokens") == 0) & ((z("fallback_prompt") != 0) | (z("fallback_completion") != 0))
    pick = lambda own, other, name: F.when(empty, other).otherwise(own).alias(name)
    return rows.select("meeting", pick(z("_stt_prompt_tokens"), z("fallback_prompt"), "prompt_tokens"),
                       pick(z("_stt_completion_tokens"), z("fallback_completion"), "completion_tokens"),
                       pick(z("_stt_total_tokens"), z("fallback_prompt") + z("fallback_completion"), "total_tokens"),
                       pick(F.coalesce("_stt_cost_usd", F.lit(0.0)), token_cost("fallback_prompt", "fallback_completion"), "cost_usd"))


def session_counters(calls: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions, calls, tokens and characters per session."""
    c = calls.groupBy("session").agg(F.count(F.lit(1)).alias("ai_calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
                                     F.sum("completion_tokens").alias("completion_tokens"), F.sum("chars_used").alias("chars"))
    a = actions.groupBy("session").agg(F.count(F.lit(1)).alias("actions"))
    z = lambda n: F.coalesce(F.col(n), F.lit(0)).alias(n)
    out = c.join(a, "session", "full").select("session", z("actions"), z("ai_calls"), z("prompt_tokens"), z("completion_tokens"), z("chars"))
    return out.withColumn("tokens_used", F.col("prompt_tokens") + F.col("completion_tokens"))


def model_tokens(calls: DataFrame) -> DataFrame:
    """Input and output tokens per session and model."""
    used = calls.where((F.col("ai_model") != "") & ((F.col("prompt_tokens") > 0) | (F.col("completion_tokens") > 0)))
    return used.groupBy("session", "ai_model").agg(F.sum("prompt_tokens").alias("input"), F.sum("completion_tokens").alias("output"))


def token_breakdown(calls: DataFrame) -> DataFrame:
    """model → tokens as one map per session."""
    entries = F.collect_list(F.struct("ai_model", F.struct("input", "output")))
    return model_tokens(calls).groupBy("session").agg(F.map_from_entries(F.array_sort(entries)).alias("token_breakdown"))


def _cut(c: Column, chars: int | None) -> Column:
    return c if chars is None else F.substring(c, 1, chars)


def action_rows(events: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Start and finish events of an action to one row; later events win, of equally late ones that which sorts last."""
    done = F.col("kind") == "finish"
    at = F.when(done, F.struct("ts", "status", "summary", "prompt_tokens", "completion_tokens", "duration_seconds"))
    last = lambda c: F.max_by(c, at)
    out = events.groupBy("action").agg(
        F.min("session").alias("session"), F.min(F.when(~done, F.col("ts"))).alias("started_at"),
        F.coalesce(last("status"), F.lit("running")).alias("status"), _cut(F.coalesce(last("summary"), F.lit("")), max_chars).alias("summary"),
        F.coalesce(last("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(last("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.round(F.coalesce(last("duration_seconds"), F.lit(0.0)), 3).alias("duration_seconds"))
    return out.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def call_rows(calls: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Fact rows of model calls: totals, messages, rounded time; calls outside a session are left out."""
    return calls.where(F.coalesce(F.col("session").cast("string"), F.lit("")) != "").select(
        "session", "action", "call_type", "ai_model", "status", "ts", "prompt_tokens", "completion_tokens",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.round("duration_seconds", 3).alias("duration_seconds"),
        _cut(F.coalesce("error_message", F.lit("")), max_chars).alias("error_message"))


def session_lifecycle(events: DataFrame) -> DataFrame:
    """Start, last activity and status of each session."""
    ended = F.bool_or(F.col("event") == "finish")
    return events.groupBy("session").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_active_at"),
                                         F.when(ended, "completed").otherwise("active").alias("status"))


def progress(chunks: DataFrame) -> DataFrame:
    """Finished chunks in whole percent; a failed chunk counts as finished work."""
    done = F.count_if(F.col("status").isin("Completed", "Error"))
    return chunks.groupBy("meeting").agg(done.alias("done"), F.count(F.lit(1)).alias("total"),
                                         F.floor(100 * done / F.count(F.lit(1))).alias("percent"))


def chunks_to_run(chunks: DataFrame, finished_segments: DataFrame | None = None) -> DataFrame:
    """Chunks without a result; ``finished_segments`` adds what an earlier run already has."""
    todo = chunks.where(F.col("status").isin(*TO_RUN))
    if finished_segments is not None:
        done = finished_segments.select("meeting", labels.chunk_index("speaker_id").alias("chunk_index")).where("chunk_index is not null").distinct()
        todo = todo.join(done, ["meeting", "chunk_index"], "left_anti")
    return todo


def patch_rows(rows: DataFrame, patches: DataFrame, columns: Sequence[str], key: str = "meeting", trim: bool = True) -> DataFrame:
    """Take over the patched fields that are given; null means unchanged."""
    cut = lambda c: F.trim(F.col(c)) if trim and dict(patches.dtypes)[c] == "string" else F.col(c)
    new = patches.select(key, *[cut(c).alias(f"_{c}") for c in columns])
    return rows.join(new, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def lookup_sessions(ids: DataFrame, sessions: DataFrame) -> DataFrame:
    """First session record of each id."""
    first = sessions.groupBy("session_id").agg(F.min_by("session", F.struct("started_at", "session")).alias("session"))
    return ids.join(first, "session_id", "left")


def transcription_totals(segments: DataFrame, usage: DataFrame) -> DataFrame:
    """Segments, distinct speakers, tokens and cost of each meeting; ``usage`` has its prompt and completion tokens."""
    per_id = segments.groupBy("meeting", "speaker_id").agg(F.count(F.lit(1)).alias("n"))
    counts = per_id.groupBy("meeting").agg(F.sum("n").alias("segments"), F.count_if(F.coalesce("speaker_id", F.lit("")) != "").alias("speakers"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return counts.join(usage, "meeting", "left").select(
        "meeting", "segments", "speakers", (z("prompt_tokens") + z("completion_tokens")).alias("tokens"), token_cost("prompt_tokens", "completion_tokens").alias("cost_usd"))


def character_quota(accounts: DataFrame) -> DataFrame:
    """Characters used by a run, characters left, and percent used of the limit."""
    used = F.greatest(F.lit(0), F.col("after") - F.col("before"))
    return accounts.select("account", F.when(used <= 0, F.length("text")).otherwise(used).alias("used"),
                           F.greatest(F.lit(0), F.col("limit") - F.col("after")).alias("remaining"),
                           F.coalesce(F.try_divide(F.col("after"), F.col("limit")) * 100, F.lit(0.0)).alias("percent"))
