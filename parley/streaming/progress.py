"""Structured Streaming forms of progress and counters.

State holds one row per meeting, chunk or session, updated in place, so any
executor can be lost and the checkpoint of the query brings the state back. All
but ``expiring_progress`` are plain streaming aggregates that keep their rows for good.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut_lineage, remove_folder, shared_folder

CHUNK_EVENTS = "meeting STRING, chunk_index INT, status STRING, ts TIMESTAMP"
CALL_EVENTS = "session STRING, ai_model STRING, prompt_tokens BIGINT, completion_tokens BIGINT, chars_used BIGINT, ts TIMESTAMP"


def file_stream(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def chunk_status(updates: DataFrame) -> DataFrame:
    """Latest status of each chunk; the later update wins, of equal times the status that sorts last."""
    return updates.groupBy("meeting", "chunk_index").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.max("ts").alias("updated_at"))


def meeting_progress(results: DataFrame, planned: DataFrame) -> DataFrame:
    """Finished chunks per meeting against the planned number (a static table), in whole percent.

    A chunk that is reported more than once counts once; the state of a meeting is the set of its finished chunks.
    """
    done = results.where(F.col("status").isin("Completed", "Error")).groupBy("meeting").agg(F.size(F.collect_set("chunk_index")).cast("long").alias("done"))
    return done.join(planned, "meeting").select("meeting", "done", "total", F.floor(100 * F.col("done") / F.col("total")).alias("percent"))


def expiring_progress(results: DataFrame, planned: DataFrame, delay: str = "1 day") -> DataFrame:
    """As ``meeting_progress``, by event time: what is kept of a meeting goes once the watermark has passed its last result by ``delay``.

    The watermark runs ``delay`` behind the latest result, so a meeting is forgotten after two delays without one.
    Results older than the watermark, or without a time, are not counted; choose a delay beyond the longest pause inside a meeting.
    """
    pause = int(pd.Timedelta(delay).total_seconds() * 1000)

    def count(key, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        chunks, last = state.get if state.exists else ([], 0)
        chunks = set(chunks)
        for p in parts:
            chunks.update(p["chunk"].tolist())
            last = max(last, int(p["at"].max()))
        state.update((sorted(chunks), last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + pause)
        yield pd.DataFrame({"meeting": [key[0]], "done": [len(chunks)]})

    told = results.withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("status").isin("Completed", "Error") & F.col("ts").isNotNull() & F.col("meeting").isNotNull())
    done = (told.withWatermark("ts", delay).select("meeting", F.coalesce(F.col("chunk_index").cast("long"), F.lit(-1)).alias("chunk"), F.unix_millis("ts").alias("at"), "ts")
            .groupBy("meeting").applyInPandasWithState(count, "meeting string, done long", "chunks array<long>, last long", "update", "EventTimeTimeout"))
    return done.join(planned, "meeting").select("meeting", "done", "total", F.floor(100 * F.col("done") / F.col("total")).alias("percent"))


def session_counters(calls: DataFrame) -> DataFrame:
    """Running call, token and character counters per session."""
    return calls.groupBy("session").agg(
        F.count(F.lit(1)).alias("ai_calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens_used"), F.sum("chars_used").alias("chars"),
        F.max("ts").alias("last_active_at"))


def run_to_table(stream: DataFrame, keys: Sequence[str], folder: str | None = None) -> DataFrame:
    """Run a stream over all that is there and return its latest row per key.

    Every micro-batch writes its updated rows under its own number, so a batch
    that is run again after a failure replaces itself. Nothing passes the driver.
    A folder of its own, rows and state, is deleted once the result is kept;
    a named one stays, and a later call goes on from its state.
    """
    spark, named = stream.sparkSession, folder is not None
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    q = (stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    values = [c for c in stream.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*keys, "r.*")
    if named:
        return latest
    latest = cut_lineage(latest)
    remove_folder(spark, folder)
    return latest
