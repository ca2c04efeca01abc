import time
from datetime import datetime

from pyspark.sql import functions as F

from parley.streaming import progress as S


def test_state_goes_after_the_watermark(spark, tmp_path):
    def arrive(rows):
        df = spark.createDataFrame([(m, c, s, t and datetime.fromisoformat(f"2024-01-01 {t}")) for m, c, s, t in rows], S.CHUNK_EVENTS)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are read in the order of their times

    planned = spark.createDataFrame([("a", 4), ("b", 2), ("c", 10)], "meeting string, total long")
    arrive([("a", 0, "Completed", "10:00"), ("a", 0, "Completed", "10:00"), ("a", 1, "Error", "10:01"), ("a", 2, "Processing", "10:02"), ("b", 0, "Completed", "10:02"), ("b", 1, "Error", None)])
    arrive([("a", 1, "Completed", "10:20"), ("a", 3, "Completed", "10:20"), ("b", None, "Completed", "10:05")])
    for i, t in enumerate(["13:00", "15:00", "17:00"]):
        arrive([("c", i, "Completed", t), ("a", 2, "Completed", "10:21")] if i == 2 else [("c", i, "Completed", t)])
    stream = S.expiring_progress(S.file_stream(spark, f"{tmp_path}/in", S.CHUNK_EVENTS, files_per_batch=1), planned, "30 minutes")
    seen = []

    def keep(batch, number):
        seen.extend((number, *r) for r in batch.select("meeting", "done", "percent").collect())

    q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    latest = {}
    for _, meeting, done, percent in sorted(seen):
        latest.setdefault(meeting, []).append((done, percent))
    assert latest["a"] == [(2, 50), (3, 75)]  # the last report of a is older than the watermark
    assert latest["b"] == [(1, 50), (2, 100)] and latest["c"] == [(1, 10), (2, 20), (3, 30)]
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert max(kept) >= 2 and kept[-1] == 1


def test_equal_to_the_plain_form(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 37).cast("string").alias("meeting"), (F.col("id") % 50).cast("int").alias("chunk_index"),
                                    F.when(F.col("id") % 3 == 0, "Completed").otherwise("Processing").alias("status"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"))
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    planned = rows.groupBy("meeting").agg(F.count(F.lit(1)).alias("total"))
    stream = lambda: S.file_stream(spark, f"{tmp_path}/in", S.CHUNK_EVENTS, files_per_batch=2)
    a = S.run_to_table(S.meeting_progress(stream(), planned), ["meeting"]).collect()
    b = S.run_to_table(S.expiring_progress(stream(), planned), ["meeting"]).collect()
    assert sorted(a) == sorted(b) and len(a) == 37
