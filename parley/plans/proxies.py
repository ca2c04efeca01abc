"""The given tables seen as meeting tables, for the engine and for its SQL check.

Every proxy reads its whole table. Times are multiples of 10 ms, so both
engines round them alike. ``CTES`` holds the same tables as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ordered
from ..functions import vectors
from ..operators import usage, voices

DIMS = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of every conversation as turns, timed by their place in the text; one meeting in ten has a clock that jumps back.

    A turn's place is its number times 1000 plus the number of the sentence, so
    nothing has to be counted across rows.
    """
    c = table(spark, sf, "conversations")
    lens = F.transform(F.split("text", r"\. "), lambda x: F.length(x))
    parts = F.arrays_zip(F.split("text", r"\. ").alias("text"), lens.alias("len"))
    rows = c.select(F.col("conv_id").cast("string").alias("meeting"), "conv_id", "turn", "role", lens.alias("lens"),
                    F.posexplode(parts).alias("pos", "p"))
    before = F.aggregate(F.slice("lens", F.lit(1), F.col("pos")), F.lit(0), lambda s, x: s + x)
    idx = F.col("turn") * 1000 + F.col("pos")
    rows = rows.select("meeting", "conv_id", "turn", "role", idx.alias("idx"), "pos",
                       F.when((F.col("turn") + F.col("pos")) % 11 == 7, "... 12").otherwise(F.col("p.text")).alias("text"),
                       (300000 * F.col("turn") + 70 * before + 250 * F.col("pos") + 1500 * F.floor(F.col("pos") / 5)
                        - F.when((F.col("conv_id") % 10 == 3) & (F.col("turn") > 0), 3000 * (F.col("pos") % 2)).otherwise(0)).alias("start_ms"),
                       (60 * F.col("p.len")).cast("long").alias("dur_ms"))
    start_ms = F.col("start_ms")
    chunk = F.col("turn").cast("int")
    who = F.when(F.col("role") == "user", "Speaker 1").when(F.col("role") == "assistant", "Speaker 2").otherwise("Speaker 3")
    sid = F.concat(F.lit("c"), chunk.cast("string"), F.lit("_"), F.lower(F.replace(who, F.lit(" "), F.lit("_"))))
    user, helper = F.col("role") == "user", F.col("role") == "assistant"
    label = (F.when(user & (F.col("conv_id") % 3 == 0), "👤 Nguyễn An").when(user, "👤 Speaker 1")
             .when(helper & (F.col("turn") % 4 == 1), "👤 Speaker 2").when(helper, "👤 Trần Bình (binh@x.vn)").otherwise(""))
    return rows.select("meeting", "idx", chunk.alias("chunk"), "turn", (start_ms / 1000.0).alias("start"),
                       ((start_ms + F.col("dur_ms")) / 1000.0).alias("end"), who.alias("speaker"), sid.alias("speaker_id"),
                       label.alias("label"), "text", F.lit("model").alias("timestamp_source"), F.lit(False).alias("timestamp_overlap"), "conv_id")


def durations(seg: DataFrame) -> DataFrame:
    return seg.groupBy("meeting", "chunk").agg(F.max("end").alias("duration"))


def local_segments(seg: DataFrame) -> DataFrame:
    """Turns on their chunk's own clock."""
    base = seg.groupBy("meeting", "chunk").agg(F.min("start").alias("_b"))
    ms = lambda c: F.round((F.col(c) - F.col("_b")) * 1000) / 1000.0
    return seg.join(base, ["meeting", "chunk"]).withColumn("start", ms("start")).withColumn("end", ms("end")).drop("_b")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    seg = segments(spark, sf)
    k = (F.col("conv_id") * 3 + F.col("chunk")) % 13
    status = F.when(k == 0, "Error").when(k == 1, "Pending").when(k == 2, "Processing").otherwise("Completed")
    per = seg.groupBy("meeting", "conv_id", "chunk").agg(
        F.sum(F.length("text")).alias("stt_prompt_tokens"), F.count(F.lit(1)).alias("segment_count"),
        F.min("start").alias("offset_sec"))
    return (per.withColumn("stt_completion_tokens", F.col("segment_count") * 3)
            .withColumn("stt_total_tokens", F.col("stt_prompt_tokens") + F.col("stt_completion_tokens"))
            .withColumn("stt_cost_usd", usage.token_cost("stt_prompt_tokens", "stt_completion_tokens"))
            .withColumn("status", status).withColumn("error_message", F.concat(F.lit("err "), F.col("chunk").cast("string")))
            .withColumnRenamed("chunk", "chunk_index"))


def chunk_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with their segments as stored JSON; every ninth chunk holds broken JSON."""
    seg = segments(spark, sf)
    item = F.struct("idx", F.struct("start", "end", "speaker", "speaker_id", "text", "timestamp_source", "timestamp_overlap").alias("s"))
    per = seg.groupBy("meeting", "conv_id", "chunk").agg(F.array_sort(F.collect_list(item)).alias("items"))
    body = F.to_json(F.struct(F.transform("items", lambda x: x["s"]).alias("segments")))
    bad = (F.col("conv_id") + F.col("chunk")) % 9 == 4
    return per.select("meeting", F.col("chunk").alias("chunk_index"), F.when(bad, F.lit("{broken")).otherwise(body).alias("raw_segments"))


def speaker_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Logs in which every turn but each fourth names the first speaker of a chunk."""
    c = table(spark, sf, "conversations")
    said = F.concat(F.lit("[x] [Speaker] Greedy result (1 speakers): c"), (F.col("turn") % 3).cast("string"), F.lit("_speaker_1→'"), "role", F.col("turn").cast("string"), F.lit("'(0.9), c9_speaker_9→'Speaker'(0.1)"))
    line = F.struct("turn", F.when(F.col("turn") % 4 == 2, "nothing c0_speaker_1→'x'").otherwise(said).alias("l"))
    return c.groupBy(F.col("conv_id").cast("string").alias("meeting")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").alias("log"))


def meetings(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    m = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"), F.max_by("text", "turn").alias("content"), F.sum(F.length("text")).alias("fallback_prompt"))
    k = F.col("conv_id") % 6
    status = F.when(k == 0, "Completed").when(k == 1, "Analyzed").when(k == 2, "Processing").when(k == 3, "Error").when(k == 4, "Partial Error").otherwise("Pending")
    at = F.timestamp_seconds(1704067200 + (F.col("conv_id") * 7919) % 1000003).cast("timestamp_ntz")
    return m.select(F.col("conv_id").cast("string").alias("meeting"), "title", at.alias("date"), at.alias("creation"), at.alias("modified"), status.alias("status"),
                    F.concat(F.lit("/files/"), F.col("conv_id").cast("string"), F.lit(".wav")).alias("audio_file"),
                    F.when(k == 0, F.lit("")).otherwise(F.col("content")).alias("meeting_summary"), F.when(k == 1, F.col("title")).alias("conclusion"),
                    F.concat(F.lit("u"), (F.col("conv_id") % 10).cast("string")).alias("owner"), "content",
                    "fallback_prompt", (F.col("conv_id") % 5).alias("fallback_completion"), "conv_id")


def calls(spark: SparkSession, sf: str) -> DataFrame:
    return calls_from(table(spark, sf, "events"))


def calls_from(e: DataFrame) -> DataFrame:
    whole = lambda x: F.floor(F.col("value") * x).cast("long")
    return e.select(F.col("user_id").cast("string").alias("session"), F.concat(F.lit("a"), F.floor(F.col("event_id") / 3).cast("string")).alias("action"),
                    F.lit("stt").alias("call_type"), F.col("event_type").alias("ai_model"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
                    "ts", whole(10).alias("prompt_tokens"), whole(1).alias("completion_tokens"), whole(14).alias("total_tokens"),
                    whole(0.5).alias("thought_tokens"), whole(1).alias("candidate_tokens"), whole(3).alias("chars_used"),
                    (F.col("value") / 7).alias("duration_seconds"), F.col("props").alias("error_message"), "event_id")


def voices_of(spark: SparkSession, sf: str) -> DataFrame:
    """Voice windows: 25 in a row make a meeting, the label is the true voice."""
    e = table(spark, sf, "embeddings")
    chunk = F.floor((F.col("vec_id") % 25) / 9).cast("int")
    return e.select(F.floor(F.col("vec_id") / 25).cast("string").alias("meeting"), (F.col("vec_id") % 25).alias("idx"), (F.col("vec_id") % 25).alias("w_idx"),
                    chunk.alias("chunk"), F.concat(F.lit("c"), chunk.cast("string"), F.lit("_speaker_"), F.col("label").cast("string")).alias("speaker_id"),
                    ((F.col("vec_id") % 25) * 3.0).alias("start"), ((F.col("vec_id") % 25) * 3.0 + 3.0 - (F.col("label") % 3) * 0.5).alias("end"),
                    F.concat(F.lit("Speaker "), F.col("label").cast("string")).alias("speaker"),
                    F.concat(F.lit("👤 Speaker "), F.col("label").cast("string")).alias("label"),
                    F.repeat(F.lit("w "), (F.col("vec_id") * 7 % 13 + 1).cast("int")).alias("text"), F.col("label").alias("voice"), "vec_id", "embedding")


def gallery(spark: SparkSession, sf: str) -> DataFrame:
    """Enrolled voices: the mean of each (label, vec_id mod 4) group."""
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("voice_"), F.col("label").cast("string"), F.lit("_"), (F.col("vec_id") % 4).cast("string")).alias("name"), "embedding")
    g = voices.mean_vector(e, ["name"], DIMS).drop("n")
    return g.withColumn("email", F.when(F.col("name").endswith("_0"), "Chưa cập nhật").otherwise(F.concat("name", F.lit("@x.vn"))))


def employees(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("string").alias("name"), F.col("p_name").alias("employee_name"),
                    F.concat(F.lit("e"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise("@x.vn")).alias("user_id"),
                    F.col("p_type").alias("designation"), F.col("p_brand").alias("department"))


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Names to look up: with a form of address, with an extra word, or with the words turned around."""
    p = table(spark, sf, "part")
    w = F.split("p_name", " ")
    turned = F.concat_ws(" ", F.element_at(w, -1), F.element_at(w, 1))
    person = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Mr. "), F.col("p_name"))).when(
        F.col("p_size") % 3 == 1, F.concat_ws(" ", "p_name", "p_type")).otherwise(turned)
    return p.select(F.col("p_partkey").alias("person_id"), person.alias("person"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("title"),
                    F.when(F.col("p_size") % 5 < 2, F.col("p_brand")).alias("department"))


def projects(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("name"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("project_name"),
                    F.concat(F.lit("e"), (F.col("c_custkey") % 200).cast("string"), F.lit("@x.vn")).alias("owner"))


def members(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.concat(F.lit("e"), (F.col("o_orderkey") % 300).cast("string"), F.lit("@x.vn")).alias("user"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("parent"))


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.floor(F.col("o_orderkey") / 5).alias("batch"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("title"),
                    F.concat(F.lit("P"), ((F.col("o_custkey") + 1) % 40).cast("string")).alias("project"),
                    F.concat(F.lit("HR_EMP_"), (F.col("o_orderkey") % 50).cast("string")).alias("assignee_hr_code"),
                    F.when(F.col("o_orderkey") % 3 == 0, "noti").otherwise("task").alias("task_type"),
                    F.date_format("o_orderdate", "dd/MM/yyyy").alias("start_date"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("end_date"),
                    F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderstatus")).alias("description"))


def erp_tasks(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "Open").when(F.col("o_orderstatus") == "O", "Working").otherwise("Completed")
    return o.select(F.col("o_orderkey").cast("string").alias("name"), F.concat(F.lit("[TASK] "), F.col("o_orderpriority")).alias("subject"),
                    F.concat(F.lit("P"), (F.col("o_custkey") % 40).cast("string")).alias("project"),
                    F.concat(F.lit("HR_EMP_"), (F.col("o_orderkey") % 50).cast("string")).alias("custom_assignee"), status.alias("status"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Speech flags: one frame per word of a turn, quiet where the word length divides by three."""
    c = table(spark, sf, "conversations")
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return c.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("file"),
                    F.posexplode(words).alias("frame_idx", "w")).select("file", "frame_idx", (F.length("w") % 3 != 0).alias("is_speech"))


def frame_durations(fr: DataFrame) -> DataFrame:
    return fr.groupBy("file").agg(((F.max("frame_idx") + 1) * 30 / 1000.0).alias("duration"))


def speech(seg: DataFrame) -> DataFrame:
    """Speech intervals per meeting: the middle of each turn."""
    return seg.where(F.col("end") - F.col("start") > 1.0).select(
        "meeting", F.col("idx").alias("ord"), (F.round((F.col("start") + 0.2) * 100) / 100.0).alias("start"), (F.round((F.col("end") - 0.3) * 100) / 100.0).alias("end"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers in JSON, one per turn of a conversation, fenced; every tenth is broken."""
    c = table(spark, sf, "conversations")
    item = F.struct(F.lit(1).alias("id"), F.col("text").alias("noi_dung"), F.col("role").alias("nguoi_thuc_hien"), F.lit("ghi chú").alias("note"),
                    F.when(F.col("turn") % 2 == 0, "Thông báo chung").otherwise("task").alias("loai"))
    body = F.to_json(F.struct(F.when(F.col("turn") % 3 == 1, F.col("role")).otherwise("").alias("ten_cuoc_hop"), F.lit("01/02/2024").alias("ngay_hop"),
                              F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("").alias("tom_tat_cuoc_hop"),
                              F.when(F.col("turn") % 3 == 0, F.col("text")).alias("ket_luan_cuoc_hop"), F.array(item, item).alias("items")))
    broken = (F.col("conv_id") + F.col("turn")) % 10 == 3
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("part"),
                    F.when(broken, "no json").otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("answer"),
                    F.length("text").cast("long").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"))


def unit_doubles(df: DataFrame) -> DataFrame:
    return df.withColumn("embedding", vectors.unit("embedding"))


CTES = {
    "seg": """
lines0 AS (
  SELECT conv_id, turn, role, p, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT *, string_split(text, '. ') AS p FROM conversations)),
seg1 AS (
  SELECT CAST(conv_id AS VARCHAR) AS meeting, turn * 1000 + pos AS idx, CAST(turn AS INTEGER) AS chunk, turn, role, conv_id,
    CASE WHEN (turn + pos) % 11 = 7 THEN '... 12' ELSE part END AS text,
    CASE role WHEN 'user' THEN 'Speaker 1' WHEN 'assistant' THEN 'Speaker 2' ELSE 'Speaker 3' END AS speaker,
    CAST(300000 * turn + 70 * coalesce(list_sum(list_transform(p[1:pos], lambda x: length(x))), 0) + 250 * pos + 1500 * (pos // 5)
      - CASE WHEN conv_id % 10 = 3 AND turn > 0 THEN 3000 * (pos % 2) ELSE 0 END AS BIGINT) AS start_ms,
    CAST(60 * length(part) AS BIGINT) AS dur_ms
  FROM lines0),
seg AS (
  SELECT meeting, idx, chunk, turn, start_ms / 1000.0::DOUBLE AS start, (start_ms + dur_ms) / 1000.0::DOUBLE AS "end", speaker,
    'c' || chunk || '_' || lower(replace(speaker, ' ', '_')) AS speaker_id,
    CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN '👤 Nguyễn An' WHEN role = 'user' THEN '👤 Speaker 1'
         WHEN role = 'assistant' AND turn % 4 = 1 THEN '👤 Speaker 2' WHEN role = 'assistant' THEN '👤 Trần Bình (binh@x.vn)'
         ELSE '' END AS label,
    text, conv_id, start_ms, start_ms + dur_ms AS end_ms
  FROM seg1)""",
    "loc": """
loc AS (
  SELECT meeting, idx, chunk, speaker, speaker_id, text, conv_id, (start_ms - b) / 1000.0::DOUBLE AS start, (end_ms - b) / 1000.0::DOUBLE AS "end"
  FROM (SELECT *, min(start_ms) OVER (PARTITION BY meeting, chunk) AS b FROM seg))""",
    "chunk_t": """
chunk_t AS (
  SELECT *, 'err ' || chunk_index AS error_message,
    stt_prompt_tokens * (0.75::DOUBLE / 1000000) + stt_completion_tokens * (3.75::DOUBLE / 1000000) AS stt_cost_usd,
    stt_prompt_tokens + stt_completion_tokens AS stt_total_tokens,
    CASE (conv_id * 3 + chunk_index) % 13 WHEN 0 THEN 'Error' WHEN 1 THEN 'Pending' WHEN 2 THEN 'Processing' ELSE 'Completed' END AS status
  FROM (SELECT meeting, conv_id, chunk AS chunk_index, CAST(sum(length(text)) AS BIGINT) AS stt_prompt_tokens, count(*) AS segment_count,
          count(*) * 3 AS stt_completion_tokens, min(start) AS offset_sec FROM seg GROUP BY ALL))""",
    "meet": """
meet AS (
  SELECT CAST(conv_id AS VARCHAR) AS meeting, title, content, conv_id, fallback_prompt, conv_id % 5 AS fallback_completion,
    TIMESTAMP '2024-01-01' + to_seconds((conv_id * 7919) % 1000003) AS creation,
    CASE conv_id % 6 WHEN 0 THEN 'Completed' WHEN 1 THEN 'Analyzed' WHEN 2 THEN 'Processing' WHEN 3 THEN 'Error' WHEN 4 THEN 'Partial Error' ELSE 'Pending' END AS status,
    '/files/' || conv_id || '.wav' AS audio_file, CASE WHEN conv_id % 6 = 0 THEN '' ELSE content END AS meeting_summary,
    CASE WHEN conv_id % 6 = 1 THEN title END AS conclusion, 'u' || (conv_id % 10) AS owner
  FROM (SELECT conv_id, arg_min(text, turn) AS title, arg_max(text, turn) AS content, CAST(sum(length(text)) AS BIGINT) AS fallback_prompt
        FROM conversations GROUP BY conv_id))""",
    "call_t": """
call_t AS (
  SELECT CAST(user_id AS VARCHAR) AS session, 'a' || (event_id // 3) AS action, event_type AS ai_model,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, ts, CAST(floor(value * 10) AS BIGINT) AS prompt_tokens,
    CAST(floor(value * 1) AS BIGINT) AS completion_tokens, CAST(floor(value * 14) AS BIGINT) AS total_tokens,
    CAST(floor(value * 0.5::DOUBLE) AS BIGINT) AS thought_tokens, CAST(floor(value * 1) AS BIGINT) AS candidate_tokens,
    CAST(floor(value * 3) AS BIGINT) AS chars_used, value / 7 AS duration_seconds, props AS error_message, event_id
  FROM events)""",
    "voice": """
voice AS (
  SELECT CAST(vec_id // 25 AS VARCHAR) AS meeting, vec_id % 25 AS idx, vec_id % 25 AS w_idx, CAST((vec_id % 25) // 9 AS INTEGER) AS chunk,
    'c' || ((vec_id % 25) // 9) || '_speaker_' || label AS speaker_id, (vec_id % 25) * 3.0::DOUBLE AS start,
    (vec_id % 25) * 3.0::DOUBLE + 3.0 - (label % 3) * 0.5::DOUBLE AS "end", 'Speaker ' || label AS speaker, '👤 Speaker ' || label AS label,
    repeat('w ', CAST(vec_id * 7 % 13 + 1 AS INTEGER)) AS text, label AS voice, vec_id, CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings)""",
    "gal": """
gal0 AS (
  SELECT name, d, avg(x) AS x FROM (
    SELECT 'voice_' || label || '_' || (vec_id % 4) AS name, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)
  GROUP BY ALL),
gal AS (SELECT name, list(x ORDER BY d) AS embedding, CASE WHEN name LIKE '%\\_0' ESCAPE '\\' THEN 'Chưa cập nhật' ELSE name || '@x.vn' END AS email FROM gal0 GROUP BY name)""",
    "emp": """
emp AS (
  SELECT CAST(p_partkey AS VARCHAR) AS name, p_name AS employee_name, 'e' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '@x.vn' END AS user_id,
    p_type AS designation, p_brand AS department FROM part)""",
    "peo": """
peo AS (
  SELECT p_partkey AS person_id, CASE p_size % 3 WHEN 0 THEN 'Mr. ' || p_name WHEN 1 THEN p_name || ' ' || p_type
    ELSE string_split(p_name, ' ')[-1] || ' ' || string_split(p_name, ' ')[1] END AS person,
    CASE WHEN p_size % 2 = 0 THEN p_type END AS title, CASE WHEN p_size % 5 < 2 THEN p_brand END AS department FROM part)""",
    "proj": """
proj AS (SELECT 'P' || c_custkey AS name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS project_name, 'e' || (c_custkey % 200) || '@x.vn' AS owner FROM customer),
memb AS (SELECT 'e' || (o_orderkey % 300) || '@x.vn' AS "user", 'P' || o_custkey AS parent FROM orders)""",
    "task_t": """
task_t AS (
  SELECT o_orderkey // 5 AS batch, o_orderkey AS seq, o_orderpriority AS title, 'P' || ((o_custkey + 1) % 40) AS project,
    'HR_EMP_' || (o_orderkey % 50) AS assignee_hr_code, CASE WHEN o_orderkey % 3 = 0 THEN 'noti' ELSE 'task' END AS task_type,
    o_orderdate, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END AS description FROM orders),
erp AS (
  SELECT o_orderpriority AS subject, 'P' || (o_custkey % 40) AS project, 'HR_EMP_' || (o_orderkey % 50) AS custom_assignee FROM orders
  WHERE o_orderstatus IN ('F', 'O')),
dup AS (
  SELECT t.*, EXISTS (SELECT 1 FROM erp e WHERE e.subject = t.title AND e.project = t.project AND e.custom_assignee = t.assignee_hr_code) AS duplicate
  FROM task_t t)""",
    "frm": """
frm AS (
  SELECT conv_id || '-' || turn AS file, i - 1 AS frame_idx, length(w) % 3 <> 0 AS is_speech FROM (
    SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT conv_id, turn, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS ws FROM conversations))),
frd AS (SELECT file, (max(frame_idx) + 1) * 30 / 1000.0::DOUBLE AS duration, max(frame_idx) AS final FROM frm GROUP BY file)""",
    "spk": """
spk AS (
  SELECT meeting, idx AS ord, round((start + 0.2::DOUBLE) * 100) / 100.0::DOUBLE AS start, round(("end" - 0.3::DOUBLE) * 100) / 100.0::DOUBLE AS "end"
  FROM seg WHERE "end" - start > 1.0)""",
    "wrd": """
wrd0 AS (
  SELECT meeting, chunk, idx, start, "end", lower(replace(speaker, ' ', '_')) AS speaker_id, ws, len(ws) AS n FROM (
    SELECT *, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM seg)),
wrd1 AS (
  SELECT meeting, chunk, idx, speaker_id, start, ("end" - start) / n AS step, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS word_idx FROM wrd0 WHERE n > 0),
wrd AS (
  SELECT meeting, chunk, idx, CAST(word_idx AS INTEGER) AS word_idx, CAST(printf('%.2f', start + word_idx * step) AS DOUBLE) AS start,
    CAST(printf('%.2f', start + (word_idx + 1) * step) AS DOUBLE) AS "end", speaker_id, text FROM wrd1)""",
    "ans": """
ans AS (
  SELECT conv_id AS doc_id, turn AS part, (conv_id + turn) % 10 = 3 AS broken, CASE WHEN turn % 3 = 1 THEN role ELSE '' END AS ten,
    CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS tom, CASE WHEN turn % 3 = 0 THEN text END AS ket, text, role, length(text) AS prompt_tokens, turn AS completion_tokens
  FROM conversations)""",
}

# Which other tables each one reads.
NEEDS = {"loc": ["seg"], "chunk_t": ["seg"], "spk": ["seg"], "wrd": ["seg"]}


def with_ctes(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause of the named tables and those they read."""
    order: list[str] = []
    for n in names:
        for m in [*NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(CTES[n] for n in order)
