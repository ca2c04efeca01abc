"""Reading meeting tables and their JSON payloads, and writing them back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ordered
from ..functions import labels, text, vectors

# Payload layouts and sheet headings.
CHUNK_SCHEMA = """segments ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, speaker: STRING, speaker_id: STRING, text: STRING,
    timestamp_source: STRING, timestamp_overlap: BOOLEAN>>,
    raw_words ARRAY<STRUCT<text: STRING, start: DOUBLE, end: DOUBLE, speaker_id: STRING>>"""
SHEET_HEADINGS = {
    "title": "Tên nhiệm vụ", "assignee_display": "Người thực hiện", "project": "Dự án", "start_date": "Ngày bắt đầu",
    "due_date": "Ngày kết thúc", "end_date": "Ngày kết thúc", "description": "Mô tả chi tiết",
}
HISTORY_COLUMNS = ["meeting", "title", "date", "status", "audio_file", "modified"]
BLOCKED_EMAILS, BLOCKED_NAMES = ["guest@example.com", "admin@example.com"], ["Guest", "Administrator"]
# End of fixed values.


def read(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def history(meetings: DataFrame, owner: str | None = None) -> DataFrame:
    """Light columns of all meetings, newest first."""
    rows = meetings if owner is None else meetings.where(F.col("owner") == owner)
    return rows.orderBy(F.desc("creation"), "meeting").select(*[c for c in HISTORY_COLUMNS if c in meetings.columns])


def latest(meetings: DataFrame) -> DataFrame:
    return meetings.orderBy(F.desc("creation"), "meeting").limit(1)


def chunks_of(chunks: DataFrame, meeting: str) -> DataFrame:
    return chunks.where(F.col("meeting") == meeting).orderBy("chunk_index")


def explode_segments(chunks: DataFrame, vectors: bool = False) -> DataFrame:
    """One row per segment of every chunk's JSON, with its voice vector if asked; bad JSON gives no rows."""
    schema = CHUNK_SCHEMA.replace("text: STRING,", "text: STRING, embedding: ARRAY<DOUBLE>,", 1) if vectors else CHUNK_SCHEMA
    data = F.from_json("raw_segments", schema)
    return chunks.select("meeting", F.col("chunk_index").alias("chunk"), F.posexplode(data["segments"]).alias("idx", "s")) \
        .select("meeting", "chunk", "idx", "s.*")


def explode_words(chunks: DataFrame) -> DataFrame:
    data = F.from_json("raw_segments", CHUNK_SCHEMA)
    return chunks.select("meeting", F.col("chunk_index").alias("chunk"), F.posexplode(data["raw_words"]).alias("word_idx", "w")) \
        .select("meeting", "chunk", "word_idx", "w.*")


def read_mixed_rows(rows: DataFrame, column: str = "raw_results") -> DataFrame:
    """Segments written as objects or as lists, read by key or by position; lists under four entries are skipped."""
    list_ = F.try_variant_get(F.try_parse_json(column), "$", "array<variant>")
    v = rows.select("meeting", F.posexplode(list_).alias("idx", "v"))

    def field(key: str, at: int, kind: str) -> Column:
        return F.coalesce(F.try_variant_get("v", f"$.{key}", kind), F.try_variant_get("v", f"$[{at}]", kind))

    usable = F.schema_of_variant("v").startswith("OBJECT") | F.try_variant_get("v", "$[3]", "variant").isNotNull()
    return v.where(usable).select("meeting", F.col("idx").cast("long"), field("start", 0, "double").alias("start"), field("end", 1, "double").alias("end"),
                                  field("speaker", 2, "string").alias("speaker"), field("text", 3, "string").alias("text"))


def pack_segments(segments: DataFrame) -> DataFrame:
    """Ordered JSON of each meeting: display rows and original rows, these with their vector where there is one."""
    vector = ["embedding"] if "embedding" in segments.columns else []
    show = F.struct("idx", F.array(F.col("start").cast("string"), F.col("end").cast("string"), "label", "text").alias("r"))
    orig = F.struct("idx", F.struct("start", "end", F.col("label").alias("speaker"), "text", *vector, "speaker_id").alias("r"))
    pick = lambda s: F.to_json(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["r"]))
    return segments.groupBy("meeting").agg(pick(show).alias("raw_results"), pick(orig).alias("original_raw_results"))


def load_gallery(speakers: DataFrame, dims: int = 192) -> DataFrame:
    """Voice gallery from stored JSON vectors: bad rows dropped, unit length, default address."""
    v = F.from_json("embedding", "array<double>")
    rows = speakers.select(F.col("speaker_name").alias("name"), F.coalesce(F.nullif("email", F.lit("")), F.lit(labels.NO_EMAIL)).alias("email"),
                           "user_info", v.alias("_v"))
    return rows.where(vectors.is_valid("_v", dims)).select("name", "email", "user_info", vectors.unit("_v").alias("embedding"))


def upsert_voices(gallery: DataFrame, added: DataFrame) -> DataFrame:
    """Gallery with new voices; the latest record of a name wins, of equally late ones that which sorts last."""
    rest = [c for c in gallery.columns if c != "name"]
    both = gallery.unionByName(added)
    return both.groupBy("name").agg(F.max_by(F.struct(*rest), F.struct("updated_at", F.struct(*rest))).alias("r")).select("name", "r.*")


def task_sheet(tasks: DataFrame) -> DataFrame:
    """Tasks under sheet headings, without the internal assignee."""
    names = {c: h for c, h in SHEET_HEADINGS.items() if c in tasks.columns}
    return tasks.drop("assignee").withColumnsRenamed(names)


def write_task_sheet(tasks: DataFrame, path: str) -> None:
    task_sheet(tasks).write.mode("overwrite").option("header", True).csv(path)


def append_log(logs: DataFrame, lines: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Log text of each record with new stamped lines at the end, whole or cut to its last ``max_chars`` characters."""
    stamped = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), text.strip("line"))
    said = lines.where(text.filled("line").isNotNull()).select("doc", stamped.alias("line"), (-F.col("seq")).alias("_back"))
    # Only lines that reach into the last characters are gathered, however long the log is.
    if max_chars is not None:
        said = ordered.scan(said, ["doc"], "_back", sums={"_after": F.length("line") + 1})
        said = said.where(F.col("_after") - F.length("line") - 1 < max_chars)
    new = said.groupBy("doc").agg(ordered.ordered_join("line", -F.col("_back"), "\n").alias("_new"))
    old = F.nullif(F.regexp_replace(F.coalesce("log", F.lit("")), r"(?U)\s+\z", ""), F.lit(""))
    joined = F.concat_ws("\n", old, F.col("_new"))
    return logs.join(new, "doc", "full").select("doc", (text.strip(joined) if max_chars is None else F.right(text.strip(joined), F.lit(max_chars))).alias("log"))


def names_from_log(logs: DataFrame) -> DataFrame:
    """Speaker names recovered from log lines; the last mention of an id wins."""
    each = logs.select("meeting", F.posexplode(F.split("log", r"\R")).alias("line_no", "line"))
    each = each.where(F.contains("line", F.lit("[Speaker] Greedy result")) | F.contains("line", F.lit("Stranger DB rematch")))
    pat = r"(?U)(\w+_\w+)\s*(?:→|->)\s*'([^']+)'"
    pair = F.arrays_zip(F.regexp_extract_all("line", F.lit(pat), 1).alias("id"), F.regexp_extract_all("line", F.lit(pat), 2).alias("name"))
    found = each.select("meeting", "line_no", F.posexplode(pair).alias("at", "p")).where("p.name <> 'Speaker'")
    return found.groupBy("meeting", F.col("p.id").alias("speaker_id")).agg(F.max_by("p.name", F.struct("line_no", "at")).alias("name"))


def employees_from_users(users: DataFrame) -> DataFrame:
    """External users as employees; only those with an address."""
    mail = F.coalesce(F.nullif("email", F.lit("")), F.col("name"))
    return users.select("name", F.col("full_name").alias("employee_name"), mail.alias("user_id")).where(F.contains("user_id", F.lit("@")))


def local_roster(users: DataFrame, speakers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Roster from local accounts, then enrolled voices under keys not yet taken."""
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    u = users.select("name", "enabled", "user_type", F.coalesce(F.nullif(t("email"), F.lit("")), t("name")).alias("key"), t("full_name").alias("full_name"))
    u = u.where((F.col("enabled") == 1) & (F.col("key") != "") & ~F.lower("key").isin(*BLOCKED_EMAILS)
                & ~F.col("full_name").isin(*BLOCKED_NAMES) & ~F.col("name").isin(*BLOCKED_NAMES)
                & ~(F.coalesce("user_type", F.lit("")) == "Website User"))
    a = u.select("key", F.coalesce(F.nullif("full_name", F.lit("")), F.col("key")).alias("employee_name"), F.col("key").alias("user_id"),
                 F.coalesce("user_type", F.lit("")).alias("designation"), F.lit(0).alias("src"), F.col("full_name").alias("ord"))
    canon = aliases.select(F.col("alias").alias("name"), "canonical")
    s = speakers.select(t("name").alias("name"), F.nullif(F.nullif(t("email"), F.lit(labels.NO_EMAIL)), F.lit("")).alias("email")).where("name <> ''")
    s = s.join(canon, "name", "left").where(F.coalesce("canonical", "name") == F.col("name"))
    b = s.select(F.coalesce("email", "name").alias("key"), F.col("name").alias("employee_name"), F.coalesce("email", F.lit("")).alias("user_id"),
                 F.lit("Voice Speaker").alias("designation"), F.lit(1).alias("src"), F.col("name").alias("ord"))
    fields = F.struct("employee_name", "user_id", "designation")
    first = a.unionByName(b).groupBy("key").agg(F.min_by(fields, F.struct("src", "ord")).alias("r"))
    return first.select(F.col("key").alias("name"), "r.*")


def remote_roster(users: DataFrame) -> DataFrame:
    """Trimmed roster of users that have an address; the title is their job title."""
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return users.select(t("email").alias("name"), t("full_name").alias("employee_name"), t("email").alias("user_id"),
                        t("job_title").alias("designation")).where("name <> ''")


def without_null_names(speakers: DataFrame, column: str = "name") -> DataFrame:
    """Speakers without the junk rows named ``null``."""
    return speakers.where(F.coalesce(F.col(column) != "null", F.lit(True)))


def parse_model_lines(answers: DataFrame) -> DataFrame:
    """Lines ``[time] Speaker N: text`` of a model answer to segments; other lines are skipped."""
    from ..functions import times
    body = text.strip(F.regexp_replace(text.strip("answer"), r"(?m)^```[a-zA-Z]*\s*|\s*```$", ""))
    line = F.replace(F.replace(F.regexp_replace(text.strip("line"), '^"+|"+$', ""), F.lit("*"), F.lit("")), F.lit("•"), F.lit(""))
    rows = answers.select("meeting", "chunk", F.posexplode(F.split(body, r"\R")).alias("line_no", "line"))
    rows = rows.withColumn("line", text.strip(F.regexp_replace(line, r"(?U)^-\s*", "")))
    pat = r"(?iU)^\s*(?:\[(\d+(?::\d{1,2}){1,2}(?:\.\d+)?)\]\s*)?(Speaker\s*\d+)\s*[:：]\s*(.+?)\s*\z"
    part = lambda i: F.nullif(F.regexp_extract("line", pat, i), F.lit(""))
    rows = rows.withColumn("speaker", text.squish(part(2))).withColumn("text", text.filled(part(3))).withColumn("at", part(1))
    return rows.where(F.col("text").isNotNull()).select(
        "meeting", "chunk", "line_no", "speaker", "text", F.when(F.col("at").isNotNull(), times.parse_seconds("at")).alias("start"),
        F.when(F.col("at").isNotNull(), "model").alias("timestamp_source"))


def skipped_model_lines(answers: DataFrame) -> DataFrame:
    """Non-empty lines per answer that are not speaker lines."""
    body = text.strip(F.regexp_replace(text.strip("answer"), r"(?m)^```[a-zA-Z]*\s*|\s*```$", ""))
    said = answers.groupBy("meeting", "chunk").agg(F.sum(F.size(F.filter(F.split(body, r"\R"), lambda x: F.length(F.trim(x)) > 0))).alias("lines"))
    kept = parse_model_lines(answers).groupBy("meeting", "chunk").agg(F.count(F.lit(1)).alias("kept"))
    return said.join(kept, ["meeting", "chunk"], "left").select("meeting", "chunk", (F.col("lines") - F.coalesce("kept", F.lit(0))).alias("skipped"))
