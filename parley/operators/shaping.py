"""Transcript shaping: merging neighbours, numbering strangers, rendering, editing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ordered
from ..functions import labels, text, times
from ..ordered import ordered_join
from ..session import cut_lineage
from ..sources import tables
from .timeline import MERGE_GAP

M = ["meeting"]
NEW_SPEAKER = "Người lạ (mới)"
GUEST = "Khách"
_JOINT = "\u0001"


def spoken_join(value: Column, by: Column) -> Column:
    """Aggregate: join turn texts in order with a blank, but not in front of closing punctuation."""
    glued = ordered_join(text.filled(value), by, _JOINT)
    glued = F.regexp_replace(glued, _JOINT + r"(?=[,.;:!?)\]}])", "")
    return F.coalesce(F.replace(glued, F.lit(_JOINT), F.lit(" ")), F.lit(""))


def merge_turns(segments: DataFrame, max_gap: float = MERGE_GAP, meaningful: Column | None = None, pos: str = "idx",
                ties: Sequence[str] = (), width: float = ordered.SLICE_ROWS) -> DataFrame:
    """Join neighbouring turns of one label and one raw id with at most ``max_gap`` between them.

    Turns without meaning are dropped and keep their neighbours apart. Needs
    ``label`` and ``speaker_id``; an ``embedding`` column is carried if present.
    A merged turn keeps the place of its first part.
    """
    carried = ["embedding"] if "embedding" in segments.columns else []
    places = list(dict.fromkeys([pos, *ties]))
    rows = segments.select("meeting", *places, *[c for c in ("start", "end") if c not in places], "label",
                           F.coalesce("speaker_id", F.lit("")).alias("speaker_id"), text.drop_ellipsis("text").alias("text"), *carried)
    rows = rows.withColumn("_keep", text.is_meaningful("text") if meaningful is None else meaningful)

    def breaks(before, row):
        return ~(before["_keep"] & before["label"].eqNullSafe(row["label"]) & (before["speaker_id"] == row["speaker_id"])
                 & (row["start"] - before["end"] <= max_gap))

    marked = ordered.runs(rows, M, pos, ["_keep", "label", "speaker_id", "start", "end"], breaks, ties=ties, width=width)
    return _fold(marked.where("_keep"), pos, ties)


def _fold(marked: DataFrame, pos: str = "idx", ties: Sequence[str] = ()) -> DataFrame:
    at = F.struct(pos, *ties) if ties else F.col(pos)
    aggs = [F.min_by("start", at).alias("start"), F.max_by("end", at).alias("end"), F.first("label").alias("label"),
            F.first("speaker_id").alias("speaker_id"), ordered_join("text", at, " ").alias("text"),
            F.count(F.lit(1)).alias("parts")]
    if "embedding" in marked.columns:
        aggs.append(F.min_by("embedding", F.when(F.col("embedding").isNotNull(), at)).alias("embedding"))
    out = marked.groupBy("meeting", "run").agg(*aggs)
    place = [F.col(f"run.{c}").alias(c) for c in (pos, *ties) if c not in ("start", "end")] if ties else [F.col("run").alias(pos)]
    return out.select("meeting", *place, *[c for c in out.columns if c not in ("meeting", "run")])


def merge_same_label(segments: DataFrame, sources: Sequence[str] = ("source_speaker", "speaker_id", "source",
                                                                     "source_chunk", "chunk")) -> DataFrame:
    """Join all neighbours that share a label, and their originals in step.

    The raw label stays only if all parts have the same one, a source key is
    blanked if parts differ, and the vector of the longest part is kept.
    """
    sources = [s for s in sources if s in segments.columns]
    label = text.strip(F.coalesce("label", F.lit("")))
    raw = F.coalesce(text.filled("raw_speaker") if "raw_speaker" in segments.columns else F.lit(None),
                     text.filled("speaker"), F.lit(""))
    rows = segments.withColumn("label", label).withColumn("_raw", raw)
    marked = ordered.runs(rows, M, "idx", ["label"], lambda p, r: (r["label"] == "") | (p["label"] != r["label"]))
    aggs = [F.min_by("start", "idx").alias("start"), F.max_by("end", "idx").alias("end"), F.first("label").alias("label"),
            spoken_join(F.col("text"), F.col("idx")).alias("text"),
            (F.min("_raw") == F.max("_raw")).alias("_one_raw"), F.min("_raw").alias("_raw"),
            F.min_by("speaker", "idx").alias("speaker"), F.count(F.lit(1)).alias("parts")]
    for s in sources:
        v = text.strip(F.coalesce(F.col(s).cast("string"), F.lit("")))
        aggs.append(F.when(F.min(v) == F.max(v), F.min(v)).otherwise("").alias(s))
    if "embedding" in segments.columns:
        length = times.segment_duration("start", "end")
        aggs.append(F.max_by("embedding", F.when(F.col("embedding").isNotNull(),
                                                 F.struct(length.alias("d"), (-F.col("idx")).alias("i")))).alias("embedding"))
    out = marked.groupBy("meeting", "run").agg(*aggs)
    out = (out.withColumn("raw_speaker", F.when(F.col("_one_raw"), F.col("_raw")).otherwise(F.col("label")))
           .withColumn("speaker", F.when(F.col("_one_raw"), F.col("speaker")).otherwise(F.col("label"))))
    return out.withColumnRenamed("run", "idx").drop("_one_raw", "_raw")


def collapse_short_strangers(items: DataFrame, max_gap: float = MERGE_GAP) -> DataFrame:
    """Give strangers with hardly any speech the label of their nearest neighbour, then join turns again."""
    totals = items.groupBy("meeting", "label").agg(F.sum(times.segment_duration("start", "end")).alias("d"),
                                                   F.count(F.lit(1)).alias("n"))
    stranger = F.col("label").rlike("^👤 (Speaker|Người lạ)")
    short = totals.where(stranger & ((F.col("d") <= 3.0) | ((F.col("d") <= 8.0) & (F.col("n") <= 3)))) \
        .select("meeting", "label", F.lit(True).alias("_short"))
    rows = items.join(short, ["meeting", "label"], "left").withColumn("_short", F.coalesce("_short", F.lit(False)))
    lasting = F.when(~F.col("_short"), F.struct("label", "start", "end"))
    near = ordered.scan(rows, M, "idx", prev={"_l": lasting}, following={"_r": lasting})
    back = F.abs(F.col("start") - F.coalesce(F.nullif("_l.end", F.lit(0.0)), "_l.start"))
    ahead = F.abs(F.col("_r.start") - F.coalesce(F.nullif("end", F.lit(0.0)), "start"))
    closer = F.when(F.col("_l").isNotNull() & (F.col("_r").isNull() | (back <= ahead)), F.col("_l.label")).otherwise(F.col("_r.label"))
    near = near.withColumn("_to", closer)
    # The last turn of a stranger that has a labelled neighbour decides for all of its turns.
    remap = (near.where(F.col("_short") & (F.col("_to") != "")).groupBy("meeting", "label")
             .agg(F.max_by("_to", "idx").alias("_to")))
    named = items.join(remap, ["meeting", "label"], "left").withColumn("label", F.coalesce("_to", "label")).drop("_to")
    named = named.withColumn("speaker_id", F.coalesce("speaker_id", F.lit("")))
    marked = ordered.runs(named, M, "idx", ["label", "speaker_id", "start", "end"], lambda p, r: ~(
        (p["label"] == r["label"]) & (p["speaker_id"] == r["speaker_id"]) & (r["start"] - p["end"] <= max_gap)))
    return _fold(marked)


def renumber_strangers(segments: DataFrame, unnamed: Column | None = None, prefix: str = "👤 Speaker ") -> DataFrame:
    """Number unnamed labels 1, 2, … by first appearance in their meeting."""
    unnamed = F.col("label").rlike(labels.STRANGER_LABEL) if unnamed is None else unnamed
    firsts = segments.where(unnamed).groupBy("meeting", "label").agg(F.min("idx").alias("_first"))
    numbers = ordered.number_rows(firsts, M, "_first", name="_no", start=1).select(
        "meeting", "label", F.concat(F.lit(prefix), F.col("_no").cast("string")).alias("_label"))
    return (segments.join(numbers, ["meeting", "label"], "left")
            .withColumn("label", F.coalesce("_label", "label")).select(*segments.columns))


def render_transcript(segments: DataFrame) -> DataFrame:
    """One text per meeting: a heading with the time whenever the label changes."""
    step = ordered.scan(segments, M, "idx", prev={"_p": F.struct("label")})
    head = F.concat(F.lit("\n**"), F.col("label"), F.lit("** ["), F.format_string("%.1f", times.exact_round("start", 1)), F.lit("s]\n"))
    piece = F.concat(F.when(F.col("_p.label").eqNullSafe(F.col("label")), F.lit(" ")).otherwise(head), F.col("text"))
    return (step.select("meeting", "idx", piece.alias("piece")).groupBy("meeting")
            .agg(text.strip(ordered_join("piece", "idx", "")).alias("transcript")))


def plain_transcript(segments: DataFrame) -> DataFrame:
    """One text per meeting: the non-empty turn texts in order."""
    return segments.groupBy("meeting").agg(
        F.coalesce(ordered_join(text.filled("text"), "idx", " "), F.lit("")).alias("transcript"))


def markdown_minutes(meetings: DataFrame, segments: DataFrame, tasks: DataFrame) -> DataFrame:
    """Minutes of each meeting: header, summary, conclusion, turns and tasks."""
    who = F.coalesce(F.nullif("speaker", F.lit("")), F.lit("?"))
    said = F.concat(F.lit("**"), who, F.lit("**: "), F.coalesce("text", F.lit("")))
    turns = segments.groupBy("meeting").agg(ordered_join(said, "idx", "\n").alias("_turns"), F.count(F.lit(1)).alias("_n"))
    todo = tasks.groupBy("meeting").agg(ordered_join(F.concat(F.lit("- "), F.col("title")), "item_id", "\n").alias("_todo"),
                                        F.count(F.lit(1)).alias("_k"))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    n = F.coalesce("_n", F.lit(0)).cast("string")
    parts = F.concat_ws(
        "\n", F.concat(F.lit("# "), F.coalesce(filled("title"), F.col("meeting")), F.lit("\n")),
        F.concat(F.lit("- Mã: "), F.col("meeting")),
        F.concat(F.lit("- Ngày: "), F.coalesce(F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.lit("?"))),
        F.concat(F.lit("- Trạng thái: "), F.coalesce("status", F.lit("None")), F.lit("\n")),
        F.concat(F.lit("## Tóm tắt\n"), filled("meeting_summary"), F.lit("\n")),
        F.concat(F.lit("## Kết luận\n"), filled("conclusion"), F.lit("\n")),
        F.concat(F.lit("## Nội dung chi tiết ("), n, F.lit(" lượt nói)")),
        F.coalesce("_turns", F.lit("_Chưa có transcript (meeting có thể đang xử lý hoặc bị lỗi)._")),
        F.concat(F.lit("\n## Danh sách task ("), F.col("_k").cast("string"), F.lit(")\n"), F.col("_todo")))
    return (meetings.join(turns, M, "left").join(todo, M, "left").select("meeting", parts.alias("minutes")))


def speaker_counts(segments: DataFrame) -> DataFrame:
    """Named speakers, unnamed groups and unnamed turns per meeting."""
    per_label = (segments.where(F.coalesce("label", F.lit("")) != "").groupBy("meeting", "label")
                 .agg(F.count(F.lit(1)).alias("n")).withColumn("u", labels.is_unknown("label")))
    return per_label.groupBy("meeting").agg(
        F.count_if(~F.col("u")).alias("known_count"), F.count_if("u").alias("unknown_group_count"),
        F.coalesce(F.sum(F.when(F.col("u"), F.col("n"))), F.lit(0)).alias("unknown_segments"))


def distinct_labels(segments: DataFrame, label: str | Column = "label") -> DataFrame:
    """Labels of a meeting in the order they first appear."""
    firsts = (segments.select("meeting", "idx", text.col(label).alias("label")).where(F.coalesce("label", F.lit("")) != "")
              .groupBy("meeting", "label").agg(F.min("idx").alias("first_idx")))
    return ordered.number_rows(firsts, M, "first_idx", name="ord", start=1)


def unknown_labels(segments: DataFrame) -> DataFrame:
    """Labels still unnamed, sorted, with their number."""
    shown = F.coalesce(text.filled("label"), F.lit("Không tên"))
    each = segments.where(labels.is_unknown("label")).select("meeting", shown.alias("label")).distinct()
    return each.groupBy("meeting").agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("labels"),
                                       F.count(F.lit(1)).alias("unknown_count"))


def attendance(segments: DataFrame, roles: DataFrame, employees: DataFrame) -> DataFrame:
    """Numbered attendance list with each person's role: given role, else employee record, else guest or empty."""
    people = distinct_labels(segments, labels.plain_name("label"))
    parts = F.split("label", " - ")
    mailed = F.coalesce(F.contains(F.get(parts, F.lit(1)), F.lit("@")), F.lit(False))
    people = (people.withColumn("name", F.when(mailed, F.trim(F.get(parts, F.lit(0)))).otherwise(F.col("label")))
              .withColumn("stated", F.when(mailed & (F.size(parts) == 3), F.trim(F.get(parts, F.lit(2)))).otherwise("")))
    exact = roles.groupBy(F.col("name").alias("name")).agg(F.max("role").alias("exact_role"))
    low = roles.groupBy(F.lower(F.trim("name")).alias("low")).agg(F.max_by("role", "name").alias("low_role"))
    staff = (employees.groupBy(F.col("employee_name").alias("name"))
             .agg(F.min_by("designation", F.col("employee_name")).alias("staff_role")))
    rows = (people.withColumn("low", F.lower("name")).join(exact, ["name"], "left").join(low, ["low"], "left")
            .join(staff, ["name"], "left"))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    guest = F.col("low").startswith("người lạ")
    given = F.coalesce(filled("exact_role"), filled("low_role"))
    shown = F.when(F.lower("stated") == "thành viên", F.lit("")).otherwise(F.col("stated"))
    role = F.when(guest, F.coalesce(given, F.lit(GUEST))).otherwise(F.coalesce(given, filled("staff_role"), shown))
    return rows.select("meeting", "ord", F.col("name"), role.alias("role"))


def rename_labels(segments: DataFrame, renames: DataFrame) -> DataFrame:
    """Apply label → new label per meeting."""
    new = renames.select("meeting", "label", text.filled("new_label").alias("_new"))
    return (segments.join(new, ["meeting", "label"], "left").withColumn("label", F.coalesce("_new", "label"))
            .select(*segments.columns))


def clear_labels(segments: DataFrame, cleared: DataFrame) -> DataFrame:
    """Empty every label named in ``cleared`` (meeting, label)."""
    gone = cleared.select("meeting", "label").distinct().withColumn("_gone", F.lit(True))
    return (segments.join(gone, ["meeting", "label"], "left")
            .withColumn("label", F.when(F.col("_gone"), F.lit("")).otherwise(F.col("label"))).select(*segments.columns))


def edit_segments(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply delete, insert_after, append and set_text edits, then number the turns again.

    ``edits`` is (meeting, idx, op, value, seq); positions are those before the edits.
    """
    gone = edits.where("op = 'delete'").select("meeting", "idx").distinct()
    texts = edits.where("op = 'set_text'").groupBy("meeting", "idx").agg(F.max_by("value", "seq").alias("_value"))
    kept = (segments.join(gone, ["meeting", "idx"], "left_anti").join(texts, ["meeting", "idx"], "left")
            .select("meeting", F.col("idx").cast("double").alias("_pos"), F.lit(0).cast("long").alias("_seq"), "start", "end", "label",
                    F.coalesce("_value", "text").alias("text")))
    size = segments.groupBy("meeting").agg(F.max("idx").alias("_last"))
    base = segments.select("meeting", "idx", F.col("start").alias("_at"))
    added = (edits.where("op in ('insert_after', 'append')").join(base, ["meeting", "idx"], "left").join(size, ["meeting"])
             .select("meeting", F.when(F.col("op") == "append", F.col("_last") + 1.0).otherwise(F.col("idx") + 0.5).alias("_pos"),
                     F.col("seq").cast("long").alias("_seq"),
                     F.when(F.col("op") == "append", 0.0).otherwise(F.coalesce("_at", F.lit(0.0))).alias("start"))
             .select("meeting", "_pos", "_seq", "start", F.col("start").alias("end"), F.lit(NEW_SPEAKER).alias("label"),
                     F.lit("").alias("text")))
    out = ordered.number_rows(kept.unionByName(added), M, "_pos", ties=("_seq",))
    return out.select("meeting", "idx", "start", "end", "label", "text")


def undo_edits(segments: DataFrame) -> DataFrame:
    """The original rows become the current ones."""
    return segments.select("meeting", "idx", F.col("orig_start").alias("start"), F.col("orig_end").alias("end"),
                           F.col("orig_label").alias("label"), F.col("orig_text").alias("text"))


def save_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Transcript text after edits."""
    return plain_transcript(edit_segments(segments, edits))


def normalize_transcript(segments: DataFrame) -> DataFrame:
    """Per meeting: joined turns, how many were joined, the new text and the labels still unnamed."""
    merged = merge_same_label(segments)
    per = merged.groupBy("meeting").agg(F.count(F.lit(1)).alias("turns"), (F.sum("parts") - F.count(F.lit(1))).alias("merged_count"),
                                        F.coalesce(ordered_join(text.filled("text"), "idx", " "), F.lit("")).alias("transcript"))
    left = unknown_labels(segments)
    return (per.join(left, M, "left").select("meeting", "turns", "merged_count", "transcript",
            F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("unknown_count", F.lit(0)).cast("long").alias("unknown_count")))


def rebuild_from_chunks(segments: DataFrame, named: DataFrame) -> DataFrame:
    """Turns rebuilt from stored chunk segments, with names recovered per (meeting, speaker_id).

    Speakers without a recovered name are numbered by first appearance.
    """
    # Segment order is by start across chunks; ties keep chunk order.
    places = ("start", "chunk", "idx")
    rows = segments.withColumn("start", F.coalesce("start", F.lit(0.0))).withColumn("speaker_id", text.strip(F.coalesce("speaker_id", F.lit(""))))
    names = named.select("meeting", "speaker_id", F.concat(F.lit(labels.ICON), F.col("name")).alias("_name"))
    rows = rows.join(names, ["meeting", "speaker_id"], "left")
    strangers = rows.where(F.col("_name").isNull() & (F.col("speaker_id") != "")).groupBy("meeting", "speaker_id").agg(
        F.min(F.struct(*places)).alias("_p")).select("meeting", "speaker_id", "_p.*")
    numbered = ordered.number_rows(strangers, M, "start", ties=("chunk", "idx"), name="_no", start=1, width=900.0).select("meeting", "speaker_id", "_no")
    rows = rows.join(numbered, ["meeting", "speaker_id"], "left")
    plain = F.coalesce(text.filled("speaker"), F.lit("Speaker"))
    label = F.coalesce("_name", F.concat(F.lit("👤 Speaker "), F.col("_no").cast("string")),
                       F.when(plain.startswith(labels.ICON), plain).otherwise(F.concat(F.lit(labels.ICON), plain)))
    # Slices of start times: a quarter of an hour holds a bounded number of turns.
    return merge_turns(rows.withColumn("label", label), pos="start", ties=("chunk", "idx"), width=900.0)


def stored_turns(chunks: DataFrame, logs: DataFrame) -> DataFrame:
    """Turns of stored chunks (``meeting``, ``chunk_index``, ``raw_segments``) under the names that the meeting's log (``meeting``, ``log``) gives.

    ``idx`` is the place of a turn in its meeting, from 0. Chunks with bad or no JSON give nothing; a meeting without a
    log has numbered strangers only.
    """
    turns = rebuild_from_chunks(tables.explode_segments(chunks, vectors=True), tables.names_from_log(logs))
    placed = ordered.number_rows(turns, M, "start", ties=("chunk", "idx"), name="_place", width=900.0)
    return placed.withColumn("idx", F.col("_place").cast("long")).drop("_place", "chunk")


def rebuild_meetings(chunks: DataFrame, logs: DataFrame) -> DataFrame:
    """What is stored for each meeting, made anew from its chunks: ``raw_results``, ``original_raw_results``, ``transcript``.

    A meeting none of whose chunks holds a usable turn has no row. The turns are worked out once and read twice.
    """
    turns = cut_lineage(stored_turns(chunks, logs))
    return tables.pack_segments(turns).join(plain_transcript(turns), M)
