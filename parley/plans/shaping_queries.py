"""Transcript shaping over the conversation table."""

from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import shaping as M
from ..sources import tables as S
from . import proxies as P
from .proxies import with_ctes
from .registry import query
from .text_queries import quoted

MEANINGFUL = rf"""
cl AS (SELECT *, trim(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\.{{2,}}', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM seg),
kp AS (SELECT *, NOT (c = '' OR regexp_full_match(c, '[^\p{{L}}_\p{{Nl}}\p{{No}}]+') OR (lower(c) IN ({quoted(text.STOCK_PHRASES)}))) AS keep
  FROM (SELECT *, trim(regexp_replace(t, '^\.{{2,}}\s*|\s*\.{{2,}}$', '', 'g')) AS c FROM cl)),
lg AS (SELECT *, lag(keep) OVER w AS pk, lag(label) OVER w AS pl, lag(speaker_id) OVER w AS ps, lag("end") OVER w AS pe FROM kp WINDOW w AS (PARTITION BY meeting ORDER BY idx)),
br AS (SELECT *, CASE WHEN pk AND pl = label AND ps = speaker_id AND start - pe <= 1.5 THEN 0 ELSE 1 END AS b FROM lg WHERE keep),
il AS (SELECT *, sum(b) OVER (PARTITION BY meeting ORDER BY idx) AS g FROM br),
mt AS (SELECT meeting, min(idx) AS idx, arg_min(start, idx) AS start, arg_max("end", idx) AS "end", any_value(label) AS label, any_value(speaker_id) AS speaker_id,
  string_agg(t, ' ' ORDER BY idx) AS text, count(*) AS parts FROM il GROUP BY meeting, g)"""


BY_START = rf"""
cl AS (SELECT *, trim(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\.{{2,}}', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM seg),
kp AS (SELECT *, NOT (c = '' OR regexp_full_match(c, '[^\p{{L}}_\p{{Nl}}\p{{No}}]+') OR (lower(c) IN ({quoted(text.STOCK_PHRASES)}))) AS keep
  FROM (SELECT *, trim(regexp_replace(t, '^\.{{2,}}\s*|\s*\.{{2,}}$', '', 'g')) AS c FROM cl)),
lg AS (SELECT *, lag(keep) OVER w AS pk, lag(label) OVER w AS pl, lag(speaker_id) OVER w AS ps, lag("end") OVER w AS pe FROM kp WINDOW w AS (PARTITION BY meeting ORDER BY start, idx)),
br AS (SELECT *, CASE WHEN pk AND pl = label AND ps = speaker_id AND start - pe <= 1.5 THEN 0 ELSE 1 END AS b FROM lg WHERE keep),
il AS (SELECT *, sum(b) OVER (PARTITION BY meeting ORDER BY start, idx) AS g FROM br),
mt AS (SELECT meeting, arg_min(idx, (start, idx)) AS idx, min(start) AS start, arg_max("end", (start, idx)) AS "end", any_value(label) AS label, any_value(speaker_id) AS speaker_id,
  string_agg(t, ' ' ORDER BY start, idx) AS text, count(*) AS parts FROM il GROUP BY meeting, g)"""


@query("meeting_transcripts", with_ctes("seg") + "," + MEANINGFUL + """,
tr AS (SELECT meeting, string_agg(trim(text), ' ' ORDER BY idx) AS transcript, count(*) AS turns FROM mt GROUP BY meeting),
lb AS (SELECT meeting, label, count(*) AS n, label LIKE '%Speaker%' AS u FROM mt WHERE label <> '' GROUP BY ALL)
SELECT meeting, turns, transcript, known_count, unknown_group_count, unknown_segments FROM tr JOIN (
  SELECT meeting, count(*) FILTER (NOT u) AS known_count, count(*) FILTER (u) AS unknown_group_count, CAST(coalesce(sum(n) FILTER (u), 0) AS BIGINT) AS unknown_segments FROM lb GROUP BY meeting) USING (meeting)""")
def transcripts(spark, sf):
    """Cleaned and merged turns as one transcript per meeting, with its speaker counts."""
    merged = M.merge_turns(P.segments(spark, sf)).select("meeting", "idx", "label", "text")
    said = merged.groupBy("meeting").agg(F.count(F.lit(1)).alias("turns"), M.ordered_join(text.filled("text"), "idx", " ").alias("transcript"))
    return said.join(M.speaker_counts(merged), "meeting")


@query("merge_turns", with_ctes("seg") + "," + MEANINGFUL + " SELECT * FROM mt")
def _(spark, sf):
    return M.merge_turns(P.segments(spark, sf)).select("meeting", "idx", "start", "end", "label", "speaker_id", "text", "parts")


SAME = """
sl AS (SELECT *, lag(label) OVER (PARTITION BY meeting ORDER BY idx) AS pl FROM seg),
si AS (SELECT *, sum(CASE WHEN label = '' OR pl IS NULL OR pl <> label THEN 1 ELSE 0 END) OVER (PARTITION BY meeting ORDER BY idx) AS g FROM sl),
sg AS (SELECT meeting, min(idx) AS idx, arg_min(start, idx) AS start, arg_max("end", idx) AS "end", any_value(label) AS label, count(*) AS parts,
  coalesce(string_agg(CASE WHEN regexp_matches(trim(text, E' \\t\\n\\r'), '^[,.;:!?)\\]}]') AND idx > fi THEN '' WHEN idx = fi THEN '' ELSE ' ' END || trim(text, E' \\t\\n\\r'), '' ORDER BY idx), '') AS text,
  CASE WHEN count(DISTINCT speaker) = 1 THEN any_value(speaker) ELSE any_value(label) END AS raw_speaker,
  CASE WHEN count(DISTINCT speaker_id) = 1 THEN any_value(speaker_id) ELSE '' END AS speaker_id, CASE WHEN count(DISTINCT chunk) = 1 THEN CAST(any_value(chunk) AS VARCHAR) ELSE '' END AS chunk
  FROM (SELECT *, min(CASE WHEN trim(text, E' \\t\\n\\r') <> '' THEN idx END) OVER (PARTITION BY meeting, g) AS fi FROM si WHERE TRUE) GROUP BY meeting, g)"""


@query("merge_same_label", with_ctes("seg") + "," + SAME + " SELECT * FROM sg")
def _(spark, sf):
    return M.merge_same_label(P.segments(spark, sf)).select("meeting", "idx", "start", "end", "label", "parts", "text", "raw_speaker", "speaker_id", "chunk")


@query("collapse_short_strangers", with_ctes("seg") + """,
it AS (SELECT meeting, idx, start, "end", CASE WHEN idx % 5 = 3 THEN '👤 Speaker ' || idx ELSE label END AS label, speaker_id, text FROM seg),
tt AS (SELECT meeting, label, sum(greatest(0, "end" - start)) AS d, count(*) AS n FROM it GROUP BY ALL),
rw AS (SELECT it.*, label LIKE '👤 Speaker%' AND (d <= 3.0 OR (d <= 8.0 AND n <= 3)) AS short FROM it JOIN tt USING (meeting, label)),
nb AS (SELECT *, last_value(CASE WHEN NOT short THEN {'l': label, 's': start, 'e': "end"} END IGNORE NULLS) OVER (PARTITION BY meeting ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lf,
  first_value(CASE WHEN NOT short THEN {'l': label, 's': start, 'e': "end"} END IGNORE NULLS) OVER (PARTITION BY meeting ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rt FROM rw),
ch AS (SELECT *, CASE WHEN lf IS NOT NULL AND (rt IS NULL OR abs(start - coalesce(nullif(lf.e, 0), lf.s)) <= abs(rt.s - coalesce(nullif("end", 0), start))) THEN lf.l ELSE rt.l END AS dest FROM nb),
mp AS (SELECT meeting, label, arg_max(dest, idx) AS dest FROM ch WHERE short AND dest <> '' GROUP BY ALL),
nw AS (SELECT it.meeting, idx, start, "end", coalesce(mp.dest, it.label) AS label, speaker_id, text FROM it LEFT JOIN mp USING (meeting, label)),
lg AS (SELECT *, lag(label) OVER w AS pl, lag(speaker_id) OVER w AS ps, lag("end") OVER w AS pe FROM nw WINDOW w AS (PARTITION BY meeting ORDER BY idx)),
gr AS (SELECT *, sum(CASE WHEN pl = label AND ps = speaker_id AND start - pe <= 1.5 THEN 0 ELSE 1 END) OVER (PARTITION BY meeting ORDER BY idx) AS g FROM lg)
SELECT meeting, min(idx) AS idx, arg_min(start, idx) AS start, arg_max("end", idx) AS "end", any_value(label) AS label, any_value(speaker_id) AS speaker_id,
  string_agg(text, ' ' ORDER BY idx) AS text, count(*) AS parts FROM gr GROUP BY meeting, g""")
def _(spark, sf):
    seg = P.segments(spark, sf).withColumn("label", F.when(F.col("idx") % 5 == 3, F.concat(F.lit("👤 Speaker "), F.col("idx").cast("string"))).otherwise(F.col("label")))
    return M.collapse_short_strangers(seg).select("meeting", "idx", "start", "end", "label", "speaker_id", "text", "parts")


@query("renumber_strangers", with_ctes("seg") + """,
f AS (SELECT meeting, label, row_number() OVER (PARTITION BY meeting ORDER BY min(idx)) AS n FROM seg WHERE regexp_full_match(label, '👤 (Speaker|Người lạ) \\d+') GROUP BY meeting, label)
SELECT seg.meeting, seg.idx, CASE WHEN n IS NULL THEN seg.label ELSE '👤 Speaker ' || n END AS label FROM seg LEFT JOIN f USING (meeting, label)""")
def _(spark, sf):
    return M.renumber_strangers(P.segments(spark, sf)).select("meeting", "idx", "label")


@query("render_transcript", with_ctes("seg") + """,
p AS (SELECT *, lag(label) OVER (PARTITION BY meeting ORDER BY idx) AS pl FROM seg)
SELECT meeting, trim(string_agg(CASE WHEN pl = label THEN ' ' ELSE E'\\n**' || label || '** [' || printf('%.1f', start) || E's]\\n' END || text, '' ORDER BY idx), E' \\n\\t\\r') AS transcript FROM p GROUP BY meeting""")
def _(spark, sf):
    return M.render_transcript(P.segments(spark, sf).select("meeting", "idx", "label", "start", "text"))


@query("plain_transcript", with_ctes("seg") + " SELECT meeting, string_agg(trim(text, E' \\n\\t\\r'), ' ' ORDER BY idx) FILTER (trim(text, E' \\n\\t\\r') <> '') AS transcript FROM seg GROUP BY meeting")
def _(spark, sf):
    return M.plain_transcript(P.segments(spark, sf))


@query("markdown_minutes", with_ctes("seg", "meet") + """,
t AS (SELECT meeting, string_agg('**' || coalesce(nullif(label, ''), '?') || '**: ' || text, E'\\n' ORDER BY idx) AS turns, count(*) AS n FROM seg GROUP BY meeting),
k AS (SELECT CAST(conv_id AS VARCHAR) AS meeting, string_agg('- ' || role, E'\\n' ORDER BY turn) AS todo, count(*) AS k FROM conversations WHERE role <> 'user' GROUP BY ALL)
SELECT m.meeting, concat_ws(E'\\n', '# ' || title || E'\\n', '- Mã: ' || m.meeting, '- Ngày: ' || strftime(creation, '%Y-%m-%d %H:%M:%S'), '- Trạng thái: ' || status || E'\\n',
  '## Tóm tắt' || E'\\n' || nullif(meeting_summary, '') || E'\\n', '## Kết luận' || E'\\n' || nullif(conclusion, '') || E'\\n', '## Nội dung chi tiết (' || n || ' lượt nói)', turns,
  E'\\n## Danh sách task (' || k || E')\\n' || todo) AS minutes
FROM meet m LEFT JOIN t USING (meeting) LEFT JOIN k USING (meeting)""")
def _(spark, sf):
    c = P.table(spark, sf, "conversations")
    todo = c.where("role <> 'user'").select(F.col("conv_id").cast("string").alias("meeting"), F.col("turn").alias("item_id"), F.col("role").alias("title"))
    seg = P.segments(spark, sf).drop("speaker").withColumnRenamed("label", "speaker")
    return M.markdown_minutes(P.meetings(spark, sf), seg, todo)


@query("speaker_counts", with_ctes("seg") + """,
l AS (SELECT meeting, label, count(*) AS n, label LIKE '%Speaker%' AS u FROM seg WHERE label <> '' GROUP BY ALL)
SELECT meeting, count(*) FILTER (NOT u) AS known_count, count(*) FILTER (u) AS unknown_group_count, CAST(coalesce(sum(n) FILTER (u), 0) AS BIGINT) AS unknown_segments FROM l GROUP BY meeting""")
def _(spark, sf):
    return M.speaker_counts(P.segments(spark, sf))


@query("distinct_labels", with_ctes("seg") + " SELECT meeting, label, min(idx) AS first_idx, row_number() OVER (PARTITION BY meeting ORDER BY min(idx)) AS ord FROM seg WHERE label <> '' GROUP BY meeting, label")
def _(spark, sf):
    return M.distinct_labels(P.segments(spark, sf))


@query("unknown_labels", with_ctes("seg") + """
SELECT meeting, string_agg(l, ', ' ORDER BY l) AS labels, count(*) AS unknown_count FROM (
  SELECT DISTINCT meeting, CASE WHEN label = '' THEN 'Không tên' ELSE label END AS l FROM seg WHERE label = '' OR label LIKE '%Speaker%') GROUP BY meeting""")
def _(spark, sf):
    return M.unknown_labels(P.segments(spark, sf))


@query("attendance", with_ctes("seg") + """,
n AS (SELECT meeting, idx, trim(regexp_replace(replace(label, '👤', ''), '\\(.*?\\)', '', 'g')) AS name FROM seg),
d AS (SELECT meeting, name, row_number() OVER (PARTITION BY meeting ORDER BY min(idx)) AS ord FROM n WHERE name <> '' GROUP BY meeting, name)
SELECT meeting, ord, name, CASE name WHEN 'Nguyễn An' THEN 'Trưởng phòng' WHEN 'Trần Bình' THEN 'Kế toán' ELSE '' END AS role FROM d""")
def _(spark, sf):
    region = P.table(spark, sf, "region")
    roles = region.select(F.when(F.col("r_regionkey") == 0, "nguyễn an").otherwise(F.col("r_name")).alias("name"), F.lit("Trưởng phòng").alias("role"))
    staff = region.select(F.when(F.col("r_regionkey") == 1, "Trần Bình").otherwise(F.col("r_name")).alias("employee_name"), F.lit("Kế toán").alias("designation"))
    return M.attendance(P.segments(spark, sf), roles, staff)


@query("rename_labels", with_ctes("seg") + " SELECT meeting, idx, CASE WHEN label = '👤 Speaker 1' THEN 'Lê Chi' ELSE label END AS label FROM seg")
def _(spark, sf):
    seg = P.segments(spark, sf)
    new = seg.select("meeting", F.lit("👤 Speaker 1").alias("label"), F.lit(" Lê Chi ").alias("new_label")).distinct()
    return M.rename_labels(seg, new).select("meeting", "idx", "label")


@query("clear_labels", with_ctes("seg") + " SELECT meeting, idx, CASE WHEN label = '👤 Speaker 2' THEN '' ELSE label END AS label FROM seg")
def _(spark, sf):
    seg = P.segments(spark, sf)
    return M.clear_labels(seg, seg.select("meeting", F.lit("👤 Speaker 2").alias("label"))).select("meeting", "idx", "label")


def sample_edits(seg):
    """Edits derived from the turns: every seventh deleted, every fifth followed by a new one, every sixth rewritten, one appended."""
    kind = F.array_compact(F.array(F.when(F.col("idx") % 7 == 3, "delete"), F.when(F.col("idx") % 5 == 1, "insert_after"),
                                   F.when(F.col("idx") % 6 == 2, "set_text"), F.when(F.col("idx") == 0, "append")))
    return seg.select("meeting", "idx", F.explode(kind).alias("op"), F.lit("sửa").alias("value"), F.col("idx").alias("seq"))


EDITED = """
ed AS (SELECT meeting, idx AS pos, 0 AS seq, start, "end", label, CASE WHEN idx % 6 = 2 THEN 'sửa' ELSE text END AS text FROM seg WHERE idx % 7 <> 3
  UNION ALL SELECT meeting, idx + 0.5, idx, start, start, 'Người lạ (mới)', '' FROM seg WHERE idx % 5 = 1
  UNION ALL SELECT meeting, max(idx) + 1, 0 AS seq, 0, 0, 'Người lạ (mới)', '' FROM seg GROUP BY meeting),
en AS (SELECT meeting, row_number() OVER (PARTITION BY meeting ORDER BY pos, seq) - 1 AS idx, start, "end", label, text FROM ed)"""


@query("edit_segments", with_ctes("seg") + "," + EDITED + " SELECT * FROM en")
def _(spark, sf):
    seg = P.segments(spark, sf)
    return M.edit_segments(seg, sample_edits(seg))


@query("save_edits", with_ctes("seg") + "," + EDITED + " SELECT meeting, string_agg(trim(text, E' \\n\\t\\r'), ' ' ORDER BY idx) FILTER (trim(text, E' \\n\\t\\r') <> '') AS transcript FROM en GROUP BY meeting")
def _(spark, sf):
    seg = P.segments(spark, sf)
    return M.save_edits(seg, sample_edits(seg))


@query("undo_edits", with_ctes("seg") + ' SELECT meeting, idx, start, "end", speaker AS label, text FROM seg')
def _(spark, sf):
    seg = P.segments(spark, sf)
    return M.undo_edits(seg.select("meeting", "idx", F.col("start").alias("orig_start"), F.col("end").alias("orig_end"), F.col("speaker").alias("orig_label"), F.col("text").alias("orig_text")))


@query("normalize_transcript", with_ctes("seg") + "," + SAME + """,
u AS (SELECT meeting, string_agg(l, ', ' ORDER BY l) AS labels, count(*) AS unknown_count FROM (
  SELECT DISTINCT meeting, CASE WHEN label = '' THEN 'Không tên' ELSE label END AS l FROM seg WHERE label = '' OR label LIKE '%Speaker%') GROUP BY meeting)
SELECT meeting, count(*) AS turns, CAST(sum(parts) AS BIGINT) - count(*) AS merged_count, string_agg(text, ' ' ORDER BY idx) FILTER (text <> '') AS transcript,
  coalesce(any_value(labels), '') AS labels, coalesce(any_value(unknown_count), 0) AS unknown_count FROM sg LEFT JOIN u USING (meeting) GROUP BY meeting""")
def _(spark, sf):
    return M.normalize_transcript(P.segments(spark, sf).select("meeting", "idx", "start", "end", "label", "speaker", "text"))


@query("rebuild_from_chunks", with_ctes("seg") + """,
nn AS (SELECT meeting, speaker_id, row_number() OVER (PARTITION BY meeting ORDER BY min((start, idx))) AS no FROM seg WHERE speaker <> 'Speaker 1' GROUP BY meeting, speaker_id),
seg_ AS (SELECT seg.* EXCLUDE (label), CASE WHEN speaker = 'Speaker 1' THEN '👤 Lê Chi' ELSE '👤 Speaker ' || no END AS label FROM seg LEFT JOIN nn USING (meeting, speaker_id)),""" +
       BY_START.replace("FROM seg)", "FROM seg_)") + ' SELECT * FROM mt')
def _(spark, sf):
    seg = P.segments(spark, sf)
    named = seg.where("speaker = 'Speaker 1'").select("meeting", "speaker_id", F.lit("Lê Chi").alias("name")).distinct()
    return M.rebuild_from_chunks(seg.drop("label"), named).select("meeting", "idx", "start", "end", "label", "speaker_id", "text", "parts")


# Stored chunks, every ninth broken, and a log that names the first speaker of some chunks.
STORED = with_ctes("seg") + """,
ok AS (SELECT * FROM seg WHERE (conv_id + chunk) % 9 <> 4),
lg_ AS (SELECT CAST(conv_id AS VARCHAR) AS meeting, 'c' || turn % 3 || '_speaker_1' AS speaker_id, arg_max(role || turn, turn) AS name FROM conversations WHERE turn % 4 <> 2 GROUP BY ALL),
nn AS (SELECT meeting, speaker_id, row_number() OVER (PARTITION BY meeting ORDER BY min((start, idx))) AS no FROM ok ANTI JOIN lg_ USING (meeting, speaker_id) GROUP BY meeting, speaker_id),
seg_ AS (SELECT ok.* EXCLUDE (label), '👤 ' || coalesce(lg_.name, 'Speaker ' || nn.no) AS label FROM ok LEFT JOIN lg_ USING (meeting, speaker_id) LEFT JOIN nn USING (meeting, speaker_id)),""" + BY_START.replace("FROM seg)", "FROM seg_)")


@query("rebuild_stored_turns", STORED + ' SELECT meeting, row_number() OVER (PARTITION BY meeting ORDER BY start, idx) - 1 AS place, start, "end", label, speaker_id, text FROM mt')
def _(spark, sf):
    done = M.rebuild_meetings(P.chunk_payloads(spark, sf), P.speaker_logs(spark, sf))
    kept = F.from_json("original_raw_results", "array<struct<start:double,end:double,speaker:string,text:string,speaker_id:string>>")
    return done.select("meeting", F.posexplode(kept).alias("i", "t")).select(
        "meeting", F.col("i").cast("long").alias("place"), "t.start", "t.end", F.col("t.speaker").alias("label"), "t.speaker_id", "t.text")


@query("rebuild_stored_meetings", STORED + " SELECT meeting, count(*) AS turns, string_agg(trim(text), ' ' ORDER BY start, idx) AS transcript FROM mt GROUP BY meeting")
def _(spark, sf):
    done = M.rebuild_meetings(P.chunk_payloads(spark, sf), P.speaker_logs(spark, sf))
    return done.select("meeting", F.size(F.from_json("raw_results", "array<array<string>>")).cast("long").alias("turns"), "transcript")


# -- sources and sinks -----------------------------------------------------------------------------

@query("explode_chunk_segments", with_ctes("seg") + ', x AS (SELECT *, (conv_id + chunk) % 9 = 4 AS broken, row_number() OVER (PARTITION BY meeting, chunk ORDER BY idx) - 1 AS i FROM seg) SELECT meeting, chunk, i AS idx, start, "end", speaker, speaker_id, text FROM x WHERE NOT broken')
def _(spark, sf):
    return S.explode_segments(P.chunk_payloads(spark, sf)).select("meeting", "chunk", F.col("idx").cast("long"), "start", "end", "speaker", "speaker_id", "text")


@query("chunk_words_from_json", with_ctes("wrd") + ' SELECT meeting, chunk, row_number() OVER (PARTITION BY meeting, chunk ORDER BY idx, word_idx) - 1 AS word_idx, text, start, "end", speaker_id FROM wrd')
def _(spark, sf):
    from ..operators import timeline as L
    w = L.segments_to_words(P.segments(spark, sf))
    item = F.struct("idx", "word_idx", F.struct("text", "start", "end", "speaker_id").alias("w"))
    packed = w.groupBy("meeting", F.col("chunk").alias("chunk_index")).agg(
        F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["w"]).alias("raw_words"))).alias("raw_segments"))
    return S.explode_words(packed).withColumn("word_idx", F.col("word_idx").cast("long"))


@query("mixed_segment_rows", with_ctes("seg") + ' SELECT meeting, row_number() OVER (PARTITION BY meeting ORDER BY idx) - 1 AS idx, start, "end", label AS speaker, text FROM seg')
def _(spark, sf):
    seg = P.segments(spark, sf)
    as_list = F.to_json(F.array(F.col("start").cast("string"), F.col("end").cast("string"), "label", "text"))
    as_dict = F.to_json(F.struct("start", "end", F.col("label").alias("speaker"), "text"))
    row = F.struct("idx", F.when(F.col("idx") % 2 == 0, as_list).otherwise(as_dict).alias("j"))
    body = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["j"]), ","), F.lit("]"))
    return S.read_mixed_rows(seg.groupBy("meeting").agg(body.alias("raw_results")))


@query("pack_segments", with_ctes("seg") + """ SELECT meeting, row_number() OVER (PARTITION BY meeting ORDER BY idx) - 1 AS place, start, "end", label, text, speaker_id, round(start + "end", 6) AS vector_sum FROM seg""")
def _(spark, sf):
    packed = S.pack_segments(P.segments(spark, sf).withColumn("embedding", F.array("start", "end")))
    shown = F.from_json("raw_results", "array<array<string>>")
    orig = F.from_json("original_raw_results", "array<struct<start:double,end:double,speaker:string,text:string,embedding:array<double>,speaker_id:string>>")
    both = packed.select("meeting", F.posexplode(F.arrays_zip(shown.alias("s"), orig.alias("o"))).alias("i", "z"))
    # the display row gives times, label and text, the original row the id and the vector
    return both.select("meeting", F.col("i").cast("long").alias("place"), F.get("z.s", F.lit(0)).cast("double").alias("start"), F.get("z.s", F.lit(1)).cast("double").alias("end"),
                       F.get("z.s", F.lit(2)).alias("label"), F.get("z.s", F.lit(3)).alias("text"), "z.o.speaker_id",
                       F.round(F.get("z.o.embedding", F.lit(0)) + F.get("z.o.embedding", F.lit(1)), 6).alias("vector_sum"))


@query("append_log", with_ctes("meet") + """,
n AS (SELECT CAST(conv_id AS VARCHAR) AS doc, string_agg('[' || strftime(creation, '%Y-%m-%d %H:%M:%S') || '] ' || trim(role), E'\\n' ORDER BY turn) AS new FROM conversations JOIN meet USING (conv_id) GROUP BY ALL)
SELECT meeting AS doc, right(trim(rtrim(title, E' \\n\\t\\r') || E'\\n' || new, E' \\n\\t\\r'), 300) AS log FROM meet JOIN n ON n.doc = meeting""")
def _(spark, sf):
    m = P.meetings(spark, sf)
    lines = P.table(spark, sf, "conversations").join(m.select("conv_id", F.col("date").alias("ts")), "conv_id").select(
        F.col("conv_id").cast("string").alias("doc"), F.col("turn").alias("seq"), F.concat(F.lit(" "), "role").alias("line"), "ts")
    return S.append_log(m.select(F.col("meeting").alias("doc"), F.col("title").alias("log")), lines, max_chars=300)


@query("names_from_log", """
SELECT CAST(conv_id AS VARCHAR) AS meeting, 'c' || turn % 3 || '_speaker_1' AS speaker_id, arg_max(role || turn, turn) AS name FROM conversations WHERE turn % 4 <> 2 GROUP BY ALL""")
def _(spark, sf):
    return S.names_from_log(P.speaker_logs(spark, sf))


@query("parse_model_lines", with_ctes("seg") + r"""
SELECT meeting, chunk, speaker, trim(regexp_replace(replace(text, '*', ''), '\s+', ' ', 'g')) AS text, CAST(start_ms // 1000 AS DOUBLE) AS start FROM seg WHERE regexp_matches(text, '[^\s*]')""")
def _(spark, sf):
    seg = P.segments(spark, sf)
    sec = F.floor(F.col("start")).cast("long")
    line = F.concat(F.when(F.col("idx") % 2 == 0, "- **").otherwise(""), F.lit("["), F.floor(sec / 60).cast("string"), F.lit(":"), F.lpad((sec % 60).cast("string"), 2, "0"), F.lit("] "),
                    "speaker", F.lit(": "), text.squish("text"))
    body = F.concat(F.lit("```text\nhello\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("l")))), lambda x: x["l"]), "\n"), F.lit("\n```"))
    return S.parse_model_lines(seg.groupBy("meeting", "chunk").agg(body.alias("answer"))).select("meeting", "chunk", "speaker", "text", "start")


@query("skipped_model_lines", "SELECT CAST(conv_id AS VARCHAR) AS meeting, turn AS chunk, CAST(len(list_filter(string_split(text, E'\\n'), lambda x: trim(x) <> '')) AS BIGINT) AS skipped FROM conversations")
def _(spark, sf):
    c = P.table(spark, sf, "conversations")
    return S.skipped_model_lines(c.select(F.col("conv_id").cast("string").alias("meeting"), F.col("turn").alias("chunk"), F.concat(F.lit("Speaker 1: xin chào\n"), "text").alias("answer")))


@query("meeting_history", with_ctes("meet") + " SELECT meeting, title, creation AS date, status, audio_file, creation AS modified FROM meet")
def _(spark, sf):
    return S.history(P.meetings(spark, sf))


@query("latest_meeting", with_ctes("meet") + " SELECT meeting, title FROM meet ORDER BY creation DESC, meeting LIMIT 1")
def _(spark, sf):
    return S.latest(P.meetings(spark, sf)).select("meeting", "title")


@query("chunks_of_meeting", with_ctes("chunk_t") + " SELECT chunk_index, status, stt_total_tokens FROM chunk_t WHERE meeting = '7'")
def _(spark, sf):
    return S.chunks_of(P.chunks(spark, sf), "7").select("chunk_index", "status", "stt_total_tokens")


@query("employees_from_users", "SELECT CAST(c_custkey AS VARCHAR) AS name, c_name AS employee_name, CASE WHEN c_custkey % 3 = 0 THEN c_name || '@x.vn' ELSE CAST(c_custkey AS VARCHAR) END AS user_id FROM customer WHERE c_custkey % 3 = 0")
def _(spark, sf):
    c = P.table(spark, sf, "customer")
    return S.employees_from_users(c.select(F.col("c_custkey").cast("string").alias("name"), F.col("c_name").alias("full_name"),
                                           F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("@x.vn"))).when(F.col("c_custkey") % 3 == 1, "").alias("email")))


@query("remote_roster", "SELECT c_name || '@x.vn' AS name, c_name AS employee_name, c_name || '@x.vn' AS user_id, c_mktsegment AS designation FROM customer WHERE c_nationkey % 4 <> 0")
def _(spark, sf):
    c = P.table(spark, sf, "customer")
    return S.remote_roster(c.select(F.when(F.col("c_nationkey") % 4 != 0, F.concat(F.lit(" "), "c_name", F.lit("@x.vn"))).alias("email"), F.col("c_name").alias("full_name"),
                                    F.concat("c_mktsegment", F.lit("  ")).alias("job_title")))


@query("local_roster", with_ctes("gal") + """,
u AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'voice_' || (c_custkey % 10) || '_1@x.vn' ELSE c_name END AS key, c_name, c_custkey FROM customer WHERE c_custkey % 7 <> 0 AND c_mktsegment <> 'MACHINERY'),
uf AS (SELECT key, arg_min(c_name, c_name) AS employee_name FROM u GROUP BY key)
SELECT key AS name, employee_name, key AS user_id, 'System User' AS designation FROM uf
UNION ALL SELECT k, name, CASE WHEN email = 'Chưa cập nhật' THEN '' ELSE email END, 'Voice Speaker' FROM (SELECT *, CASE WHEN email = 'Chưa cập nhật' THEN name ELSE email END AS k FROM gal) WHERE k NOT IN (SELECT key FROM uf)""")
def _(spark, sf):
    from ..operators import voices
    c = P.table(spark, sf, "customer")
    mail = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("voice_"), (F.col("c_custkey") % 10).cast("string"), F.lit("_1@x.vn")))
    users = c.select(F.col("c_name").alias("name"), mail.alias("email"), F.col("c_name").alias("full_name"), F.when(F.col("c_custkey") % 7 == 0, 0).otherwise(1).alias("enabled"),
                     F.when(F.col("c_mktsegment") == "MACHINERY", "Website User").otherwise("System User").alias("user_type"))
    g = P.gallery(spark, sf).select("name", "email")
    return S.local_roster(users, g, voices.alias_table(g))


@query("task_sheet", with_ctes("task_t") + ' SELECT batch, title AS "Tên nhiệm vụ", project AS "Dự án", description AS "Mô tả chi tiết" FROM task_t')
def _(spark, sf):
    t = P.tasks(spark, sf).select("batch", "title", "project", "description", F.col("assignee_hr_code").alias("assignee"))
    return S.task_sheet(t)


@query("speakers_without_null_names", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 4 THEN NULL ELSE c_name END AS name FROM customer WHERE c_custkey % 9 <> 2")
def _(spark, sf):
    c = P.table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 9 == 2, "null").when(F.col("c_custkey") % 9 != 4, F.col("c_name"))
    return S.without_null_names(c.select("c_custkey", name.alias("name")))
