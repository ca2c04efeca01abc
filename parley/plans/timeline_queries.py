"""Time work over the conversation and frame tables."""

from pyspark.sql import functions as F

from .. import ordered
from ..functions import labels, text
from ..operators import timeline as L
from . import proxies as P
from .proxies import with_ctes
from .registry import query


def d2(x: str) -> str:
    """Two places, as the engine rounds."""
    return f"CAST(printf('%.2f', {x}) AS DOUBLE)"


@query("complete_starts", with_ctes("loc") + f""",
d AS (SELECT meeting, chunk, max("end") AS duration FROM loc GROUP BY ALL),
m AS (SELECT *, lag(start) OVER (PARTITION BY meeting, chunk ORDER BY idx) AS before FROM loc JOIN d USING (meeting, chunk)),
ok AS (SELECT meeting, chunk FROM m GROUP BY ALL HAVING NOT bool_or(start < 0 OR start > duration + 1 OR coalesce(start + 0.15::DOUBLE < before, FALSE))
  AND NOT (count(*) >= 4 AND count(DISTINCT printf('%.1f', start)) < greatest(2, count(*) // 5))),
nx AS (SELECT a.meeting, a.chunk, a.idx, arg_min(b.start, b.idx) AS nxt FROM loc a JOIN loc b ON a.meeting = b.meeting AND a.chunk = b.chunk AND b.idx > a.idx
  AND b.start > a.start + 0.05::DOUBLE GROUP BY ALL),
ov AS (SELECT DISTINCT a.meeting, a.idx FROM loc a JOIN loc b ON a.meeting = b.meeting AND a.chunk = b.chunk AND a.idx <> b.idx AND abs(a.start - b.start) <= 0.05::DOUBLE)
SELECT m.meeting, m.chunk, m.idx, {d2('least(duration, greatest(0, start))')} AS start, {d2('least(duration, greatest(start, coalesce(nxt, duration)))')} AS "end",
  ov.idx IS NOT NULL AS timestamp_overlap
FROM m JOIN ok USING (meeting, chunk) LEFT JOIN nx USING (meeting, chunk, idx) LEFT JOIN ov ON ov.meeting = m.meeting AND ov.idx = m.idx""")
def _(spark, sf):
    seg = P.local_segments(P.segments(spark, sf))
    return L.complete_starts(seg.drop("end"), P.durations(seg)).select("meeting", "chunk", "idx", "start", "end", "timestamp_overlap")


@query("timeline_errors", with_ctes("loc") + r""",
d AS (SELECT meeting, chunk, max("end") * 0.9::DOUBLE AS duration FROM loc GROUP BY ALL),
r AS (SELECT *, "end" - start AS len, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words FROM loc JOIN d USING (meeting, chunk)),
e AS (SELECT meeting, chunk, idx, unnest(list_filter([CASE WHEN start < -0.25 OR "end" > duration + 1 THEN 'out_of_chunk' END,
    CASE WHEN words > 0 AND len <= 0 THEN 'no_time' END, CASE WHEN words > 0 AND len > greatest(45, duration * 0.22::DOUBLE) THEN 'too_long' END,
    CASE WHEN words >= 8 AND len >= 15 AND words / len < 0.45 THEN 'stretched' END], lambda x: x IS NOT NULL)) AS reason FROM r),
c AS (SELECT meeting, chunk, count(*) FILTER (duration > 0 AND "end" >= duration - 0.15::DOUBLE) AS tail,
    arg_max(duration > 0 AND "end" >= duration - 0.15::DOUBLE AND len <= 0.15 AND words >= 5, idx) AS squeezed FROM r GROUP BY ALL)
SELECT meeting, chunk, idx, reason FROM e UNION ALL SELECT meeting, chunk, NULL, 'tail_pile' FROM c WHERE tail >= 2 UNION ALL SELECT meeting, chunk, NULL, 'empty_last' FROM c WHERE squeezed""")
def _(spark, sf):
    counted = P.segments(spark, sf).withColumn("words", text.word_count("text")).select("meeting", "chunk", "idx", "start", "end", "words")
    seg = P.local_segments(counted)
    short = P.durations(seg).withColumn("duration", F.col("duration") * 0.9)
    return L.timeline_errors(seg, short)


@query("speech_intervals", with_ctes("frm") + """,
s AS (SELECT *, lag((frame_idx + 1) * 30 / 1000.0::DOUBLE) OVER (PARTITION BY file ORDER BY frame_idx) AS before FROM frm WHERE is_speech),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR frame_idx * 30 / 1000.0::DOUBLE - before > 0.03::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY frame_idx) AS g FROM s),
r AS (SELECT file, g, min(frame_idx) AS ord, min(frame_idx) * 30 / 1000.0::DOUBLE AS start, max(frame_idx) AS last FROM i GROUP BY ALL)
SELECT file, ord, start, "end" FROM (
  SELECT frd.file, coalesce(ord, 0) AS ord, coalesce(start, 0) AS start, CASE WHEN last IS NULL OR last = final THEN duration ELSE (last + 1) * 30 / 1000.0::DOUBLE END AS "end"
  FROM frd LEFT JOIN r USING (file))""")
def _(spark, sf):
    fr = P.frames(spark, sf)
    return L.speech_intervals(fr, P.frame_durations(fr), join_gap=0.03)


@query("retime_by_speech", with_ctes("spk") + f""",
sc AS (SELECT s.meeting, seg.chunk, s.ord, s.start, s."end", s."end" - s.start AS len FROM spk s JOIN seg ON seg.meeting = s.meeting AND seg.idx = s.ord),
t AS (SELECT *, sum(len) OVER (PARTITION BY meeting, chunk ORDER BY ord) AS clock, sum(len) OVER (PARTITION BY meeting, chunk ORDER BY ord) - len AS from_ FROM sc),
w AS (SELECT *, greatest(1, len(list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> ''))) AS wt FROM seg),
a AS (SELECT *, sum(wt) OVER (PARTITION BY meeting, chunk ORDER BY idx) AS upto, sum(wt) OVER (PARTITION BY meeting, chunk) AS total, lead(speaker) OVER (PARTITION BY meeting, chunk ORDER BY idx) AS nxt FROM w),
b AS (SELECT a.*, sp.speech, sp.fin, sp.speech * (upto - wt) / total AS c0, sp.speech * upto / total AS c1 FROM a
  LEFT JOIN (SELECT meeting, chunk, sum(len) AS speech, arg_max("end", ord) AS fin FROM sc GROUP BY ALL) sp USING (meeting, chunk)),
c AS (SELECT meeting, chunk, idx, start, "end", speech, fin, c0, CASE WHEN nxt IS NOT NULL AND nxt <> speaker THEN greatest(c0, c1 - 0.15::DOUBLE) ELSE c1 END AS c1 FROM b),
h AS (SELECT c.meeting, c.idx, arg_min(t.start + (c0 - t.from_), t.ord) FILTER (t.clock >= c0) AS h0, arg_min(t.start + (c1 - t.from_), t.ord) FILTER (t.clock >= c1) AS h1
  FROM c JOIN t USING (meeting, chunk) GROUP BY ALL)
SELECT meeting, idx, CAST(printf('%.2f', CASE WHEN speech IS NULL THEN start ELSE coalesce(h0, fin) END) AS DOUBLE) AS start, CAST(printf('%.2f', CASE WHEN speech IS NULL THEN "end" ELSE coalesce(h1, fin) END) AS DOUBLE) AS "end"
FROM c LEFT JOIN h USING (meeting, idx)""")
def _(spark, sf):
    seg = P.segments(spark, sf)
    talk = P.speech(seg).join(seg.select("meeting", F.col("idx").alias("ord"), "chunk"), ["meeting", "ord"])
    return L.retime_by_speech(seg, talk).select("meeting", "idx", "start", "end")


@query("segments_to_words", with_ctes("wrd") + " SELECT * FROM wrd")
def _(spark, sf):
    return L.segments_to_words(P.segments(spark, sf))


def words_sql(rule: str) -> str:
    return with_ctes("wrd") + f""",
p AS (SELECT *, lag(speaker_id) OVER w AS ps, lag("end") OVER w AS pe FROM wrd WINDOW w AS (PARTITION BY meeting ORDER BY idx, word_idx)),
i AS (SELECT *, sum(CASE WHEN {rule} THEN 1 ELSE 0 END) OVER (PARTITION BY meeting ORDER BY idx, word_idx) AS g FROM p)
SELECT meeting, min(idx) AS idx, arg_min(word_idx, (idx, word_idx)) AS word_idx, arg_min(start, (idx, word_idx)) AS start, arg_max("end", (idx, word_idx)) AS "end", any_value(speaker_id) AS speaker_id,
  string_agg(text, ' ' ORDER BY idx, word_idx) AS text, count(*) AS words FROM i GROUP BY meeting, g"""


@query("words_to_segments", words_sql('ps IS NULL OR ps <> speaker_id OR start - pe > 1.5'))
def _(spark, sf):
    return L.words_to_segments(L.segments_to_words(P.segments(spark, sf)))


@query("words_to_speaker_turns", words_sql('ps IS NULL OR ps <> speaker_id'))
def _(spark, sf):
    return L.words_to_segments(L.segments_to_words(P.segments(spark, sf)), max_gap=None)


@query("map_chunk_times", with_ctes("loc", "chunk_t") + f""",
m AS (SELECT meeting, chunk, 0.0::DOUBLE AS d0, max("end") * 0.5::DOUBLE AS d1, 100.0::DOUBLE AS o0 FROM loc GROUP BY ALL HAVING max("end") > 20),
x AS (SELECT l.*, offset_sec, d0, d1, o0 FROM loc l JOIN chunk_t c ON c.meeting = l.meeting AND c.chunk_index = l.chunk LEFT JOIN m ON m.meeting = l.meeting AND m.chunk = l.chunk)
SELECT meeting, idx, chunk, {d2('CASE WHEN d0 IS NULL THEN start + offset_sec WHEN start < d0 THEN o0 WHEN start <= d1 THEN o0 + (start - d0) ELSE o0 + (d1 - d0) END')} AS start,
  {d2('CASE WHEN d0 IS NULL THEN "end" + offset_sec WHEN "end" < d0 THEN o0 WHEN "end" <= d1 THEN o0 + ("end" - d0) ELSE o0 + (d1 - d0) END')} AS "end" FROM x""")
def _(spark, sf):
    seg = P.local_segments(P.segments(spark, sf))
    maps = P.durations(seg).where("duration > 20").select(
        "meeting", "chunk", F.lit(0.0).alias("dense_start"), (F.col("duration") * 0.5).alias("dense_end"), F.lit(100.0).alias("orig_start"),
        (F.lit(100.0) + F.col("duration") * 0.5).alias("orig_end"))
    offsets = P.chunks(spark, sf).withColumnRenamed("chunk_index", "chunk")
    return L.map_chunk_times(seg, maps, offsets).select("meeting", "idx", "chunk", "start", "end")


@query("tag_speakers_with_chunk", with_ctes("seg") + " SELECT meeting, idx, 'c' || chunk || '_' || lower(replace(speaker, ' ', '_')) AS speaker_id, 'c' || chunk || '_' || speaker AS speaker FROM seg")
def _(spark, sf):
    seg = P.segments(spark, sf).withColumn("speaker_id", labels.speaker_key("speaker"))
    return L.tag_with_chunk(seg).select("meeting", "idx", "speaker_id", "speaker")


@query("merge_transcription_runs", with_ctes("seg") + """,
kept AS (SELECT *, 1 AS src FROM seg WHERE speaker = 'Speaker 3'), done AS (SELECT DISTINCT meeting, chunk FROM kept),
alls AS (SELECT meeting, chunk, idx, start, text, 0 AS src FROM seg WHERE (meeting, chunk) NOT IN (SELECT (meeting, chunk) FROM done)
  UNION ALL SELECT meeting, chunk, idx, start, 'kept' AS text, 1 FROM kept)
SELECT meeting, row_number() OVER (PARTITION BY meeting ORDER BY start, src, chunk, idx) - 1 AS idx, chunk, start, text FROM alls""")
def _(spark, sf):
    seg = P.segments(spark, sf)
    kept = seg.where("speaker = 'Speaker 3'").withColumn("text", F.lit("kept"))
    return L.merge_runs(seg, kept).select("meeting", "idx", "chunk", "start", "text")


@query("repeated_phrases", with_ctes("seg") + r""",
w0 AS (SELECT meeting, chunk, idx, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS ws FROM seg),
w1 AS (SELECT meeting, chunk, idx, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w0),
w2 AS (SELECT meeting, chunk, w, row_number() OVER (PARTITION BY meeting, chunk ORDER BY idx, i) - 1 AS p FROM w1),
w3 AS (SELECT meeting, chunk, p, string_agg(w, ' ') OVER (PARTITION BY meeting, chunk ORDER BY p ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS phrase,
    count(*) OVER (PARTITION BY meeting, chunk ORDER BY p ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS n FROM w2),
w4 AS (SELECT *, row_number() OVER (PARTITION BY meeting, chunk, phrase ORDER BY p) AS k FROM w3 WHERE n = 2)
SELECT meeting, chunk, min(p) AS at_word, arg_min(phrase, p) AS preview FROM w4 WHERE k = 3 GROUP BY ALL""")
def _(spark, sf):
    return L.repeated_phrases(P.segments(spark, sf), window_words=2, times=3, stride=1)


@query("plan_chunks", with_ctes("frm", recursive=True) + """,
q AS (SELECT file, frame_idx, frame_idx - row_number() OVER (PARTITION BY file ORDER BY frame_idx) AS g FROM frm WHERE NOT is_speech),
r AS (SELECT file, list({'a': a, 'b': b} ORDER BY a) AS runs FROM (SELECT file, min(frame_idx) AS a, max(frame_idx) + 1 AS b FROM q GROUP BY file, g) GROUP BY file),
f AS (SELECT file, CAST(round(duration * 1000) AS BIGINT) AS total, coalesce(runs, []) AS runs FROM frd LEFT JOIN r USING (file)),
w AS (SELECT file, total, runs, 0::BIGINT AS begin, 0::BIGINT AS pos, -1::BIGINT AS chunk FROM f
  UNION ALL
  SELECT file, total, runs, pos, CASE WHEN stop <= pos THEN least(total, pos + 1500) ELSE stop END, chunk + 1
  FROM (SELECT *, least(CASE WHEN pos + 1500 >= total THEN total WHEN best.n >= 2 THEN (best.b - best.n // 2) * 30 ELSE pos + 1500 END, pos + 3000, total) AS stop
    FROM (SELECT *, list_max(list_transform(list_filter(runs, lambda x: x.b > lo AND x.a < hi), lambda x: {'n': least(x.b, hi) - greatest(x.a, lo), 'first': -x.a, 'b': least(x.b, hi)})) AS best
      FROM (SELECT *, greatest(pos + 750, pos + 900) // 30 AS lo, least(total, pos + 3000, pos + 2100) // 30 AS hi FROM w WHERE pos < total))))
SELECT file, CAST(chunk AS INTEGER) AS chunk, begin / 1000.0::DOUBLE AS orig_start, pos / 1000.0::DOUBLE AS orig_end, 0.0::DOUBLE AS dense_start,
  pos / 1000.0::DOUBLE - begin / 1000.0::DOUBLE AS dense_end FROM w WHERE chunk >= 0""")
def _(spark, sf):
    fr = P.frames(spark, sf)
    return L.plan_chunks(fr, P.frame_durations(fr), target_sec=1.5, max_sec=3.0, search_sec=0.6, min_silence_frames=2)


@query("turn_windows", with_ctes("spk") + f""",
p AS (SELECT seg.meeting, seg.idx, seg.speaker_id, greatest(seg.start, s.start) + 0.12::DOUBLE AS a, least(seg."end", s."end") - 0.18::DOUBLE AS b
  FROM seg JOIN spk s ON s.meeting = seg.meeting AND greatest(seg.start, s.start) < least(seg."end", s."end") WHERE seg."end" - seg.start >= 1.6),
q AS (SELECT *, row_number() OVER (PARTITION BY meeting, idx ORDER BY b - a DESC, a) AS r FROM p WHERE b - a >= 1.6),
l AS (SELECT *, least(4.0::DOUBLE, b - a) AS len FROM q WHERE r = 1), f AS (SELECT *, greatest(a, (a + b) / 2.0::DOUBLE - len / 2.0::DOUBLE) AS ws FROM l),
g AS (SELECT *, least(b, ws + len) AS we FROM f)
SELECT meeting, idx, speaker_id, {d2('greatest(a, we - len)')} AS start, {d2('we')} AS "end" FROM g""")
def _(spark, sf):
    seg = P.segments(spark, sf)
    return L.turn_windows(seg, P.speech(seg))


@query("speech_windows", with_ctes("spk") + f""",
e AS (SELECT meeting, ord, k, start + k * 3.0::DOUBLE AS a, "end" FROM (SELECT *, unnest(range(0, CAST(floor(("end" - start) / 3.0::DOUBLE) AS BIGINT) + 1)) AS k FROM spk)
  WHERE start + k * 3.0::DOUBLE + 1.6::DOUBLE <= "end" AND least("end", start + k * 3.0::DOUBLE + 3.0) - (start + k * 3.0::DOUBLE) >= 1.6::DOUBLE),
r AS (SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY ord, k) - 1 AS r, count(*) OVER (PARTITION BY meeting) AS n FROM e),
s AS (SELECT meeting, n, unnest(range(0, least(n, 40))) AS i FROM (SELECT DISTINCT meeting, n FROM r))
SELECT s.meeting, s.i AS w_idx, {d2('a')} AS start, {d2('least("end", a + 3.0::DOUBLE)')} AS "end"
FROM s JOIN r ON r.meeting = s.meeting AND r.r = CASE WHEN s.n > 40 THEN CAST(floor(s.i * (s.n / 40.0::DOUBLE)) AS BIGINT) ELSE s.i END""")
def _(spark, sf):
    return L.speech_windows(P.speech(P.segments(spark, sf)), at_most=40)


@query("enrolment_windows", """
SELECT name, k AS w_idx, k * 3.0::DOUBLE AS start, least(k * 3.0::DOUBLE + 3.0, d) AS "end" FROM (
  SELECT CAST(s_suppkey AS VARCHAR) AS name, (s_suppkey % 20) * 0.75::DOUBLE + 0.5 AS d, unnest(range(0, 6)) AS k FROM supplier)
WHERE (d > 3 AND k * 3 < d AND least(k * 3.0::DOUBLE + 3.0, d) - k * 3.0::DOUBLE >= 1) OR (d <= 3 AND k = 0)""")
def _(spark, sf):
    s = P.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("name"), ((F.col("s_suppkey") % 20) * 0.75 + 0.5).alias("duration"))
    return L.enrol_windows(s)


@query("sliding_windows", with_ctes("seg") + """
SELECT meeting, idx, k AS w_idx, start + k * 1.0::DOUBLE AS start, least("end", start + k * 1.0::DOUBLE + 2.0::DOUBLE) AS "end" FROM (
  SELECT *, unnest(range(0, CAST(floor("end" - start) AS BIGINT) + 1)) AS k FROM seg)
WHERE start + k * 1.0::DOUBLE + 1.5::DOUBLE <= "end" AND least("end", start + k * 1.0::DOUBLE + 2.0) - (start + k * 1.0::DOUBLE) >= 1.5""")
def _(spark, sf):
    return L.sliding_windows(P.segments(spark, sf))


@query("choose_samples", with_ctes("seg") + """,
t AS (SELECT meeting, speaker_id, idx, start, "end", "end" - start AS d, CASE WHEN "end" - start BETWEEN 2 AND 15 THEN 0 WHEN "end" - start > 15 THEN 1 WHEN "end" - start >= 1 THEN 2 END AS tier FROM seg),
o AS (SELECT *, start + least(0.2::DOUBLE, d * 0.2::DOUBLE) AS a, "end" - least(0.6::DOUBLE, d * 0.4::DOUBLE) AS b,
    row_number() OVER (PARTITION BY meeting, speaker_id ORDER BY tier, CASE WHEN tier = 0 THEN round(d, 3) ELSE -d END, CASE WHEN tier = 0 THEN round(start, 3) ELSE 0 END, idx) AS r FROM t WHERE tier IS NOT NULL),
c AS (SELECT *, sum(b - a) OVER (PARTITION BY meeting, speaker_id ORDER BY r) - (b - a) AS before FROM o)
SELECT meeting, speaker_id, idx, round(a, 2) AS start, round(least(b - a, 25.0::DOUBLE - before), 2) AS take FROM c WHERE least(b - a, 25.0::DOUBLE - before) > 0.000000001""")
def _(spark, sf):
    out = L.choose_samples(P.segments(spark, sf))
    return out.withColumn("start", F.round("start", 2)).withColumn("take", F.round("take", 2))


@query("overlapping_intervals", with_ctes("spk") + """
SELECT seg.meeting, seg.idx, s.ord FROM seg JOIN spk s ON s.meeting = seg.meeting AND greatest(seg.start, s.start - 1.0::DOUBLE) < least(seg."end", s."end" + 1.0::DOUBLE)""")
def _(spark, sf):
    seg = P.segments(spark, sf)
    talk = P.speech(seg).select("meeting", "ord", (F.col("start") - 1.0).alias("r_start"), (F.col("end") + 1.0).alias("r_end"))
    return ordered.overlapping(seg.select("meeting", "idx", "start", "end"), talk, ["meeting"]).select("meeting", "idx", "ord")
