"""Time work: turn ranges, speech intervals, chunk plans and voice windows.

Times are seconds as DOUBLE. Every ordered step goes through ``ordered.scan``,
so neither a meeting nor a chunk has to fit one task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ordered
from ..functions import labels, text
from ..functions.times import exact_round
from ..session import cut_lineage

CHUNK = ("meeting", "chunk")
FRAME_MS = 30

# Limits that decide results.
SAME_START = 0.05
MAX_BACK_STEP = 0.15
SPEECH_JOIN_GAP = 0.3
TURN_GAP = 0.15
MERGE_GAP = 1.5
# End of fixed values.


def _looked_around(segments: DataFrame) -> DataFrame:
    """Turns with the start before them in their chunk."""
    return ordered.scan(segments, CHUNK, "idx", prev={"_before": F.col("start")})


def _verdicts(around: DataFrame, source: str) -> DataFrame:
    bad = ((F.col("start") < 0) | (F.col("start") > F.greatest(F.lit(0.0), F.col("duration")) + 1.0)
           | (F.col("start") + MAX_BACK_STEP < F.col("_before"))
           | ~F.col("timestamp_source").eqNullSafe(source))
    few = (F.col("n") >= 4) & (F.col("marks") < F.greatest(F.lit(2), F.floor(F.col("n") / 5)))
    per_mark = around.groupBy(*CHUNK, exact_round("start", 1).alias("mark")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(bad, F.lit(False))).alias("bad"), F.max("idx").alias("last"))
    return (per_mark.groupBy(*CHUNK)
            .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("marks"), F.bool_or("bad").alias("bad"), F.max("last").alias("_last"))
            .select(*CHUNK, (~F.col("bad") & ~few).alias("usable"), "_last"))


def timeline_verdicts(segments: DataFrame, durations: DataFrame, source: str = "model") -> DataFrame:
    """One row per chunk: is its start-only clock usable?"""
    rows = segments.select(*CHUNK, "idx", "start", "timestamp_source").join(durations, list(CHUNK))
    return _verdicts(_looked_around(rows), source).select(*CHUNK, "usable")


def _next_above(start: np.ndarray) -> np.ndarray:
    """For each value the first later one that is more than SAME_START above it, else NaN.

    Read from the end; of the values read only those matter that no nearer one reaches, a stack in falling order.
    """
    out = np.full(len(start), np.nan)
    if len(start) < 2:
        return out
    out[:-1] = np.where(start[1:] > start[:-1] + SAME_START, start[1:], np.nan)
    if not np.isnan(out[:-1]).any():
        return out
    stack: list[float] = []  # negated: rising, the nearest value last
    for i, s in zip(range(len(start) - 1, -1, -1), start[::-1].tolist()):
        if s != s:
            continue
        k = bisect_left(stack, -(s + SAME_START))
        if k:
            out[i] = -stack[k - 1]
        while stack and stack[-1] >= -s:
            stack.pop()
        stack.append(-s)
    return out


def _with_next(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Add ``_next``, the next distinct start in the chunk; drops ``_cut``, the slice.

    Slices are dealt over the tasks in order of ``idx``, and each is resolved by itself. What is left open at its end, a few
    different starts, is looked up in the first later slice whose greatest start is high enough, which slice maxima tell; there,
    running maxima are searched. So a chunk of any length and any number of equal starts is spread over its
    slices, and nothing is compared with all that follows.
    """
    key = [*CHUNK, "_cut"]
    plain = segments.select(*CHUNK, "idx", "start", F.floor(F.col("idx") / ordered.SLICE_ROWS).alias("_cut"))
    tops = plain.groupBy(*key).agg(F.max("start").alias("top"))
    several = cut_lineage(tops.groupBy(*CHUNK).agg(F.array_sort(F.collect_list(F.struct("_cut", "top"))).alias("slices")).where(F.size("slices") > 1))
    long = plain.join(several.select(*CHUNK), list(CHUNK), "left_semi")
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    head = ", ".join(f"{c} {kinds[c]}" for c in key)

    def open_starts(keys, table):
        start = np.asarray(table.sort_by("idx").column("start"), dtype=np.float64)
        left = np.unique(start[np.isnan(_next_above(start)) & ~np.isnan(start)])
        return pa.table({**{c: pa.array([k.as_py()] * len(left), k.type) for c, k in zip(key, keys)}, "start": pa.array(left)})

    def answers(keys, asked, table):
        start = np.asarray(table.sort_by("idx").column("start"), dtype=np.float64)
        upto = np.maximum.accumulate(np.nan_to_num(start, nan=-np.inf))
        at = np.searchsorted(upto, np.asarray(asked.column("start"), dtype=np.float64) + SAME_START, "right")
        return pa.table({**{c: asked.column(c) for c in CHUNK}, "_cut": asked.column("own"), "start": asked.column("start"), "_far": pa.array(start[at])})

    asks = long.groupBy(*key).applyInArrow(open_starts, f"{head}, start double").join(several, list(CHUNK))
    enough = F.filter("slices", lambda x: (x["_cut"] > F.col("_cut")) & (x["top"] > F.col("start") + SAME_START))
    asks = asks.select(*CHUNK, F.col("_cut").alias("own"), "start", F.get(enough, F.lit(0))["_cut"].alias("_cut")).where("_cut is not null")
    there = long.join(asks.select(*key).distinct(), key, "left_semi")
    far = asks.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(answers, f"{head}, start double, _far double")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last slice seen, which may go on
        def done(t: pa.Table) -> list[pa.RecordBatch]:
            start, told = np.asarray(t.column("start"), dtype=np.float64), np.asarray(t.column("_far").is_valid())
            bounds = [0, *_changes(t).tolist(), t.num_rows]
            out = [_next_above(start[i:j]) for i, j in zip(bounds, bounds[1:])]
            if told.any():  # answers come first in their slice
                far = np.asarray(t.column("_far"), dtype=np.float64)
                for n, (i, j) in enumerate(zip(bounds, bounds[1:])):
                    k = i + int(told[i:j].sum())
                    out[n] = np.concatenate([far[i:k], _next_above(start[k:j])])
                    if k > i:
                        order = i + np.argsort(start[i:k])
                        at = order[np.minimum(np.searchsorted(start[order], start[k:j]), k - i - 1)]
                        out[n][k - i:] = np.where(np.isnan(out[n][k - i:]) & (start[at] == start[k:j]), far[at], out[n][k - i:])
            values = np.concatenate(out)
            t = t.drop_columns("_far").append_column("_next", pa.array(values, mask=np.isnan(values)))
            return (t.filter(pa.array(~told)) if told.any() else t).to_batches()

        def _changes(t: pa.Table) -> np.ndarray:
            """Rows that begin another slice than the row before them."""
            new = np.zeros(max(0, t.num_rows - 1), dtype=bool)
            for c in key:
                one = t.column(c).combine_chunks()
                new |= np.asarray(pc.fill_null(pc.not_equal(one.slice(1), one.slice(0, t.num_rows - 1)), True), dtype=bool)
            return np.flatnonzero(new) + 1

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            last = _changes(t)
            end = int(last[-1]) if len(last) else 0
            if end:
                yield from done(t.slice(0, end))
            held = t.slice(end).to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    both = rows.withColumn("_far", F.lit(None).cast("double"))
    if not several.isEmpty():  # else every chunk is one slice and nothing stays open
        both = both.unionByName(far, allowMissingColumns=True)
    dealt = both.repartition(*key).sortWithinPartitions(*key, F.col("_far").isNull(), "idx")
    return dealt.mapInArrow(resolve, T.StructType([*both.schema.fields[:-1], T.StructField("_next", T.DoubleType())])).drop("_cut")


def complete_starts(segments: DataFrame, durations: DataFrame, source: str = "model") -> DataFrame:
    """Turn ranges from starts: a turn ends at the next distinct start in its chunk.

    Chunks with an unusable clock are left out; see ``timeline_verdicts``.
    """
    keep = [c for c in segments.columns if c not in ("start", "end", "timestamp_overlap")]
    around = _looked_around(segments.select(*keep, "start").join(durations, list(CHUNK)))
    rows = (around.join(_verdicts(around, source).where("usable").drop("usable", "_last"), list(CHUNK)).drop("_before")
            .withColumn("_cut", F.floor(F.col("idx") / ordered.SLICE_ROWS)))
    timed = _with_next(rows, segments)
    # Simultaneous turns sit next to each other in start order.
    close = ordered.neighbourhood(timed, CHUNK, "start", width=60.0, before=2 * SAME_START, after=2 * SAME_START)
    order = W.partitionBy(*CHUNK, "_slice").orderBy("start", "idx")
    timed = close.withColumn("_left", F.lag("start").over(order)).withColumn("_right", F.lead("start").over(order)).where("not _copy")
    limit = F.greatest(F.lit(0.0), F.col("duration"))
    end = F.greatest(F.col("start"), F.coalesce("_next", limit))
    overlap = ((F.abs(F.col("start") - F.col("_left")) <= SAME_START)
               | (F.abs(F.col("_right") - F.col("start")) <= SAME_START))
    return timed.select(*keep, exact_round(F.least(limit, F.greatest(F.lit(0.0), F.col("start")))).alias("start"),
                        exact_round(F.least(limit, end)).alias("end"),
                        F.coalesce(overlap, F.lit(False)).alias("timestamp_overlap"))


def timeline_errors(segments: DataFrame, durations: DataFrame, check_long: bool = True) -> DataFrame:
    """Reasons a chunk's timeline is unsafe to cut: one row per reason, ``idx`` null for chunk-level ones.

    ``segments`` have a ``text`` or, counted beforehand, its ``words``; texts are not shuffled.
    """
    limit = F.greatest(F.lit(0.0), F.col("duration"))
    words = F.col("words") if "words" in segments.columns else text.word_count("text")
    rows = (segments.select(*CHUNK, "idx", "start", F.coalesce("end", "start").alias("end"), words.alias("words"))
            .join(durations.select(*CHUNK, limit.alias("duration")), list(CHUNK)).withColumn("len", F.col("end") - F.col("start")))
    worded, length = F.col("words") > 0, F.col("len")
    reasons = [F.when((F.col("start") < -0.25) | (F.col("end") > F.col("duration") + 1.0), "out_of_chunk"),
               F.when(worded & (length <= 0), "no_time")]
    if check_long:
        reasons += [F.when(worded & (length > F.greatest(F.lit(45.0), F.col("duration") * 0.22)), "too_long"),
                    F.when((F.col("words") >= 8) & (length >= 15.0) & (F.col("words") / length < 0.45), "stretched")]
    per_row = rows.select(*CHUNK, "idx", F.explode(F.array_compact(F.array(*reasons))).alias("reason"))

    at_tail = (F.col("duration") > 0) & (F.col("end") >= F.col("duration") - 0.15)
    squeezed = at_tail & (length <= 0.15) & (F.col("words") >= 5)
    whole = rows.groupBy(*CHUNK).agg(F.count_if(at_tail).alias("tail"), F.max_by(squeezed, "idx").alias("squeezed"))
    known = durations.select(*CHUNK).join(whole, list(CHUNK), "left")
    chunk_reasons = F.array_compact(F.array(
        F.when(F.col("tail").isNull(), "no_segments"), F.when(F.col("tail") >= 2, "tail_pile"),
        F.when(F.col("squeezed"), "empty_last")))
    per_chunk = known.select(*CHUNK, F.lit(None).cast("long").alias("idx"), F.explode(chunk_reasons).alias("reason"))
    return per_row.select(*CHUNK, F.col("idx").cast("long"), "reason").unionByName(per_chunk)


def speech_intervals(frames: DataFrame, durations: DataFrame, join_gap: float = SPEECH_JOIN_GAP) -> DataFrame:
    """Speech flags per 30 ms frame to merged intervals; a file without speech is one whole interval."""
    at = F.col("frame_idx") * FRAME_MS / 1000.0
    speech = frames.where("is_speech").select("file", "frame_idx", at.alias("at"),
                                              ((F.col("frame_idx") + 1) * FRAME_MS / 1000.0).alias("until"))
    marked = ordered.runs(speech, ["file"], "frame_idx", ["at", "until"], lambda p, r: r["at"] - p["until"] > join_gap)
    found = marked.groupBy("file", "run").agg(F.max("frame_idx").alias("last"), F.max("until").alias("until"))
    size = frames.groupBy("file").agg(F.max("frame_idx").alias("final"))
    end = F.when(F.col("last").isNull() | (F.col("last") == F.col("final")), F.col("duration")).otherwise(F.col("until"))
    # Intervals are ordered by their first frame.
    return (size.join(durations, ["file"]).join(found, ["file"], "left")
            .select("file", F.coalesce("run", F.lit(0)).cast("long").alias("ord"), (F.coalesce("run", F.lit(0)) * FRAME_MS / 1000.0).alias("start"), end.alias("end"))
            .where(F.col("end") > 0))


def retime_by_speech(segments: DataFrame, speech: DataFrame) -> DataFrame:
    """Lay turns over the speech time of their chunk in proportion to their words."""
    weight = F.greatest(F.lit(1), F.size(text.word_tokens("text"))).cast("double")
    rows = segments.withColumn("_w", weight)
    rows = ordered.scan(rows, CHUNK, "idx", sums={"_upto": F.col("_w")}, following={"_next": F.struct("speaker")})
    talk = speech.select(*CHUNK, "ord", "start", "end").withColumn("_len", F.greatest(F.lit(0.0), F.col("end") - F.col("start")))
    talk = ordered.scan(talk, CHUNK, "ord", sums={"_clock": F.col("_len")})
    totals = (rows.groupBy(*CHUNK).agg(F.sum("_w").alias("_weight"))
              .join(talk.groupBy(*CHUNK).agg(F.sum("_len").alias("_speech"), F.max_by("end", "ord").alias("_final")),
                    list(CHUNK), "left"))
    rows = rows.join(totals, list(CHUNK))
    begin = F.col("_speech") * (F.col("_upto") - F.col("_w")) / F.col("_weight")
    finish = F.col("_speech") * F.col("_upto") / F.col("_weight")
    changes = F.col("_next").isNotNull() & ~F.col("_next.speaker").eqNullSafe(F.col("speaker"))
    finish = F.when(changes, F.greatest(begin, finish - TURN_GAP)).otherwise(finish)
    usable = F.coalesce(F.col("_speech"), F.lit(0.0)) > 0
    clocks = rows.where(usable).select(*CHUNK, "idx", "_final", F.explode(F.array(
        F.struct(F.lit("start").alias("side"), begin.alias("at")),
        F.struct(F.lit("end").alias("side"), finish.alias("at")))).alias("c")).select(*CHUNK, "idx", "_final", "c.*")
    talk = talk.select(*CHUNK, "ord", "start", "_clock", (F.col("_clock") - F.col("_len")).alias("_from"))
    placed = ordered.next_match(clocks, talk, CHUNK, "at", "_clock", ["start", "_from"], tie="ord", name="hit")
    when = F.coalesce(F.col("hit.start") + (F.col("at") - F.col("hit._from")), F.col("_final"))
    times = (placed.withColumn("t", exact_round(when)).groupBy(*CHUNK, "idx")
             .agg(F.max(F.when(F.col("side") == "start", F.col("t"))).alias("_start"),
                  F.max(F.when(F.col("side") == "end", F.col("t"))).alias("_end")))
    keep = [c for c in segments.columns if c not in ("start", "end")]
    return (segments.join(times, [*CHUNK, "idx"], "left")
            .select(*keep, F.coalesce("_start", "start").alias("start"), F.coalesce("_end", "end").alias("end")))


def segments_to_words(segments: DataFrame) -> DataFrame:
    """One row per word, times spread evenly over the turn."""
    parts = segments.select("meeting", "chunk", "idx", "start", F.coalesce("end", F.col("start") + 1).alias("end"),
                            labels.speaker_key("speaker").alias("speaker_id"), text.split_words("text").alias("_words"))
    words = parts.withColumn("_n", F.size("_words").cast("double"))
    return (words.select("meeting", "chunk", "idx", "start", "speaker_id",
                         F.when(F.col("_n") > 0, (F.col("end") - F.col("start")) / F.col("_n")).alias("_step"),
                         F.posexplode("_words").alias("word_idx", "text"))
            .select("meeting", "chunk", "idx", "word_idx",
                    exact_round(F.col("start") + F.col("word_idx") * F.col("_step")).alias("start"),
                    exact_round(F.col("start") + (F.col("word_idx") + 1) * F.col("_step")).alias("end"),
                    "speaker_id", "text"))


def words_to_segments(words: DataFrame, keys: Sequence[str] = ("meeting",), pos: str = "idx",
                      ties: Sequence[str] = ("word_idx",), max_gap: float | None = MERGE_GAP) -> DataFrame:
    """Words to turns: a new one on a speaker change or a gap over ``max_gap`` (None: speaker change only)."""
    keys = list(keys)
    words = words.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    def breaks(before, row):
        other = ~before["speaker_id"].eqNullSafe(row["speaker_id"])
        return other if max_gap is None else other | (row["start"] - before["end"] > max_gap)

    at = F.struct(pos, *ties)
    marked = ordered.runs(words, keys, pos, ["speaker_id", "start", "end"], breaks, ties=ties)
    out = marked.groupBy(*keys, "run").agg(
        F.min_by("start", at).alias("start"), F.max_by("end", at).alias("end"), F.min_by("speaker_id", at).alias("speaker_id"),
        ordered.ordered_join("text", at, " ").alias("text"), F.count(F.lit(1)).alias("words"))
    place = [F.col(f"run.{c}").alias(c) for c in (pos, *ties)] if ties else [F.col("run").alias(pos)]
    return out.select(*keys, *place, "start", "end", "speaker_id", "text", "words")


def map_chunk_times(rows: DataFrame, maps: DataFrame, offsets: DataFrame, columns: Sequence[str] = ("start", "end"),
                    key: Sequence[str] = ("idx",)) -> DataFrame:
    """Chunk time to meeting time through mapping ranges, else clamped to them, else by the chunk offset."""
    maps = maps.withColumn("_ord", F.floor(F.col("dense_start") * 1000))
    ends = maps.groupBy(*CHUNK).agg(F.min_by("orig_start", "dense_start").alias("_lo"), F.min("dense_start").alias("_lo_at"),
                                    F.max_by("orig_end", "dense_start").alias("_hi"))
    side = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("t")) for c in columns])).alias("v")
    points = rows.select(*CHUNK, *key, side).select(*CHUNK, *key, "v.*")
    hit = ordered.next_match(points, maps, CHUNK, "t", "dense_end", ["dense_start", "orig_start"], tie="_ord", name="m")
    hit = hit.join(ends, list(CHUNK), "left").join(offsets.select(*CHUNK, "offset_sec"), list(CHUNK), "left")
    t = F.col("t")
    mapped = (F.when(F.col("_lo").isNull(), t + F.coalesce("offset_sec", F.lit(0.0)))
              .when(F.col("m.dense_start") <= t, F.col("m.orig_start") + (t - F.col("m.dense_start")))
              .when(t < F.col("_lo_at"), F.col("_lo")).otherwise(F.col("_hi")))
    wide = hit.withColumn("t", exact_round(mapped)).groupBy(*CHUNK, *key).agg(
        *[F.max(F.when(F.col("c") == c, F.col("t"))).alias(c) for c in columns])
    return rows.drop(*columns).join(wide, [*CHUNK, *key])


def tag_with_chunk(rows: DataFrame, columns: Sequence[str] = ("speaker_id", "speaker")) -> DataFrame:
    """Put the chunk number in front of speaker ids, so ids of two chunks never meet."""
    tagged = {c: F.concat(F.lit("c"), F.col("chunk"), F.lit("_"), F.col(c)) for c in columns}
    return rows.withColumns(tagged)


def merge_runs(fresh: DataFrame, kept: DataFrame) -> DataFrame:
    """Segments of a new run with those of finished chunks kept from an earlier one, in start order."""
    kept = kept.where(labels.chunk_index("speaker_id").isNotNull())
    done = kept.select("meeting", labels.chunk_index("speaker_id").alias("chunk")).distinct()
    both = (fresh.join(done, ["meeting", "chunk"], "left_anti").withColumn("_from", F.lit(0))
            .unionByName(kept.withColumn("_from", F.lit(1)), allowMissingColumns=True)
            .withColumn("_idx", F.col("idx")).withColumn("_at", F.coalesce("start", F.lit(0.0))))
    out = ordered.number_rows(both, ["meeting"], "_at", ties=("_from", "chunk", "_idx"), width=900.0)
    return out.drop("_from", "_idx", "_at")


def repeated_phrases(segments: DataFrame, window_words: int = 24, times: int = 3, stride: int = 4,
                     preview_words: int = 8) -> DataFrame:
    """Chunks in which one long phrase comes back: the first phrase to be seen ``times`` times.

    Each word goes to the few phrases that contain it, so a chunk's text is never gathered in one place.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)([^\W_]+)"), 1)
    rows = segments.select(*CHUNK, "idx", words.alias("w")).withColumn("n", F.size("w").cast("long"))
    rows = ordered.scan(rows, CHUNK, "idx", sums={"upto": F.col("n")})
    each = rows.select(*CHUNK, F.posexplode("w").alias("i", "word"), (F.col("upto") - F.col("n")).alias("base")) \
        .select(*CHUNK, (F.col("base") + F.col("i")).alias("p"), "word")
    first = F.greatest(F.lit(0), F.ceil((F.col("p") - window_words + 1) / stride))
    spread = each.select(*CHUNK, "p", "word", F.explode(F.sequence(first, F.floor(F.col("p") / stride))).alias("k"))
    phrases = (spread.groupBy(*CHUNK, "k").agg(F.count(F.lit(1)).alias("n"), ordered.ordered_join("word", "p", " ").alias("phrase"))
               .where(F.col("n") == window_words))
    # The limit on the row number is applied in every task before the shuffle, so a phrase that loops stays small.
    order = W.partitionBy(*CHUNK, "phrase").orderBy("k")
    seen = phrases.withColumn("r", F.row_number().over(order)).where(F.col("r") <= times).where(F.col("r") == times).withColumnRenamed("k", "hit")
    return (seen.groupBy(*CHUNK).agg(F.min("hit").alias("k"), F.min_by("phrase", "hit").alias("phrase"))
            .select(*CHUNK, (F.col("k") * stride).alias("at_word"),
                    F.array_join(F.slice(F.split("phrase", " "), 1, preview_words), " ").alias("preview")))


def plan_chunks(frames: DataFrame, durations: DataFrame, target_sec: float = 300.0, max_sec: float = 600.0,
                search_sec: float = 30.0, min_silence_frames: int = 10) -> DataFrame:
    """Cut points of a recording: the longest silence near each target, never past ``max_sec``.

    Frames shrink to silent runs in parallel; only the runs of one recording, whose
    number its own length bounds, meet in the fold that walks from cut to cut.
    """
    ideal, cap, reach = int(target_sec * 1000), int(max(target_sec, max_sec) * 1000), int(search_sec * 1000)
    quiet = frames.where(~F.col("is_speech")).select("file", "frame_idx")
    marked = ordered.runs(quiet, ["file"], "frame_idx", ["frame_idx"], lambda p, r: p["frame_idx"] + 1 < r["frame_idx"])
    runs = marked.groupBy("file", "run").agg((F.max("frame_idx") + 1).alias("until"))
    gathered = runs.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(F.col("run").alias("a"), F.col("until").alias("b")))).alias("runs"))
    files = durations.select("file", F.round(F.col("duration") * 1000).cast("long").alias("total")).join(gathered, ["file"], "left")

    def cut(acc: Column, _step: Column) -> Column:
        begin, total = acc["at"], F.col("total")
        target = begin + ideal
        lo = F.floor(F.greatest(begin + ideal // 2, target - reach) / FRAME_MS)
        hi = F.floor(F.least(total, begin + cap, target + reach) / FRAME_MS)
        clipped = F.transform(F.filter(F.coalesce("runs", F.array()), lambda r: (r["b"] > lo) & (r["a"] < hi)),
                              lambda r: F.struct((F.least(r["b"], hi) - F.greatest(r["a"], lo)).alias("n"),
                                                 (-r["a"]).alias("first"), F.least(r["b"], hi).alias("b")))
        best = F.array_max(clipped)
        soft = (best["b"] - F.floor(best["n"] / 2)) * FRAME_MS
        chosen = F.when(F.coalesce(best["n"], F.lit(0)) >= min_silence_frames, soft).otherwise(target)
        end = F.when(target >= total, total).otherwise(chosen)
        end = F.least(end, begin + cap, total)
        end = F.when(end <= begin, F.least(total, begin + ideal)).otherwise(end)
        onward = F.transform(F.array(end.cast("long")), lambda e: F.struct(e.alias("at"), F.concat(acc["cuts"], F.array(e)).alias("cuts")))
        return F.when(begin >= total, acc).otherwise(F.get(onward, F.lit(0)))

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("total") / max(1, ideal // 2)).cast("int") + 1))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("cuts"))
    folded = files.select("file", F.aggregate(steps, start, cut, lambda a: a["cuts"]).alias("cuts"))
    return (folded.select("file", "cuts", F.posexplode("cuts").alias("chunk", "stop"))
            .select("file", "chunk", (F.coalesce(F.get("cuts", F.col("chunk") - 1), F.lit(0)) / 1000.0).alias("orig_start"),
                    (F.col("stop") / 1000.0).alias("orig_end"))
            .withColumn("dense_start", F.lit(0.0)).withColumn("dense_end", F.col("orig_end") - F.col("orig_start")))


def turn_windows(segments: DataFrame, speech: DataFrame | None = None, source: str = "model", min_sec: float = 1.6,
                 max_sec: float = 4.0, head: float = 0.12, tail: float = 0.18) -> DataFrame:
    """One clean voice window per turn: its longest voiced part, trimmed, the middle ``max_sec`` of it."""
    who = F.coalesce(F.nullif("speaker_id", F.lit("")), F.nullif("speaker", F.lit("")))
    turns = (segments.where((F.col("timestamp_source") == source) & ~F.coalesce("timestamp_overlap", F.lit(False)))
             .select("meeting", "idx", who.alias("speaker_id"), "start", F.coalesce("end", "start").alias("end"))
             .where(F.col("speaker_id").isNotNull() & (F.col("end") - F.col("start") >= min_sec)))
    if speech is None:
        parts = turns.withColumn("a", F.col("start")).withColumn("b", F.col("end"))
    else:
        talk = speech.select("meeting", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
        parts = (ordered.overlapping(turns, talk, ["meeting"]).withColumn("a", F.greatest("start", "r_start"))
                 .withColumn("b", F.least("end", "r_end")))
    clean = parts.withColumn("a", F.col("a") + head).withColumn("b", F.col("b") - tail).where(F.col("b") - F.col("a") >= min_sec)
    best = clean.groupBy("meeting", "idx", "speaker_id").agg(
        F.max_by(F.struct("a", "b"), F.struct((F.col("b") - F.col("a")).alias("len"), (-F.col("a")).alias("at"))).alias("p")) \
        .select("meeting", "idx", "speaker_id", "p.*")
    length = F.least(F.lit(max_sec), F.col("b") - F.col("a"))
    first = F.greatest(F.col("a"), (F.col("a") + F.col("b")) / 2.0 - length / 2.0)
    last = F.least(F.col("b"), first + length)
    return best.select("meeting", "idx", "speaker_id", exact_round(F.greatest(F.col("a"), last - length)).alias("start"),
                       exact_round(last).alias("end"))


def speech_windows(speech: DataFrame, window: float = 3.0, min_sec: float = 1.6, at_most: int | None = None) -> DataFrame:
    """Tumbling windows inside speech, all or sampled evenly down to ``at_most`` per meeting."""
    count = F.floor((F.col("end") - F.col("start")) / window).cast("int")
    fits = (F.col("a") + min_sec <= F.col("end")) & (F.least("end", F.col("a") + window) - F.col("a") >= min_sec)
    each = (speech.where(F.col("start") + min_sec <= F.col("end"))
            .select("meeting", "ord", "start", "end", F.explode(F.sequence(F.lit(0), count)).alias("k"))
            .withColumn("a", F.col("start") + F.col("k") * window).where(fits)
            .select("meeting", "ord", "k", exact_round("a").alias("start"),
                    exact_round(F.least("end", F.col("a") + window)).alias("end")))
    numbered = ordered.number_rows(each, ["meeting"], "ord", ties=("k",), name="r")
    if at_most is None:
        return numbered.select("meeting", F.col("r").alias("w_idx"), "start", "end")
    size = each.groupBy("meeting").agg(F.count(F.lit(1)).alias("n"))
    step = F.col("n") / F.lit(float(at_most))
    near = F.floor(F.col("r") / step)
    slots = F.filter(F.array(near - 1, near, near + 1), lambda i: (i >= 0) & (i < at_most) & (F.floor(i * step) == F.col("r")))
    slot = F.when(F.col("n") > at_most, F.get(slots, F.lit(0))).otherwise(F.col("r"))
    return (numbered.join(size, ["meeting"]).withColumn("w_idx", slot.cast("long")).where("w_idx is not null")
            .select("meeting", "w_idx", "start", "end"))


def enrol_windows(samples: DataFrame, window: float = 3.0, min_sec: float = 1.0) -> DataFrame:
    """Tumbling windows over an enrolment sample; a short sample is one window."""
    starts = F.sequence(F.lit(0), (F.ceil(F.col("duration") / window) - 1).cast("int"))
    long = samples.where(F.col("duration") > window).select("name", "duration", F.explode(starts).alias("k")) \
        .select("name", F.col("k").cast("long").alias("w_idx"), (F.col("k") * window).alias("start"),
                F.least(F.col("k") * window + window, F.col("duration")).alias("end")).where(F.col("end") - F.col("start") >= min_sec)
    short = samples.where(F.col("duration") <= window).select(
        "name", F.lit(0).cast("long").alias("w_idx"), F.lit(0.0).alias("start"), F.col("duration").alias("end"))
    return long.unionByName(short)


def sliding_windows(segments: DataFrame, window: float = 2.0, step: float = 1.0, min_sec: float = 1.5) -> DataFrame:
    """Overlapping windows over a turn, used to find its cleanest stretch."""
    count = F.floor((F.col("end") - F.col("start")) / step).cast("int")
    each = (segments.where(F.col("start") + min_sec <= F.col("end"))
            .select("meeting", "idx", F.col("start").alias("s"), F.col("end").alias("e"),
                    F.explode(F.sequence(F.lit(0), count)).alias("w_idx"))
            .select("meeting", "idx", F.col("w_idx").cast("long"), (F.col("s") + F.col("w_idx") * step).alias("start"), "e"))
    fits = (F.col("start") + min_sec <= F.col("e")) & (F.least("e", F.col("start") + window) - F.col("start") >= min_sec)
    return each.where(fits).select("meeting", "idx", "w_idx", "start", F.least("e", F.col("start") + window).alias("end"))


def choose_samples(segments: DataFrame, keys: Sequence[str] = ("meeting", "speaker_id"), max_total: float = 25.0,
                   min_sec: float = 1.0) -> DataFrame:
    """Parts of turns that make a voice sample: medium turns first, short ones last, up to ``max_total`` seconds."""
    keys = list(keys)
    d = F.col("end") - F.col("start")
    tier = F.when((d >= 2.0) & (d <= 15.0), 0).when(d > 15.0, 1).when((d >= min_sec) & (d < 2.0), 2)
    pure = F.col("_tier") == 0
    rows = (segments.select(*keys, "idx", "start", "end").withColumn("_d", d).withColumn("_tier", tier)
            .where("_tier is not null")
            .withColumn("_rank", F.col("_tier") * 1e7 + F.when(pure, F.round("_d", 3)).otherwise(1e6 - F.col("_d")))
            .withColumn("_tie", F.when(pure, F.round("start", 3)).otherwise(0.0))
            .withColumn("_a", F.col("start") + F.least(F.lit(0.2), F.col("_d") * 0.2))
            .withColumn("_b", F.col("end") - F.least(F.lit(0.6), F.col("_d") * 0.4))
            .where(F.col("_b") > F.col("_a")))
    placed = ordered.place_rows(rows, keys, "_rank", ties=("_tie", "idx"), name="_place")
    run = ordered.scan(placed, keys, "_place", sums={"_upto": F.col("_b") - F.col("_a")})
    before = F.col("_upto") - (F.col("_b") - F.col("_a"))
    take = F.least(F.col("_b") - F.col("_a"), max_total - before)
    return (run.withColumn("take", take).where(F.col("take") > 1e-9)
            .select(*keys, "idx", F.round("_a", 3).alias("start"), F.round("take", 3).alias("take")))
