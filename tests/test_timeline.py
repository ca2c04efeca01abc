import random

import pytest

from pyspark.sql import functions as F

from parley import ordered
from parley.operators import timeline as L

SEG = "meeting string, chunk int, idx long, start double, end double, text string"


def segs(spark, rows):
    return spark.createDataFrame([("m", 0, i, float(s), float(e), t) for i, (s, e, t) in enumerate(rows)], SEG)


def length(spark, d):
    return spark.createDataFrame([("m", 0, d)], "meeting string, chunk int, duration double")


def test_good_timeline(spark):
    df = segs(spark, [(0.4, 4.8, "Chúng ta bắt đầu cuộc họp."), (5.1, 12.0, "Tôi sẽ báo cáo phần công việc tuần này.")])
    assert L.timeline_errors(df, length(spark, 15.0)).count() == 0


def test_long_and_collapsed_tail(spark):
    df = segs(spark, [(114.0, 227.0, "Nội dung báo cáo " * 30), (319.49, 320.49, "Đồng ý với phương án trên."),
                      (320.49, 320.49, "Đoạn cuối vẫn còn rất nhiều nội dung.")])
    got = {(r.idx, r.reason) for r in L.timeline_errors(df, length(spark, 320.49)).collect()}
    assert {(0, "too_long"), (2, "no_time"), (None, "tail_pile"), (None, "empty_last")} <= got


def test_no_segments(spark):
    df = segs(spark, [(0, 1, "x")]).where("false")
    assert [r.reason for r in L.timeline_errors(df, length(spark, 5.0)).collect()] == ["no_segments"]


def plan_reference(speech, total, ideal, cap, reach=30_000, least=10):
    """Cuts in milliseconds, walked frame by frame."""
    begin, cuts = 0, []
    while begin < total:
        target = begin + ideal
        if target >= total:
            end = total
        else:
            lo, hi = max(begin + ideal // 2, target - reach) // 30, min(total, begin + cap, target + reach) // 30
            best, longest, i = target // 30, 0, lo
            while i < hi:
                j = i
                while j < hi and not speech[j]:
                    j += 1
                if j - i > longest:
                    longest, best = j - i, j - (j - i) // 2
                i = max(j, i + 1)
            end = min(best * 30, begin + cap) if longest >= least else target
        end = min(end, begin + cap, total)
        if end <= begin:
            end = min(total, begin + ideal)
        cuts.append((begin, end))
        begin = end
    return cuts


def test_plan_chunks(spark):
    rnd = random.Random(2)
    files, frames, durations = {}, [], []
    for f in range(6):
        flags = []
        while len(flags) < 400:
            flags += [rnd.random() < 0.7] * rnd.randint(1, 25)
        files[f"f{f}"] = flags
    files["silent"] = [False] * 133
    for f, flags in files.items():
        frames += [(f, i, x) for i, x in enumerate(flags)]
        durations.append((f, len(flags) * 30 / 1000.0))
    fr = spark.createDataFrame(frames, "file string, frame_idx int, is_speech boolean")
    du = spark.createDataFrame(durations, "file string, duration double")
    got = {}
    for r in L.plan_chunks(fr, du, target_sec=1.0, max_sec=1.5).orderBy("file", "chunk").collect():
        got.setdefault(r.file, []).append((round(r.orig_start * 1000), round(r.orig_end * 1000)))
    for f, flags in files.items():
        assert got[f] == plan_reference(flags, len(flags) * 30, 1000, 1500), f
    assert len(got["silent"]) >= 3
    assert all(b - a <= 1500 for cuts in got.values() for a, b in cuts)


def test_speech_intervals(spark):
    fr = spark.createDataFrame([("a", i, i in (2, 3, 10, 30, 31)) for i in range(32)] + [("b", i, False) for i in range(5)], "file string, frame_idx int, is_speech boolean")
    du = spark.createDataFrame([("a", 0.97), ("b", 0.15)], "file string, duration double")
    got = {(r.file, round(r.start, 2), round(r.end, 2)) for r in L.speech_intervals(fr, du).collect()}
    assert got == {("a", 0.06, 0.33), ("a", 0.9, 0.97), ("b", 0.0, 0.15)}


def test_starts_to_ranges(spark):
    rows = [("m", 0, i, s, "model") for i, s in enumerate([0.0, 2.0, 2.03, 2.0, 9.5])] + [("m", 1, i, s, "model") for i, s in enumerate([1.0, 5.0, 3.0])]
    rows += [("m", 2, i, 1.0, "model") for i in range(8)] + [("m", 3, i, 0.0 if i < 80 else float(i), "model") for i in range(160)]
    df = spark.createDataFrame(rows, "meeting string, chunk int, idx long, start double, timestamp_source string")
    du = spark.createDataFrame([("m", c, 200.0 if c == 3 else 10.0) for c in range(4)], "meeting string, chunk int, duration double")
    out = {(r.chunk, r.idx): (r.end, r.timestamp_overlap) for r in L.complete_starts(df, du).collect()}
    assert {k[0] for k in out} == {0, 3}
    assert [out[(0, i)] for i in range(5)] == [(2.0, False), (9.5, True), (9.5, True), (9.5, True), (10.0, False)]
    # eighty equal starts: the next distinct one lies beyond the look-ahead
    assert out[(3, 0)] == (80.0, True) and out[(3, 79)] == (80.0, True) and out[(3, 80)] == (81.0, False)


def test_repeated_phrase(spark):
    words = [f"w{i}" for i in range(24)]
    loop = " ".join(words * 3)
    df = segs(spark, [(0, 1, "mở đầu bốn từ"), (1, 2, loop[:60]), (2, 3, loop[60:])])
    # splitting inside a word changes it, so the loop is given whole
    df = segs(spark, [(0, 1, "mở đầu bốn từ"), (1, 2, loop)])
    r = L.repeated_phrases(df).first()
    assert (r.at_word, r.preview) == (52, " ".join(words[:8]))
    assert L.repeated_phrases(segs(spark, [(0, 1, " ".join(words * 2))])).count() == 0


def test_retime_keeps_order_and_stays_in_speech(spark):
    rnd = random.Random(4)
    rows = [("m", 0, i, "a" if i % 3 else "b", " ".join("w" * rnd.randint(1, 9) for _ in range(rnd.randint(0, 12))), 0.0, 0.0) for i in range(25)]
    df = spark.createDataFrame(rows, "meeting string, chunk int, idx long, speaker string, text string, start double, end double")
    talk = [(1.0, 4.0), (6.0, 7.5), (9.0, 20.0)]
    sp = spark.createDataFrame([("m", 0, i, a, b) for i, (a, b) in enumerate(talk)], "meeting string, chunk int, ord long, start double, end double")
    out = sorted(L.retime_by_speech(df, sp).collect(), key=lambda r: r.idx)
    assert out[0].start == 1.0 and out[-1].end == 20.0
    for a, b in zip(out, out[1:]):
        assert a.start <= a.end <= b.start + 1e-9
        assert any(x <= a.start <= y for x, y in talk)


def test_even_sampling(spark):
    sp = spark.createDataFrame([("m", 0, 0.0, 3.0 * 700)], "meeting string, ord long, start double, end double")
    out = {r.w_idx: r.start for r in L.speech_windows(sp, at_most=240).collect()}
    assert out == {i: 3.0 * int(i * (700 / 240)) for i in range(240)}
    assert L.speech_windows(sp).count() == 700


def test_words_round_trip(spark):
    df = segs(spark, [(0, 2, "a b c"), (2.5, 3, "d"), (9, 10, "e f")]).withColumn("speaker", F.lit("Speaker 1"))
    out = sorted(L.words_to_segments(L.segments_to_words(df)).collect(), key=lambda r: r.idx)
    assert [(r.text, r.start, r.end) for r in out] == [("a b c d", 0.0, 3.0), ("e f", 9.0, 10.0)]


@pytest.mark.parametrize("slice_rows", [7, 50_000])
def test_turn_ends_across_slices(spark, monkeypatch, slice_rows):
    """Most starts of a chunk are equal, others go back a little; slices cut it anywhere."""
    monkeypatch.setattr(ordered, "SLICE_ROWS", slice_rows)
    rnd = random.Random(4)
    data, at = [], 0.0
    for meeting, chunk, n in (("a", 0, 300), ("a", 1, 5), ("b", 0, 120)):
        at = 0.0
        for i in range(n):
            at = at if rnd.random() < 0.6 else max(0.0, at + rnd.choice([0.5, 1.25, -0.1, 0.04]))
            data.append((meeting, chunk, i, round(at, 2), "model"))
    df = spark.createDataFrame(data, "meeting string, chunk int, idx int, start double, timestamp_source string")
    durations = spark.createDataFrame([("a", 0, 500.0), ("a", 1, 50.0), ("b", 0, 500.0)], "meeting string, chunk int, duration double")
    got = {(r.meeting, r.chunk, r.idx): r.end for r in L.complete_starts(df, durations).collect()}
    usable = {(r.meeting, r.chunk) for r in L.timeline_verdicts(df, durations).where("usable").collect()}
    assert ("a", 0) in usable and {k[:2] for k in got} == usable
    limit = {("a", 0): 500.0, ("a", 1): 50.0, ("b", 0): 500.0}
    for m, c, i, s, _ in data:
        if (m, c) in usable:
            later = [x[3] for x in data if x[:2] == (m, c) and x[2] > i and x[3] > s + 0.05]
            assert got[m, c, i] == pytest.approx(round(later[0] if later else limit[m, c], 2))


def test_timeline_errors_shuffle_no_texts(spark):
    df = spark.createDataFrame([("m", 0, i, float(i), i + 1.0, "a b") for i in range(9)], "meeting string, chunk int, idx long, start double, end double, text string")
    out = L.timeline_errors(df, length(spark, 9.0))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above = [line for line in plan.splitlines()[:plan.splitlines().index(next(x for x in plan.splitlines() if "Join" in x)) + 1]]
    assert not any("split(text" in line for line in above)
    counted = df.selectExpr("meeting", "chunk", "idx", "start", "end", "size(split(text, ' ')) as words")
    assert sorted(map(str, L.timeline_errors(counted, length(spark, 9.0)).collect())) == sorted(map(str, out.collect()))
