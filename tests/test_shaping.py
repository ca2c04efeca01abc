import json
import random

from pyspark.sql import functions as F

from parley import ordered
from parley.operators import shaping as M

SEG = "meeting string, idx long, start double, end double, label string, speaker string, speaker_id string, text string"


def make(spark, rows):
    return spark.createDataFrame([("m", i, *r) for i, r in enumerate(rows)], SEG)


def test_dropped_turn_is_a_barrier(spark):
    df = make(spark, [(0.0, 1.0, "A", "a", "s1", "một"), (1.5, 2.0, "A", "a", "s1", "hai"), (2.0, 2.1, "A", "a", "s1", "..."),
                      (2.2, 3.0, "A", "a", "s1", "ba"), (9.0, 9.5, "A", "a", "s1", "bốn"), (9.6, 9.9, "A", "a", "s2", "năm")])
    out = sorted(M.merge_turns(df).collect(), key=lambda r: r.idx)
    assert [(r.text, r.start, r.end, r.parts) for r in out] == [("một hai", 0.0, 2.0, 2), ("ba", 2.2, 3.0, 1), ("bốn", 9.0, 9.5, 1), ("năm", 9.6, 9.9, 1)]


def test_merge_keeps_words_across_slices(spark):
    rnd = random.Random(8)
    rows, t = [], 0.0
    for i in range(200):
        d = rnd.uniform(0.2, 2.0)
        rows.append((t, t + d, rnd.choice("AB"), "a", "s", f"từ{i}"))
        t += d + rnd.choice([0.1, 0.1, 3.0])
    df = make(spark, rows)
    whole = sorted(M.merge_turns(df).collect(), key=lambda r: r.idx)
    cut = sorted(M.merge_turns(df, width=7).collect(), key=lambda r: r.idx)
    assert whole == cut
    assert " ".join(r.text for r in whole) == " ".join(r[5] for r in rows)
    assert all(a.label != b.label or b.start - a.end > 1.5 for a, b in zip(whole, whole[1:]))


def test_merge_same_label(spark):
    rows = [(0.0, 1.0, "A", "x", "s1", "xin"), (1.0, 5.0, "A", "x", "s1", ", chào"), (5.0, 6.0, "", "x", "s1", "q"), (6.0, 7.0, "", "x", "s1", "r"),
            (7.0, 8.0, "B", "x", "s1", "t"), (8.0, 8.5, "B", "y", "s2", " ")]
    df = make(spark, rows).withColumn("embedding", F.when(F.col("idx") < 2, F.array(F.col("idx").cast("float"))))
    out = sorted(M.merge_same_label(df).collect(), key=lambda r: r.idx)
    assert [(r.label, r.text, r.raw_speaker, r.speaker_id, r.parts) for r in out] == [
        ("A", "xin, chào", "x", "s1", 2), ("", "q", "x", "s1", 1), ("", "r", "x", "s1", 1), ("B", "t", "B", "", 2)]
    assert out[0].embedding == [1.0]


def collapse_reference(items):
    """Short strangers to the nearest lasting neighbour, row by row."""
    dur, n = {}, {}
    for s, e, l in items:
        dur[l], n[l] = dur.get(l, 0) + max(0, e - s), n.get(l, 0) + 1
    short = {l for l in dur if l.startswith("👤 Speaker") and (dur[l] <= 3 or (dur[l] <= 8 and n[l] <= 3))}
    remap = {}
    for i, (s, e, l) in enumerate(items):
        if l not in short:
            continue
        left = next((items[j] for j in range(i - 1, -1, -1) if items[j][2] not in short), None)
        right = next((items[j] for j in range(i + 1, len(items)) if items[j][2] not in short), None)
        a = abs(s - left[1]) if left else None
        b = abs(right[0] - e) if right else None
        if a is not None and (b is None or a <= b):
            remap[l] = left[2]
        elif b is not None:
            remap[l] = right[2]
    return [remap.get(l, l) for _, _, l in items]


def test_collapse_short_strangers(spark):
    rnd = random.Random(6)
    for _ in range(3):
        items, t = [], 1.0
        for _ in range(30):
            d = rnd.uniform(0.3, 4)
            items.append((t, t + d, rnd.choice(["👤 An", "👤 Bình", "👤 Speaker 1", "👤 Speaker 2", "👤 Speaker 3"])))
            t += d + rnd.uniform(2, 4)
        df = make(spark, [(s, e, l, "x", f"s{i}", "t") for i, (s, e, l) in enumerate(items)])
        out = sorted(M.collapse_short_strangers(df).collect(), key=lambda r: r.idx)
        assert [r.label for r in out] == collapse_reference(items)


def test_renumber_and_render(spark):
    df = make(spark, [(0.25, 1.0, "👤 Speaker 7", "x", "s", "a"), (1.0, 2.0, "👤 Speaker 7", "x", "s", "b"), (2.35, 3.0, "👤 An", "x", "s", "c"), (3.0, 4.0, "👤 Người lạ 2", "x", "s", "d")])
    out = M.renumber_strangers(df)
    assert [r.label for r in out.orderBy("idx").collect()] == ["👤 Speaker 1", "👤 Speaker 1", "👤 An", "👤 Speaker 2"]
    assert M.render_transcript(out).first().transcript == "**👤 Speaker 1** [0.2s]\na b\n**👤 An** [2.4s]\nc\n**👤 Speaker 2** [3.0s]\nd"


def test_edits(spark):
    df = make(spark, [(float(i), i + 1.0, "A", "x", "s", f"t{i}") for i in range(4)])
    ed = spark.createDataFrame([("m", 1, "delete", None, 1), ("m", 2, "set_text", "mới", 2), ("m", 0, "insert_after", None, 3), ("m", 0, "append", None, 4)],
                               "meeting string, idx long, op string, value string, seq long")
    out = M.edit_segments(df, ed).orderBy("idx").collect()
    assert [(r.idx, r.start, r.label, r.text) for r in out] == [(0, 0.0, "A", "t0"), (1, 0.0, M.NEW_SPEAKER, ""), (2, 2.0, "A", "mới"), (3, 3.0, "A", "t3"), (4, 0.0, M.NEW_SPEAKER, "")]


def test_rebuild_meetings_from_stored_chunks(spark):
    def seg(start, end, speaker_id, words, **more):
        return {"start": start, "end": end, "speaker": more.pop("speaker", "S"), "speaker_id": speaker_id, "text": words, **more}

    one = {"segments": [seg(1.0, 2.0, "c0_speaker_1", "xin  mời.."), seg(2.5, 3.0, " c0_speaker_1 ", "các bạn", embedding=[0.5, 1.0]), seg(3.0, 3.1, "c0_speaker_1", "..."),
                        seg(3.2, 4.0, "c0_speaker_1", "tiếp theo"), seg(None, 0.5, "", "mở đầu", speaker=None)]}
    two = {"segments": [seg(10.0, 11.0, "c1_speaker_2", "người hai"), seg(5.0, 6.0, "c1_speaker_3", "người ba")]}
    chunks = spark.createDataFrame([("m", 2, json.dumps(two)), ("m", 0, json.dumps(one)), ("m", 1, "{broken"), ("m", 3, None), ("bad", 0, "[]"), ("n", 0, json.dumps(two))],
                                   "meeting string, chunk_index int, raw_segments string")
    log = "[Speaker] Greedy result: c0_speaker_1→'Lan'(0.9)\nother c1_speaker_2→'no'\nStranger DB rematch: c1_speaker_3 -> 'Minh', c1_speaker_2→'Speaker'"
    logs = spark.createDataFrame([("m", log), ("gone", log)], "meeting string, log string")
    got = {r.meeting: r for r in M.rebuild_meetings(chunks, logs).collect()}
    assert set(got) == {"m", "n"}
    turns = json.loads(got["m"].original_raw_results)
    assert [(t["start"], t["end"], t["speaker"], t["text"], t["speaker_id"]) for t in turns] == [
        (0.0, 0.5, "👤 Speaker", "mở đầu", ""), (1.0, 3.0, "👤 Lan", "xin mời các bạn", "c0_speaker_1"), (3.2, 4.0, "👤 Lan", "tiếp theo", "c0_speaker_1"),
        (5.0, 6.0, "👤 Minh", "người ba", "c1_speaker_3"), (10.0, 11.0, "👤 Speaker 1", "người hai", "c1_speaker_2")]
    assert turns[1]["embedding"] == [0.5, 1.0]
    assert [x[2] for x in json.loads(got["m"].raw_results)] == [t["speaker"] for t in turns]
    assert got["m"].transcript == "mở đầu xin mời các bạn tiếp theo người ba người hai"
    assert [t["speaker"] for t in json.loads(got["n"].original_raw_results)] == ["👤 Speaker 1", "👤 Speaker 2"]


def test_attendance_roles(spark):
    df = make(spark, [(0.0, 1.0, l, "x", "s", "t") for l in ("👤 An (a@x)", "Bình - b@x - Kế toán", "Người lạ 1", "👤 An", "Cúc - c@x - thành viên")])
    roles = spark.createDataFrame([("an", "Giám đốc")], "name string, role string")
    staff = spark.createDataFrame([("Bình", "Dev"), ("Cúc", None)], "employee_name string, designation string")
    out = M.attendance(df, roles, staff).orderBy("ord").collect()
    assert [(r.name, r.role) for r in out] == [("An", "Giám đốc"), ("Bình", "Dev"), ("Người lạ 1", "Khách"), ("Cúc", "")]


def test_numbering_is_dense(spark):
    df = make(spark, [(0.0, 1.0, "A", "x", "s", "t")] * 9).where("idx % 2 = 0")
    assert sorted(r.n for r in ordered.number_rows(df, ["meeting"], "idx", name="n", width=3).collect()) == [0, 1, 2, 3, 4]


def test_stranger_beside_an_empty_label_keeps_its_own(spark):
    df = make(spark, [(0.0, 9.0, "", "s", "a", "x"), (9.0, 10.0, "👤 Speaker 1", "s", "b", "y")])
    assert {r.label for r in M.collapse_short_strangers(df).collect()} == {"", "👤 Speaker 1"}
