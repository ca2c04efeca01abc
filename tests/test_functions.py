import random

import pytest
from pyspark.sql import functions as F

from parley.functions import labels, text, times


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn("x").alias("y")).first().y


@pytest.mark.parametrize("given, clean", [
    ("ừm", ""), ("Dạ vâng ạ", "Dạ vâng ạ"), ("vâng.", ""), ("OK!!", ""), (None, ""),
    ("thì là mình làm báo cáo", "Mình làm báo cáo"), ("mình mình mình làm làm xong", "Mình làm xong"),
    ("xong  rồi , nhé", "Xong rồi, nhé"), ("gửi Nhật trình cho sếp", "Gửi Tờ trình cho sếp"),
    ("ổn à , ừm, được", "Ổn được"), ("thành thành phố", "Thành phố"), ("lan Lan hoa", "Lan hoa"), ("anhanh", "Anhanh"),
])
def test_clean_segment_text(spark, given, clean):
    assert one(spark, given, text.clean_segment_text) == clean


@pytest.mark.parametrize("given, ok", [
    ("xin chào", False), ("Xin  Chào", False), ("xin chào anh", True), ("...", False), ("12 - 3", False), ("... hết ...", False), ("à", False), ("ạ", True), ("", False),
])
def test_meaningful(spark, given, ok):
    assert one(spark, given, text.is_meaningful) is ok


def test_short_list_keeps_small_words(spark):
    assert one(spark, "dạ vâng", lambda c: text.is_meaningful(c, text.STOCK_PHRASES_SHORT)) is True


def test_control_characters(spark):
    assert one(spark, "hello\x08world", text.strip_control) == "helloworld"
    assert one(spark, " a\x0b\t b\n", text.normalize_whitespace) == "a b"


def test_reordered_name_scores_one(spark):
    df = spark.createDataFrame([("Nguyễn Trí Khang", "anh Khang Trí Nguyễn")], "a string, b string")
    assert df.select(text.token_overlap(text.name_tokens("a"), text.name_tokens("b")).alias("s")).first().s == 1.0
    assert one(spark, "Bà Chị Thu Ba", text.norm_name) == "thu"


@pytest.mark.parametrize("given, name", [
    ("👤 chị Thuỷ (t@x.vn)", "chị Thuỷ"), ("👤 An - 69%", "An"), ("An", "An"),
])
def test_plain_name(spark, given, name):
    assert one(spark, given, labels.plain_name) == name


@pytest.mark.parametrize("given, seconds", [("12.5", 12.5), ("1:02", 62.0), ("1:00:03.2", 3603.2), ("x", 0.0), (None, 0.0), ("a:b", 0.0)])
def test_parse_seconds(spark, given, seconds):
    assert one(spark, given, times.parse_seconds) == pytest.approx(seconds)


def test_parse_user_datetime(spark):
    f = lambda v: str(one(spark, v, times.parse_user_datetime))
    assert f("2026-08-21T10:00:00Z") == "2026-08-21 10:00:00"
    assert f("2026-08-21T10:00:00+07:00") == "2026-08-21 03:00:00"
    assert f("1/2/2026 9:05") == "2026-02-01 09:05:00"
    assert f("09:05 21/08/2026") == "2026-08-21 09:05:00"
    assert f("nope") == "None"


def test_exact_round_is_pythons(spark):
    rnd = random.Random(1)
    xs = [rnd.uniform(0, 5000) for _ in range(3000)] + [k / 1000 for k in range(5, 20000, 10)] + [k / 8 for k in range(200)] + [-1.005, -2.675, 0.285, 1.005]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for places in (1, 2):
        got = [r.y for r in df.select(times.exact_round("x", places).alias("y")).collect()]
        assert got == [round(x, places) for x in xs]


def test_minute_file_name(spark):
    df = spark.sql("select 'Office' d, ' a/b: c ' s, timestamp_ntz'2026-08-21 10:00' t, 'm1' f, cast(null as timestamp_ntz) n")
    r = df.select(text.minute_file_name("d", "s", "t", "f").alias("a"), text.minute_file_name(F.lit(""), F.lit(None), "n", "f").alias("b"),
                  text.minute_file_name("d", F.repeat("d", 200), "t", "f", max_chars=180).alias("c")).first()
    assert (r.a, r.b) == ("Office - BBH - a b c - 21.8.2026.docx", "m1 - BBH.docx")
    assert len(r.c) == 185


def test_voice_suffix_and_access(spark):
    assert one(spark, "A - Voice Speaker - Voice Speaker", labels.without_voice_suffix) == "A"
    assert one(spark, "👤 A", labels.strip_icon) == "A"
    df = spark.sql("select 'u' o, array('System Manager') r")
    got = df.select(labels.can_access("o", F.lit("u")).alias("a"), labels.can_access("o", F.lit("v")).alias("b"), labels.can_access("o", F.lit("v"), F.col("r")).alias("c"),
                    labels.can_access("o", F.lit("Guest"), any_signed_in=True).alias("d")).first()
    assert tuple(got) == (True, False, True, False)
