"""Rules, votes and rescans on small transcripts."""

import random

from pyspark.sql import functions as F

from parley.functions import labels as lab
from parley.operators import propagation as L

SEG = "meeting string, idx long, start double, end double, label string, speaker string, speaker_id string, chunk int, text string"


def make(spark, rows):
    return spark.createDataFrame([("m", i, float(i), float(i) + d, l, s, sid, c, t) for i, (d, l, s, sid, c, t) in enumerate(rows)], SEG)


def no_alias(spark):
    return spark.createDataFrame([("An", "An"), ("An - Voice Speaker", "An")], "alias string, canonical string")


def test_reset_numbers_unnamed_sources(spark):
    df = make(spark, [(1, "An", "", "c0_a", 0, "x"), (1, "An", "👤 Bình", "c0_b", 0, "x"), (1, "An", "👤 Speaker 4", "c0_c", 0, "x"), (1, "An", None, "c1_a", 1, "x"), (1, "An", "", "c0_a", 0, "x"), (1, "An", "", None, 0, "x")])
    out = [r.label for r in L.reset_labels(df).orderBy("idx").collect()]
    assert out == ["👤 Speaker 1 [c0_a]", "Bình", "👤 Speaker 4", "👤 Speaker 2 [c1_a]", "👤 Speaker 1 [c0_a]", "👤 Speaker 3 [segment_6]"]


def test_last_rule_wins_and_source_comes_first(spark):
    df = make(spark, [(1, "Speaker 1", "Speaker 1", "a", 0, "x"), (1, "Speaker 2", "Speaker 2", "a", 0, "x"), (1, "Speaker 2", "Speaker 2", "b", 0, "x"), (1, "Cúc", "Cúc", "d", 0, "x")])
    mapping = spark.createDataFrame([("m", "Speaker 1", "An"), ("m", "Speaker 2", " Bình ")], "meeting string, label string, new_label string")
    rules = L.rules_from_mapping(df, mapping)
    assert {(r.key, r.name) for r in rules.collect()} == {("source:a", "Bình"), ("source:b", "Bình"), ("label:Speaker 1", "An"), ("label:Speaker 2", "Bình")}
    out = L.apply_rules(df, rules).orderBy("idx").collect()
    assert [(r.label, r.ruled) for r in out] == [("Bình", True), ("Bình", True), ("Bình", True), ("Cúc", False)]


def test_inheritance_never_changes_a_known_label(spark):
    rnd = random.Random(3)
    rows = [(1, rnd.choice(["An", "Bình", "Speaker 1", "", "👤 Người lạ 2"]), "s", f"c{i // 10}_s{rnd.randint(0, 2)}", i // 10, "x") for i in range(60)]
    df = make(spark, rows).withColumn("matched", (F.col("idx") % 3 == 0) & ~lab.is_unknown("label"))
    before = {r.idx: r for r in df.collect()}
    after = {r.idx: r for r in L.inherit_names(df).collect()}
    votes, chunk_votes = {}, {}
    for i, r in sorted(before.items()):
        if r.matched:
            votes.setdefault(r.speaker_id, {}).setdefault(r.label, []).append(i)
            chunk_votes.setdefault(r.chunk, {}).setdefault(r.label, []).append(i)
    top = lambda v: min(v.items(), key=lambda kv: (-len(kv[1]), kv[1][0]))[0] if v else None
    for i, r in before.items():
        if r.label in ("An", "Bình"):
            assert after[i].label == r.label
        else:
            assert after[i].label == (top(votes.get(r.speaker_id)) or top(chunk_votes.get(r.chunk)) or r.label)


def test_reset_then_restore_keeps_names(spark):
    df = make(spark, [(1, "An", "Speaker 1", "a", 0, "x"), (1, "Speaker 9", "Speaker 1", "a", 0, "x")]).withColumn("previous_label", F.col("label"))
    out = L.restore_known(L.reset_labels(df)).orderBy("idx").collect()
    assert [(r.label, r.restored) for r in out] == [("An", True), ("Speaker 1", False)]


def test_rescan_from_labels_spreads_an_edited_name(spark):
    rows = [(3, "👤 An - Voice Speaker", "Speaker 1", "c0_a", 0, "một hai ba"), (1, "Speaker 1", "Speaker 1", "c0_a", 0, "bốn"), (1, "Speaker 2", "Speaker 2", "c0_b", 0, "năm"),
            (1, "Speaker 3", "Speaker 3", "c1_a", 1, "sáu"), (2, "Cúc", "Cúc", "c1_c", 1, "bảy"), (1, "Speaker 4", "Speaker 4", "c2_d", 2, "tám")]
    df = make(spark, rows)
    mapping = spark.createDataFrame([("m", "c0_a", 1), ("m", "c1_a", 1), ("m", "c0_b", 2)], "meeting string, speaker_id string, cluster long")
    out = L.rescan_from_labels(df, no_alias(spark), mapping).orderBy("idx").collect()
    # c0_a and its cluster peer c1_a are named; c0_b inherits from its chunk; the confirmed name and the lone stranger stay
    assert [(r.label, r.text) for r in out] == [("An", "một hai ba bốn năm sáu"), ("Cúc", "bảy"), ("Speaker 4", "tám")]


def test_sample_vectors_fall_back_in_order(spark):
    rows = [(3, "An", "Speaker 1", "a", 0, "x"), (3, "Bình", "Speaker 2", "b", 0, "x"), (3, "Cúc", "Speaker 3", None, 0, "x"), (3, "Dũng", "Speaker 4", None, 0, "x")]
    df = make(spark, rows).withColumn("embedding", F.when(F.col("idx") < 3, F.array(*[F.lit(float(x)) for x in (3, 4)])))
    mapping = spark.createDataFrame([("m", "a", 7)], "meeting string, speaker_id string, cluster long")
    clusters = spark.createDataFrame([("m", 7, [1.0, 0.0])], "meeting string, cluster long, centroid array<double>")
    out = {r.name: (r.origin, r.embedding) for r in L.sample_vectors(df, no_alias(spark), mapping, clusters, dims=2).collect()}
    assert {k: v[0] for k, v in out.items()} == {"An": "cluster", "Bình": "source", "Cúc": "row", "Dũng": "none"}
    assert out["An"][1] == [1.0, 0.0] and [round(x, 6) for x in out["Cúc"][1]] == [0.6, 0.8] and out["Dũng"][1] is None
