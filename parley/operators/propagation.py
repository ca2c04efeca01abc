"""Spreading confirmed names over a transcript by rules and votes.

Segments carry the shown ``label`` and the original columns (``raw_speaker``,
``speaker``, ``speaker_id``, ``chunk``, …). Rules are (meeting, key, name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ordered
from ..functions import labels, text, times, vectors
from ..session import cut_lineage
from . import matching, shaping, voices

M = ["meeting"]
MIN_SAMPLE_SEC = 2.0


def _sources(df: DataFrame) -> list[str]:
    return [c for c in ("source_speaker", "speaker_id", "source") if c in df.columns]


def source_key(df: DataFrame, label: str | Column = "label") -> Column:
    return labels.source_key(_sources(df), text.col(label))


def with_raw_label(segments: DataFrame) -> DataFrame:
    """Add ``raw_label``: the written raw label, else a numbered stranger per source."""
    spoken = F.col("raw_speaker") if "raw_speaker" in segments.columns else F.lit(None).cast("string")
    source = F.coalesce(*[text.filled(c) for c in _sources(segments)], F.concat(F.lit("segment_"), (F.col("idx") + 1).cast("string")))
    rows = segments.withColumn("_stated", labels.stated_raw_label(spoken, "speaker")).withColumn("_src", source)
    firsts = rows.where("_stated is null").groupBy("meeting", "_src").agg(F.min("idx").alias("_first"))
    numbered = ordered.number_rows(firsts, M, "_first", name="_no", start=1).select("meeting", "_src", "_no")
    stranger = F.concat(F.lit("👤 Speaker "), F.col("_no").cast("string"), F.lit(" ["), F.col("_src"), F.lit("]"))
    return (rows.join(numbered, ["meeting", "_src"], "left").withColumn("raw_label", F.coalesce("_stated", stranger))
            .drop("_stated", "_src", "_no"))


def reset_labels(segments: DataFrame) -> DataFrame:
    """Every label back to its raw form; ``changed`` marks rows it touched."""
    rows = with_raw_label(segments)
    now = text.strip(F.coalesce("label", F.lit("")))
    return rows.withColumn("changed", now != F.col("raw_label")).withColumn("label", F.col("raw_label"))


def rules_from_mapping(segments: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rules from (meeting, label, new_label): for the source of each mapped row and for the label itself."""
    new = mapping.select("meeting", text.strip("label").alias("_l"), text.filled("new_label").alias("name")).where("name is not null")
    rows = segments.withColumn("_l", text.strip(F.coalesce("label", F.lit("")))).join(new, ["meeting", "_l"])
    return _keyed(rows, source_key(rows, "_l"), F.concat(F.lit("label:"), F.col("_l")))


def rules_from_segments(segments: DataFrame, picks: DataFrame) -> DataFrame:
    """Rules from single confirmed rows: (meeting, idx, name)."""
    new = picks.select("meeting", "idx", text.filled("name").alias("name")).where("name is not null")
    rows = segments.withColumn("_l", text.strip(F.coalesce("label", F.lit("")))).join(new, ["meeting", "idx"])
    return _keyed(rows, source_key(rows, "_l"), F.when(F.col("_l") != "", F.concat(F.lit("label:"), F.col("_l"))))


def _keyed(rows: DataFrame, *keys: Column) -> DataFrame:
    each = rows.select("meeting", "idx", "name", F.explode(F.array_compact(F.array(*[F.nullif(k, F.lit("")) for k in keys]))).alias("key"))
    return each.groupBy("meeting", "key").agg(F.max_by("name", "idx").alias("name"))


def edited_rows(segments: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows whose shown name was set by hand: a known name that differs from the raw label."""
    rows = voices.normalize_names(with_raw_label(segments), "label", aliases)
    return rows.where(~labels.is_unknown("canonical") & (F.col("canonical") != F.col("raw_label")))


def rules_from_labels(segments: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rules from edited labels, by source."""
    rows = edited_rows(segments, aliases).withColumn("name", F.col("canonical"))
    return _keyed(rows, source_key(rows, "name"))


def longest_edited(segments: DataFrame, aliases: DataFrame) -> DataFrame:
    """Longest edited row of every name, the candidate voice sample."""
    rows = edited_rows(segments, aliases).withColumn("d", times.segment_duration("start", "end")).where("d > 0")
    return rows.groupBy("meeting", F.col("canonical").alias("name")).agg(
        F.max_by("idx", F.struct("d", (-F.col("idx")).alias("i"))).alias("idx"), F.min("idx").alias("first_idx"))


def apply_rules(segments: DataFrame, rules: DataFrame) -> DataFrame:
    """Set labels by rule, source before label; ``ruled`` marks rows that changed."""
    now = text.strip(F.coalesce("label", F.lit("")))
    rows = segments.withColumn("_l", now)
    rows = rows.withColumn("_k1", source_key(rows, "_l")).withColumn("_k2", F.concat(F.lit("label:"), F.col("_l")))
    r1 = rules.select("meeting", F.col("key").alias("_k1"), F.col("name").alias("_n1"))
    r2 = rules.select("meeting", F.col("key").alias("_k2"), F.col("name").alias("_n2"))
    new = F.coalesce("_n1", "_n2")
    return (rows.join(r1, ["meeting", "_k1"], "left").join(r2, ["meeting", "_k2"], "left")
            .withColumn("ruled", F.coalesce(new != F.col("_l"), F.lit(False))).withColumn("label", F.coalesce(new, "label"))
            .drop("_l", "_k1", "_k2", "_n1", "_n2"))


def ruled_counts(segments: DataFrame) -> DataFrame:
    """Rows changed by rules per name."""
    return segments.where("ruled").groupBy("meeting", F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def apply_names(segments: DataFrame, names: DataFrame) -> DataFrame:
    """Names by speaker id; rows of other ids keep their label. ``matched`` marks named rows."""
    new = names.select("meeting", "speaker_id", F.col("name").alias("_n"))
    return (segments.join(new, ["meeting", "speaker_id"], "left").withColumn("matched", F.col("_n").isNotNull())
            .withColumn("label", F.coalesce("_n", "label")).drop("_n"))


def preserved_ids(segments: DataFrame, names: DataFrame) -> DataFrame:
    """Speaker ids (or single rows without one) that no name was given for."""
    who = F.coalesce("speaker_id", F.concat(F.lit("segment:"), F.col("idx").cast("string")))
    rest = segments.join(names.select("meeting", "speaker_id"), ["meeting", "speaker_id"], "left_anti")
    return rest.select("meeting", who.alias("id")).distinct()


def restore_known(segments: DataFrame, previous: str = "previous_label") -> DataFrame:
    """Put back known names after a reset; ``restored`` marks rows it touched."""
    known = ~labels.is_unknown(previous)
    back = known & (text.strip(F.coalesce("label", F.lit(""))) != F.col(previous))
    return segments.withColumn("restored", F.coalesce(back, F.lit(False))).withColumn(
        "label", F.when(known, F.col(previous)).otherwise(F.col("label")))


def source_winners(segments: DataFrame, key: Column) -> DataFrame:
    """Most frequent known label of the matched rows of each key; ties go to the label seen first."""
    votes = (segments.where(F.col("matched") & ~labels.is_unknown("label")).select("meeting", "idx", text.strip("label").alias("label"), key.alias("key"))
             .where(F.col("key") != "").groupBy("meeting", "key", "label").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first")))
    return votes.groupBy("meeting", "key").agg(F.max_by("label", F.struct("n", (-F.col("first")).alias("f"))).alias("winner"))


def inherit_names(segments: DataFrame) -> DataFrame:
    """Unmatched, unnamed rows take the winner of their source, else of their chunk.

    Known labels are never changed. ``inherited`` marks rows that were filled.
    """
    chunks = [c for c in ("source_chunk", "chunk") if c in segments.columns]
    ck = labels.chunk_key(*chunks) if chunks else F.lit("")
    rows = segments.withColumn("_sk", source_key(segments)).withColumn("_ck", ck)
    by_source = source_winners(rows, F.col("_sk")).select("meeting", F.col("key").alias("_sk"), F.col("winner").alias("_w1"))
    by_chunk = source_winners(rows, F.col("_ck")).select("meeting", F.col("key").alias("_ck"), F.col("winner").alias("_w2"))
    open_ = ~F.col("matched") & labels.is_unknown("label")
    winner = F.coalesce("_w1", "_w2")
    return (rows.join(by_source, ["meeting", "_sk"], "left").join(by_chunk, ["meeting", "_ck"], "left")
            .withColumn("inherited", open_ & winner.isNotNull())
            .withColumn("label", F.when(open_, F.coalesce(winner, "label")).otherwise(F.col("label"))).drop("_sk", "_ck", "_w1", "_w2"))


def dominant_ids(segments: DataFrame, aliases: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Speaker id that says most of the words shown under each name."""
    rows = voices.normalize_names(segments, "label", aliases).where(F.coalesce("speaker_id", F.lit("")) != "")
    weight = rows.groupBy("meeting", F.col("canonical").alias("name"), "speaker_id").agg(
        F.sum(text.word_count("text")).alias("words"), F.min("idx").alias("first"))
    if names is not None:
        weight = weight.join(names.select("meeting", "name"), ["meeting", "name"], "left_semi")
    else:
        weight = weight.where(~labels.is_unknown("name"))
    return weight.groupBy("meeting", "name").agg(
        F.max_by("speaker_id", F.struct("words", (-F.col("first")).alias("f"))).alias("speaker_id"), F.min("first").alias("first_idx"))


def spread_over_clusters(dominant: DataFrame, mapping: DataFrame) -> DataFrame:
    """Name of every speaker id that shares a voice cluster with a name's dominant id; later names win."""
    m = mapping.select("meeting", "speaker_id", "cluster")
    peers = dominant.join(m, ["meeting", "speaker_id"]).select("meeting", "cluster", "name", "first_idx").join(m, ["meeting", "cluster"])
    both = dominant.select("meeting", "speaker_id", "name", "first_idx").unionByName(peers.select("meeting", "speaker_id", "name", "first_idx"))
    return both.groupBy("meeting", "speaker_id").agg(F.max_by("name", F.struct("first_idx", "name")).alias("name"))


def samples_to_enrol(segments: DataFrame, mapping: DataFrame, gallery: DataFrame,
                     min_sec: float = MIN_SAMPLE_SEC) -> DataFrame:
    """Longest row of each mapped label and what to do with it: enrol, skipped (known voice) or too_short."""
    rows = mapping.select("meeting", "label", F.col("new_label").alias("name")).join(
        segments.select("meeting", "idx", "label", times.segment_duration("start", "end").alias("d")), ["meeting", "label"], "left")
    best = rows.groupBy("meeting", "label", "name").agg(F.max_by(F.struct("idx", "d"), F.struct("d", (-F.col("idx")).alias("i"))).alias("b"))
    known = gallery.where("embedding is not null").select(F.col("name")).distinct().withColumn("_known", F.lit(True))
    short = F.coalesce(F.col("b.d"), F.lit(0.0)) < min_sec
    status = F.when(short, "too_short").when(F.col("_known"), "skipped").otherwise("enrol")
    return best.join(known, "name", "left").select("meeting", "label", "name", F.when(~short, F.col("b.idx")).alias("idx"), status.alias("status"))


def match_segments(segments: DataFrame, gallery: DataFrame, aliases: DataFrame, dims: int = voices.DIMS,
                   threshold: float = voices.ACCEPT) -> DataFrame:
    """Label every row whose own vector has an accepted match; ``matched`` marks them."""
    # Matching is the costly step and its result is small, so that is what is kept.
    hits = cut_lineage(voices.top_match(segments.select("meeting", "idx", "embedding"), gallery, aliases, ["meeting", "idx"],
                                        threshold=threshold, dims=dims))
    return (segments.join(hits.select("meeting", "idx", F.col("name").alias("_n")), ["meeting", "idx"], "left")
            .withColumn("matched", F.col("_n").isNotNull()).withColumn("label", F.coalesce("_n", "label")).drop("_n"))


def rescan(segments: DataFrame, gallery: DataFrame, aliases: DataFrame, rules: DataFrame, dims: int = voices.DIMS,
           threshold: float = voices.ACCEPT) -> DataFrame:
    """Reset labels, match every row, inherit by votes, then apply confirmed rules."""
    return apply_rules(inherit_names(match_segments(reset_labels(segments), gallery, aliases, dims, threshold)), rules)


def rescan_from_labels(segments: DataFrame, aliases: DataFrame, mapping: DataFrame) -> DataFrame:
    """Spread hand-set names: to their source, to ids of the same voice cluster, by votes and rules; then join turns."""
    rules = cut_lineage(rules_from_labels(segments, aliases))
    dominant = dominant_ids(segments, aliases, longest_edited(segments, aliases))
    by_id = cut_lineage(spread_over_clusters(dominant, mapping))
    rows = reset_labels(segments.withColumn("previous_label", text.strip(F.coalesce("label", F.lit("")))))
    rows = apply_names(restore_known(rows), by_id)
    return shaping.merge_same_label(apply_rules(inherit_names(cut_lineage(rows)), rules))


def sample_vectors(segments: DataFrame, aliases: DataFrame, mapping: DataFrame, clusters: DataFrame,
                   dims: int = voices.DIMS) -> DataFrame:
    """Voice of each hand-set name: its cluster's centroid, else its source's robust centroid, else its longest row's vector."""
    names = cut_lineage(longest_edited(segments, aliases))
    dominant = cut_lineage(dominant_ids(segments, aliases, names).select("meeting", "name", "speaker_id"))
    by_cluster = (dominant.join(mapping, ["meeting", "speaker_id"]).join(clusters.select("meeting", "cluster", "centroid"), ["meeting", "cluster"])
                  .select("meeting", "name", F.col("centroid").alias("_v1")))
    said = segments.join(dominant.select("meeting", "speaker_id").distinct(), ["meeting", "speaker_id"], "left_semi")
    centre = voices.robust_centroid(said, ["meeting", "speaker_id"], dims=dims)
    by_source = dominant.join(centre, ["meeting", "speaker_id"]).select("meeting", "name", F.col("embedding").alias("_v2"))
    long = segments.where((F.col("end") - F.col("start") >= MIN_SAMPLE_SEC) & F.col("embedding").isNotNull())
    by_row = names.join(long, ["meeting", "idx"]).select("meeting", "name", vectors.unit("embedding").alias("_v3"))
    key = ["meeting", "name"]
    return (names.select(*key).join(by_cluster, key, "left").join(by_source, key, "left").join(by_row, key, "left")
            .select(*key, F.when(F.col("_v1").isNotNull(), "cluster").when(F.col("_v2").isNotNull(), "source")
                    .when(F.col("_v3").isNotNull(), "row").otherwise("none").alias("origin"), F.coalesce("_v1", "_v2", "_v3").alias("embedding")))
