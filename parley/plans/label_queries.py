"""Spreading names over the conversation table."""

from pyspark.sql import functions as F

from ..operators import propagation as L
from ..operators import voices as V
from . import proxies as P
from .proxies import DIMS, with_ctes
from .registry import query
from .shaping_queries import SAME
from .voice_queries import ROBUST, SUMMARY, UNIT, by_voice, probe_vec, summary


def turns(spark, sf):
    """Turns whose written speaker is missing for assistants, so a numbered stranger stands in."""
    seg = P.segments(spark, sf)
    return seg.withColumn("speaker", F.when(F.col("speaker") == "Speaker 2", "").otherwise(F.col("speaker"))).select(
        "meeting", "idx", "chunk", "start", "end", "speaker", "speaker_id", "label", "text", "conv_id")


TURNS = """
tn0 AS (SELECT meeting, idx, chunk, start, "end", CASE WHEN speaker = 'Speaker 2' THEN '' ELSE speaker END AS speaker, speaker_id, label, text, conv_id FROM seg),
st AS (SELECT meeting, speaker_id, row_number() OVER (PARTITION BY meeting ORDER BY min(idx)) AS no FROM tn0 WHERE speaker = '' GROUP BY meeting, speaker_id),
tn AS (SELECT tn0.*, CASE WHEN speaker <> '' THEN speaker ELSE '👤 Speaker ' || no || ' [' || speaker_id || ']' END AS raw_label, 'source:' || speaker_id AS sk FROM tn0 LEFT JOIN st USING (meeting, speaker_id))"""
# A known shown name, without icon and address.
NAMED = """
nm AS (SELECT *, CASE label WHEN '👤 Nguyễn An' THEN 'Nguyễn An' WHEN '👤 Trần Bình (binh@x.vn)' THEN 'Trần Bình' END AS name FROM tn)"""


def aliases(spark, sf):
    r = P.table(spark, sf, "region")
    names = r.select(F.when(F.col("r_regionkey") == 0, "Trần Bình (binh@x.vn)").otherwise(F.col("r_name")).alias("alias"),
                     F.when(F.col("r_regionkey") == 0, "Trần Bình").otherwise(F.col("r_name")).alias("canonical"))
    return names


def mapping(seg):
    return seg.select("meeting", F.lit("👤 Speaker 1").alias("label"), F.lit(" Lê Chi ").alias("new_label")).distinct()


@query("reset_labels", with_ctes("seg") + "," + TURNS + " SELECT meeting, idx, raw_label AS label, label <> raw_label AS changed FROM tn")
def _(spark, sf):
    return L.reset_labels(turns(spark, sf)).select("meeting", "idx", "label", "changed")


MAP_RULES = """
mr AS (SELECT DISTINCT meeting, unnest([sk, 'label:' || label]) AS key, 'Lê Chi' AS name FROM tn WHERE label = '👤 Speaker 1')"""


@query("rules_from_mapping", with_ctes("seg") + "," + TURNS + "," + MAP_RULES + " SELECT * FROM mr")
def _(spark, sf):
    seg = turns(spark, sf)
    return L.rules_from_mapping(seg, mapping(seg))


@query("rules_from_segments", with_ctes("seg") + "," + TURNS + """
SELECT meeting, unnest(CASE WHEN label = '' THEN [sk] ELSE [sk, 'label:' || label] END) AS key, 'Phạm Dũng' AS name FROM tn WHERE idx = 0""")
def _(spark, sf):
    seg = turns(spark, sf)
    picks = seg.groupBy("meeting").agg(F.min("idx").alias("idx")).withColumn("name", F.lit("Phạm Dũng "))
    return L.rules_from_segments(seg, picks)


@query("rules_from_labels", with_ctes("seg") + "," + TURNS + "," + NAMED + " SELECT meeting, sk AS key, arg_max(name, idx) AS name FROM nm WHERE name IS NOT NULL GROUP BY meeting, sk")
def _(spark, sf):
    return L.rules_from_labels(turns(spark, sf), aliases(spark, sf))


LONGEST = """
lo AS (SELECT meeting, name, arg_max(idx, ("end" - start, -idx)) AS idx, min(idx) AS first_idx FROM nm WHERE name IS NOT NULL AND "end" > start GROUP BY meeting, name)"""


@query("longest_edited_turns", with_ctes("seg") + "," + TURNS + "," + NAMED + "," + LONGEST + " SELECT * FROM lo")
def _(spark, sf):
    return L.longest_edited(turns(spark, sf), aliases(spark, sf))


@query("apply_rules", with_ctes("seg") + "," + TURNS + "," + MAP_RULES + """
SELECT tn.meeting, idx, coalesce(a.name, b.name, label) AS label, coalesce(coalesce(a.name, b.name) <> label, FALSE) AS ruled
FROM tn LEFT JOIN mr a ON a.meeting = tn.meeting AND a.key = sk LEFT JOIN mr b ON b.meeting = tn.meeting AND b.key = 'label:' || label""")
def _(spark, sf):
    seg = turns(spark, sf)
    return L.apply_rules(seg, L.rules_from_mapping(seg, mapping(seg))).select("meeting", "idx", "label", "ruled")


@query("ruled_counts", with_ctes("seg") + "," + TURNS + "," + MAP_RULES + """
SELECT tn.meeting, 'Lê Chi' AS name, count(*) AS n FROM tn LEFT JOIN mr a ON a.meeting = tn.meeting AND a.key = sk LEFT JOIN mr b ON b.meeting = tn.meeting AND b.key = 'label:' || label
WHERE coalesce(a.name, b.name) IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    seg = turns(spark, sf)
    return L.ruled_counts(L.apply_rules(seg, L.rules_from_mapping(seg, mapping(seg))))


DOMINANT = """
dw AS (SELECT meeting, name, speaker_id, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) AS w, min(idx) AS f FROM nm WHERE name IS NOT NULL GROUP BY ALL),
dm AS (SELECT meeting, name, arg_max(speaker_id, (w, -f)) AS speaker_id, min(f) AS first_idx FROM dw GROUP BY meeting, name)"""


@query("dominant_ids", with_ctes("seg") + "," + TURNS + "," + NAMED + "," + DOMINANT + " SELECT * FROM dm")
def _(spark, sf):
    return L.dominant_ids(turns(spark, sf), aliases(spark, sf))


@query("apply_names", with_ctes("seg") + "," + TURNS + "," + NAMED + "," + DOMINANT + """,
d1 AS (SELECT meeting, speaker_id, any_value(name) AS name FROM dm GROUP BY ALL)
SELECT tn.meeting, idx, coalesce(d1.name, label) AS label, d1.name IS NOT NULL AS matched FROM tn LEFT JOIN d1 USING (meeting, speaker_id)""")
def _(spark, sf):
    seg = turns(spark, sf)
    return L.apply_names(seg, L.dominant_ids(seg, aliases(spark, sf))).select("meeting", "idx", "label", "matched")


@query("preserved_ids", with_ctes("seg") + "," + TURNS + "," + NAMED + "," + DOMINANT + " SELECT DISTINCT meeting, speaker_id AS id FROM tn WHERE (meeting, speaker_id) NOT IN (SELECT (meeting, speaker_id) FROM dm)")
def _(spark, sf):
    seg = turns(spark, sf)
    return L.preserved_ids(seg, L.dominant_ids(seg, aliases(spark, sf)))


@query("restore_known_labels", with_ctes("seg") + "," + TURNS + """
SELECT meeting, idx, CASE WHEN label = '' OR label LIKE '%Speaker%' THEN raw_label ELSE label END AS label, NOT (label = '' OR label LIKE '%Speaker%') AS restored FROM tn""")
def _(spark, sf):
    seg = turns(spark, sf)
    return L.restore_known(L.reset_labels(seg.withColumn("previous_label", F.col("label")))).select("meeting", "idx", "label", "restored")


INHERIT = """
mx AS (SELECT *, text LIKE '%e' AS matched, CASE WHEN text LIKE '%e' AND label = '👤 Speaker 1' THEN 'Lê Chi' ELSE label END AS l FROM tn),
v1 AS (SELECT meeting, sk, l, count(*) AS n, min(idx) AS f FROM mx WHERE matched AND NOT (l = '' OR l LIKE '%Speaker%') GROUP BY ALL), w1 AS (SELECT meeting, sk, arg_max(l, (n, -f)) AS w FROM v1 GROUP BY ALL),
v2 AS (SELECT meeting, chunk, l, count(*) AS n, min(idx) AS f FROM mx WHERE matched AND NOT (l = '' OR l LIKE '%Speaker%') GROUP BY ALL), w2 AS (SELECT meeting, chunk, arg_max(l, (n, -f)) AS w FROM v2 GROUP BY ALL)"""


@query("inherit_names", with_ctes("seg") + "," + TURNS + "," + INHERIT + """
SELECT mx.meeting, idx, CASE WHEN NOT matched AND (l = '' OR l LIKE '%Speaker%') THEN coalesce(w1.w, w2.w, l) ELSE l END AS label,
  NOT matched AND (l = '' OR l LIKE '%Speaker%') AND coalesce(w1.w, w2.w) IS NOT NULL AS inherited
FROM mx LEFT JOIN w1 ON w1.meeting = mx.meeting AND w1.sk = mx.sk LEFT JOIN w2 ON w2.meeting = mx.meeting AND w2.chunk = mx.chunk""")
def _(spark, sf):
    seg = turns(spark, sf).withColumn("matched", F.col("text").endswith("e"))
    seg = seg.withColumn("label", F.when(F.col("matched") & (F.col("label") == "👤 Speaker 1"), "Lê Chi").otherwise(F.col("label")))
    return L.inherit_names(seg).select("meeting", "idx", "label", "inherited")


@query("spread_over_clusters", with_ctes("voice") + """,
m AS (SELECT DISTINCT meeting, speaker_id, voice AS cluster FROM voice), d AS (SELECT meeting, voice, arg_min(speaker_id, idx) AS speaker_id, 'người ' || voice AS name FROM voice GROUP BY ALL)
SELECT m.meeting, m.speaker_id, d.name FROM d JOIN m ON m.meeting = d.meeting AND m.cluster = d.voice""")
def _(spark, sf):
    v = probe_vec(spark, sf)
    clusters = v.select("meeting", "speaker_id", F.col("voice").alias("cluster")).distinct()
    dominant = v.groupBy("meeting", "voice").agg(F.min_by("speaker_id", "idx").alias("speaker_id"), F.min("idx").alias("first_idx")).select(
        "meeting", F.concat(F.lit("người "), F.col("voice").cast("string")).alias("name"), "speaker_id", "first_idx")
    return L.spread_over_clusters(dominant, clusters)


@query("samples_to_enrol", with_ctes("voice", "gal") + """,
b AS (SELECT meeting, label, voice, arg_max(idx, ("end" - start, -idx)) AS i, max("end" - start) AS d FROM voice GROUP BY ALL)
SELECT meeting, label, CASE WHEN voice % 2 = 0 THEN 'voice_' || voice || '_1' ELSE 'mới ' || voice END AS name, CASE WHEN d >= 2.4 THEN i END AS idx,
  CASE WHEN d < 2.4 THEN 'too_short' WHEN voice % 2 = 0 THEN 'skipped' ELSE 'enrol' END AS status FROM b""")
def _(spark, sf):
    v = probe_vec(spark, sf)
    n = F.col("voice").cast("string")
    name = F.when(F.col("voice") % 2 == 0, F.concat(F.lit("voice_"), n, F.lit("_1"))).otherwise(F.concat(F.lit("mới "), n))
    return L.samples_to_enrol(v, v.select("meeting", "label", name.alias("new_label")).distinct(), P.gallery(spark, sf), min_sec=2.4)


@query("rescan_meetings", with_ctes("voice", "gal") + """,
sim AS (SELECT v.meeting, v.idx, g.name, list_cosine_similarity(v.embedding, g.embedding) AS score FROM voice v, gal g),
hit AS (SELECT meeting, idx, arg_max(name, score) AS name FROM sim GROUP BY ALL HAVING max(score) >= 0.3),
mx AS (SELECT v.*, 'source:' || v.speaker_id AS sk, h.name IS NOT NULL AS matched, coalesce(h.name, v.speaker) AS l FROM voice v LEFT JOIN hit h USING (meeting, idx)),
v1 AS (SELECT meeting, sk, l, count(*) AS n, min(idx) AS f FROM mx WHERE matched GROUP BY ALL), w1 AS (SELECT meeting, sk, arg_max(l, (n, -f)) AS w FROM v1 GROUP BY ALL),
v2 AS (SELECT meeting, chunk, l, count(*) AS n, min(idx) AS f FROM mx WHERE matched GROUP BY ALL), w2 AS (SELECT meeting, chunk, arg_max(l, (n, -f)) AS w FROM v2 GROUP BY ALL)
SELECT mx.meeting, mx.idx, CASE WHEN voice = 0 THEN 'Lê Chi' WHEN matched THEN l ELSE coalesce(w1.w, w2.w, l) END AS label, matched
FROM mx LEFT JOIN w1 ON w1.meeting = mx.meeting AND w1.sk = mx.sk LEFT JOIN w2 ON w2.meeting = mx.meeting AND w2.chunk = mx.chunk""")
def _(spark, sf):
    v = probe_vec(spark, sf)
    g = P.gallery(spark, sf)
    rules = v.where("voice = 0").select("meeting", F.concat(F.lit("source:"), "speaker_id").alias("key"), F.lit("Lê Chi").alias("name")).distinct()
    return L.rescan(v, g, V.alias_table(g), rules, DIMS, threshold=0.3).select("meeting", "idx", "label", "matched")


UNNAMED = "(l = '' OR l LIKE '%Speaker%')"


@query("rescan_from_labels", with_ctes("seg") + "," + TURNS + "," + NAMED + "," + LONGEST + "," + DOMINANT + f""",
ru AS (SELECT meeting, sk, arg_max(name, idx) AS name FROM nm WHERE name IS NOT NULL GROUP BY meeting, sk),
do_ AS (SELECT dm.* FROM dm SEMI JOIN lo USING (meeting, name)),
cs AS (SELECT DISTINCT meeting, speaker_id, CASE WHEN speaker_id LIKE '%1' THEN 1 ELSE 2 END AS cluster FROM tn),
sp AS (SELECT meeting, speaker_id, name, first_idx FROM do_
  UNION ALL SELECT b.meeting, b.speaker_id, name, first_idx FROM do_ JOIN cs a USING (meeting, speaker_id) JOIN cs b ON b.meeting = a.meeting AND b.cluster = a.cluster),
ids AS (SELECT meeting, speaker_id, arg_max(name, (first_idx, name)) AS name FROM sp GROUP BY ALL),
mx AS (SELECT tn.* EXCLUDE (label), ids.name IS NOT NULL AS matched, coalesce(ids.name, CASE WHEN label = '' OR label LIKE '%Speaker%' THEN raw_label ELSE label END) AS l FROM tn LEFT JOIN ids USING (meeting, speaker_id)),
w1 AS (SELECT meeting, sk, arg_max(l, (n, -f)) AS w FROM (SELECT meeting, sk, l, count(*) AS n, min(idx) AS f FROM mx WHERE matched AND NOT {UNNAMED} GROUP BY ALL) GROUP BY ALL),
w2 AS (SELECT meeting, chunk, arg_max(l, (n, -f)) AS w FROM (SELECT meeting, chunk, l, count(*) AS n, min(idx) AS f FROM mx WHERE matched AND NOT {UNNAMED} GROUP BY ALL) GROUP BY ALL),
ih AS (SELECT mx.*, CASE WHEN NOT matched AND {UNNAMED} THEN coalesce(w1.w, w2.w, l) ELSE l END AS l2 FROM mx
  LEFT JOIN w1 ON w1.meeting = mx.meeting AND w1.sk = mx.sk LEFT JOIN w2 ON w2.meeting = mx.meeting AND w2.chunk = mx.chunk),
fin AS (SELECT ih.* EXCLUDE (l, l2), coalesce(ru.name, l2) AS label FROM ih LEFT JOIN ru ON ru.meeting = ih.meeting AND ru.sk = ih.sk),""" + SAME.replace("FROM seg)", "FROM fin)")
       + ' SELECT meeting, idx, start, "end", label, text, parts FROM sg')
def _(spark, sf):
    seg = turns(spark, sf)
    clusters = seg.select("meeting", "speaker_id", F.when(F.col("speaker_id").endswith("1"), 1).otherwise(2).alias("cluster")).distinct()
    return L.rescan_from_labels(seg, aliases(spark, sf), clusters).select("meeting", "idx", "start", "end", "label", "text", "parts")


@query("sample_vectors_for_names", with_ctes("voice") + "," + ROBUST.replace("cs AS (", "unused AS (") + """,
v0 AS (SELECT meeting, voice, arg_min(embedding, idx) AS v, 'cluster' AS origin FROM voice WHERE voice < 3 GROUP BY meeting, voice
  UNION ALL SELECT meeting, CAST(substr(id, 9) AS INTEGER), """ + UNIT.format("e") + """, 'source' FROM c0 WHERE CAST(substr(id, 9) AS INTEGER) >= 3),
v1 AS (SELECT meeting, 'người ' || voice AS name, origin, v AS e FROM v0)
SELECT meeting, name, origin, """ + SUMMARY + " FROM v1")
def _(spark, sf):
    v = by_voice(probe_vec(spark, sf))
    name = F.concat(F.lit("người "), F.col("voice").cast("string"))
    v = v.withColumn("label", name)
    clusters = v.where("voice < 3").groupBy("meeting", F.col("voice").cast("long").alias("cluster")).agg(F.min_by("embedding", "idx").alias("centroid"))
    known = v.where("voice < 3").select("meeting", "speaker_id", F.col("voice").cast("long").alias("cluster")).distinct()
    out = L.sample_vectors(v, V.alias_table(P.gallery(spark, sf)), known, clusters, DIMS)
    return summary(out, "meeting", "name", "origin")
