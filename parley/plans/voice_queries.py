"""Voice vectors over the embedding table.

Its vectors lie far apart, so acceptance thresholds are set lower than usual.
"""

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import matching as G
from ..operators import voices as V
from ..sources import tables as S
from . import proxies as P
from .proxies import DIMS, with_ctes
from .registry import query

SIM = """
sim AS (SELECT v.vec_id, v.meeting, v.idx, v.speaker_id, v.chunk, v.voice, g.name, g.email, list_cosine_similarity(v.embedding, g.embedding) AS score FROM voice v, gal g),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, name) AS rank FROM sim)"""
LABEL_GALLERY = """
lg0 AS (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY ALL),
lgal AS (SELECT 'v' || label AS name, list(x ORDER BY d) AS embedding FROM lg0 GROUP BY label)"""


def probe_vec(spark, sf):
    return P.voices_of(spark, sf)


def summary(df, *keys):
    """A vector as a few numbers that any change of an entry would change."""
    v = F.col("embedding")
    weighted = F.aggregate(F.zip_with(v, F.sequence(F.lit(1), F.lit(DIMS)), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return df.select(*keys, F.round(F.get(v, F.lit(0)), 6).alias("first"), F.round(F.element_at(v, -1), 6).alias("last"), F.round(weighted, 5).alias("weighted"))


UNIT = "list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0})))"
# Mean vector of each speaker of a meeting.
SPEAKERS = """
cs0 AS (SELECT meeting, voice, d, avg(x) AS x FROM (SELECT meeting, voice, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM voice) GROUP BY ALL),
cs AS (SELECT meeting, 'speaker_' || voice AS id, list(x ORDER BY d) AS e FROM cs0 GROUP BY meeting, voice)"""
# Best one-to-one names of the rows of ``cs`` (meeting, id, e): name by name, the best total for each set of ids served so far.
ASSIGN = """
ids AS (SELECT meeting, id, e, row_number() OVER (PARTITION BY meeting ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY meeting) AS n FROM cs),
nms AS (SELECT name, embedding, row_number() OVER (ORDER BY name) AS j FROM gal),
opt AS (SELECT meeting, j, k, id, name, list_cosine_similarity(e, embedding) AS s FROM ids, nms
  UNION ALL SELECT DISTINCT meeting, j, -1, NULL, NULL, 0 FROM ids, nms),
st AS (SELECT DISTINCT meeting, 0::BIGINT AS j, 0::BIGINT AS mask, 0::DOUBLE AS total, []::STRUCT(id VARCHAR, name VARCHAR, s DOUBLE)[] AS picks FROM ids
  UNION ALL
  SELECT st.meeting, st.j + 1, CASE WHEN k < 0 THEN mask ELSE mask | (1::BIGINT << k) END AS after, max(total + s),
    arg_max(CASE WHEN k < 0 THEN picks ELSE list_append(picks, {'id': id, 'name': name, 's': s}) END, total + s)
  FROM st JOIN opt ON opt.meeting = st.meeting AND opt.j = st.j + 1 AND (k < 0 OR (mask >> greatest(k, 0)) & 1 = 0) GROUP BY 1, 2, 3),
one AS (SELECT meeting, unnest(picks, recursive := true) FROM st JOIN (SELECT DISTINCT meeting, n FROM ids) USING (meeting)
  WHERE j = (SELECT max(j) FROM nms) AND mask = (1::BIGINT << n) - 1)"""


SUMMARY = "round(e[1], 6) AS first, round(e[64], 6) AS last, round(list_sum(list_transform(e, lambda x, i: x * i)), 5) AS weighted"


@query("rank_all_names", with_ctes("voice", "gal") + "," + SIM + " SELECT vec_id, name, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk")
def _(spark, sf):
    return V.rank_names(probe_vec(spark, sf), P.gallery(spark, sf), ["vec_id"], floor=-2.0, dims=DIMS).withColumn("score", F.round("score", 6))


@query("identify_voice", with_ctes("voice", "gal") + "," + SIM + " SELECT vec_id, CASE WHEN score >= 0.35 THEN name ELSE 'Speaker' END AS name, round(score, 6) AS score FROM rk WHERE rank = 1")
def _(spark, sf):
    return V.identify(probe_vec(spark, sf), P.gallery(spark, sf), ["vec_id"], threshold=0.35, dims=DIMS).withColumn("score", F.round("score", 6))


@query("identify_ranked", with_ctes("voice", "gal") + "," + SIM + " SELECT vec_id, name, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE score >= 0.3")
def _(spark, sf):
    return V.identify_ranked(probe_vec(spark, sf), P.gallery(spark, sf), ["vec_id"], threshold=0.3, dims=DIMS).withColumn("score", F.round("score", 6))


def with_doubles(g):
    """Gallery with composite duplicates of every name, and its aliases."""
    twice = g.unionByName(g.withColumn("name", F.concat("name", F.lit(" - Voice Speaker"))))
    return twice, V.alias_table(twice)


@query("top_match", with_ctes("voice", "gal") + "," + SIM + " SELECT vec_id, name, round(score, 6) AS score FROM rk WHERE rank = 1 AND score >= 0.3")
def _(spark, sf):
    g, aliases = with_doubles(P.gallery(spark, sf))
    return V.top_match(probe_vec(spark, sf), g, aliases, ["vec_id"], threshold=0.3, dims=DIMS).withColumn("score", F.round("score", 6))


ALLOWED = """
al AS (SELECT DISTINCT meeting, 'voice_' || voice || '_0' AS name FROM voice WHERE voice < 5),
ra AS (SELECT sim.*, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, sim.name) AS r FROM sim JOIN al USING (meeting, name))"""


@query("rank_allowed_names", with_ctes("voice", "gal") + "," + SIM + "," + ALLOWED + " SELECT meeting, vec_id, name, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM ra")
def _(spark, sf):
    v = probe_vec(spark, sf)
    allowed = v.where("voice < 5").select("meeting", F.concat(F.lit("voice_"), F.col("voice").cast("string"), F.lit("_0")).alias("name")).distinct()
    return V.rank_allowed(v, P.gallery(spark, sf), allowed, ["meeting", "vec_id"], dims=DIMS).withColumn("score", F.round("score", 6))


@query("second_pass_match", with_ctes("voice", "gal") + "," + SIM + "," + ALLOWED + """,
f AS (SELECT vec_id, name, score FROM ra WHERE r = 1 AND score >= 0.3 UNION ALL SELECT vec_id, name, score FROM rk WHERE rank = 1 AND score >= 0.3 AND meeting NOT IN (SELECT meeting FROM al)),
s AS (SELECT vec_id, name, score FROM rk WHERE rank = 1 AND score >= 0.3 AND vec_id NOT IN (SELECT vec_id FROM f))
SELECT vec_id, meeting, coalesce(n.name, 'Speaker') AS name, round(coalesce(n.score, 0), 6) AS score FROM voice LEFT JOIN (SELECT * FROM f UNION ALL SELECT * FROM s) n USING (vec_id)""")
def _(spark, sf):
    v = probe_vec(spark, sf)
    g, aliases = with_doubles(P.gallery(spark, sf))
    allowed = v.where("voice < 5").select("meeting", F.concat(F.lit("👤 voice_"), F.col("voice").cast("string"), F.lit("_0 - Voice Speaker")).alias("name")).distinct()
    first = V.top_match(v, g, aliases, ["meeting", "vec_id"], allowed=allowed, threshold=0.3, dims=DIMS)
    return V.second_pass(first, v, g, aliases, ["meeting", "vec_id"], threshold=0.3, dims=DIMS).withColumn("score", F.round("score", 6))


@query("alias_table", with_ctes("gal") + """
SELECT alias, name AS canonical FROM (SELECT name, unnest(CASE WHEN email = 'Chưa cập nhật' THEN [name, name || ' - Voice Speaker']
  ELSE [name, name || ' - Voice Speaker', name || ' - ' || email || ' - Voice Speaker', name || ' - ' || email] END) AS alias FROM gal)""")
def _(spark, sf):
    return V.alias_table(P.gallery(spark, sf))


@query("normalize_requested_names", with_ctes("voice", "gal") + " SELECT vec_id, CASE WHEN voice < 9 THEN 'voice_' || voice || '_1' ELSE 'người ' || voice END AS canonical FROM voice")
def _(spark, sf):
    v = probe_vec(spark, sf)
    name = F.concat(F.lit("voice_"), F.col("voice").cast("string"), F.lit("_1"))
    asked = (F.when(F.col("voice") == 9, F.concat(F.lit("người "), F.col("voice").cast("string"), F.lit(" - Voice Speaker")))
             .when(F.col("idx") % 3 == 0, F.concat(F.lit("👤 "), name)).when(F.col("idx") % 3 == 1, F.concat(name, F.lit(" - Voice Speaker - Voice Speaker")))
             .otherwise(F.concat(name, F.lit(" - "), name, F.lit("@x.vn - Voice Speaker"))))
    return V.normalize_names(v.select("vec_id", asked.alias("asked")), "asked", V.alias_table(P.gallery(spark, sf))).select("vec_id", "canonical")


@query("mean_vectors", "WITH a AS (SELECT label, d, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY ALL), b AS (SELECT label, any_value(n) AS n, list(x ORDER BY d) AS m FROM a GROUP BY label), c AS (SELECT label, n, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS e FROM b) SELECT label, n, " + SUMMARY + " FROM c")
def _(spark, sf):
    m = V.mean_vector(P.table(spark, sf, "embeddings"), ["label"], DIMS)
    return summary(m, "label", "n")


@query("unit_vectors", "WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x * 3.0::DOUBLE) AS w FROM embeddings), n AS (SELECT vec_id, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS e FROM u) SELECT vec_id, " + SUMMARY + " FROM n")
def _(spark, sf):
    e = P.table(spark, sf, "embeddings").withColumn("embedding", vectors.unit(F.transform("embedding", lambda x: x.cast("double") * 3.0)))
    return summary(e, "vec_id")


@query("valid_vectors", "SELECT vec_id, vec_id % 7 NOT IN (3, 5) AS ok FROM embeddings")
def _(spark, sf):
    v = F.col("embedding")
    bad = F.when(F.col("vec_id") % 7 == 3, F.slice(v, 1, DIMS - 1)).when(F.col("vec_id") % 7 == 5, F.transform(v, lambda x, i: F.when(i == 3, F.lit(float("nan")).cast("float")).otherwise(x))).otherwise(v)
    return P.table(spark, sf, "embeddings").select("vec_id", vectors.is_valid(bad, DIMS).alias("ok"))


@query("load_gallery", "SELECT CAST(vec_id AS VARCHAR) AS name, CASE WHEN vec_id % 2 = 0 THEN 'Chưa cập nhật' ELSE 'm' END AS email, 1.0::DOUBLE AS norm FROM embeddings WHERE vec_id % 5 <> 4")
def _(spark, sf):
    e = P.table(spark, sf, "embeddings")
    stored = e.select(F.col("vec_id").cast("string").alias("speaker_name"), F.when(F.col("vec_id") % 2 == 0, "").otherwise("m").alias("email"), F.lit(None).cast("string").alias("user_info"),
                      F.when(F.col("vec_id") % 5 == 4, "[broken").otherwise(F.to_json("embedding")).alias("embedding"))
    return S.load_gallery(stored, DIMS).select("name", "email", F.round(vectors.norm("embedding"), 6).alias("norm"))


@query("upsert_voices", "SELECT 'v' || label AS name, max(vec_id) AS updated_at, arg_max(CAST(embedding[1] AS DOUBLE), vec_id) AS first FROM embeddings GROUP BY label")
def _(spark, sf):
    e = P.table(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("name"), "embedding", F.col("vec_id").alias("updated_at"))
    half = F.col("updated_at") % 2 == 0
    return S.upsert_voices(e.where(half), e.where(~half)).select("name", "updated_at", F.get("embedding", F.lit(0)).cast("double").alias("first"))


@query("robust_centroids", """
WITH u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings),
p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS s FROM u a JOIN u b ON a.label = b.label),
m AS (SELECT label, a, median(s) AS med FROM p GROUP BY ALL), md AS (SELECT label, arg_max(a, (round(med, 12), -a)) AS m FROM m GROUP BY label),
n AS (SELECT p.label, b, s, greatest(0.45::DOUBLE, quantile_cont(s, 0.25) OVER (PARTITION BY p.label)) AS cut FROM p JOIN md ON md.label = p.label AND md.m = p.a),
k AS (SELECT label, b FROM (SELECT *, count(*) FILTER (s >= cut) OVER (PARTITION BY label) AS kc FROM n) WHERE s >= cut OR kc < 2), x AS (SELECT k.label, d, avg(x) AS x, count(*) AS kept FROM (SELECT k.label, unnest(u.v) AS x, generate_subscripts(u.v, 1) AS d FROM k JOIN u ON u.vec_id = k.b) k GROUP BY ALL),
c AS (SELECT label, any_value(kept) AS kept, list(x ORDER BY d) AS m FROM x GROUP BY label), e AS (SELECT label, kept, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS e FROM c)
SELECT label, kept, """ + SUMMARY + " FROM e")
def _(spark, sf):
    e = P.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "idx")
    return summary(V.robust_centroid(e, ["label"], dims=DIMS), "label", "kept")


@query("cleanest_runs", with_ctes("voice") + """,
u AS (SELECT meeting, w_idx, """ + UNIT.format("embedding") + """ AS u, count(*) OVER (PARTITION BY meeting) AS n FROM voice),
s AS (SELECT a.meeting, a.w_idx, any_value(a.n) AS n, (sum(list_dot_product(a.u, b.u)) - any_value(list_dot_product(a.u, a.u))) / greatest(1, any_value(a.n) - 1) AS score FROM u a JOIN u b USING (meeting) GROUP BY a.meeting, a.w_idx),
md AS (SELECT meeting, arg_max(w_idx, (round(score, 12), -w_idx)) AS mid FROM s GROUP BY meeting),
k AS (SELECT s.*, md.mid, s.w_idx - row_number() OVER (PARTITION BY s.meeting ORDER BY s.w_idx) AS r FROM s JOIN md USING (meeting) JOIN u x ON x.meeting = s.meeting AND x.w_idx = s.w_idx
  JOIN u y ON y.meeting = s.meeting AND y.w_idx = md.mid WHERE list_dot_product(x.u, y.u) >= 0 OR s.w_idx = md.mid),
lr AS (SELECT meeting, arg_max(r, (len, -first)) AS r FROM (SELECT meeting, r, count(*) AS len, min(w_idx) AS first FROM k GROUP BY ALL) GROUP BY meeting),
c AS (SELECT k.* FROM k JOIN lr USING (meeting, r)),
t AS (SELECT a.meeting, a.w_idx, round(sum(b.score), 12) AS total, any_value(a.mid) BETWEEN a.w_idx AND a.w_idx + 10 AS holds FROM c a JOIN c b ON a.meeting = b.meeting AND b.w_idx BETWEEN a.w_idx AND a.w_idx + 10 GROUP BY a.meeting, a.w_idx HAVING count(*) = 11),
f AS (SELECT meeting, arg_max(w_idx, (holds, total, -w_idx)) AS f FROM t GROUP BY meeting),
z AS (SELECT c.* FROM c LEFT JOIN f USING (meeting) WHERE f IS NULL OR w_idx BETWEEN f AND f + 10),
x AS (SELECT meeting, d, avg(x) AS x FROM (SELECT z.meeting, unnest(u.u) AS x, generate_subscripts(u.u, 1) AS d FROM z JOIN u USING (meeting, w_idx)) GROUP BY ALL),
v AS (SELECT meeting, list(x ORDER BY d) AS v FROM x GROUP BY meeting), e AS (SELECT meeting, """ + UNIT.format("v") + """ AS e FROM v)
SELECT meeting, min(z.w_idx) * 1.0::DOUBLE AS start, max(z.w_idx) + 2.0::DOUBLE AS "end", max(n) AS windows, count(*) AS kept, any_value(first) AS first, any_value(last) AS last, any_value(weighted) AS weighted
FROM z JOIN (SELECT meeting, """ + SUMMARY + """ FROM e) USING (meeting) GROUP BY meeting""")
def _(spark, sf):
    return summary(V.cleanest_run(probe_vec(spark, sf).withColumn("start", F.col("w_idx") * 1.0).withColumn("end", F.col("w_idx") + 2.0), ["meeting"], DIMS, accept=0.0, max_windows=11),
                   "meeting", "start", "end", "windows", "kept")


@query("purify_groups", with_ctes("voice") + "," + LABEL_GALLERY + """,
q AS (SELECT v.vec_id, v.voice % 3 AS g, l.name, list_cosine_similarity(v.embedding, l.embedding) AS s FROM voice v, lgal l WHERE v."end" - v.start >= 1.5),
t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, name) AS r FROM q), b AS (SELECT * FROM t WHERE r = 1 AND s >= 0.35),
z AS (SELECT voice % 3 AS g, count(*) AS n FROM voice WHERE "end" - start >= 1.5 GROUP BY ALL), c AS (SELECT g, name, count(*) AS c, min(vec_id) AS f FROM b GROUP BY ALL),
w AS (SELECT g, arg_max(name, (c, -f)) AS name, max(c) AS c FROM c GROUP BY g), mj AS (SELECT w.* FROM w JOIN z USING (g) WHERE n >= 6 AND c >= n * 0.25::DOUBLE)
SELECT vec_id, voice % 3 AS g FROM voice WHERE vec_id NOT IN (SELECT vec_id FROM b JOIN mj USING (g) WHERE b.name <> mj.name)""")
def _(spark, sf):
    v = probe_vec(spark, sf).withColumn("g", F.col("voice") % 3).withColumn("idx", F.col("vec_id"))
    g = V.mean_vector(v.select(F.concat(F.lit("v"), F.col("voice").cast("string")).alias("name"), "embedding"), ["name"], DIMS)
    return V.purify(v, g, ["g"], DIMS, share=0.25).select("vec_id", "g")


@query("contaminated_meetings", with_ctes("voice") + """,
x AS (SELECT meeting, speaker_id, d, avg(x) AS x FROM (SELECT meeting, speaker_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM voice) GROUP BY ALL),
c AS (SELECT meeting, speaker_id, list(x ORDER BY d) AS e FROM x GROUP BY ALL)
SELECT a.meeting, round(max(list_cosine_similarity(a.e, b.e)), 6) AS closest FROM c a JOIN c b ON a.meeting = b.meeting AND a.speaker_id < b.speaker_id GROUP BY a.meeting HAVING max(list_cosine_similarity(a.e, b.e)) >= 0.3""")
def _(spark, sf):
    c = V.mean_vector(probe_vec(spark, sf), ["meeting", "speaker_id"], DIMS)
    return V.contaminated(c, limit=0.3, dims=DIMS).withColumn("closest", F.round("closest", 6))


@query("attach_group_vectors", with_ctes("voice") + """,
x AS (SELECT meeting, speaker_id, d, avg(x) AS x FROM (SELECT meeting, speaker_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM voice) GROUP BY ALL),
c AS (SELECT meeting, speaker_id, list(x ORDER BY d) AS m FROM x GROUP BY ALL), u AS (SELECT meeting, speaker_id, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS e FROM c)
SELECT vec_id, """ + SUMMARY + " FROM voice JOIN u USING (meeting, speaker_id)")
def _(spark, sf):
    v = probe_vec(spark, sf)
    return summary(V.attach_group_vectors(v, V.mean_vector(v, ["meeting", "speaker_id"], DIMS)), "vec_id")


@query("vector_backlog", with_ctes("voice") + ' SELECT meeting, count(*) FILTER (idx % 2 = 1 AND "end" - start >= 2.4) AS to_build, count(*) FILTER (NOT (idx % 2 = 1 AND "end" - start >= 2.4)) AS skipped FROM voice GROUP BY meeting')
def _(spark, sf):
    return V.vector_backlog(probe_vec(spark, sf).withColumn("embedding", F.when(F.col("idx") % 2 == 0, F.col("embedding"))), min_sec=2.4)


@query("unassigned_labels", with_ctes("voice") + " SELECT vec_id, voice >= 5 OR idx % 2 = 0 AS unassigned FROM voice")
def _(spark, sf):
    v = probe_vec(spark, sf)
    name = F.concat(F.lit("voice_"), F.col("voice").cast("string"), F.lit("_2"))
    shown = F.when(F.col("voice") >= 5, F.concat(F.lit("ai "), name)).when(F.col("idx") % 2 == 0, "👤 Speaker 1").otherwise(name)
    return V.strict_unknown(v.withColumn("label", shown), P.gallery(spark, sf)).select("vec_id", "unassigned")


@query("greedy_best_names", with_ctes("voice", "gal") + "," + SIM + """,
b AS (SELECT meeting, speaker_id, name, max(score) AS score FROM sim WHERE score >= 0.3 GROUP BY ALL)
SELECT meeting, speaker_id, arg_min(name, (-score, name)) AS name, round(max(score), 6) AS score FROM b GROUP BY ALL""")
def _(spark, sf):
    return G.greedy_best(candidates(spark, sf)).withColumn("score", F.round("score", 6))


def candidates(spark, sf):
    """Names each speaker id of a meeting could take: the best score of its vectors per name."""
    r = V.identify_ranked(probe_vec(spark, sf), P.gallery(spark, sf), ["meeting", "speaker_id", "vec_id"], threshold=0.3, dims=DIMS)
    return r.groupBy("meeting", "speaker_id", "name").agg(F.max("score").alias("score"))


@query("greedy_names_once_per_chunk", with_ctes("voice", "gal", recursive=True) + "," + SIM + """,
b AS (SELECT meeting, chunk, speaker_id, name, max(score) AS score FROM sim WHERE score >= 0.3 GROUP BY ALL),
e AS (SELECT meeting, chunk, list({'s': score, 'i': speaker_id, 'n': name} ORDER BY score DESC) AS r FROM b GROUP BY meeting, chunk),
g AS (SELECT meeting, chunk, r[1] AS h, list_filter(r, lambda x: x.i <> r[1].i AND x.n <> r[1].n) AS r FROM e
  UNION ALL SELECT meeting, chunk, r[1], list_filter(r, lambda x: x.i <> r[1].i AND x.n <> r[1].n) FROM g WHERE len(r) > 0)
SELECT meeting, h.i AS speaker_id, h.n AS name, round(h.s, 6) AS score FROM g""")
def _(spark, sf):
    return G.greedy_once_per_chunk(candidates(spark, sf)).withColumn("score", F.round("score", 6))


@query("cluster_facts", with_ctes("voice") + """,
s AS (SELECT *, lag("end") OVER (PARTITION BY meeting, voice ORDER BY start, w_idx) AS pe FROM voice)
SELECT meeting, CAST(voice AS BIGINT) AS cluster, count(*) AS windows, round(sum("end" - start), 6) AS seconds, min(start) AS first_start,
  round(sum("end" - start) / count(*) FILTER (pe IS NULL OR start - pe > 3.0), 6) AS avg_turn, any_value(first) AS first, any_value(last) AS last, any_value(weighted) AS weighted
FROM s JOIN (SELECT meeting, voice, """ + SUMMARY + " FROM (SELECT meeting, voice, " + UNIT.format("m") + """ AS e FROM (SELECT meeting, voice, list(x ORDER BY d) AS m FROM (
  SELECT meeting, voice, d, avg(x) AS x FROM (SELECT meeting, voice, unnest(""" + UNIT.format("embedding") + """) AS x, generate_subscripts(embedding, 1) AS d FROM voice) GROUP BY ALL) GROUP BY meeting, voice))) USING (meeting, voice)
GROUP BY meeting, voice HAVING count(*) >= 3""")
def _(spark, sf):
    v = probe_vec(spark, sf)
    f = G.cluster_facts(v.drop("label"), v.select("meeting", "w_idx", F.col("voice").cast("long").alias("cluster")), DIMS, min_windows=3)
    return summary(f.withColumnRenamed("centroid", "embedding"), "meeting", "cluster", "windows", "seconds", "first_start", "avg_turn").withColumn("seconds", F.round("seconds", 6)).withColumn("avg_turn", F.round("avg_turn", 6))


def hints(v):
    return v.select("meeting", "voice").distinct().groupBy("meeting").agg(F.count(F.lit(1)).cast("int").alias("hint"))


# Merging the pair of highest mean similarity, on windows cut to clusters as (smallest window, members, vector sum).
LINKED = """
un AS (SELECT meeting, w_idx, voice, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS u FROM voice),
cl AS (SELECT meeting, greatest(2, least(count(*) - 1, count(DISTINCT voice) + 2)) AS k, list({'c': w_idx, 'm': [w_idx], 'u': u} ORDER BY w_idx) AS g FROM un GROUP BY meeting
  UNION ALL
  SELECT meeting, k, list_sort(list_append(list_filter(g, lambda x: x.c <> -p.a AND x.c <> -p.b), (SELECT {'c': -p.a, 'm': list_concat(list_filter(g, lambda x: x.c = -p.a)[1].m, list_filter(g, lambda x: x.c = -p.b)[1].m),
      'u': list_transform(list_zip(list_filter(g, lambda x: x.c = -p.a)[1].u, list_filter(g, lambda x: x.c = -p.b)[1].u), lambda z: z[1] + z[2])}))) AS g
  FROM (SELECT meeting, k, g, list_max(flatten(list_transform(g, lambda x: list_transform(list_filter(g, lambda y: y.c > x.c),
      lambda y: {'s': round(list_dot_product(x.u, y.u) / (len(x.m) * len(y.m)), 12), 'a': -x.c, 'b': -y.c})))) AS p FROM cl WHERE len(g) > k)),
mem AS (SELECT meeting, c.c AS cluster, unnest(c.m) AS w_idx FROM (SELECT meeting, unnest(g) AS c FROM cl WHERE len(g) <= k))"""


@query("cluster_windows", with_ctes("voice", recursive=True) + "," + LINKED + " SELECT meeting, w_idx, cluster FROM mem")
def _(spark, sf):
    v = probe_vec(spark, sf)
    return G.cluster_windows(v, hints(v), DIMS)


# Facts of the clusters ``mem0`` (meeting, w_idx, cluster) of at least so many windows; votes of speakers for clusters; the first of the best one-to-one maps.
# A speaker's choice is two digits, 99 for none; the text of all choices orders equally good maps.
VOTED = """
fw AS (SELECT meeting, cluster, v.start, v."end", lag(v."end") OVER (PARTITION BY meeting, cluster ORDER BY v.start, w_idx) AS pe FROM voice v JOIN mem0 USING (meeting, w_idx)),
fd AS (SELECT *, seconds / sum(seconds) OVER (PARTITION BY meeting) AS share FROM (SELECT meeting, cluster, sum("end" - start) AS seconds, min(start) AS first_start,
  sum("end" - start) / count(*) FILTER (pe IS NULL OR start - pe > 3.0) AS avg_turn FROM fw GROUP BY meeting, cluster HAVING count(*) >= {least})),
tk AS (SELECT *, words / turns AS per_turn FROM (SELECT *, words / sum(words) OVER (PARTITION BY meeting) AS share FROM (
  SELECT meeting, 'speaker_' || voice AS sid, sum(len(list_filter(string_split(text, ' '), lambda x: x <> '')))::DOUBLE AS words, count(*) AS turns, min(idx) AS first FROM voice GROUP BY ALL)) WHERE share >= 0.02::DOUBLE),
vt AS (SELECT meeting, sid, cluster, count(*)::INTEGER AS votes FROM (
  SELECT meeting, sid, arg_min(cluster, (abs(tk.share - fd.share), cluster)) AS cluster FROM tk JOIN fd USING (meeting) GROUP BY meeting, sid
  UNION ALL SELECT meeting, sid, cluster FROM (SELECT meeting, sid, row_number() OVER (PARTITION BY meeting ORDER BY first, sid) AS r FROM tk)
    JOIN (SELECT meeting, cluster, row_number() OVER (PARTITION BY meeting ORDER BY first_start, cluster) AS r FROM fd) USING (meeting, r)
  UNION ALL SELECT meeting, sid, cluster FROM (SELECT meeting, sid, row_number() OVER (PARTITION BY meeting ORDER BY per_turn DESC, words DESC, first) AS r FROM tk)
    JOIN (SELECT meeting, cluster, row_number() OVER (PARTITION BY meeting ORDER BY avg_turn DESC, cluster) AS r FROM fd) USING (meeting, r)) GROUP BY ALL),
si AS (SELECT meeting, sid, row_number() OVER (PARTITION BY meeting ORDER BY sid) AS k FROM (SELECT DISTINCT meeting, sid FROM vt)),
ci AS (SELECT meeting, cluster, row_number() OVER (PARTITION BY meeting ORDER BY cluster) - 1 AS j FROM (SELECT DISTINCT meeting, cluster FROM vt)),
pick AS (SELECT meeting, k, j, votes FROM vt JOIN si USING (meeting, sid) JOIN ci USING (meeting, cluster) UNION ALL SELECT meeting, k, 99, 0 FROM si),
way AS (SELECT DISTINCT meeting, 0::BIGINT AS k, 0::BIGINT AS mask, 0::BIGINT AS total, '' AS path FROM si
  UNION ALL
  SELECT way.meeting, way.k + 1, CASE WHEN j = 99 THEN mask ELSE mask | (1::BIGINT << least(j, 60)) END AS after, max(total + votes),
    arg_min(path || printf('%02d', j), printf('%04d', 9999 - total - votes) || path || printf('%02d', j))
  FROM way JOIN pick ON pick.meeting = way.meeting AND pick.k = way.k + 1 AND (j = 99 OR (mask >> least(j, 60)) & 1 = 0) GROUP BY 1, 2, 3),
won AS (SELECT meeting, arg_min(path, printf('%04d', 9999 - total) || path) AS path FROM way JOIN (SELECT meeting, max(k) AS k FROM si GROUP BY meeting) USING (meeting, k) GROUP BY meeting),
mp AS (SELECT meeting, sid AS speaker_id, cluster, votes FROM won JOIN si USING (meeting) JOIN vt USING (meeting, sid) JOIN ci USING (meeting, cluster)
  WHERE j = CAST(substr(path, 2 * k - 1, 2) AS BIGINT) AND votes >= 2)"""
# Clusters of the meetings with ten windows or more.
LINKED_MANY = LINKED + ", mem0 AS (SELECT * FROM mem WHERE meeting IN (SELECT meeting FROM voice GROUP BY meeting HAVING count(*) >= 10))"


@query("map_speakers_to_clusters", with_ctes("voice", recursive=True) + ", mem0 AS (SELECT meeting, w_idx, CAST(voice AS BIGINT) AS cluster FROM voice)," + VOTED.format(least=3)
       + " SELECT meeting, speaker_id, cluster, votes FROM mp")
def _(spark, sf):
    v = probe_vec(spark, sf)
    f = G.cluster_facts(v, v.select("meeting", "w_idx", F.col("voice").cast("long").alias("cluster")), DIMS, min_windows=3)
    return G.map_speakers(by_voice(v), f)


def by_voice(v):
    return v.withColumn("speaker_id", F.concat(F.lit("speaker_"), F.col("voice").cast("string")))


@query("assign_names_one_to_one", with_ctes("voice", "gal", recursive=True) + "," + SPEAKERS + "," + ASSIGN + " SELECT meeting, id AS speaker_id, name, round(s, 6) AS score FROM one")
def _(spark, sf):
    v = probe_vec(spark, sf)
    c = V.mean_vector(by_voice(v), ["meeting", "speaker_id"], DIMS)
    return G.assign_one_to_one(G._scores(c, P.gallery(spark, sf), "speaker_id", DIMS), ["meeting"], "speaker_id", "name").withColumn("score", F.round("score", 6))


@query("name_clusters", with_ctes("voice", "gal", recursive=True) + """,
cs0 AS (SELECT meeting, voice, d, avg(x) AS x, count(*) AS n FROM (SELECT meeting, voice, unnest(""" + UNIT.format("embedding") + """) AS x, generate_subscripts(embedding, 1) AS d FROM voice) GROUP BY ALL),
cs AS (SELECT meeting, CAST(voice AS VARCHAR) AS id, list(x ORDER BY d) AS e FROM cs0 WHERE n >= 3 GROUP BY meeting, voice),""" + ASSIGN + """,
nd AS (SELECT meeting, CAST(id AS BIGINT) AS cluster, name, s, s >= 0.2 AS named FROM one)
SELECT meeting, cluster, CASE WHEN named THEN name ELSE 'Speaker ' || row_number() OVER (PARTITION BY meeting, named ORDER BY cluster) END AS name, round(s, 6) AS score FROM nd""")
def _(spark, sf):
    v = probe_vec(spark, sf)
    f = G.cluster_facts(v, v.select("meeting", "w_idx", F.col("voice").cast("long").alias("cluster")), DIMS, min_windows=3)
    return G.name_clusters(f, P.gallery(spark, sf), DIMS, 0.2).withColumn("score", F.round("score", 6))


# Robust centroid of each speaker of a meeting; meetings with two speakers too much alike are left out.
ROBUST = """
u AS (SELECT w_idx, meeting || '|' || voice AS g, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS v FROM voice),
p AS (SELECT a.g, a.w_idx AS a, b.w_idx AS b, list_dot_product(a.v, b.v) AS s FROM u a JOIN u b ON a.g = b.g),
md AS (SELECT g, arg_max(a, (round(med, 12), -a)) AS m FROM (SELECT g, a, median(s) AS med FROM p GROUP BY ALL) GROUP BY g),
n AS (SELECT p.g, b, s, greatest(0.45::DOUBLE, quantile_cont(s, 0.25) OVER (PARTITION BY p.g)) AS cut, count(*) OVER (PARTITION BY p.g) AS size FROM p JOIN md ON md.g = p.g AND md.m = p.a),
kp AS (SELECT g, b FROM (SELECT *, count(*) FILTER (s >= cut) OVER (PARTITION BY g) AS kc FROM n) WHERE s >= cut OR kc < least(2, size)),
x AS (SELECT g, d, avg(x) AS x FROM (SELECT kp.g, unnest(u.v) AS x, generate_subscripts(u.v, 1) AS d FROM kp JOIN u ON u.g = kp.g AND u.w_idx = kp.b) GROUP BY ALL),
c0 AS (SELECT split_part(g, '|', 1) AS meeting, 'speaker_' || split_part(g, '|', 2) AS id, list(x ORDER BY d) AS e FROM x GROUP BY g),
cs AS (SELECT * FROM c0 WHERE meeting NOT IN (SELECT a.meeting FROM c0 a JOIN c0 b ON a.meeting = b.meeting AND a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.92))"""


BY_CENTROIDS = with_ctes("voice", "gal", recursive=True) + "," + ROBUST + "," + ASSIGN + " SELECT meeting, id AS speaker_id, name, round(s, 6) AS score FROM one WHERE s >= 0.2"
# Clusters of windows, mapped to speakers by votes and to names one-to-one.
BY_CLUSTERS = with_ctes("voice", "gal", recursive=True) + "," + LINKED_MANY + "," + VOTED.format(least=5) + """,
cw AS (SELECT meeting, cluster, d, avg(x) AS x FROM (SELECT meeting, cluster, unnest(""" + UNIT.format("embedding") + """) AS x, generate_subscripts(embedding, 1) AS d FROM voice JOIN mem0 USING (meeting, w_idx)) GROUP BY ALL),
cs AS (SELECT meeting, CAST(cluster AS VARCHAR) AS id, list(x ORDER BY d) AS e FROM cw JOIN (SELECT meeting, cluster FROM fd) USING (meeting, cluster) GROUP BY meeting, cluster),""" + ASSIGN + """,
nd AS (SELECT meeting, CAST(id AS BIGINT) AS cluster, name, s, s >= 0.2 AS named FROM one),
nn AS (SELECT meeting, cluster, CASE WHEN named THEN name ELSE 'Speaker ' || row_number() OVER (PARTITION BY meeting, named ORDER BY cluster) END AS name, s FROM nd)
SELECT meeting, speaker_id, name, round(s, 6) AS score FROM mp JOIN nn USING (meeting, cluster)"""


@query("identify_by_centroids", BY_CENTROIDS)
def _(spark, sf):
    return G.identify_by_centroids(by_voice(probe_vec(spark, sf)), P.gallery(spark, sf), DIMS, 0.2).withColumn("score", F.round("score", 6))


@query("identify_by_clusters", BY_CLUSTERS)
def _(spark, sf):
    v = by_voice(probe_vec(spark, sf))
    return G.identify_by_clusters(v, v, P.gallery(spark, sf), DIMS, 0.2).withColumn("score", F.round("score", 6))


@query("identify_with_fallback", "WITH bc AS (" + BY_CLUSTERS + "), ct AS (" + BY_CENTROIDS + """),
fa AS (SELECT *, 'clusters' AS source FROM bc UNION ALL SELECT *, 'centroids' FROM ct WHERE meeting NOT IN (SELECT meeting FROM bc)),
sp AS (SELECT DISTINCT CAST(vec_id // 25 AS VARCHAR) AS meeting, 'speaker_' || label AS speaker_id FROM embeddings)
SELECT meeting, speaker_id, coalesce(name, 'Speaker') AS name, coalesce(score, 0) AS score, coalesce(source, 'none') AS source FROM sp LEFT JOIN fa USING (meeting, speaker_id)""")
def _(spark, sf):
    v, g = by_voice(probe_vec(spark, sf)), P.gallery(spark, sf)
    return G.identify_with_fallback(v, G.identify_by_clusters(v, v, g, DIMS, 0.2), G.identify_by_centroids(v, g, DIMS, 0.2)).withColumn("score", F.round("score", 6))


def sample_sql(source, least):
    """Parts of the rows of ``source`` (meeting, speaker_id, idx, start, end): medium turns first, up to 25 seconds."""
    return f"""SELECT meeting, speaker_id, idx, round(a, 3) AS start, round(take, 3) AS take FROM (SELECT *, least(b - a, 25.0 - (sum(b - a) OVER o - (b - a))) AS take FROM (
      SELECT *, start + least(0.2::DOUBLE, d * 0.2::DOUBLE) AS a, "end" - least(0.6::DOUBLE, d * 0.4::DOUBLE) AS b, CASE WHEN d BETWEEN 2 AND 15 THEN 0 WHEN d > 15 THEN 1 WHEN d >= {least} AND d < 2 THEN 2 END AS tier
      FROM (SELECT *, "end" - start AS d FROM {source})) WHERE tier IS NOT NULL AND b > a
      WINDOW o AS (PARTITION BY meeting, speaker_id ORDER BY tier, CASE WHEN tier = 0 THEN round(d, 3) ELSE -d END, CASE WHEN tier = 0 THEN round(start, 3) END, idx ROWS UNBOUNDED PRECEDING)) WHERE take > 1e-9"""


@query("cluster_voice_samples", with_ctes("voice", recursive=True) + "," + LINKED_MANY + "," + VOTED.format(least=5) + """,
ro AS (SELECT meeting, speaker_id, w_idx AS idx, voice.start, voice."end" FROM mp JOIN mem0 USING (meeting, cluster) JOIN (SELECT meeting, w_idx, start, "end" FROM voice) voice USING (meeting, w_idx)),
go AS (""" + sample_sql("ro", 1.5) + "), re AS (SELECT * FROM ro WHERE (meeting, speaker_id) NOT IN (SELECT (meeting, speaker_id) FROM go)) SELECT * FROM go UNION ALL " + sample_sql("re", 0.0))
def _(spark, sf):
    v = by_voice(probe_vec(spark, sf))
    members, _, mapping = G.analyse_voices(v, v, DIMS)
    return G.cluster_samples(v, members, mapping)


@query("group_strangers", with_ctes("voice", recursive=True) + """,
m0 AS (SELECT meeting, speaker_id, chunk, d, avg(x) AS x FROM (SELECT meeting, speaker_id, chunk, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM voice) GROUP BY ALL),
m1 AS (SELECT meeting, speaker_id, chunk, list(x ORDER BY d) AS e FROM m0 GROUP BY ALL),
m2 AS (SELECT meeting, speaker_id, chunk, """ + UNIT.format("e") + """ AS e, row_number() OVER (PARTITION BY meeting ORDER BY speaker_id) AS i FROM m1),
wk AS (SELECT DISTINCT meeting, 0::BIGINT AS i, NULL::VARCHAR AS speaker_id, 0::BIGINT AS pos, []::STRUCT(u DOUBLE[], c INTEGER[])[] AS g FROM m2
  UNION ALL
  SELECT meeting, i, speaker_id, CASE WHEN best >= 0.3 THEN pos ELSE len(g) + 1 END, CASE WHEN best >= 0.3
    THEN list_transform(g, lambda x, n: CASE WHEN n = pos THEN {'u': list_transform(list_zip(x.u, e), lambda z: z[1] + z[2]), 'c': list_append(x.c, chunk)} ELSE x END)
    ELSE list_append(g, {'u': e, 'c': [chunk]}) END
  FROM (SELECT *, list_max(sims) AS best, list_position(sims, list_max(sims)) AS pos FROM (
    SELECT m2.meeting, m2.i, m2.speaker_id, chunk, e, g, list_transform(g, lambda x: CASE WHEN list_contains(x.c, chunk) THEN -1::DOUBLE ELSE list_cosine_similarity(x.u, e) END) AS sims
    FROM wk JOIN m2 ON m2.meeting = wk.meeting AND m2.i = wk.i + 1)))
SELECT meeting, speaker_id, pos - 1 AS "group" FROM wk WHERE i > 0""")
def _(spark, sf):
    v = V.mean_vector(probe_vec(spark, sf), ["meeting", "speaker_id"], DIMS)
    return G.group_strangers(v, DIMS, threshold=0.3)
