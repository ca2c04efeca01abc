"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from ..functions import labels, text, times
from ..operators import usage
from . import proxies as P
from .proxies import with_ctes
from .registry import query

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


WC = r"\p{L}\p{N}\p{M}_"


def clean_sql() -> str:
    """The cleaning steps without look-around or back-references: fillers by repeated passes, repeats on a token list."""
    t = "trim(text, E' \\t\\n\\r')"
    for old, new in text.DOMAIN_REPLACEMENTS.items():
        t = f"replace({t}, '{old}', '{new}')"
    t = f"regexp_replace(regexp_replace({t}, '\\s+', ' ', 'g'), '\\s+([,.!?;:])', '\\1', 'g')"
    steps = [f"c0 AS (SELECT meeting, idx, {t} AS t FROM seg)",
             "c1 AS (SELECT *, regexp_full_match(lower(t), '\\s*(" + "|".join(text.FILLER_ONLY) + ")[\\s,.!?;:]*') AS is_filler, t AS f FROM c0)"]
    n = 1
    for phrase in text.FILLER_PHRASES:
        for _ in range(3):
            steps.append(f"c{n + 1} AS (SELECT meeting, idx, is_filler, regexp_replace(f, '(^|[^{WC}])(?i:{phrase})(?:[\\s,]+|$|([^{WC}\\s,]))', '\\1\\2', 'g') AS f FROM c{n})")
            n += 1
    steps += [f"k0 AS (SELECT *, regexp_extract_all(f, '[{WC}]+|[^{WC}]+') AS ks FROM c{n})",
              "k1 AS (SELECT meeting, idx, unnest(ks) AS k, generate_subscripts(ks, 1) AS i FROM k0)",
              "k2 AS (SELECT *, lag(k) OVER w AS k1, lag(k, 2) OVER w AS k2, lead(k) OVER w AS n1, lag(k) OVER w AS p1 FROM k1 WINDOW w AS (PARTITION BY meeting, idx ORDER BY i))",
              f"k3 AS (SELECT *, regexp_full_match(k, '[{WC}]+') AS isw FROM k2)",
              "k4 AS (SELECT meeting, idx, i, k FROM k3 WHERE NOT (isw AND k2 IS NOT NULL AND lower(k) = lower(k2) AND regexp_full_match(k1, '\\s+')) "
              "AND NOT (NOT isw AND p1 IS NOT NULL AND n1 IS NOT NULL AND lower(p1) = lower(n1) AND regexp_full_match(k, '\\s+')))",
              "k5 AS (SELECT meeting, idx, trim(regexp_replace(string_agg(k, '' ORDER BY i), '\\s+', ' ', 'g'), ' ,') AS t FROM k4 GROUP BY ALL)"]
    return with_ctes("seg") + ",\n" + ",\n".join(steps) + """
SELECT k0.meeting, k0.idx, CASE WHEN is_filler OR t IS NULL THEN '' ELSE upper(substring(t, 1, 1)) || substring(t, 2) END AS clean FROM k0 LEFT JOIN k5 USING (meeting, idx)"""


@query("clean_segment_text", clean_sql())
def _(spark, sf):
    return P.segments(spark, sf).select("meeting", "idx", text.clean_segment_text("text").alias("clean"))


@query("normalize_whitespace", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '\\s+', ' ', 'g')) AS clean FROM documents")
def _(spark, sf):
    return P.table(spark, sf, "documents").select("doc_id", text.normalize_whitespace("text").alias("clean"))


@query("strip_control_characters", "SELECT page_id, regexp_replace(html, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS clean FROM pages")
def _(spark, sf):
    return P.table(spark, sf, "pages").select("page_id", text.strip_control("html").alias("clean"))


@query("drop_ellipsis", with_ctes("seg") + r"""
SELECT meeting, idx, trim(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\.{2,}', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM seg""")
def _(spark, sf):
    return P.segments(spark, sf).select("meeting", "idx", text.drop_ellipsis("text").alias("clean"))


def meaningful_sql(phrases: str) -> str:
    return with_ctes("seg") + rf""",
t AS (SELECT *, trim(regexp_replace(trim(text, E' \t\n\r'), '^\.{{2,}}\s*|\s*\.{{2,}}$', '', 'g'), E' \t\n\r') AS c FROM seg),
u AS (SELECT *, trim(regexp_replace(lower(c), '\s+', ' ', 'g')) AS l FROM t)
SELECT meeting, idx, NOT (c = '' OR regexp_full_match(c, '[^\p{{L}}_\p{{Nl}}\p{{No}}]+') OR (l IN ({phrases}) AND len(string_split(l, ' ')) <= 5)) AS meaningful FROM u"""


def quoted(items) -> str:
    return ", ".join(f"'{p}'" for p in items)


@query("meaningful_turns", meaningful_sql(quoted(text.STOCK_PHRASES)))
def _(spark, sf):
    return P.segments(spark, sf).select("meeting", "idx", text.is_meaningful("text").alias("meaningful"))


@query("meaningful_turns_short_list", meaningful_sql(quoted(text.STOCK_PHRASES_SHORT)))
def _(spark, sf):
    return P.segments(spark, sf).select("meeting", "idx", text.is_meaningful("text", text.STOCK_PHRASES_SHORT).alias("meaningful"))


@query("plain_speaker_names", with_ctes("seg") + r"""
SELECT meeting, idx, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[\x{1F464}-\x{1F469}]', '', 'g'), '\(.*?\)', '', 'g'), '-\s*\d+%', '', 'g'), '\s+', ' ', 'g')) AS name
FROM (SELECT meeting, idx, label || ' - ' || (idx % 100) || '%' AS x FROM seg)""")
def _(spark, sf):
    shown = F.concat("label", F.lit(" - "), (F.col("idx") % 100).cast("string"), F.lit("%"))
    return P.segments(spark, sf).select("meeting", "idx", labels.plain_name(shown).alias("name"))


@query("unknown_labels_by_text", with_ctes("seg") + " SELECT label, count(*) AS n, label = '' OR label LIKE '%Speaker%' OR label LIKE '%Người lạ%' OR label LIKE '%Unknown%' OR label LIKE '%Không tên%' AS unknown FROM seg GROUP BY label")
def _(spark, sf):
    return P.segments(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("unknown", labels.is_unknown("label"))


NORM = r"trim(regexp_replace(regexp_replace(lower(trim({0})), '\b(mr\.?|ms\.?|mrs\.?|anh|chi|ba|em)\b', '', 'g'), '\s+', ' ', 'g'))"


@query("normal_names", with_ctes("peo") + f" SELECT person_id, {NORM.format('person')} AS norm FROM peo")
def _(spark, sf):
    return P.people(spark, sf).select("person_id", text.norm_name("person").alias("norm"))


@query("name_token_overlap", with_ctes("peo") + f""",
t AS (SELECT person_id, list_distinct(list_filter(string_split({NORM.format('person')}, ' '), lambda w: length(w) > 1)) AS a,
        list_distinct(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) > 1)) AS b
      FROM peo JOIN part ON p_partkey = person_id)
SELECT person_id, CAST(len(a) AS INTEGER) AS tokens, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / greatest(len(a), len(b))::DOUBLE ELSE 0 END, 6) AS overlap FROM t""")
def _(spark, sf):
    p = P.people(spark, sf).join(P.table(spark, sf, "part").select(F.col("p_partkey").alias("person_id"), "p_name"), "person_id")
    a, b = text.name_tokens("person"), text.name_tokens("p_name")
    return p.select("person_id", F.size(a).alias("tokens"), F.round(text.token_overlap(a, b), 6).alias("overlap"))


@query("word_tokens", rf"""
SELECT doc_id, len(w) AS n, list_aggregate(w, 'string_agg', '|') AS words FROM (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS w FROM documents)""")
def _(spark, sf):
    w = text.word_tokens("text")
    return P.table(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.nullif(F.array_join(w, "|"), F.lit("")).alias("words"))


@query("parse_seconds", """
SELECT o_orderkey, m * 60 + s + 0.5 AS a, (h * 3600 + m * 60 + s)::DOUBLE AS b, o_totalprice AS c, 0.0::DOUBLE AS d
FROM (SELECT *, (o_orderkey % 60)::DOUBLE AS s, (o_custkey % 60)::DOUBLE AS m, (o_orderkey % 5)::DOUBLE AS h FROM orders)""")
def _(spark, sf):
    o = P.table(spark, sf, "orders")
    s, m, h = (F.col("o_orderkey") % 60).cast("string"), (F.col("o_custkey") % 60).cast("string"), (F.col("o_orderkey") % 5).cast("string")
    return o.select("o_orderkey", times.parse_seconds(F.concat(m, F.lit(":"), s, F.lit(".5"))).alias("a"),
                    times.parse_seconds(F.concat_ws(":", h, m, s)).alias("b"), times.parse_seconds("o_totalprice").alias("c"),
                    times.parse_seconds("o_orderpriority").alias("d"))


@query("parse_user_datetimes", """
SELECT event_id, date_trunc('second', ts) AS a, date_trunc('minute', ts) AS b, date_trunc('day', ts) AS c, date_trunc('second', ts) AS d,
  date_trunc('minute', ts) AS e, date_trunc('second', ts) - INTERVAL 7 HOUR AS f, CAST(NULL AS TIMESTAMP) AS g FROM events""")
def _(spark, sf):
    e = P.table(spark, sf, "events")
    fmt = lambda f: times.parse_user_datetime(F.date_format("ts", f))
    return e.select("event_id", fmt("dd/MM/yyyy HH:mm:ss").alias("a"), fmt("dd/MM/yyyy HH:mm").alias("b"), fmt("yyyy-MM-dd").alias("c"),
                    fmt("yyyy-MM-dd'T'HH:mm:ss").alias("d"), fmt("HH:mm dd/MM/yyyy").alias("e"),
                    times.parse_user_datetime(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+07:00"))).alias("f"),
                    times.parse_user_datetime("event_type").alias("g"))


@query("parse_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m-%d') AS b, CAST(NULL AS VARCHAR) AS c FROM orders""")
def _(spark, sf):
    o = P.table(spark, sf, "orders")
    return o.select("o_orderkey", times.parse_date(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("a"),
                    times.parse_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("b"), times.parse_date("o_orderpriority").alias("c"))


@query("format_times", "SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M') AS a, strftime(ts, '%d/%m/%Y') AS b, strftime(ts, '%H giờ %M') AS c FROM events")
def _(spark, sf):
    return P.table(spark, sf, "events").select("event_id", times.format_datetime("ts").alias("a"), times.format_day("ts").alias("b"), times.format_clock("ts").alias("c"))


@query("minute_file_names", with_ctes("meet") + r""",
t AS (SELECT meeting, trim(trim(regexp_replace(regexp_replace(title, '[\\/:*?"<>|]+', ' ', 'g'), '\s+', ' ', 'g')), ' -') AS subj, creation FROM meet),
n AS (SELECT meeting, 'Office - BBH - ' || subj || CASE WHEN subj = '' THEN '' ELSE ' - ' END || day(creation) || '.' || month(creation) || '.' || year(creation) AS name FROM t)
SELECT meeting, CASE WHEN length(name) > 180 THEN rtrim(substring(name, 1, 180), ' -') ELSE name END || '.docx' AS file FROM n""")
def _(spark, sf):
    return P.meetings(spark, sf).select("meeting", text.minute_file_name(F.lit("Office"), "title", "creation", "meeting", max_chars=180).alias("file"))


@query("task_types", "SELECT event_id, CASE WHEN lower(event_type) LIKE '%noti%' OR event_type LIKE '%thông báo%' THEN 'noti' ELSE 'task' END AS kind FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Noti ' ELSE '' END || event_type AS event_type FROM events)")
def _(spark, sf):
    t = F.concat(F.when(F.col("event_id") % 3 == 0, "Noti ").otherwise(""), "event_type")
    return P.table(spark, sf, "events").select("event_id", text.task_type(t).alias("kind"))


@query("employee_codes", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'HR_EMP_' || c_custkey WHEN 1 THEN 'HR-EMP-' || c_custkey ELSE c_mktsegment END AS code FROM customer""")
def _(spark, sf):
    c = P.table(spark, sf, "customer")
    k = F.col("c_custkey").cast("string")
    shown = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(" (HR_EMP_"), k, F.lit(")"))).when(
        F.col("c_custkey") % 3 == 1, F.concat(F.lit("HR-EMP-"), k, F.lit(" "))).otherwise(F.col("c_name"))
    return c.select("c_custkey", text.employee_code(shown, "c_mktsegment").alias("code"))


@query("billable_usage", with_ctes("call_t") + """,
b AS (SELECT event_id, prompt_tokens, greatest(total_tokens - prompt_tokens, candidate_tokens + thought_tokens) AS completion_tokens, total_tokens AS t FROM call_t)
SELECT event_id, completion_tokens, greatest(t, prompt_tokens + completion_tokens) AS total_tokens,
  round(prompt_tokens * (0.75::DOUBLE / 1000000) + completion_tokens * (3.75::DOUBLE / 1000000), 9) AS cost_usd FROM b""")
def _(spark, sf):
    return usage.billable_usage(P.calls(spark, sf)).select("event_id", "completion_tokens", "total_tokens", F.round("cost_usd", 9).alias("cost_usd"))


@query("chunk_prefixes", with_ctes("seg") + " SELECT speaker_id, CAST(regexp_extract(speaker_id, '^c(\\d+)_', 1) AS INTEGER) AS chunk, regexp_extract(speaker_id, '^(c\\d+)_', 1) AS prefix, count(*) AS n FROM seg GROUP BY speaker_id")
def _(spark, sf):
    s = P.segments(spark, sf).groupBy("speaker_id").agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("chunk", labels.chunk_index("speaker_id")).withColumn("prefix", labels.chunk_prefix("speaker_id"))


@query("display_labels", with_ctes("gal") + " SELECT name, '👤 ' || name || CASE WHEN email = 'Chưa cập nhật' THEN '' ELSE ' (' || email || ')' END AS label FROM gal")
def _(spark, sf):
    return P.gallery(spark, sf).select("name", labels.display_label("name", "email", F.lit("c0_x")).alias("label"))


@query("spelling_variants", "SELECT DISTINCT n_nationkey, v FROM (SELECT n_nationkey, unnest(['Thúy ' || n_name, 'Thuý ' || n_name, lower('Thúy ' || n_name), lower('Thuý ' || n_name)]) AS v FROM nation)")
def _(spark, sf):
    n = P.table(spark, sf, "nation")
    return n.select("n_nationkey", F.explode(text.spelling_variants(F.concat(F.lit("Thúy "), "n_name"))).alias("v"))


@query("employee_options", with_ctes("emp") + " SELECT name, concat_ws(' - ', employee_name, user_id, designation) AS label, contains(lower(concat_ws(' - ', employee_name, user_id, designation)), 'ring') AS hit FROM emp")
def _(spark, sf):
    label = text.employee_option("employee_name", "user_id", "designation")
    return P.employees(spark, sf).select("name", label.alias("label"), text.option_matches(label, F.lit("RING")).alias("hit"))


@query("vocabulary_terms", "SELECT doc_id, term, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, E' \\t\\n\\r')), lambda x: x <> '')) AS term FROM documents) GROUP BY ALL")
def _(spark, sf):
    d = P.table(spark, sf, "documents")
    return d.select("doc_id", F.explode(text.vocabulary_terms("text")).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query("segment_durations", with_ctes("seg") + ' SELECT meeting, idx, round(greatest(0, "end" - start), 6) AS seconds FROM seg')
def _(spark, sf):
    return P.segments(spark, sf).select("meeting", "idx", F.round(times.segment_duration("start", "end"), 6).alias("seconds"))


@query("missing_task_fields", with_ctes("task_t") + " SELECT seq, CASE WHEN seq % 2 = 0 THEN '' ELSE 'end_date' END AS missing FROM task_t")
def _(spark, sf):
    return P.tasks(spark, sf).select("seq", F.array_join(text.missing_core_fields("project", "assignee_hr_code", "end_date"), ",").alias("missing"))


@query("unfenced_answers", with_ctes("ans") + " SELECT doc_id, part, NOT broken AS ok, CASE WHEN broken THEN NULL ELSE ten END AS title, CASE WHEN broken THEN NULL ELSE tom END AS summary FROM ans")
def _(spark, sf):
    from ..operators import tasks as K
    return K.parse_answers(P.answers(spark, sf)).select("doc_id", "part", F.col("data").isNotNull().alias("ok"), F.col("data.ten_cuoc_hop").alias("title"),
                                                         F.col("data.tom_tat_cuoc_hop").alias("summary"))


@query("meeting_access", with_ctes("meet") + " SELECT meeting, owner = 'u3' AS mine, TRUE AS admin, FALSE AS guest, TRUE AS any_user, conv_id % 2 = 0 OR owner = 'u3' AS manager FROM meet")
def _(spark, sf):
    m = P.meetings(spark, sf)
    roles = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("System Manager"))).otherwise(F.array(F.lit("Employee")))
    user = F.lit("u3")
    return m.select("meeting", labels.can_access("owner", user).alias("mine"), labels.can_access("owner", F.lit("Administrator")).alias("admin"),
                    labels.can_access("owner", F.lit("Guest")).alias("guest"), labels.can_access("owner", user, any_signed_in=True).alias("any_user"),
                    labels.can_access("owner", user, roles).alias("manager"))


@query("source_and_chunk_keys", with_ctes("seg") + " SELECT meeting, idx, CASE WHEN idx % 4 = 0 THEN CASE WHEN label = '' THEN '' ELSE 'label:' || label END ELSE 'source:' || speaker_id END AS source, 'chunk:' || chunk AS chunk_key FROM seg")
def _(spark, sf):
    sid = F.when(F.col("idx") % 4 != 0, F.col("speaker_id"))
    return P.segments(spark, sf).select("meeting", "idx", labels.source_key([sid], "label").alias("source"), labels.chunk_key("chunk").alias("chunk_key"))


@query("joined_fields", with_ctes("emp") + " SELECT name, CASE WHEN designation = 'ECONOMY' THEN user_id ELSE user_id || ' - ' || designation END AS shown, CASE WHEN designation = 'ECONOMY' THEN '{\"a\":\"' || name || '\"}' ELSE '{\"a\":\"' || name || '\",\"b\":\"' || designation || '\"}' END AS record FROM emp")
def _(spark, sf):
    d = F.when(F.col("designation") == "ECONOMY", "").otherwise(F.col("designation"))
    return P.employees(spark, sf).select("name", text.join_filled("user_id", d).alias("shown"),
                                         text.drop_empty_json(F.col("name").alias("a"), F.nullif(d, F.lit("")).alias("b")).alias("record"))
