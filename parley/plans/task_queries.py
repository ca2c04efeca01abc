"""Tasks, people and projects over the order, part and document tables."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import tasks as K
from ..operators import voices as V
from . import proxies as P
from .proxies import with_ctes
from .registry import query
from .text_queries import NORM

TOK = "list_distinct(list_filter(string_split({0}, ' '), lambda w: length(w) > 1))"


def tok(c: str) -> str:
    return TOK.format(NORM.format(f"coalesce({c}, '')"))


OVER = "CASE WHEN len({0}) > 0 AND len({1}) > 0 THEN len(list_intersect({0}, {1})) / greatest(len({0}), len({1}))::DOUBLE ELSE 0 END"

MATCH = f"""
qp AS (SELECT person_id, {tok('person')} AS q, {tok('title')} AS qt, {tok('department')} AS qd FROM peo),
ep AS (SELECT name AS code, {tok('employee_name')} AS e, {tok('designation')} AS et, {tok('department')} AS ed FROM emp),
qn AS (SELECT DISTINCT list_sort(q) AS q FROM qp), en AS (SELECT DISTINCT list_sort(e) AS e FROM ep),
pr AS (SELECT q, e, {OVER.format('q', 'e')} AS ns FROM qn, en WHERE len(list_intersect(q, e)) > 0 AND {OVER.format('q', 'e')} >= 0.6),
qd AS (SELECT DISTINCT list_sort(q) AS q, qt, qd FROM qp), ed AS (SELECT list_sort(e) AS e, et, ed, min(code) AS code, count(*) AS same FROM ep GROUP BY ALL),
sc AS (SELECT qd.q, qd.qt, qd.qd, ed.code, same, ns + 0.3::DOUBLE * {OVER.format('qd.qt', 'ed.et')} + 0.2::DOUBLE * {OVER.format('qd.qd', 'ed.ed')} AS score FROM qd JOIN pr USING (q) JOIN ed USING (e)),
rk AS (SELECT *, row_number() OVER (PARTITION BY q, qt, qd ORDER BY round(score, 9) DESC, code) AS r, lead(score) OVER (PARTITION BY q, qt, qd ORDER BY round(score, 9) DESC, code) AS nxt FROM sc),
bs AS (SELECT person_id, code, round(score, 6) AS score, coalesce(score - CASE WHEN same > 1 THEN score ELSE nxt END < 0.1::DOUBLE, FALSE) AS close_call
  FROM qp LEFT JOIN (SELECT * FROM rk WHERE r = 1) b ON list_sort(qp.q) = b.q AND qp.qt = b.qt AND qp.qd = b.qd)"""


@query("match_employees", with_ctes("peo", "emp") + "," + MATCH + " SELECT * FROM bs")
def _(spark, sf):
    out = K.match_employees(P.people(spark, sf), P.employees(spark, sf))
    return out.select("person_id", "code", F.round("score", 6).alias("score"), "close_call")


@query("duplicate_names", with_ctes("emp") + f" SELECT {NORM.format('employee_name')} AS norm, count(*) AS n FROM emp GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return K.duplicate_names(P.employees(spark, sf))


PROJ = """
up AS (SELECT DISTINCT * FROM (SELECT owner AS "user", name AS project FROM proj UNION ALL SELECT "user", parent FROM memb)),
ul AS (SELECT up."user", up.project, coalesce(nullif(p.project_name, ''), up.project) AS label FROM up LEFT JOIN proj p ON p.name = up.project)"""


@query("user_projects", with_ctes("proj") + "," + PROJ + ' SELECT * FROM ul')
def _(spark, sf):
    return K.user_projects(P.projects(spark, sf), P.members(spark, sf))


@query("employee_projects", with_ctes("proj", "emp") + "," + PROJ + ' SELECT emp.name, project, label FROM emp LEFT JOIN ul ON ul."user" = emp.user_id')
def _(spark, sf):
    return K.employee_projects(P.employees(spark, sf), K.user_projects(P.projects(spark, sf), P.members(spark, sf)))


@query("split_long_text", r"""
WITH RECURSIVE l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, lines, 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS n, NULL::BIGINT AS pa, NULL::BIGINT AS pb FROM l WHERE length(text) > 2000
  UNION ALL
  SELECT doc_id, lines, i + 1, CASE WHEN cut THEN b ELSE a END, CASE WHEN cut THEN list_sum(list_transform(lines[b + 1:i], lambda x: length(x) + 1)) ELSE n END + size,
    CASE WHEN cut THEN a END, CASE WHEN cut THEN i END
  FROM (SELECT *, length(lines[i + 1]) + 1 AS size, a < i AND n + length(lines[i + 1]) + 1 > 2000 AS cut, greatest(a, i - 3) AS b FROM w WHERE i < len(lines))),
p AS (SELECT doc_id, lines, pa, pb FROM w WHERE pa IS NOT NULL UNION ALL SELECT doc_id, lines, a, len(lines) FROM w WHERE i = len(lines))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pb, pa) - 1 AS INTEGER) AS part, array_to_string(lines[pa + 1:pb], chr(10)) AS text FROM p
UNION ALL SELECT doc_id, 0, text FROM l WHERE length(text) <= 2000""")
def _(spark, sf):
    return K.split_long_text(P.table(spark, sf, "documents"), max_chars=2000)


@query("merge_answers", with_ctes("ans") + """,
o AS (SELECT * FROM ans WHERE NOT broken),
s AS (SELECT doc_id, part, tom AS s, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS no, count(*) OVER (PARTITION BY doc_id) AS k FROM o WHERE tom <> ''),
a AS (SELECT doc_id, CASE WHEN any_value(k) = 1 THEN any_value(s) ELSE string_agg('── Phần ' || no || E' ──\\n' || s, E'\\n\\n' ORDER BY part) END AS summary FROM s GROUP BY doc_id)
SELECT o.doc_id, coalesce(arg_min(ten, part) FILTER (ten <> ''), '') AS title, '01/02/2024' AS day, coalesce(arg_max(ket, part) FILTER (ket <> ''), '') AS conclusion,
  count(*) * 2 AS items, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens_used, coalesce(any_value(a.summary), '') AS summary
FROM o LEFT JOIN a USING (doc_id) GROUP BY o.doc_id""")
def _(spark, sf):
    return K.merge_answers(K.parse_answers(P.answers(spark, sf)))


@query("answer_items", with_ctes("ans") + """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, k) AS item_id, part, text AS noi_dung, role AS nguoi_thuc_hien, 'ghi chú' AS note
FROM ans, (SELECT unnest([1, 2]) AS k) WHERE NOT broken""")
def _(spark, sf):
    return K.answer_items(K.parse_answers(P.answers(spark, sf))).select("doc_id", "item_id", "part", "noi_dung", "nguoi_thuc_hien", "note")


@query("titles_before", """
WITH i AS (SELECT conv_id AS doc_id, turn // 2 AS part, turn AS item_id, role || turn AS title FROM conversations WHERE turn % 3 <> 2),
p AS (SELECT DISTINCT conv_id AS doc_id, turn // 2 AS part FROM conversations),
r AS (SELECT p.doc_id, p.part, i.item_id, i.title, row_number() OVER (PARTITION BY p.doc_id, p.part ORDER BY i.item_id DESC) AS k FROM p JOIN i ON i.doc_id = p.doc_id AND i.part < p.part)
SELECT doc_id, part, string_agg(title, E'\\n' ORDER BY item_id) AS titles, count(*) AS n FROM r WHERE k <= 3 GROUP BY doc_id, part""")
def _(spark, sf):
    c = P.table(spark, sf, "conversations")
    part = F.floor(F.col("turn") / 2).alias("part")
    items = c.select(F.col("conv_id").alias("doc_id"), part, F.col("turn").alias("item_id"), F.when(F.col("turn") % 3 != 2, F.concat("role", F.col("turn").cast("string"))).alias("title"))
    return K.titles_before(items, c.select(F.col("conv_id").alias("doc_id"), part).distinct(), at_most=3)


@query("enrich_items", with_ctes("peo", "emp") + "," + MATCH + """
SELECT person_id AS doc_id, 1 AS item_id, CAST(person_id AS VARCHAR) AS title, CASE WHEN code IS NULL THEN person ELSE concat_ws(' - ', e.employee_name, e.user_id, e.designation) END AS assignee_display,
  '01/02/2024' AS start_date, CASE WHEN person_id % 2 = 0 THEN '03/02/2024' ELSE '' END AS end_date, CASE WHEN person_id % 3 = 0 THEN 'noti' ELSE 'task' END AS task_type, 0 AS weight, '' AS description
FROM bs JOIN peo USING (person_id) LEFT JOIN emp e ON e.name = bs.code""")
def _(spark, sf):
    people, staff = P.people(spark, sf), P.employees(spark, sf)
    items = people.select(F.col("person_id").alias("doc_id"), F.lit(1).alias("item_id"), F.col("person_id").cast("string").alias("noi_dung"), F.col("person").alias("nguoi_thuc_hien"),
                          F.lit("01/02/2024").alias("meeting_day"), F.lit("").alias("ngay_bat_dau"), F.when(F.col("person_id") % 2 == 0, "03/02/2024").alias("ngay_ket_thuc"),
                          F.when(F.col("person_id") % 3 == 0, "Thông báo").alias("loai"), F.lit(None).cast("string").alias("note"))
    found = K.match_employees(people, staff).select(F.col("person_id").alias("doc_id"), F.lit(1).alias("item_id"), "code")
    return K.enrich_items(items, found, staff)


@query("duplicate_tasks", with_ctes("task_t") + " SELECT seq, duplicate FROM dup")
def _(spark, sf):
    return K.duplicate_tasks(P.tasks(spark, sf), P.erp_tasks(spark, sf)).select("seq", "duplicate")


@query("duplicate_tasks_as_written", with_ctes("task_t") + " SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS duplicates FROM task_t")
def _(spark, sf):
    t = K.duplicate_tasks(P.tasks(spark, sf), P.erp_tasks(spark, sf), as_written=True)
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_if("duplicate").alias("duplicates"))


@query("gate_batches", with_ctes("task_t") + " SELECT batch, seq, NOT bool_or(duplicate) OVER (PARTITION BY batch) AS created FROM dup")
def _(spark, sf):
    return K.gate_batches(K.duplicate_tasks(P.tasks(spark, sf), P.erp_tasks(spark, sf))).select("batch", "seq", "created")


@query("task_payloads", with_ctes("task_t") + """
SELECT seq, '{"subject":"[' || upper(task_type) || '] ' || title || '","status":"Open"' || CASE WHEN description = '' THEN '' ELSE ',"description":"' || description || '"' END ||
  ',"custom_loai_nhiem_vu":"' || task_type || '","exp_start_date":"' || strftime(o_orderdate, '%Y-%m-%d') || '"' || CASE WHEN seq % 2 = 0 THEN ',"exp_end_date":"' || strftime(o_orderdate, '%Y-%m-%d') || '"' ELSE '' END ||
  ',"custom_assignee":"' || assignee_hr_code || '","project":"' || project || '","is_group":1}' AS payload FROM task_t""")
def _(spark, sf):
    return K.task_payload(P.tasks(spark, sf), ["seq"])


@query("batch_report", with_ctes("task_t") + """,
g AS (SELECT *, NOT bool_or(duplicate) OVER (PARTITION BY batch) AS created FROM dup)
SELECT batch, count(*) FILTER (created) AS created, CAST(bool_or(duplicate) AS INTEGER) AS failed, '''' || arg_min(title[:40], seq) FILTER (duplicate) || ''': Đã tồn tại (Trùng lặp)' AS error,
  coalesce(min(seq) < min(seq) FILTER (duplicate), FALSE) AS rolled_back FROM g GROUP BY batch""")
def _(spark, sf):
    return K.batch_report(K.gate_batches(K.duplicate_tasks(P.tasks(spark, sf), P.erp_tasks(spark, sf))), title_chars=40)


@query("speaker_roles", with_ctes("gal", "emp") + """,
st AS (SELECT employee_name AS n, designation, name FROM emp),
g AS (SELECT name, regexp_extract(name, '^voice_(\\d+)_', 1) AS number FROM gal),
a AS (SELECT g.name AS k, emp.designation AS role, 0 AS prio, '' AS code FROM g JOIN emp ON emp.name = g.number),
b AS (SELECT DISTINCT unnest([n, lower(n)]) AS k, designation AS role, 1 AS prio, name AS code FROM st)
SELECT k AS key, arg_max(role, (prio, code)) AS role FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k""")
def _(spark, sf):
    number = F.regexp_extract("name", r"^voice_(\d+)_", 1)
    speakers = P.gallery(spark, sf).select("name", F.concat(F.lit("e"), number).alias("email"))
    staff = P.employees(spark, sf).withColumn("user_id", F.regexp_replace("user_id", "@.*", ""))
    return K.speaker_roles(speakers, staff)


@query("enrolled_speakers", with_ctes("gal") + " SELECT name, email, CASE WHEN email LIKE 'voice_%' THEN email || ' title' ELSE '' END AS designation FROM gal")
def _(spark, sf):
    g = P.gallery(spark, sf).select("name", "email")
    extra = g.select(F.concat("name", F.lit(" - Voice Speaker")).alias("name"), F.lit(None).cast("string").alias("email"))
    every = g.unionByName(extra)
    staff = g.where(F.col("email").startswith("voice_")).select(F.col("email").alias("user_id"), F.concat("email", F.lit(" title")).alias("designation"), "name")
    return K.enrolled_speakers(every, V.alias_table(every), staff)


@query("default_assignees", with_ctes("emp", "proj") + """
SELECT DISTINCT u."user", coalesce(employee_name || ' (' || emp.name || ')', '') AS assignee FROM (SELECT DISTINCT "user" FROM memb) u LEFT JOIN emp ON emp.user_id = u."user" """)
def _(spark, sf):
    return K.default_assignee(P.members(spark, sf).select("user").distinct(), P.employees(spark, sf))
