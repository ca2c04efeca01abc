"""Tasks from minutes: splitting text, merging answers, matching people, checking duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import ordered
from ..functions import labels, text, times

# Limits and weights that decide results.
NAME_THRESHOLD, TITLE_BONUS, DEPARTMENT_BONUS, CLOSE_MARGIN = 0.6, 0.3, 0.2, 0.1
MAX_CHARS, OVERLAP_LINES = 24000, 3
OPEN_STATUSES = ["Open", "Working"]
ANSWER_SCHEMA = """ten_cuoc_hop STRING, ngay_hop STRING, tom_tat_cuoc_hop STRING, ket_luan_cuoc_hop STRING,
    items ARRAY<STRUCT<id INT, noi_dung STRING, nguoi_thuc_hien STRING, chuc_danh STRING, phong_ban STRING,
    ngay_bat_dau STRING, ngay_ket_thuc STRING, loai STRING, note STRING>>"""
# End of fixed values.


def _sets(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("_set", F.array_sort(text.name_tokens(column))).where(F.size("_set") > 0)


def match_employees(people: DataFrame, employees: DataFrame, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """Best employee per (person, title, department) row, with the margin to the runner-up.

    Pairs come from a set-similarity join: two word sets that overlap enough
    share one of their rarest words, so a family name held by a third of the
    staff brings no pairs by itself. Distinct names meet, not rows.
    """
    qs, es = _sets(people, "person"), _sets(employees, "employee_name")
    qsets, esets = qs.select("_set").distinct(), es.select("_set").distinct()
    words = esets.select(F.explode("_set").alias("w")).unionByName(qsets.select(F.explode("_set").alias("w")))
    rarity = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))

    def rare_words(sets: DataFrame) -> DataFrame:
        each = sets.select("_set", F.explode("_set").alias("w")).join(rarity, "w")
        listed = each.groupBy("_set").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
        size = F.size("_set")
        keep = size - F.ceil(size * threshold - 1e-9).cast("int") + 1
        return listed.select("_set", F.explode(F.slice("o", F.lit(1), keep)).alias("x")).select("_set", F.col("x.w").alias("w"))

    pairs = (rare_words(qsets).withColumnRenamed("_set", "_q").join(rare_words(esets).withColumnRenamed("_set", "_e"), "w")
             .where(F.least(F.size("_q"), F.size("_e")) >= F.greatest(F.size("_q"), F.size("_e")) * threshold - 1e-9)
             .select("_q", "_e").distinct().withColumn("name_score", text.token_overlap("_q", "_e"))
             .where(F.col("name_score") >= threshold))

    # Distinct profiles on both sides, so repeated names are scored once.
    tok = lambda c: F.array_sort(text.name_tokens(c))
    qp = qs.select(F.col("_set").alias("_q"), tok("title").alias("_qt"), tok("department").alias("_qd")).distinct()
    ep = es.groupBy(F.col("_set").alias("_e"), tok("designation").alias("_et"), tok("department").alias("_ed")).agg(
        F.min("name").alias("code"), F.count(F.lit(1)).alias("_same"))
    score = (F.col("name_score") + TITLE_BONUS * text.token_overlap("_qt", "_et") + DEPARTMENT_BONUS * text.token_overlap("_qd", "_ed"))
    scored = qp.join(pairs, "_q").join(ep, "_e").withColumn("score", score)
    key = ["_q", "_qt", "_qd"]
    order = W.partitionBy(*key).orderBy(F.desc(F.round("score", 9)), "code")
    # row_number <= 2 is cut per task before the shuffle, so a popular name does not pile up in one task.
    top = scored.withColumn("r", F.row_number().over(order)).where("r <= 2")
    best = top.groupBy(*key).agg(F.min_by("code", "r").alias("code"), F.min_by("score", "r").alias("score"),
                                 F.min_by("_same", "r").alias("_same"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("_next"))
    best = best.withColumn("runner_up", F.when(F.col("_same") > 1, F.col("score")).otherwise(F.col("_next"))).drop("_same", "_next")
    keyed = qs.withColumn("_q", F.col("_set")).withColumn("_qt", tok("title")).withColumn("_qd", tok("department"))
    found = keyed.select("person_id", *key).join(best, key).drop(*key)
    close = F.coalesce(F.col("score") - F.col("runner_up") < CLOSE_MARGIN, F.lit(False))
    return people.join(found, "person_id", "left").withColumn("close_call", close)


def duplicate_names(employees: DataFrame, column: str = "employee_name") -> DataFrame:
    """Normal names that more than one employee has."""
    return employees.groupBy(text.norm_name(column).alias("norm")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def user_projects(projects: DataFrame, members: DataFrame) -> DataFrame:
    """One row per user and project they own or belong to, with a title to show."""
    owned = projects.select(F.col("owner").alias("user"), F.col("name").alias("project"))
    joined = members.select("user", F.col("parent").alias("project"))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    both = owned.unionByName(joined).where(filled("user") & filled("project")).distinct()
    titles = projects.select(F.col("name").alias("project"), F.nullif("project_name", F.lit("")).alias("_t"))
    return both.join(titles, "project", "left").select("user", "project", F.coalesce("_t", "project").alias("label"))


def employee_projects(employees: DataFrame, projects_of: DataFrame) -> DataFrame:
    """Projects per employee code; employees without any keep one row with a null project."""
    staff = employees.where(text.filled("user_id").isNotNull() & text.filled("name").isNotNull()).select("name", F.col("user_id").alias("user"))
    return staff.join(projects_of, "user", "left").select("name", "project", "label")


def split_long_text(docs: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_LINES) -> DataFrame:
    """Parts of each text, cut at line ends, each repeating the last lines of the one before.

    The walk over a text keeps line numbers and lengths only; text is sliced once at the end.
    """
    lens = F.transform("lines", lambda x: F.length(x) + 1)

    def step(acc: Column, i: Column) -> Column:
        size = F.element_at("lens", i + 1)
        cut = (acc["a"] < i) & (acc["n"] + size > max_chars)
        a = F.when(cut, F.greatest(acc["a"], i - overlap)).otherwise(acc["a"])
        carried = F.aggregate(F.slice("lens", a + 1, i - a), F.lit(0), lambda s, x: s + x)
        n = F.when(cut, carried).otherwise(acc["n"])
        done = F.when(cut, F.concat(acc["parts"], F.array(F.struct(acc["a"].alias("a"), i.alias("b"))))).otherwise(acc["parts"])
        return F.struct(a.alias("a"), (n + size).alias("n"), done.alias("parts"))

    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("n"), F.array().cast("array<struct<a:int,b:int>>").alias("parts"))
    total = F.size("lines")
    walked = F.aggregate(F.sequence(F.lit(0), total - 1), start, step,
                         lambda s: F.concat(s["parts"], F.array(F.struct(s["a"].alias("a"), total.alias("b")))))
    whole = F.array(F.struct(F.lit(0).alias("a"), total.alias("b")))
    rows = docs.select("doc_id", "text", F.split("text", "\n").alias("lines")).withColumn("lens", lens)
    parts = F.when(F.length("text") <= max_chars, whole).otherwise(walked)
    return (rows.select("doc_id", "lines", F.posexplode(parts).alias("part", "p"))
            .select("doc_id", "part", F.array_join(F.slice("lines", F.col("p.a") + 1, F.col("p.b") - F.col("p.a")), "\n").alias("text")))


def parse_answers(answers: DataFrame) -> DataFrame:
    """Answer text of every part (doc_id, part, answer) to a typed struct; bad JSON gives null."""
    data = F.from_json(text.unfence_json("answer"), ANSWER_SCHEMA + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    # explode of one element keeps the parse from being repeated per field read from it
    rows = answers.select(*[c for c in answers.columns if c != "data"], F.explode(F.array(data)).alias("data"))
    return rows.withColumn("data", F.when(F.col("data._bad").isNull(), F.col("data").dropFields("_bad")))


def answer_items(parsed: DataFrame) -> DataFrame:
    """Items of all parts of a document in order, numbered from 1."""
    each = parsed.select("doc_id", "part", F.col("data.ngay_hop").alias("meeting_day"), F.posexplode("data.items").alias("pos", "item"))
    out = ordered.number_rows(each, ["doc_id"], "part", ties=("pos",), name="item_id", start=1)
    return out.select("doc_id", "item_id", "part", "meeting_day", "item.noi_dung", "item.nguoi_thuc_hien", "item.chuc_danh",
                      "item.phong_ban", "item.ngay_bat_dau", "item.ngay_ket_thuc", "item.loai", "item.note")


def merge_answers(parsed: DataFrame) -> DataFrame:
    """One record per document: first title and day, numbered summaries, last conclusion, token sums.

    Texts are joined as they are; only empty ones don't count. Without a column ``tokens_used`` it is the sum of the other two.
    """
    part = F.col("part")
    ok = parsed.where("data is not null")
    there = lambda c: F.nullif(F.col(c), F.lit(""))
    first = lambda c: F.coalesce(F.min_by(there(c), F.when(there(c).isNotNull(), part)), F.lit(""))
    summary = there("data.tom_tat_cuoc_hop")
    used = F.col("tokens_used") if "tokens_used" in parsed.columns else F.col("prompt_tokens") + F.col("completion_tokens")
    # Summaries are numbered among the parts that have one.
    numbered = ordered.number_rows(ok.where(summary.isNotNull()).select("doc_id", "part", summary.alias("s")), ["doc_id"], "part", name="no", start=1)
    head = F.concat(F.lit("── Phần "), F.col("no").cast("string"), F.lit(" ──\n"), F.col("s"))
    sums = numbered.groupBy("doc_id").agg(F.when(F.count(F.lit(1)) == 1, F.first("s")).otherwise(ordered.ordered_join(head, "part", "\n\n")).alias("summary"))
    last = there("data.ket_luan_cuoc_hop")
    rest = ok.groupBy("doc_id").agg(
        first("data.ten_cuoc_hop").alias("title"), first("data.ngay_hop").alias("day"),
        F.coalesce(F.max_by(last, F.when(last.isNotNull(), part)), F.lit("")).alias("conclusion"),
        F.coalesce(F.sum(F.size("data.items")), F.lit(0)).alias("items"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum(used).alias("tokens_used"))
    return rest.join(sums, "doc_id", "left").withColumn("summary", F.coalesce("summary", F.lit("")))


def titles_before(items: DataFrame, parts: DataFrame, at_most: int | None = None) -> DataFrame:
    """Titles found in earlier parts of the same document, all or the latest ``at_most``, per part."""
    named = items.where(text.filled("title").isNotNull())
    placed = ordered.number_rows(named.select("doc_id", "item_id", "part", "title"), ["doc_id"], "item_id", name="p")
    counts = placed.groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = ordered.scan(parts.select("doc_id", "part").join(counts, ["doc_id", "part"], "left").withColumn("n", F.coalesce("n", F.lit(0))),
                        ["doc_id"], "part", sums={"c": F.col("n")})
    wanted = upto.withColumn("c", F.col("c") - F.col("n")).where("c > 0").select(
        "doc_id", "part", F.explode(F.sequence(F.lit(0) if at_most is None else F.greatest(F.lit(0), F.col("c") - at_most), F.col("c") - 1)).alias("p"))
    got = wanted.join(placed.select("doc_id", "p", "title"), ["doc_id", "p"])
    return got.groupBy("doc_id", "part").agg(ordered.ordered_join("title", "p", "\n").alias("titles"), F.count(F.lit(1)).alias("n"))


def enrich_items(items: DataFrame, matched: DataFrame, employees: DataFrame) -> DataFrame:
    """Items with their matched employee shown, dates defaulted and type derived."""
    staff = employees.select(F.col("name").alias("code"), "employee_name", "user_id", "designation")
    rows = items.join(matched.select("doc_id", "item_id", "code"), ["doc_id", "item_id"], "left").join(staff, "code", "left")
    hit = F.col("code").isNotNull()
    shown = text.join_filled(F.when(hit, F.col("employee_name")).otherwise(F.col("nguoi_thuc_hien")), "user_id", "designation")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select("doc_id", "item_id", F.col("noi_dung").alias("title"), shown.alias("assignee_display"),
                       F.coalesce(filled("ngay_bat_dau"), filled("meeting_day"), F.lit("")).alias("start_date"),
                       F.coalesce("ngay_ket_thuc", F.lit("")).alias("end_date"), text.task_type("loai").alias("task_type"),
                       F.lit(0).alias("weight"), F.coalesce("note", F.lit("")).alias("description"))


def duplicate_tasks(tasks: DataFrame, existing: DataFrame, as_written: bool = False) -> DataFrame:
    """Mark tasks that an open task already covers (subject, project and assignee).

    Stored subjects carry a type tag in front of the title; it is taken off
    before comparing unless ``as_written``.
    """
    subject = F.col("subject") if as_written else F.regexp_replace("subject", r"^\[[A-Z]+\] ", "")
    open_ = existing.where(F.col("status").isin(*OPEN_STATUSES)).select(
        subject.alias("_s"), F.nullif("project", F.lit("")).alias("_p"), F.col("custom_assignee").alias("_a")).distinct().withColumn("_dup", F.lit(True))
    hit = F.col("title").eqNullSafe(F.col("_s")) & F.nullif(F.col("project"), F.lit("")).eqNullSafe(F.col("_p")) \
        & F.col("assignee_hr_code").eqNullSafe(F.col("_a"))
    return tasks.join(open_, hit, "left").withColumn("duplicate", F.coalesce("_dup", F.lit(False))).drop("_s", "_p", "_a", "_dup")


def gate_batches(tasks: DataFrame, error: str | Column = "duplicate", batch: str = "batch") -> DataFrame:
    """All-or-nothing per batch: one failing task empties its batch. ``created`` tells which tasks go through."""
    bad = tasks.groupBy(batch).agg(F.bool_or(text.col(error)).alias("_bad"))
    return tasks.join(bad, batch).withColumn("created", ~F.col("_bad")).drop("_bad")


def task_payload(tasks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JSON record of each task: typed subject, ISO dates, no empty fields."""
    kind = F.coalesce("task_type", F.lit("task"))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    fields = [F.concat(F.lit("["), F.upper(kind), F.lit("] "), F.coalesce("title", F.lit("Task không tên"))).alias("subject"),
              F.lit("Open").alias("status"), filled("description").alias("description"), kind.alias("custom_loai_nhiem_vu"),
              times.parse_date("start_date").alias("exp_start_date"), times.parse_date("end_date").alias("exp_end_date"),
              filled("assignee_hr_code").alias("custom_assignee"), filled("project").alias("project"), F.lit(1).alias("is_group")]
    return tasks.select(*keys, text.drop_empty_json(*fields).alias("payload"))


def batch_report(tasks: DataFrame, batch: str = "batch", title_chars: int | None = None) -> DataFrame:
    """Created tasks per batch, the error it stopped at, and whether tasks made before the error were taken back.

    A batch goes in the order of ``seq`` and stops at its first duplicate, so it has one error at most.
    """
    title = F.col("title") if title_chars is None else F.substring("title", 1, title_chars)
    message = F.concat(F.lit("'"), title, F.lit("': Đã tồn tại (Trùng lặp)"))
    stopped = F.min(F.when(F.col("duplicate"), F.col("seq")))
    return tasks.groupBy(batch).agg(F.count_if("created").alias("created"), F.when(stopped.isNull(), 0).otherwise(1).alias("failed"),
                                    F.min_by(message, F.when(F.col("duplicate"), F.col("seq"))).alias("error"),
                                    F.coalesce(F.min("seq") < stopped, F.lit(False)).alias("rolled_back"))


def speaker_roles(speakers: DataFrame, employees: DataFrame) -> DataFrame:
    """name → role: by address for enrolled speakers, then by employee name and its spellings (which win)."""
    titled = employees.where(text.filled("designation").isNotNull())
    by_mail = (titled.where(text.filled("user_id").isNotNull()).groupBy(F.col("user_id").alias("email")).agg(F.max_by("designation", "name").alias("role")))
    first = speakers.where(text.filled("email").isNotNull()).join(by_mail, "email").select(
        F.col("name").alias("key"), "role", F.lit(0).alias("prio"), F.lit("").alias("code"))
    second = titled.where(text.filled("employee_name").isNotNull()).select(
        F.explode(text.spelling_variants("employee_name")).alias("key"), F.col("designation").alias("role"), F.lit(1).alias("prio"), F.col("name").alias("code"))
    return first.unionByName(second).groupBy("key").agg(F.max_by("role", F.struct("prio", "code")).alias("role"))


def enrolled_speakers(speakers: DataFrame, aliases: DataFrame, employees: DataFrame) -> DataFrame:
    """Enrolled voices under their own name, with the title of the employee at their address."""
    canon = aliases.select(F.col("alias").alias("name"), "canonical")
    erp = employees.where(text.filled("user_id").isNotNull()).groupBy(F.col("user_id").alias("email")).agg(
        F.max_by(F.coalesce("designation", F.lit("")), "name").alias("_d"))
    kept = speakers.join(canon, "name", "left").where(F.coalesce("canonical", F.trim("name")) == F.trim("name"))
    return kept.join(erp, "email", "left").select("name", "email", F.coalesce("_d", F.lit("")).alias("designation"))


def default_assignee(users: DataFrame, employees: DataFrame) -> DataFrame:
    """The employee record of each signed-in user, shown as ``name (code)``."""
    staff = employees.groupBy(F.col("user_id").alias("user")).agg(F.min_by(F.struct("employee_name", "name"), "name").alias("e"))
    shown = F.concat(F.col("e.employee_name"), F.lit(" ("), F.col("e.name"), F.lit(")"))
    return users.join(staff, "user", "left").select("user", F.coalesce(shown, F.lit("")).alias("assignee"))


def first_of(rows: DataFrame, order: str, at_most: int = 100) -> DataFrame:
    """The first rows in a stated order."""
    return rows.orderBy(order).limit(at_most)
