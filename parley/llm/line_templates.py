"""Line dedup by log templates: lines that recur across unrelated documents are dropped. DataFrame expressions only.

The parse tree has fixed depth: token count, leading tokens, then the rest of the line with its variable fields left
out. Tokens with a digit are always variable. Lines of at least ``WIDE`` tokens also stand under three wider templates
that leave out the last third, the middle third, or the first third after the leading tokens, so lines that differ
in one field share a template. A line goes if any of its templates recurs.

Copies of a whole document share all their lines, and that is not recurrence: a template counts once for all documents
with the same mark. The mark is the least md5 among a document's long tokens, which copies and near copies share and
unrelated documents hardly ever do. A recurring line must not bring the mark itself: each line takes the first of the
document's ``MARKS`` least tokens whose places, from its first to its last, are not near the line, else one that is not in it. Documents that hold little
but the line have the same mark for it and count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .registry import query, table

LEAST_TOKENS = 4   # shorter lines recur by chance
WIDE = 9
LEADING = 3
LONG_TOKEN = 12
LEAST_MARKS = 5
MD5 = 32           # its hex digits
MARKS = 8          # least tokens of a document to choose a line's mark from
AROUND = 4         # lines before and after a line that are near it


#: a long token or a line end, or nothing at the end of the text; what is short before it is passed over, so each character is read about once
PARTS = (f"(?:[^ \\n]{{0,{LONG_TOKEN - 1}}}+ )*+(?:[^ \\n]{{0,{LONG_TOKEN - 1}}}+(?=\\n|\\z))?+"
         f"([^ \\n]{{{LONG_TOKEN},}}+|\\n|\\z)")


def least_tokens(tokens: Column) -> Column:
    """The ``MARKS`` tokens with the least md5, as md5 and token in one string."""
    return F.slice(F.sort_array(F.transform(tokens, lambda t: F.concat(F.md5(t), t))), 1, MARKS)


def with_marks(docs: DataFrame) -> DataFrame:
    """``text`` and ``marks``, a hash for each line of a text: of the first least token that is nowhere near, else not in the line, else the first, else the text.

    Tokens are kept with their first and last line, told by the line ends before and after them. They are looked for among the long tokens and
    line ends alone (``long``), where they stand as often as in the text and on the same lines. So the work is bounded by ``MARKS`` times that,
    however often a token comes.
    """
    lines = F.split("text", "\n")

    def ends(part: Column) -> Column:
        return F.octet_length(part) - F.octet_length(F.replace(part, F.lit("\n"), F.lit("")))

    def placed(x: Column) -> Column:
        token = F.substr(x, F.lit(MD5 + 1))
        before, after = (F.call_function("substring_index", F.col("long"), token, F.lit(n)) for n in (1, -1))
        return F.struct(F.substr(x, F.lit(1), F.lit(MD5)).alias("md5"), token.alias("token"), ends(before).alias("first"),
                        (ends(F.col("long")) - ends(after)).alias("last"))

    parts = docs.select("text", F.regexp_extract_all("text", F.lit(PARTS), 1).alias("parts"))
    long = parts.select("text", F.array_distinct(F.array_remove(F.array_remove("parts", "\n"), "")).alias("tokens"), F.array_join("parts", " ").alias("long"))
    known = long.select("text", F.md5("text").alias("whole"), F.transform(least_tokens(F.col("tokens")), placed).alias("least"))
    return known.select("text", F.transform(lines, lambda line, i: F.xxhash64(F.coalesce(
        F.get(F.filter("least", lambda x: (i < x["first"] - AROUND) | (i > x["last"] + AROUND)), F.lit(0))["md5"],
        F.get(F.filter("least", lambda x: ~F.contains(line, x["token"])), F.lit(0))["md5"],
        F.get("least", F.lit(0))["md5"], F.col("whole")))).alias("marks"))


def masked(line: Column) -> Column:
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(line)


def templates(line: Column, tokens: Column) -> Column:
    """Hashes of the templates of a masked line: one, or four for a wide one. Tokens are what stands between blanks."""
    third = F.floor(tokens / 3).cast("int")

    def head(n: Column) -> Column:
        return F.call_function("substring_index", line, F.lit(" "), n)

    def tail(n: Column) -> Column:
        return F.call_function("substring_index", line, F.lit(" "), -n)

    one = F.xxhash64(F.lit("line"), line)
    more = F.array(
        one,
        F.xxhash64(F.lit("last"), tokens, head(tokens - third)),
        F.xxhash64(F.lit("middle"), tokens, head(third), tail(tokens - 2 * third)),
        F.xxhash64(F.lit("first"), tokens, head(F.lit(LEADING)), tail(tokens - third)),
    )
    return F.when(tokens >= WIDE, more).otherwise(F.array(one))


def _lines(docs: DataFrame, *keep: Column) -> DataFrame:
    """One row for each line of enough tokens: the kept columns, ``pos`` and ``line`` (masked), ``tokens``.

    What is kept is worked out for each document, before its text becomes lines; of ``marks`` each line keeps its own, as
    ``mark``. Masking never changes the token count.
    """
    whole = docs.select("text", *keep)
    names = [c for c in whole.columns[1:] if c != "marks"]
    marked = "marks" in whole.columns
    lines = F.split("text", "\n")
    item = F.transform(lines, lambda x, i: F.struct(x.alias("raw"), F.get("marks", i).alias("mark"))) if marked else F.transform(lines, lambda x: F.struct(x.alias("raw")))
    blanks = F.octet_length("raw") - F.octet_length(F.replace("raw", F.lit(" "), F.lit("")))
    split = whole.select(*names, F.posexplode(item).alias("pos", "item")).select(*names, "pos", "item.*").withColumn("tokens", (blanks + 1).cast("int"))
    kept = [*names, "mark"] if marked else names
    return split.where(F.col("tokens") >= LEAST_TOKENS).select(*kept, "pos", "tokens", masked(F.col("raw")).alias("line"))


def recurring(docs: DataFrame, least_marks: int = LEAST_MARKS) -> DataFrame:
    """``template`` hashes that documents of at least ``least_marks`` different marks have.

    Templates are counted in two steps, each with partial sums before its shuffle: first distinct (template, mark),
    then marks of a template, so a line that a third of the documents share gathers nowhere.
    """
    lines = _lines(with_marks(docs), F.col("marks"))
    pairs = lines.select("mark", F.explode(templates(F.col("line"), F.col("tokens"))).alias("template")).distinct()
    return pairs.groupBy("template").agg(F.count("*").alias("marks")).where(F.col("marks") >= least_marks).select("template")


def drop_recurring_lines(docs: DataFrame, least_marks: int = LEAST_MARKS) -> DataFrame:
    """The rows of ``docs`` with cleaned ``text``, all in a column ``row``, and ``n_lines``, ``n_dropped``, ``dropped_chars``.

    A null text stays null and has no lines; an empty one has one empty line. A text none of whose lines goes is left
    as it is; one that loses all becomes empty. Repeated rows stay repeated, ties don't arise, other columns are kept
    whatever their names, no documents give no rows.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    texts = rows.select(F.col("row.doc_id").alias("doc"), F.col("row.text").alias("text"))
    ids = (F.col("doc"), F.xxhash64("text").alias("same"))
    found = _lines(texts, *ids).select("doc", "same", "pos", F.explode(templates(F.col("line"), F.col("tokens"))).alias("template"))
    hit = found.join(recurring(texts, least_marks), "template", "left_semi")
    dropped = hit.groupBy("doc", "same").agg(F.collect_set("pos").alias("gone")).withColumnRenamed("doc", "d").withColumnRenamed("same", "s")
    joined = (rows.withColumn("same", F.xxhash64("row.text"))
              .join(dropped, F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.col("same") == F.col("s")), "left"))
    lines = F.split("row.text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    return (joined.withColumn("clean", text)
            .select(F.struct(*(F.col("clean" if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns)).alias("row"),
                    F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
                    F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
                    F.coalesce(F.length("row.text") - F.length("clean"), F.lit(0)).cast("long").alias("dropped_chars")))


@query("op10_log_templates", rf"""
    with d as (select doc_id, text, string_split(text, chr(10)) as lines,
                      list_sort(list_transform(list_distinct(regexp_extract_all(text, '[^ \n]{{{LONG_TOKEN},}}')), lambda x: {{'md5': md5(x), 'token': x}}))[1:{MARKS}] as least
               from documents),
    e as (select doc_id, text, lines, generate_subscripts(lines, 1) as pos, unnest(lines) as raw,
                 list_transform(least, lambda x: {{'md5': x.md5, 'token': x.token,
                     'first': len(string_split(text[:strpos(text, x.token)], chr(10))),
                     'last': len(lines) + 1 - len(string_split(reverse(text)[:strpos(reverse(text), reverse(x.token))], chr(10)))}}) as least from d),
    s as (select doc_id, text, pos, raw, coalesce(list_filter(least, lambda x: pos < x.first - {AROUND} or pos > x.last + {AROUND})[1].md5,
                      list_filter(least, lambda x: not contains(raw, x.token))[1].md5, least[1].md5, md5(text)) as mark from e),
    l as (select *, regexp_replace(raw, '[^ ]*[0-9][^ ]*', '<*>', 'g') as line from s),
    t as (select doc_id, text, mark, pos, line, string_split(line, ' ') as w from l),
    n as (select *, len(w) as n, len(w) // 3 as third from t where len(w) >= {LEAST_TOKENS}),
    k as (select doc_id, text, mark, pos, 'line' || line as template from n
          union all select doc_id, text, mark, pos, 'last' || n || array_to_string(w[:n - third], ' ') from n where n >= {WIDE}
          union all select doc_id, text, mark, pos, 'middle' || n || array_to_string(w[:third], ' ') || chr(10) || array_to_string(w[2 * third + 1:], ' ') from n where n >= {WIDE}
          union all select doc_id, text, mark, pos, 'first' || n || array_to_string(w[:{LEADING}], ' ') || chr(10) || array_to_string(w[third + 1:], ' ') from n where n >= {WIDE}),
    r as (select template from k group by template having count(distinct mark) >= {LEAST_MARKS}),
    g as (select distinct doc_id, text, pos from k semi join r using (template)),
    q as (select s.doc_id, s.text, s.pos, s.raw, g.pos is not null as gone from s left join g on s.doc_id is not distinct from g.doc_id and s.text = g.text and s.pos = g.pos)
    select doc_id, case when max(gone::int) = 0 then text else coalesce(string_agg(raw, chr(10) order by pos) filter (not gone), '') end as text,
           count(*) as n_lines, sum(gone::int)::bigint as n_dropped,
           (length(text) - length(case when max(gone::int) = 0 then text else coalesce(string_agg(raw, chr(10) order by pos) filter (not gone), '') end))::bigint as dropped_chars
    from q group by doc_id, text""")
def line_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = drop_recurring_lines(table(spark, sf_dir, "documents"))
    return clean.select("row.doc_id", "row.text", "n_lines", "n_dropped", "dropped_chars")
