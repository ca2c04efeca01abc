"""Text cleaning and parsing as Columns. Nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases and replacements below decide results.
DOMAIN_REPLACEMENTS = {
    "Nhật trình": "Tờ trình",
    "nhật trình": "tờ trình",
    "Nhặt trình": "Tờ trình",
    "nhặt trình": "tờ trình",
}
FILLER_ONLY = ["dạ", "vâng", "ừ", "ừm", "ờ", "à", "okay", "ok", "được anh", "dạ em hiểu rồi"]
FILLER_PHRASES = ["ừm", "ờ", "à", "thì là", "ý là", "tức là", "kiểu như", "vậy á", "nha anh", "đó nha", "nghen"]
STOCK_PHRASES_SHORT = [
    "xong rồi gì nữa", "em xích lên cho", "cảm ơn các bạn", "xin chào", "tạm biệt", "cảm ơn", "hết", "chào các bạn",
]
STOCK_PHRASES = STOCK_PHRASES_SHORT + ["ừ", "ừm", "ờ", "ok", "dạ", "vâng", "dạ vâng", "à", "ờm"]
HONORIFICS = ["mr\\.?", "ms\\.?", "mrs\\.?", "anh", "chị", "chi", "ông", "bà", "ba", "em", "bạn", "chú", "cô", "bác"]
CONTROL_CHARACTERS = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"
# End of fixed values.


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: str | Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def strip(c: str | Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+\z", "")


def squish(c: str | Column) -> Column:
    """Collapse white-space runs to one blank and trim."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def clean_segment_text(c: str | Column) -> Column:
    """Readable form of one spoken turn; empty when the turn is only a filler word."""
    t = strip(F.coalesce(col(c), F.lit("")))
    for old, new in DOMAIN_REPLACEMENTS.items():
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"(?U)\s+([,.!?;:])", "$1")
    only = t.rlike(r"(?iU)^\s*(?:" + "|".join(FILLER_ONLY) + r")[\s,.!?;:]*\z")
    # Phrases go one after the other, since one removal can bring the parts of another together;
    # a turn without any of them skips them all.
    u = t
    for phrase in FILLER_PHRASES:
        u = F.regexp_replace(u, r"(?iU)(?<!\w)" + phrase + r"(?!\w)[\s,]*", "")
    t = F.when(t.rlike(r"(?iU)(?<!\w)(?:" + "|".join(FILLER_PHRASES) + r")(?!\w)"), u).otherwise(t)
    t = F.regexp_replace(t, r"(?iU)(?<!\w)(\w+)(?:\s+\1(?!\w))+", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), "^[ ,]+|[ ,]+$", "")
    t = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 2**31 - 1))
    return F.when(only, F.lit("")).otherwise(t)


def normalize_whitespace(c: str | Column) -> Column:
    return squish(strip_control(F.coalesce(col(c), F.lit(""))))


def strip_control(c: str | Column) -> Column:
    return F.regexp_replace(col(c), CONTROL_CHARACTERS, "")


def drop_ellipsis(c: str | Column) -> Column:
    return squish(F.regexp_replace(squish(c), r"\.{2,}", " "))


def is_meaningful(c: str | Column, phrases: Sequence[str] = STOCK_PHRASES, max_words: int = 5) -> Column:
    """False for empty turns, turns of symbols or digits, and stock phrases."""
    t = strip(F.regexp_replace(strip(F.coalesce(col(c), F.lit(""))), r"(?U)^\.{2,}\s*|\s*\.{2,}\z", ""))
    low = squish(F.lower(t))
    stock = low.isin(*phrases) & (F.size(F.split(low, " ")) <= max_words)
    return ~((t == "") | t.rlike(r"(?U)^[\W\d]+\z") | stock)


def norm_name(c: str | Column) -> Column:
    """Lower-case name without honorifics."""
    t = F.lower(strip(F.coalesce(col(c), F.lit(""))))
    return squish(F.regexp_replace(t, r"(?U)\b(" + "|".join(HONORIFICS) + r")\b", ""))


def name_tokens(c: str | Column) -> Column:
    """Distinct words of a normal name, one-letter words dropped."""
    return F.array_distinct(F.filter(F.split(norm_name(c), " "), lambda w: F.length(w) > 1))


def token_overlap(a: str | Column, b: str | Column) -> Column:
    """Shared words over the larger of two word sets; 0 when either is empty."""
    a, b = col(a), col(b)
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / F.greatest(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def word_tokens(c: str | Column) -> Column:
    """Case-folded words with punctuation removed."""
    t = squish(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"(?U)[^\w\s]", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def split_words(c: str | Column) -> Column:
    """White-space words of a text."""
    t = squish(F.coalesce(col(c), F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def word_count(c: str | Column) -> Column:
    return F.size(split_words(c))


def task_type(c: str | Column) -> Column:
    return F.when(F.lower(F.coalesce(col(c), F.lit(""))).rlike("noti|thông báo"), "noti").otherwise("task")


def employee_code(display: str | Column, given: str | Column) -> Column:
    """Employee code written inside a display text, else the given one."""
    d = F.coalesce(col(display), F.lit(""))
    inside = F.nullif(F.regexp_extract(d, r"\((HR[-_]EMP[-_][^)]+)\)", 1), F.lit(""))
    return (F.when(F.contains(d, F.lit("(HR")), F.coalesce(inside, col(given)))
            .when(d.rlike("^(HR_EMP_|HR-EMP-)"), strip(d)).otherwise(col(given)))


def join_filled(*cols: str | Column, sep: str = " - ") -> Column:
    """Non-empty parts joined by a separator."""
    return F.concat_ws(sep, *[F.nullif(col(c), F.lit("")) for c in cols])


def employee_option(name: str | Column, user_id: str | Column, designation: str | Column) -> Column:
    """Picker label: name, account when it differs, title unless the name already says it."""
    n = F.coalesce(F.nullif(col(name), F.lit("")), F.nullif(col(user_id), F.lit("")), F.lit(""))
    said = (col(designation) == "Voice Speaker") & F.contains(n, F.lit("Voice Speaker"))
    return join_filled(n, F.when(col(user_id) != n, col(user_id)), F.when(~said, col(designation)))


def option_matches(label: str | Column, query: str | Column) -> Column:
    q = col(query)
    return F.coalesce(q == "", F.lit(True)) | F.contains(F.lower(col(label)), F.lower(q))


def unfence_json(c: str | Column) -> Column:
    """Answer text without a code fence."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"```json\s*", ""), "```", ""))


def vocabulary_terms(c: str | Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), strip), lambda x: F.length(x) > 0)


def missing_core_fields(project: str | Column, assignee: str | Column, end_date: str | Column) -> Column:
    """Names of the required task fields that are empty."""
    named = [("project", project), ("assignee", assignee), ("end_date", end_date)]
    return F.array_compact(F.array(*[F.when(filled(c).isNull(), F.lit(n)) for n, c in named]))


def drop_empty_json(*fields: Column) -> Column:
    """JSON object of the given named columns without null or empty fields."""
    return F.to_json(F.struct(*fields))


def minute_file_name(department: str | Column, subject: str | Column, when: str | Column,
                     fallback: str | Column, max_chars: int | None = None) -> Column:
    def safe(c):
        t = squish(F.regexp_replace(F.coalesce(col(c), F.lit("")), r'[\\/:*?"<>|]+', " "))
        return F.nullif(F.regexp_replace(t, "^[ -]+|[ -]+$", ""), F.lit(""))

    day = F.date_format(col(when), "d.M.yyyy")
    dept, subj = safe(department), safe(subject)
    name = F.when(F.coalesce(dept, subj, day).isNotNull(), F.concat_ws(" - ", dept, F.lit("BBH"), subj, day)) \
        .otherwise(F.concat(col(fallback), F.lit(" - BBH")))
    if max_chars is not None:
        name = F.when(F.length(name) > max_chars, F.regexp_replace(F.substring(name, 1, max_chars), "[ -]+$", "")).otherwise(name)
    return F.concat(name, F.lit(".docx"))


def spelling_variants(name: str | Column) -> Column:
    """The name with both accent positions of uy, each plain and lower-case, without repeats."""
    # Accent pairs.
    pairs = [("úy", "uý"), ("ủy", "uỷ"), ("ũy", "uỹ"), ("ụy", "uỵ"), ("ùy", "uỳ")]
    fwd = back = col(name)
    for a, b in pairs:
        fwd, back = F.replace(fwd, F.lit(a), F.lit(b)), F.replace(back, F.lit(b), F.lit(a))
    forms = [col(name), fwd, back]
    return F.array_distinct(F.array(*forms, *[F.lower(strip(f)) for f in forms]))
