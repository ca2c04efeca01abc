"""Speaker labels, source keys and access rules as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, filled, normalize_whitespace, squish, strip

# Markers of an unnamed speaker, icons, suffixes, placeholders.
UNKNOWN_MARKERS = ["Speaker", "Người lạ", "Unknown", "Không tên"]
ICON = "👤 "
VOICE_SUFFIX = " - Voice Speaker"
NO_EMAIL = "Chưa cập nhật"
STRANGER_LABEL = "^👤 (?:Speaker|Người lạ) \\d+$"
# End of fixed values.


def is_unknown(label: str | Column) -> Column:
    t = F.coalesce(strip(label), F.lit(""))
    return (t == "") | t.rlike("|".join(UNKNOWN_MARKERS))


def plain_name(label: str | Column) -> Column:
    """Name without icons, bracketed parts and percent scores."""
    t = F.regexp_replace(F.coalesce(col(label), F.lit("")), r"[\x{1F464}-\x{1F469}]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\(.*?\)", ""), r"(?U)-\s*\d+%", "")
    return normalize_whitespace(t)


def strip_icon(label: str | Column) -> Column:
    """Text without leading person icons."""
    t = strip(F.coalesce(col(label), F.lit("")))
    return strip(F.regexp_replace(t, r"(?U)^[\x{1F464}-\x{1F469}\x{200D}\x{FE0F}\s]+", ""))


def without_voice_suffix(text: str | Column) -> Column:
    """Peel every trailing voice suffix; text that is only suffixes stays as it is."""
    t = col(text)
    return F.coalesce(filled(F.regexp_replace(t, r"(?U)(?:" + VOICE_SUFFIX + r"\s*)+\z", "")), t)


def display_label(name: str | Column, email: str | Column, speaker_id: str | Column) -> Column:
    """Icon and name with a known address; an unnamed speaker shows as a group of its id."""
    n, e = col(name), F.coalesce(col(email), F.lit(""))
    shown = F.when((e == "") | (F.lower(e) == NO_EMAIL.lower()), n).otherwise(F.concat(n, F.lit(" ("), e, F.lit(")")))
    return F.concat(F.lit(ICON), F.when(n == "Speaker", F.concat(F.lit("Unknown_Group_"), col(speaker_id)))
                    .when(n.isNull(), F.concat(F.lit("Unknown_Group_Fallback_"), col(speaker_id))).otherwise(shown))


def chunk_index(speaker_id: str | Column) -> Column:
    """Chunk number inside an id like c3_speaker_1; null when there is none."""
    return F.regexp_extract(col(speaker_id), r"^c(\d+)_", 1).try_cast("int")


def chunk_prefix(speaker_id: str | Column) -> Column:
    p = F.nullif(F.regexp_extract(col(speaker_id), r"^(c\d+(?:_resume\d*)*)_", 1), F.lit(""))
    return F.coalesce(p, F.lit("all"))


def speaker_key(label: str | Column, default: str = "Speaker 1") -> Column:
    """Id form of a spoken label: blanks to underscores, lower-case."""
    return F.lower(F.replace(F.coalesce(col(label), F.lit(default)), F.lit(" "), F.lit("_")))


def source_key(sources: Sequence[str | Column], label: str | Column) -> Column:
    """First non-empty source id, else the label, with its kind in front."""
    src = strip(F.coalesce(*[F.nullif(col(s), F.lit("")) for s in sources]))
    return F.coalesce(F.concat(F.lit("source:"), F.nullif(src, F.lit(""))),
                      F.concat(F.lit("label:"), filled(label)), F.lit(""))


def chunk_key(*chunks: str | Column) -> Column:
    first = strip(F.coalesce(*[F.nullif(col(c).cast("string"), F.lit("")) for c in chunks]))
    return F.coalesce(F.concat(F.lit("chunk:"), F.nullif(first, F.lit(""))), F.lit(""))


def stated_raw_label(raw_speaker: str | Column, speaker: str | Column) -> Column:
    """Raw label as written, icon removed when it names a person; null when nothing is written."""
    t = strip(F.coalesce(F.nullif(col(raw_speaker), F.lit("")), F.nullif(col(speaker), F.lit(""))))
    t = F.nullif(t, F.lit(""))
    return F.when(t.startswith(ICON) & ~is_unknown(t), strip(F.substring(t, 3, 2**31 - 1))).otherwise(t)


def can_access(owner: str | Column, user: str | Column, roles: Column | None = None, *,
               any_signed_in: bool = False, manager_roles: Sequence[str] = ("System Manager",)) -> Column:
    """Owner, administrator or manager may open a meeting; optionally every signed-in user may."""
    u = F.coalesce(col(user), F.lit(""))
    signed_in = ~u.isin("", "Guest")
    if any_signed_in:
        return signed_in
    ok = (u == "Administrator") | F.coalesce(col(owner) == u, F.lit(False))
    if roles is not None:
        ok = ok | F.coalesce(F.arrays_overlap(roles, F.array(*[F.lit(r) for r in manager_roles])), F.lit(False))
    return signed_in & ok


def tidy(label: str | Column) -> Column:
    return squish(F.coalesce(col(label), F.lit("")))
