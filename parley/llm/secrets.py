"""Secret scans: fixed patterns, and values in a credential context whose guess cost is high.

The guess cost of a value is the cheapest way to spell it as a row of common words, dates, repeats, keyboard
walks and brute-force spans, found by dynamic programming over its positions. Costs are powers of ten and add up;
every further segment costs ``SEGMENT`` more. The work is linear in the length of the value.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .registry import query, table

# fixed values: patterns of the three plain kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this equals longer runs of [0-9a-f]+
KINDS = ("assign", "access", "hex", "guess")

#: names that announce a credential, wider than the plain pattern; the value may be quoted and hold any characters
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|secret|auth|encryption)[_-]?key|client[_-]?secret|bearer)"""
    r"""["']?[ \t]*(?:=>|:=|[:=])[ \t]*(?:"([^"\n]{6,})"|'([^'\n]{6,})'|([^\s"',;<>()]{6,}))""", re.I | re.A)
MARKS = ("pass", "pwd", "secret", "token", "credential", "key", "bearer")

#: common password words, most common first
WORDS = (
    "password", "admin", "welcome", "login", "letmein", "master", "dragon", "monkey", "shadow", "sunshine", "princess", "football",
    "baseball", "iloveyou", "trustno", "superman", "batman", "hello", "freedom", "whatever", "secret", "token", "test", "user", "guest",
    "root", "default", "changeme", "example", "sample", "dummy", "placeholder", "your", "here", "none", "null", "true", "false", "pass",
    "word", "key", "api", "demo", "love", "god", "money", "summer", "winter", "spring", "autumn", "flower", "star", "home", "work",
    "server", "system", "service", "public", "private", "access", "account", "email", "mail", "name", "data", "base", "cloud", "local",
    "host", "dev", "prod", "stage", "temp", "change", "this", "please", "enter", "value", "string", "the", "and", "for", "not",
)
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
LEET = str.maketrans({"4": "a", "@": "a", "8": "b", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"})
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")
SEGMENT = math.log10(2)
BRUTE = 1.0  # ten guesses for every character


def _adjacent() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for i, c in enumerate(row):
            for rr, ii in ((r, i - 1), (r, i + 1), (r - 1, i), (r - 1, i + 1), (r + 1, i - 1), (r + 1, i)):
                if 0 <= rr < len(ROWS) and 0 <= ii < len(ROWS[rr]):
                    near.setdefault(c, set()).add(ROWS[rr][ii])
    for a, b in zip(ALPHABET, ALPHABET[1:]):
        near[a].add(b)
        near[b].add(a)
    return near


NEAR = _adjacent()


def _word_spans(value: str, ranks: dict[str, int], longest: int) -> Iterator[tuple[int, int, float]]:
    low = value.lower()
    plain = low.translate(LEET)
    for i in range(len(value)):
        for j in range(i + 3, min(len(value), i + longest) + 1):
            for form, extra in ((low, 0.0), (plain, SEGMENT)):
                rank = ranks.get(form[i:j])
                if rank is not None:
                    part = value[i:j]
                    upper = 0.0 if part.islower() or not any(c.isalpha() for c in part) else SEGMENT if part.isupper() or part[1:].islower() else 2 * SEGMENT
                    yield i, j, math.log10(rank + 1) + upper + extra
                    break


def _walk_spans(value: str) -> Iterator[tuple[int, int, float]]:
    low, i = value.lower(), 0
    while i < len(low) - 2:
        j, turns, before = i, 0, None
        while j + 1 < len(low) and low[j + 1] in NEAR.get(low[j], ()):
            step = ord(low[j + 1]) - ord(low[j])
            turns += step != before
            before = step
            j += 1
        if j - i >= 2:
            yield i, j + 1, math.log10(47) + min(turns, j - i) * math.log10(4.6) / 2 + math.log10(j - i + 1)
        i = max(j, i + 1)


REPEAT = re.compile(r"(.{1,8}?)\1+", re.S)


def guess_cost(value: str, words: tuple[str, ...] = WORDS, _inside: bool = False) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs; 0 for an empty value."""
    n = len(value)
    if n == 0:
        return 0.0
    ranks = {w: r for r, w in enumerate(words, 1)}
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _word_spans(value, ranks, max(map(len, words), default=0)):
        ends.setdefault(j, []).append((i, cost))
    for i, j, cost in _walk_spans(value):
        ends.setdefault(j, []).append((i, cost))
    for m in DATE.finditer(value):
        years = max(20, *(abs(int(y) - 2020) for y in re.findall(r"(?:19|20)\d\d", m[0])[:1]))
        ends.setdefault(m.end(), []).append((m.start(), math.log10(years) + (math.log10(365) if len(m[0]) > 4 else 0)))
    if not _inside:
        for m in REPEAT.finditer(value):
            unit = m[1]
            cost = guess_cost(unit, words, True) + math.log10((m.end() - m.start()) // len(unit))
            ends.setdefault(m.end(), []).append((m.start(), cost))
    best = [0.0] + [math.inf] * n          # cheapest way to spell value[:j]
    brute = [math.inf] * (n + 1)           # the same, ending inside a brute-force span
    for j in range(1, n + 1):
        brute[j] = min(best[j - 1] + (SEGMENT if j > 1 else 0), brute[j - 1]) + BRUTE
        best[j] = min([brute[j]] + [best[i] + cost + (SEGMENT if i else 0) for i, cost in ends.get(j, ())])
    return best[n]


def scan(text: str | None, least: float = 10.0, words: tuple[str, ...] = WORDS) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, cost) of every span in one text, in code points, by start and then kind."""
    if not text:
        return []
    found: list[tuple[str, int, int, float | None]] = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "key")) or not text.isascii():
        found += [("assign", m.start(), m.end(), guess_cost(m[2], words)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    if any(x in low for x in MARKS) or not text.isascii():
        for m in CONTEXT.finditer(text):
            value = m.group(m.lastindex)
            cost = guess_cost(value, words)
            if cost >= least:
                found.append(("guess", m.start(m.lastindex), m.end(m.lastindex), cost))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


SPANS = "array<struct<kind:string,start:int,end:int,cost:double>>"


def find_secrets(docs: DataFrame, least: float = 10.0, words: tuple[str, ...] = WORDS) -> DataFrame:
    """One row per document row: ``doc_id`` and ``spans``.

    Kinds: ``assign``, ``access`` and ``hex`` are fixed patterns; ``guess`` is the value after a credential name
    whose guess cost is at least ``least`` powers of ten. A null or empty text has no spans; a null id stays null;
    repeated rows give repeated rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())]))
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end", "cost"), x)) for x in scan(t, least, words)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    two = docs.select("doc_id", "text")
    return two.mapInArrow(run, f"doc_id {two.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op2_secret_guess_cost")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"), count("guess"),
        F.array_max(F.transform("spans", lambda s: s["cost"])).alias("highest_cost"))
