"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases, tags are parsed as expressions.

A text is brought to its words (ASCII separators become one blank, A-Z is lower-cased) and read once by the automaton.
After an identifier tag the original text is read as a licence expression: a shunting-yard parser turns identifiers,
``and``, ``or``, ``with`` and brackets into postfix order, which is evaluated to the labels it names and to whether every
choice it leaves is permissive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .registry import query, table

# fixed values: phrases of the base report and their labels
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: further notice phrases, as words, with the label and how much weight a single notice has
NOTICES = {
    "apache license version 2 0": ("apache-2.0", 0.9), "gnu general public license version 3": ("gpl-3.0", 0.9),
    "gnu general public license version 2": ("gpl-2.0", 0.9), "lesser general public license": ("lgpl", 0.8),
    "affero general public license": ("agpl", 0.8), "mozilla public license": ("mpl", 0.8), "eclipse public license": ("epl", 0.8),
    "creative commons attribution": ("cc-by", 0.7), "licensed under cc by": ("cc-by", 0.8), "licensed under cc by nc": ("cc-by-nc", 0.9),
    "licensed under cc by sa": ("cc-by-sa", 0.9), "cc0 1 0 universal": ("cc0", 0.9), "bsd 3 clause": ("bsd-3-clause", 0.8),
    "bsd 2 clause": ("bsd-2-clause", 0.8), "redistribution and use in source and binary forms": ("bsd", 0.8), "isc license": ("isc", 0.8),
    "boost software license": ("bsl", 0.8), "released into the public domain": ("public-domain", 0.7), "all rights reserved": ("reserved", 0.4),
    "permission is hereby granted free of charge": ("mit", 0.8),
}
TAG = "spdx license identifier"
TAG_TEXT = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*", re.I | re.A)
PERMISSIVE = {"mit", "apache", "bsd", "isc", "zlib", "unlicense", "cc0", "bsl", "cc-by", "0bsd"}
BASE_WEIGHT, TAG_WEIGHT = 0.7, 1.0

_NOT_WORD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else _NOT_WORD[c] for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8: runs of digits, ASCII letters and all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


OPERATORS = {"or": 1, "and": 2, "with": 3}
PIECE = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+:-]+)")


@dataclass
class Expression:
    labels: set[str] = field(default_factory=set)
    permissive: bool = False


def _evaluate(postfix: list[str]) -> Expression | None:
    stack: list[Expression] = []
    for x in postfix:
        if x not in OPERATORS:
            stem = x.rstrip("+")
            stack.append(Expression({stem}, any(stem == p or stem.startswith(p + "-") for p in PERMISSIVE)))
            continue
        if len(stack) < 2:
            return None
        b, a = stack.pop(), stack.pop()
        if x == "with":  # the exception belongs to the licence before it
            stack.append(Expression({f"{n} with {e}" for n in a.labels for e in b.labels}, a.permissive))
        else:
            both = a.permissive and b.permissive if x == "and" else a.permissive or b.permissive
            stack.append(Expression(a.labels | b.labels, both))
    return stack[0] if len(stack) == 1 else None


def parse_expression(text: str, at: int = 0) -> tuple[Expression | None, int]:
    """The licence expression that begins at ``at``, and where it ends; None where none begins there.

    Reading stops at the end of the line, at an unmatched bracket and where an operand and an operator don't alternate,
    so text after the expression doesn't matter. A left-over operator at the end is given back.
    """
    out: list[str] = []
    ops: list[str] = []
    need, end = True, at
    closed: tuple[int, list[str], int] | None = None  # the longest complete expression so far: its part of ``out``, operators left, end
    while m := PIECE.match(text, at):
        x = m[1].lower()
        if x == "(":
            if not need:
                break
            ops.append(x)
        elif x == ")":
            if need or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif x in OPERATORS:
            if need:
                break
            while ops and ops[-1] != "(" and OPERATORS[ops[-1]] >= OPERATORS[x]:
                out.append(ops.pop())
            ops.append(x)
            need = True
        else:
            if not need:
                break
            out.append(x.rstrip(".:-") or x)
            need = False
        at = end = m.end()
        if not need and "(" not in ops:
            closed = (len(out), ops[::-1], end)
    if closed is None:
        return None, end
    return _evaluate(out[:closed[0]] + closed[1]), closed[2]


def build_automaton(notices: dict[str, tuple[str, float]] = NOTICES) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    phrases: dict[str, list[tuple[str, str, float]]] = {}
    for p, label in BASE.items():
        phrases.setdefault(p, []).append(("base", label, BASE_WEIGHT))
    for p, (label, weight) in notices.items():
        phrases.setdefault(p, []).append(("notice", label, weight))
    phrases.setdefault(TAG, []).append(("tag", "", TAG_WEIGHT))
    for p, what in phrases.items():
        a.add_word(f" {p} ", (len(p), what))
    a.make_automaton()
    return a


def scan(text: str | None, automaton: ahocorasick.Automaton) -> dict:
    """Words, base places, labels and score of one text. The score is the chance that at least one notice is meant, by weights."""
    words = words_of(text)
    norm = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    first = last = None
    n_base, base, labels, miss, tagged = 0, set(), set(), 1.0, False
    counted, place = 0, 0  # blanks before this position
    for end, (length, what) in automaton.iter(norm):
        for kind, label, weight in what:
            if kind == "tag":
                tagged = True
                continue
            miss *= 1 - weight
            labels.add(label)
            if kind == "base":
                at = end - length - 1  # the blank that leads the match; a match can begin before the last one
                place += norm.count(" ", counted, at) if at >= counted else -norm.count(" ", at, counted)
                counted = at
                n_base += 1
                base.add(label)
                first = place if first is None else min(first, place)
                last = place if last is None else max(last, place)
    expressions = []
    if tagged:
        for m in TAG_TEXT.finditer(text or ""):
            e, end = parse_expression(text, m.end())
            if e is not None:
                expressions.append({"start": m.start(), "end": end, "labels": sorted(e.labels), "permissive": e.permissive})
                labels |= e.labels
                miss = 0.0
    return {"n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last, "base_labels": sorted(base),
            "labels": sorted(labels), "expressions": expressions, "score": 1 - miss}


FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())),
          ("labels", pa.list_(pa.string())),
          ("expressions", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("labels", pa.list_(pa.string())), ("permissive", pa.bool_())]))),
          ("score", pa.float64())]
SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
          "expressions array<struct<start:int,end:int,labels:array<string>,permissive:boolean>>, score double")


def find_licences(docs: DataFrame, notices: dict[str, tuple[str, float]] = NOTICES) -> DataFrame:
    """One row per document row with what its text says about licences.

    A null or empty text has no words, no labels and score 0; repeated rows stay repeated; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton(notices)
        for b in batches:
            rows = [scan(t, automaton) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[n] for r in rows], kind) for n, kind in FIELDS)],
                                             names=["doc_id", *(n for n, _ in FIELDS)])

    two = docs.select("doc_id", "text")
    return two.mapInArrow(run, f"doc_id {two.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


@query("op6_licence_automaton")
def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licences(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "n_words", "n_base", "first_word", "last_word", "array_join(base_labels, ',') base_labels",
                            "array_join(labels, ',') labels", "score", "cast(size(expressions) as long) n_expressions")
