"""URL filters: many glob rules simulated at once as a bit-parallel automaton.

Every rule is a glob over the canonical form ``.host/path``: ``*`` stands for any run without a slash, ``**`` for any
run, ``?`` for one character. All rules lie side by side in 64-bit words; one step reads one character of every URL of
a batch: ``D = (shift(D) & MASK[c]) | (D & LOOP[c])``. ``MASK[c]`` has the positions that read character c, ``LOOP[c]``
those that a star keeps alive. The work is the length of the URLs times the words of the rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .registry import query, table


@dataclass(frozen=True)
class Rule:
    """``glob`` over the canonical URL; the longest ``name`` among the rules that fit wins, then the earlier rule."""
    verdict: str
    glob: str
    name: str
    tier: int = 1  # a lower tier counts only where no rule of a higher one fits


def site_rule(verdict: str, site: str) -> Rule:
    """A rule for a host with all its subdomains and every path under a prefix, given as ``host/prefix``."""
    return Rule(verdict, f"*.{site}**", site, 2)


# fixed values: the site rules of the url report
SITE_RULES = (
    site_rule("allow", "org/"), site_rule("block", "example.org/es/"), site_rule("block", "example.org/en/1"),
    site_rule("allow", "com/fr/"), site_rule("block", "com/de/"),
)
#: verdicts where no site rule fits
GLOB_RULES = tuple(Rule("block", g, g) for g in (
    "**/login**", "**/signin**", "**/cart/**", "**/checkout/**", "**/wp-admin/**", "**/cgi-bin/**", "**/tag/**", "**/feed/",
    "*.ads.*/**", "*.track*.*/**", "**.exe", "**.zip", "**.jpg", "**.png", "**.gif", "**.css", "**.js",
))
DEFAULT = "allow"


@dataclass(frozen=True)
class Automaton:
    classes: dict[str, int]   # character -> column; 0 stands for all others
    mask: np.ndarray          # [column, word]
    loop: np.ndarray          # [column, word]
    start: np.ndarray         # [word]
    final: tuple[tuple[int, int], ...]  # (word, bit) of each rule


def compile_globs(globs: list[str]) -> Automaton:
    """Masks of all globs; the first position of each stands for nothing read yet."""
    parsed = []
    for g in globs:
        items: list[tuple[str | None, int]] = [(None, 0)]  # (character or None for any, star after it)
        i = 0
        while i < len(g):
            if g.startswith("**", i):
                items[-1] = (items[-1][0], 2)
                i += 2
            elif g[i] == "*":
                items[-1] = (items[-1][0], max(1, items[-1][1]))
                i += 1
            else:
                items.append((None if g[i] == "?" else g[i], 0))
                i += 1
        parsed.append(items)
    letters = sorted({c for items in parsed for c, _ in items if c} | {"/"})
    classes = {c: k for k, c in enumerate(letters, 1)}
    width = sum(map(len, parsed))
    words = max(1, -(-width // 64))
    bits = {name: [[0] * words for _ in range(len(letters) + 1)] for name in ("mask", "loop")}
    start, final, at = [0] * words, [], 0
    for items in parsed:
        start[at // 64] |= 1 << at % 64
        for k, (c, star) in enumerate(items):
            w, b = divmod(at, 64)
            for col in range(len(letters) + 1):
                if k and (c is None or classes[c] == col):
                    bits["mask"][col][w] |= 1 << b
                if star == 2 or star == 1 and col != classes["/"]:
                    bits["loop"][col][w] |= 1 << b
            at += 1
        final.append(divmod(at - 1, 64))
    array = {k: np.array(v, dtype=np.uint64) for k, v in bits.items()}
    return Automaton(classes, array["mask"], array["loop"], np.array(start, dtype=np.uint64), tuple(final))


def matches(auto: Automaton, texts: list[str]) -> np.ndarray:
    """[text, rule]: whether the rule fits the whole text. Texts of a batch are read together, longest first."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
    state = np.tile(auto.start, (len(texts), 1))
    flat = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.zeros(int(flat.max(initial=0)) + 1 if flat.size else 1, dtype=np.uint16)
    for c, k in auto.classes.items():
        if ord(c) < len(codes):
            codes[ord(c)] = k
    cols, begin = codes[flat], np.concatenate([[0], np.cumsum(lengths)[:-1]])
    alive = len(texts)
    one, top = np.uint64(1), np.uint64(63)
    for p in range(int(lengths[0]) if len(texts) else 0):
        while lengths[alive - 1] <= p:
            alive -= 1
        d = state[:alive]
        c = cols[begin[:alive] + p]
        shifted = d << one
        shifted[:, 1:] |= d[:, :-1] >> top
        state[:alive] = (shifted & auto.mask[c]) | (d & auto.loop[c])
    out = np.zeros((len(texts), len(auto.final)), dtype=bool)
    for k, (w, b) in enumerate(auto.final):
        out[order, k] = (state[:, w] >> np.uint64(b)) & one != 0
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), tail


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + GLOB_RULES, default: str = DEFAULT, step: int = 4096) -> DataFrame:
    """One row per page row: ``page_id``, ``host``, ``path``, ``rule`` (name of the deciding site rule, else null), ``glob``, ``verdict``.

    The rules are a parameter of bounded size and travel with the task. A null or unparsable url has an empty host
    and path and gets the verdict of whatever fits the empty site, else ``default``. Repeated rows stay repeated;
    other columns are ignored.
    """
    auto = compile_globs([r.glob for r in rules])
    rank = sorted(range(len(rules)), key=lambda i: (-rules[i].tier, -len(rules[i].name), i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                hit = matches(auto, ["." + h + p for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())])
                first = [next((i for i in rank if row[i]), None) for row in hit]
                name = [rules[i].name if i is not None and rules[i].tier == 2 else None for i in first]
                glob = [rules[i].glob if i is not None else None for i in first]
                verdict = [rules[i].verdict if i is not None else default for i in first]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(name, pa.string()), pa.array(glob, pa.string()),
                                                  pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "glob", "verdict"])

    host, path = split_url(F.col("url"))
    three = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    return three.mapInArrow(run, f"page_id {three.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, glob string, verdict string")


def _regex(glob: str) -> str:
    parts = glob.replace("**", "\0").split("*")
    text = "[^/]*".join("".join("\\" + c if c in ".+()[]{}^$|\\" else "." if c == "?" else c for c in p) for p in parts)
    return text.replace("\0", ".*")


def _oracle() -> str:
    def case(rules: list[Rule], out: str) -> str:
        ordered = sorted(rules, key=lambda r: -len(r.name))
        return " ".join(f"when regexp_full_match('.' || host || path, '{_regex(r.glob)}', 's') then '{getattr(r, out)}'" for r in ordered)

    site, rest = list(SITE_RULES), list(GLOB_RULES)
    return f"""
    with u as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
    s as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from u)
    select page_id, host, path, case {case(site, 'name')} end as rule, case {case(site, 'verdict')} {case(rest, 'verdict')} else '{DEFAULT}' end as verdict,
           case {case(site, 'glob')} {case(rest, 'glob')} end as glob
    from s"""


@query("op7_url_globs", _oracle())
def url_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "glob")
