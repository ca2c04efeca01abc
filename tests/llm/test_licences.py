import re

import pytest
from hypothesis import given, settings, strategies as st

from parley.llm import licences

from .helpers import documents, odd, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = []
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    places = [i for i, _ in found]
    return len(w), len(found), min(places, default=None), max(places, default=None), sorted({x for _, x in found})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "license", "License", "apache", "general", "public", "GENERAL PUBLIC LICENSE", " ", "-", "\n", "\u00a0", "é", ".", "\x7f", "mit license"]), max_size=20).map("".join))
def test_base_places(text):
    got = licences.scan(text, licences.build_automaton())
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == plain(text)
    assert set(got["base_labels"]) <= set(got["labels"]) and 0 <= got["score"] <= 1


@pytest.mark.parametrize("text,labels,permissive", [
    ("MIT", {"mit"}, True), ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl-2.0-only with classpath-exception-2.0"}, False),
    ("(MIT OR GPL-3.0) AND Apache-2.0", {"mit", "gpl-3.0", "apache-2.0"}, True), ("MIT AND GPL-3.0 OR GPL-2.0", {"mit", "gpl-3.0", "gpl-2.0"}, False),
    ("GPL-3.0 AND (BSD-3-Clause OR MIT", {"gpl-3.0"}, False), ("MIT and some text", {"mit", "some"}, False), ("MIT OR", {"mit"}, True),
    ("LGPL-2.1+ or zlib.\nnext", {"lgpl-2.1", "zlib"}, True),
])
def test_expressions(text, labels, permissive):
    e, _ = licences.parse_expression(text)
    assert e.labels == labels and e.permissive == permissive


@pytest.mark.parametrize("text", ["", ")", "AND MIT", "(", "(MIT", "  "])
def test_no_expression(text):
    assert licences.parse_expression(text)[0] is None


def test_tags_and_notices():
    got = licences.scan("# SPDX-License-Identifier: Apache-2.0 OR MIT\nLicensed under CC BY-NC 4.0.", licences.build_automaton())
    assert set(got["labels"]) == {"apache-2.0", "mit", "cc-by", "cc-by-nc"} and got["score"] == 1 and got["n_base"] == 0
    assert got["expressions"] == [{"start": 2, "end": 44, "labels": ["apache-2.0", "mit"], "permissive": True}]


def test_query_on_odd_rows(spark, tmp_path):
    df = odd(spark).unionByName(documents(spark, ["The MIT, License"]))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(licences.licence_scan(spark, str(tmp_path)))
    assert len(got) == df.count() and [r["labels"] for r in got if r["n_base"]] == ["mit"]
    assert rows(licences.find_licences(df.limit(0))) == []


def test_long_texts_take_time_in_proportion():
    import time

    def seconds(n):
        text, automaton = "mit license " * n, licences.build_automaton()
        begin = time.process_time()
        found = licences.scan(text, automaton)
        assert (found["n_base"], found["first_word"], found["last_word"]) == (n, 0, 2 * n - 2)
        return time.process_time() - begin

    assert seconds(160_000) < 30 * max(seconds(20_000), 0.02)
