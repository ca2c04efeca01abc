import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from parley.llm import fill_middle as fm

from .helpers import documents, odd, rows


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab é߿ࠀ￿\U00010000🙂"), max_size=60))
def test_index(text):
    data = text.encode()
    index = fm.CutIndex(np.frombuffer(data, dtype=np.uint8))
    starts = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
    assert index.to_bytes(np.arange(len(text) + 1)).tolist() == starts.tolist()
    at = np.arange(len(data) + 1)
    assert index.to_chars(at).tolist() == [len(data[:i].decode(errors="ignore")) for i in at]


def brute(doc_id, text, plain=fm.PLAIN_PERCENT, spm=fm.SPM_PERCENT, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["plain ascii text", "née Ångström", "🙂", "日本語のテキスト", "holds <M> a mark", "tail <", "<", "P>", "<S", ">", "a<P", "S><M", "é" * 500, "x" * 1000 + "🙂" + "y" * 1000]


def check(got, texts, **kw):
    for r in got:
        want = brute(r["doc_id"], texts[r["doc_id"]], **kw)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["back"] == (texts[r["doc_id"]] or "")


def with_back(df):
    return df.withColumn("back", fm.restored(df["output"], df["form"]))


@pytest.mark.parametrize("kw", [{}, {"plain_percent": 0, "spm_percent": 100}, {"plain_percent": 0, "spm_percent": 0, "seed": 7}])
def test_against_brute_force(spark, kw):
    texts = {i: TEXTS[i % len(TEXTS)] for i in range(300)}
    got = rows(with_back(fm.fill_in_middle(documents(spark, [texts[i] for i in range(300)]), **kw)))
    assert len(got) == 300
    check(got, texts, **{k.removesuffix("_percent"): v for k, v in kw.items()})


def test_steps_inside_a_batch(spark, monkeypatch):
    monkeypatch.setattr(fm, "STEP_BYTES", 64)
    texts = {i: TEXTS[i % len(TEXTS)] for i in range(100)}
    got = rows(with_back(fm.fill_in_middle(documents(spark, [texts[i] for i in range(100)], clash=False).coalesce(1))))
    assert len(got) == 100
    check(got, texts)


def test_odd_rows(spark):
    df = odd(spark)
    got = rows(with_back(fm.fill_in_middle(df)))
    texts = {r["doc_id"]: r["text"] for r in rows(df)}
    assert len(got) == df.count()
    check(got, texts)
    assert rows(fm.fill_in_middle(df.limit(0))) == []


def test_cuts_in_bytes(spark):
    texts = {i: TEXTS[i % len(TEXTS)] for i in range(200)}
    got = rows(with_back(fm.fill_in_middle(documents(spark, [texts[i] for i in range(200)]), plain_percent=0, unit="bytes")))
    for r in got:
        text = texts[r["doc_id"]]
        data = text.encode()
        h = hashlib.sha256(f"1:{r['doc_id']}".encode()).hexdigest()
        cut = sorted(len(data[:int(h[8 * i:8 * i + 8], 16) % (len(data) + 1)].decode(errors="ignore")) for i in range(2))
        assert r["back"] == text and r["n"] == len(text)
        if r["form"] != "plain":
            assert [r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]] == cut
    with pytest.raises(ValueError):
        fm.fill_in_middle(documents(spark, ["x"]), unit="words")
