import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from parley.llm import packing

from .helpers import documents, odd, rows


def laid_out(steps):
    bins = {}
    for size, rank, n, first, each, offset in steps:
        for r in range(n):
            bins.setdefault(first + r // each, []).append((offset + r % each * size, size))
    return bins


def plain_best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=30))
def test_plan(histogram):
    steps, n = packing.plan_sequences(histogram, 30)
    bins = laid_out(steps)
    assert sorted(bins) == list(range(n))
    for size in histogram:
        ranks = sorted((rank, k) for s, rank, k, *_ in steps if s == size)
        assert [r for r, _ in ranks] == [sum(k for _, k in ranks[:i]) for i in range(len(ranks))] and sum(k for _, k in ranks) == histogram[size]
    for places in bins.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= 30
    sizes = [s for s, k in histogram.items() for _ in range(k)]
    assert n <= plain_best_fit(sizes, 30) + max(1, n // 20)


def test_plan_is_near_the_bound():
    rng = random.Random(5)
    histogram = {}
    for _ in range(20_000):
        s = min(2048, int(rng.lognormvariate(6, 1)) + 1)
        histogram[s] = histogram.get(s, 0) + 1
    steps, n = packing.plan_sequences(histogram, 2048)
    assert n <= 1.002 * -(-sum(s * k for s, k in histogram.items()) // 2048) + 1
    assert len(steps) < 20_000


def test_too_long():
    with pytest.raises(ValueError):
        packing.plan_sequences({31: 1}, 30)


TOKENS = ["word", " word", "The", "\n", " ", "  ", "\t", "'s", "don't", "12", "é", "\u00a0", "\u3000", "!!", "ß", "<|endoftext|>", "\x1c", "漢字", "🙂", ".", "\r\n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(TOKENS), max_size=16).map("".join))
def test_ids_are_those_of_the_tokenizer_file(text):
    whole = test_ids_are_those_of_the_tokenizer_file.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert np.frombuffer(packing._encoder(packing.TOKENIZER)(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_query_on_odd_rows(spark, tmp_path):
    df = odd(spark).unionByName(documents(spark, [f"short text {i}" for i in range(50)]))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(packing.packed_documents(spark, str(tmp_path)))
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in df.collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        want += [(r["doc_id"], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda x: str(x)
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert rows(packing.pack(df.limit(0))) == []
