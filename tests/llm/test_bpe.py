import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from parley.llm import bpe

from .helpers import documents, odd, rows

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(bpe.RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("library", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def whole(ranks):
    return tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def machine(ranks):
    return bpe.Transducer(ranks)


@pytest.fixture(scope="module")
def encoder(ranks):
    return bpe.Encoder(ranks, P.PATTERN)


def ids(encoder, text):
    return np.frombuffer(encoder(text), "<i4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("aAbe th=-0\n", min_size=1, max_size=120)))
def test_against_the_library(machine, encoder, whole, library, text):
    if text:
        assert machine.encode(text.encode()) == whole.encode_ordinary(text)
    assert ids(encoder, text) == library.encode_ordinary(text)


def test_sequences_of_tokens(machine, ranks, whole):
    rng, words = random.Random(5), list(ranks)
    for _ in range(3000):
        text = b"".join(rng.choices(words, k=rng.randint(1, 6))).decode(errors="ignore")
        if text:
            assert machine.encode(text.encode()) == whole.encode_ordinary(text)


def test_long_runs(encoder, library):
    for text in ("a" * 5000, " " * 5000 + "x", "ab" * 5000, "=" * 3001, "\n" * 999, "日本" * 2000, "1" * 777, "word " * 60_000, "née, " * 300_000):
        assert ids(encoder, text) == library.encode_ordinary(text)


def test_every_character_is_classed_as_the_library_does(encoder, library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(2)
    rng.shuffle(chars)
    for i in range(0, len(chars), 5000):
        text = "".join(c + rng.choice(["", "a", " ", "1", " \n"]) for c in chars[i:i + 5000])
        assert ids(encoder, text) == library.encode_ordinary(text)


def test_few_states_and_pieces_give_the_same(ranks, library):
    tight = bpe.Encoder(ranks, P.PATTERN, kept=10, kept_states=20)
    for text in ("Some words, then some words again; unusual wordforms.", "internationalisation of the internationalised"):
        assert ids(tight, text) == library.encode_ordinary(text)
    assert len(tight.machine.states) <= 20 and len(tight.pieces) <= 10


def test_lookahead_is_bounded(machine, ranks):
    longest = max(map(len, ranks))
    rng = random.Random(8)
    for _ in range(50):
        piece = "".join(rng.choices("aeinrst lo", k=400)).encode()
        given_out, (*early, tail) = 0, machine.tokens(piece)
        assert [t for out in (*early, tail) for t in out] == machine.encode(piece) and len(early) == len(piece)
        for read, out in enumerate(early, 1):
            given_out += sum(len(machine.merges.bytes_of[t]) for t in out)
            assert read - given_out <= 3 * longest
        assert given_out + sum(len(machine.merges.bytes_of[t]) for t in tail) == len(piece)


def test_merges_out_of_order():
    """A vocabulary whose merges run against the ranks, and one with a token that merges do not give."""
    byte = {bytes([b]): b for b in range(256)}
    rng = random.Random(3)
    for extra in ({b"bc": 256, b"abcd": 257, b"ab": 258, b"cd": 259, b"abc": 260, b"bcd": 261}, {b"aa": 256, b"aaaa": 257, b"aaa": 258}, {b"xyz": 256}):
        ranks = byte | extra
        lib = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        mine = bpe.Transducer(ranks)
        for _ in range(400):
            text = "".join(rng.choices("abcdxyz", k=rng.randint(1, 9)))
            assert mine.encode(text.encode()) == lib.encode_ordinary(text), (extra, text)
    with pytest.raises(ValueError):
        bpe.Merges({b"a": 0})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(list(b"A\x80\x8f\x90\x9f\xa0\xbf\xc0\xc2\xdf\xe0\xe1\xed\xef\xf0\xf1\xf4\xf5\xff")), max_size=14), st.integers(1, 5))
def test_stream_of_bytes(data, step):
    data = bytes(data)
    stream, out = bpe.Utf8Stream(), b""
    for i in range(0, len(data), step):
        out += stream.feed(data[i:i + step])
        out.decode()  # whole characters only
    assert out + stream.finish() == data.decode(errors="replace").encode()


def test_odd_rows(spark, library):
    df = odd(spark)
    coded = bpe.encode(df)
    got = rows(coded)
    want = [library.encode_ordinary(r["text"] or "") for r in rows(df)]
    assert sorted(r["ids"] for r in got) == sorted(want)
    back = rows(bpe.decode(coded))
    both = rows(bpe.encode(df, decoded=True))
    assert sorted((r["ids"], r["decoded"]) for r in both) == sorted((w, r["text"] or "") for w, r in zip(want, rows(df)))
    assert sorted(r["text"] for r in back) == sorted(r["text"] or "" for r in rows(df)) and set(back[0]) == {"doc_id", "text"}
    assert rows(bpe.encode(df.limit(0))) == [] and rows(bpe.decode(coded.limit(0))) == []


def test_decode_any_ids(spark, ranks):
    euro = "€".encode()
    cut = [ranks[euro[:1]], ranks[euro[1:2]]]
    data = [(1, [ranks[b"a"], None, ranks[b"b"]]), (2, None), (3, cut), (4, [10**6, -3]), (5, [*cut, ranks[euro[2:]]]), (6, [])]
    got = {r["k"]: r["text"] for r in rows(bpe.decode(spark.createDataFrame(data, "k long, ids array<int>")))}
    assert got == {1: "ab", 2: "", 3: "�", 4: "��", 5: "€", 6: ""}


def test_batches_are_cut(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "STEP_BYTES", 40)
    texts = [f"document number {i} has some words" for i in range(50)]
    df = documents(spark, texts, clash=False).coalesce(1)
    coded = bpe.encode(df)
    assert {r["doc_id"]: r["ids"] for r in rows(coded)} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in rows(bpe.decode(coded))} == dict(enumerate(texts))


def test_query(spark, library, tmp_path):
    import hashlib

    texts = [None, "", "It's 12 o'clock — née Ångström 🙂🙂", " \n\t x", "<|endoftext|> is plain here", "ab" * 3000]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in rows(bpe.round_trip(spark, str(tmp_path)))}
    for i, t in enumerate(texts):
        tokens = library.encode_ordinary(t or "")
        assert got[i] == {"doc_id": i, "n_tokens": len(tokens), "ids_sha256": hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest(),
                          "decoded_sha256": hashlib.sha256((t or "").encode()).hexdigest()}


def test_only_broken_runs_are_read_byte_by_byte(ranks, library, monkeypatch):
    read, feed = [], bpe.Utf8Stream.feed
    words = bpe.Vocabulary(ranks)
    monkeypatch.setattr(bpe.Utf8Stream, "feed", lambda self, data: read.append(data) or feed(self, data))
    text = "Une journée à l'étranger " * 200 + "🙂 and " + "x" * 50
    assert bpe._text_of(np.array(library.encode_ordinary(text), np.int32), words).decode() == text
    assert sum(map(len, read)) <= 8
    rng, broken, last = random.Random(4), np.flatnonzero(~words.whole).tolist(), words.last
    for size in (1, 2, 5, 1 << 16):
        monkeypatch.setattr(bpe, "SLICE", size)
        for _ in range(500):
            ids = [rng.choice(broken) if rng.random() < 0.6 else rng.randrange(-2, last + 3) for _ in range(rng.randrange(12))]
            plain = b"".join(words.words[t if 0 <= t <= last else last].as_py() for t in ids)
            assert bpe._text_of(np.array(ids, np.int32), words).decode() == plain.decode(errors="replace")


def test_texts_of_every_range_are_split_as_the_library_does(encoder, library):
    for text in ("plain words 12", "née l’été  x  y ½ ²²", "𝒳𝒴 x 𐌰𐌱12 🙂🙂   𝟙𝟚", "a\x1c\x1f b\x85\x85c", "퟿ ï"):
        assert ids(encoder, text) == library.encode_ordinary(text)
