import random
import re
from itertools import combinations

import numpy as np
import xxhash

import corpus_pipeline
from parley.llm import golay, simhash
from parley.llm.components import components

from .helpers import documents, odd, rows


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_golay_words_near_each_other_share_an_index():
    flips = [0, *(1 << b for b in range(23)), *(1 << a | 1 << b for a, b in combinations(range(23), 2))]
    words = np.random.default_rng(0).integers(0, 1 << 23, 2048)
    words = np.unique(np.concatenate([words, np.arange(2048)]))  # the low 11 bits alone run through all remainders
    base = golay.nearby(words)
    assert set((base >= 0).sum(axis=1)) == {1, 6}
    for f in flips:
        other = golay.nearby(words ^ f)
        assert ((base[:, :, None] == other[:, None, :]) & (base[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_codewords_are_seven_apart():
    c = golay.codewords()
    d = (23 - c.T @ c) / 2
    assert d[0, 1:].min() == 7 and (np.sort(np.unique(d)) == [0, 7, 8, 11, 12, 15, 16, 23]).all()


def test_prints_within_two_bits_share_a_key():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2 ** 64, 3000, dtype=np.uint64)
    a, b = rng.integers(0, 64, (2, 3000)).astype(np.uint64)
    y = x ^ (np.uint64(1) << a) ^ (np.uint64(1) << b)
    kx, rx = simhash.golay_keys(x)
    ky, ry = simhash.golay_keys(y)
    assert {*zip(kx, rx)} and len({r for k, r in {*zip(kx, rx)} & {*zip(ky, ry)}}) == 3000
    assert np.bincount(rx).max() <= 18


def check_links(spark, prints, small):
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    signed = [r["print"] for r in df.collect()]
    tree = {r["node"]: r["root"] for r in rows(components(simhash.link_prints(df, small)))}
    place = {p: i for i, p in enumerate(signed)}
    want = plain_roots(len(prints), [(i, j) for i, j in combinations(range(len(prints)), 2) if bin(prints[i] ^ prints[j]).count("1") <= 2])
    got = {}
    for p in signed:
        got.setdefault(tree.get(p, p), set()).add(place[p])
    expected = {}
    for i, r in enumerate(want):
        expected.setdefault(r, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_links_of_small_and_full_keys(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for base in list(prints)[:20]:
        x = base
        for _ in range(12):
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    dense = rng.getrandbits(64)
    prints |= {dense ^ sum(1 << b for b in rng.sample(range(8), 3)) for _ in range(200)} | {0, (1 << 64) - 1, 1 << 63}
    for small in (64, 3):
        check_links(spark, sorted(prints), small)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(7, 7)]
    want = plain_roots(400, links)
    tree = {r["node"]: r["root"] for r in rows(components(spark.createDataFrame(links, "a long, b long")))}
    assert all(tree.get(i, i) == want[i] for i in range(400))
    assert rows(components(spark.createDataFrame([], "a long, b long"))) == []


def test_report(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("the of a Bee SEA dée e f g").lower() + str(rng.randrange(50)) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    texts += [t + " end" for t in texts[:20]] + [t.upper() for t in texts[20:40]] + ["x\x1cy z", "x y", "x\x0by"]
    df = odd(spark).unionByName(documents(spark, texts).selectExpr("doc_id + 100 as doc_id", "* except(doc_id)"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(simhash.simhash_groups(spark, str(tmp_path)))
    data = [(r["doc_id"], r["text"]) for r in df.collect()]
    prints = [plain_print(t) for _, t in data]
    want = plain_roots(len(data), [(i, j) for i, j in combinations(range(len(data)), 2) if bin(prints[i] ^ prints[j]).count("1") <= 2])
    least = {}
    for (d, _), r in zip(data, want):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    expected = sorted((str(d), f"{p:016x}", least.get(r)) for (d, _), p, r in zip(data, prints, want))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == expected
    assert rows(simhash.fingerprint_components(df.limit(0))) == []


def plain_similarity(a, b):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_one_of_each_group_stays(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    texts, pairs = [], 0
    for k in range(150):
        body = fresh(rng.randint(60, 400))
        texts.append(" ".join(body))
        if k % 2:
            near = body[:]
            for _ in range(max(1, len(body) // rng.choice([50, 70, 100, 200]))):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near))
            pairs += plain_similarity(texts[-1], texts[-2]) >= 0.8
    texts += [texts[0]] * 5 + ["", None]
    df = documents(spark, texts)
    kept = sorted(r["doc_id"] for r in rows(simhash.keep_one_of_each_group(df)))
    gone = set(range(len(texts))) - set(kept)
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if plain_similarity(texts[i] or "", texts[j] or "") >= 0.8]
    want = plain_roots(len(texts), links)
    should_go = {i for i in range(len(texts)) if want[i] != i}
    assert gone <= should_go
    assert len(gone) >= 0.9 * len(should_go) and pairs > 40


def test_full_keys_are_compared_with_hubs_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 2)
    monkeypatch.setattr(simhash, "SMALL", 2)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10_000)}" for _ in range(300)]
    texts = []
    for k in range(60):
        near = base[:]
        near[rng.randrange(300)] = f"x{k}"
        texts.append(" ".join(near))
    assert simhash.keep_one_of_each_group(documents(spark, texts)).count() == 1


def test_chains_in_full_keys_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 2)
    monkeypatch.setattr(simhash, "SMALL", 2)
    rng = random.Random(9)
    texts = []
    for g in range(6):
        now = [f"g{g}w{rng.randrange(10_000)}" for _ in range(240)]
        for _ in range(40):  # copies that drift: each is like the one before and soon unlike the first
            texts.append(" ".join(now))
            now[rng.randrange(240)] = f"x{rng.randrange(10_000)}"
    rng.shuffle(texts)
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if plain_similarity(texts[i], texts[j]) >= 0.8]
    want = plain_roots(len(texts), links)
    kept = sorted(r["doc_id"] for r in rows(simhash.keep_one_of_each_group(documents(spark, texts))))
    assert kept == sorted(set(want))


def test_recall_at_the_threshold_by_kind_of_edit(spark):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    fresh = lambda n: rng.choices(words, weights, k=n)

    def replaced(body):
        near, n = body[:], len(body)
        while plain_similarity(" ".join(near), " ".join(body)) > 0.85:
            near[rng.randrange(n)] = rng.choice(words)
        return near

    edits = {
        "appended": lambda body: body + fresh(len(body) * 23 // 100),
        "cut": lambda body: body[:len(body) * 82 // 100],
        "block": lambda body: body[:20] + fresh(len(body) // 11) + body[20 + len(body) // 11:],
        "scattered": replaced,
    }
    texts, kinds = [], {}
    for kind, edit in edits.items():
        while sum(k == kind for k in kinds.values()) < 100:
            body = fresh(rng.randint(150, 400))
            x, y = " ".join(body), " ".join(edit(body))
            if 0.8 <= plain_similarity(x, y) <= 0.86:
                kinds[len(texts) + 1] = kind
                texts += [x, y]
    kept = {r["doc_id"] for r in rows(simhash.keep_one_of_each_group(documents(spark, texts)))}
    found = {kind: sum(k == kind and i not in kept for i, k in kinds.items()) for kind in edits}
    print("found of 100 pairs at 0.80 to 0.86:", found)
    assert all(n >= 98 for n in found.values()), found


def test_stage_takes_candidates_from_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_close", lambda: simhash.F.lit(False))  # no candidates from the bands
    rng = random.Random(12)
    body = [[f"w{rng.randrange(10_000)}" for _ in range(600)] for _ in range(20)]
    texts = [" ".join(b) for b in body] + [" ".join(["x", *b[1:]]) for b in body]
    prints = [simhash.fingerprint(t) for t in texts]
    near = [i for i in range(20) if 0 < bin(prints[i] ^ prints[20 + i]).count("1") <= 2]
    assert len(near) > 3
    kept = {r["doc_id"] for r in rows(corpus_pipeline.near_dedup_stage(spark, documents(spark, texts), ""))}
    assert set(range(20)) <= kept and not any(20 + i in kept for i in near)


def test_shuffle_files_go_with_their_execution(spark):
    from parley.session import short_lived_shuffles
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with short_lived_shuffles(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before


def test_stage_on_odd_rows(spark):
    df = odd(spark)
    kept = simhash.keep_one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in rows(kept)) == [0, 3, 5]
    assert simhash.keep_one_of_each_group(df.limit(0)).count() == 0
