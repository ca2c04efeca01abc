import math
import random
from collections import Counter, defaultdict

from parley.llm import quality

from .helpers import SCHEMA, documents, odd, rows


def plain_costs(train, asked, order):
    """Modified Kneser-Ney straight from its definition, in dictionaries; one language."""
    counts = {order: Counter(train)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off, sums = {}, {}
    for k, c in counts.items():
        n = {i: sum(v == i for v in c.values()) for i in (1, 2, 3, 4)}
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        off[k] = [0.0] + [max(0.0, min(float(i), i - (i + 1) * y * n[i + 1] / n[i])) if y is not None and n[i] else 0.5 * i for i in (1, 2, 3)]
        s = defaultdict(lambda: [0, 0.0])
        for g, v in c.items():
            s[g[:-1]][0] += v
            s[g[:-1]][1] += off[k][min(v, 3)]
        sums[k] = s

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        low, k = p(g[1:]), len(g)
        if g[:-1] not in sums[k]:
            return low
        total, spare = sums[k][g[:-1]]
        v = counts[k].get(g, 0)
        return (v - off[k][min(v, 3)] if v else 0) / total + spare / total * low

    return {g: -math.log(p(g)) for g in asked}


def grams(text, order=quality.ORDER):
    t = quality.BEGIN * (order - 1) + text
    return [t[i:i + order] for i in range(len(text))]


def test_costs_against_the_definition(spark):
    rng = random.Random(1)
    train = Counter(g for _ in range(60) for g in grams("".join(rng.choice("aab c") for _ in range(40))))
    asked = set(train) | {x[:quality.ORDER] for x in ("zzzzz", "aazbc", "abcaz", "zaaaa")}
    df = spark.createDataFrame([("x", g, train.get(g, 0)) for g in asked] + [("untrained", "abcde"[:quality.ORDER], 0)], "lang string, gram string, c long")
    got = {(r["lang"], r["gram"]): r["cost"] for r in rows(quality.ngram_costs(df))}
    want = plain_costs(train, asked, quality.ORDER)
    assert len(got) == len(asked) + 1
    for g in asked:
        assert math.isclose(got["x", g], want[g], rel_tol=1e-9), g
    for context in {g[:-1] for g in list(train)[:20]}:  # probabilities of what can follow add up to less than one; the rest is unseen
        total = sum(math.exp(-v) for (lang, g), v in got.items() if lang == "x" and g[:-1] == context)
        assert total <= 1 + 1e-9


def corpus(spark):
    rng = random.Random(2)
    syllables = {"en": ["th", "er", "on", "an", "re", " ", " "], "de": ["sch", "ein", "ung", "ü", " ", " "]}
    data, labels = [], []
    for i in range(240):
        lang = "en" if i % 2 else "de"
        text = "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(60, 200)))
        bad = i % 10 == 3 or i % 10 == 4
        if bad:
            text = "".join(c.upper() + rng.choice("#%$!*&") for c in text)
        data.append((i, text, lang, "s", len(text)))
        if i % 4 < 3:
            labels.append((i, 0 if bad else 1, 0))
    labels += [(5, 1, 1), (None, 1, 0), (6, None, None)]
    return spark.createDataFrame(data, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i for i in range(240) if i % 10 in (3, 4)}


def test_perplexities_and_decisions(spark):
    docs, labels, bad = corpus(spark)
    got = {r["doc_id"]: r for r in rows(quality.judge(docs, labels))}
    keys = {r["doc_id"]: r["text_key"] for r in got.values()}
    good = {r["doc_id"] for r in rows(quality.trusted_ids(labels))}
    assert 5 not in good and 6 not in good and 3 not in good and 1 in good
    data = {r["doc_id"]: r for r in rows(docs)}
    for lang in ("en", "de"):
        own = [i for i in data if data[i]["lang"] == lang]
        train = [g for i in own if i in good and keys[i] % quality.HELD != 0 for g in grams(data[i]["text"])]
        cost = plain_costs(train, {g for i in own for g in grams(data[i]["text"])}, quality.ORDER)
        for i in own:
            g = grams(data[i]["text"])
            assert math.isclose(got[i]["perplexity"], math.exp(sum(cost[x] for x in g) / len(g)), rel_tol=1e-9)
    kept = {i for i, r in got.items() if r["keep"]}
    if all(r["upper_limit"] is not None for r in got.values()):
        assert not kept & bad and len(kept) >= 0.9 * (240 - len(bad))
    out = quality.keep_good(docs, labels)
    assert {r["doc_id"] for r in rows(out)} == kept and out.columns == docs.columns


def test_several_blocks_and_slices_give_the_same(spark, monkeypatch):
    docs, labels, _ = corpus(spark)
    one = {r["doc_id"]: r["perplexity"] for r in rows(quality.judge(docs, labels))}
    monkeypatch.setattr(quality, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(quality, "SLICE_CHARS", 500)
    many = {r["doc_id"]: r["perplexity"] for r in rows(quality.judge(docs, labels))}
    assert one.keys() == many.keys() and all(math.isclose(one[i], many[i], rel_tol=1e-9) for i in one)


def test_many_trusted_ids_are_joined_without_a_broadcast(spark, monkeypatch):
    docs, labels, _ = corpus(spark)
    one = {r["doc_id"]: r["perplexity"] for r in rows(quality.judge(docs, labels))}
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    other = {r["doc_id"]: r["perplexity"] for r in rows(quality.judge(docs, labels))}
    assert all(math.isclose(one[i], other[i], rel_tol=1e-9) for i in one)


def test_odd_rows(spark):
    docs, labels, _ = corpus(spark)
    df = odd(spark).selectExpr("doc_id + 1000 as doc_id", "* except(doc_id)").unionByName(docs, allowMissingColumns=True)
    df = df.unionByName(documents(spark, ["漢字かな交じり文" * 50], lang=None).selectExpr("doc_id + 5000 as doc_id", "* except(doc_id)"))
    got = rows(quality.judge(df, labels))
    assert len(got) == df.count()
    assert all(r["keep"] and r["perplexity"] is None for r in got if r["doc_id"] in (1000, 1001))
    assert all(r["keep"] and r["upper_limit"] is None for r in got if r["doc_id"] == 5000)
    assert rows(quality.judge(df.limit(0), labels)) == []
    assert all(r["keep"] for r in rows(quality.judge(df, labels.limit(0))))


def test_languages_with_few_trusted_texts_have_a_limit(spark):
    docs, labels, bad = corpus(spark)
    few = docs.where("lang = 'en' or doc_id < 60")
    got = {r["doc_id"]: r for r in rows(quality.judge(few, labels))}
    german = {i: r for i, r in got.items() if r["lang"] == "de"}
    trusted = {r["doc_id"] for r in rows(quality.trusted_ids(labels))} & set(german)
    assert 5 < len(trusted) < 30 and sum(german[i]["text_key"] % quality.HELD == 0 for i in trusted) < quality.LEAST_HELD
    assert all(not r["keep"] for i, r in german.items() if i in bad)
    data = {r["doc_id"]: r["text"] for r in rows(docs)}
    unseen = []
    for i in trusted:
        fold = german[i]["text_key"] % quality.HELD
        train = [g for t in trusted if german[t]["text_key"] % quality.HELD != fold for g in grams(data[t])]
        cost = plain_costs(train, grams(data[i]), quality.ORDER)
        unseen.append(math.exp(sum(cost[g] for g in grams(data[i])) / len(data[i])))
    assert all(math.isclose(r["upper_limit"], max(unseen), rel_tol=1e-9) for r in german.values())
