import random

from parley.llm import decontaminate as dec
from parley.llm.licences import words_of

from .helpers import documents, odd, rows


def plain(text, item):
    """Best aligned window by trying all places."""
    a, b = words_of(text), words_of(item)
    need = min(dec.WINDOW, len(b))
    best = 0
    for i in range(len(a) - need + 1):
        for j in range(len(b) - need + 1):
            best = max(best, sum(x == y for x, y in zip(a[i:i + need], b[j:j + need])))
    return need and best >= dec.SHARE * need


def test_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    items = [" ".join(word() for _ in range(n)) for n in (3, 12, 15, 24, 40, 59)] + ["", None]
    texts = []
    for k in range(120):
        body = [word() for _ in range(rng.randint(0, 120))]
        if k % 2:
            part = words_of(items[rng.randint(1, 5)])
            cut = part[rng.randint(0, len(part) // 2):]
            cut = [w.decode() if rng.random() > k / 400 else word() for w in cut]
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + "," for w in cut]
        texts.append(" ".join(body))
    bench = spark.createDataFrame(list(enumerate(items)) + [(99, items[3])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in rows(dec.find_overlaps(documents(spark, texts), bench))}
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if x and plain(t, x)}
    assert got.keys() - want == {(d, 99) for d, i in want if i == 3}  # nothing false
    found = {k for k in got if k[1] != 99}
    assert len(found) >= 0.97 * len(want) and len(want) > 30
    for (d, i), r in got.items():
        w, x = words_of(texts[d]), words_of(items[3 if i == 99 else i])
        mine = w[r["first_word"]:r["first_word"] + r["n_words"]]
        assert max(sum(p == q for p, q in zip(mine, x[j:])) for j in range(len(x) - r["n_words"] + 1)) == r["n_equal"]
    kept = {r["doc_id"] for r in rows(dec.drop_contaminated(documents(spark, texts), bench))}
    assert kept == set(range(120)) - {d for d, _ in got}


def test_odd_rows(spark):
    item = "a passage of the benchmark that is long enough to have all seeds in it"
    bench = spark.createDataFrame([(1, item), (1, item), (None, None)], "item_id long, text string")
    df = odd(spark).unionByName(documents(spark, [f"before {item} after", f"{item.upper()}!"]))
    got = rows(dec.find_overlaps(df, bench))
    assert sorted((r["doc_id"], r["item_id"], r["first_word"]) for r in got) == [(0, 1, 1), (1, 1, 0)]
    assert dec.drop_contaminated(df, bench).count() == df.count() - 2
    assert dec.drop_contaminated(df, bench).columns == df.columns
    assert rows(dec.find_overlaps(df.limit(0), bench)) == [] and rows(dec.find_overlaps(df, bench.limit(0))) == []
    null_id = df.where("doc_id is null")
    assert dec.drop_contaminated(null_id, bench).count() == null_id.count()


def test_every_item_length(spark):
    """Items of 1 to 40 words, planted with as many replaced words as are allowed: all found below the window, 0.9 and more from it on."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(9))
    items = {n: [word() for _ in range(n)] for n in range(1, 41)}
    texts, planted = [], []
    for n, item in items.items():
        for _ in range(12):
            part = list(item)
            lost = min(n, dec.WINDOW) // 4
            for k in rng.sample(range(n if n <= dec.WINDOW else dec.WINDOW), lost):
                part[k] = word()
            if n > dec.WINDOW:
                part = part[:dec.WINDOW]
            texts.append(" ".join([word() for _ in range(rng.randint(0, 50))] + part + [word() for _ in range(rng.randint(0, 50))]))
            planted.append(n)
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows(dec.find_overlaps(documents(spark, texts), bench))}
    assert all(planted[d] == n for d, n in got)
    missed = [n for d, n in enumerate(planted) if (d, n) not in got]
    assert not [n for n in missed if n < dec.WINDOW]
    assert len(missed) <= 0.1 * sum(n >= dec.WINDOW for n in planted)


def test_places_are_cut_and_words_joined_once(spark):
    """A text of equal words beside an item of them: one row a stretch and item, whatever the number of shifts."""
    bench = spark.createDataFrame([(1, "same " * 30), (2, "same " * 30), (3, "same other")], "item_id long, text string")
    got = rows(dec.find_overlaps(documents(spark, ["same " * 16_000 + "other"]), bench))
    assert sorted((r["item_id"], r["first_word"], r["n_words"], r["n_equal"]) for r in got) == [(1, 0, 24, 24), (2, 0, 24, 24), (3, 15_999, 2, 2)]


def test_a_shorter_window(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = ["x six seven EIGHT nine other eleven twelve thirteen y", "x six other eight nine other eleven other y", "x " + item]
    assert {r["doc_id"] for r in rows(dec.find_overlaps(documents(spark, texts), bench, window=8))} == {0, 2}
