import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from parley.llm import vector_codes as vc

from .helpers import rows


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 8, 33]), st.sampled_from([3, 2**12, 2**20, 2**26, 2**28]))
def test_products_are_exact(seed, d, size):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-size, size + 1, (2, 5, d)), rng.integers(-size, size + 1, (2, d, 4))
    got = vc.exact_products(a, b)
    want = np.matmul(a.astype(object), b.astype(object))
    assert got.tolist() == want.tolist()


def test_products_at_the_border():
    """Sums beyond 2^53 that floats alone would round."""
    a, b = np.full((1, 1, 8), 2 ** 29 - 1), np.full((1, 8, 1), 2 ** 29 - 1)
    assert vc.exact_products(a, b)[0, 0, 0] == 8 * (2 ** 29 - 1) ** 2
    assert int(np.matmul(a.astype(float), b.astype(float))[0, 0, 0]) != 8 * (2 ** 29 - 1) ** 2
    assert vc.exact_products(np.zeros((2, 0, 3), dtype=np.int64), np.ones((2, 3, 2), dtype=np.int64)).shape == (2, 0, 2)


def brute(vectors, parts, entries, rounds, scale):
    """Plain Python integers; vectors: (id, label, list) in any order, all of them kept."""
    dims = max(len(v) for _, _, v in vectors)
    width = -(-dims // parts)
    whole = [[math.floor(scale * x) for x in v] + [0] * (parts * width - len(v)) for *_, v in vectors]
    cut = [[w[p * width:(p + 1) * width] for p in range(parts)] for w in whole]
    first = {}
    for (i, *_), c, w in sorted(zip(vectors, cut, whole), key=lambda t: (t[0][0] is None, t[0][0] or 0, t[2])):
        if i is not None:
            first.setdefault(i, c)
    books = [[c[p] for c in list(first.values())[:entries]] for p in range(parts)]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [assign(p, c[p])[1] for c in cut]
            sums = []
            for k, e in enumerate(books[p]):
                mine = [c[p] for c, o in zip(cut, own) if o == k]
                sums.append([sum(x) // len(mine) for x in zip(*mine)] if mine else e)
            new.append(sums)
        books = new
    out = []
    for (i, label, _), c in zip(vectors, cut):
        best = [assign(p, c[p]) for p in range(parts)]
        out.append((i, label, [k for _, k in best], sum(d for d, _ in best)))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return out, books, digest


def key(r):
    return str(r)


def compare(spark, data, kept, parts=8, entries=16, rounds=6, scale=4096.0, repartition=3):
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, code int, error string, n int, own string, salt int, part int").repartition(repartition)
    books = vc.train_codebooks(df, parts, entries, rounds, scale)
    used = [(i, label, [float(np.float32(x)) for x in v]) for i, v, label, *_ in kept]
    want, want_books, digest = brute(used, parts, entries, rounds, scale)
    assert books.tolist() == want_books and vc.books_digest(books) == digest
    coded = vc.encode_vectors(df, books, scale)
    got = [(r["vec_id"], r["label"], r["code"], r["error"]) for r in rows(coded)]
    assert sorted(got, key=key) == sorted(want, key=key)
    total = {}
    for _, label, _, e in want:
        total[label] = total.get(label, 0) + e
    for sent in (100_000, 0):
        summed = rows(vc.with_group_error(coded, salts=3, sent=sent))
        assert sorted(((r["vec_id"], r["label"], r["code"], r["error"], r["label_error"]) for r in summed), key=key) == \
            sorted(((*w, total[w[1]]) for w in want), key=key)
    return df, books


EXTRA = (1, "clash", 2, "clash", 3, 4)


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    data = [(int(i) * 3 - 50, [float(x) for x in centres[i % 6] + rng.normal(size=16) * 0.2], int(i % 4) if i % 5 else None, *EXTRA) for i in rng.permutation(120)]
    compare(spark, data, data, parts=4, entries=5, rounds=4)
    compare(spark, data, data)


def test_large_components(spark):
    """Whole numbers that need two limbs."""
    rng = np.random.default_rng(9)
    data = [(i, [float(x) for x in rng.normal(size=8) * 9000], 1, *EXTRA) for i in range(40)]
    compare(spark, data, data, parts=2, entries=4, rounds=3)
    far = [(1, [1e30] * 8, 1, *EXTRA)]
    with pytest.raises(Exception, match="would not fit 64 bits"):
        vc.train_codebooks(spark.createDataFrame(far, "vec_id long, embedding array<float>, label int, code int, error string, n int, own string, salt int, part int"))


def test_ties_and_odd_rows(spark):
    """Equal vectors, repeated ids and rows, null ids and labels, short vectors, vectors that take no part."""
    kept = [(5, [1.0, 1.0, 0.0, 0.0], 1), (5, [1.0, 1.0, 0.0, 0.0], 1), (5, [0.5, 9.0, 0.0, 0.0], 1), (7, [1.0, 1.0, 0.0, 0.0], None), (8, [-1.0, -1.0, -0.5, 2.0], None),
            (None, [0.25, 0.0, -3.0, 1.0], 2), (9, [1.0, 2.0, 3.0], 2), (10, [1.0], 3)]
    bad = [(1, None, 1), (2, [], 1), (3, [1.0, None, 0.0, 0.0], 1), (4, [math.nan, 0.0, 0.0, 0.0], 1), (6, [math.inf, 0.0, 0.0, 0.0], 2), (11, [1.0] * 9 + [None], 5)]
    kept, bad = ([(*r, *EXTRA) for r in x] for x in (kept, bad))
    df, books = compare(spark, kept + bad, kept, parts=2, entries=3, rounds=3)
    assert books.shape == (2, 3, 2)
    none = df.where("vec_id = 1")
    for empty in (none, df.limit(0)):
        books = vc.train_codebooks(empty)
        assert books.size == 0 and rows(vc.with_group_error(vc.encode_vectors(empty, books))) == []


def test_decoded_is_near(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.normal(size=8)], 1, *EXTRA) for i in range(64)]
    df, books = compare(spark, data, data, parts=4, entries=16)
    coded = vc.encode_vectors(df, books)
    vectors = dict((d[0], d[1]) for d in data)
    for r in rows(vc.decode_vectors(coded, books)):
        far = sum((x - y) ** 2 for x, y in zip(vectors[r["vec_id"]], r["approximation"])) * 4096 ** 2
        assert abs(far - r["error"]) < 8 + 4 * math.sqrt(8 * r["error"])


def test_query(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=64)], i % 3) for i in range(50)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want, _, digest = brute([(i, lab, [float(np.float32(x)) for x in v]) for i, v, lab in data], 8, 16, 6, 4096.0)
    got = {r["vec_id"]: r for r in rows(vc.coded_vectors(spark, str(tmp_path)))}
    total = {k: sum(e for _, lab, _, e in want if lab == k) for k in range(3)}
    for i, label, code, error in want:
        assert got[i] == {"vec_id": i, "code": "".join(f"{c:02x}" for c in code), "error": error, "label_error": total[label], "codebooks_sha256": digest}
