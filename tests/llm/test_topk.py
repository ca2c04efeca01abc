import math

import numpy as np
from hypothesis import given, settings, strategies as st

from parley.llm import topk

from .helpers import rows


def brute(ids, vectors, q_ids, queries, k):
    out = []
    for qi, q in zip(q_ids, queries):
        scored = sorted((-int(np.dot(q.astype(object), v.astype(object))), i) for i, v in zip(ids, vectors) if i != qi)
        out.append([(i, -s) for s, i in scored[:k]])
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 5, 300, 700]), st.sampled_from([1, 3, 64]), st.sampled_from([1, 4, 60]))
def test_search_against_brute_force(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-spread, spread + 1, (n, dims))
    ids = rng.permutation(5 * n)[:n].astype(np.int64)
    q_ids, queries = ids[: max(1, n // 10)], vectors[: max(1, n // 10)]
    row, got_ids, score = topk.search_tree(topk.build_tree(ids, vectors), q_ids, queries, 20)
    want = brute(ids, vectors, q_ids, queries, 20)
    for r in range(len(q_ids)):
        mine = sorted(zip((-score[row == r]).tolist(), got_ids[row == r].tolist()))
        assert [(i, -s) for s, i in mine] == want[r]


def test_same_vectors_and_large_numbers():
    ids = np.arange(1000)
    for v in (np.ones((1000, 4), dtype=np.int64), np.full((1000, 2), 2 ** 29 + 1, dtype=np.int64)):
        row, got, score = topk.search_tree(topk.build_tree(ids, v), ids[500:501], v[500:501], 20)
        assert sorted(got.tolist()) == list(range(20)) and set(score.tolist()) == {int((v[0].astype(object) ** 2).sum())}


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 16)) * 200
    v = np.floor(centres[rng.integers(0, 10, 4000)] + rng.normal(size=(4000, 16)) * 5).astype(np.int64)
    tree = topk.build_tree(np.arange(4000), v)
    for n in range(len(tree["leaf"])):
        if tree["leaf"][n]:
            own = tree["vectors"][tree["lo"][n]:tree["hi"][n]].astype(float)
            d = np.sqrt(((own - tree["centre"][n]) ** 2).sum(axis=1))
            assert (d <= tree["radius"][n] + 1e-9).all() and np.allclose(d, tree["entry"][tree["lo"][n]:tree["hi"][n]])


def test_query_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=4)], 1) for i in range(60)]
    data += [(60, None, 1), (80, [], 1), (100, [1.0, None, 0.0, 0.0], 1), (120, [math.nan, 0.0, 0.0, 0.0], 1), (140, [math.inf, 0.0, 0.0, 0.0], 1), (None, [9.0] * 4, 1), (3, data[3][1], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, shard int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = rows(topk.nearest_vectors(spark, str(tmp_path)))
    used = [(i, np.floor(64 * np.array(np.float32(v), dtype=float)).astype(np.int64)) for i, v, _ in data if i is not None and i < 60]
    for q in (0, 20, 40):
        vec = dict(used)[q]
        want = sorted((-int(vec @ v), i) for i, v in used if i != q)[:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(i, -s) for s, i in want] == [(i, s) for _, i, s in mine] and [r for r, *_ in mine] == list(range(1, 21))
    assert {r["query_id"] for r in got} == {0, 20, 40}
    assert rows(topk.exact_top_k(df.limit(0))) == []
