"""Vector operators against numpy on small inputs, on every path they can take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley import blocks
from parley.operators import voices as V

D = 6


def unit(x):
    return x / np.linalg.norm(x)


def vecs(seed, n, centres=3, noise=0.25):
    rnd = np.random.default_rng(seed)
    c = rnd.normal(size=(centres, D))
    return [unit(unit(c[i % centres]) + noise * rnd.normal(size=D)) for i in range(n)]


@pytest.fixture(scope="module")
def world(spark):
    g, p = vecs(1, 9), vecs(1, 40, noise=0.5)
    gallery = spark.createDataFrame([(f"n{i}", v.tolist()) for i, v in enumerate(g)], "name string, embedding array<double>")
    probes = spark.createDataFrame([(f"m{i % 4}", i, v.tolist()) for i, v in enumerate(p)], "meeting string, idx long, embedding array<double>")
    return np.array(g), np.array(p), gallery, probes


@pytest.mark.parametrize("limit", [blocks.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("k, floor", [(None, -2.0), (1, None), (2, None), (None, 0.5), (1, 0.5)])
def test_rank_names(world, monkeypatch, limit, k, floor):
    g, p, gallery, probes = world
    monkeypatch.setattr(blocks, "fits_broadcast", lambda df, dims: limit > 0)
    real = blocks.cells
    monkeypatch.setattr(blocks, "cells", lambda *a, **kw: real(*a, **{**kw, "block_rows": 4}))
    out = {}
    for r in V.rank_names(probes, gallery, ["meeting", "idx"], k=k, floor=floor, dims=D).collect():
        out.setdefault(r.idx, []).append((r["rank"], r.name, round(r.score, 9)))
    for i, v in enumerate(p):
        want = sorted(((-float(s), f"n{j}") for j, s in enumerate(g @ v)))
        want = [(r + 1, n, round(-s, 9)) for r, (s, n) in enumerate(want)]
        want = [w for w in want if (k is None or w[0] <= k) and (floor is None or w[2] >= floor)]
        assert sorted(out.get(i, [])) == want


@pytest.mark.parametrize("small", [True, False])
def test_probes_that_repeat_a_key_are_ranked_apart(world, monkeypatch, small):
    _, _, gallery, probes = world
    monkeypatch.setattr(blocks, "fits_broadcast", lambda df, dims: small)
    out = V.rank_names(probes.unionByName(probes.where("idx < 3")), gallery, ["meeting", "idx"], k=2, dims=D)
    n = {(r.idx, r["rank"]): r.n for r in out.groupBy("idx", "rank").agg(F.count("*").alias("n")).collect()}
    assert n == {(i, r): 2 if i < 3 else 1 for i in range(40) for r in (1, 2)}


def test_all_names_of_all_probes_are_refused(world):
    with pytest.raises(ValueError):
        V.rank_names(world[3], world[2], ["meeting", "idx"], dims=D)


def test_k_from_a_column(world):
    _, _, gallery, probes = world
    out = V.rank_names(probes.withColumn("want", (F.col("idx") % 3 + 1).cast("int")), gallery, ["meeting", "idx"], k="want", dims=D)
    assert {r.idx: r.n for r in out.groupBy("idx").agg(F.count("*").alias("n")).collect()} == {i: i % 3 + 1 for i in range(40)}


def centroid_reference(values):
    m = np.array([unit(v) for v in values])
    if len(m) == 1:
        return m[0], 1
    s = m @ m.T
    to = s[int(np.argmax(np.round(np.median(s, axis=1), 12)))]
    kept = m[to >= max(0.45, np.percentile(to, 25))]
    if len(kept) < min(2, len(m)):
        kept = m
    return unit(kept.mean(axis=0)), len(kept)


@pytest.mark.parametrize("block_rows", [2048, 7])
def test_robust_centroid(spark, block_rows):
    groups = {"a": vecs(2, 30, centres=1, noise=0.4) + vecs(3, 6), "b": vecs(4, 1), "c": vecs(5, 2, noise=2.0), "d": vecs(6, 23, centres=2)}
    df = spark.createDataFrame([(k, i, v.tolist()) for k, vs in groups.items() for i, v in enumerate(vs)], "g string, idx long, embedding array<double>")
    for r in V.robust_centroid(df, ["g"], dims=D, block_rows=block_rows).collect():
        want, kept = centroid_reference(groups[r.g])
        assert (r.kept, r.n) == (kept, len(groups[r.g]))
        assert np.allclose(r.embedding, want, atol=1e-9)


def run_reference(values, accept, most):
    m = np.array([unit(v) for v in values])
    n = len(m)
    score = [(sum(float(m[i] @ m[j]) for j in range(n) if j != i)) / max(1, n - 1) for i in range(n)]
    mid = int(np.argmax(np.round(score, 12)))
    kept = [i for i in range(n) if m[i] @ m[mid] >= accept or i == mid]
    runs = [[kept[0]]]
    for i in kept[1:]:
        if i == runs[-1][-1] + 1:
            runs[-1].append(i)
        else:
            runs.append([i])
    best = max(runs, key=len)
    if len(best) > most:
        cands = [best[o:o + most] for o in range(len(best) - most + 1)]
        best = max(cands, key=lambda c: (mid in c, round(sum(score[i] for i in c), 12), -c[0]))
    return best, unit(m[best].mean(axis=0))


def test_cleanest_run(spark):
    groups = {i: vecs(10 + i, n, centres=1, noise=noise) for i, (n, noise) in enumerate([(1, 0.3), (9, 0.5), (25, 0.2), (30, 0.55), (16, 1.0)])}
    df = spark.createDataFrame([("m", g, i, float(i), i + 2.0, v.tolist()) for g, vs in groups.items() for i, v in enumerate(vs)],
                               "meeting string, idx long, w_idx long, start double, end double, embedding array<double>")
    out = {r.idx: r for r in V.cleanest_run(df, dims=D, max_windows=11).collect()}
    for g, vs in groups.items():
        best, centre = run_reference(vs, 0.5, 11)
        assert (out[g].start, out[g].end, out[g].kept, out[g].windows) == (best[0], best[-1] + 2.0, len(best), len(vs))
        assert np.allclose(out[g].embedding, centre)


def test_purify(spark):
    a, b = unit(np.eye(D)[0]), unit(np.eye(D)[1])
    gallery = spark.createDataFrame([("A", a.tolist()), ("B", b.tolist())], "name string, embedding array<double>")
    rows = [("m", "s1", i, float(i), i + 2.0, (b if i in (3, 5) else a).tolist()) for i in range(8)] + [("m", "s1", 8, 8.0, 8.5, b.tolist())]
    rows += [("m", "s2", i, 0.0, 2.0, (b if i % 2 else a).tolist()) for i in range(4)]
    df = spark.createDataFrame(rows, "meeting string, speaker_id string, idx long, start double, end double, embedding array<double>")
    kept = {(r.speaker_id, r.idx) for r in V.purify(df, gallery, dims=D).collect()}
    assert kept == {("s1", i) for i in (0, 1, 2, 4, 6, 7, 8)} | {("s2", i) for i in range(4)}


@pytest.mark.parametrize("block_rows", [8192, 2])
def test_contaminated(spark, monkeypatch, block_rows):
    real = blocks.cells
    monkeypatch.setattr(blocks, "cells", lambda *a, **kw: real(*a, **{**kw, "block_rows": block_rows}))
    base = np.eye(D)
    near = unit(base[0] + 0.1 * base[1])
    rows = [("x", "a", base[0]), ("x", "b", base[1]), ("x", "c", near), ("y", "a", base[0]), ("y", "b", base[1]), ("z", "a", base[0])]
    df = spark.createDataFrame([(m, s, v.tolist()) for m, s, v in rows], "meeting string, speaker_id string, embedding array<double>")
    out = V.contaminated(df, dims=D).collect()
    assert [r.meeting for r in out] == ["x"] and out[0].closest == pytest.approx(float(base[0] @ near))


def test_aliases(spark):
    sp = spark.createDataFrame([("An", "a@x"), ("Bình", "Chưa cập nhật"), ("An - a@x - Voice Speaker", None), (" ", "z@x")], "name string, email string")
    al = V.alias_table(sp)
    table = {r.alias: r.canonical for r in al.collect()}
    assert table["An - a@x"] == table["An - Voice Speaker"] == table["An - a@x - Voice Speaker"] == "An" and "Bình - Chưa cập nhật" not in table
    ask = spark.createDataFrame([("👤 An",), ("An - a@x - Voice Speaker",), ("Ai đó - Voice Speaker",), (" ",)], "t string")
    assert [r.canonical for r in V.normalize_names(ask, "t", al).orderBy(F.length("t")).collect()] == ["", "An", "Ai đó", "An"]
    g = sp.withColumn("embedding", F.array(F.lit(1.0)))
    assert {r.name for r in V.canonical_gallery(g, al).collect()} == {"An", "Bình", " "}


def test_centroids_take_text_ids_at_every_size(spark):
    v = vecs(31, 20, noise=0.4) + vecs(31, 3, noise=0.4)[:1] * 3  # with ties
    df = spark.createDataFrame([("g", f"id{i:02d}", x.tolist()) for i, x in enumerate(v)], "g string, idx string, embedding array<double>")
    small, large = (V.robust_centroid(df, ["g"], dims=D, block_rows=b).first() for b in (2048, 5))
    assert (small.kept, small.n) == (large.kept, large.n) and np.allclose(small.embedding, large.embedding)


def test_large_groups_take_exact_medians_of_few_rows(spark):
    v = vecs(41, 400, centres=1, noise=0.5)
    df = spark.createDataFrame([("g", i // 2, x.tolist()) for i, x in enumerate(v)], "g string, idx long, embedding array<double>")
    small, large = (V.robust_centroid(df, ["g"], dims=D, block_rows=b).first() for b in (2048, 50))
    assert (small.kept, small.n) == (large.kept, large.n) and np.allclose(small.embedding, large.embedding)
    rows = df.select("g", F.col("idx").alias("_id"), "embedding", F.lit(400).cast("long").alias("n"), F.monotonically_increasing_id().alias("_row")).localCheckpoint()
    kept = V._candidates(rows, ["g"], D, 50).select("_row", "embedding").collect()
    m = np.array(v)
    medians = np.round(np.median(m @ m.T, axis=1), 12)
    assert len(kept) < 100 and any(np.array_equal(r.embedding, m[medians.argmax()]) for r in kept)
