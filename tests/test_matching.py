import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import matching as G
from parley.operators import voices as V
from tests.test_voices import D, unit, vecs


def best_total(s):
    n, m = s.shape
    if n > m:
        s, n, m = s.T, m, n
    return max(sum(s[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))


def score_table(spark, seed=0, groups=12, places=3):
    rnd = np.random.default_rng(seed)
    mats = {f"m{i}": np.round(rnd.uniform(-1, 1, size=(rnd.integers(1, 5), rnd.integers(1, 6))), places) for i in range(groups)}
    data = [(k, f"r{i}", f"c{j}", float(s[i, j])) for k, s in mats.items() for i in range(s.shape[0]) for j in range(s.shape[1])]
    return mats, spark.createDataFrame(data, "meeting string, row string, col string, score double")


def check_pairs(mats, out):
    got = {}
    for r in out:
        got.setdefault(r.meeting, []).append(r)
    for k, s in mats.items():
        rs = got[k]
        assert len(rs) == min(s.shape) == len({r.row for r in rs}) == len({r.col for r in rs})
        assert sum(r.score for r in rs) == pytest.approx(best_total(s))


def first_of_best(s):
    """Of the assignments of rows to columns with the best total the first, rows in order."""
    n, m = s.shape
    return min(itertools.permutations(range(m), n), key=lambda p: (-sum(s[i, p[i]] for i in range(n)), p))


def test_equal_totals_give_the_first_assignment():
    rnd = np.random.default_rng(8)
    for _ in range(600):
        n = int(rnd.integers(1, 6))
        s = rnd.integers(-1, 3, size=(n, n + int(rnd.integers(0, 3)))).astype(float)
        assert tuple(G._best_pairs(s)) == first_of_best(s)
    assert G._best_pairs(np.zeros((200, 210))).tolist() == list(range(200))


def test_votes_leave_rows_alone(spark):
    """Sparse scores: unlisted pairs are worth nothing, and of equal totals the first is taken."""
    rnd = random.Random(6)
    data = [(f"m{g}", f"r{i}", j, float(rnd.randint(1, 3))) for g in range(40) for i in range(4) for j in range(rnd.choice([2, 4])) if rnd.random() < 0.5]
    got = {}
    for r in G.assign_one_to_one(spark.createDataFrame(data, "meeting string, row string, col long, score double"), ["meeting"], "row", "col", sparse=True).collect():
        got.setdefault(r.meeting, {})[r.row] = r.col
    for g in {d[0] for d in data}:
        own = {(r, c): s for m, r, c, s in data if m == g}
        rows = sorted({r for r, _ in own})
        ways = [w for w in itertools.product([0, 1, 2, 3, 9], repeat=len(rows)) if all(c == 9 or (r, c) in own for r, c in zip(rows, w))
                and len({c for c in w if c != 9}) == sum(c != 9 for c in w)]
        best = min(ways, key=lambda w: (-sum(own.get(p, 0) for p in zip(rows, w)), w))
        assert got.get(g, {}) == {r: c for r, c in zip(rows, best) if c != 9}


def test_assignment(spark):
    mats, df = score_table(spark)
    check_pairs(mats, G.assign_one_to_one(df, ["meeting"], "row", "col").collect())


@pytest.mark.parametrize("places", [3, 1])
def test_both_ways_agree_on_many_groups(spark, monkeypatch, places):
    mats, df = score_table(spark, seed=11 + places, groups=200, places=places)
    check_pairs(mats, G.assign_one_to_one(df, ["meeting"], "row", "col").collect())
    monkeypatch.setattr(G, "SMALL_SIDE", 0)
    monkeypatch.setattr(G, "SCORE_STEPS", 10 ** places)
    check_pairs(mats, G.assign_one_to_one(df, ["meeting"], "row", "col").collect())


@pytest.mark.parametrize("small", [256, 0])
def test_negative_scores_and_pruned_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(G, "SMALL_SIDE", small)
    data = [("m", "r1", "A", -0.1), ("m", "r1", "B", -0.9), ("m", "r1", "C", -0.95), ("m", "r2", "A", 0.6), ("m", "r2", "B", -0.5), ("m", "r2", "C", 0.55)]
    df = spark.createDataFrame(data, "meeting string, row string, col string, score double")
    assert {(r.row, r.col) for r in G.assign_one_to_one(df, ["meeting"], "row", "col").collect()} == {("r1", "A"), ("r2", "C")}


def test_auction_finds_the_same_totals(spark):
    mats, df = score_table(spark, seed=4, groups=6)
    check_pairs(mats, G.auction(G.prune_scores(df, ["meeting"], "row", "col"), ["meeting"], "row", "col", scale=1000).collect())


def linkage_reference(m, k):
    """Average linkage, one merge at a time over all pairs."""
    groups = [[i] for i in range(len(m))]
    while len(groups) > k:
        sim = {(a, b): np.mean([m[i] @ m[j] for i in groups[a] for j in groups[b]]) for a in range(len(groups)) for b in range(a)}
        a, b = max(sim, key=sim.get)
        groups[b] += groups[a]
        del groups[a]
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("small", [1024, 3])
def test_clustering(spark, monkeypatch, small):
    monkeypatch.setattr(G, "SMALL_GROUP", small)
    sets = {"a": vecs(21, 18), "b": vecs(22, 11, noise=0.8), "c": vecs(23, 3)}
    df = spark.createDataFrame([(k, i, v.tolist()) for k, vs in sets.items() for i, v in enumerate(vs)], "meeting string, w_idx long, embedding array<double>")
    hints = spark.createDataFrame([("a", 1), ("b", 2)], "meeting string, hint int")
    got = {}
    for r in G.cluster_windows(df, hints, D).collect():
        got.setdefault(r.meeting, {}).setdefault(r.cluster, set()).add(r.w_idx)
    for k, hint in (("a", 1), ("b", 2), ("c", 2)):
        n = max(2, min(len(sets[k]) - 1, hint + 2))
        assert {frozenset(g) for g in got[k].values()} == linkage_reference(np.array(sets[k]), n)
        assert all(min(g) == c for c, g in got[k].items())


def test_greedy_once_per_chunk(spark):
    rnd = random.Random(5)
    data = [(m, f"c{c}_speaker_{s}", f"n{j}", round(rnd.random(), 6)) for m in "xy" for c in range(3) for s in range(4) for j in range(3)]
    df = spark.createDataFrame(data, "meeting string, speaker_id string, name string, score double")
    want, used, taken = {}, set(), set()
    for m, s, n, x in sorted(data, key=lambda r: -r[3]):
        if (m, s) in used or (m, s.split("_")[0], n) in taken:
            continue
        used.add((m, s))
        taken.add((m, s.split("_")[0], n))
        want[(m, s)] = (n, x)
    assert {(r.meeting, r.speaker_id): (r.name, r.score) for r in G.greedy_once_per_chunk(df).collect()} == want
    best = {}
    for m, s, n, x in data:
        best[(m, s)] = max(best.get((m, s), (-1, "")), (x, n))
    assert {(r.meeting, r.speaker_id): (r.score, r.name) for r in G.greedy_best(df).collect()} == best


def votes_reference(segs, clusters):
    words, turns, first = {}, {}, {}
    for i, (sid, t) in enumerate(segs):
        words[sid] = words.get(sid, 0) + len(t.split())
        turns[sid] = turns.get(sid, 0) + 1
        first.setdefault(sid, i)
    total = sum(words.values())
    who = [s for s in sorted(words, key=lambda k: (-words[k], first[k])) if words[s] / total >= 0.02]
    ids, seconds = sorted(clusters), sum(c[0] for c in clusters.values())
    v = {}
    for s in who:
        c = min(ids, key=lambda c: (abs(words[s] / total - clusters[c][0] / seconds), c))
        v[s, c] = v.get((s, c), 0) + 1
    for s, c in zip(sorted(who, key=lambda s: first[s]), sorted(ids, key=lambda c: clusters[c][1])):
        v[s, c] = v.get((s, c), 0) + 1
    for s, c in zip(sorted(who, key=lambda s: -words[s] / turns[s]), sorted(ids, key=lambda c: -clusters[c][2])):
        v[s, c] = v.get((s, c), 0) + 1
    return v


def test_map_speakers(spark):
    rnd = random.Random(7)
    seg_rows, cl_rows, want = [], [], {}
    for m in range(6):
        segs = [(f"s{rnd.randint(0, 3)}", "w " * rnd.randint(1, 12)) for _ in range(20)]
        cl = {c: (rnd.uniform(5, 90), rnd.uniform(0, 50), rnd.uniform(1, 20)) for c in range(rnd.randint(2, 4))}
        seg_rows += [(str(m), i, s, s, t) for i, (s, t) in enumerate(segs)]
        cl_rows += [(str(m), c, *x, [0.0]) for c, x in cl.items()]
        want[str(m)] = votes_reference(segs, cl)
    out = G.map_speakers(spark.createDataFrame(seg_rows, "meeting string, idx long, speaker_id string, speaker string, text string"),
                         spark.createDataFrame(cl_rows, "meeting string, cluster long, seconds double, first_start double, avg_turn double, centroid array<double>")).collect()
    got = {}
    for r in out:
        assert want[r.meeting][r.speaker_id, r.cluster] == r.votes >= 2
        got.setdefault(r.meeting, []).append((r.speaker_id, r.cluster))
    for m, v in want.items():
        pairs = got.get(m, [])
        assert len({s for s, _ in pairs}) == len(pairs) == len({c for _, c in pairs})
        # a sure pair (three votes of three) is always kept
        assert all(p in pairs for p, n in v.items() if n == 3)


def strangers_reference(items, threshold):
    groups = []
    for sid, chunk, v in sorted(items):
        best, at = -1.0, -1
        for i, g in enumerate(groups):
            if any(c == chunk for _, c, _ in g):
                continue
            s = float(unit(np.mean([x for *_, x in g], axis=0)) @ unit(v))
            if s > best:
                best, at = s, i
        if best >= threshold:
            groups[at].append((sid, chunk, v))
        else:
            groups.append([(sid, chunk, v)])
    return {sid: i for i, g in enumerate(groups) for sid, *_ in g}


def test_group_strangers(spark):
    items = [(f"c{i % 4}_speaker_{i}", i % 4, v) for i, v in enumerate(vecs(31, 24, noise=0.4))]
    df = spark.createDataFrame([("m", s, v.tolist()) for s, _, v in items], "meeting string, speaker_id string, embedding array<double>")
    assert {r.speaker_id: r.group for r in G.group_strangers(df, D).collect()} == strangers_reference(items, 0.45)


def test_identification_end_to_end(spark):
    """Two voices named by clusters and by centroids; a voice the gallery lacks gets a number."""
    base = np.eye(D)
    rnd = np.random.default_rng(3)
    noisy = lambda v: unit(v + 0.05 * rnd.normal(size=D)).tolist()
    gallery = spark.createDataFrame([("An", base[0].tolist(), "a@x"), ("Bình", base[1].tolist(), None)], "name string, embedding array<double>, email string")
    plan = [0] * 8 + [1] * 16
    rows = [("m", i, i, f"s{w}", f"S{w}", 3.0 * i, 3.0 * i + 3.0, "một hai ba bốn" if w else "một hai", noisy(base[w])) for i, w in enumerate(plan)]
    df = spark.createDataFrame(rows, "meeting string, idx long, w_idx long, speaker_id string, speaker string, start double, end double, text string, embedding array<double>")
    # two windows of noise take the two spare clusters
    noise = spark.createDataFrame([("m", 24 + i, 72.0 + 3 * i, 75.0 + 3 * i, base[2 + i].tolist()) for i in range(2)], "meeting string, w_idx long, start double, end double, embedding array<double>")
    windows = df.select("meeting", "w_idx", "start", "end", "embedding").unionByName(noise)
    by_clusters = G.identify_by_clusters(df, windows, gallery, D)
    by_centroids = G.identify_by_centroids(df, gallery, D)
    assert {r.speaker_id: r.name for r in by_centroids.collect()} == {"s0": "An", "s1": "Bình"}
    full = G.identify_with_fallback(df, by_clusters, by_centroids).collect()
    assert {r.speaker_id: r.name for r in full} == {"s0": "An", "s1": "Bình"}
    none = G.identify_with_fallback(df, by_clusters.where("false"), by_centroids.where("false")).collect()
    assert {(r.name, r.source) for r in none} == {("Speaker", "none")}
    members, facts, mapping = G.analyse_voices(df, windows, D)
    assert {r.speaker_id for r in G.cluster_samples(windows, members, mapping).collect()} == {"s0", "s1"}
    named = G.name_clusters(facts, gallery.where("name = 'An'"), D)
    assert sorted(r.name for r in named.collect()) == ["An", "Speaker 1"]
    assert V.identify(df, gallery, ["meeting", "idx"], dims=D).where("name = 'An'").count() == 8
