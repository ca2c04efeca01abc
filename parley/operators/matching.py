"""Clustering voices and matching them one-to-one with names."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import blocks, ordered
from ..functions import labels, text, vectors
from ..session import cut_lineage
from . import voices
from .timeline import MERGE_GAP, choose_samples

M = ["meeting"]
# Limits that decide results.
MIN_CLUSTER_WINDOWS = 5
TURN_BREAK_SEC = 3.0
MIN_WORD_SHARE = 0.02
MIN_VOTES = 2
# End of fixed values.
SMALL_SIDE = 256
SMALL_GROUP = 1024
SCORE_STEPS = 1_000_000


# -- one-to-one assignment -------------------------------------------------------------------------

def _best_pairs(s: np.ndarray) -> np.ndarray:
    """Column of each row in a total-maximising one-to-one assignment of whole scores; rows must not outnumber columns.

    Of equally good ones the first: each row in turn has the first column that a best total allows. Shortest augmenting
    paths with row and column prices (Jonker and Volgenant, 1987).
    """
    n, m = s.shape
    cost = -s
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        least, back, seen = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while owner[col]:
            seen[col] = True
            slack = cost[owner[col] - 1] - u[owner[col]] - v[1:]
            open_ = ~seen[1:]
            better = open_ & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], col
            nxt = 1 + int(np.argmin(np.where(open_, least[1:], np.inf)))
            step = least[nxt]
            u[owner[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            col = nxt
        while col:
            owner[col], col = owner[back[col]], back[col]
    out = np.zeros(n, dtype=int)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return _first_of_best(cost - u[1:, None] - v[None, 1:] == 0, v[1:] == 0, out)


def _first_of_best(tight: np.ndarray, spare: np.ndarray, match: np.ndarray) -> np.ndarray:
    """The first of all best assignments, from one of them.

    Best assignments are those that use ``tight`` pairs only (price-reduced cost 0) and leave only ``spare`` columns (price 0)
    free. A row gets an earlier column if its owner can move on along tight pairs, and so forth, until one takes the
    row's old column; a free column moves on to any spare one.
    """
    n, m = tight.shape
    owner = np.full(m, -1)
    owner[match] = np.arange(n)
    open_ = np.ones(m, dtype=bool)  # columns that no earlier row holds
    for row in range(n):
        old = match[row]
        for col in np.flatnonzero(tight[row] & open_):
            if col == old:
                break
            seen, back, todo = ~open_, np.full(m, -1), [col]
            seen[col] = True
            while todo and not seen[old]:
                c = todo.pop()
                new = np.flatnonzero((tight[owner[c]] if owner[c] >= 0 else spare) & ~seen)
                seen[new], back[new] = True, c
                todo += new.tolist()
            if not seen[old]:
                continue
            at = old
            while at != col:
                mover = owner[back[at]]
                owner[at] = mover
                if mover >= 0:
                    match[mover] = at
                at = back[at]
            match[row], owner[col] = col, row
            break
        open_[match[row]] = False
    return match


def prune_scores(scores: DataFrame, keys: Sequence[str], row: str, col: str) -> DataFrame:
    """Keep, per member of a group's smaller side, its best few partners: as many as that side has members.

    With n members on the smaller side, n-1 others can take at most n-1 of a
    member's n best partners, so some best total uses only these.
    """
    keys = list(keys)
    count = scores.groupBy(*keys).agg(F.countDistinct(row).alias("_rows"), F.countDistinct(col).alias("_cols"))
    sized = scores.join(count, keys).withColumn("_small", F.when(F.col("_rows") <= F.col("_cols"), F.col(row).cast("string")).otherwise(F.col(col).cast("string")))
    order = W.partitionBy(*keys, "_small").orderBy(F.desc("score"), row, col)
    return (sized.withColumn("_r", F.row_number().over(order))
            .where(F.col("_r") <= F.least("_rows", "_cols")).drop("_r", "_small"))


def assign_one_to_one(scores: DataFrame, keys: Sequence[str], row: str, col: str, sparse: bool = False) -> DataFrame:
    """Best one-to-one pairs of every group by total score, in whole steps of 1/SCORE_STEPS.

    ``scores`` lists every pair of a group, or at least every row's best
    partners, as many as the smaller side has members; each member of the
    smaller side gets a partner, if only at a negative score. ``sparse`` means
    that pairs not listed score 0, as votes do, and a row may stay alone. Groups
    whose smaller side is moderate are solved in one task each after pruning, and
    of equal totals the first is taken: the smaller side (``sparse``: the rows) in order, each
    with the first partner that a best total allows, alone last. Larger groups go through
    auction rounds over all groups at once.
    """
    keys = list(keys)
    pruned = prune_scores(cut_lineage(scores), keys, row, col)
    small = pruned.where(F.least("_rows", "_cols") <= SMALL_SIDE).select(*keys, row, col, "score")
    schema = T.StructType([scores.schema[c] for c in [*keys, row, col]] + [T.StructField("score", T.DoubleType())])

    def solve(key, table):
        r, c = table.column(row).to_pylist(), table.column(col).to_pylist()
        rows, cols = sorted(set(r)), sorted(set(c))
        ri, ci = {x: i for i, x in enumerate(rows)}, {x: i for i, x in enumerate(cols)}
        score = np.array(table.column("score").to_pylist(), dtype=float)
        whole = np.rint(score * SCORE_STEPS)
        # A pair that is not listed must never beat a listed one, not even a negative one.
        size = len(rows) if sparse else min(len(rows), len(cols))
        never = min(whole.min(), 0.0) - (max(whole.max(), 0.0) - min(whole.min(), 0.0) + 1) * (size + 1)
        wide = len(cols) + (len(rows) if sparse else 0)  # sparse: a row may stay alone, in a column of its own at the end
        s, exact = np.full((len(rows), wide), never), np.zeros((len(rows), wide))
        listed = np.zeros(s.shape, dtype=bool)
        for a, b, w, x in zip(r, c, whole, score):
            s[ri[a], ci[b]], exact[ri[a], ci[b]], listed[ri[a], ci[b]] = w, x, True
        if sparse:
            s[np.arange(len(rows)), len(cols) + np.arange(len(rows))] = 0.0
        flip = len(rows) > wide
        pick = _best_pairs(s.T if flip else s)
        pairs = [(b, a) if flip else (a, b) for a, b in enumerate(pick)]
        pairs = [(a, b) for a, b in pairs if listed[a, b]]
        data = {k: pa.array([v.as_py()] * len(pairs), v.type) for k, v in zip(keys, key)}
        data[row] = pa.array([rows[a] for a, _ in pairs], table.schema.field(row).type)
        data[col] = pa.array([cols[b] for _, b in pairs], table.schema.field(col).type)
        data["score"] = pa.array([float(exact[a, b]) for a, b in pairs], pa.float64())
        return pa.table(data)

    solved = small.groupBy(*keys).applyInArrow(solve, schema)
    large = pruned.where(F.least("_rows", "_cols") > SMALL_SIDE)
    if large.select(F.lit(1)).limit(1).count() == 0:
        return solved
    return solved.unionByName(auction(large, keys, row, col))


def auction(scores: DataFrame, keys: Sequence[str], row: str, col: str, scale: int | None = None) -> DataFrame:
    """One-to-one assignment by auction rounds (Bertsekas, 1988), exact to 1/scale.

    The smaller side bids. Scores are whole numbers times (side size + 1) with a
    price step of 1, which makes the final total optimal. Every round is two
    joins and two aggregates over all groups; nothing is gathered.
    """
    keys, scale = list(keys), scale or SCORE_STEPS
    sizes = scores.groupBy(*keys).agg(F.countDistinct(row).alias("_a"), F.countDistinct(col).alias("_b"))
    edges = scores.drop("_rows", "_cols").join(sizes, keys)
    flip = F.col("_a") > F.col("_b")
    edges = cut_lineage(edges.select(
        *keys, F.when(flip, F.col(col).cast("string")).otherwise(F.col(row).cast("string")).alias("bidder"),
        F.when(flip, F.col(row).cast("string")).otherwise(F.col(col).cast("string")).alias("item"),
        F.rint(F.col("score") * scale).cast("long").alias("whole"), F.least("_a", "_b").alias("n"), row, col, "score")
        .withColumn("worth", F.col("whole") * (F.col("n") + 1)))
    # A bidder with fewer listed items than bidders may also stay alone, which is worth 0.
    few = edges.groupBy(*keys, "bidder").agg(F.count(F.lit(1)).alias("_d"), F.first("n").alias("n")).where("_d < n")
    alone = few.select(*keys, "bidder", F.concat(F.lit("alone:"), F.col("bidder")).alias("item"), F.lit(0).cast("long").alias("worth"))
    real = edges
    edges = cut_lineage(edges.select(*keys, "bidder", "item", "worth").unionByName(alone))
    prices = edges.select(*keys, "item", F.lit(None).cast("string").alias("holder"), F.lit(0).cast("long").alias("price")).limit(0)
    while True:
        held = prices.select(*keys, F.col("holder").alias("bidder"))
        free = edges.join(held, [*keys, "bidder"], "left_anti")
        offers = (free.join(prices.select(*keys, "item", "price"), [*keys, "item"], "left")
                  .withColumn("net", F.col("worth") - F.coalesce("price", F.lit(0))))
        order = W.partitionBy(*keys, "bidder").orderBy(F.desc("net"), "item")
        ranked = (offers.withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("net").over(order)).where("r = 1"))
        bids = ranked.select(*keys, "bidder", "item", (F.coalesce("price", F.lit(0)) + F.col("net")
                             - F.coalesce("second", F.col("net")) + 1).alias("bid"))
        won = bids.groupBy(*keys, "item").agg(F.max(F.struct("bid", "bidder")).alias("w"))
        won = won.select(*keys, "item", F.col("w.bidder").alias("holder"), F.col("w.bid").alias("price"))
        now = cut_lineage(won.unionByName(prices.join(won, [*keys, "item"], "left_anti")))
        changed = bids.limit(1).count()
        prices = now
        if not changed:
            break
    return (real.join(prices.select(*keys, "item", F.col("holder").alias("bidder")), [*keys, "item", "bidder"])
            .select(*keys, row, col, "score"))


# -- clustering ------------------------------------------------------------------------------------

def cluster_windows(windows: DataFrame, hints: DataFrame, dims: int = voices.DIMS) -> DataFrame:
    """Average-linkage clusters on cosine distance, ``max(2, min(n-1, hint+2))`` per meeting.

    A cluster is named by its smallest window. On unit vectors the average
    similarity of two clusters is the product of their vector sums over their
    sizes, so no pair table is kept: usual meetings are merged in one task,
    huge ones by rounds of mutual nearest neighbours over all meetings.
    """
    rows = windows.where(F.size("embedding") == dims).select("meeting", F.col("w_idx").cast("long"), "embedding")
    sizes = rows.groupBy("meeting").agg(F.count(F.lit(1)).alias("n")).join(hints, M, "left")
    want = F.greatest(F.lit(2), F.least(F.col("n") - 1, F.coalesce("hint", F.lit(2)) + 2))
    rows = rows.join(sizes.select("meeting", "n", want.cast("int").alias("k")), M)
    schema = T.StructType([rows.schema["meeting"], T.StructField("w_idx", T.LongType()), T.StructField("cluster", T.LongType())])

    def merge(key, table):
        ids = np.asarray(table.column("w_idx"))
        order = np.argsort(ids, kind="stable")
        ids, m = ids[order], blocks.matrix(table)[order]
        k, n = int(table.column("k")[0].as_py()), len(ids)
        sums, size, label = m.copy(), np.ones(n), np.arange(n)
        sim = np.round(m @ m.T, 12)  # the same ties as in cluster_by_rounds
        np.fill_diagonal(sim, -np.inf)
        for _ in range(n - min(k, n)):
            a, b = sorted(divmod(int(np.argmax(sim)), n))
            sums[a] += sums[b]
            size[a] += size[b]
            label[label == b] = a
            row = np.round((sums @ sums[a]) / (size * size[a]), 12)
            row[np.isneginf(sim).all(axis=1)] = -np.inf
            sim[b, :] = sim[:, b] = -np.inf
            row[b] = row[a] = -np.inf
            sim[a, :] = sim[:, a] = row
        return pa.table({"meeting": pa.array([key[0].as_py()] * n, key[0].type), "w_idx": pa.array(ids),
                         "cluster": pa.array(ids[label])})

    small = rows.where(F.col("n") <= SMALL_GROUP).groupBy("meeting").applyInArrow(merge, schema)
    if sizes.where(F.col("n") > SMALL_GROUP).limit(1).count() == 0:
        return small
    return small.unionByName(cluster_by_rounds(rows.where(F.col("n") > SMALL_GROUP)))


def cluster_by_rounds(rows: DataFrame) -> DataFrame:
    """Average linkage by merging all mutual nearest neighbours per round.

    Average linkage is reducible, so these merges are merges of the full tree;
    the tree is cut by keeping the n-k merges of highest similarity.
    """
    goal = cut_lineage(rows.groupBy("meeting").agg(F.first("n").alias("n"), F.first("k").alias("k")))
    live = cut_lineage(rows.select("meeting", F.col("w_idx").alias("id"), vectors.unit("embedding").alias("sum"), F.lit(1.0).alias("size")))
    tree = None
    out = T.StructType([live.schema["meeting"], T.StructField("id", T.LongType()), T.StructField("near", T.LongType()),
                        T.StructField("sim", T.DoubleType())])

    def nearest(key, lt, rt):
        a, b = np.asarray(lt.column("id")), np.asarray(rt.column("id"))
        raw = lambda t: np.asarray(t.column("sum").combine_chunks().flatten()).reshape(t.num_rows, -1) / np.asarray(t.column("size"))[:, None]
        best, sims = [], []
        if len(a) and len(b):
            order = np.argsort(b, kind="stable")
            b, r = b[order], raw(rt)[order]
            for off, s in blocks.strips(raw(lt), r):
                s[b[None, :] == a[off:off + len(s), None]] = -np.inf
                j = s.argmax(axis=1)
                best.append(b[j]); sims.append(s[np.arange(len(s)), j])
        cat = lambda x, t: np.concatenate(x) if x else np.array([], dtype=t)
        sims = cat(sims, np.float64)
        ok = np.isfinite(sims)
        return pa.table({"meeting": pa.array([key[0].as_py()] * int(ok.sum()), key[0].type), "id": pa.array(a[ok] if len(sims) else sims.astype(np.int64)),
                         "near": pa.array(cat(best, np.int64)[ok]), "sim": pa.array(sims[ok])})

    while True:
        found = blocks.cells(live, live, M, "id", "id", nearest, out)
        best = found.groupBy("meeting", "id").agg(F.max(F.struct(F.round("sim", 12).alias("s"), (-F.col("near")).alias("j"))).alias("b")) \
            .select("meeting", "id", (-F.col("b.j")).alias("near"), F.col("b.s").alias("sim"))
        best = cut_lineage(best)
        mirror = best.select("meeting", F.col("near").alias("id"), F.col("id").alias("near"))
        pairs = best.join(mirror, ["meeting", "id", "near"]).where("id < near")
        pairs = cut_lineage(pairs)
        if pairs.limit(1).count() == 0:
            break
        tree = pairs if tree is None else tree.unionByName(pairs)
        into = pairs.select("meeting", F.col("near").alias("id"), F.col("id").alias("_to"))
        moved = live.join(into, ["meeting", "id"], "left").withColumn("id", F.coalesce("_to", "id"))
        plus = F.zip_with(F.element_at("v", 1), F.element_at("v", -1), lambda x, y: x + y)
        live = cut_lineage(moved.groupBy("meeting", "id").agg(F.collect_list("sum").alias("v"), F.sum("size").alias("size"))
                           .select("meeting", "id", F.when(F.size("v") == 2, plus).otherwise(F.element_at("v", 1)).alias("sum"), "size"))
    return _cut_tree(rows, tree, goal)


def _cut_tree(rows: DataFrame, tree: DataFrame, goal: DataFrame) -> DataFrame:
    """Cluster of every window from the n-k best merges."""
    best_first = ordered.place_rows(tree.withColumn("_d", -F.col("sim")), M, "_d", ties=("id", "near"), name="_r")
    kept = best_first.join(goal, M).where(F.col("_r") < F.col("n") - F.col("k")).select("meeting", "id", "near")
    links = cut_lineage(kept.select("meeting", F.col("near").alias("child"), F.col("id").alias("parent")))
    found = cut_lineage(rows.select("meeting", "w_idx", F.col("w_idx").alias("cluster")))
    while True:
        # A merge always keeps the smaller id, so following parents ends at the smallest member.
        up = links.select("meeting", F.col("child").alias("cluster"), "parent")
        step = found.join(up, ["meeting", "cluster"], "left")
        moved = step.where("parent is not null").limit(1).count()
        found = cut_lineage(step.select("meeting", "w_idx", F.coalesce("parent", "cluster").alias("cluster")))
        if not moved:
            return found
        wide = links.alias("a").join(links.alias("b"), (F.col("a.meeting") == F.col("b.meeting")) & (F.col("a.parent") == F.col("b.child")), "left")
        links = cut_lineage(wide.select(F.col("a.meeting").alias("meeting"), F.col("a.child").alias("child"),
                                        F.coalesce("b.parent", "a.parent").alias("parent")))


def cluster_facts(windows: DataFrame, members: DataFrame, dims: int = voices.DIMS,
                  min_windows: int = MIN_CLUSTER_WINDOWS) -> DataFrame:
    """Centroid, seconds, first start and mean turn length of every cluster that is large enough."""
    rows = windows.join(members, ["meeting", "w_idx"]).withColumn("_u", vectors.unit("embedding"))
    key = ["meeting", "cluster"]
    centre = voices.mean_vector(rows, key, dims, "_u").where(F.col("n") >= min_windows).withColumnRenamed("embedding", "centroid")
    step = ordered.scan(rows.select(*key, "w_idx", "start", "end"), key, "start", ties=("w_idx",), prev={"_e": F.col("end")}, width=900.0)
    new = F.col("_e").isNull() | (F.col("start") - F.col("_e") > TURN_BREAK_SEC)
    length = F.col("end") - F.col("start")
    facts = step.groupBy(*key).agg(F.sum(length).alias("seconds"), F.min("start").alias("first_start"),
                                   (F.sum(length) / F.count_if(new)).alias("avg_turn"))
    return centre.join(facts, key).select(*key, F.col("n").alias("windows"), "seconds", "first_start", "avg_turn", "centroid")


def map_speakers(segments: DataFrame, clusters: DataFrame) -> DataFrame:
    """Speaker id ↔ cluster by three votes that need no clock: share of talk, order of first speech, length of turns."""
    sid = F.coalesce(F.nullif("speaker_id", F.lit("")), F.nullif("speaker", F.lit("")), F.lit("unknown"))
    talk = segments.groupBy("meeting", sid.alias("sid")).agg(
        F.sum(text.word_count("text")).alias("words"), F.count(F.lit(1)).alias("turns"), F.min("idx").alias("first"))
    total = talk.groupBy("meeting").agg(F.greatest(F.lit(1), F.sum("words")).alias("total"))
    talk = (talk.join(total, M).withColumn("share", F.col("words") / F.col("total")).where(F.col("share") >= MIN_WORD_SHARE)
            .withColumn("per_turn", F.col("words") / F.col("turns")))
    talk = cut_lineage(talk)
    clusters = cut_lineage(clusters.select("meeting", "cluster", "seconds", "first_start", "avg_turn"))
    seconds = clusters.groupBy("meeting").agg(F.sum("seconds").alias("total"))
    found = clusters.join(seconds, M) \
        .withColumn("share", F.col("seconds") / F.coalesce(F.nullif("total", F.lit(0.0)), F.lit(1.0)))

    # Nearest share on either side, read from one ordered pass over both tables.
    spots = found.groupBy("meeting", "share").agg(F.min("cluster").alias("cluster"))
    both = talk.select("meeting", "share", F.col("sid").alias("_sid"), F.lit(None).cast("long").alias("cluster"), F.lit(1).alias("_side")) \
        .unionByName(spots.select("meeting", "share", F.lit(None).cast("string").alias("_sid"), "cluster", F.lit(0).alias("_side")))
    at = F.when(F.col("_side") == 0, F.struct("share", "cluster"))
    near = ordered.scan(both, M, "share", ties=("_side", "_sid"), prev={"_b": at}, following={"_a": at}, width=0.01)
    gap_b, gap_a = F.abs(F.col("share") - F.col("_b.share")), F.abs(F.col("share") - F.col("_a.share"))
    pick = (F.when(F.col("_a").isNull(), F.col("_b.cluster")).when(F.col("_b").isNull(), F.col("_a.cluster"))
            .when(gap_b < gap_a, F.col("_b.cluster")).when(gap_a < gap_b, F.col("_a.cluster"))
            .otherwise(F.least("_a.cluster", "_b.cluster")))
    vote1 = near.where("_side = 1").select("meeting", F.col("_sid").alias("sid"), pick.alias("cluster"))

    def ranked(df, column, sign, ties, width):
        return ordered.number_rows(df.withColumn("_o", sign * F.col(column)), M, "_o", ties=ties, name="_rank", width=width)

    talk = talk.withColumn("_w", -F.col("words"))
    vote2 = ranked(talk, "first", 1, ("sid",), 1e5).select("meeting", "_rank", "sid").join(
        ranked(found, "first_start", 1, ("cluster",), 900.0).select("meeting", "_rank", "cluster"), ["meeting", "_rank"])
    vote3 = ranked(talk, "per_turn", -1, ("_w", "first"), 10.0).select("meeting", "_rank", "sid").join(
        ranked(found, "avg_turn", -1, ("cluster",), 10.0).select("meeting", "_rank", "cluster"), ["meeting", "_rank"])
    votes = vote1.unionByName(vote2.drop("_rank")).unionByName(vote3.drop("_rank")).groupBy("meeting", "sid", "cluster") \
        .agg(F.count(F.lit(1)).cast("double").alias("score"))
    pairs = assign_one_to_one(votes, M, "sid", "cluster", sparse=True)
    return pairs.where(F.col("score") >= MIN_VOTES).select("meeting", F.col("sid").alias("speaker_id"), "cluster",
                                                            F.col("score").cast("int").alias("votes"))


def name_clusters(clusters: DataFrame, gallery: DataFrame, dims: int = voices.DIMS, threshold: float = voices.ACCEPT) -> DataFrame:
    """Clusters to gallery names one-to-one; a cluster without an accepted name is ``Speaker n``."""
    pairs = assign_one_to_one(_scores(clusters, gallery, "cluster", dims), M, "cluster", "name")
    pairs = cut_lineage(pairs)
    scored = clusters.select("meeting", "cluster").join(pairs, ["meeting", "cluster"], "left") \
        .withColumn("named", F.coalesce(F.col("score") >= threshold, F.lit(False)))
    odd = ordered.number_rows(scored.where(~F.col("named")), M, "cluster", name="_n", start=1).select("meeting", "cluster", "_n")
    return (scored.join(odd, ["meeting", "cluster"], "left")
            .select("meeting", "cluster", F.when(F.col("named"), F.col("name"))
                    .otherwise(F.concat(F.lit("Speaker "), F.col("_n").cast("string"))).alias("name"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))


def _scores(rows: DataFrame, gallery: DataFrame, id: str, dims: int) -> DataFrame:
    """Scores an assignment can use: each row's best names, as many as its meeting has rows."""
    size = rows.groupBy("meeting").agg(F.count(F.lit(1)).cast("int").alias("_want"))
    vector = "centroid" if "centroid" in rows.columns else "embedding"
    probes = rows.select("meeting", id, F.col(vector).alias("embedding")).join(size, M)
    return voices.rank_names(probes, gallery, ["meeting", id], k="_want", dims=dims).drop("rank")


def match_speakers(centroids: DataFrame, gallery: DataFrame, dims: int = voices.DIMS, threshold: float = voices.ACCEPT) -> DataFrame:
    """Speaker centroids to names one-to-one, accepted above the threshold; contaminated meetings are void."""
    centroids = cut_lineage(centroids)
    void = voices.contaminated(centroids, dims=dims).select("meeting")
    clean = centroids.join(void, M, "left_anti")
    pairs = assign_one_to_one(_scores(clean, gallery, "speaker_id", dims), M, "speaker_id", "name")
    return pairs.where(F.col("score") >= threshold)


def identify_by_centroids(windows: DataFrame, gallery: DataFrame, dims: int = voices.DIMS,
                          threshold: float = voices.ACCEPT) -> DataFrame:
    """Turn windows with vectors → robust centroid per speaker → names."""
    return match_speakers(voices.robust_centroid(windows, ["meeting", "speaker_id"], dims=dims), gallery, dims, threshold)


def analyse_voices(segments: DataFrame, windows: DataFrame, dims: int = voices.DIMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cluster members, cluster facts and the speaker-to-cluster map; meetings with too few windows are left out."""
    ok = F.size("embedding") == dims
    enough = windows.where(ok).groupBy("meeting").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2 * MIN_CLUSTER_WINDOWS)
    used = windows.where(ok).join(enough.select("meeting"), M, "left_semi")
    hints = segments.select("meeting", F.coalesce("speaker_id", "speaker").alias("s")).distinct().groupBy("meeting").agg(F.count("s").cast("int").alias("hint"))
    members = cut_lineage(cluster_windows(used, hints, dims))
    facts = cut_lineage(cluster_facts(used, members, dims))
    return members, facts, cut_lineage(map_speakers(segments, facts))


def identify_by_clusters(segments: DataFrame, windows: DataFrame, gallery: DataFrame, dims: int = voices.DIMS,
                         threshold: float = voices.ACCEPT) -> DataFrame:
    """Names by voice clusters, independent of turn times."""
    _, facts, mapping = analyse_voices(segments, windows, dims)
    return mapping.join(name_clusters(facts, gallery, dims, threshold), ["meeting", "cluster"]).select("meeting", "speaker_id", "name", "score")


def identify_with_fallback(speakers: DataFrame, by_clusters: DataFrame, by_centroids: DataFrame) -> DataFrame:
    """Per meeting the cluster result if there is one, else the centroid result; everyone else is ``Speaker``."""
    done = by_clusters.select("meeting").distinct()
    rest = by_centroids.select("meeting", "speaker_id", "name", "score").join(done, M, "left_anti").withColumn("source", F.lit("centroids"))
    found = by_clusters.select("meeting", "speaker_id", "name", "score").withColumn("source", F.lit("clusters")).unionByName(rest)
    return (speakers.select("meeting", "speaker_id").distinct().join(found, ["meeting", "speaker_id"], "left")
            .select("meeting", "speaker_id", F.coalesce("name", F.lit("Speaker")).alias("name"),
                    F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("source", F.lit("none")).alias("source")))


def cluster_samples(windows: DataFrame, members: DataFrame, mapping: DataFrame, max_total: float = 25.0) -> DataFrame:
    """Sample parts per speaker id from its cluster's windows; short parts only where no longer one exists."""
    rows = mapping.join(members, ["meeting", "cluster"]).join(windows.select("meeting", "w_idx", "start", "end"), ["meeting", "w_idx"]).select(
        "meeting", "speaker_id", F.col("w_idx").alias("idx"), "start", "end")
    key = ["meeting", "speaker_id"]
    good = choose_samples(rows, key, max_total, 1.5)
    rest = rows.join(good.select(*key).distinct(), key, "left_anti")
    return good.unionByName(choose_samples(rest, key, max_total, 0.0))


# -- greedy forms ----------------------------------------------------------------------------------

def greedy_best(candidates: DataFrame, keys: Sequence[str] = ("meeting", "speaker_id")) -> DataFrame:
    """Greedy choice in score order where a name may serve many ids: every id gets its best name."""
    first = F.min_by(F.struct("name", "score"), F.struct((-F.col("score")).alias("s"), "name"))
    return candidates.groupBy(*keys).agg(first.alias("b")).select(*keys, "b.*")


def greedy_once_per_chunk(candidates: DataFrame) -> DataFrame:
    """Greedy choice in score order where a name serves one id per chunk.

    An edge that is the best of both its id and its (chunk, name) is what the
    greedy order would take next; each round takes all of them.
    """
    edges = cut_lineage(candidates.select("meeting", labels.chunk_prefix("speaker_id").alias("part"), "speaker_id", "name", "score"))
    taken = None
    best = F.max(F.struct(F.col("score"), F.col("_h"))).alias("b")
    while True:
        # One total order for all edges: score, then a fixed order of the pair.
        keyed = edges.withColumn("_h", F.struct(F.xxhash64("speaker_id", "name").alias("h"), "speaker_id", "name"))
        by_id = keyed.groupBy("meeting", "part", "speaker_id").agg(best).select("meeting", "part", F.col("b.score").alias("score"), F.col("b._h").alias("_h"))
        by_name = keyed.groupBy("meeting", "part", "name").agg(best).select("meeting", "part", F.col("b.score").alias("score"), F.col("b._h").alias("_h"))
        mutual = by_id.intersect(by_name)
        won = cut_lineage(mutual.select("meeting", "part", F.col("_h.speaker_id").alias("speaker_id"), F.col("_h.name").alias("name"), "score"))
        if won.limit(1).count() == 0:
            break
        taken = won if taken is None else taken.unionByName(won)
        edges = cut_lineage(edges.join(won.select("meeting", "part", "speaker_id"), ["meeting", "part", "speaker_id"], "left_anti")
                            .join(won.select("meeting", "part", "name"), ["meeting", "part", "name"], "left_anti"))
    empty = edges.limit(0).select("meeting", "part", "speaker_id", "name", "score")
    return (empty if taken is None else taken).select("meeting", "speaker_id", "name", "score")


def group_strangers(speakers: DataFrame, dims: int = voices.DIMS, threshold: float = voices.STRANGER_MERGE) -> DataFrame:
    """Group speaker ids of different chunks by voice, in id order; a group never holds two ids of one chunk.

    ``speakers`` has one vector per (meeting, speaker_id). Each id joins the
    group of nearest mean at or above the threshold, else it opens one. The
    walk is over the ids of one recording, a few per chunk.
    """
    rows = speakers.where(F.size("embedding") == dims).select(
        "meeting", "speaker_id", F.coalesce(labels.chunk_index("speaker_id"), F.lit(-1)).alias("chunk"), "embedding")
    rows = ordered.number_rows(rows.withColumn("_o", F.lit(0)), M, "_o", ties=("speaker_id",), name="ord")
    schema = T.StructType([rows.schema["meeting"], T.StructField("speaker_id", T.StringType()), T.StructField("group", T.LongType())])

    def walk(key, table):
        order = np.argsort(np.asarray(table.column("ord")), kind="stable")
        ids = table.column("speaker_id").to_pylist()
        raw = np.asarray(table.column("embedding").combine_chunks().flatten(), dtype=np.float64).reshape(table.num_rows, -1)
        chunk = np.asarray(table.column("chunk"))
        sums, counts, inside, out = np.zeros((0, raw.shape[1])), np.zeros(0), [], []
        for at in order:
            v, best = raw[at], -1
            if len(counts):
                norm = np.linalg.norm(sums, axis=1) * np.linalg.norm(v)
                sim = np.where(norm > 0, (sums @ v) / np.where(norm > 0, norm, 1.0), 0.0)
                sim[[i for i, c in enumerate(inside) if chunk[at] in c]] = -1.0
                best = int(np.argmax(sim)) if sim.max() >= threshold else -1
            if best < 0:
                sums, counts, best = np.vstack([sums, v]), np.append(counts, 1), len(counts)
                inside.append({chunk[at]})
            else:
                sums[best] += v
                counts[best] += 1
                inside[best].add(chunk[at])
            out.append((ids[at], best))
        return pa.table({"meeting": pa.array([key[0].as_py()] * len(out), key[0].type),
                         "speaker_id": pa.array([i for i, _ in out], pa.string()), "group": pa.array([g for _, g in out], pa.int64())})

    return rows.groupBy("meeting").applyInArrow(walk, schema)
