"""Voice vectors: ranking against a gallery, centroids, outliers, contamination.

A gallery is (name, embedding, …). A probe table has any key columns and an
``embedding``. ``dims`` is the vector length (192 unless said otherwise).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import blocks, ordered
from ..functions import labels, text, vectors
from ..session import cut_lineage

# Thresholds that decide results.
DIMS = 192
ACCEPT = 0.50
STRANGER_MERGE = 0.45
CONTAMINATION = 0.92
PURIFY_MIN_SEGMENTS, PURIFY_MIN_SEC, PURIFY_SCORE, PURIFY_SHARE = 6, 1.5, 0.35, 0.5
CENTROID_FLOOR, CENTROID_PERCENTILE = 0.45, 0.25
SLACK = 1e-9  # more than medians differ by rounding and by the order of sums
# End of fixed values.


def _ranked(batch, keys: list[str], left: np.ndarray, names: np.ndarray, right: np.ndarray, k, floor) -> pa.RecordBatch:
    """Best ``k`` names of every row as a record batch; ``k`` is None or one number per row."""
    rows, cols, scores, ranks = [], [], [], []
    for at, sims in blocks.strips(left, right):
        for r, s in enumerate(sims):
            limit = len(s) if k is None else int(k[at + r])
            if limit == 1:
                best = s.max()
                tied = np.flatnonzero(s == best)
                order = tied if len(tied) == 1 else tied[np.argsort(names[tied], kind="stable")][:1]
            else:
                near = np.arange(len(s))
                if limit < len(s):
                    near = np.flatnonzero(s >= np.partition(s, len(s) - limit)[len(s) - limit])
                order = near[np.lexsort((names[near], -s[near]))][:limit]
            if floor is not None:
                order = order[s[order] >= floor]
            rows.append(np.full(len(order), at + r))
            cols.append(order)
            scores.append(s[order])
            ranks.append(np.arange(1, len(order) + 1))
    at = pa.array(np.concatenate(rows) if rows else np.array([], dtype=np.int64))
    pick = np.concatenate(cols) if cols else np.array([], dtype=np.int64)
    data = [batch.column(c).take(at) for c in keys]
    data += [pa.array(names[pick].tolist(), pa.string()),
             pa.array(np.concatenate(scores) if scores else np.array([]), pa.float64()),
             pa.array(np.concatenate(ranks) if ranks else np.array([], dtype=np.int64)).cast(pa.int32())]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in data],
                                      names=[*keys, "name", "score", "rank"])


def rank_names(probes: DataFrame, gallery: DataFrame, keys: Sequence[str], *, k: int | str | None = None,
               floor: float | None = None, dims: int = DIMS) -> DataFrame:
    """The best ``k`` gallery names per probe row, or all with a score of at least ``floor``, with ``rank`` by score and name.

    ``k`` may name an integer column of the probes; one of both limits must be
    given. A gallery counted as small is shipped to every task and the probes
    are never shuffled; a larger one is multiplied block by block and the
    partial winners are merged per probe row.
    """
    if k is None and floor is None:
        raise ValueError("give k or floor: all names of all probes are as many rows as their product")
    keys = list(keys)
    ok = F.size("embedding") == dims
    kcol = [F.col(k).cast("int").alias("_k")] if isinstance(k, str) else []
    probes = probes.where(ok).select(*keys, *kcol, "embedding")
    gallery = gallery.where(ok).select("name", "embedding")
    fields = [probes.schema[c] for c in keys]
    schema = T.StructType(fields + [T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType()),
                                    T.StructField("rank", T.IntegerType())])

    def limits(batch):
        if k is None:
            return None
        if isinstance(k, int):
            return np.full(batch.num_rows, k)
        return np.asarray(batch.column("_k"))

    if blocks.fits_broadcast(gallery, dims):
        rows = gallery.toArrow()
        shipped = probes.sparkSession.sparkContext.broadcast(
            (np.array(rows.column("name").to_pylist(), dtype=object), blocks.matrix(rows)))

        def run(batches):
            names, right = shipped.value
            for b in batches:
                if b.num_rows and len(names):
                    yield _ranked(b, keys, blocks.matrix(b), names, right, limits(b), floor)

        # A probe meets the whole gallery in one place, so its ranks are final there.
        return probes.mapInArrow(run, schema)
    else:
        def cell(key, lt, rt):
            if not lt.num_rows or not rt.num_rows:
                return schema_arrow.empty_table()
            names = np.array(rt.column("name").to_pylist(), dtype=object)
            return pa.Table.from_batches([_ranked(lt, [*keys, "_row"], blocks.matrix(lt), names, blocks.matrix(rt), limits(lt), floor)])

        from pyspark.sql.pandas.types import to_arrow_schema
        schema = T.StructType([*fields, T.StructField("_row", T.LongType()), *schema.fields[len(fields):]])
        schema_arrow = to_arrow_schema(schema)
        # A probe row is known by its number, so rows that repeat a key are ranked apart, as above.
        one = cut_lineage(probes.withColumn("_row", F.monotonically_increasing_id()))
        found = blocks.cells(one, gallery, [], "_row", "name", cell, schema)
    # Each block gave its own winners; a probe has at most one row per name.
    out = found.withColumn("rank", F.row_number().over(W.partitionBy("_row").orderBy(F.desc("score"), "name")))
    if isinstance(k, int):
        out = out.where(F.col("rank") <= k)
    elif isinstance(k, str):
        out = out.join(one.select("_row", "_k"), "_row").where(F.col("rank") <= F.col("_k")).drop("_k")
    return out.drop("_row")


def rank_allowed(probes: DataFrame, gallery: DataFrame, allowed: DataFrame, keys: Sequence[str], *,
                 floor: float | None = None, dims: int = DIMS) -> DataFrame:
    """Rank only the names each meeting allows: an equi-join, so only asked-for pairs are scored."""
    ok = F.size("embedding") == dims
    probes, gallery = probes.where(ok), gallery.where(ok)
    listed = allowed.select("meeting", "name").distinct().join(gallery.select("name", vectors.unit("embedding").alias("_g")), "name")
    out = (probes.select(*keys, vectors.unit("embedding").alias("_v")).join(listed, "meeting")
           .select(*keys, "name", vectors.dot("_v", "_g").alias("score")))
    if floor is not None:
        out = out.where(F.col("score") >= floor)
    return out.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "name")))


def identify(probes: DataFrame, gallery: DataFrame, keys: Sequence[str], *, threshold: float = ACCEPT,
             dims: int = DIMS) -> DataFrame:
    """Best name at or above the threshold, else ``Speaker`` with the best score."""
    best = rank_names(probes, gallery, keys, k=1, dims=dims)
    return best.select(*keys, F.when(F.col("score") >= threshold, F.col("name")).otherwise("Speaker").alias("name"), "score")


def identify_ranked(probes: DataFrame, gallery: DataFrame, keys: Sequence[str], *, threshold: float = ACCEPT,
                    dims: int = DIMS) -> DataFrame:
    """Every name at or above the threshold, in order."""
    return rank_names(probes, gallery, keys, floor=threshold, dims=dims)


def canonical_gallery(gallery: DataFrame, aliases: DataFrame) -> DataFrame:
    """Gallery without composite duplicates of a name it also holds."""
    canon = aliases.select(F.col("alias").alias("name"), F.col("canonical").alias("_c")).where("name <> _c")
    held = gallery.select(F.col("name").alias("_c")).distinct()
    return gallery.join(canon.join(held, "_c", "left_semi"), "name", "left_anti")


def top_match(probes: DataFrame, gallery: DataFrame, aliases: DataFrame, keys: Sequence[str], *,
              allowed: DataFrame | None = None, threshold: float = ACCEPT, dims: int = DIMS) -> DataFrame:
    """Accepted best match; a meeting with an allow-list is matched inside it, others against the whole gallery."""
    g = canonical_gallery(gallery, aliases)
    if allowed is None:
        best = rank_names(probes, g, keys, k=1, dims=dims)
    else:
        named = normalize_names(allowed, "name", aliases).select("meeting", F.col("canonical").alias("name"))
        open_meetings = probes.join(named.select("meeting").distinct(), "meeting", "left_anti")
        best = (rank_allowed(probes, g, named, keys, dims=dims).where("rank = 1")
                .unionByName(rank_names(open_meetings, g, keys, k=1, dims=dims)))
    return best.where(F.col("score") >= threshold).select(*keys, "name", "score")


def second_pass(first: DataFrame, probes: DataFrame, gallery: DataFrame, aliases: DataFrame, keys: Sequence[str], *,
                threshold: float = ACCEPT, dims: int = DIMS) -> DataFrame:
    """Probes left unnamed by ``first`` are tried once more against the whole gallery."""
    first = cut_lineage(first)
    rest = probes.join(first.select(*keys), list(keys), "left_anti")
    again = top_match(rest, gallery, aliases, keys, threshold=threshold, dims=dims)
    named = first.select(*keys, "name", "score").unionByName(again)
    return (probes.select(*keys).distinct().join(named, list(keys), "left")
            .select(*keys, F.coalesce("name", F.lit("Speaker")).alias("name"), F.coalesce("score", F.lit(0.0)).alias("score")))


def alias_table(speakers: DataFrame) -> DataFrame:
    """alias → canonical name: the name, and the name with address or voice suffix."""
    rows = speakers.select(text.filled("name").alias("name"), text.filled("email").alias("email")).where("name is not null")
    suffix = F.lit(labels.VOICE_SUFFIX)
    mail = F.when(F.col("email") != labels.NO_EMAIL, F.col("email"))
    made = F.array_compact(F.array(
        F.struct(F.lit(0).alias("prio"), F.col("name").alias("alias")),
        F.struct(F.lit(1).alias("prio"), F.concat("name", suffix).alias("alias")),
        F.when(mail.isNotNull(), F.struct(F.lit(1).alias("prio"), F.concat("name", F.lit(" - "), mail, suffix).alias("alias"))),
        F.when(mail.isNotNull(), F.struct(F.lit(1).alias("prio"), F.concat("name", F.lit(" - "), mail).alias("alias")))))
    each = rows.select("name", F.explode(made).alias("a")).select("name", "a.*")
    return each.groupBy("alias").agg(F.max_by("name", F.struct("prio", "name")).alias("canonical"))


def normalize_names(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Add ``canonical``: the alias hit of the icon-free text, else of the text without voice suffixes, else that text."""
    a1 = aliases.select(F.col("alias").alias("_t"), F.col("canonical").alias("_direct"))
    a2 = aliases.select(F.col("alias").alias("_s"), F.col("canonical").alias("_peeled"))
    base = rows.withColumn("_t", labels.strip_icon(column))
    base = base.withColumn("_s", labels.without_voice_suffix("_t"))
    return (base.join(a1, "_t", "left").join(a2, "_s", "left")
            .withColumn("canonical", F.coalesce("_direct", "_peeled", "_s")).drop("_t", "_s", "_direct", "_peeled"))


def mean_vector(rows: DataFrame, keys: Sequence[str], dims: int = DIMS, column: str = "embedding",
                normalize: bool = True) -> DataFrame:
    """Mean of each group's vectors of ``dims`` entries, as a unit vector, with the group size.

    A group leaves each batch of rows as one vector sum, and few of those meet in a task.
    """
    keys = list(keys)
    rows = rows.where(F.size(column) == dims).select(*keys, F.col(column).cast("array<double>").alias("_v"))
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("n", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def listed(m):
        return pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), dims).cast(pa.list_(pa.float64()))

    def add_up(batches):
        for b in batches:
            groups: dict[tuple, int] = {}
            code = np.fromiter((groups.setdefault(k, len(groups)) for k in zip(*(b.column(c).to_pylist() for c in keys))), dtype=np.int64, count=b.num_rows)
            first = np.unique(code, return_index=True)[1]
            order = np.argsort(code, kind="stable")
            m = np.nan_to_num(np.asarray(b.column("_v").flatten(), dtype=np.float64).reshape(-1, dims))
            sums = np.add.reduceat(m[order], np.searchsorted(code[order], np.arange(len(groups)))) if len(groups) else np.zeros((0, dims))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(first)) for c in keys), pa.array(np.bincount(code, minlength=len(groups))), listed(sums)],
                                             names=[*keys, "n", "embedding"])

    def finish(key, table):
        n = int(np.asarray(table.column("n")).sum())
        mean = np.asarray(table.column("embedding").combine_chunks().flatten()).reshape(-1, dims).sum(axis=0) / n
        size = np.sqrt((mean * mean).sum())
        out = mean / size if normalize and size > 0 else mean
        return pa.table({**{k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key)}, "n": pa.array([n]), "embedding": listed(out)})

    return rows.mapInArrow(add_up, schema).groupBy(*keys).applyInArrow(finish, schema)


def robust_centroid(rows: DataFrame, keys: Sequence[str], id: str = "idx", dims: int = DIMS,
                    block_rows: int = 2048) -> DataFrame:
    """Centroid of a group after dropping vectors far from its medoid.

    The medoid has the highest median similarity to its group (of equals the
    smallest id); vectors below max(0.45, lower quartile) of similarity to it
    are dropped. A group of at most ``block_rows`` vectors is worked out in one
    step; larger ones in blocks, with the same result.
    """
    keys = list(keys)
    rows = rows.where(F.size("embedding") == dims).select(*keys, F.col(id).alias("_id"), "embedding")
    sizes = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    large = sizes.where(F.col("n") > block_rows)
    if large.isEmpty():
        return _centroids_small(rows, keys)
    small = _centroids_small(rows.join(large.select(*keys), keys, "left_anti"), keys)
    return small.unionByName(_centroids_large(rows, large, keys, dims, block_rows))


def _centroids_small(rows: DataFrame, keys: list[str]) -> DataFrame:
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("kept", T.LongType()),
                                                            T.StructField("n", T.LongType())])

    def kernel(key, table):
        ids, m = table.column("_id").to_pylist(), blocks.matrix(table)
        medians = np.round(np.concatenate([np.median(s, axis=1) for _, s in blocks.strips(m, m)]), 12)
        medoid = min(np.flatnonzero(medians == medians.max()), key=lambda i: ids[i])
        near = m @ m[medoid]
        ok = near >= max(CENTROID_FLOOR, np.quantile(near, CENTROID_PERCENTILE))
        if ok.sum() < min(2, len(m)):
            ok[:] = True
        mean = m[ok].mean(axis=0)
        size = np.sqrt((mean * mean).sum())
        return pa.table({**{k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key)},
                         "embedding": pa.array([mean / size if size > 0 else mean], pa.list_(pa.float64())), "kept": pa.array([int(ok.sum())]), "n": pa.array([len(m)])})

    return rows.groupBy(*keys).applyInArrow(kernel, schema)


def _centroids_large(rows: DataFrame, sizes: DataFrame, keys: list[str], dims: int, block_rows: int) -> DataFrame:
    # ids may repeat, so rows are told apart by a number
    rows = cut_lineage(rows.join(sizes, keys).withColumn("_row", F.monotonically_increasing_id()))
    medoid = cut_lineage(_medoids_large(rows, keys, dims, block_rows))
    near = (rows.join(medoid.join(rows.select(F.col("_row").alias("_m"), vectors.unit("embedding").alias("_mv")), "_m"), keys)
            .withColumn("_u", vectors.unit("embedding")).withColumn("_s", vectors.dot("_u", "_mv")))
    cut = _order_statistic(near.select(*keys, "_row", "_s", "n"), keys, CENTROID_PERCENTILE).withColumnRenamed("value", "_q")
    judged = near.join(cut, keys).withColumn("_ok", F.col("_s") >= F.greatest(F.lit(CENTROID_FLOOR), F.col("_q")))
    enough = judged.groupBy(*keys).agg(F.count_if("_ok").alias("_kept"))
    kept = judged.join(enough, keys).where(F.col("_ok") | (F.col("_kept") < F.least(F.lit(2), F.col("n"))))
    centre = mean_vector(kept.select(*keys, "_u"), keys, dims, "_u").withColumnRenamed("n", "kept")
    return centre.join(sizes, keys).select(*keys, "embedding", "kept", "n")


def _candidates(rows: DataFrame, keys: list[str], dims: int, block_rows: int) -> DataFrame:
    """The rows of each group whose median similarity may be the highest one.

    The median of one row, the nearest to the group's mean, is a bound. One pass over the cells counts for each row the similarities under
    it, one number a cell; a row with more than half of them under it has a lower median and is left out. The bound decides how
    many rows stay, never which is the medoid.
    """
    units = rows.select(*keys, "_row", "n", vectors.unit("embedding").alias("_u"))
    centre = mean_vector(units, keys, dims, "_u").select(*keys, F.col("embedding").alias("_c"))
    at = F.struct(vectors.dot("_u", "_c").alias("s"), "_row")
    first = (units.join(centre, keys).withColumn("_at", at).where(F.col("_at.s").isNotNull() & ~F.isnan("_at.s"))
             .groupBy(*keys).agg(F.max_by("_u", "_at").alias("_f")))
    near = cut_lineage(units.join(first, keys).select(*keys, "_row", "n", vectors.dot("_u", "_f").alias("_s")))
    bound = cut_lineage(_order_statistic(near, keys, 0.5).select(*keys, (F.col("value") - SLACK).alias("bound")))
    asked = rows.select(*keys, "_row", "n", "embedding").join(bound, keys, "left")

    def below(key, lt, rt):
        m, r = blocks.matrix(lt), blocks.matrix(rt)
        under = np.zeros(len(m), dtype=np.int64)
        if len(m) and len(r):
            bound = np.asarray(lt.column("bound"), dtype=np.float64)[:, None]
            for off, sims in blocks.strips(m, r):
                under[off:off + len(sims)] = len(r) - np.count_nonzero(sims >= bound[off:off + len(sims)], axis=1)
        return pa.table({"_row": lt.column("_row"), "under": pa.array(under)})

    counted = blocks.cells(asked, rows.select(*keys, "_row", "embedding"), keys, "_row", "_row", below, "_row long, under long", 4 * block_rows)
    under = counted.groupBy("_row").agg(F.sum("under").alias("under"))
    return asked.join(under, "_row").where((2 * F.col("under") <= F.col("n")) | F.col("bound").isNull() | F.isnan("bound")).drop("under", "bound")


def _medoids_large(rows: DataFrame, keys: list[str], dims: int, block_rows: int, bins: int = 4096) -> DataFrame:
    """Medoid row of each group of many blocks: exact medians of the candidates from two passes over the cells.

    Pass one counts similarities per bin and finds the bin of each median; pass
    two returns only the similarities inside that bin.
    """
    head = [rows.schema[k] for k in keys] + [T.StructField("_row", T.LongType())]
    to_bin = lambda s: np.clip(((s + 1.0) * (bins / 2.0)).astype(np.int64), 0, bins - 1)

    def keyed(key, at, table, **cols):
        base = {k: pa.array([v.as_py()] * len(at), v.type) for k, v in zip(keys, key)}
        return pa.table({**base, "_row": table.column("_row").take(pa.array(at)).combine_chunks(), **cols})

    def count(key, lt, rt):
        at, bn, n = [], [], []
        m, r = blocks.matrix(lt), blocks.matrix(rt)
        for off, sims in blocks.strips(m, r) if len(m) and len(r) else ():
            for i, s in enumerate(sims):
                b, c = np.unique(to_bin(s), return_counts=True)
                at.append(np.full(len(b), off + i)); bn.append(b); n.append(c)
        cat = lambda x: np.concatenate(x) if x else np.array([], dtype=np.int64)
        return keyed(key, cat(at), lt, bin=pa.array(cat(bn), pa.int64()), c=pa.array(cat(n), pa.int64()))

    side = rows.select(*keys, "_row", "embedding")
    asked = cut_lineage(_candidates(rows, keys, dims, block_rows))
    counted = blocks.cells(asked.drop("n"), side, keys, "_row", "_row", count,
                           T.StructType(head + [T.StructField("bin", T.LongType()), T.StructField("c", T.LongType())]), block_rows)
    per = counted.groupBy(*keys, "_row", "bin").agg(F.sum("c").alias("c"))
    run = W.partitionBy(*keys, "_row").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    sizes = asked.select(*keys, "_row", "n")
    spot = per.withColumn("upto", F.sum("c").over(run)).join(sizes, [*keys, "_row"])
    lo_rank, hi_rank = F.floor((F.col("n") - 1) / 2) + 1, F.floor(F.col("n") / 2) + 1
    holds = lambda r: (F.col("upto") >= r) & (F.col("upto") - F.col("c") < r)
    want = (spot.where(holds(lo_rank) | holds(hi_rank)).groupBy(*keys, "_row")
            .agg(F.min("bin").alias("b_lo"), F.max("bin").alias("b_hi"), F.min(F.col("upto") - F.col("c")).alias("below")))

    def gather(key, lt, rt):
        at, val = [], []
        m, r = blocks.matrix(lt), blocks.matrix(rt)
        lo, hi = np.asarray(lt.column("b_lo")), np.asarray(lt.column("b_hi"))
        for off, sims in blocks.strips(m, r) if len(m) and len(r) else ():
            for i, s in enumerate(sims):
                b = to_bin(s)
                v = s[(b >= lo[off + i]) & (b <= hi[off + i])]
                at.append(np.full(len(v), off + i)); val.append(v)
        cat = lambda x, t: np.concatenate(x) if x else np.array([], dtype=t)
        return keyed(key, cat(at, np.int64), lt, v=pa.array(cat(val, np.float64), pa.float64()))

    target = asked.drop("n").join(want.select(*keys, "_row", "b_lo", "b_hi"), [*keys, "_row"])
    values = blocks.cells(target, side, keys, "_row", "_row", gather, T.StructType(head + [T.StructField("v", T.DoubleType())]), block_rows)
    order = W.partitionBy(*keys, "_row").orderBy("v")
    placed = (values.withColumn("r", F.row_number().over(order)).join(want.select(*keys, "_row", "below"), [*keys, "_row"])
              .join(sizes, [*keys, "_row"]).withColumn("r", F.col("r") + F.col("below")))
    median = (placed.where((F.col("r") == lo_rank) | (F.col("r") == hi_rank)).groupBy(*keys, "_row").agg(F.avg("v").alias("med")))
    best = F.min(F.struct((-F.round("med", 12)).alias("m"), "_id", "_row"))
    return median.join(rows.select("_row", "_id"), "_row").groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b._row").alias("_m"))


def _order_statistic(rows: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Exact linear quantile of ``_s`` per group, by position instead of by gathering the group."""
    placed = ordered.place_rows(rows, keys, "_s", ties=("_row",), name="_r")
    at = F.lit(q) * (F.col("n") - 1)
    lo = F.floor(at)
    picked = placed.where((F.col("_r") == lo) | (F.col("_r") == lo + 1))
    low, high = F.min("_s"), F.max("_s")
    frac = F.first(at - lo)
    return picked.groupBy(*keys).agg((low + (high - low) * frac).alias("value"))


def cleanest_run(windows: DataFrame, keys: Sequence[str] = ("meeting", "idx"), dims: int = DIMS,
                 accept: float = 0.50, max_windows: int | None = None) -> DataFrame:
    """Most self-consistent stretch of sliding windows of a turn, whole or of ``max_windows`` windows, and its mean vector.

    The mean similarity of a window to the others follows from the group's
    vector sum, so the medoid needs no pairs.
    """
    keys = list(keys)
    rows = windows.where(F.size("embedding") == dims).withColumn("_u", vectors.unit("embedding"))
    total = mean_vector(rows, keys, dims, "_u", normalize=False).withColumnRenamed("embedding", "_mean")
    rows = rows.join(total, keys)
    others = F.greatest(F.lit(1), F.col("n") - 1)
    rows = rows.withColumn("_score", (vectors.dot("_u", "_mean") * F.col("n") - vectors.dot("_u", "_u")) / others)
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(F.col("w_idx").alias("i"), F.col("_u").alias("u")),
                                            F.struct(F.round("_score", 12).alias("s"), (-F.col("w_idx")).alias("i"))).alias("_m"))
    kept = rows.join(best, keys).where((vectors.dot("_u", "_m.u") >= accept) | (F.col("w_idx") == F.col("_m.i")))
    # The choice of the run works on scores alone; vectors come back at the end.
    kept = cut_lineage(kept.select(*keys, "w_idx", "start", "end", "n", "_score", F.col("_m.i").alias("_mid")))
    run = ordered.runs(kept, keys, "w_idx", ["w_idx"], lambda p, r: p["w_idx"] + 1 != r["w_idx"])
    longest = run.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("len")).groupBy(*keys).agg(
        F.max_by("run", F.struct("len", (-F.col("run")).alias("i"))).alias("_r"))
    chosen = run.join(longest, keys).where(F.col("run") == F.col("_r"))
    chosen = cut_lineage(ordered.scan(chosen, keys, "w_idx", sums={"_cum": F.col("_score")}))
    cut = chosen
    if max_windows is not None:
        cut = _best_stretch(chosen, keys, max_windows)
    span = cut.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("n").alias("windows"))
    used = rows.select(*keys, "w_idx", "_u").join(cut.select(*keys, "w_idx"), [*keys, "w_idx"])
    return span.join(mean_vector(used, keys, dims, "_u").withColumnRenamed("n", "kept"), keys)


def _best_stretch(chosen: DataFrame, keys: list[str], max_windows: int) -> DataFrame:
    # Stretch starts: sums of max_windows scores by position arithmetic on the running sum.
    ends = chosen.select(*keys, (F.col("w_idx") - (max_windows - 1)).alias("w_idx"), F.col("_cum").alias("_end"))
    starts = (chosen.join(ends, [*keys, "w_idx"]).withColumn("_sum", F.round(F.col("_end") - F.col("_cum") + F.col("_score"), 12))
              .withColumn("_holds", F.col("_mid").between(F.col("w_idx"), F.col("w_idx") + max_windows - 1))
              .groupBy(*keys).agg(F.max_by("w_idx", F.struct("_holds", "_sum", (-F.col("w_idx")).alias("i"))).alias("_from")))
    return chosen.join(starts, keys, "left").where(
        F.col("_from").isNull() | F.col("w_idx").between(F.col("_from"), F.col("_from") + max_windows - 1))


def purify(segments: DataFrame, gallery: DataFrame, keys: Sequence[str] = ("meeting", "speaker_id"), dims: int = DIMS,
           share: float = PURIFY_SHARE) -> DataFrame:
    """Segments of a speaker group without those that clearly belong to somebody else."""
    keys = list(keys)
    usable = segments.where((F.col("end") - F.col("start") >= PURIFY_MIN_SEC) & (F.size("embedding") == dims))
    names = rank_names(usable, gallery, [*keys, "idx"], k=1, floor=PURIFY_SCORE, dims=dims).select(*keys, "idx", F.col("name").alias("_vote"))
    size = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    tally = names.groupBy(*keys, "_vote").agg(F.count(F.lit(1)).alias("_c"), F.min("idx").alias("_first"))
    major = (tally.groupBy(*keys).agg(F.max_by(F.struct("_vote", "_c"), F.struct("_c", (-F.col("_first")).alias("f"))).alias("_w"))
             .join(size, keys).where((F.col("_n") >= PURIFY_MIN_SEGMENTS) & (F.col("_w._c") >= F.col("_n") * share))
             .select(*keys, F.col("_w._vote").alias("_major")))
    dissent = names.join(major, keys).where(F.col("_vote") != F.col("_major")).select(*keys, "idx")
    return segments.join(dissent, [*keys, "idx"], "left_anti")


def contaminated(centroids: DataFrame, group: str = "meeting", id: str = "speaker_id", limit: float = CONTAMINATION,
                 dims: int = DIMS) -> DataFrame:
    """Meetings in which two speakers have nearly the same centroid, with the closest pair's similarity."""
    side = centroids.where(F.size("embedding") == dims).select(group, F.col(id).alias("_id"), "embedding")

    def kernel(key, lt, rt):
        worst = -2.0
        a, b = lt.column("_id").to_pylist(), np.array(rt.column("_id").to_pylist(), dtype=object)
        if a and len(b):
            for off, sims in blocks.strips(blocks.matrix(lt), blocks.matrix(rt)):
                for i, s in enumerate(sims):
                    other = s[b != a[off + i]]
                    worst = max(worst, float(other.max())) if len(other) else worst
        return pa.table({group: pa.array([key[0].as_py()], key[0].type), "closest": pa.array([worst], pa.float64())})

    schema = T.StructType([side.schema[group], T.StructField("closest", T.DoubleType())])
    each = blocks.cells(side, side, [group], "_id", "_id", kernel, schema)
    return each.groupBy(group).agg(F.max("closest").alias("closest")).where(F.col("closest") >= limit)


def attach_group_vectors(segments: DataFrame, groups: DataFrame, keys: Sequence[str] = ("meeting", "speaker_id")) -> DataFrame:
    """Give every segment the unit vector of its speaker group; others keep their own."""
    unit = groups.select(*keys, vectors.unit("embedding").alias("_g"))
    own = F.col("embedding") if "embedding" in segments.columns else F.lit(None).cast("array<double>")
    return segments.withColumn("_own", own.cast("array<double>")).drop("embedding").join(unit, list(keys), "left") \
        .withColumn("embedding", F.coalesce("_g", "_own")).drop("_g", "_own")


def needs_vector(min_sec: float = 0.8) -> Column:
    """Segment without a vector that is long enough to get one."""
    return F.col("embedding").isNull() & (F.coalesce("end", "start") - F.col("start") >= min_sec)


def vector_backlog(segments: DataFrame, min_sec: float = 0.8) -> DataFrame:
    """Per meeting: turns to embed, and turns skipped because they are short or done."""
    need = needs_vector(min_sec)
    return segments.groupBy("meeting").agg(F.count_if(need).alias("to_build"), F.count_if(~need).alias("skipped"))


def strict_unknown(segments: DataFrame, gallery: DataFrame) -> DataFrame:
    """Flag labels that are unnamed or not in the gallery."""
    known = gallery.select(F.col("name").alias("_n")).distinct()
    return (segments.withColumn("_t", text.strip(F.coalesce("label", F.lit("")))).join(known, F.col("_t") == F.col("_n"), "left")
            .withColumn("unassigned", labels.is_unknown("_t") | F.col("_n").isNull()).drop("_t", "_n"))
