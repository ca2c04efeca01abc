"""Exact top-k inner products by best-first search in M-trees.

Vectors are dealt to shards of bounded size by their id. Each shard is bulk-loaded into an M-tree: pages of vectors under
routing nodes that store their centre, covering radius, largest norm and distance to the parent. A block of queries walks a
tree together, each query always opening its own most promising node. For x in a node, |q - x| is at least
``max(0, |q - centre| - radius)``, and ``|q - centre|`` at least the difference of the distances of q and of the centre to the
parent, which needs no new distance; so q.x is at most (|q|^2 + norm^2 - bound^2) / 2. A node below a query's k-th score
is never opened for it. Every block of queries meets every shard, in bounded memory; the best of the shards are merged.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .registry import query, table

SHARD = 8192
BLOCK = 2048
PAGE = 128
FANOUT = 12
K = 20


def build_tree(ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of an M-tree over integer vectors. Node 0 is the root; a leaf has rows ``lo:hi`` of the reordered vectors, an inner node children ``lo:hi``."""
    v = vectors.astype(np.float64)
    leaf, lo, hi, centre, radius, norm, up = [], [], [], [], [], [], []
    order: list[np.ndarray] = []
    placed = 0
    norms = np.sqrt((v * v).sum(axis=1))
    todo: list[tuple[int, np.ndarray]] = []

    def add(rows: np.ndarray, middle: np.ndarray, parent: np.ndarray | None) -> None:
        leaf.append(False)
        lo.append(0)
        hi.append(0)
        centre.append(middle)
        radius.append(np.sqrt(((v[rows] - middle) ** 2).sum(axis=1).max()) if len(rows) else 0.0)
        norm.append(norms[rows].max() if len(rows) else 0.0)
        up.append(0.0 if parent is None else float(np.sqrt(((middle - parent) ** 2).sum())))
        todo.append((len(leaf) - 1, rows))

    add(np.arange(len(v)), v.mean(axis=0) if len(v) else np.zeros(v.shape[1]), None)
    while todo:
        node, rows = todo.pop()
        if len(rows) <= PAGE:
            rows = rows[np.argsort(ids[rows], kind="stable")]
            leaf[node], lo[node], hi[node] = True, placed, placed + len(rows)
            order.append(rows)
            placed += len(rows)
            continue
        f = min(FANOUT, -(-len(rows) // PAGE))
        pivots = v[rows[np.linspace(0, len(rows) - 1, f).astype(int)]]
        far = (pivots ** 2).sum(axis=1) - 2 * v[rows] @ pivots.T
        own = far.argmin(axis=1)
        if np.bincount(own, minlength=f).max() == len(rows):  # all alike: cut by position
            own = np.arange(len(rows)) * f // len(rows)
        lo[node] = len(leaf)
        for p in range(f):
            part = rows[own == p]
            if len(part):
                add(part, v[part].mean(axis=0), centre[node])
        hi[node] = len(leaf)
    at = np.concatenate(order) if order else np.zeros(0, int)
    small = np.min_scalar_type(-int(np.abs(vectors).max(initial=1)) - 1)
    middle = np.array(centre)
    owner = np.zeros(len(at), int)
    for n in range(len(leaf)):
        if leaf[n]:
            owner[lo[n]:hi[n]] = n
    entry = np.sqrt(((v[at] - middle[owner]) ** 2).sum(axis=1)) if len(at) else np.zeros(0)
    return {"ids": ids[at], "vectors": vectors[at].astype(small), "entry": entry, "leaf": np.array(leaf), "lo": np.array(lo), "hi": np.array(hi),
            "centre": middle, "radius": np.array(radius), "norm": np.array(norm), "up": np.array(up)}


def search_tree(tree: dict[str, np.ndarray], q_ids: np.ndarray, queries: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, id and score of the k best vectors of the tree for each query (those of its own id left out)."""
    big = int(np.abs(queries).max(initial=0)) * int(np.abs(tree["vectors"].astype(np.int64)).max(initial=0)) * max(1, queries.shape[1])
    kind = np.float64 if big < 2 ** 53 else np.int64  # floats are exact up to there
    vec, q = tree["vectors"].astype(kind), queries.astype(kind)
    qf = queries.astype(np.float64)
    v_norm = (tree["vectors"].astype(np.float64) ** 2).sum(axis=1)
    n, nodes = len(q), len(tree["leaf"])
    q_norm = (qf ** 2).sum(axis=1)
    none = np.iinfo(np.int64).max
    worst = -np.inf if kind is np.float64 else np.iinfo(np.int64).min + 1
    top, top_ids = np.full((n, k), worst, dtype=kind), np.full((n, k), none, dtype=np.int64)
    bound = np.full((n, nodes), -np.inf)
    dist = np.full((n, nodes), np.nan)
    slack = 1e-6 * (1 + float(q_norm.max(initial=0)) + float(v_norm.max(initial=0)))

    def measure(rows: np.ndarray, node: int) -> None:
        d = np.sqrt(np.maximum(0, ((qf[rows] - tree["centre"][node]) ** 2).sum(axis=1)))
        dist[rows, node] = d
        least = np.maximum(0, d - tree["radius"][node])
        bound[rows, node] = (q_norm[rows] + tree["norm"][node] ** 2 - least ** 2) / 2 + slack

    measure(np.arange(n), 0)
    active = np.arange(n)
    while len(active):
        best = bound[active].argmax(axis=1)
        alive = bound[active, best] >= top[active, k - 1]
        alive &= bound[active, best] > -np.inf
        active, best = active[alive], best[alive]
        by = np.argsort(best, kind="stable")
        for rows in np.split(active[by], np.flatnonzero(np.diff(best[by])) + 1) if len(active) else []:
            node = int(bound[rows[0]].argmax())
            bound[rows, node] = -np.inf
            lo, hi = tree["lo"][node], tree["hi"][node]
            limit = top[rows, k - 1].astype(np.float64)
            if not tree["leaf"][node]:
                for child in range(lo, hi):  # by the distance to the parent first, measured only where that doesn't decide
                    least = np.maximum(0, np.abs(dist[rows, node] - tree["up"][child]) - tree["radius"][child])
                    may = (q_norm[rows] + tree["norm"][child] ** 2 - least ** 2) / 2 + slack >= limit
                    if may.any():
                        measure(rows[may], child)
                continue
            gap = dist[rows, node][:, None] - tree["entry"][None, lo:hi]
            may = (q_norm[rows][:, None] + v_norm[None, lo:hi] - gap ** 2) / 2 + slack >= limit[:, None]
            cols = np.flatnonzero(may.any(axis=0)) + lo
            if not len(cols):
                continue
            score, ids = q[rows] @ vec[cols].T, np.broadcast_to(tree["ids"][cols], (len(rows), len(cols)))
            score = np.where(ids == q_ids[rows][:, None], worst, score)
            useful = (score >= top[rows, k - 1][:, None]).any(axis=0)
            score, ids = np.hstack([top[rows], score[:, useful]]), np.hstack([top_ids[rows], ids[:, useful]])
            first = np.lexsort((ids, -score), axis=-1)[:, :k]
            top[rows], top_ids[rows] = np.take_along_axis(score, first, 1), np.take_along_axis(ids, first, 1)
    row, col = np.nonzero(top > worst)
    return row, top_ids[row, col], top[row, col].astype(np.int64)


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), dtype=np.int64)
    flat, sizes = column.combine_chunks(), None
    sizes = np.asarray(flat.value_lengths().fill_null(0)).astype(int)
    if len(out) and (sizes == dims).all():
        return np.asarray(flat.flatten()).reshape(-1, dims)
    for i, v in enumerate(flat.to_pylist()):
        out[i, :len(v)] = v
    return out


def _load_tree(data: pa.Table) -> pa.Table:
    dims = int(data.column("dims")[0].as_py())
    tree = build_tree(np.asarray(data.column("vec_id").combine_chunks()), _matrix(data.column("v"), dims))
    return pa.table({"shard": data.column("shard").slice(0, 1), "tree": pa.array([_packed(tree)], pa.binary())})


def _load_block(data: pa.Table) -> pa.Table:
    dims = int(data.column("dims")[0].as_py())
    block = {"ids": np.asarray(data.column("vec_id").combine_chunks()), "vectors": _matrix(data.column("v"), dims)}
    return pa.table({"block": data.column("block").slice(0, 1), "queries": pa.array([_packed(block)], pa.binary())})


def exact_top_k(vectors: DataFrame, k: int = K, every: int = 20, scale: float = 64.0) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the k largest inner products of each query vector.

    Components become floor(scale * x). Queries are the vectors whose ``vec_id`` is divisible by ``every``, candidates all
    of another id; equal scores go to the smaller id; a query with fewer candidates gets all of them. A vector that is null,
    empty, of null id, or holds a null or non-finite component takes no part. A shorter vector counts as filled up with zeros.
    A repeated row is a candidate each time, a repeated query is answered once. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad)
    whole = clean.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    n, dims, asked = whole.agg(F.count("*"), F.max(F.size("v")), F.count_if(F.col("vec_id") % every == 0)).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asked // BLOCK))
    whole = whole.withColumn("dims", F.lit(dims or 0))
    trees = (whole.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit("shard")), F.lit(shards)).cast("int"))
             .groupBy("shard").applyInArrow(_load_tree, "shard int, tree binary"))
    mine = (whole.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
            .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int"))
            .groupBy("block").applyInArrow(_load_block, "block int, queries binary"))
    pairs = mine.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(trees, "shard").select("tree", "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, q in zip(b.column(0), b.column(1)):
                tree, block = (dict(np.load(io.BytesIO(x.as_py()))) for x in (t, q))
                row, ids, score = search_tree(tree, block["ids"], block["vectors"], k)
                yield pa.RecordBatch.from_arrays([pa.array(block["ids"][row]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op5_mtree_topk", f"""
    with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
               where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
    select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
    qualify rank <= {K}""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))
