"""Compression of vectors to short codes by exact integer nearest-entry search.

Components become whole numbers, a vector is cut into equal parts, and each part position has a codebook of a few entries.
Distances need the products of all parts with all entries. Float matrix products are fast but exact only below 2^53, so
whole numbers are split into limbs small enough for every sum of products to stay below; each pair of limbs is one BLAS product,
and the results are put together again in 64-bit integers. Equal distances thus are equal, and the first one wins.

Spark deals the vectors; a round of training sends the codebooks (parts x entries x width numbers, whatever the input) to the
tasks, and a task returns one row of sums for each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .registry import query, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096.0


def _limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """Parts of whole numbers, lowest first, as floats: a = sum of limb[i] * 2^(bits * i); only the last one is signed."""
    out, rest = [], a
    while len(rest) and (rest.max(initial=0) >= 1 << bits or rest.min(initial=0) < -(1 << bits)):
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return out + [rest.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact ``a @ b`` of 64-bit integers [..., n, d] and [..., d, k]; the true results must fit 64 bits."""
    d = a.shape[-1]
    bits = (53 - max(0, d - 1).bit_length()) // 2  # d * 2^bits * 2^bits <= 2^53
    out = np.zeros(np.broadcast_shapes(a.shape[:-2], b.shape[:-2]) + (a.shape[-2], b.shape[-1]), dtype=np.int64)
    right = _limbs(b, bits)
    for i, x in enumerate(_limbs(a, bits)):
        for j, y in enumerate(right):
            if bits * (i + j) < 64:
                out += np.matmul(x, y).astype(np.int64) << bits * (i + j)
    return out


def nearest_entries(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For parts [part, n, d] the index of the nearest entry of books [part, entry, d] and the squared distance, both [part, n]."""
    score = (books * books).sum(axis=2)[:, None, :] - 2 * exact_products(parts, books.transpose(0, 2, 1))
    code = score.argmin(axis=2)  # the first of equal ones
    return code, np.take_along_axis(score, code[:, :, None], 2)[:, :, 0] + (parts * parts).sum(axis=2)


def largest_component(dims: int) -> int:
    """Whole components up to this size keep all squared distances of vectors of ``dims`` components within 64 bits."""
    return isqrt((2 ** 63 - 1) // max(1, dims)) // 2


def _kept(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose vector takes part, their lengths, and all their whole components one behind the other."""
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    good = sizes > 0
    good[owner[~np.isfinite(flat)]] = False
    whole = np.floor(scale * flat[good[owner]])
    sizes = sizes[good]
    top = largest_component(int(sizes.max(initial=1)))
    if len(whole) and np.abs(whole).max() > top:
        raise ValueError(f"a component times {scale} is beyond {top}: squared distances would not fit 64 bits")
    return np.flatnonzero(good), sizes, whole.astype(np.int64)


def _parts(sizes: np.ndarray, flat: np.ndarray, parts: int, width: int) -> np.ndarray:
    """[part, n, width]; shorter vectors are filled with zeros."""
    n, dims = len(sizes), parts * width
    if (sizes == dims).all():
        square = flat.reshape(n, dims)
    else:
        square = np.zeros((n, dims), dtype=np.int64)
        square[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return np.ascontiguousarray(square.reshape(n, parts, width).transpose(1, 0, 2))


def _sums(parts: np.ndarray, code: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """How many parts each entry has, [part, entry], and their exact sums, [part, entry, d]."""
    one_hot = (code[:, None, :] == np.arange(entries)[None, :, None]).astype(np.int64)
    return one_hot.sum(axis=2), exact_products(one_hot, parts)


def first_vectors(vectors: DataFrame, entries: int, scale: float) -> tuple[list[list[int]], int]:
    """The whole components of the kept vectors of the smallest ids (ascending; of a repeated id the smallest vector), and the largest length.

    A task keeps its own smallest ids only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[int]] = {}
        dims = 0
        for b in batches:
            rows, sizes, flat = _kept(b.column(1), scale)
            if not len(rows):
                continue
            dims = max(dims, int(sizes.max()))
            ends = np.cumsum(sizes)
            ids = b.column(0).take(pa.array(rows))
            known = np.flatnonzero(np.asarray(ids.is_valid()))
            numbers = np.asarray(ids.fill_null(0), dtype=np.int64)
            smallest = np.unique(numbers[known])[:entries]
            for i in known[np.isin(numbers[known], smallest)]:
                v, key = flat[ends[i] - sizes[i]:ends[i]].tolist(), int(numbers[i])
                best[key] = min(best.get(key, v), v)
            best = {k: best[k] for k in sorted(best)[:entries]}
        if dims:
            keys = list(best) or [None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([best.get(k) for k in keys], pa.list_(pa.int64())), pa.array([dims] * len(keys), pa.int32())],
                names=["vec_id", "v", "dims"])

    few = cut_lineage(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, v array<long>, dims int"))
    first = few.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()
    return [r["v"] for r in first], few.agg(F.max("dims")).first()[0] or 0


def train_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> np.ndarray:
    """Whole-number codebooks [part, entry, width] of the column ``embedding``.

    They start as the parts of the vectors with the smallest ids (fewer vectors give fewer entries). Each round assigns all parts to
    their nearest entry, the lower index at equal distance, and replaces an entry by the floor of its parts' mean; unused
    entries stay. Rounds that would change nothing are left out. The input is read once for each round; write one that is costly
    to compute to a table first.
    """
    first, dims = first_vectors(vectors, entries, scale)
    width = -(-dims // parts)
    flat = np.array([x for v in first for x in v], dtype=np.int64)
    books = _parts(np.array([len(v) for v in first], dtype=np.int64), flat, parts, width)
    if not len(first):
        return books

    def round_of(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = books.shape[1]
            n, s = np.zeros((parts, k), dtype=np.int64), np.zeros((parts, k, width), dtype=np.int64)
            for b in batches:
                rows, sizes, flat = _kept(b.column(0), scale)
                if len(rows):
                    p = _parts(sizes, flat, parts, width)
                    more, sums = _sums(p, nearest_entries(p, books)[0], k)
                    n, s = n + more, s + sums
            part, entry = np.nonzero(n)
            if len(part):
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]),
                                                  *(pa.array(s[part, entry, i]) for i in range(width))],
                                                 names=["part", "entry", "n", *(f"s{i}" for i in range(width))])
        return run

    schema = "part int, entry int, n long" + "".join(f", s{i} long" for i in range(width))
    total = [F.sum("n").alias("n"), *(F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(width))]
    for _ in range(rounds):
        got = vectors.select("embedding").mapInArrow(round_of(books), schema).groupBy("part", "entry").agg(*total).collect()  # parts x entries rows
        new = books.copy()
        for r in got:
            new[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
        if (new == books).all():
            break
        books = new
    return books


def encode_vectors(vectors: DataFrame, books: np.ndarray, scale: float = SCALE) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (index of the entry of each part) and ``error`` (squared distances, summed) of every vector that takes part.

    A vector that is null, empty, or holds a null or non-finite component takes none. A shorter one counts as filled up with zeros.
    """
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, sizes, flat = _kept(b.column(2), scale)
            if not len(rows):
                continue
            code, far = nearest_entries(_parts(sizes, flat, parts, width), books)
            at = pa.array(rows)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * parts, pa.int32()), pa.array(code.T.reshape(-1), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), codes, pa.array(far.sum(axis=0))], names=["vec_id", "label", "code", "error"])

    three = vectors.select("vec_id", "label", "embedding")
    kinds = {f.name: f.dataType.simpleString() for f in three.schema}
    return three.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code array<int>, error long")


def decode_vectors(codes: DataFrame, books: np.ndarray, scale: float = SCALE) -> DataFrame:
    """The columns of ``codes`` and ``approximation``: the middle of the cells of the entries that ``code`` names."""
    rows = [(p, [[(float(x) + 0.5) / scale for x in e] for e in books[p].tolist()]) for p in range(len(books))]
    entries = F.array(*(F.array(*(F.array(*map(F.lit, e)) for e in book)) for _, book in rows))
    pick = F.flatten(F.transform("code", lambda c, i: F.get(F.get(F.col("books"), i), c)))
    return codes.withColumn("books", entries).withColumn("approximation", pick).drop("books")


def with_group_error(coded: DataFrame, salts: int = 32, sent: int = 100_000) -> DataFrame:
    """Add ``label_error``, the errors summed over equal labels; null labels are one group.

    Totals of at most ``sent`` labels are broadcast; more are joined on label and salt, so a label that very many vectors have is spread.
    """
    totals = cut_lineage(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own"))
    if totals.count() <= sent:
        return coded.join(F.broadcast(totals), coded["label"].eqNullSafe(totals["own"])).drop("own")
    left = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)))
    right = totals.withColumn("own_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = left["label"].eqNullSafe(right["own"]) & (left["salt"] == right["own_salt"])
    return left.join(right, same).drop("own", "salt", "own_salt")


def books_digest(books: np.ndarray) -> str:
    """Hex SHA-256 of all components in order, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def _sql(width: int = 8) -> str:
    """The rounds written out, for vectors of PARTS x width components."""
    cs = [f"c{i}" for i in range(width)]
    far = " + ".join(f"(p.{c} - b.{c}) * (p.{c} - b.{c})" for c in cs)
    mean = ", ".join(f"coalesce((g.{c} - ((g.{c} % g.n) + g.n) % g.n) // g.n, b.{c})::bigint as {c}" for c in cs)
    out = [f"""v as materialized (select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
        where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
           f"p as materialized (select rid, t.part, {', '.join(f'v[t.part * {width} + {i + 1}] as {c}' for i, c in enumerate(cs))} from v, range({PARTS}) t(part))",
           "one as (select rid, vec_id from v where vec_id is not null qualify row_number() over (partition by vec_id order by v) = 1)",
           f"f as (select rid, row_number() over (order by vec_id) - 1 as entry from one qualify entry < {ENTRIES})",
           f"b0 as materialized (select p.part, f.entry, {', '.join('p.' + c for c in cs)} from f join p using (rid))"]
    for r in range(ROUNDS + 1):
        out.append(f"a{r} as materialized (select p.rid, p.part, min(({far}) * {ENTRIES} + b.entry) as m from p join b{r} b on p.part = b.part group by all)")
        if r < ROUNDS:
            out.append(f"""b{r + 1} as materialized (select b.part, b.entry, {mean} from b{r} b left join
                (select part, m % {ENTRIES} as entry, count(*) as n, {', '.join(f'sum({c}) as {c}' for c in cs)} from a{r} join p using (rid, part) group by all) g using (part, entry))""")
    last = f"""e as (select rid, string_agg(printf('%02x', m % {ENTRIES}), '' order by part) as code, sum(m // {ENTRIES})::bigint as error from a{ROUNDS} group by rid)
        select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
        (select sha256(string_agg(concat_ws(',', {', '.join(cs)}), ',' order by part, entry)) from b{ROUNDS}) as codebooks_sha256 from v join e using (rid)"""
    return "with " + ",\n".join([*out, last])


@query("op11_limb_split_codes", _sql())
def coded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = train_codebooks(vectors)
    coded = with_group_error(encode_vectors(vectors, books))
    digits = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return coded.select("vec_id", digits.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
