"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words: the words under its ones are hashed, those under its zeros are ignored,
so a replaced word spoils only the seeds that look at it. Hashes of the benchmark and of the documents are joined; around
each hit document and item are laid side by side and the best aligned window is measured, replaced words allowed.

What has to be equal is a window of ``need`` words: ``WINDOW``, or all words of a shorter item. Windows of ``WINDOW`` words and more have
the four long masks at every place. Shorter ones have a family of masks that no allowed set of replaced words spoils as a whole: with at
most r replaced words and the window cut into more than r blocks, some masks of the other blocks stay untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .registry import query, table
from .wordhash import mix, slices, word_hashes



def _family(sizes: tuple[int, ...], kept: int) -> tuple[str, ...]:
    """A mask for each choice of ``kept`` blocks of the given sizes: untouched ones remain if ``len(sizes) - kept`` words are replaced."""
    return tuple("".join(("1" if k in chosen else "0") * n for k, n in enumerate(sizes)) for chosen in combinations(range(len(sizes)), kept))


LONG = ("111111", "11011011", "1100110011", "10101101011")
EXACT = ("1", "11", "111")          # windows of 1, 2 and 3 words, none replaced
ONE = _family((1, 1, 1, 1), 3)      # 4 to 7 words, one replaced
TWO = _family((2, 2, 2, 2), 2)      # 8 to 11 words, two replaced; and 16 to 23 words, one half of which has at most two
THREE = _family((3, 3, 2, 2, 2), 2)  # 12 to 15 words, three replaced
MASKS = LONG + EXACT + ONE + TWO + THREE
WINDOW = 24      # words that must lie side by side; an item with fewer counts as a whole
SHARE = 0.75     # of them equal
STRETCH = 2048   # words of a document between the hits of one place
MARGIN = 40      # words kept around hits, beyond a window on either side
LEAST_BITS, MOST_BITS = 16, 26


def _seeds(words: np.ndarray, bounds: np.ndarray, mask_no: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the seed at each word where it fits into one text, and those words."""
    mask = MASKS[mask_no]
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            h += words[k:k + n] * np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF)
    inside = np.ones(n, dtype=bool)
    for b in bounds[1:-1]:  # a text's last words have no room for the mask
        inside[max(0, b - len(mask) + 1):b] = False
    at = np.flatnonzero(inside)
    return mix(h[at], mask_no), at


def _wanted(mask: str, need: np.ndarray, at: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a mask is laid at word ``at`` of an item whose windows have ``need`` words and begin at words 0 to ``last``."""
    if mask in LONG:
        return need >= WINDOW
    if mask in EXACT:
        return (need == len(mask)) & (at <= last)
    if mask in TWO:
        second = at - need // 2
        halves = (need >= 16) & (need < WINDOW) & ((at <= last) | (second >= 0) & (second <= last))
        return (need >= 8) & (need < 12) & (at <= last) | halves
    low = 4 if mask in ONE else 12
    return (need >= low) & (need < low + 4) & (at <= last)


def _item_seeds(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, bounds = word_hashes(b.column(1).to_pylist())
        for m, mask in enumerate(MASKS):
            h, at = _seeds(words, bounds, m)
            row = np.searchsorted(bounds, at, "right") - 1
            own, size = at - bounds[row], np.diff(bounds)[row]
            need = np.minimum(size, window)
            keep = np.flatnonzero(_wanted(mask, need, own, size - need))
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(np.full(len(keep), m, dtype=np.int32)), b.column(0).take(pa.array(row[keep])),
                                              pa.array(own[keep].astype(np.int32))], names=["seed", "mask", "item_no", "item_at"])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, bounds = word_hashes(b.column(1).to_pylist())
        cut = [words[i:j].astype(np.uint32).tobytes() for i, j in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cut, pa.binary())], names=["item_no", "item_words"])


def _filter_bits(seeds: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Two bits for each seed, by its high and by its low bits: at most 2**MOST_BITS bits, gathered as 64-bit words, whatever the benchmark's size.

    About one in a thousand other hashes passes as long as the table isn't at its bound.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(64 * n + 1))))
    place = F.explode(F.array(F.shiftrightunsigned("seed", 64 - bits), F.col("seed").bitwiseAND(F.lit((1 << bits) - 1)))).alias("place")
    rows = (seeds.select(place).select(F.shiftright("place", 6).alias("w"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    words = np.zeros(1 << (bits - 6), dtype=np.int64)
    words[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return np.unpackbits(words.view(np.uint8), bitorder="little"), bits


def find_overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """One row for each document and item that overlap: ``doc_id``, ``text_key`` (xxhash64 of the text), ``item_id``,
    ``first_word`` (in the document, from 0), ``n_words`` and ``n_equal`` of the best window.

    A pair counts if ``window`` words of the document lie beside ``window`` words of the item (all of a shorter item)
    and at least ``share`` of them are equal, words being as in a case-insensitive text without ASCII punctuation.
    With a ``share`` of 0.75 or more every such pair is found whose window has fewer than ``WINDOW`` words, from items of one word on;
    of longer windows those are missed (about one in a hundred at the edge) whose replaced words spoil every seed. Null and empty texts
    and items without words overlap nothing. Repeated rows give one result, items of equal text one each; ties go to the first place;
    other columns are ignored; no documents or no items give no rows.
    """
    spark = docs.sparkSession
    numbered = cut_lineage(items.select(F.coalesce("text", F.lit("")).alias("text")).distinct().select(F.monotonically_increasing_id().alias("item_no"), "text"))
    plain = numbered.select("item_no", "text")
    seeds = cut_lineage(plain.mapInArrow(lambda batches: _item_seeds(batches, window), "seed long, mask int, item_no long, item_at int"))
    by_mask = {r["mask"]: r["n"] for r in seeds.groupBy("mask").agg(F.count("*").alias("n")).collect()}  # at most one row a mask
    seeds, masks = seeds.drop("mask"), sorted(by_mask)
    table_bits, bits = _filter_bits(seeds, sum(by_mask.values()))
    shared = spark.sparkContext.broadcast(table_bits)  # at most 2**MOST_BITS bytes
    shift, low = np.uint64(64 - bits), np.uint64((1 << bits) - 1)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        part, count = TaskContext.get().partitionId(), 0
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, j in slices(texts):
                words, bounds = word_hashes(texts[i:j])
                places, found = [], []
                for m in masks:
                    h, at = _seeds(words, bounds, m)
                    ok = np.flatnonzero(known[h >> shift])
                    ok = ok[known[h[ok] & low] != 0]
                    places.append(at[ok])
                    found.append(h[ok])
                if not any(map(len, places)):
                    continue
                place, seed = np.concatenate(places), np.concatenate(found)
                order = np.argsort(place, kind="stable")
                place, seed = place[order], seed[order]
                row = np.searchsorted(bounds, place, "right") - 1
                cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(place) > MARGIN) | (np.diff(place // STRETCH) != 0)) + 1
                out = []
                for group in np.split(np.arange(len(place)), cut):
                    r, lo = row[group[0]], max(bounds[row[group[0]]], place[group[0]] - window - MARGIN)
                    hi = min(bounds[r + 1], place[group[-1]] + window + MARGIN)
                    out.append((part << 36 | count, i + int(r), int(lo - bounds[r]), words[lo:hi].astype(np.uint32).tobytes(),
                                (place[group] - lo).astype(np.int32).tolist(), seed[group].view(np.int64).tolist()))
                    count += 1
                c = list(zip(*out))
                take = pa.array(c[1], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), b.column(0).take(take), b.column(1).take(take), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary()),
                     pa.array(c[4], pa.list_(pa.int32())), pa.array(c[5], pa.list_(pa.int64()))],
                    names=["place", "doc_id", "text_key", "first", "words", "ats", "seeds"])

    two = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = two.schema["doc_id"].dataType.simpleString()
    places = cut_lineage(two.mapInArrow(hits, f"place long, doc_id {kind}, text_key long, first int, words binary, ats array<int>, seeds array<long>"))
    looked = places.select("place", F.explode(F.arrays_zip("ats", "seeds")).alias("x")).select("place", "x.ats", F.col("x.seeds").alias("seed"))
    # a place's words are joined once for each item, not for each shift
    lines = (looked.join(seeds, "seed").groupBy("place", "item_no").agg(F.array_sort(F.collect_set(F.col("ats") - F.col("item_at"))).alias("shifts")))
    beside = (lines.join(places.select("place", "doc_id", "text_key", "first", "words"), "place")
              .join(plain.mapInArrow(_item_words, "item_no long, item_words binary"), "item_no"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                mine, theirs = (np.frombuffer(b.column(c)[k].as_buffer(), np.uint32) for c in ("words", "item_words"))
                first, need = b.column("first")[k].as_py(), min(window, len(theirs))
                best = None
                for shift in b.column("shifts")[k].values.to_numpy():
                    lo, hi = max(0, -shift), min(len(theirs), len(mine) - shift)
                    if hi - lo < need:
                        continue
                    same = np.concatenate([[0], np.cumsum(mine[lo + shift:hi + shift] == theirs[lo:hi])])
                    inside = same[need:] - same[:-need]
                    at = int(inside.argmax())
                    found = (int(inside[at]), -int(first + lo + shift + at))
                    best = found if best is None else max(best, found)
                if best and best[0] >= share * need:
                    rows.append((k, -best[1], need, best[0]))
            c = list(zip(*rows)) or [()] * 4
            take = pa.array(c[0], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("text_key").take(take), b.column("item_no").take(take),
                                              *(pa.array(x, pa.int64()) for x in c[1:])],
                                             names=["doc_id", "text_key", "item_no", "first_word", "n_words", "n_equal"])

    good = beside.select("doc_id", "text_key", "first", "words", "item_no", "item_words", "shifts").mapInArrow(
        verify, f"doc_id {kind}, text_key long, item_no long, first_word long, n_words long, n_equal long")
    best = good.groupBy("doc_id", "text_key", "item_no").agg(F.max(F.struct("n_equal", (-F.col("first_word")).alias("back"), "n_words")).alias("b"))
    ids = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().join(numbered, "text").select("item_no", "item_id")
    return (best.join(ids, "item_no")
            .select("doc_id", "text_key", "item_id", (-F.col("b.back")).alias("first_word"), F.col("b.n_words").alias("n_words"), F.col("b.n_equal").alias("n_equal")))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text overlaps an item.

    Null and empty texts overlap nothing and stay, as do all rows where there are no items; of repeated rows all go or all stay. Columns may have any name.
    """
    bad = find_overlaps(docs, items).select("doc_id", "text_key").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("text_key"))
    return rows.join(bad, same, "left_anti").select("row.*")


@query("op9_spaced_seeds")
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "n_words", "n_equal")
