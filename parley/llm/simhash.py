"""SimHash near-dedup with Golay-code fuzzy hashing.

``fingerprint_components`` links 64-bit fingerprints that differ in at most two bits, completely. A fingerprint has three
segments of 22, 21 and 21 bits, each read as a word of the Golay code. Two errors leave one segment whole and, going
round, the next one with at most one error or else another such pair; words with at most one error share the index of
a nearby codeword. So each fingerprint is filed under (whole segment, index of a codeword near the next segment), one to
six keys for each of the three turns, and any two linked fingerprints meet under a key, where their distance is checked.

``similar_texts`` finds documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more. The same fingerprints,
met under the same Golay keys, give its first candidates and with them most components. Near 0.8 about 15 % of the bits of a
fingerprint differ, too many for nearby codewords, so texts that are not in one component yet are compared by the least shingle
hashes under 64 orders as well, in 16 bands of four: each pair at 0.8 shares a band with a probability of 0.9998, however the
texts differ. Every candidate is verified on the shingles themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage, remove_folder, shared_folder, short_lived_shuffles
from .components import components
from .golay import nearby
from .registry import query, table
from .wordhash import TOKENS, mix, slices, word_hashes

SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (lowest bit, bits)
SMALL = 64  # members of a key that are compared with each other


# --- 64-bit fingerprints -------------------------------------------------------------------------------------------

def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash over the text's word shingles: a bit is set if it is in over half of their hashes; 0 without words."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(TOKENS).split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i:i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id`` and ``print`` (the 64 bits as a signed long) of each row; null and empty texts have 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint(t, words) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    two = docs.select("doc_id", "text")
    return two.mapInArrow(run, f"doc_id {two.schema['doc_id'].dataType.simpleString()}, print long")


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of all prints (uint64), and the row each belongs to."""
    part = [(prints >> np.uint64(low) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    keys, rows = [], []
    for turn in range(3):
        near = nearby(part[(turn + 1) % 3])
        row, col = np.nonzero(near >= 0)
        keys.append(turn << 40 | part[turn][row] << 12 | near[row, col])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 50_000):
            prints = b.column(0).slice(at, 50_000)
            keys, rows = golay_keys(prints.to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), prints.take(pa.array(rows))], names=["key", "print"])


def link_prints(prints: DataFrame, small: int = SMALL) -> DataFrame:
    """Links (``a``, ``b``) among distinct ``print`` values whose components are those of all pairs at two bits or fewer.

    Members of a key with at most ``small`` prints are compared with each other. Prints of fuller keys are instead tied
    together exactly and in linear work: two prints are at most two bits apart if and only if they have a common value at
    most one bit from each, so every print names the 65 values around it and each value ties its prints to the smallest.
    """
    keyed = prints.mapInArrow(_keyed, "key long, print long")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut_lineage(keyed.join(counts, "key"))
    few = shared.where(F.col("n") <= small)
    x, y = few.select("key", F.col("print").alias("a")), few.select("key", F.col("print").alias("b"))
    near = (x.join(y, (x["key"] == y["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
            .select("a", "b"))
    full = shared.where(F.col("n") > small).select("print").distinct()
    around = F.concat(F.array("print"), *(F.array(F.col("print").bitwiseXOR(F.lit((1 << i) if i < 63 else -(1 << 63)))) for i in range(64)))
    spots = full.select("print", F.explode(around).alias("spot"))
    hubs = spots.groupBy("spot").agg(F.min("print").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    tied = spots.join(hubs, "spot").where("print <> b").select(F.col("print").alias("a"), "b")
    return near.union(tied).distinct()


def fingerprint_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id``, ``print`` and ``component_id``, the smallest doc_id reached over prints at most two bits apart.

    One row per document row, repeated rows included. Null ids are kept and never are the smallest, unless all are null. Null and empty texts
    have print 0, which is linked like any other. No documents give no rows; other columns are ignored.
    """
    marked = cut_lineage(fingerprints(docs, words))
    each = cut_lineage(marked.groupBy("print").agg(F.min("doc_id").alias("first")))
    tree = components(link_prints(each.select("print")))
    rooted = each.join(tree, each["print"] == tree["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("print", "component_id")
    return marked.join(named, "print").select("doc_id", "print", "component_id")


# --- documents that are alike by their shingles ----------------------------------------------------------------------

BANDS, BAND = 16, 4  # a pair with 0.8 of its shingles in common shares a key with probability 1 - (1 - 0.8 ** 4) ** 16 = 0.9998
APART = 28           # of the low four bits of the 64 minima; a pair at 0.8 differs in 12 of them, in more than 28 once in a million, one at 0.4 in 36
FEW = 8              # members of a key that are compared with each other at once
CELL = 256           # members of a full key that are compared in one task
SHINGLE, SIMILARITY = 5, 0.8
BITS = ("b0", "b1", "b2", "b3")
SKETCH = "node long, size int, b0 long, b1 long, b2 long, b3 long, print long, keys array<long>"
_TURNS = mix(np.arange(BANDS * BAND, dtype=np.uint64), 4) | np.uint64(1)


def _shingles(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, in rising order; a text of fewer words is one shingle, one without words has none."""
    for i, j in slices(texts):
        words, bounds = word_hashes(texts[i:j], TOKENS)
        for lo, hi in zip(bounds, bounds[1:]):
            w = words[lo:hi]
            n = len(w) - SHINGLE + 1
            h = np.zeros(max(n, min(len(w), 1)), dtype=np.uint64)
            for k in range(SHINGLE if n > 0 else len(w)):
                h += (w[k:k + n] if n > 0 else w[k:k + 1]) * np.uint64(2 * k * 0x51ED270B + 1)
            yield np.unique(mix(h, 3))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text its fingerprint, the number of its shingles, and from the least values of its shingles under ``BANDS`` x ``BAND`` orders the low bits and a key for each band."""
    for b in batches:
        least = np.full((b.num_rows, BANDS * BAND), np.iinfo(np.uint64).max, dtype=np.uint64)
        size = np.zeros(b.num_rows, dtype=np.int32)
        texts = b.column(1).to_pylist()
        prints = np.fromiter(map(fingerprint, texts), dtype=np.uint64, count=b.num_rows)
        for r, own in enumerate(_shingles(texts)):
            size[r] = len(own)
            for at in range(0, len(own), 4096):
                np.minimum(least[r], (own[at:at + 4096] * _TURNS[:, None]).min(axis=1), out=least[r])
        least = mix(least, 5)
        low = (least & np.uint64(15)).astype(np.uint8)
        bits = (low[:, ::2] | low[:, 1::2] << 4).view(np.int64)  # 16 minima in each of four numbers
        keys = np.tile(np.arange(BANDS, dtype=np.uint64), (b.num_rows, 1))
        for k in range(BAND):
            keys = mix(keys + least[:, k::BAND], 6)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(size), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(len(BITS))), pa.array(prints.view(np.int64)),
             pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))], names=["node", "size", *BITS, "print", "keys"])


def _close() -> Column:
    """Whether a pair, the second one's columns ending in ``_y``, can be alike by its sizes and is near enough by its bits."""
    sizes = F.least("size", "size_y") >= SIMILARITY * F.greatest("size", "size_y")
    return sizes & (sum((_unlike(F.col(c), F.col(f"{c}_y")) for c in BITS), F.lit(0)) <= APART)


def _unlike(x: Column, y: Column) -> Column:
    """In how many of their sixteen groups of four bits two numbers differ."""
    d = x.bitwiseXOR(y)
    for k in (1, 2):
        d = d.bitwiseOR(F.shiftrightunsigned(d, k))
    return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [own.tobytes() for own in _shingles(b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.large_binary()).cast(pa.binary())], names=["node", "shingles"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for k, (x, y) in enumerate(zip(b.column(2), b.column(3))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= SIMILARITY * (len(x) + len(y) - both):
                keep.append(k)
        yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(keep, pa.int64())) for i in range(2)], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) of nodes that are alike; only texts that stand in a pair are read again.

    Pairs and shingles are written to the shared folder and deleted in the end.
    """
    spark = pairs.sparkSession
    folder = f"{shared_folder(spark)}/near-{uuid.uuid4().hex}"
    pairs.write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    (texts.join(asked, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
     .mapInArrow(_shingle_sets, "node long, shingles binary").write.parquet(f"{folder}/sets"))
    sets = spark.read.parquet(f"{folder}/sets")
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    found = cut_lineage(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_alike, "a long, b long"))
    remove_folder(spark, folder)
    return found


def _pairs(x: DataFrame, y: DataFrame, on: list[str], extra: Column) -> DataFrame:
    """Pairs (``a`` < ``b``) of a member of ``x`` and one of ``y`` that agree in ``on`` and whose sketches are close."""
    y = y.select(*on, *(F.col(c).alias(f"{c}_y") for c in y.columns if c not in on))
    return (x.join(y, on).where((F.col("node") != F.col("node_y")) & extra & _close())
            .select(F.least("node", "node_y").alias("a"), F.greatest("node", "node_y").alias("b")))


def _print_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (``a`` < ``b``) of nodes of (``node``, ``print``): the nodes of each print with the least of them, and the least ones of linked prints."""
    each = cut_lineage(prints.groupBy("print").agg(F.min("node").alias("first")))
    x, y = each.select(F.col("print").alias("a"), F.col("first").alias("x")), each.select(F.col("print").alias("b"), F.col("first").alias("y"))
    near = link_prints(each.select("print")).join(x, "a").join(y, "b").select("x", "y")
    same = prints.join(each, "print").select(F.col("first").alias("x"), F.col("node").alias("y"))
    return same.union(near).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_texts(texts: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) among the distinct ``node`` values of (``node``, ``text``).

    Their components are those of all alike pairs whose fingerprints link or that share a key, each pair verified.
    Fingerprints go first; keys whose members they bring into one component are done. Members of a key with at most ``FEW``
    nodes are compared with each other, unless they are in one component. In a fuller key one member, the hub, is compared with all others, and then the components of all links
    so far are worked out: a key whose members are in one component is done, since no further link can change it. The
    others take another hub, as long as that settles half of the pairs of unlike components; all pairs of members in
    different components that are left then are compared, so none is given up.
    """
    sketched = cut_lineage(texts.mapInArrow(_sketches, SKETCH).dropDuplicates(["node"]))
    own = [c for c in sketched.columns if c not in ("node", "print", "keys")]
    tree = components(_verified(_print_pairs(sketched.select("node", "print")), texts))
    todo = sketched.join(tree, "node", "left").select("node", *own, F.coalesce("root", "node").alias("root"), F.explode("keys").alias("key"))
    counts = todo.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "m")
    shared = cut_lineage(todo.join(counts, "key"))
    few, full = shared.where(F.col("m") <= FEW).drop("m"), shared.where(F.col("m") > FEW).drop("m")
    fresh, last, turn = _pairs(few, few, ["key"], (F.col("node") < F.col("node_y")) & (F.col("root") != F.col("root_y"))), None, 0
    while True:
        hub = (full.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", *own, "root")).alias("s"))
               .select("key", *(F.col(f"s.{c}").alias(c) for c in ("node", *own, "root"))))
        to_hub = _pairs(full, cut_lineage(hub), ["key"], F.col("root") != F.col("root_y"))
        found = _verified((fresh.union(to_hub) if fresh is not None else to_hub).distinct(), texts)
        tied = tree.select(F.col("node").alias("a"), F.col("root").alias("b"))
        fresh, turn, tree = None, turn + 1, components(tied.union(found))
        rooted = cut_lineage(full.drop("root").join(tree, "node", "left").select("key", "node", *own, F.coalesce("root", "node").alias("root")))
        sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("c"))
        split = cut_lineage(sizes.groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.max_by("root", "c").alias("main"))
                            .where("sq < m * m"))
        left, members = split.agg(F.sum((F.col("m") * F.col("m") - F.col("sq")) / 2), F.sum("m")).first()
        links = tree.select(F.col("node").alias("a"), F.col("root").alias("b"))
        if not members:
            return links
        full = cut_lineage(rooted.join(split.drop("sq"), "key"))
        if left <= FEW * members or (last is not None and left > last / 2):
            break
        full, last = full.drop("m", "main"), left
    # each member stands in one cell of its key as a target; those outside the key's largest component go to all cells
    cells = F.ceil(F.col("m") / CELL).cast("long")
    targets = full.withColumn("cell", F.pmod(F.xxhash64("node"), cells)).drop("m", "main")
    rest = full.where("root <> main").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1))).drop("m", "main")
    return links.union(_verified(_pairs(rest, targets, ["key", "cell"], F.col("root") != F.col("root_y")).distinct(), texts))


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that a row with a smaller ``doc_id`` in their group of near duplicates stands for.

    A group is a component of texts that are equal or alike (``SIMILARITY`` of their five-word shingles). Of it the row with the smallest
    id stays, null ids last; of rows equal in id and text one stays. Null and empty texts are alike. Other columns may
    have any name and decide between equal ids only. Texts are told apart by a 64-bit hash.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    node = F.xxhash64(F.coalesce("row.text", F.lit("")))
    texts = rows.select(node.alias("node"), F.coalesce("row.text", F.lit("")).alias("text"))
    with short_lived_shuffles(docs.sparkSession):
        tree = components(similar_texts(texts))
    ids = docs.schema["doc_id"].dataType.simpleString()
    own = rows.select(node.alias("node"), F.col("row.doc_id").alias("id"), F.xxhash64("row").alias("same"))
    rooted = own.join(tree, "node", "left").select(F.coalesce("root", "node").alias("root"), "id", "same")
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "same")).alias("s"))
    chosen = best.select(F.col("s.id").cast(ids).alias("id"), F.col("s.same").alias("same")).distinct()
    kept = (rows.withColumn("same", F.xxhash64("row"))
            .join(chosen.withColumnRenamed("same", "chosen"), (F.col("same") == F.col("chosen")) & F.col("row.doc_id").eqNullSafe(F.col("id")), "left_semi"))
    return kept.select("row.*").dropDuplicates()


@query("op3_golay_simhash")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
