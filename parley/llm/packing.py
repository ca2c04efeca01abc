"""Best-fit packing of token sequences: large items are matched, small ones fill the gaps.

No more than two pieces above a third of the capacity fit together in a sequence. So those are matched first: the
longest unmatched piece takes the longest one that still fits beside it. The rest goes, longest first, into the
tightest gap that holds it. Pieces of one length are alike, so the plan is made on the histogram of lengths: it has
at most ``capacity`` entries, however many documents there are, and sequences that look alike are kept as one group
with a count. Spark counts the lengths, numbers the pieces of each length and joins each to its place in the plan.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage
from .registry import query, table

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k"

#: (length, first rank, pieces, first sequence, pieces in each sequence, offset in the first of them)
Step = tuple[int, int, int, int, int, int]


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Step], int]:
    """Where the pieces of each length go, and the number of sequences.

    A step says: of the pieces of this length, those with the given ranks fill consecutive sequences, so many in each,
    one behind the other from the given offset on.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("a piece is empty or longer than a sequence")
    used: Counter[int] = Counter()
    steps: list[Step] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, sequences)
    n_sequences = 0

    def place(size: int, pieces: int, first: int, each: int, offset: int) -> None:
        steps.append((size, used[size], pieces, first, each, offset))
        used[size] += pieces
        left[size] -= pieces
        if not left[size]:
            del left[size]

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        if at < 0:
            first, pairs, b = n_sequences, left[a], 0
            place(a, pairs, first, 1, 0)
        else:
            b = large[at]
            first = n_sequences
            if a == b and left[a] == 1:
                pairs, b = 1, 0
                place(a, 1, first, 1, 0)
            elif a == b:
                pairs = left[a] // 2
                place(a, 2 * pairs, first, 2, 0)
            else:
                pairs = min(left[a], left[b])
                place(a, pairs, first, 1, 0)
                place(b, pairs, first, 1, a)
        n_sequences += pairs
        gaps[capacity - a - b].append((first, pairs))
        large = [s for s in large if s in left]

    for size in sorted(left, reverse=True):
        open_gaps = sorted(g for g in gaps if g >= size and gaps[g])
        for g in open_gaps:
            each = g // size
            while size in left and gaps[g]:
                first, bins = gaps[g].pop()
                full = min(bins, left[size] // each)
                if full:
                    place(size, full * each, first, each, capacity - g)
                    if g - each * size:
                        gaps[g - each * size].append((first, full))
                rest = left.get(size, 0)
                if full < bins and rest:
                    place(size, rest, first + full, rest, capacity - g)
                    if g - rest * size:
                        gaps[g - rest * size].append((first + full, 1))
                    full += 1
                if full < bins:
                    gaps[g].append((first + full, bins - full))
            if size not in left:
                break
        if size in left:
            each = capacity // size
            full, rest = divmod(left[size], each)
            for bins, n in ((full, each), (1, rest)):
                if bins and n:
                    place(size, bins * n, n_sequences, n, 0)
                    if capacity - n * size:
                        gaps[capacity - n * size].append((n_sequences, bins))
                    n_sequences += bins
    return steps, n_sequences


TWO_BLANKS = re.compile(r"\s\s")
#: between a character that is not white space and a blank or line end that another such character follows
SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")


class Encoder:
    """Token ids of texts as the public byte-level vocabulary gives them.

    A blank between two other characters that are not white space always begins a new piece of the vocabulary's
    splitting pattern, so a text may be cut there and each part's ids kept: common words are encoded once for each
    worker. The same ids come from the ``tokenizers`` file; a test compares both. A text with the special token's
    string is left to ``tokenizers``.
    """
    def __init__(self, name: str = TOKENIZER, kept: int = 400_000):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.name, self.kept, self.parts, self.whole = name, kept, {}, None

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        if "<|endoftext|>" in text:
            if self.whole is None:
                import public_tokenizers
                from tokenizers import Tokenizer
                self.whole = Tokenizer.from_file(public_tokenizers.path(f"{self.name}.json"))
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if TWO_BLANKS.search(text) or text[0].isspace() or text[-1].isspace():
            cut = SAFE.split(text)
        else:
            first, *rest = text.replace("\n", " \n").split(" ")
            cut = [first, *[p if p[0] == "\n" else " " + p for p in rest]]
        known = self.parts
        if len(known) > self.kept:
            known.clear()
        for p in cut:
            if p not in known:
                known[p] = np.asarray(self.encoding.encode_ordinary(p), dtype="<u4").tobytes()
        return b"".join([known[p] for p in cut])


_encoders: dict[str, Encoder] = {}


def _encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    A document is its ids and one closing id; only longer ones are cut, the first piece taking what is over.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = _encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = encode(text or "") + tail
                n = len(ids) // 4
                begin, piece = 0, 0
                end = n % capacity or capacity if n > capacity else n
                while begin < n:
                    rows.append((i, piece, begin, end - begin, zlib.crc32(ids[4 * begin:4 * end])))
                    begin, end, piece = end, end + capacity, piece + 1
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    two = docs.select("doc_id", "text")
    return two.mapInArrow(run, f"doc_id {two.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, salts: int = 64) -> DataFrame:
    """All pieces with ``sequence_id`` and ``offset``; together they fill every sequence from 0 without a gap.

    A null or empty text is one piece of the closing id. Null ids and repeated rows are packed like any others. Pieces
    of a length are numbered inside ``salts`` shares of it, so a length that very many pieces have is spread over as
    many tasks; the shares' sizes (at most ``salts`` times ``capacity`` of them) shift the numbers. No documents give no rows.
    """
    pieces = cut_lineage(cut_pieces(docs, capacity, tokenizer))
    share = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int")
    pieces = pieces.withColumn("share", share)
    counted = pieces.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    begins = counted.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    steps, _ = plan_sequences(histogram, capacity)
    spark = docs.sparkSession
    by_length: dict[int, list[Step]] = defaultdict(list)
    for s in steps:
        by_length[s[0]].append(s)
    plan_rows = [(s, [x[1] for x in xs], [(x[1], x[3], x[4], x[5]) for x in xs]) for s, xs in by_length.items()]
    plan = spark.createDataFrame(plan_rows, "length long, ranks array<long>, steps array<struct<rank:long,first:long,each:long,offset:long>>")
    inside = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (pieces.withColumn("inside", inside)
              .join(F.broadcast(begins), ["length", "share"])  # at most capacity x salts rows
              .withColumn("rank", F.col("inside") + F.col("begin")))
    numbered = ranked.join(F.broadcast(plan), "length")
    # ranks of a length are in rising order: the step is the last one that begins at or before the rank
    step = F.expr("element_at(steps, cast(aggregate(ranks, 0, (a, r) -> a + if(r <= rank, 1, 0)) as int))")
    done = numbered.withColumn("step", step).withColumn("over", F.col("rank") - F.col("step.rank"))
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("step.first + over div step.each").alias("sequence_id"),
                       F.expr("step.offset + (over % step.each) * length").alias("offset"))


@query("op8_matched_best_fit")
def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
