"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Counts, continuation counts and context sums are tables sharded by n-gram; probabilities come from a join of those
tables for the n-grams that documents have. Documents go through it in blocks: a block counts its
distinct n-grams, asks the tables for those only, and scores its documents with the answers, so neither single places
nor whole tables travel. A document's perplexity is held against a quantile of its language.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage, remove_folder, shared_folder
from .registry import query, table

ORDER = 4
BEGIN = "\x02"          # stands before a text
BLOCK_CHARS = 32_000_000
SLICE_CHARS = 2_000_000
HELD = 5                # every fifth trusted text sets the limits instead of training
QUANTILE = 0.99
LEAST_HELD = 10         # a language with fewer takes all its trusted texts in turn for its limit
SALTS = 64
BROADCAST_IDS = 4_000_000  # trusted ids that may travel to every task, 32 MB
_BASE = np.uint64(0x9E3779B97F4A7C15)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id`` of the documents whose labels all say good and not toxic."""
    return (labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
            .where("q = 1 and t = 0").select("doc_id"))


def _ipc(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def _open(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows of a partition as numbered blocks of about BLOCK_CHARS characters, however they arrive."""
    part, count, held, chars = TaskContext.get().partitionId(), 0, [], 0
    for b in batches:
        sizes = np.cumsum(np.asarray(pc.utf8_length(b.column("text"))))
        begin = 0
        while begin < b.num_rows:
            done = int(sizes[begin - 1]) if begin else 0
            end = min(b.num_rows, int(np.searchsorted(sizes, done + BLOCK_CHARS - chars)) + 1)
            held.append(b.slice(begin, end - begin))
            chars += int(sizes[end - 1]) - done
            begin = end
            if chars >= BLOCK_CHARS:
                yield part << 32 | count, pa.Table.from_batches(held)
                count, held, chars = count + 1, [], 0
    if held:
        yield part << 32 | count, pa.Table.from_batches(held)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, t in _blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_ipc(t)], pa.binary())], names=["block", "blob"])


def _codes(chars: np.ndarray) -> np.ndarray:
    """A 64-bit code of the n-gram that ends at each place from ORDER - 1 on."""
    n = len(chars) - ORDER + 1
    c = chars.astype(np.uint64) + np.uint64(1)
    h = c[:n].copy()
    for k in range(1, ORDER):
        h *= _BASE
        h += c[k:k + n]
    return h ^ (h >> np.uint64(29))


def _places(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts in one row, each after its beginning; codes of the n-grams ending at their characters; places where each text's codes begin."""
    joined = "".join(BEGIN * (ORDER - 1) + t for t in texts)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.arange(lengths.sum()) + np.repeat(np.arange(len(texts)) * (ORDER - 1), lengths)  # index of the code, i.e. of the n-gram's first character
    codes = _codes(chars)[ends] if len(ends) else np.zeros(0, np.uint64)
    return joined, codes, ends


def _by_language(t: pa.Table) -> Iterator[tuple[str, np.ndarray]]:
    lang = np.array(t.column("lang").to_pylist(), dtype=object)
    for one in sorted(set(lang)):
        yield one, np.flatnonzero(lang == one)


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    total = np.cumsum(lengths)
    begin = 0
    while begin < len(lengths):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + SLICE_CHARS)))
        yield begin, min(end, len(lengths))
        begin = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of each block and language with their count in trusted texts that train."""
    for number, t in _blocks(batches):
        texts, trains = t.column("text").to_pylist(), np.asarray(t.column("trains"))
        for lang, rows in _by_language(t):
            codes, counts, names = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, f"U{ORDER}")
            for train in (True, False):
                some = rows[trains[rows] == train]
                for i, j in _slices(np.array([len(texts[r]) for r in some])):
                    joined, all_codes, ends = _places([texts[r] for r in some[i:j]])
                    c, first, n = np.unique(all_codes, return_index=True, return_counts=True)
                    new = ~np.isin(c, codes, assume_unique=True)
                    own = np.array([joined[p:p + ORDER] for p in ends[first[new]].tolist()], dtype=f"U{ORDER}")
                    if train and len(codes):
                        counts[np.searchsorted(codes, c[~new])] += n[~new]
                    codes, counts, names = (np.concatenate(x) for x in ((codes, c[new]), (counts, n[new] * train), (names, own)))
                    order = np.argsort(codes, kind="stable")
                    codes, counts, names = codes[order], counts[order], names[order]
            for at in range(0, len(codes), 100_000):
                n = names[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(n), pa.int64()), pa.array([lang] * len(n)), pa.array(n.tolist(), pa.string()),
                                                  pa.array(counts[at:at + 100_000])], names=["block", "lang", "gram", "n"])


def _score(docs: pa.Table, grams: pa.Table) -> pa.Table:
    out = []
    lang_of = np.array(grams.column("lang").to_pylist(), dtype=object)
    names, values = grams.column("gram").to_pylist(), np.asarray(grams.column("cost"))
    for blob in docs.column("blob"):
        t = _open(blob.as_py())
        texts = t.column("text").to_pylist()
        cost = np.full(len(texts), np.nan)
        for lang, rows in _by_language(t):
            own = np.flatnonzero(lang_of == lang)
            chars = np.frombuffer("".join(names[i] for i in own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            codes = _codes(chars)[::ORDER] if len(chars) else np.zeros(0, np.uint64)
            order = np.argsort(codes)
            codes, known = codes[order], values[own][order]
            for i, j in _slices(np.array([len(texts[r]) for r in rows])):
                some = rows[i:j]
                _, at, _ = _places([texts[r] for r in some])
                if not len(at):
                    continue
                spot = np.searchsorted(codes, at)
                if spot.max() >= len(codes) or (codes[spot] != at).any():
                    raise RuntimeError("a block differs from the one whose n-grams were counted")
                each = known[spot]
                lengths = np.array([len(texts[r]) for r in some])
                has = np.flatnonzero(lengths)
                begins = np.concatenate([[0], np.cumsum(lengths[has])[:-1]])
                cost[some[has]] = np.add.reduceat(each, begins) / lengths[has]
        out.append(pa.table([t.column("doc_id"), t.column("text_key"), t.column("lang"), pa.array(np.exp(cost), mask=np.isnan(cost))],
                            names=["doc_id", "text_key", "lang", "perplexity"]))
    return pa.concat_tables(out) if out else pa.table({})


def _discounts(suffixes: DataFrame) -> DataFrame:
    """Discounts for counts of 1, 2 and more, by language, length and salt, and how many suffixes were seen."""
    n = suffixes.where("c > 0").groupBy("lang", "k").agg(*(F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)), F.count("*").alias("seen"))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def d(i: int) -> Column:
        raw = F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.lit(float(i)), F.coalesce(raw, F.lit(0.5 * i)))).alias(f"d{i}")

    return n.select("lang", "k", d(1), d(2), d(3), "seen", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def ngram_costs(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang``, ``gram``, ``cost`` (-log of the probability of the last character after the others) for every row of ``counts`` (``lang``, ``gram``, ``c``).

    All n-grams with c > 0 are the training counts; the others are only asked for. A suffix of k characters counts by
    how many different ones of k + 1 characters end in it, the whole n-gram by its own count. At each length the
    probability is ``own`` plus ``spare`` times that of the next shorter suffix; so an n-gram gathers both numbers of
    its suffixes in one join and folds them. A language without training has the same cost everywhere.
    """
    k = F.col("k")
    ends = (counts.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(order))))
            .select("lang", "gram", "c", "k", F.substring("gram", order + 1 - k, k).alias("suffix"),
                    F.when(k < order, F.substring("gram", order - k, F.lit(1))).otherwise("").alias("before")))
    longer = ends.groupBy("lang", "k", "suffix", "before").agg(F.sum("c").alias("c"))
    suffixes = longer.groupBy("lang", "k", "suffix").agg(F.sum(F.when(k == order, F.col("c")).otherwise((F.col("c") > 0).cast("long"))).alias("c"))
    context = Window.partitionBy("lang", "k", "context")
    salt = F.pmod(F.xxhash64("suffix"), F.lit(SALTS)).cast("int")
    summed = (suffixes.withColumn("context", F.substring("suffix", F.lit(1), k - 1)).withColumn("salt", salt)
              .select("lang", "k", "suffix", "c", "salt", F.sum("c").over(context).alias("total"),
                      *(F.sum((F.col("c") == i).cast("long")).over(context).alias(f"m{i}") for i in (1, 2)), F.sum((F.col("c") > 2).cast("long")).over(context).alias("m3"))
              .join(_discounts(suffixes), ["lang", "k", "salt"], "left"))
    off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    own = F.when(F.col("c") > 0, (F.col("c") - off) / F.col("total")).otherwise(0.0)
    spare = F.when(F.col("total") == 0, 1.0).otherwise((F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total"))
    parts = summed.select("lang", "k", "suffix", own.alias("own"), spare.alias("spare"), (1 / (F.coalesce("seen", F.lit(0)) + 1)).alias("even"))
    asked = ends.select("lang", "gram", "k", "suffix").join(parts, ["lang", "k", "suffix"]).groupBy("lang", "gram").agg(
        F.sort_array(F.collect_list(F.struct("k", "own", "spare", "even"))).alias("parts"))
    p = F.aggregate("parts", F.get("parts", F.lit(0))["even"], lambda low, x: x["own"] + x["spare"] * low)
    return asked.select("lang", "gram", (-F.log(F.greatest(p, F.lit(1e-300)))).alias("cost"))


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` (xxhash64 of the text), ``lang`` (null: empty), ``perplexity`` of each row, from all trusted texts of ``docs``.

    A null or empty text has a null perplexity. Repeated rows stay repeated; other columns are ignored. ``docs`` is read
    twice, to count and to score, and has to come in the same order both times, as tables do. What lies between
    is written to the shared folder and deleted in the end.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    marks = trusted.withColumn("mark", F.lit(True))
    wide = trusted.count() > BROADCAST_IDS
    flagged = plain.join(marks if wide else F.broadcast(marks), "doc_id", "left")
    trains = F.coalesce("mark", F.lit(False)) & (_fold() != 0)
    return _scored(flagged.select("doc_id", "text_key", "lang", "text", trains.alias("trains")), kind, wide)


def _fold() -> Column:
    return F.pmod("text_key", F.lit(HELD))


def _scored(flagged: DataFrame, kind: str, write: bool) -> DataFrame:
    """``doc_id``, ``text_key``, ``lang``, ``perplexity`` of each row under the model of its language's rows that ``trains``; ``write``: keep the rows' order by a copy."""
    spark = flagged.sparkSession
    folder = f"{shared_folder(spark)}/quality-{uuid.uuid4().hex}"
    if write:
        flagged.write.parquet(f"{folder}/flagged")
        flagged = spark.read.parquet(f"{folder}/flagged")
    flagged.mapInArrow(_count, "block long, lang string, gram string, n long").write.parquet(f"{folder}/grams")
    grams = spark.read.parquet(f"{folder}/grams")
    counts = cut_lineage(grams.groupBy("lang", "gram").agg(F.sum("n").alias("c")))
    asked = grams.select("block", "lang", "gram").join(ngram_costs(counts), ["lang", "gram"])
    blocks = flagged.mapInArrow(_pack, "block long, blob binary")
    scored = cut_lineage(blocks.groupBy("block").cogroup(asked.groupBy("block"))
                         .applyInArrow(_score, f"doc_id {kind}, text_key long, lang string, perplexity double"))
    remove_folder(spark, folder)
    return scored


def _in_turn(docs: DataFrame, trusted: DataFrame, few: DataFrame) -> DataFrame:
    """``lang`` and ``perplexity`` of all trusted texts of the languages ``few``, each fifth under a model of the other four."""
    plain = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    own = cut_lineage(plain.join(trusted, "doc_id", "left_semi").join(F.broadcast(few), "lang", "left_semi"))
    turns = own.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(HELD - 1))))
    apart = F.concat("lang", F.lit(BEGIN), F.col("turn").cast("string"))
    scored = _scored(turns.select("doc_id", "text_key", apart.alias("lang"), "text", (_fold() != F.col("turn")).alias("trains")), docs.schema["doc_id"].dataType.simpleString(), True)
    turn = F.substring_index("lang", BEGIN, -1).cast("int")
    return scored.where(_fold() == turn).select(F.expr(f"substr(lang, 1, length(lang) - {len(BEGIN) + 1})").alias("lang"), "perplexity")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``doc_id``, ``text_key``, ``lang``, ``perplexity``, ``upper_limit`` and ``keep`` of each row.

    The model is trained on the texts of documents whose labels all say good and not toxic, but for every fifth of
    them (by text hash, so copies go together). Those held back set the limit of their language: ``quantile`` of their perplexities.
    Where they are fewer than ``LEAST_HELD``, all trusted texts of the language set it, each fifth in turn under a model of the
    other four. A document above its language's limit is rejected; one without a perplexity is kept, and so is one of a
    language whose trusted texts are none or all in one fifth, which leaves nothing unseen to hold it against. No documents give no rows.
    """
    trusted = trusted_ids(labels)
    scored = perplexities(docs, trusted)
    # a share of the trusted texts that the model has not seen
    good = scored.where("perplexity is not null").join(trusted, "doc_id", "left_semi")
    per = cut_lineage(good.groupBy("lang").agg(F.count_if(_fold() == 0).alias("held"), F.count_distinct(_fold()).alias("folds")).where("folds > 1"))
    few = per.where(F.col("held") < LEAST_HELD).select("lang")
    enough = per.where(F.col("held") >= LEAST_HELD).select(F.col("lang").alias("own"))  # one row a language, as below
    unseen = good.where(_fold() == 0).join(F.broadcast(enough), F.col("lang") == F.col("own"), "left_semi").select("lang", "perplexity")
    if not few.isEmpty():
        unseen = unseen.union(_in_turn(docs, trusted, few))
    limits = unseen.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 100_000).alias("upper_limit"))
    return (scored.join(F.broadcast(limits), "lang", "left")
            .withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("upper_limit"), F.lit(True)))
            .select("doc_id", "text_key", "lang", "perplexity", "upper_limit", "keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows; what ``judge`` has no limit or perplexity for stays.

    Of repeated rows all go or all stay; no rows give none. Columns may have any name.
    """
    bad = judge(docs, labels).where("not keep").select("doc_id", "text_key", "lang").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = (F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("text_key"))
            & (F.coalesce("row.lang", F.lit("")) == F.col("lang")))
    return rows.join(bad, same, "left_anti").select("row.*")


@query("op1_kneser_ney")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
