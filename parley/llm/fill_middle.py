"""Fill-in-the-middle texts: a document is cut in three, and the middle goes last.

Cuts are drawn in characters, but texts are UTF-8 bytes. A sparse index holds the multibyte characters only: where each stands and
how many bytes it has beyond one. Between two of them, positions differ from byte positions by a constant; a binary
search finds the constant, the rest is one addition. So no text is decoded, and a batch of texts is indexed and cut at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .registry import query, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT = 10
SPM_PERCENT = 20
SEED = 1
STEP_BYTES = 32 << 20


class CutIndex:
    """Character and byte positions of a UTF-8 buffer, from its multibyte characters alone."""
    def __init__(self, data: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        first = data[lead]
        self.byte_at = lead
        self.size = 2 + (first >= 0xE0) + (first >= 0xF0)
        self.excess = np.concatenate(([0], np.cumsum(self.size - 1)))  # bytes beyond one in all multibyte characters before the k-th
        self.char_at = lead - self.excess[:-1]

    def to_bytes(self, chars: np.ndarray) -> np.ndarray:
        """Byte positions of characters."""
        return chars + self.excess[np.searchsorted(self.char_at, chars, "left")]

    def to_chars(self, at: np.ndarray) -> np.ndarray:
        """Characters that begin before a byte position, without one that is cut by it."""
        k = np.searchsorted(self.byte_at, at, "left")
        if not len(self.byte_at):
            return at
        before = np.maximum(k - 1, 0)
        cut = (k > 0) & (at < self.byte_at[before] + self.size[before])
        return np.where(cut, self.char_at[before], at - self.excess[k])


def _number(digest: Column, group: int) -> Column:
    """A group of eight hex digits as an unsigned number."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column, nulls as empty texts; nothing is copied."""
    column = column.fill_null("") if column.null_count else column
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(ends, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) if ends and ends.size else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return ends - ends[0], whole[ends[0]:ends[-1]]


def row_spans(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows whose sizes sum to at most ``limit``, or one row beyond it."""
    lo, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > lo and total + s > limit:
            yield lo, i
            lo, total = i, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)


def fill_in_middle(docs: DataFrame, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED, unit: str = "chars") -> DataFrame:
    """``doc_id``, ``n`` (characters), ``form``, ``prefix_chars``, ``middle_chars``, ``output`` of every row.

    Four numbers drawn from ``seed`` and ``doc_id`` by SHA-256 decide: both cuts, whether the text stays plain, and the order of the parts (``psm``
    or ``spm``). Cuts are drawn in characters, or with ``unit="bytes"`` in bytes and moved back to the beginning of the character they hit.
    A null text is empty. Empty texts and texts that hold one of the marks are plain, with null counts. A null id draws
    from the seed alone. Repeated rows give repeated results, no rows none; other columns are ignored.
    """
    if unit not in ("chars", "bytes"):
        raise ValueError("unit is chars or bytes")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    text = F.coalesce("text", F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (_number(digest, 2) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(_number(digest, 3) % 100 < spm_percent, "spm").otherwise("psm")
    drawn = docs.select("doc_id", text.alias("text"), form.alias("form"), _number(digest, 0).alias("h1"), _number(digest, 1).alias("h2"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.diff(_text_bytes(whole.column(1))[0])
            for lo, hi in row_spans(sizes, STEP_BYTES):
                b = whole.slice(lo, hi - lo)
                ends, data = _text_bytes(b.column(1))
                index = CutIndex(data)
                begin = index.to_chars(ends)
                n, first = np.diff(begin), begin[:-1]
                h = np.stack([np.asarray(b.column(c), dtype=np.int64) for c in (3, 4)])
                if unit == "chars":
                    cuts = np.sort(h % (n + 1), axis=0)
                else:
                    cuts = np.sort(index.to_chars(ends[:-1] + h % (np.diff(ends) + 1)) - first, axis=0)
                at = index.to_bytes(first + cuts)
                forms = b.column(2).to_pylist()
                view, pieces = memoryview(data), []
                for form, x, y, i, j in zip(forms, ends[:-1].tolist(), ends[1:].tolist(), at[0].tolist(), at[1].tolist()):
                    if form == "plain":
                        pieces.append(view[x:y])
                    elif form == "psm":
                        pieces += [p, view[x:i], s, view[j:y], m, view[i:j]]
                    else:
                        pieces += [s, view[j:y], p, view[x:i], m, view[i:j]]
                cut = np.array([f != "plain" for f in forms])
                long = np.concatenate(([0], np.cumsum(np.diff(ends) + cut * (len(p) + len(s) + len(m)))))
                output = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(long), pa.py_buffer(b"".join(pieces))).cast(pa.string())
                counts = [pa.array(c, pa.int64(), mask=~cut) for c in (cuts[0], cuts[1] - cuts[0])]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(2), *counts, output],
                                                 names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = drawn.schema["doc_id"].dataType.simpleString()
    return drawn.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of.

    No part holds a mark, and no mark ends as another begins, so the first place of each mark is its own.
    """
    p, s, m = (F.instr(output, x) for x in (PREFIX, SUFFIX, MIDDLE))
    wide = len(PREFIX)

    def between(lo: Column, hi: Column) -> Column:
        return F.substring(output, lo + wide, hi - lo - wide)

    middle = F.substring(output, m + wide, F.length(output))
    psm, spm = F.concat(between(p, s), middle, between(s, m)), F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


@query("op12_sparse_index_fim", f"""
    with d as (select doc_id, coalesce(text, '') as t, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as h from documents),
    x as (select doc_id, t, length(t) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
    f as (select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') or h3 % 100 >= {100 - PLAIN_PERCENT} then 'plain'
             when h4 % 100 < {SPM_PERCENT} then 'spm' else 'psm' end as form from x),
    o as (select *, substring(t, 1, a) as p, substring(t, a + 1, b - a) as m, substring(t, b + 1) as s from f)
    select doc_id, n::bigint as n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
        sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m else '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m end) as output_sha256,
        sha256(t) as restored_sha256 from o""")
def middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
