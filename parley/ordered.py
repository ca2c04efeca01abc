"""Ordered work inside a key, cut into slices.

A transcript is an ordered list, so most operators ask "what came before this
row". A plain window over ``meeting`` puts a whole meeting in one task. Here
each key is cut into slices of consecutive positions; windows run per slice and
only one summary row per slice crosses slice borders. A meeting of any length
is therefore spread over many tasks, and a meeting shorter than one slice costs
no more than one extra summary row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import cut_lineage

SLICE_ROWS = 50_000
_KEY, _SLICE, _ROW = "_key", "_slice", "_row"


def _sliced(df: DataFrame, keys: Sequence[str], pos: str, width: float, inputs: Mapping[str, Column]) -> DataFrame:
    """Rows shuffled once by (key, slice), with the row packed in one column.

    Both readers of the result - the windows and the slice summaries - see the
    same columns, so Spark runs one exchange and reuses it. Without the packing
    each reader would prune its own columns and the input would be computed
    twice per scan, four times after two scans, and so on.
    """
    key = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]) if keys else F.lit("")
    at = F.coalesce(F.floor(F.col(pos) / F.lit(width)).cast("long"), F.lit(-(1 << 62)))
    row = F.array(F.struct(*df.columns, *[e.alias(n) for n, e in inputs.items()]))
    packed = df.select(F.coalesce(key, F.lit("")).alias(_KEY), at.alias(_SLICE), row.alias(_ROW))
    shared = packed.repartition(_KEY, _SLICE)
    names = [*df.columns, *inputs]
    # element_at keeps the optimizer from pulling single fields below the exchange.
    return shared.select(_KEY, _SLICE, *[F.element_at(_ROW, 1)[n].alias(n) for n in names], F.size(_ROW).alias(_ROW))


def scan(df: DataFrame, keys: Sequence[str], pos: str, *, ties: Sequence[str] = (),
         prev: Mapping[str, Column] | None = None, last: Mapping[str, Column] | None = None,
         following: Mapping[str, Column] | None = None, sums: Mapping[str, Column] | None = None,
         width: float = SLICE_ROWS) -> DataFrame:
    """Add running columns in the order ``pos, *ties`` within ``keys``.

    prev       last non-null value strictly before the row
    last       last non-null value up to and including the row
    following  first non-null value strictly after the row
    sums       running sum including the row

    ``width`` is the span of ``pos`` in one slice: a row count for dense
    positions, seconds for times. Select the needed columns before calling.
    """
    prev, last = dict(prev or {}), dict(last or {})
    following, sums = dict(following or {}), dict(sums or {})
    inputs = {f"_in_{n}": e for group in (prev, last, following, sums) for n, e in group.items()}
    base = _sliced(df, keys, pos, width, inputs)
    at = F.struct(pos, *ties) if ties else F.col(pos)

    aggs = []
    for n in [*prev, *last]:
        c = F.col(f"_in_{n}")
        aggs.append(F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_edge_{n}"))
    for n in following:
        c = F.col(f"_in_{n}")
        aggs.append(F.min_by(c, F.when(c.isNotNull(), at)).alias(f"_edge_{n}"))
    for n in sums:
        aggs.append(F.sum(f"_in_{n}").alias(f"_edge_{n}"))
    edges = base.groupBy(_KEY, _SLICE).agg(*aggs)
    before = W.partitionBy(_KEY).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(_KEY).orderBy(F.desc(_SLICE)).rowsBetween(W.unboundedPreceding, -1)
    carried = edges.select(
        _KEY, _SLICE,
        *[F.last(f"_edge_{n}", ignorenulls=True).over(before).alias(f"_carry_{n}") for n in [*prev, *last]],
        *[F.last(f"_edge_{n}", ignorenulls=True).over(after).alias(f"_carry_{n}") for n in following],
        *[F.sum(f"_edge_{n}").over(before).alias(f"_carry_{n}") for n in sums])

    order = W.partitionBy(_KEY, _SLICE).orderBy(pos, *ties)
    back = W.partitionBy(_KEY, _SLICE).orderBy(F.desc(pos), *[F.desc(t) for t in ties])
    strict, upto = (W.unboundedPreceding, -1), (W.unboundedPreceding, 0)
    local = {}
    for n in prev:
        local[f"_own_{n}"] = F.last(f"_in_{n}", ignorenulls=True).over(order.rowsBetween(*strict))
    for n in last:
        local[f"_own_{n}"] = F.last(f"_in_{n}", ignorenulls=True).over(order.rowsBetween(*upto))
    for n in sums:
        local[f"_own_{n}"] = F.sum(f"_in_{n}").over(order.rowsBetween(*upto))
    for n in following:
        local[f"_own_{n}"] = F.last(f"_in_{n}", ignorenulls=True).over(back.rowsBetween(*strict))
    out = base.withColumns(local).join(carried, [_KEY, _SLICE], "left")
    values = {n: F.coalesce(f"_own_{n}", f"_carry_{n}") for n in [*prev, *last, *following]}
    for n in sums:
        values[n] = F.coalesce(F.col(f"_own_{n}") + F.col(f"_carry_{n}"), f"_own_{n}", f"_carry_{n}")
    keep = [c for c in df.columns if c not in values]
    return out.select(*keep, *[e.alias(n) for n, e in values.items()])


def number_rows(df: DataFrame, keys: Sequence[str], pos: str, *, ties: Sequence[str] = (), name: str = "idx",
                start: int = 0, width: float = SLICE_ROWS) -> DataFrame:
    """Dense position within ``keys`` in the order ``pos, *ties``."""
    base = _sliced(df, keys, pos, width, {})
    before = W.partitionBy(_KEY).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    carried = (base.groupBy(_KEY, _SLICE).agg(F.sum(_ROW).alias("_n"))
               .select(_KEY, _SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    order = W.partitionBy(_KEY, _SLICE).orderBy(pos, *ties)
    out = base.withColumn("_rn", F.row_number().over(order)).join(carried, [_KEY, _SLICE])
    keep = [c for c in df.columns if c != name]
    return out.select(*keep, (F.col("_rn") + F.col("_offset") - 1 + start).cast("long").alias(name))


def place_rows(df: DataFrame, keys: Sequence[str], pos: str, *, ties: Sequence[str] = (), name: str = "idx", start: int = 0) -> DataFrame:
    """As ``number_rows``, for values that may pile up: all slices hold about as many rows, whatever their values.

    Rows are dealt by sampled ranges of (key, ``pos``, ``ties``), so those of one key and value are split by their ties,
    and written down, as both readers have to see the same ranges. A row's number is its place in its part of the key and what
    the earlier parts hold.
    """
    key = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]) if keys else F.lit("")
    order = [_KEY, *[f"_o{i}" for i in range(1 + len(ties))]]
    packed = df.select(F.coalesce(key, F.lit("")).alias(_KEY), *[F.col(c).alias(o) for c, o in zip((pos, *ties), order[1:])], F.struct(*df.columns).alias(_ROW))
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut_lineage(packed.repartitionByRange(ranges, *order).sortWithinPartitions(*order))
    # the upper bits of the id are the range, the lower 33 the place in it
    base = dealt.select(_KEY, _ROW, F.monotonically_increasing_id().alias("_at")).withColumn(_SLICE, F.shiftright("_at", 33))
    before = W.partitionBy(_KEY).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    parts = (base.groupBy(_KEY, _SLICE).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
             .select(_KEY, _SLICE, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    number = (F.col("_at") - F.col("_first") + F.col("_offset") + start).cast("long").alias(name)
    return base.join(parts, [_KEY, _SLICE]).select(*[F.col(_ROW)[c].alias(c) for c in df.columns if c != name], number)


def neighbourhood(df: DataFrame, keys: Sequence[str], pos: str, *, width: float, before: float = 0, after: float = 0) -> DataFrame:
    """Rows by slice, each slice with copies of the rows just outside it.

    Rows within ``before`` of a slice's end are copied to the next slice, rows
    within ``after`` of its start to the one before. Windows over
    ``(keys, _slice)`` can then look that far across the border; drop the
    copies with ``where("not _copy")``.
    """
    own = F.floor(F.col(pos) / F.lit(width)).cast("long")
    inside = F.col(pos) - own * F.lit(width)
    targets = F.array_compact(F.array(own, F.when(inside >= F.lit(width - before), own + 1) if before else F.lit(None).cast("long"),
                                      F.when(inside <= F.lit(after), own - 1) if after else F.lit(None).cast("long")))
    return df.withColumn("_own", own).withColumn(_SLICE, F.explode(targets)).withColumn("_copy", F.col("_own") != F.col(_SLICE)).drop("_own")


def runs(df: DataFrame, keys: Sequence[str], pos: str, columns: Sequence[str], breaks: Callable[[Column, Column], Column], *,
         ties: Sequence[str] = (), name: str = "run", width: float = SLICE_ROWS) -> DataFrame:
    """Mark each row with the place (``pos``, or a struct with ``ties``) where its run of rows begins.

    ``breaks(before, row)`` gets the previous and the current row as structs of
    ``columns`` and says whether the row begins a new run. Runs are found per
    slice; the summaries tell which slices go on with the run before them.
    """
    base = _sliced(df, keys, pos, width, {})
    at = F.struct(pos, *ties) if ties else F.col(pos)
    order = W.partitionBy(_KEY, _SLICE).orderBy(pos, *ties)
    new = lambda before, row: before.isNull() | F.coalesce(breaks(before, row), F.lit(True))
    rows = base.withColumn("_cur", F.struct(*columns)).withColumn("_at", at)
    rows = rows.withColumn("_before", F.lag("_cur").over(order))
    rows = rows.withColumn("_begin", F.last(F.when(new(F.col("_before"), F.col("_cur")), F.col("_at")), ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, 0)))
    ends = rows.groupBy(_KEY, _SLICE).agg(F.min("_at").alias("_first_at"), F.max("_begin").alias("_last_begin"),
                                          F.min_by("_cur", "_at").alias("_first"), F.max_by("_cur", "_at").alias("_final"))
    chain = W.partitionBy(_KEY).orderBy(_SLICE)
    ends = ends.withColumn("_goes_on", ~new(F.lag("_final").over(chain), F.col("_first")))
    own = F.when(~F.col("_goes_on") | (F.col("_last_begin") > F.col("_first_at")), F.col("_last_begin"))
    ends = ends.withColumn("_carried", F.last(own, ignorenulls=True).over(chain.rowsBetween(W.unboundedPreceding, -1)))
    linked = ends.where("_goes_on").select(_KEY, _SLICE, "_first_at", "_carried")
    out = rows.join(linked, [_KEY, _SLICE], "left")
    begin = F.when(F.col("_begin") == F.col("_first_at"), F.col("_carried"))
    return out.select(*[c for c in df.columns if c != name], F.coalesce(begin, "_begin").alias(name))


def next_match(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str,
               payload: Sequence[str], *, tie: str, name: str = "match", width: float = 600.0) -> DataFrame:
    """As-of join: the first right row at or after each left row, as a struct column.

    Both sides are stacked and read once in order, so no pair of rows is formed.
    """
    keys = list(keys)
    lrow = F.struct(*left.columns)
    both = (left.select(*keys, F.col(left_at).alias("_at"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_tie"),
                        lrow.alias("_l"), F.lit(None).alias("_r"))
            .unionByName(right.select(*keys, F.col(right_at).alias("_at"), F.lit(1).alias("_side"),
                                      F.col(tie).cast("long").alias("_tie"), F.lit(None).alias("_l"),
                                      F.struct(*payload).alias("_r"))))
    out = scan(both, keys, "_at", ties=("_side", "_tie"), following={name: F.col("_r")}, width=width)
    return out.where(F.col("_side") == 0).select("_l.*", name)


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], *, bucket: float = 30.0,
                start: str = "start", end: str = "end", right_start: str = "r_start",
                right_end: str = "r_end") -> DataFrame:
    """Pairs of intervals that share time.

    Both sides are copied to the time buckets they touch and joined on
    (keys, bucket); a pair is kept only in the bucket where it begins.
    """
    def spread(df, a, b):
        lo, hi = F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(a), F.col(b)) / bucket)
        return df.withColumn("_bucket", F.explode(F.sequence(lo, hi)))

    pair = spread(left, start, end).join(spread(right, right_start, right_end), [*keys, "_bucket"])
    begins = F.greatest(F.col(start), F.col(right_start))
    return (pair.where(begins < F.least(F.col(end), F.col(right_end)))
            .where(F.col("_bucket") == F.floor(begins / bucket)).drop("_bucket"))


def ordered_join(text: str | Column, by: str | Column, sep: str) -> Column:
    """Aggregate: texts in order, joined by ``sep``; null when every text is null."""
    text = F.col(text) if isinstance(text, str) else text
    by = F.col(by) if isinstance(by, str) else by
    parts = F.collect_list(F.when(text.isNotNull(), F.struct(by.alias("p"), text.alias("t"))))
    return F.when(F.size(parts) > 0, F.array_join(F.transform(F.array_sort(parts), lambda x: x["t"]), sep))
