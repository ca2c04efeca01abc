"""Connected components by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def _print_of(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.hash("hi", "lo").cast("long"))).first()
    return tuple(r)


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reached) for the nodes of ``links`` (``a``, ``b``) that are not roots themselves.

    Every round ties neighbours to their smallest neighbour, first the larger ones and then the smaller ones, until
    nothing changes: a logarithmic number of rounds in practice. Groups are only ever read through partial sums and
    joins that adaptive execution can split.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    last = None
    while (now := _print_of(edges)) != last:
        last = now
        if now[0] == 0:
            break
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        first = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(first, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .union(first.select("hi", F.col("m").alias("lo"))).distinct())
        edges = cut_lineage(small)
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
