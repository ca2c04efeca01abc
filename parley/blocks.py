"""All-against-all vector work in bounded cells.

Comparing every vector of a group with every other one is quadratic, but it
does not need a row per pair. Each side of a group is split by hash into blocks
of at most ``BLOCK_ROWS`` vectors; a cell is one left block against one right
block, multiplied as matrices inside a task, and only what the caller reduces
it to leaves the cell. A usual group is one cell; a huge one is many.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
STRIP_ROWS = 512
BROADCAST_BYTES = 64 << 20


def matrix(table: pa.Table | pa.RecordBatch, column: str = "embedding") -> np.ndarray:
    """Rows of a list column as unit vectors of doubles; zero rows stay zero."""
    c = table.column(column)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    if isinstance(c, pa.ChunkedArray):
        c = c.chunk(0)
    flat = np.asarray(c.flatten(), dtype=np.float64)
    m = flat.reshape(len(c), -1) if len(c) else flat.reshape(0, 0)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n > 0, n, 1.0)


def strips(left: np.ndarray, right: np.ndarray):
    """Similarity matrix a few rows at a time."""
    for at in range(0, len(left), STRIP_ROWS):
        yield at, left[at:at + STRIP_ROWS] @ right.T


def cells(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str,
          kernel: Callable, schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Run ``kernel(key, left_table, right_table)`` on every cell of every group.

    Both sides are shuffled by (group, left block, right block). The number of
    blocks follows the counted size of the group, so no cell outgrows a task.
    Without keys all rows are one group, counted beforehand: nothing is joined.
    """
    def blocks_of(df, name):
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))

    # Fresh column identities, since both sides often come from one table.
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    if keys:
        grid = blocks_of(left, "_nl").join(blocks_of(right, "_nr"), list(keys))
        left, right = left.join(grid, list(keys)), right.join(grid, list(keys))
    else:
        nl, nr = (F.lit(max(1, -(-df.count() // block_rows))) for df in (left, right))
        left, right = (df.withColumn("_nl", nl).withColumn("_nr", nr) for df in (left, right))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    zero_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lt = left.withColumn("_i", at(left_id, "_nl")).withColumn("_j", zero_to("_nr")).drop("_nl", "_nr")
    rt = right.withColumn("_j", at(right_id, "_nr")).withColumn("_i", zero_to("_nl")).drop("_nl", "_nr")
    lt, rt = lt.toDF(*lt.columns), rt.toDF(*rt.columns)
    cell = [*keys, "_i", "_j"]
    return lt.groupBy(*cell).cogroup(rt.groupBy(*cell)).applyInArrow(kernel, schema)


def fits_broadcast(df: DataFrame, dims: int, limit: int = BROADCAST_BYTES) -> bool:
    """Is a vector table, counted now, small enough to ship to every task?"""
    most = limit // (dims * 8 + 64)
    return df.select(F.lit(1)).limit(most + 1).count() <= most
