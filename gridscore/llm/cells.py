"""Rows that share a cell are compared in blocks of bounded size; what comes out is linear in the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscore.session import stored


def dealt_in_blocks(rows: DataFrame, cell: list[str], tie: str, block: int, slim: DataFrame | None = None) -> DataFrame:
    """Rows sorted by block within partitions, each block at most about 2 x `block` rows of one cell.

    A cell of up to `block` rows is one block. A larger cell is cut by the hash of `tie` into c chunks, and each row
    goes to the c pairs of chunks that hold its own, so that every two rows of the cell meet in some block whatever
    the cell's size, and no task holds more than a block. Adds `_chunk`, `_i` and `_j`; two rows of one chunk meet in
    several blocks and are compared where `_i` = `_j`. Cells are counted on `slim`, the same rows with fewer columns.
    """
    large = (rows if slim is None else slim).groupBy(*cell).count().where(F.col("count") > block).select(*cell, F.ceil(F.col("count") / block).alias("_chunks"))
    large = stored(large, "large")  # at most one cell for `block` rows: Spark sees the size, and only a large table is shuffled
    joined = rows.join(large, cell, "left")
    chunk = F.when(F.col("_chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64(tie), F.col("_chunks"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("_chunks", F.lit(1)).cast("int") - 1))
    pairs = joined.withColumn("_chunk", chunk).withColumn("_other", other)
    pairs = pairs.withColumn("_i", F.least("_chunk", "_other")).withColumn("_j", F.greatest("_chunk", "_other")).drop("_chunks", "_other")
    key = [*cell, "_i", "_j"]
    return pairs.repartition(*key).sortWithinPartitions(*key)


def by_block(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole blocks, with the bounds of each, from batches that are sorted by block."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        bounds = _bounds(rest, key)
        if len(bounds) > 2:
            yield rest.slice(0, bounds[-2]).combine_chunks(), bounds[:-1]
            rest = rest.slice(bounds[-2])
    if rest is not None and len(rest):
        yield rest.combine_chunks(), _bounds(rest, key)


def _bounds(table: pa.Table, key: list[str]) -> np.ndarray:
    if not len(table):
        return np.array([0])
    new = np.zeros(len(table) - 1, dtype=bool)
    for k in key:
        column = table.column(k).to_numpy()
        new |= column[1:] != column[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(table)]])


def small_pairs(bounds: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b), a < b, of all pairs of rows within the blocks of up to `most` rows."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    end = bounds[1:][owner]
    fits = sizes[owner] <= most
    at = np.flatnonzero(fits & (np.arange(len(owner)) + 1 < end))
    left, right, shift = [], [], 1
    while len(at):
        left.append(at)
        right.append(at + shift)
        shift += 1
        at = at[at + shift < end[at]]
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest(left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, root) of each row that links to a smaller id, from links between positions; root: its group's smallest id."""
    if not len(left):
        return np.empty(0, ids.dtype), np.empty(0, ids.dtype)
    names, place = np.unique(ids, return_inverse=True)
    a, b = place[left], place[right]
    label = np.arange(len(names))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]
