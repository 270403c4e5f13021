"""Stencils over a lattice by dense tiles: neighbours' faces come in one exchange, and a tile is worked on as one array.

Cells are packed into cubes of SIZE cells a side (one shuffle of cells); each cube sends the cells near its faces, edges and
corners to the cubes that need them (at most 26 short rows a cube, one shuffle of cubes); then a step of any number of taps
is a sum of shifted arrays inside the task. So what is shuffled doesn't grow with the taps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = ["i", "j", "k"]
SIZE = 8
#: Cubes, with their surroundings, that are worked on in one go.
AT_ONCE = 64

#: (values, which cells are there, the first cell's indices) of m cubes with `reach` cells around each, to (values, which
#: cells to return) of the cubes alone.
Step = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def packed(df: DataFrame, keys: list[str], value: str, size: int) -> DataFrame:
    """keys, the cube's indices, and the places within it (`at`) and values (`v`) of its cells."""
    cube = [F.floor(F.col(c) / size).cast("int").alias(f"_{c}") for c in CELL]
    at = sum(((F.pmod(F.col(c), F.lit(size)) * size ** (2 - n)) for n, c in enumerate(CELL)), F.lit(0)).cast("int")
    rows = df.where(" and ".join(f"{c} is not null" for c in CELL)).select(*keys, *cube, F.struct(at.alias("at"), F.col(value).cast("double").alias("v")).alias("x"))
    return rows.groupBy(*keys, *[f"_{c}" for c in CELL]).agg(F.collect_list("x").alias("x")).select(*keys, *[f"_{c}" for c in CELL], F.col("x.at").alias("at"), F.col("x.v").alias("v"))


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def surrounded(cubes: DataFrame, keys: list[str], reach: int, size: int) -> DataFrame:
    """keys, the cube's indices, and the places (`at`, within the cube and `reach` cells around it) and values of the cells
    there; also for cubes without cells of their own that others reach into."""
    wide, n = size + 2 * reach, len(keys)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.repeat(np.arange(batch.num_rows), batch.column(n + 3).value_lengths().to_numpy())
            at, v = batch.column(n + 3).flatten().to_numpy(), batch.column(n + 4).flatten().to_numpy(zero_copy_only=False)
            local = [at // size**2, at // size % size, at % size]
            for step in product((-1, 0, 1), repeat=3):
                near = np.ones(len(at), dtype=bool)
                for x, o in zip(local, step, strict=True):
                    near &= (x >= size - reach) if o > 0 else (x < reach) if o < 0 else True
                chosen = np.flatnonzero(near)
                if not len(chosen):
                    continue
                # where the cell lies as the receiving cube counts
                a, b, c = (x[chosen] - o * size + reach for x, o in zip(local, step, strict=True))
                to, counts = np.unique(rows[chosen], return_counts=True)
                columns = [batch.column(k).take(pa.array(to)) for k in range(n)]
                columns += [pa.array(batch.column(n + k).to_numpy()[to] + o, pa.int32()) for k, o in enumerate(step)]
                columns += [_lists(counts, ((a * wide + b) * wide + c).astype(np.int32), pa.int32()), _lists(counts, v[chosen], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    sent = cubes.mapInArrow(send, cubes.schema)
    gathered = sent.groupBy(*keys, *[f"_{c}" for c in CELL]).agg(F.collect_list(F.struct("at", "v")).alias("x"))
    return gathered.select(*keys, *[f"_{c}" for c in CELL], F.flatten("x.at").alias("at"), F.flatten("x.v").alias("v"))


def stencil(df: DataFrame, keys: list[str], reach: int, step: Step, value: str = "value", size: int = SIZE, most: bool = False) -> DataFrame:
    """keys, i, j, k and value of the cells that `step` returns. Rows of one cell are added up (most: the largest counts).

    Null values count as absent cells.
    """
    size = max(size, reach)
    wide, n = size + 2 * reach, len(keys)
    around = surrounded(packed(df.where(F.col(value).isNotNull()), keys, value, size), keys, reach, size)
    schema = T.StructType([*[around.schema[k] for k in keys], *[T.StructField(c, T.IntegerType()) for c in CELL], T.StructField(value, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(k, AT_ONCE)
                m = batch.num_rows
                rows = np.repeat(np.arange(m), batch.column(n + 3).value_lengths().to_numpy())
                at, v = rows * wide**3 + batch.column(n + 3).flatten().to_numpy(), batch.column(n + 4).flatten().to_numpy()
                values, there = np.full(m * wide**3, -np.inf if most else 0.0), np.zeros(m * wide**3, dtype=bool)
                (np.maximum if most else np.add).at(values, at, v)
                there[at] = True
                cubes = np.stack([batch.column(n + c).to_numpy() for c in range(3)], 1) * size
                out, kept = step(values.reshape(m, wide, wide, wide), there.reshape(m, wide, wide, wide), cubes - reach)
                row, *cell = np.nonzero(kept)
                columns = [batch.column(c).take(pa.array(row)) for c in range(n)]
                columns += [pa.array((x + cubes[row, c]).astype(np.int32)) for c, x in enumerate(cell)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out[kept])], names=schema.names)

    return around.mapInArrow(run, schema)


def places(first: np.ndarray, axis: int, wide: int) -> np.ndarray:
    """Indices along an axis (0 to 2) of blocks of `wide` cells that begin at `first`, to be broadcast against them."""
    shape = [len(first), 1, 1, 1]
    shape[axis + 1] = wide
    return (first[:, axis, None] + np.arange(wide)).reshape(shape)


def within(first: np.ndarray, shape: tuple[int, int, int], wide: int) -> np.ndarray:
    """Which cells of the blocks lie on the lattice."""
    inside = [(places(first, a, wide) >= 0) & (places(first, a, wide) < n) for a, n in enumerate(shape)]
    return inside[0] & inside[1] & inside[2]


def inner(x: np.ndarray, reach: int) -> np.ndarray:
    """Blocks without `reach` cells on every side."""
    return x[:, reach : x.shape[1] - reach, reach : x.shape[2] - reach, reach : x.shape[3] - reach] if reach else x


def shifted(x: np.ndarray, axis: int, by: int, empty: float | bool) -> np.ndarray:
    """x moved by some cells along an axis (0 to 2), `empty` where nothing comes from."""
    out = np.full_like(x, empty)
    to, of = [slice(None)] * 4, [slice(None)] * 4
    to[axis + 1], of[axis + 1] = (slice(by, None), slice(None, -by)) if by > 0 else (slice(None, by), slice(-by, None))
    out[tuple(to)] = x[tuple(of)]
    return out


def mirrored(x: np.ndarray, first: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """Blocks whose cells beyond the lattice repeat those within, edge cells included."""
    for axis, n in enumerate(shape):
        at = first[:, axis, None] + np.arange(x.shape[axis + 1])
        back = np.where((m := at % (2 * n)) >= n, 2 * n - 1 - m, m) - first[:, axis, None]
        # cells so far out that their image isn't in the block aren't needed by any cell on the lattice
        back = np.clip(back, 0, x.shape[axis + 1] - 1)
        x = np.take_along_axis(x, back.reshape([len(x), *[x.shape[axis + 1] if a == axis else 1 for a in range(3)]]), axis=axis + 1)
    return x
