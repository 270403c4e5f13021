"""Neighbourhood and graph operators on lattice cells: stencils and components by dense cubes, joins of what crosses their faces."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.operators import tiles
from gridscore.operators.components import connected_components
from gridscore.operators.order import quantiles
from gridscore.operators.topk import keep_top
from gridscore.session import stored

CELL = ["i", "j", "k"]


def gaussian_taps(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """(offset, weight) of a sampled Gaussian up to truncate deviations, summing to 1."""
    r = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (x / sigma) ** 2) if sigma > 0 else float(x == 0) for x in range(-r, r + 1)]
    return [(x, w / sum(raw)) for x, w in zip(range(-r, r + 1), raw, strict=True)]


def _convolved(x: np.ndarray, sigmas: tuple[float, float, float]) -> np.ndarray:
    for axis, sigma in enumerate(sigmas):
        x = sum(w * (tiles.shifted(x, axis, by, 0.0) if by else x) for by, w in gaussian_taps(sigma))
    return x


def _reached(x: np.ndarray, sigmas: tuple[float, float, float]) -> np.ndarray:
    for axis, sigma in enumerate(sigmas):
        x = np.logical_or.reduce([tiles.shifted(x, axis, by, False) if by else x for by, _ in gaussian_taps(sigma)])
    return x


def smooth(df: DataFrame, keys: list[str], sigmas: tuple[float, float, float], masked: bool = True, shape: tuple[int, int, int] | None = None, value: str = "value") -> DataFrame:
    """keys, cell and value of a Gaussian over cells, worked out cube by cube (tiles.stencil).

    Absent cells count as 0. masked: results stay where the input was positive, and weights beyond the lattice are lost;
    else results spread, mirrored at the edges of `shape`.
    """
    reach = max(by for sigma in sigmas for by, _ in gaussian_taps(sigma))

    def step(x: np.ndarray, there: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if masked:
            return tiles.inner(_convolved(x, sigmas), reach), tiles.inner(there & (x > 0), reach)
        if shape:
            inside = tiles.within(first, shape, x.shape[1])
            x, there = tiles.mirrored(x, first, shape), tiles.mirrored(there, first, shape)
            return tiles.inner(_convolved(x, sigmas), reach), tiles.inner(_reached(there, sigmas) & inside, reach)
        return tiles.inner(_convolved(x, sigmas), reach), tiles.inner(_reached(there, sigmas), reach)

    return tiles.stencil(df, keys, reach, step, value)


def blend_smooth(df: DataFrame, keys: list[str], sigmas: tuple[float, float, float], share: float = 0.15, value: str = "value") -> DataFrame:
    """(1 - share) of the value and share of its masked Gaussian."""
    soft = smooth(df, keys, sigmas, value=value).withColumnRenamed(value, "_s")
    return df.where(F.col(value) > 0).join(soft, [*keys, *CELL]).withColumn(value, (1 - share) * F.col(value) + share * F.col("_s")).drop("_s")


def bilateral(df: DataFrame, keys: list[str], shape: tuple[int, int, int], sigma: float = 2.0, intensity: float = 0.1, value: str = "value") -> DataFrame:
    """Value and its Gaussian blended by exp(-difference^2 / 2 intensity^2)."""
    soft = smooth(df, keys, (sigma,) * 3, masked=False, shape=shape, value=value).withColumnRenamed(value, "_s")
    d = F.col(value) - F.col("_s")
    w = F.exp(-d * d / (2 * intensity**2))
    return df.join(soft, [*keys, *CELL]).withColumn(value, F.col(value) * (1 - w) + F.col("_s") * w).drop("_s")


def _grown(x: np.ndarray) -> np.ndarray:
    """Cells and their six neighbours."""
    return np.logical_or.reduce([x, *[tiles.shifted(x, axis, by, False) for axis in range(3) for by in (-1, 1)]])


def _shrunk(x: np.ndarray) -> np.ndarray:
    """Cells all of whose six neighbours are cells."""
    return np.logical_and.reduce([x, *[tiles.shifted(x, axis, by, False) for axis in range(3) for by in (-1, 1)]])


def _morphed(cells: DataFrame, keys: list[str], steps: str, shape: tuple[int, int, int] | None) -> DataFrame:
    """keys and cells after steps, each a letter: g grows within `shape`, G beyond it too, s shrinks. All in one exchange."""

    def step(x: np.ndarray, there: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = tiles.within(first, shape, x.shape[1]) if shape else True
        for letter in steps:
            there = _shrunk(there) if letter == "s" else _grown(there) & (inside if letter == "g" else True)
        return tiles.inner(x, len(steps)), tiles.inner(there, len(steps))

    return tiles.stencil(cells.select(*keys, *CELL, F.lit(1.0).alias("_v")), keys, len(steps), step, "_v").drop("_v")


def dilate(cells: DataFrame, keys: list[str], shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Cells (keys, i, j, k) and their six neighbours, within shape."""
    return _morphed(cells, keys, "g", shape)


def erode(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells all of whose six neighbours are cells; the lattice's edge counts as outside."""
    return _morphed(cells, keys, "s", None)


def clean_mask(df: DataFrame, keys: list[str], shape: tuple[int, int, int], share: float = 0.30, value: str = "value") -> DataFrame:
    """Rows whose cell is in the mask above the quantile `share` of positive values, after opening, closing and dilation."""
    df = stored(df, "raw")
    cut = quantiles(df.where(F.col(value) > 0), keys, value, {"_cut": share})
    mask = df.join(cut, keys).where(F.col(value) > F.col("_cut"))
    # opening; closing, which must not lose cells at the lattice's edge for want of neighbours there, so it may grow
    # beyond and back; dilation
    return df.join(_morphed(mask, keys, "sgGsg", shape), [*keys, *CELL], "left_semi")


def maximum(df: DataFrame, keys: list[str], value: str = "value", shape: tuple[int, int, int] | None = None) -> DataFrame:
    """keys, cell and the largest value among each cell's 27, for every cell that has one near; absent cells don't count."""

    def step(x: np.ndarray, there: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = tiles.within(first, shape, x.shape[1]) if shape else True
        for axis in range(3):
            x = np.maximum.reduce([x, *[tiles.shifted(x, axis, by, -np.inf) for by in (-1, 1)]])
            there = np.logical_or.reduce([there, *[tiles.shifted(there, axis, by, False) for by in (-1, 1)]])
        return tiles.inner(x, 1), tiles.inner(there & inside, 1)

    return tiles.stencil(df, keys, 1, step, value, most=True)


def _labels(there: np.ndarray) -> np.ndarray:
    """For each cell of m cubes the smallest place in its cube that it is joined to by 6-neighbour steps, by hooking and
    pointer jumping; cells that aren't there have the cube's size."""
    m, size = len(there), there.shape[1]
    none = size**3
    label = np.where(there, np.arange(none).reshape(1, size, size, size), none)
    while True:
        least = np.minimum.reduce([label, *[tiles.shifted(label, axis, by, none) for axis in range(3) for by in (-1, 1)]])
        least = np.where(there, least, none).reshape(m, none)
        padded = np.concatenate([least, np.full((m, 1), none)], axis=1)
        least = np.minimum(least, np.take_along_axis(padded, least, axis=1)).reshape(label.shape)
        if (least == label).all():
            return label
        label = least


def _labelled(cubes: DataFrame, keys: list[str], size: int) -> DataFrame:
    """cubes (with _id) with `label`, a long for each of their cells: alike within a cube's component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, tiles.AT_ONCE):
                batch = whole.slice(k, tiles.AT_ONCE)
                lists, ids = batch.column(batch.schema.get_field_index("at")), batch.column(batch.schema.get_field_index("_id")).to_numpy()
                at, counts = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
                rows = np.repeat(np.arange(len(ids)), counts)
                there = np.zeros((len(ids), size**3), dtype=bool)
                there[rows, at] = True
                found = _labels(there.reshape(-1, size, size, size)).reshape(len(ids), -1)[rows, at] + ids[rows] * size**3
                label = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(found, pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, label], names=[*batch.schema.names, "label"])

    return cubes.mapInArrow(run, T.StructType([*cubes.schema.fields, T.StructField("label", T.ArrayType(T.LongType()))]))


def components(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cell, component (the smallest cell code of the group reachable by 6-neighbour steps) and its size.

    Cells are joined cube by cube inside tasks; only what meets across the cubes' faces becomes an edge between two
    cubes' components, each pair once, and goes to star contraction. So what is shuffled and stored in its rounds falls
    with the faces, not with the cells.
    """
    size = tiles.SIZE
    cubes = tiles.packed(df.select(*keys, *CELL).distinct().withColumn("_v", F.lit(0.0)), keys, "_v", size).drop("v")
    cubes = stored(_labelled(stored(cubes.withColumn("_id", F.monotonically_increasing_id()), "cubes"), keys, size), "labelled")
    place = [F.expr(f"_{c} * {size} + x.at div {size ** (2 - n)} % {size}").cast("int").alias(c) for n, c in enumerate(CELL)]
    cells = cubes.select(*keys, *[f"_{c}" for c in CELL], F.explode(F.arrays_zip("at", "label")).alias("x")).select(*keys, *place, F.col("x.label").alias("label"))
    low, high = ([cells.where(F.pmod(F.col(c), F.lit(size)) == edge) for c in CELL] for edge in (0, size - 1))
    seams = [a.withColumn(c, F.col(c) + 1).withColumnRenamed("label", "src").join(b.withColumnRenamed("label", "dst"), [*keys, *CELL]).select("src", "dst") for c, a, b in zip(CELL, high, low, strict=True)]
    joined = connected_components(stored(reduce(DataFrame.unionByName, seams).distinct(), "seams"))
    own = cells.groupBy("label").agg(F.count("*").alias("_cells"), F.min(F.struct(*keys, *CELL)).alias("_code"))
    rooted = stored(own.join(joined, own["label"] == joined["node"], "left").select("label", "_cells", "_code", F.coalesce("component", "label").alias("_root")), "rooted")
    groups = rooted.groupBy("_root").agg(F.min("_code").alias("component"), F.sum("_cells").alias("size"))
    found = rooted.join(groups, "_root").select("label", "component", "size")
    return cells.join(found, "label").select(*keys, *CELL, "component", "size")


def drop_small(df: DataFrame, keys: list[str], least: int, floor_share: float = 0.5, floor_least: int = 0, value: str = "value") -> DataFrame:
    """Active cells (value > 0) of components of at least `least` cells; where fewer than max(floor_share of the active
    cells, floor_least) remain, the largest values are brought back up to that number, ties included."""
    active = df.where(F.col(value) > 0)
    sized = active.join(components(active, keys).drop("component"), [*keys, *CELL])
    counts = sized.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum((F.col("size") >= least).cast("long")).alias("_left"))
    floor = F.least(F.greatest(F.floor(floor_share * F.col("_n")), F.lit(floor_least)), F.col("_n"))
    rows = sized.join(counts, keys).withColumn("_floor", floor)
    topped = keep_top(rows.withColumn("_v", F.col(value)), keys, F.col("_floor"), "_v")
    kept = (F.col("size") >= least) | ((F.col("_left") < F.col("_floor")) & (F.col("_v") > 0))
    return topped.where(kept).drop("_n", "_left", "_floor", "_v", "size")


def min_cells(cubic_mm: float, spacing: float = 2.0, least: int = 8) -> int:
    return max(least, int(cubic_mm / spacing**3))


def scatter(df: DataFrame, keys: list[str], order: str = "voxel_id", value: str = "value") -> DataFrame:
    """keys, cell and value: of several voxels in one cell the last in `order` stays; voxels off the lattice (null index) go."""
    return df.where("i is not null and j is not null and k is not null").groupBy(*keys, *CELL).agg(F.max_by(value, order).alias(value))
