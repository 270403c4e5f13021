"""Embedding near-dedup by a subspace pigeonhole join: near vectors are near in some block of rotated coordinates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscore.llm.cells import by_block, dealt_in_blocks, forest
from gridscore.operators.components import connected_components
from gridscore.session import stored

COSINE = 0.95
#: Blocks that the rotated coordinates are split into, and vectors that the rotation is fitted on at most.
BLOCKS, SAMPLE, SEED = 4, 2048, 42
#: What a row that is sent to a cell costs, in comparisons of two rows: it lies on disk until they are done. A grid is laid
#: over up to MOST coordinates.
ROW_COST, MOST = 40000, 8
#: Room for rounding in squared distances of unit vectors.
SLACK = 1e-6
#: Rows of a cell that one block of work holds at most, twice; and pairs that are looked at in one go.
CHUNK, AT_ONCE = 1 << 17, 1 << 15


@lru_cache(8)
def _rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


class _Space:
    """Where unit vectors of `dims` coordinates lie: their blocks, each with its share of the squared-distance budget.

    Any rotation gives the same links. This one puts the widest directions of `sample` first in the blocks, in turn, and
    each block's grid lies over its widest coordinates: as many as make the least work for `n` vectors.
    """

    def __init__(self, dims: int, cosine: float, sample: np.ndarray, n: int):
        blocks = min(BLOCKS, dims)
        if len(sample) >= 2 * dims:
            widest = np.linalg.eigh(np.cov(sample.T).reshape(dims, dims))[1][:, ::-1]
            self.rotation = np.ascontiguousarray(widest[:, np.argsort(np.arange(dims) % blocks, kind="stable")])
        else:
            self.rotation = _rotation(dims)
        sizes = [len(range(k, dims, blocks)) for k in range(blocks)]
        ends = np.cumsum(sizes).tolist()
        self.parts = [slice(end - size, end) for size, end in zip(sizes, ends, strict=True)]
        whole = 2 - 2 * cosine + SLACK
        self.budgets = [whole * size / dims for size in sizes]
        spread = (sample @ self.rotation).std(0) if len(sample) > 1 else np.full(dims, dims**-0.5)
        self.gridded = [self._gridded(spread[part], budget, n) for part, budget in zip(self.parts, self.budgets, strict=True)]

    @staticmethod
    def _radius(budget: float) -> tuple[float, int]:
        """The radius that cells are twice as wide as, and how many cells a coordinate of unit vectors has at most."""
        radius = budget**0.5 * (1 + 1e-9)
        return radius, 2 * math.ceil(0.5 / radius) + 5

    def _gridded(self, spread: np.ndarray, budget: float, n: int) -> int:
        """Coordinates to grid: each sends a row to two thirds more cells and leaves this share of the comparisons; a cell that
        is cut into chunks sends it to as many blocks."""
        radius, cells = self._radius(budget)
        most = max(1, min(len(spread), MOST, int(62 / math.log2(cells))))
        left = np.cumprod([math.erf(0.86 * radius / max(float(s), 1e-9)) for s in spread[:most]])
        sent = [1.68**g * max(1.0, n * left[g - 1] / (2 * CHUNK)) for g in range(1, most + 1)]
        return int(np.argmin([ROW_COST * sent[g - 1] + n * left[g - 1] for g in range(1, most + 1)])) + 1

    def rotated(self, unit: np.ndarray) -> np.ndarray:
        # a plain sum in fixed order: a row's coordinates are alike in whatever batch it comes
        return np.einsum("nd,de->ne", unit, self.rotation, optimize=False)

    def within(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """Rows of a and b whose k-th blocks are within its budget."""
        gap = a[:, self.parts[k]] - b[:, self.parts[k]]
        return (gap * gap).sum(1) <= self.budgets[k]

    def cells(self, rotated: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, home) of the cells of block k's grid that the rows lie in or, being later ones, reach into."""
        radius, cells = self._radius(self.budgets[k])
        x = rotated[:, self.parts[k]][:, : self.gridded[k]] / (2 * radius)
        home = np.floor(x).astype(np.int64)
        up = x - home >= 0.5
        # a radius is half a cell, so in each coordinate a row reaches into the nearer neighbour at most
        gap = np.where(up, home + 1 - x, x - home) * (2 * radius)
        unit = cells ** np.arange(x.shape[1], dtype=np.int64)
        code = (home + cells // 2) @ unit
        row, cell, left = np.arange(len(x)), code, np.full(len(x), radius**2 * (1 + 1e-9))
        for c in range(x.shape[1]):
            rest = left - gap[row, c] ** 2
            some = np.flatnonzero(rest >= 0)
            moved = row[some]
            row, cell = np.concatenate([row, moved]), np.concatenate([cell, cell[some] + np.where(up[moved, c], unit[c], -unit[c])])
            left = np.concatenate([left, rest[some]])
        kept = (np.arange(len(row)) < len(x)) | (cell > code[row])
        return row[kept], cell[kept], np.arange(len(row))[kept] < len(x)


#: Makes the space of vectors of so many coordinates.
Spaces = Callable[[int], _Space]


def _spaces(distinct: DataFrame, cosine: float) -> Spaces:
    """Spaces fitted on up to SAMPLE vectors of each frequent length, drawn by hash."""
    counts = {r.dims: r.n for r in distinct.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(8).collect()}
    known = {}
    for dims, n in counts.items():
        draw = F.pmod(F.xxhash64("vector", F.lit(SEED)), F.lit(1 << 32))
        drawn = distinct.where((F.col("dims") == dims) & (draw < int(min(1, 2 * SAMPLE / n) * (1 << 32)))).orderBy(draw, "uid").limit(SAMPLE)
        vectors = drawn.select("vector").toArrow()["vector"]
        known[dims] = _Space(dims, cosine, _matrix(vectors, dims) if len(vectors) else np.empty((0, dims)), n)
    return lambda dims: known[dims] if dims in known else _Space(dims, cosine, np.empty((0, dims)), 1)


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    scaled = values / np.abs(values).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _spread(batches: Iterator[pa.RecordBatch], spaces: Spaces, vectors: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("dims").to_numpy()
        for dims in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == dims))
            space = spaces(dims)
            rotated = space.rotated(_matrix(part.column("vector"), dims))
            kept = part if vectors else part.select(["dims"])
            for k in range(len(space.parts)):
                rows, cell, home = space.cells(rotated, k)
                for at in range(0, len(rows), 1 << 14):
                    taken = kept.take(pa.array(rows[at : at + (1 << 14)]))
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns, pa.array(np.full(len(taken), k, dtype=np.int32)), pa.array(cell[at : at + (1 << 14)]), pa.array(home[at : at + (1 << 14)])],
                        names=[*taken.schema.names, "block", "cell", "home"],
                    )


def _link(batches: Iterator[pa.RecordBatch], spaces: Spaces, cosine: float) -> Iterator[pa.RecordBatch]:
    for table, bounds in by_block(batches, ["dims", "block", "cell", "_i", "_j"]):
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if end - start > 1:
                yield from _link_block(table.slice(start, end - start), spaces, cosine)


def _link_block(table: pa.Table, spaces: Spaces, cosine: float) -> Iterator[pa.RecordBatch]:
    dims, k, pairwise = table["dims"][0].as_py(), table["block"][0].as_py(), table["_i"][0] != table["_j"][0]
    homes = table["home"].to_numpy()
    table = table.take(pa.array(np.argsort(~homes, kind="stable")))  # rows at home first: each meets the rows after it
    uid, weight, chunk = (table[c].to_numpy() for c in ("uid", "copies", "_chunk"))
    space, vectors = spaces(dims), table["vector"].combine_chunks()
    # vectors stay as they came, in single precision mostly; what the sieve looks at is worked out for all rows, the rest
    # for those of pairs that pass
    block = np.concatenate([_matrix(vectors.slice(at, AT_ONCE), dims) @ space.rotation[:, space.parts[k]] for at in range(0, len(vectors), AT_ONCE)])
    norms, ones = (block * block).sum(1), np.ones(len(block))
    # one product gives |x|^2 - 2 <x, y> + |y|^2; single precision sieves, and pairs that pass are looked at again
    left_side = np.column_stack([-2 * block, norms, ones]).astype(np.float32)
    right_side = np.column_stack([block, ones, norms]).astype(np.float32)
    links = np.zeros(len(uid), dtype=np.int64)
    left, right = [], []
    # tiles of about a million comparisons, which stay in a core's cache
    wide = min(len(uid), AT_ONCE)
    for start, other in product(range(0, int(homes.sum()), max(1, (1 << 20) // wide)), range(0, len(uid), wide)):
        stop = min(start + max(1, (1 << 20) // wide), int(homes.sum()))
        if other + wide <= start:
            continue
        near = left_side[start:stop] @ right_side[other : other + wide].T <= np.float32(space.budgets[k] + 1e-5)
        a, b = np.divmod(np.flatnonzero(near), near.shape[1])
        a, b = a + start, b + other
        once = a < b
        if pairwise:
            once &= chunk[a] != chunk[b]
        a, b = a[once], b[once]
        for begin in range(0, len(a), AT_ONCE):
            i, j = a[begin : begin + AT_ONCE], b[begin : begin + AT_ONCE]
            rows, places = np.unique(np.concatenate([i, j]), return_inverse=True)
            unit = _matrix(vectors.take(pa.array(rows)), dims)
            rotated, p, q = space.rotated(unit), places[: len(i)], places[len(i) :]
            # a pair belongs to the first block that it is near in, so it is counted once over all blocks
            own = space.within(rotated[p], rotated[q], k)
            for earlier in range(k):
                own[own] = ~space.within(rotated[p[own]], rotated[q[own]], earlier)
            own[own] = np.einsum("nd,nd->n", unit[p[own]], unit[q[own]]) >= cosine
            i, j = i[own], j[own]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            # of a dense group's links a forest is kept
            node, root = forest(i, j, np.arange(len(uid)))
            left.append(node)
            right.append(root)
    if not links.any():
        return
    node, root = forest(np.concatenate(left), np.concatenate(right), uid)
    some = np.flatnonzero(links)
    roots = uid[some].copy()
    order = np.argsort(node)
    place = np.minimum(np.searchsorted(node[order], roots), max(0, len(node) - 1))
    if len(node):
        roots = np.where(node[order][place] == roots, root[order][place], roots)
    yield pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.array(links[some]), pa.array(roots)], names=["uid", "links", "root"])


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """key, n_links, component_id and kept of each row of df, by all links at cosine similarity of at least `cosine`.

    Unit vectors at that cosine have a squared distance of 2 - 2 x cosine at most. After one rotation their coordinates
    are split into BLOCKS blocks; in one block at least the distance is within the block's proportional share, and each
    block's vectors are range-joined under that budget on a grid over some of its widest coordinates, more of them the
    more vectors there are: a vector is at home in its cell and visits the later cells that its radius reaches. Pairs
    near in a block are verified exactly in double precision; each link is counted in the first block that it is near
    in. Copies of a vector count as one with a weight until the end. What comes out of a cell is a count a vector and a
    spanning forest, never its pairs, and a large cell is compared in blocks of bounded size.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths; such a row is its own component. component_id is the smallest key reachable; kept: it is the
    row's own. Rows that repeat a key each count as a vector; an empty table gives no rows.
    """
    kind = df.schema[vector].dataType.elementType.simpleString()
    x = F.col("vector")
    plain = F.coalesce(F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v)), F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    rows = df.select(df[key].alias("key"), df[vector].alias("vector")).withColumn("valid", plain)
    distinct = stored(rows.where("valid").groupBy("vector").agg(F.min("key").alias("least"), F.count("*").alias("copies")).withColumn("uid", F.monotonically_increasing_id()).withColumn("dims", F.size("vector")), "vectors")
    slim = f"uid long, copies long, dims int, vector array<{kind}>"
    spaces = _spaces(distinct, cosine)
    homes = distinct.select("uid", "copies", "dims", "vector")
    spread = homes.mapInArrow(lambda b: _spread(b, spaces, True), f"{slim}, block int, cell long, home boolean")
    # the cells' sizes are counted on a second pass without the vectors, so that only the pass that is shuffled holds them
    cells = homes.mapInArrow(lambda b: _spread(b, spaces, False), "dims int, block int, cell long, home boolean")
    dealt = dealt_in_blocks(spread, ["dims", "block", "cell"], "uid", CHUNK, cells)
    found = stored(dealt.mapInArrow(lambda b: _link(b, spaces, cosine), "uid long, links long, root long"), "links")
    counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
    groups = connected_components(found, "uid", "root")
    labelled = distinct.join(counts, "uid", "left").join(groups, distinct.uid == groups.node, "left")
    labelled = stored(labelled.select("vector", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "uid").alias("group")), "labelled")
    names = labelled.groupBy("group").agg(F.min("least").alias("component_id"))
    named = stored(labelled.join(names, "group").select(F.col("vector").alias("like"), "n_links", "component_id"), "named")
    joined = rows.join(named, F.col("valid") & (F.col("vector") == F.col("like")), "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("key"))
    return joined.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
