"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry c counts as floor(SCALE * c) + OFFSET; components returned; entries beyond LARGEST take no part.
SCALE, OFFSET, COMPONENTS, LARGEST = 64, 1_000_000, 32, float(1 << 31)
#: Rows worked on at once; a pivot below this share of the first, for each dimension, ends the factor.
ROWS, LEAST = 1024, 2.0**-52
#: Columns of a factor count as orthogonal below this cosine; sweeps over all pairs at most.
COSINE, SWEEPS = 1e-15, 60


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L @ L.T, L lower triangular with as many columns as the rank; the largest
    remaining diagonal entry is the next pivot, the first of equal ones."""
    rest, d = np.array(a, dtype=np.float64), len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    first = float(rest.diagonal().max()) if d else 0.0
    for k in range(d):
        p = k + int(np.argmax(rest.diagonal()[k:]))
        if not rest[p, p] > first * d * LEAST:
            return factor[:, :k], order
        for x in (order, factor, rest, rest.T):
            x[[k, p]] = x[[p, k]]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1 :, k] = rest[k + 1 :, k] / factor[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor with its columns turned, in pairs, until all are orthogonal; its product with its transpose stays.

    The pairs of a sweep go in rounds, as in a tournament, so that a round's rotations touch disjoint columns.
    """
    u = np.array(factor, dtype=np.float64)
    r = u.shape[1]
    players = np.arange(r + r % 2)
    for _ in range(SWEEPS if r > 1 else 0):
        worst = 0.0
        for _ in range(len(players) - 1):
            i, j = players[: len(players) // 2], players[: len(players) // 2 - 1 : -1]
            real = (i < r) & (j < r)
            i, j = i[real], j[real]
            a, b, g = (u[:, i] ** 2).sum(0), (u[:, j] ** 2).sum(0), (u[:, i] * u[:, j]).sum(0)
            cosine = np.abs(g) / np.sqrt(a * b)
            worst = max(worst, float(cosine.max()))
            turn = cosine > COSINE
            i, j, a, b, g = i[turn], j[turn], a[turn], b[turn], g[turn]
            zeta = (b - a) / (2 * g)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            x, y = u[:, i], u[:, j]
            u[:, i], u[:, j] = c * (x - t * y), c * (y + t * x)
            players = np.concatenate([players[:1], players[-1:], players[1:-1]])
        if worst <= COSINE * 10:
            break
    return u


@dataclass
class Whitening:
    """n fitted vectors with sums S = n * centre + rest; eigenvalues of their covariance, falling, with their vectors in columns."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, without the rounding that large x would bring."""
        return (x - self.centre) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S) squared, exact; null where they exceed a long."""
        y = x - self.centre
        most = self.n * int(np.abs(y).max(initial=0)) + int(np.abs(self.rest).max(initial=0))
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * y - self.rest) ** 2).sum(1).tolist()
        exact = ((self.n * y.astype(object) - self.rest.astype(object)) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def fitted(vector: Column) -> Column:
    """Whether a vector takes part: it has entries, none of them null, not finite or beyond LARGEST."""
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST)), F.lit(False))


def _blocks(column: pa.Array, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix of longs) of up to ROWS vectors at a time."""
    for k in range(0, len(column), ROWS):
        part = column.slice(k, ROWS)
        yield k, np.floor(part.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64).reshape(-1, dims) + OFFSET


def _summed(rows: DataFrame, made, width: int) -> list[np.ndarray]:
    """Sums over all tasks of the matrix that `made` gives for each block of rows: a task sends one matrix, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _blocks(batch.column(0), width):
                total = made(x) if total is None else total + made(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    each = rows.mapInArrow(run, "i int, row array<double>").withColumn("v", array_to_vector("row"))
    found = each.groupBy("i").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("row")).orderBy("i").collect()
    return [np.array(r.row) for r in found]


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fit on all vectors of df of the commonest length (ties: the longer) that take part; None without any.

    Three scans: exact sums, the centred scatter, and the covariance of the whitened vectors, which tells how far it is
    from the identity. Tasks send a matrix of dimensions x dimensions each, which Spark sums; two come to the driver,
    whatever the number of rows. Components end where the covariance's rank does.
    """
    sizes = df.where(fitted(F.col(vector))).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return None
    d, n = sizes.d, sizes.n
    rows = _taking_part(df, vector, d).select(vector)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, dtype=np.int64)
        for batch in batches:
            for _, x in _blocks(batch.column(0), d):
                total += (x - OFFSET).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total)], names=["i", "s"])

    # decimal sums: those of many large entries exceed a long
    total = [int(r.s) + n * OFFSET for r in rows.mapInArrow(sums, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()]
    centre = np.array([(2 * s + n) // (2 * n) for s in total], dtype=np.int64)
    rest = np.array([s - n * int(c) for s, c in zip(total, centre, strict=True)], dtype=np.int64)
    model = Whitening(n, centre, rest, np.empty(0), np.empty((d, 0)), 0.0)

    def scatter(x: np.ndarray) -> np.ndarray:
        y = model.centred(x)
        return y.T @ y

    covariance = np.array(_summed(rows, scatter, d)) / n
    factor, order = pivoted_cholesky(covariance)
    turned = one_sided_jacobi(factor)
    values = (turned * turned).sum(0)
    falling = np.argsort(-values, kind="stable")[:components]
    vectors = np.empty((d, len(falling)))
    vectors[order] = turned[:, falling] / np.sqrt(values[falling])
    model.values, model.vectors, model.trace = values[falling], vectors, float(covariance.trace())
    if len(falling):
        found = np.array(_summed(rows, lambda x: (z := model.whitened(x)).T @ z, d)) / n
        model.error = float(np.abs(found - np.eye(len(falling))).max())
    return model


def _taking_part(df: DataFrame, vector: str, dims: int) -> DataFrame:
    return df.where(fitted(F.col(vector)) & (F.size(vector) == dims))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each vector that takes part and component.

    Vectors that are null or empty, hold null or non-finite entries or entries beyond LARGEST, or are of another length
    than the commonest are left out; equal vectors, constant dimensions (they add no component) and repeated keys are
    fine; a null key stays null. Vectors that are all alike have no component, so no row; nor has an empty table. A
    deviation that exceeds a long is null. Other columns of df don't matter. Rows are whitened where they are.
    """
    model = fit(df, vector, components)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return df.select(key).limit(0).selectExpr(f"`{key}`", *[f"CAST(NULL AS {t}) AS {c}" for c, t in (x.split() for x in schema.split(", ")[1:])])
    d, k = model.vectors.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _blocks(batch.column(1), d):
                m = len(x)
                columns = [
                    batch.column(0).slice(at, m).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, model.error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _taking_part(df, vector, d).select(key, vector).mapInArrow(run, schema)
