"""Hard-negative mining over an inverted multi-index: cells of two half-space codebooks, visited in order of their bounds."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscore.session import stored

#: Vectors that the codebooks are fitted on at most, rounds of fitting, and the seed of the draw.
SAMPLE, ROUNDS, SEED = 8192, 12, 42
#: Rows that a cell should hold, and codewords of a half at most; a larger cell is stored in parts of PART rows or so.
CELL, CODEWORDS, PART = 512, 128, 2048
#: Anchors that search together, and rows that an anchor looks at before its first bound is set.
TOGETHER, FIRST = 256, 1024
#: Room for rounding in bounds.
SLACK = 1e-9


@dataclass
class Codebooks:
    """Codewords of both halves with the largest distance of a row to its codeword; rows by cell (first, second)."""

    halves: tuple[slice, slice]
    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    rows: np.ndarray

    def nearest(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For both halves: the nearest codeword of each row, and its distance."""
        at, far = [], []
        for half, words in zip(self.halves, self.words, strict=True):
            part = x[:, half]
            at.append(np.argmin((words * words).sum(1) - 2 * part @ words.T, axis=1))
            far.append(np.sqrt(((part - words[at[-1]]) ** 2).sum(1)))
        return at, far

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For both halves: the least and the largest product of x's half with any row of each codeword."""
        low, high = [], []
        for half, words, radii in zip(self.halves, self.words, self.radii, strict=True):
            middle, reach = words @ x[half], np.sqrt((x[half] ** 2).sum()) * radii
            room = SLACK * (1 + np.abs(middle) + reach)
            low.append(middle - reach - room)
            high.append(middle + reach + room)
        return low, high

    def visit(self, x: np.ndarray, least: float, most: float, enough: float = math.inf) -> list[int]:
        """Numbers of the cells that may hold a row whose product with x is within [least, most], by falling upper bound.

        Multi-sequence search: both halves' bounds are sorted and a heap gives the pair with the next largest sum; it
        ends once that is below `least`, which certifies all cells not visited, or once `enough` rows are found.
        """
        low, high = self.bounds(x)
        first, second = (np.argsort(-h, kind="stable").tolist() for h in high)
        out, found = [], 0
        heap = [(-(high[0][first[0]] + high[1][second[0]]), 0, 0)]
        while heap and found < enough:
            bound, i, j = heapq.heappop(heap)
            if -bound < least:
                break
            a, b = first[i], second[j]
            if self.rows[a, b] and low[0][a] + low[1][b] <= most:
                out.append(a * self.rows.shape[1] + b)
                found += int(self.rows[a, b])
            # each pair is pushed once: along the second half always, along the first from its first place
            if j + 1 < len(second):
                heapq.heappush(heap, (-(high[0][a] + high[1][second[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (-(high[0][first[i + 1]] + high[1][second[0]]), i + 1, 0))
        return out


def _codewords(x: np.ndarray, k: int) -> np.ndarray:
    """k means of the rows of x, from evenly spaced rows in order of their first differing direction."""
    words = x[np.linspace(0, len(x) - 1, k).astype(int)].astype(np.float64)
    for _ in range(ROUNDS):
        at = np.argmin((words * words).sum(1) - 2 * x @ words.T, axis=1)
        n = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, weights=column, minlength=k) for column in x.T], 1) if x.shape[1] else np.zeros((k, 0))
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integers: in doubles where they suffice, else in longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a @ b.T).astype(np.int64) if most < 2.0**53 else a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Index:
    """`table`: (cell, part, rows), each row (uid, key, label, v); every vector lies in one part of one cell."""

    table: DataFrame
    books: Codebooks
    parts: np.ndarray
    dims: int


def build(rows: DataFrame, dims: int, n: int) -> tuple[DataFrame, Index]:
    """(rows with their cell, the index): codebooks are fitted on up to SAMPLE rows by hash, radii and counts on all."""
    draw = F.pmod(F.xxhash64("v", F.lit(SEED)), F.lit(1 << 32))
    drawn = rows.where(draw < int(min(1, 2 * SAMPLE / n) * (1 << 32))).orderBy(draw, "uid").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sample = _matrix(drawn, dims)
    k = int(min(CODEWORDS, max(1, round(math.sqrt(n / CELL)))))
    halves = (slice(0, dims // 2), slice(dims // 2, dims))
    words = tuple(_codewords(sample[:, h], k) if len(sample) else np.zeros((1, h.stop - h.start)) for h in halves)
    books = Codebooks(halves, words, (), np.empty(0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, far = books.nearest(_matrix(batch.column(batch.schema.get_field_index("v")), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(a.astype(np.int32)) for a in at], *[pa.array(f) for f in far]], names=[*batch.schema.names, "first", "second", "far1", "far2"])

    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    placed = stored(rows.mapInArrow(assign, f"{kinds}, first int, second int, far1 double, far2 double"), "placed")
    count = np.zeros((len(words[0]), len(words[1])), dtype=np.int64)
    radii = [np.zeros(len(w)) for w in words]
    for r in placed.groupBy("first", "second").agg(F.count("*").alias("n"), F.max("far1").alias("a"), F.max("far2").alias("b")).collect():  # CODEWORDS squared at most
        count[r.first, r.second] = r.n
        radii[0][r.first], radii[1][r.second] = max(radii[0][r.first], r.a), max(radii[1][r.second], r.b)
    books.rows, books.radii = count, tuple(radii)
    parts = np.maximum(1, -(-count // PART)).ravel()
    placed = placed.drop("far1", "far2").withColumn("cell", F.col("first") * count.shape[1] + F.col("second"))
    ways = rows.sparkSession.createDataFrame([(c, int(p)) for c, p in enumerate(parts)], "cell int, ways int")  # a row a cell
    part = F.pmod(F.xxhash64("uid"), F.col("ways")).cast("int").alias("part")
    packed = placed.join(F.broadcast(ways), "cell").groupBy("cell", part).agg(F.collect_list(F.struct("uid", "key", "label", "v")).alias("rows"))
    return placed, Index(stored(packed, "index"), books, parts, dims)


def _chunks(anchors: DataFrame) -> DataFrame:
    """(anchors) in rows of TOGETHER or so; anchors of near cells are together."""
    counts = sorted(anchors.groupBy("cell").count().collect())
    ends = np.cumsum([r["count"] for r in counts])
    starts = {r.cell: int(end - r["count"]) for r, end in zip(counts, ends, strict=True)}
    spark = anchors.sparkSession
    place = spark.createDataFrame([(c, s // TOGETHER, 1 + int(r["count"]) // TOGETHER) for (c, s), r in zip(starts.items(), counts, strict=True)], "cell int, at long, ways int")
    keyed = anchors.join(F.broadcast(place), "cell")  # a row for each cell, CODEWORDS squared at most
    return keyed.groupBy(F.col("at"), F.pmod(F.xxhash64("uid"), F.col("ways")).alias("way")).agg(F.collect_list(F.struct("uid", "key", "label", "v", "lows", "highs", "floors", "seen")).alias("anchors")).select("anchors")


_MEMBER = "struct<uid: bigint, label: string, v: array<int>, lows: array<bigint>, highs: array<bigint>>"


def _visited(chunks: DataFrame, index: Index, enough: float) -> DataFrame:
    """(cell, part, members): the anchors that look into each part of each cell; with `enough`, the first cells only."""
    books, parts = index.books, index.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchors in batch.column(0).to_pylist():
                into: dict[int, list[dict]] = {}
                for a in anchors:
                    # a window is certified by its floor: the lowest of its k best so far, or its lower end
                    windows = [(f, h) for f, h in zip(a["floors"], a["highs"], strict=True) if f <= h]
                    if not windows:
                        continue
                    x, least, most = np.array(a["v"], dtype=np.float64), min(f for f, _ in windows), max(h for _, h in windows)
                    member = {"uid": a["uid"], "label": a["label"], "v": a["v"], "lows": a["floors"], "highs": a["highs"]}
                    least_before = min(low for low, h in zip(a["lows"], a["highs"], strict=True) if low <= h)
                    done = set(books.visit(x, least_before, most, FIRST)) if a["seen"] else ()
                    for cell in books.visit(x, least, most, enough):
                        if cell not in done:
                            into.setdefault(cell, []).append(member)
                for cell, members in into.items():
                    for part in range(int(parts[cell])):
                        yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([part], pa.int32()), pa.array([members], _member_type())], names=["cell", "part", "members"])

    return chunks.mapInArrow(run, f"cell int, part int, members array<{_MEMBER}>")


def _member_type() -> pa.DataType:
    return pa.list_(pa.struct([("uid", pa.int64()), ("label", pa.string()), ("v", pa.list_(pa.int32())), ("lows", pa.list_(pa.int64())), ("highs", pa.list_(pa.int64()))]))


def _best(visits: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """(uid, window, other, key, score): of each part, an anchor's k best rows in each of its windows."""
    dims = index.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                members, rows = batch.column(0)[i].values, batch.column(1)[i].values
                uids, labels = rows.field("uid").to_numpy(), np.array(rows.field("label").to_pylist(), dtype=object)
                keys, missing = rows.field("key").fill_null(0).to_numpy(), rows.field("key").is_null().to_numpy(zero_copy_only=False)
                scores = _products(_matrix(members.field("v"), dims), _matrix(rows.field("v"), dims))
                out: list[list[np.ndarray]] = []
                ends = zip(members.field("uid").to_pylist(), members.field("label").to_pylist(), members.field("lows").to_pylist(), members.field("highs").to_pylist(), strict=True)
                for line, (uid, label, lows, highs) in zip(scores, ends, strict=True):
                    fits = np.flatnonzero(((labels == label) == same) & (uids != uid) & (line >= min(lows)))
                    for window, (low, high) in enumerate(zip(lows, highs, strict=True)):
                        there = fits[(line[fits] >= low) & (line[fits] <= high)]
                        if len(there) > k:
                            there = there[line[there] >= np.partition(line[there], -k)[-k]]
                        if len(there):
                            there = there[np.lexsort((uids[there], keys[there], missing[there], -line[there]))][:k]
                            out.append([np.full(len(there), uid), np.full(len(there), window, dtype=np.int32), uids[there], there, line[there]])
                if out:
                    uid, window, other, there, score = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(window), pa.array(other), rows.field("key").take(pa.array(there)), pa.array(score)], names=["uid", "window", "other", "key", "score"])

    # merged, never broadcast: the index holds every row, which pack several times smaller on disk than Spark has them
    joined = visits.join(index.table.hint("merge"), ["cell", "part"]).select("members", "rows")
    return joined.mapInArrow(run, "uid long, window int, other long, key long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("uid", "window").orderBy(F.desc("score"), F.asc_nulls_last("key"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(anchors: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """(uid, window, rank, other, key, score): the k best rows in each anchor's windows [lows, highs] of products, with
    the anchor's label (`same`) or with another; higher ones first, ties by smaller key.

    Exact, in two visits: an anchor's first cells set a floor under each window that they fill; then it visits every
    other cell whose bound reaches a floor. Work goes by (cell, part) x anchors that look into it.
    """
    start = anchors.withColumn("floors", F.col("lows")).withColumn("seen", F.lit(False))
    first = stored(_top(_best(_visited(_chunks(start), index, FIRST), index, k, same), k), "first")
    full = first.where(F.col("rank") == k).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("full"))  # a window each
    floors = F.transform(F.col("lows"), lambda low, i: F.greatest(low, F.coalesce(F.try_element_at("full", i), low)))
    after = anchors.join(full, "uid", "left").withColumn("floors", F.when(F.col("full").isNull(), F.col("lows")).otherwise(floors)).withColumn("seen", F.lit(True)).drop("full")
    more = _best(_visited(_chunks(after), index, math.inf), index, k, same)
    return _top(first.drop("rank").unionByName(more), k)


def mine(
    df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", scale: int = 256, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95)
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its best
    `positives` rows of the same label, the best `negatives` rows of other labels whose score is within `band` percent
    of the positive's.

    Scores are exact inner products of floor(scale * x). Rows take no part whose label or vector is null, whose vector
    is empty, holds null or non-finite entries or entries too large for exact scores in a long, or is of another length
    than the commonest (ties: the longer). Ties go by smaller key, a null key last; rows that repeat a key are rows of
    their own; an anchor without positives, or with negative scores only, gives no rows, nor does an empty table. Other
    columns of df don't matter; its key must be integral.
    """
    whole = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale))
    wide = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    dims = wide.d if wide else 1
    largest = min((1 << 31) - 2, math.isqrt((1 << 55) // dims)) / scale
    sound = (F.size(vector) == dims) & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > largest))
    tag = F.col(label) if isinstance(label, str) else label
    picked = df.where(sound & tag.isNotNull()).select(F.col(key).cast("long").alias("key"), tag.cast("string").alias("label"), whole.cast("array<int>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = stored(picked.withColumn("uid", F.monotonically_increasing_id()), "rows")
    n = rows.count()
    placed, index = build(rows, dims, max(1, n))
    far = 1 << 60
    anchors = placed.where("anchor").select("uid", "key", "label", "v", "cell")
    near = stored(search(anchors.withColumns({"lows": F.array(F.lit(-far)), "highs": F.array(F.lit(far))}), index, positives, True), "positives")
    windows = F.array_sort(F.collect_list(F.struct("rank", F.expr(f"score * {band[0]} div 100 + int(score * {band[0]} % 100 > 0)").alias("low"), F.expr(f"score * {band[1]} div 100 - int(score * {band[1]} % 100 < 0)").alias("high"))))
    asked = anchors.join(near.groupBy("uid").agg(windows.alias("w")), "uid").withColumns({"lows": F.col("w.low"), "highs": F.col("w.high")}).drop("w")
    found = search(asked, index, negatives, False)
    pairs = near.select("uid", (F.col("rank") - 1).alias("window"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
    named = found.join(pairs, ["uid", "window"]).join(anchors.select("uid", F.col("key").alias("anchor_id")), "uid")
    return named.select("anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
