"""SimHash fingerprints of whole texts and their links at a few differing bits, through segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscore.llm.cells import by_block, dealt_in_blocks, forest, small_pairs
from gridscore.llm.rows import packed, unpacked
from gridscore.operators.components import connected_components
from gridscore.session import stored

SEED, WIDTH = 42, 3
#: Rows of a cell that one block holds at most (two chunks of it meet), and rows up to which pairs are listed at once.
BLOCK, LISTED = 2048, 48
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANE = np.arange(8) * 256


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64 bits as a signed integer; bit k is 1 if over half the hashed shingles, repeats included, have it."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        value = digest(joined, SEED)
        return value - (1 << 64) if value >> 63 else value
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - width + 1].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64)
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANE).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.int64())], names=[*batch.schema.names[1:], "_fp"])


def with_fingerprint(df: DataFrame, text: str, carried: dict[str, F.Column]) -> DataFrame:
    """`carried` columns and `_fp` of each row; no shuffle."""
    slim = df.select(df[text].cast("string").alias("_text"), *[c.alias(name) for name, c in carried.items()])
    kinds = ", ".join(f"{name} {kind}" for name, kind in slim.dtypes[1:])
    return slim.mapInArrow(_fingerprints, f"{kinds}, _fp long")


def _link(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for table, bounds in by_block(batches, ["half", "cell", "_i", "_j"]):
        fp = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False)
        left, right = small_pairs(bounds, LISTED)
        near = (home[left] | home[right]) & (np.bitwise_count(fp[left] ^ fp[right]) <= most)
        found = [(left[near], right[near])]
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            if end - start > LISTED:
                at = start + np.flatnonzero(home[start:end])
                for k in range(0, len(at), 256):
                    rows = at[k : k + 256]
                    a, b = np.nonzero(np.bitwise_count(fp[rows, None] ^ fp[None, start:end]) <= most)
                    found.append((rows[a], start + b))
        node, root = forest(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]), fp.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["src", "dst"])


def hamming_links(fps: DataFrame, most: int = 3) -> DataFrame:
    """(src, dst): a spanning forest of the links between distinct fingerprints (column fp) at up to `most` (1 to 3) bits.

    A fingerprint's half of 32 bits is mapped to the bit counts of its 16 segments of two bits. The Manhattan distance
    of two count vectors is at most the number of differing bits, and of two fingerprints within three bits one half
    differs in one bit at most; so in that half they lie in the same grid cell of counts or in cells one step apart.
    Every fingerprint is at home in its cell; those whose counts have an even sum also visit the cells one step away
    (a step changes the sum's parity, so one of the two visits the other). Visits to cells where none is at home go
    before anything is compared. Rows of a cell that aren't the same fingerprint are verified on all 64 bits.
    """
    if not 0 < most <= 3:
        raise ValueError("most must be 1 to 3")
    ones = 0x5555555555555555 & 0xFFFFFFFF
    half = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("half"), F.expr(f"shiftrightunsigned(fp, {32 * k}) & {0xFFFFFFFF}L").alias("bits")) for k in (0, 1)])).alias("h")).select("fp", "h.*")
    homes = half.select("fp", "half", F.expr(f"(bits & {ones}L) + (shiftright(bits, 1) & {ones}L)").alias("cell"), (F.expr("bit_count(bits)") % 2).alias("odd"))
    steps = F.explode(F.expr("flatten(transform(sequence(0, 30, 2), k -> array_compact(array(if((shiftright(cell, k) & 3) < 2, cell + shiftleft(1L, k), null), if((shiftright(cell, k) & 3) > 0, cell - shiftleft(1L, k), null)))))"))
    visits = homes.where("odd = 0").select("fp", "half", steps.alias("cell"))
    lived = homes.select("half", "cell").distinct()
    rows = homes.select("fp", "half", "cell", F.lit(True).alias("home")).unionByName(visits.join(lived, ["half", "cell"], "left_semi").withColumn("home", F.lit(False)))
    rows = stored(rows, "cells")
    return dealt_in_blocks(rows, ["half", "cell"], "fp", BLOCK).mapInArrow(lambda b: _link(b, most), "src long, dst long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """key, fp and component_id of each row of df, with _text_hash (xxhash64 of the text) to tell rows of one key apart
    and _group, which names the row's group also where keys are null or repeated.

    Fingerprints link at up to `most` differing bits; component_id is the smallest key reachable by links. Copies
    share a fingerprint and count once from there on. A null text counts as empty; texts without words have the
    fingerprint zero, which links like any other. Null keys are never a component_id unless no key of the group is
    known; repeated rows get equal answers; an empty table gives none.
    """
    rows = stored(with_fingerprint(df, text, {key: df[key], "_text_hash": F.xxhash64(F.coalesce(df[text].cast("string"), F.lit("")))}), "fingerprints")
    distinct = stored(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min(key).alias("_least")), "distinct")
    groups = connected_components(hamming_links(distinct, most))
    labelled = stored(distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "_least", F.coalesce("component", "fp").alias("_group")), "labelled")
    names = stored(labelled.groupBy("_group").agg(F.min("_least").alias("component_id")), "names")
    named = stored(labelled.join(names, "_group").select("fp", "component_id", "_group"), "named")
    return rows.withColumnRenamed("_fp", "fp").join(named, "fp").select(key, "fp", "component_id", "_text_hash", "_group")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """One row of each group of df: the smallest key's, known before null ones, then the smallest text hash; once if the
    row is repeated; columns unchanged."""
    last, hashed = F.lit((1 << 63) - 1), F.xxhash64(F.coalesce(df[text].cast("string"), F.lit("")))
    order = F.struct(F.coalesce(F.col(key), last).alias("key"), F.col("_text_hash").alias("hash"))
    first = stored(near_duplicates(df, key, text, most).groupBy("_group").agg(F.min(order).alias("o")).select("o.*"), "first")
    rows = df.select(packed(df).alias("row"), F.coalesce(df[key], last).alias("key"), hashed.alias("hash"))
    return rows.join(first, ["key", "hash"], "left_semi").dropDuplicates(["key", "hash"]).select(*unpacked(df.columns))
