"""Scores of signatures against snapshots: histograms, mutual information, Dice, ranks and their hybrid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscore.functions.columns import let
from gridscore.functions.columns import total as _sum
from gridscore.operators import bitslice
from gridscore.session import stored

#: Signatures and snapshots that are counted against each other in one go.
CHUNK = 128


def long_form(df: DataFrame, keys: list[str], values: str, position: str = "pos", value: str = "value") -> DataFrame:
    """One row per entry of an array column."""
    return df.select(*keys, F.posexplode(values).alias(position, value))


def packed(df: DataFrame, keys: list[str], position: str, value: str, values: str = "values") -> DataFrame:
    """Arrays of a long table's values in the order of their position."""
    gathered = F.array_sort(F.collect_list(F.struct(position, value)))
    return df.groupBy(*keys).agg(F.transform(gathered, lambda s: s[value]).alias(values))


def average_rank(keys: list[str], value: str) -> Column:
    """Rank of a value among its group's, ties sharing the mean of their places; for groups that fit a task (order.with_rank: any)."""
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (ties - 1) / F.lit(2.0)


def rank_array(values: Column) -> Column:
    """average_rank() of each entry of an array, over its size: sorted once, then looked up from both ends."""

    def ranked(m: Column) -> Column:
        # the first and the last place of an entry among the sorted ones
        return F.transform(m["v"], lambda v: (F.array_position(m["up"], v) + m["n"] + 1 - F.array_position(m["down"], v)) / (2.0 * m["n"]))

    def both(v: Column) -> Column:
        return let(F.array_sort(v), lambda up: let(F.struct(v.alias("v"), up.alias("up"), F.reverse(up).alias("down"), F.size(v).alias("n")), ranked))

    return let(values, both)


def bin_array(values: Column, n: int) -> Column:
    """Equal-width bin of each entry between the array's ends; the last bin is closed; a flat array is centred."""

    def binned(m: Column) -> Column:
        return F.transform(m["v"], lambda v: F.least(F.floor((v - m["start"]) / m["width"] * n), F.lit(n - 1)).cast("int"))

    def ends(m: Column) -> Column:
        flat = ~(m["high"] > m["low"])
        return F.struct(m["v"].alias("v"), F.when(flat, m["low"] - 0.5).otherwise(m["low"]).alias("start"), F.when(flat, 1.0).otherwise(m["high"] - m["low"]).alias("width"))

    return let(values, lambda v: let(F.struct(v.alias("v"), F.array_min(v).alias("low"), F.array_max(v).alias("high")), lambda m: let(ends(m), binned)))


def bin_value(value: Column, low: Column, high: Column, n: int) -> Column:
    start = F.when(high > low, low).otherwise(low - 0.5)
    return F.least(F.floor((value - start) / F.when(high > low, high - low).otherwise(1.0) * n), F.lit(n - 1)).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def dice(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """2 <a, b> / (|a|^2 + |b|^2 + eps)."""
    return 2 * dot(a, b) / (dot(a, a) + dot(b, b) + eps)


def pair_up(signatures: DataFrame, snapshots: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each signature with each snapshot of its band: the snapshots are a query set that all signatures answer.

    They are stored, so that Spark knows their size: a few hundred go to all tasks, and beyond the session's broadcast
    threshold both sides are dealt by a block number and meet in an equi-join.
    """
    held = stored(snapshots, "snapshots")
    blocks = -(-held.count() // CHUNK) or 1
    asked = held.withColumn("_block", F.pmod(F.xxhash64(*held.columns), F.lit(blocks)))
    dealt = signatures.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    return dealt.join(asked, [*(by or []), "_block"]).drop("_block")


def dice_scores(signatures: DataFrame, snapshots: DataFrame, keys: list[str], ranked: bool = False, by: list[str] | None = None) -> DataFrame:
    """keys and dice of all pairs of a signature w and a snapshot v; ranked: of their average ranks over n."""
    if ranked:
        signatures, snapshots = signatures.withColumn("w", rank_array(F.col("w"))), snapshots.withColumn("v", rank_array(F.col("v")))
    # the norms are each side's own, so they are summed before the sides meet
    left, right = signatures.withColumn("_w2", dot(F.col("w"), F.col("w"))), snapshots.withColumn("_v2", dot(F.col("v"), F.col("v")))
    return pair_up(left, right, by).select(*keys, (2 * dot(F.col("w"), F.col("v")) / (F.col("_w2") + F.col("_v2") + 1e-12)).alias("dice"))


def mutual_information(signatures: DataFrame, snapshots: DataFrame, keys: list[str], signature_keys: list[str], snapshot_keys: list[str], n: int = 4, alpha: float = 0.5, eps: float = 1e-10, method: str = "bits") -> DataFrame:
    """keys and mi of all pairs of a signature w and a snapshot v, from n equal-width bins of each.

    method "bits": bins become bit masks over channels, and a pair's joint counts are bit counts (pair_scores());
    "arrow": signatures and snapshots are gathered into chunks of about CHUNK, chunks meet in an equi-join, and two chunks
    are counted against each other by a matrix product in Python. Null arrays have no pairs; entries beyond the shorter
    of two vectors don't count.
    """
    if method == "bits":
        return pair_scores(signatures, snapshots, keys, n=n, alpha=alpha, eps=eps, dice=False)
    left = signatures.withColumn("bv", bin_array(F.col("w"), n))
    right = snapshots.withColumn("bs", bin_array(F.col("v"), n))
    return _information_by_chunk(left, right, signature_keys, snapshot_keys, keys, n, alpha, eps)


def pair_scores(signatures: DataFrame, snapshots: DataFrame, keys: list[str], n: int = 4, alpha: float = 0.5, eps: float = 1e-10, mi: bool = True, dice: bool = True, agreement: bool = False, by: list[str] | None = None) -> DataFrame:
    """keys and mi, dice (of average ranks over their number) and agreement (share of channels in the same bin), as asked
    for, of all pairs of a signature w and a snapshot v: each pair is met once, and all its scores are bit counts of
    slices that were cut before the sides met, in one projection of generated code.
    """
    held = stored(snapshots.where(F.col("v").isNotNull()), "snapshots")
    left = signatures.where(F.col("w").isNotNull())
    channels = held.agg(F.max(F.size("v"))).first()[0] or 1
    digits = (2 * max(channels, left.agg(F.max(F.size("w"))).first()[0] or 1)).bit_length() if dice else 0

    def sliced(df: DataFrame, values: str, name: str) -> DataFrame:
        made: dict[str, Column] = {}
        rows = df.withColumns({"_bins": bin_array(F.col(values), n), "_twice": F.transform(rank_array(F.col(values)), lambda r: F.round(r * 2 * F.size(values)).cast("bigint")) if dice else F.lit(0)})
        if mi or agreement:
            made |= bitslice.bin_slices("_bins", n, channels, name)
        if dice:
            made |= bitslice.digit_slices("_twice", digits, channels, f"{name}d")
            made[f"{name}s"] = F.aggregate("_twice", F.lit(0).cast("bigint"), lambda s, r: s + r * r)
        return rows.withColumns(made | {f"{name}n": F.size(values)}).drop("_bins", "_twice", values)

    pairs = pair_up(sliced(left, "w", "_a"), sliced(held, "v", "_b"), by)
    if mi:
        pairs = bitslice.with_information(pairs, "_a", "_b", n, channels, alpha, eps)
    found = []
    if mi:
        found.append(F.col("mi"))
    if dice:
        # the slices hold twice the ranks; a rank counts as a share of its vector's length
        a, b = F.col("_an").cast("double"), F.col("_bn").cast("double")
        found.append((2 * (bitslice.product("_ad", "_bd", digits, channels) / (4 * a * b)) / (F.col("_as") / (4 * a * a) + F.col("_bs") / (4 * b * b) + 1e-12)).alias("dice"))
    if agreement:
        found.append((bitslice.agreement("_a", "_b", n, channels) / F.col("_an")).alias("agreement"))
    return pairs.select(*keys, *found)


def _chunks(df: DataFrame, keys: list[str], bins: str, name: str) -> tuple[DataFrame, int]:
    """Rows of about CHUNK rows of df each: `name` (number), the keys as arrays and all bins in one array; and how many."""
    rows = df.where(F.col(bins).isNotNull()).select(*keys, F.col(bins).cast("array<tinyint>").alias("_bins"))
    count = -(-rows.count() // CHUNK) or 1
    gathered = rows.groupBy(F.pmod(F.xxhash64(*keys), F.lit(count)).alias(name)).agg(F.collect_list(F.struct(*keys, "_bins")).alias("_r"))
    return gathered.select(name, *[F.col(f"_r.{k}").alias(f"{name}_{k}") for k in keys], F.flatten("_r._bins").alias(f"{name}_bins")), count


def _information_by_chunk(left: DataFrame, right: DataFrame, own: list[str], other: list[str], keys: list[str], n: int, alpha: float, eps: float) -> DataFrame:
    kinds = dict(left.dtypes) | dict(right.dtypes)
    a, _ = _chunks(left, own, "bv", "_a")
    b, blocks = _chunks(right, other, "bs", "_b")
    pairs = a.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))).join(stored(b, "chunks"), "_b")
    pairs = pairs.select("_a_bins", "_b_bins", *[f"_a_{k}" for k in own], *[f"_b_{k}" for k in other])

    def marked(bins: np.ndarray, rows: int) -> np.ndarray:
        return np.stack([bins.reshape(rows, -1) == i for i in range(n)], axis=1).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {name: batch.column(name)[k].values for name in batch.schema.names}
                rows, columns = len(row[f"_a_{own[0]}"]), len(row[f"_b_{other[0]}"])
                one, two = marked(row["_a_bins"].to_numpy(), rows), marked(row["_b_bins"].to_numpy(), columns)
                joint = (one.reshape(rows * n, -1) @ two.reshape(columns * n, -1).T).reshape(rows, n, columns, n).transpose(0, 2, 1, 3).astype(np.float64) + alpha
                p = joint / joint.sum((2, 3), keepdims=True)
                product = p.sum(3)[..., None] * p.sum(2)[..., None, :] + eps
                mi = np.maximum(0.0, np.where(p > 0, p * np.log(np.where(p > 0, p, 1.0) / product), 0.0).sum((2, 3)))
                at = {f"_a_{name}": np.repeat(np.arange(rows), columns) for name in own} | {f"_b_{name}": np.tile(np.arange(columns), rows) for name in other}
                made = {name[3:]: row[name].take(pa.array(places)) for name, places in at.items()}
                yield pa.RecordBatch.from_arrays([*[made[name] for name in keys], pa.array(mi.ravel())], names=[*keys, "mi"])

    return pairs.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", mi double")


def bin_agreement(a: Column, b: Column) -> Column:
    """Share of positions where two bin arrays agree."""
    same = F.zip_with(a, b, lambda p, q: F.when(p == q, 1.0).otherwise(0.0))
    return F.aggregate(same, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def min_max(df: DataFrame, keys: list[str], columns: list[str], eps: float = 0.0, kept: bool = False) -> DataFrame:
    """Columns rescaled to 0..1 within keys; flat groups become 0.

    The ends come from a partial and final aggregate and are joined back, so no group is gathered in one task. df is
    stored first, unless it is `kept`, that is, cheap to read twice.
    """
    df = df if kept else stored(df, "unscaled")
    ends = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    ends = stored(ends, "ends")
    scaled = {c: F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}") + eps, (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(0.0) for c in columns}
    return df.join(ends, keys).withColumns(scaled).drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def hybrid(df: DataFrame, keys: list[str], mi_weight: Column | float, contrast: Column | float = 1.0, weight: Column | float = 1.0, mi: str = "mi", dice_: str = "dice", kept: bool = False) -> DataFrame:
    """df with `hybrid`: mi and dice blended, times a prior weight, raised to a contrast and rescaled within keys."""
    w, c, p = (F.lit(float(v)) if isinstance(v, (int, float)) else v for v in (mi_weight, contrast, weight))
    blended = (w * F.col(mi) + (1 - w) * F.col(dice_)) * p
    raised = F.when(c == 1.0, blended).otherwise(F.pow(F.greatest(blended, F.lit(1e-12)), c))
    return min_max(df.withColumn("hybrid", raised), keys, ["hybrid"], eps=float(np.finfo(np.float32).eps), kept=kept)


def scaled_scores(signatures: DataFrame, snapshots: DataFrame, keys: list[str], within: list[str], by: list[str] | None = None) -> DataFrame:
    """pair_scores() of mutual information and rank Dice, each rescaled within `within`.

    The pairs are made once and stored; what is read again are their columns, for the ends (an aggregate that sends a row
    a task and group) and for the rescaled result. No table of pairs is joined or shuffled.
    """
    return min_max(pair_scores(signatures, snapshots, keys, by=by), within, ["mi", "dice"])


def stability_hybrid(mi: Column, dice_: Column, stability: Column, mi_weight: float = 0.5, dice_weight: float = 0.5) -> Column:
    """Blend whose weights shrink with a voxel's stability, which adds a bonus of its own."""
    s = stability / (stability + 1)
    return (mi_weight * mi + dice_weight * dice_) * (1 - 0.2 * s) + 0.4 * s


def time_mean(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])
