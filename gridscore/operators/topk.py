"""Top-k with ties, quotas by region, capped removal and exact seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_top(df: DataFrame, keys: list[str], k: int | Column, value: str = "value") -> DataFrame:
    """Values of a group that are below its k-th largest positive one become 0; ties stay, as do groups of up to k."""
    place = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(value)))
    limit = F.lit(k) if isinstance(k, int) else k
    return df.withColumn("_r", place).withColumn(value, F.when((F.col("_r") <= limit) | (F.col(value) <= 0), F.col(value)).otherwise(0.0)).drop("_r")


def sparsify(df: DataFrame, keys: list[str], n_grey: int, share: float, least: int, value: str = "value") -> DataFrame:
    """keep_top() of grey voxels with k = max(share of the grey voxels, least); values outside grey matter stay."""
    k = max(int(share * n_grey), least)
    active = df.where("is_gm").groupBy(*keys).agg(F.sum((F.col(value) > 0).cast("long")).alias("_active"))
    place = F.rank().over(Window.partitionBy(*keys, "is_gm").orderBy(F.desc(value)))
    rows = df.withColumn("_r", place).join(active, keys, "left")
    cut = F.col("is_gm") & (F.col("_active") > k) & (F.col("_r") > k)
    return rows.withColumn(value, F.when(cut, 0.0).otherwise(F.col(value))).drop("_r", "_active")


def _quota(n: Column, share: Column | float, least: Column | int) -> Column:
    share, least = (F.lit(v) if isinstance(v, (int, float)) else v for v in (share, least))
    return F.greatest(F.floor(share * n), F.least(least, n))


def keep_by_region(
    df: DataFrame, keys: list[str], occipital: list[int], frontal: list[int], posterior: list[int], region_share: float = 0.3, region_least: int = 50, global_share: float = 0.4,
    global_least: int = 20000, protect_share: float = 0.8, protect_least: int = 100, boost: float = 1.0, value: str = "value",
) -> DataFrame:
    """df with values set to 0 unless a quota keeps them, ties included.

    In turn: a share of each occipital, then each frontal region; of the rest, the largest over all regions; of what is
    left, a share of every other labelled region, more of posterior ones.
    """
    v, active = F.col(value), F.col(value) > 0
    by_roi = Window.partitionBy(*keys, "roi_id", "_open")
    rows = df.withColumn("_open", active)
    protected = F.col("roi_id").isin(occipital + frontal)
    n = F.count("*").over(by_roi)
    first = active & protected & (F.rank().over(by_roi.orderBy(F.desc(value))) <= _quota(n, protect_share, protect_least))
    rows = rows.withColumn("_kept", first)
    # group counts are partial aggregates, so a group's rows meet only in its ranks
    counts = rows.groupBy(*keys).agg(F.sum((active & ~F.col("_kept")).cast("long")).alias("_n"), F.sum(F.col("_kept").cast("long")).alias("_k"))
    rows = rows.join(counts, keys).withColumn("_open", active & ~F.col("_kept"))
    limit = F.least(F.greatest(F.floor(global_share * F.col("_n")), global_least - F.col("_k")), F.col("_n"))
    place = F.rank().over(Window.partitionBy(*keys, "_open").orderBy(F.desc(value)))
    rows = rows.withColumn("_kept", F.col("_kept") | (F.col("_open") & (limit > 0) & (place <= limit))).withColumn("_open", active & ~F.col("_kept"))
    more = F.when(F.col("roi_id").isin(posterior), boost).otherwise(1.0)
    left = F.col("_open") & (F.col("roi_id") > 0) & ~F.col("roi_id").isin(occipital)
    quota = _quota(F.count("*").over(by_roi), region_share * more, F.floor(region_least * more))
    last = left & (F.rank().over(by_roi.orderBy(F.desc(value))) <= quota)
    return rows.withColumn("_kept", F.col("_kept") | last).withColumn(value, F.when(F.col("_kept"), v).otherwise(0.0)).drop("_open", "_kept", "_n", "_k")


def largest(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """The n rows with the largest `by`; a report, not a filter."""
    return df.orderBy(F.desc(by), *ties).limit(n)


def cap_removals(flagged: DataFrame, keys: list[str], most: int, score: str = "score", tie: str = "component") -> DataFrame:
    """Of the flagged components of each recording, the `most` with the highest scores."""
    return flagged.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))).where(F.col("_r") <= most).drop("_r")


def exact_sample(df: DataFrame, n: int, key: str, seed: int, keys: list[str] | None = None) -> DataFrame:
    """n rows (of each group) without replacement: those whose key hashes lowest, the same on every run."""
    draw = F.xxhash64(F.lit(seed), key)
    if not keys:
        return df.orderBy(draw, key).limit(n)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(draw, key))).where(F.col("_r") <= n).drop("_r")
