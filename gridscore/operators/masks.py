"""Sets of voxels as bitmaps: a long holds 64 of them, so set algebra is one bit operation a word, and sizes are bit counts.

A mask is a table (keys, word, bits): bit k of a word says that voxel 64 word + k is in. Words without voxels are absent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def _bit(id_: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col(id_), F.lit(WORD)).cast("int"))


def _word(id_: str) -> Column:
    return F.floor(F.col(id_) / WORD).cast("bigint")


def mask(df: DataFrame, keys: list[str], id_: str = "voxel_id", where: Column | None = None) -> DataFrame:
    """The voxels of each group whose rows meet a condition (null: not); ids that repeat count once, null ids don't.

    Words are or-ed together before they are shuffled, so at most one row a word and task moves.
    """
    rows = df.where(F.col(id_).isNotNull()) if where is None else df.where(F.col(id_).isNotNull() & where)
    return rows.groupBy(*keys, _word(id_).alias("word")).agg(F.bit_or(_bit(id_)).alias("bits"))


def union(masks: list[DataFrame], keys: list[str]) -> DataFrame:
    """Voxels that any mask has."""
    return reduce(DataFrame.unionByName, masks).groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def intersection(masks: list[DataFrame], keys: list[str]) -> DataFrame:
    """Voxels that all masks have. A mask has a word once, so a word that is met less often is missing somewhere."""
    met = reduce(DataFrame.unionByName, masks).groupBy(*keys, "word").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("_n"))
    return met.where((F.col("_n") == len(masks)) & (F.col("bits") != 0)).drop("_n")


def difference(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Voxels of one mask that the other hasn't; with a mask of all voxels as the first, the complement."""
    less = one.join(other.withColumnRenamed("bits", "_less"), [*keys, "word"], "left")
    return less.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_less", F.lit(0).cast("bigint"))))).where("bits <> 0").drop("_less")


def size(masks: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n, the number of voxels; a group whose mask is empty has no row."""
    return masks.groupBy(*keys).agg(F.sum(F.bit_count("bits").cast("bigint")).alias("n"))


def members(masks: DataFrame, keys: list[str], id_: str = "voxel_id") -> DataFrame:
    """A row a voxel."""
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.call_function("shiftright", F.col("bits"), k).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return masks.select(*keys, "word", F.explode(places).alias("_k")).select(*keys, (F.col("word") * WORD + F.col("_k")).alias(id_))


def within(df: DataFrame, masks: DataFrame, keys: list[str], id_: str = "voxel_id") -> DataFrame:
    """Rows of df whose voxel is in its group's mask: an equi-join on a table of one row in 64 voxels."""
    m = masks.select(*[F.col(c).alias(f"_mask_{c}") for c in (*keys, "word", "bits")])
    on = reduce(Column.__and__, [df[k] == m[f"_mask_{k}"] for k in keys], _word(id_) == m["_mask_word"])
    return df.join(m, on).where(m["_mask_bits"].bitwiseAND(_bit(id_)) != 0).select(*[df[c] for c in df.columns])
