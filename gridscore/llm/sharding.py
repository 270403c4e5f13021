"""Contiguous byte-balanced shards from global prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscore.session import stored

#: Bytes that a record costs beside its text.
OVERHEAD = 16


def record_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus OVERHEAD; a null text has no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(OVERHEAD)


def with_prefix(df: DataFrame, order: list[str], size: str, partitions: int | None = None) -> DataFrame:
    """Add `_before` (sum of `size` over all rows that come earlier), `_index` (their count) and `_total`.

    Rows are dealt into ranges of `order`; each range sums its own rows, the range totals (one row a range) are
    prefix-summed, and a window within each range adds its running sum to its range's offset. No row but the range
    totals meets all others. Rows that agree in all of `order` may come in either order among themselves.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the tie-break lets one repeated key spread over several ranges; rows that differ only in it are alike
    keyed = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in order] + [F.col("_tie")]
    ranged = stored(keyed.repartitionByRange(n, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes0"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows0"),
        F.sum("_bytes").over(whole).alias("_total"),
    )
    here = Window.partitionBy("_range").orderBy(*by)
    # one row a range, so its size is the number of ranges
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn("_before", F.col("_bytes0") + F.sum(size).over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size))
        .withColumn("_index", F.col("_rows0") + F.row_number().over(here) - 1)
        .drop("_bytes0", "_rows0", "_range", "_tie")
    )


def shard_by_bytes(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut df, in order of `key`, into n_shards contiguous shards of near-equal bytes.

    A row goes to the shard in whose equal share of the bytes the middle of the row falls, so a shard misses its
    target by half of the row at either end at most. Returns key, size, text_crc32, shard and slot (the row's place
    in its shard, gapless from 0); join on key to carry other columns. Null keys come first; a null text counts as
    empty; repeated rows each get a slot of their own; an empty table gives no rows. Only key, size and checksum are
    shuffled, never the texts.
    """
    return _placed(df, n_shards, key, text, {}).select(F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


def _placed(df: DataFrame, n_shards: int, key: str, text: str, carried: dict[str, Column]) -> DataFrame:
    """_key, _size, _crc, _shard and _slot of each row, and `carried` columns, whose order decides among equal keys."""
    slim = df.select(
        F.col(key).alias("_key"),
        record_size(F.col(text)).alias("_size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_crc"),
        *[c.alias(name) for name, c in carried.items()],
    )
    placed = with_prefix(slim, ["_key", "_crc", "_size", *[name for name in carried if name == "_like"]], "_size").withColumn(
        "_shard",
        F.least(F.lit(n_shards - 1), F.expr(f"((2 * _before + _size) * {n_shards}) div (2 * _total)")).cast("int"),
    )
    first = placed.groupBy("_shard").agg(F.min("_index").alias("_first"))  # n_shards rows
    return placed.join(F.broadcast(first), "_shard").withColumn("_slot", F.col("_index") - F.col("_first"))


def write_shards(df: DataFrame, path: str, n_shards: int, key: str = "doc_id", text: str = "text") -> None:
    """Write df with its shard and slot as Parquet, one folder a shard, sorted by slot.

    Rows are shuffled once, by ranges, and carry their columns; rows that agree in key, size and checksum are ordered
    by a hash of all columns but maps, so that reruns agree.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    whole = [c for name in kept if "map<" not in df.schema[name].dataType.simpleString() for c in (df[name].isNull(), df[name])]
    placed = _placed(df, n_shards, key, text, {"_like": F.xxhash64(*whole), "_row": F.struct(*[df[c] for c in kept])})
    rows = placed.select("_row.*", F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))
    # a shard's rows lie in a few neighbouring ranges, and stay in their tasks
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
