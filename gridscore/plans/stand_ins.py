"""The given tables read as recordings, voxels, scores and signatures, in DataFrames and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore.model import BANDS
from gridscore.session import dealt, table


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded_all(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in columns})


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as voxels of a 20 x 20 x 50 lattice; its size is the region, and voxels of an even region are grey."""
    k = F.col("p_partkey")
    at = {"i": k % 20, "j": F.expr("p_partkey div 20 % 20"), "k": F.expr("p_partkey div 400 % 50")}
    rows = table(spark, sf_dir, "part").select(k.alias("voxel_id"), F.col("p_size").alias("roi_id"), *[c.cast("int").alias(n) for n, c in at.items()])
    return rows.withColumns({"x": -90.0 + 9.0 * F.col("i"), "y": -130.0 + 11.0 * F.col("j"), "z": -72.0 + 3.6 * F.col("k"), "is_gm": F.col("roi_id") % 2 == 0})


VOX = """vox AS (SELECT p_partkey AS voxel_id, p_size AS roi_id, CAST(p_partkey % 20 AS INT) AS i, CAST((p_partkey // 20) % 20 AS INT) AS j,
  CAST((p_partkey // 400) % 50 AS INT) AS k, -90::DOUBLE + 9::DOUBLE * (p_partkey % 20) AS x, -130::DOUBLE + 11::DOUBLE * ((p_partkey // 20) % 20) AS y,
  -72::DOUBLE + 3.6::DOUBLE * ((p_partkey // 400) % 50) AS z, p_size % 2 = 0 AS is_gm FROM part)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as scores: a supplier is a recording, a return flag a band, a part a voxel, a month an epoch."""
    rows = table(spark, sf_dir, "lineitem")
    keys = {"recording_id": "l_suppkey", "band": "l_returnflag", "voxel_id": "l_partkey", "epoch": F.month("l_shipdate"), "mi": F.col("l_discount") * 10, "dice": F.col("l_tax") * 12.5}
    slim = rows.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in keys.items()])
    return dealt(slim, rows.count(), "voxel_id").groupBy("recording_id", "band", "voxel_id", "epoch").agg(F.avg("mi").alias("mi"), F.avg("dice").alias("dice"))


SC = """sc AS (SELECT l_suppkey AS recording_id, l_returnflag AS band, l_partkey AS voxel_id, CAST(month(l_shipdate) AS INT) AS epoch,
  avg(l_discount * 10::DOUBLE) AS mi, avg(l_tax * 12.5::DOUBLE) AS dice FROM lineitem GROUP BY 1, 2, 3, 4)"""


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located hybrid values (0.6 mi + 0.4 dice) of every recording, band, voxel and epoch."""
    v = scores(spark, sf_dir).withColumn("value", 0.6 * F.col("mi") + 0.4 * F.col("dice")).drop("mi", "dice")
    return v.join(voxels(spark, sf_dir), "voxel_id")


VAL = f"{VOX}, {SC}, val AS (SELECT recording_id, band, epoch, 0.6::DOUBLE * mi + 0.4::DOUBLE * dice AS value, vox.* FROM sc JOIN vox USING (voxel_id))"


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """values(), averaged over epochs."""
    return values(spark, sf_dir).groupBy("recording_id", "band", "voxel_id", "roi_id", "x", "y", "z", "is_gm").agg(F.avg("value").alias("value"))


MEAN = f"{VAL}, m AS (SELECT recording_id, band, voxel_id, roi_id, x, y, z, is_gm, avg(value) AS value FROM val GROUP BY ALL)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples: a user is a recording, an event type a channel, a day an epoch; absent days hold 0."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), F.col("event_type").alias("channel"), F.datediff("ts", F.lit("2024-01-01")).alias("epoch"), "value")
    known = rows.groupBy("recording_id", "channel", "epoch").agg(F.avg("value").alias("value"))
    grid = rows.select("channel").distinct().crossJoin(rows.agg(F.max("epoch").alias("_last")).select(F.explode(F.sequence(F.lit(0), "_last")).alias("epoch")))
    from gridscore.operators.timeops import densify

    return densify(known, ["recording_id"], grid)


EV = """raw AS (SELECT user_id AS recording_id, event_type AS channel, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS epoch, value FROM events),
  known AS (SELECT recording_id, channel, epoch, avg(value) AS value FROM raw GROUP BY 1, 2, 3),
  ev AS (SELECT r.recording_id, c.channel, e.epoch, coalesce(known.value, 0) AS value FROM (SELECT DISTINCT recording_id FROM raw) r CROSS JOIN (SELECT DISTINCT channel FROM raw) c
    CROSS JOIN (SELECT CAST(range AS INT) AS epoch FROM range((SELECT max(epoch) + 1 FROM raw))) e LEFT JOIN known USING (recording_id, channel, epoch))"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as signatures w of voxels, the label as region."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("voxel_id"), F.col("label").alias("roi_id"), F.col("embedding").cast("array<double>").alias("w"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean signature of every label as a snapshot v; the label numbers the epoch."""
    from gridscore.operators.score import packed

    long = signatures(spark, sf_dir).select(F.col("roi_id").alias("epoch"), F.posexplode("w").alias("pos", "a"))
    found = long.groupBy("epoch", "pos").agg(F.round(F.avg("a"), 9).alias("a"))
    return packed(found, ["epoch"], "pos", "a", "v")


SIG = """lng AS (SELECT vec_id AS voxel_id, label AS roi_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS a FROM embeddings),
  snap AS (SELECT roi_id AS epoch, pos, round(avg(a), 9) AS b FROM lng GROUP BY 1, 2)"""


def nation_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as a montage of 25 channels at scattered places."""
    k = F.col("n_nationkey")
    places = table(spark, sf_dir, "nation").select(k.alias("idx"), (k * 37 % 25 * 6.0 - 72).alias("x"), (k * 11 % 25 * 8.0 - 104).alias("y"), (k * 17 % 25 * 4.0 - 20).alias("z"))
    return places.withColumn("side", F.when(F.col("x") < -3, "L").when(F.col("x") > 3, "R").otherwise("M"))


NCH = """nch AS (SELECT *, CASE WHEN x < -3 THEN 'L' WHEN x > 3 THEN 'R' ELSE 'M' END AS side FROM (SELECT n_nationkey AS idx, (n_nationkey * 37) % 25 * 6::DOUBLE - 72 AS x,
  (n_nationkey * 11) % 25 * 8::DOUBLE - 104 AS y, (n_nationkey * 17) % 25 * 4::DOUBLE - 20 AS z FROM nation))"""


def order_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as snapshots: a status is a recording, a priority a band, a quarter an epoch; nations' mean prices are the
    power of their channels."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("idx"))
    keys = [F.col("o_orderstatus").alias("recording_id"), F.element_at(F.array(*[F.lit(b) for b in BANDS]), F.substring("o_orderpriority", 1, 1).cast("int")).alias("band"), F.quarter("o_orderdate").alias("epoch")]
    power = table(spark, sf_dir, "orders").join(customers, "o_custkey").groupBy(*keys, "idx").agg(F.round(F.avg("o_totalprice"), 6).alias("value"))
    known = power.groupBy("recording_id", "band", "epoch").agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("known"))
    n = table(spark, sf_dir, "nation").count()
    return known.select("recording_id", "band", "epoch", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("known", k), F.lit(0.0))).alias("v"))


ORD = """pw AS (SELECT o_orderstatus AS recording_id, list_extract(['delta', 'theta', 'alpha', 'beta', 'gamma'], CAST(o_orderpriority[1] AS INT)) AS band, CAST(quarter(o_orderdate) AS INT) AS epoch, c_nationkey AS idx, round(avg(o_totalprice), 6) AS value
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3, 4),
  ord AS (SELECT k.recording_id, k.band, k.epoch, n_nationkey AS pos, coalesce(value, 0) AS b FROM (SELECT DISTINCT recording_id, band, epoch FROM pw) k CROSS JOIN nation LEFT JOIN pw ON pw.recording_id = k.recording_id AND pw.band = k.band AND pw.epoch = k.epoch AND pw.idx = n_nationkey)"""
