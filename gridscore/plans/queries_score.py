"""Queries of scores and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore.operators import score, topk
from gridscore.operators.order import with_rank
from gridscore.plans.registry import query
from gridscore.plans.stand_ins import NCH, ORD, SC, SIG, VAL, VOX, nation_channels, order_snapshots, rounded, rounded_all, scores, signatures, snapshots, values, voxels

PAIR = ["voxel_id", "epoch"]


@query(f"""WITH {SIG} SELECT voxel_id, epoch, round(2 * sum(a * b) / (sum(a * a) + sum(b * b) + 1e-12), 6) + 0.0 AS dice
  FROM lng JOIN snap USING (pos) GROUP BY 1, 2""")
def q_dice_raw(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(score.dice_scores(signatures(spark, d), snapshots(spark, d), PAIR), "dice")


RANKED = f"""{SIG}, lr AS (SELECT voxel_id, pos, (rank() OVER (PARTITION BY voxel_id ORDER BY a) + (count(*) OVER (PARTITION BY voxel_id, a) - 1) / 2.0::DOUBLE)
    / count(*) OVER (PARTITION BY voxel_id) AS a FROM lng),
  sr AS (SELECT epoch, pos, (rank() OVER (PARTITION BY epoch ORDER BY b) + (count(*) OVER (PARTITION BY epoch, b) - 1) / 2.0::DOUBLE)
    / count(*) OVER (PARTITION BY epoch) AS b FROM snap)"""


@query(f"""WITH {RANKED} SELECT voxel_id, epoch, round(2 * sum(a * b) / (sum(a * a) + sum(b * b) + 1e-12), 6) + 0.0 AS dice
  FROM lr JOIN sr USING (pos) GROUP BY 1, 2""")
def q_dice_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(score.dice_scores(signatures(spark, d), snapshots(spark, d), PAIR, ranked=True), "dice")


@query("""WITH lng AS (SELECT vec_id AS voxel_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS a FROM embeddings)
  SELECT voxel_id, pos, rank() OVER (PARTITION BY voxel_id ORDER BY a) + (count(*) OVER (PARTITION BY voxel_id, a) - 1) / 2.0::DOUBLE AS place FROM lng""")
def q_average_rank(spark: SparkSession, d: str) -> DataFrame:
    long = score.long_form(signatures(spark, d), ["voxel_id"], "w", value="a").withColumn("pos", F.col("pos").cast("bigint"))
    return with_rank(long, ["voxel_id"], "a", "place").select("voxel_id", "pos", "place")


def _binned(n: int) -> str:
    def side(key: str, source: str, v: str, name: str) -> str:
        return f"""(SELECT {key}, pos, least(CAST(floor(({v} - CASE WHEN hi > lo THEN lo ELSE lo - 0.5 END) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END) * {n}) AS INT), {n - 1}) AS {name}
          FROM (SELECT *, min({v}) OVER (PARTITION BY {key}) AS lo, max({v}) OVER (PARTITION BY {key}) AS hi FROM {source}))"""

    return f"lb AS {side('voxel_id', 'lng', 'a', 'p')}, sb AS {side('epoch', 'snap', 'b', 'q')}"


def information_sql(n: int, alpha: float, eps: float) -> str:
    return f"""{SIG}, {_binned(n)}, c AS (SELECT voxel_id, epoch, p, q, count(*) AS c FROM lb JOIN sb USING (pos) GROUP BY 1, 2, 3, 4),
  pairs AS (SELECT DISTINCT voxel_id, epoch FROM c), cells AS (SELECT x.range AS p, y.range AS q FROM range({n}) x, range({n}) y),
  g AS (SELECT voxel_id, epoch, p, q, coalesce(c, 0) + {alpha}::DOUBLE AS c FROM pairs CROSS JOIN cells LEFT JOIN c USING (voxel_id, epoch, p, q)),
  pr AS (SELECT *, c / sum(c) OVER (PARTITION BY voxel_id, epoch) AS v FROM g),
  mg AS (SELECT *, sum(v) OVER (PARTITION BY voxel_id, epoch, p) AS vp, sum(v) OVER (PARTITION BY voxel_id, epoch, q) AS vq FROM pr),
  info AS (SELECT voxel_id, epoch, greatest(0, sum(CASE WHEN v > 0 THEN v * ln(v / (vp * vq + {eps})) ELSE 0 END)) AS mi FROM mg GROUP BY 1, 2)"""


@query(f"WITH {information_sql(4, 0.5, 1e-10)} SELECT voxel_id, epoch, round(mi, 6) + 0.0 AS mi FROM info")
def q_mi_hist(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(score.mutual_information(signatures(spark, d), snapshots(spark, d), PAIR, ["voxel_id"], ["epoch"]), "mi")


@query(f"WITH {information_sql(4, 0.5, 1e-10)} SELECT voxel_id, epoch, round(mi, 6) + 0.0 AS mi FROM info")
def q_mi_batches(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(score.mutual_information(signatures(spark, d), snapshots(spark, d), PAIR, ["voxel_id"], ["epoch"], method="arrow"), "mi")


@query(f"WITH {information_sql(6, 0.0, 1e-12)} SELECT voxel_id, epoch, round(mi, 6) + 0.0 AS mi FROM info")
def q_mi_plain(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(score.mutual_information(signatures(spark, d), snapshots(spark, d), PAIR, ["voxel_id"], ["epoch"], n=6, alpha=0.0, eps=1e-12), "mi")


@query(f"WITH {SIG}, {_binned(4)} SELECT voxel_id, epoch, round(avg(CASE WHEN p = q THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS agreement FROM lb JOIN sb USING (pos) GROUP BY 1, 2")
def q_bin_agreement(spark: SparkSession, d: str) -> DataFrame:
    found = score.pair_scores(signatures(spark, d), snapshots(spark, d), PAIR, mi=False, dice=False, agreement=True)
    return rounded_all(found, "agreement")


@query(f"""WITH {information_sql(4, 0.5, 1e-10)}, {RANKED.replace(SIG + ",", "")}, dc AS (SELECT voxel_id, epoch, 2 * sum(a * b) / (sum(a * a) + sum(b * b) + 1e-12) AS dice FROM lr JOIN sr USING (pos) GROUP BY 1, 2),
  j AS (SELECT voxel_id, epoch, (mi - min(mi) OVER w) / (max(mi) OVER w - min(mi) OVER w) AS mi, (dice - min(dice) OVER w) / (max(dice) OVER w - min(dice) OVER w) AS dice
    FROM info JOIN dc USING (voxel_id, epoch) WINDOW w AS (PARTITION BY epoch)),
  h AS (SELECT voxel_id, epoch, pow(greatest(0.65::DOUBLE * mi + 0.35::DOUBLE * dice, 1e-12), 0.5::DOUBLE) AS h FROM j)
  SELECT voxel_id, epoch, round((h - min(h) OVER ()) / (max(h) OVER () - min(h) OVER ()), 6) + 0.0 AS hybrid FROM h""")
def q_hybrid_minmax(spark: SparkSession, d: str) -> DataFrame:
    both = score.scaled_scores(signatures(spark, d), snapshots(spark, d), PAIR, ["epoch"])
    found = score.hybrid(both.withColumn("_all", F.lit(1)), ["_all"], 0.65, 0.5, kept=True)
    return found.select("voxel_id", "epoch", rounded("hybrid").alias("hybrid"))


@query(f"""WITH {SC}, w AS (SELECT recording_id, band, voxel_id, avg(mi) AS mi, avg(dice) AS dice, CASE WHEN stddev_pop(mi) > 0 THEN 1 / (1 + stddev_pop(mi) / (avg(mi) + 1e-8)) ELSE 1.0::DOUBLE END AS s FROM sc GROUP BY 1, 2, 3)
  SELECT recording_id, band, voxel_id, round((0.5::DOUBLE * mi + 0.5::DOUBLE * dice) * (1 - 0.2::DOUBLE * (s / (s + 1))) + 0.4::DOUBLE * (s / (s + 1)), 6) + 0.0 AS hybrid FROM w""")
def q_stability_hybrid(spark: SparkSession, d: str) -> DataFrame:
    from gridscore.operators.metrics import temporal_stability

    keys = ["recording_id", "band", "voxel_id"]
    rows = scores(spark, d)
    joined = score.time_mean(rows, keys, ["mi", "dice"]).join(temporal_stability(rows, keys, "mi"), keys)
    return joined.select(*keys, rounded(score.stability_hybrid(F.col("mi"), F.col("dice"), F.col("stability"))).alias("hybrid"))


TOP = ["band", "epoch", "roi_id"]


@query(f"""WITH {VAL}, a AS (SELECT band, epoch, roi_id, voxel_id, round(avg(value), 6) + 0.0 AS value FROM val GROUP BY 1, 2, 3, 4)
  SELECT band, epoch, roi_id, voxel_id, CASE WHEN rank() OVER (PARTITION BY band, epoch, roi_id ORDER BY value DESC) <= 5 OR value <= 0 THEN value ELSE 0 END AS value FROM a""")
def q_topk_ties(spark: SparkSession, d: str) -> DataFrame:
    rows = values(spark, d).groupBy(*TOP, "voxel_id").agg(rounded(F.avg("value")).alias("value"))
    return topk.keep_top(rows, TOP, 5)


@query(f"""WITH {VAL}, a AS (SELECT band, epoch, voxel_id, is_gm, round(avg(value), 6) + 0.0 AS value FROM val GROUP BY 1, 2, 3, 4),
  n AS (SELECT band, epoch, count(*) FILTER (WHERE value > 0 AND is_gm) AS n FROM a GROUP BY 1, 2), g AS (SELECT greatest(CAST(floor(0.02::DOUBLE * count(*)) AS INT), 10) AS k FROM vox WHERE is_gm)
  SELECT band, epoch, voxel_id, CASE WHEN is_gm AND n > k AND rank() OVER (PARTITION BY band, epoch, is_gm ORDER BY value DESC) > k THEN 0 ELSE value END AS value FROM a JOIN n USING (band, epoch), g""")
def q_sparsify(spark: SparkSession, d: str) -> DataFrame:
    keys = ["band", "epoch"]
    rows = values(spark, d).groupBy(*keys, "voxel_id", "is_gm").agg(rounded(F.avg("value")).alias("value"))
    n = voxels(spark, d).where("is_gm").count()
    return topk.sparsify(rows, keys, n, 0.02, 10).drop("is_gm")


OCC, FRO, POS = list(range(1, 6)), list(range(6, 11)), list(range(11, 21))


@query(f"""WITH {VAL}, a AS (SELECT band, epoch, roi_id, voxel_id, round(avg(value), 6) + 0.0 AS v FROM val GROUP BY 1, 2, 3, 4),
  s1 AS (SELECT *, v > 0 AND roi_id BETWEEN 1 AND 10 AND rank() OVER (PARTITION BY band, epoch, roi_id, v > 0 ORDER BY v DESC) <= greatest(floor(0.5::DOUBLE * count(*) OVER (PARTITION BY band, epoch, roi_id, v > 0)), least(2, count(*) OVER (PARTITION BY band, epoch, roi_id, v > 0))) AS kept FROM a),
  c AS (SELECT band, epoch, count(*) FILTER (WHERE v > 0 AND NOT kept) AS n, count(*) FILTER (WHERE kept) AS k FROM s1 GROUP BY 1, 2),
  s2 AS (SELECT s1.*, n, k, v > 0 AND NOT kept AS o, rank() OVER (PARTITION BY band, epoch, v > 0 AND NOT kept ORDER BY v DESC) AS r, least(greatest(floor(0.2::DOUBLE * n), 30 - k), n) AS lim FROM s1 JOIN c USING (band, epoch)),
  s3 AS (SELECT band, epoch, roi_id, voxel_id, v, kept OR (o AND lim > 0 AND r <= lim) AS kept FROM s2),
  s4 AS (SELECT *, v > 0 AND NOT kept AS o, CASE WHEN roi_id BETWEEN 11 AND 20 THEN 1.5::DOUBLE ELSE 1 END AS m FROM s3),
  s5 AS (SELECT *, kept OR (o AND roi_id > 5 AND rank() OVER (PARTITION BY band, epoch, roi_id, o ORDER BY v DESC) <= greatest(floor(0.1::DOUBLE * m * count(*) OVER (PARTITION BY band, epoch, roi_id, o)), least(floor(1 * m), count(*) OVER (PARTITION BY band, epoch, roi_id, o)))) AS fin FROM s4)
  SELECT band, epoch, roi_id, voxel_id, CASE WHEN fin THEN v ELSE 0 END AS value FROM s5""")
def q_roi_quota(spark: SparkSession, d: str) -> DataFrame:
    keys = ["band", "epoch"]
    rows = values(spark, d).groupBy(*keys, "roi_id", "voxel_id").agg(rounded(F.avg("value")).alias("value"))
    return topk.keep_by_region(rows, keys, OCC, FRO, POS, region_share=0.1, region_least=1, global_share=0.2, global_least=30, protect_share=0.5, protect_least=2, boost=1.5)


@query(f"WITH {VOX}, c AS (SELECT roi_id, count(*) AS n FROM vox GROUP BY 1) SELECT roi_id, n FROM c ORDER BY n DESC, roi_id LIMIT 10")
def q_largest_rois(spark: SparkSession, d: str) -> DataFrame:
    return topk.largest(voxels(spark, d).groupBy("roi_id").agg(F.count("*").alias("n")), 10, "n", "roi_id")


@query("""WITH s AS (SELECT l_suppkey AS recording_id, l_partkey AS component, round(sum(l_quantity), 6) AS score FROM lineitem GROUP BY 1, 2)
  SELECT recording_id, component, score FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY score DESC, component) AS r FROM s) WHERE r <= 8""")
def q_cap_removals(spark: SparkSession, d: str) -> DataFrame:
    from gridscore.session import table

    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("recording_id"), F.col("l_partkey").alias("component")).agg(F.round(F.sum("l_quantity"), 6).alias("score"))
    return topk.cap_removals(rows, ["recording_id"], 8)


@query()
def q_exact_sample(spark: SparkSession, d: str) -> DataFrame:
    return topk.exact_sample(voxels(spark, d), 100, "voxel_id", 42, ["roi_id"]).select("voxel_id", "roi_id")


#: Signatures of parts over nations, and their scores against orders' snapshots, by band.
ZONES = "CASE WHEN v.y < -90 THEN 1.5 WHEN v.y < -70 THEN 1.3 WHEN v.y < -40 THEN 1.2 WHEN v.y < 0 THEN 1.0 ELSE 1.1 END::DOUBLE"
SCALES = "(VALUES ('delta', 1.15::DOUBLE), ('theta', 1.05::DOUBLE), ('alpha', 1.0::DOUBLE), ('beta', 0.9::DOUBLE), ('gamma', 0.8::DOUBLE))"
SIDES = "CASE WHEN side = 'M' THEN 1 WHEN abs(vx) <= 3 THEN 0.8 WHEN side = CASE WHEN vx < -3 THEN 'L' ELSE 'R' END THEN 0.85 ELSE 0.25 END::DOUBLE"


def _bins(key: str, source: str, name: str) -> str:
    v = {"p": "a", "q": "b"}[name]
    return f"""SELECT {key}, pos, least(CAST(floor(({v} - CASE WHEN hi > lo THEN lo ELSE lo - 0.5 END) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END) * 4) AS INT), 3) AS {name}, (rank() OVER (PARTITION BY {key} ORDER BY {v}) + (count(*) OVER (PARTITION BY {key}, {v}) - 1) / 2.0::DOUBLE) / 25 AS r{name}
    FROM (SELECT *, min({v}) OVER (PARTITION BY {key}) AS lo, max({v}) OVER (PARTITION BY {key}) AS hi FROM {source})"""


@query(f"""WITH {VOX}, {NCH}, {ORD}, pp AS (SELECT band, voxel_id, v.x AS vx, idx, side, sqrt((v.x - c.x) * (v.x - c.x) + (v.y - c.y) * (v.y - c.y) + (v.z - c.z) * (v.z - c.z)) AS d, {ZONES} * (35 * scale) AS s FROM vox v, nch c, {SCALES} b(band, scale)),
  ww AS (SELECT *, CASE WHEN d > 200 THEN 0 ELSE exp(-d * d / (2 * s * s)) END AS w FROM pp),
  nn AS (SELECT *, count(*) FILTER (WHERE w > 0.01) OVER (PARTITION BY band, voxel_id) < 8 AND row_number() OVER (PARTITION BY band, voxel_id ORDER BY d, idx) <= 8 AS few FROM ww),
  ff AS (SELECT band, voxel_id, idx AS pos, CASE WHEN few THEN greatest(w, 0.05) ELSE w END * {SIDES} AS w FROM nn),
  lng AS (SELECT band, voxel_id, pos, round(w / sum(w) OVER (PARTITION BY band, voxel_id), 12) AS a FROM ff),
  lb AS ({_bins("band, voxel_id", "lng", "p")}), sb AS ({_bins("recording_id, band, epoch", "ord", "q")}),
  j AS (SELECT recording_id, band, epoch, voxel_id, p, q, rp, rq FROM lb JOIN sb USING (band, pos)),
  dc AS (SELECT recording_id, band, epoch, voxel_id, 2 * sum(rp * rq) / (sum(rp * rp) + sum(rq * rq) + 1e-12) AS dice FROM j GROUP BY 1, 2, 3, 4),
  c AS (SELECT recording_id, band, epoch, voxel_id, p, q, count(*) AS c FROM j GROUP BY ALL), cells AS (SELECT x.range AS p, y.range AS q FROM range(4) x, range(4) y),
  g AS (SELECT dc.recording_id, dc.band, dc.epoch, dc.voxel_id, cells.p, cells.q, (coalesce(c, 0) + 0.5::DOUBLE) / 33 AS v FROM dc CROSS JOIN cells LEFT JOIN c ON c.recording_id = dc.recording_id AND c.band = dc.band AND c.epoch = dc.epoch AND c.voxel_id = dc.voxel_id AND c.p = cells.p AND c.q = cells.q),
  m AS (SELECT *, sum(v) OVER (PARTITION BY recording_id, band, epoch, voxel_id, p) AS vp, sum(v) OVER (PARTITION BY recording_id, band, epoch, voxel_id, q) AS vq FROM g),
  mi AS (SELECT recording_id, band, epoch, voxel_id, greatest(0, sum(v * ln(v / (vp * vq + 1e-10)))) AS mi FROM m GROUP BY 1, 2, 3, 4)
  SELECT recording_id, band, epoch, voxel_id, round((mi - min(mi) OVER w) / (max(mi) OVER w - min(mi) OVER w), 6) + 0.0 AS mi, round((dice - min(dice) OVER w) / (max(dice) OVER w - min(dice) OVER w), 6) + 0.0 AS dice
    FROM mi JOIN dc USING (recording_id, band, epoch, voxel_id) WINDOW w AS (PARTITION BY recording_id, band, epoch)""")
def q_score_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Scores of parts against every status and quarter of orders, in all bands; the band power is given (mean prices)."""
    from gridscore.plans.pipeline import score_snapshots

    return score_snapshots(order_snapshots(spark, d), nation_channels(spark, d), voxels(spark, d), decimals=6)
