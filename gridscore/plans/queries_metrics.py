"""Queries of aggregates over voxels and channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore.functions.geometry import channel_side_by_digit, voxel_side
from gridscore.operators import metrics as M
from gridscore.plans.registry import query
from gridscore.plans.stand_ins import EV, MEAN, SIG, VAL, VOX, means, rounded, rounded_all, samples, signatures, values, voxels

RB = ["recording_id", "band"]
RAW = "CASE WHEN count(*) FILTER (WHERE y <= -40) > 0 AND count(*) FILTER (WHERE y >= 0) > 0 THEN sum(CASE WHEN y <= -40 THEN value ELSE 0 END) / (sum(CASE WHEN y >= 0 THEN value ELSE 0 END) + 1e-12) ELSE 0 END"


@query(f"WITH {MEAN} SELECT recording_id, band, round({RAW}, 6) + 0.0 AS raw FROM m GROUP BY 1, 2")
def q_region_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(M.band_metric(means(spark, d), RB, "alpha").select(*RB, "raw"), "raw")


SCORED = "CASE WHEN raw BETWEEN {lo} AND {hi} THEN least(1, 1.15 / (1 + pow((raw - {t}) / {s}, 2))) ELSE 1 / (1 + pow((raw - {t}) / {s}, 2)) END"


@query(f"""WITH {MEAN}, a AS (SELECT recording_id, {RAW} AS raw, 1.0 AS pen FROM m WHERE band = 'A' GROUP BY 1),
  b AS (SELECT recording_id, CASE WHEN count(*) FILTER (WHERE y BETWEEN -45 AND 15 AND z >= 40 AND abs(x) BETWEEN 10 AND 55) > 0 THEN sum(CASE WHEN y BETWEEN -45 AND 15 AND z >= 40 AND abs(x) BETWEEN 10 AND 55 THEN value ELSE 0 END) / (sum(value) + 1e-12) ELSE 0 END AS raw,
    100 * sum(CASE WHEN y BETWEEN -45 AND 15 THEN value ELSE 0 END) / (sum(value) + 1e-12) AS c FROM m WHERE band = 'N' GROUP BY 1),
  e AS (SELECT recording_id, coalesce(CASE WHEN count(*) FILTER (WHERE y >= 0) > 0 AND count(*) FILTER (WHERE y <= -40) > 0 THEN avg(value) FILTER (WHERE y >= 0) / (avg(value) FILTER (WHERE y <= -40) + 1e-12) END, 0) AS raw,
    avg(value) FILTER (WHERE y > 0) / (avg(value) FILTER (WHERE y < -40) + 1e-12) AS f FROM m WHERE band = 'R' GROUP BY 1),
  u AS (SELECT recording_id, 'A' AS band, {SCORED.format(lo=0.4, hi=1.5, t=0.9, s=0.275)} AS metric FROM a
    UNION ALL SELECT recording_id, 'N', {SCORED.format(lo=0.12, hi=0.4, t=0.22, s=0.07)} * CASE WHEN c > 35 THEN exp(-pow(c - 35, 2) / 800) ELSE 1 END FROM b
    UNION ALL SELECT recording_id, 'R', {SCORED.format(lo=0.5, hi=1.4, t=0.85, s=0.225)} * coalesce(CASE WHEN f > 1.5 THEN exp(-pow(f - 1.5, 2) / 4.5) WHEN f < 0.8 THEN exp(-pow(0.8 - f, 2) / 0.5) END, 1) FROM e)
  SELECT recording_id, band, round(metric::DOUBLE, 6) + 0.0 AS metric FROM u""")
def q_band_score(spark: SparkSession, d: str) -> DataFrame:
    rows = means(spark, d)
    parts = [M.band_metric(rows.where(F.col("band") == flag), RB, band).select(*RB, rounded("metric").alias("metric")) for flag, band in (("A", "alpha"), ("N", "beta"), ("R", "delta"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {MEAN}, s AS (SELECT recording_id, band, sum(CASE WHEN y <= -60 AND z <= 40 THEN value ELSE 0 END) / (sum(value) + 1e-12) AS p, count(*) FILTER (WHERE y <= -60 AND z <= 40) AS n FROM m GROUP BY 1, 2)
  SELECT recording_id, band, round((CASE WHEN n > 0 THEN p / (1 - p + 1e-12) ELSE 0 END)::DOUBLE, 6) + 0.0 AS raw FROM s""")
def q_region_odds(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(M.band_metric(means(spark, d), RB, "gamma").select(*RB, "raw"), "raw")


@query(f"""WITH {MEAN} SELECT recording_id, band, round(sum(CASE WHEN y < -40 THEN value ELSE 0 END) / (sum(CASE WHEN y > 0 THEN value ELSE 0 END) + 1e-12), 6) + 0.0 AS pa_ratio,
  round(100 * sum(CASE WHEN y < -70 THEN value ELSE 0 END) / (sum(value) + 1e-12), 6) + 0.0 AS occipital_pct FROM m GROUP BY 1, 2""")
def q_posterior_anterior(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(M.posterior_anterior(means(spark, d), RB), "pa_ratio", "occipital_pct")


ZONE = "CASE WHEN y <= -85 THEN 'very_posterior' WHEN y <= -70 THEN 'occipital' WHEN y <= -40 THEN 'posterior' WHEN y <= 0 THEN 'central' WHEN y <= 40 THEN 'anterior' ELSE 'frontal' END"


@query(f"""WITH {VAL}, s AS (SELECT recording_id, band, {ZONE} AS zone, sum(greatest(value, 0)) AS s, count(*) FILTER (WHERE value > 0) AS n, coalesce(avg(value) FILTER (WHERE value > 0), 0) AS mean FROM val GROUP BY 1, 2, 3)
  SELECT recording_id, band, zone, round(100 * s / (sum(s) OVER (PARTITION BY recording_id, band) + 1e-12), 6) + 0.0 AS pct, n AS n_active, round(mean, 11) + 0.0 AS mean FROM s""")
def q_zone_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(rounded_all(M.zone_shares(values(spark, d), RB), "pct"), "mean", digits=11)


@query(f"""WITH {VAL}, a AS (SELECT recording_id, band, roi_id, count(DISTINCT voxel_id) AS active, avg(value) AS mean, max(value) AS max FROM val WHERE value > 0 GROUP BY 1, 2, 3),
  t AS (SELECT roi_id, count(*) AS total FROM vox WHERE roi_id > 0 GROUP BY 1), g AS (SELECT DISTINCT recording_id, band FROM val)
  SELECT recording_id, band, roi_id, total, coalesce(active, 0) AS active, round(100.0::DOUBLE * coalesce(active, 0) / greatest(total, 1), 6) + 0.0 AS coverage_pct, round(coalesce(mean, 0), 6) + 0.0 AS mean, round(coalesce(max, 0), 6) + 0.0 AS max,
    CASE WHEN coalesce(active, 0) > 100 THEN 'Covered' WHEN coalesce(active, 0) > 0 THEN 'Weak' ELSE 'Missing' END AS status FROM g CROSS JOIN t LEFT JOIN a USING (recording_id, band, roi_id)""")
def q_roi_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(M.region_coverage(values(spark, d), voxels(spark, d), RB), "coverage_pct", "mean", "max")


@query(f"WITH {VOX} SELECT roi_id, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z, count(*) AS n FROM vox GROUP BY 1")
def q_roi_centroid(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(M.centroids(voxels(spark, d), ["roi_id"]), "x", "y", "z")


@query(f"""WITH {VAL}, p AS (SELECT band, roi_id, avg(value) AS mean, stddev_pop(value) AS std, max(value) AS max, count(DISTINCT voxel_id) AS n_voxels FROM val GROUP BY 1, 2),
  e AS (SELECT band, roi_id, epoch, round(avg(value), 9) AS v FROM val GROUP BY 1, 2, 3), k AS (SELECT band, roi_id, epoch, row_number() OVER (PARTITION BY band, roi_id ORDER BY v DESC, epoch) AS r FROM e)
  SELECT band, roi_id, round(mean, 11) + 0.0 AS mean, round(std, 6) + 0.0 AS std, round(max, 6) + 0.0 AS max, n_voxels, epoch AS peak_epoch FROM p JOIN k USING (band, roi_id) WHERE r = 1""")
def q_roi_peak(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(M.region_peaks(values(spark, d), ["band"]), "std", "max").withColumn("mean", rounded("mean", 11))


@query(f"WITH {SIG} SELECT roi_id, pos, round(avg(a), 6) + 0.0 AS value FROM lng GROUP BY 1, 2")
def q_roi_signature(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(M.mean_signature(signatures(spark, d), ["roi_id"]), "value")


@query(f"""WITH {VAL}, s AS (SELECT recording_id, band, roi_id, epoch, avg(value) AS value FROM val GROUP BY 1, 2, 3, 4),
  k AS (SELECT recording_id, band, roi_id FROM s GROUP BY 1, 2, 3 HAVING max(abs(value)) > 0) SELECT recording_id, band, roi_id, epoch, round(value, 6) + 0.0 AS value FROM s SEMI JOIN k USING (recording_id, band, roi_id)""")
def q_roi_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(M.region_series(values(spark, d), RB), "value")


@query(f"""WITH {VAL}, r AS (SELECT count(*) FILTER (WHERE y < -40) AS post, count(*) FILTER (WHERE y > 0) AS ant FROM vox WHERE is_gm),
  s AS (SELECT recording_id, band, sum(CASE WHEN y < -40 THEN greatest(value, 0) ELSE 0 END) AS p, sum(CASE WHEN y > 0 THEN greatest(value, 0) ELSE 0 END) AS a FROM val WHERE is_gm GROUP BY 1, 2)
  SELECT recording_id, band, round((p / (post + 1e-12)) / (a / (ant + 1e-12) + 1e-12), 6) + 0.0 AS enrichment FROM s, r WHERE a > 0""")
def q_enrichment(spark: SparkSession, d: str) -> DataFrame:
    rows = values(spark, d)
    some = rows.where("is_gm and y > 0 and value > 0").select(*RB).distinct()
    return rounded_all(M.posterior_enrichment(rows, voxels(spark, d), RB).join(some, RB, "left_semi"), "enrichment")


@query(f"""WITH {VAL}, v AS (SELECT recording_id, band, voxel_id, avg(abs(value)) AS v, first(x) AS x, first(y) AS y FROM val GROUP BY 1, 2, 3)
  SELECT recording_id, band, count(*) AS total_active, round(100.0::DOUBLE * count(*) / 20000, 6) + 0.0 AS coverage_pct, round(avg(CAST(y < -40 AS INT)), 6) + 0.0 AS posterior_frac, round(avg(CAST(y > 0 AS INT)), 6) + 0.0 AS anterior_frac,
    round(avg(CAST(x < 0 AS INT)), 6) + 0.0 AS left_frac, round(avg(v), 11) + 0.0 AS mean_value, round(stddev_pop(v), 6) + 0.0 AS std_value FROM v WHERE v > 0.001 GROUP BY 1, 2""")
def q_distribution(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(M.distribution(values(spark, d), RB, 20000), "coverage_pct", "posterior_frac", "anterior_frac", "left_frac", "std_value").withColumn("mean_value", rounded("mean_value", 11))


@query(f"""WITH {MEAN}, t AS (SELECT recording_id, band, max(value) AS top FROM m GROUP BY 1, 2),
  b AS (SELECT recording_id, band, least(CAST(floor(value / (top + 1e-10) * 50) AS INT), 49) AS b FROM m JOIN t USING (recording_id, band) WHERE top > 0 AND value >= 0),
  c AS (SELECT recording_id, band, b, count(*) AS c FROM b GROUP BY 1, 2, 3), p AS (SELECT *, c / sum(c) OVER (PARTITION BY recording_id, band) AS p FROM c),
  e AS (SELECT recording_id, band, sum(-p * log2(p)) AS entropy FROM p GROUP BY 1, 2)
  SELECT recording_id, band, round(coalesce(entropy, 0), 6) + 0.0 AS entropy FROM t LEFT JOIN e USING (recording_id, band)""")
def q_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(M.entropy(means(spark, d), RB), "entropy")


@query(f"""WITH {MEAN}, r AS (SELECT recording_id, band, value, row_number() OVER (PARTITION BY recording_id, band ORDER BY value) AS i FROM m)
  SELECT recording_id, band, round(CASE WHEN sum(value) = 0 THEN 0 ELSE 2 * sum(i * value) / (count(*) * sum(value)) - (count(*) + 1) / count(*)::DOUBLE END, 6) + 0.0 AS gini FROM r GROUP BY 1, 2""")
def q_gini(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(M.gini(means(spark, d), RB), "gini")


@query(f"""WITH {MEAN}, c AS (SELECT recording_id, band, quantile_cont(value, 0.95) AS cut FROM m GROUP BY 1, 2)
  SELECT recording_id, band, round(sum(CASE WHEN value >= cut THEN value ELSE 0 END) / (sum(value) + 1e-10), 6) + 0.0 AS concentration FROM (SELECT recording_id, band, round(value, 9) AS value, round(cut, 9) AS cut FROM m JOIN c USING (recording_id, band)) GROUP BY 1, 2""")
def q_concentration(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(M.concentration(means(spark, d).withColumn("value", F.round("value", 9)), RB), "concentration")


@query(f"""WITH {MEAN}, c AS (SELECT recording_id, band, sum(value) AS t, sum(value * x) / sum(value) AS cx, sum(value * y) / sum(value) AS cy, sum(value * z) / sum(value) AS cz FROM m GROUP BY 1, 2),
  f AS (SELECT recording_id, band, sum(value * sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))) / sum(value) AS v FROM m JOIN c USING (recording_id, band) WHERE t > 0 GROUP BY 1, 2)
  SELECT recording_id, band, round(coalesce(v, 0), 6) + 0.0 AS dispersion FROM c LEFT JOIN f USING (recording_id, band)""")
def q_dispersion(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(M.dispersion(means(spark, d), RB), "dispersion")


@query(f"WITH {MEAN} SELECT recording_id, band, round(stddev_pop(value) / (avg(value) + 1e-10), 6) + 0.0 AS cv, round(CASE WHEN stddev_pop(value) > 0 THEN kurtosis_pop(value) END, 5) + 0.0 AS kurtosis FROM m GROUP BY 1, 2")
def q_variation(spark: SparkSession, d: str) -> DataFrame:
    found = means(spark, d).groupBy(*RB).agg(M.variation().alias("cv"), F.when(F.stddev_pop("value") > 0, M.spatial_kurtosis()).alias("kurtosis"))
    return rounded_all(rounded_all(found, "cv"), "kurtosis", digits=5)


@query(f"""WITH {MEAN}, s AS (SELECT recording_id, band, sum(CASE WHEN y < -40 THEN value ELSE 0 END) AS a, sum(CASE WHEN y >= -40 AND y < 0 THEN value ELSE 0 END) AS b, sum(CASE WHEN y >= 0 THEN value ELSE 0 END) AS c FROM m GROUP BY 1, 2),
  p AS (SELECT recording_id, band, unnest([a, b, c]) / (a + b + c + 1e-12) AS p FROM s) SELECT recording_id, band, round(sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END), 6) + 0.0 AS entropy FROM p GROUP BY 1, 2""")
def q_zone_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(M.zone_entropy(means(spark, d), RB), "entropy")


@query(f"WITH {EV} SELECT recording_id, channel, round(CASE WHEN stddev_pop(value) > 0 THEN 1 / (1 + stddev_pop(value) / (avg(value) + 1e-8)) ELSE 1 END, 6) + 0.0 AS stability FROM ev GROUP BY 1, 2")
def q_temporal_stability(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(M.temporal_stability(samples(spark, d), ["recording_id", "channel"]), "stability")


@query("""WITH lng AS (SELECT vec_id AS voxel_id, label AS roi_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS a FROM embeddings),
  s AS (SELECT voxel_id, roi_id, sum(CASE WHEN pos < 8 THEN a ELSE 0 END) AS share FROM lng GROUP BY 1, 2)
  SELECT roi_id, round(avg(share), 6) + 0.0 AS mean, round(median(share), 6) + 0.0 AS median, round(min(share), 6) + 0.0 AS min, round(max(share), 6) + 0.0 AS max FROM s GROUP BY 1""")
def q_channel_share(spark: SparkSession, d: str) -> DataFrame:
    shares = M.channel_share(signatures(spark, d), ["voxel_id", "roi_id"], list(range(8)))
    return rounded_all(M.share_summary(shares, ["roi_id"]), "mean", "median", "min", "max")


@query("""WITH lng AS (SELECT vec_id AS voxel_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS a FROM embeddings),
  r AS (SELECT *, row_number() OVER (PARTITION BY voxel_id ORDER BY a DESC, pos) AS r FROM lng)
  SELECT voxel_id, max(pos) FILTER (WHERE r = 1) AS first, max(pos) FILTER (WHERE r = 2) AS second, max(pos) FILTER (WHERE r = 3) AS third FROM r GROUP BY 1""")
def q_top_channels(spark: SparkSession, d: str) -> DataFrame:
    top = M.channel_share(signatures(spark, d), ["voxel_id"], [0])
    return top.select("voxel_id", *[F.col("top")[k].cast("bigint").alias(n) for k, n in enumerate(("first", "second", "third"))])


@query(f"""WITH {MEAN}, w AS (SELECT band, roi_id, y, CASE WHEN value > 1.05 THEN 'boosted' WHEN value < 0.95 THEN 'suppressed' ELSE 'neutral' END AS class, {ZONE} AS zone, CASE WHEN abs(x) <= 3 THEN 'MID' WHEN x < -3 THEN 'LH' ELSE 'RH' END AS side FROM m)
  SELECT band, class, zone, side, roi_id, count(*) AS n FROM w GROUP BY GROUPING SETS ((band, class, zone), (band, class, side), (band, class, roi_id))""")
def q_boosted_anatomy(spark: SparkSession, d: str) -> DataFrame:
    return M.boosted_anatomy(means(spark, d).withColumn("side", voxel_side(F.col("x"))), ["band"], "value")


@query(f"""WITH {MEAN}, c AS (SELECT band, roi_id, quantile_cont(value, 0.85) AS cut FROM m WHERE value > 0 GROUP BY 1, 2)
  SELECT recording_id, m.band, voxel_id, round(CASE WHEN round(value, 9) < round(cut, 9) THEN 0 ELSE value END, 6) + 0.0 AS value FROM m LEFT JOIN c ON m.band = c.band AND m.roi_id = c.roi_id""")
def q_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows = means(spark, d).withColumn("value", F.round("value", 9))
    return rounded_all(M.threshold_positive(rows, ["band", "roi_id"], 0.85).select(*RB, "voxel_id", "value"), "value")


@query(f"""WITH {MEAN}, q AS (SELECT recording_id, band, voxel_id, CASE WHEN value <> 0 THEN (value - avg(value) FILTER (WHERE value <> 0) OVER w) / nullif(stddev_pop(value) FILTER (WHERE value <> 0) OVER w, 0) END AS z FROM m WINDOW w AS (PARTITION BY recording_id, band)),
  r AS (SELECT recording_id, band, voxel_id, z FROM q), c AS (SELECT recording_id, band, quantile_cont(abs(z), 0.5) AS cut FROM r WHERE z IS NOT NULL GROUP BY 1, 2)
  SELECT recording_id, band, voxel_id, round(CASE WHEN abs(z) >= cut THEN z ELSE 0 END, 5) + 0.0 AS value FROM r LEFT JOIN c USING (recording_id, band)""")
def q_normalise_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(M.normalise_and_threshold(means(spark, d), RB, 0.5).select(*RB, "voxel_id", "value"), "value", digits=5)


CHANNELS = "(SELECT channel, -60::DOUBLE + 30 * (row_number() OVER (ORDER BY channel) - 1) AS x, 40::DOUBLE - 25 * (row_number() OVER (ORDER BY channel) - 1) AS y, 60::DOUBLE - 5 * (row_number() OVER (ORDER BY channel) - 1) AS z FROM (SELECT DISTINCT channel FROM ev))"
POINTS = "(VALUES (0, 0.0::DOUBLE, -40.0::DOUBLE, 50.0::DOUBLE), (1, -50.0::DOUBLE, 30.0::DOUBLE, 40.0::DOUBLE))"


def channel_places(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy("channel")) - 1  # a handful of channels
    return rows.select("channel").distinct().select("channel", (-60.0 + 30 * n).alias("x"), (40.0 - 25 * n).alias("y"), (60.0 - 5 * n).alias("z"))


def points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 0.0, -40.0, 50.0), (1, -50.0, 30.0, 40.0)], "point_id int, x double, y double, z double")


@query(f"""WITH {EV}, pw AS (SELECT recording_id, channel, round(avg(value * value), 9) AS power FROM ev GROUP BY 1, 2), ch AS {CHANNELS}, pt(point_id, x, y, z) AS {POINTS},
  r AS (SELECT pw.*, ch.x, ch.y, ch.z, row_number() OVER (PARTITION BY recording_id ORDER BY power DESC, channel) AS r, quantile_cont(power, 0.75) OVER (PARTITION BY recording_id) AS q FROM pw JOIN ch USING (channel)),
  w AS (SELECT recording_id, method, x, y, z, CASE method WHEN 'max_channel' THEN r = 1 WHEN 'top5_weighted' THEN r <= 5 WHEN 'triangulation' THEN r <= 3 ELSE power > q END AS used, power FROM r, (VALUES ('max_channel'), ('top5_weighted'), ('center_of_mass'), ('triangulation')) v(method)),
  e AS (SELECT recording_id, method, sum(power * x) FILTER (WHERE used) / nullif(sum(power) FILTER (WHERE used), 0) AS x, sum(power * y) FILTER (WHERE used) / nullif(sum(power) FILTER (WHERE used), 0) AS y, sum(power * z) FILTER (WHERE used) / nullif(sum(power) FILTER (WHERE used), 0) AS z FROM w GROUP BY 1, 2)
  SELECT recording_id, method, round(min(sqrt((e.x - pt.x) ** 2 + (e.y - pt.y) ** 2 + (e.z - pt.z) ** 2)), 5) + 0.0 AS error FROM e, pt GROUP BY 1, 2""")
def q_localise(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d)
    power = M.channel_power(rows, ["recording_id", "channel"]).withColumn("power", F.round("power", 9))
    return rounded_all(M.localise(power, channel_places(rows), ["recording_id"], points(spark)), "error", digits=5)


@query(f"""WITH {EV}, ch AS {CHANNELS}, pt(point_id, x, y, z) AS {POINTS}, r AS (SELECT point_id, sqrt((ch.x - pt.x) ** 2 + (ch.y - pt.y) ** 2 + (ch.z - pt.z) ** 2) AS d, sqrt(pt.x ** 2 + pt.y ** 2 + pt.z ** 2) AS p FROM ch, pt)
  SELECT point_id, count(*) FILTER (WHERE d < 30) AS within_30, count(*) FILTER (WHERE d < 50) AS within_50, round(first(p), 6) + 0.0 AS depth FROM r GROUP BY 1""")
def q_coverage_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(M.coverage_diagnostics(channel_places(samples(spark, d)), points(spark)), "depth")


@query(f"WITH {EV} SELECT recording_id, round(avg(value * value) / nullif(var_pop(value), 0), 5) + 0.0 AS snr FROM ev GROUP BY 1")
def q_signal_quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(M.signal_quality(samples(spark, d), ["recording_id"]), "snr", digits=5)


@query(f"""WITH {EV}, pw AS (SELECT channel, avg(value * value) AS power FROM ev GROUP BY 1), ch AS {CHANNELS}, pt(point_id, x, y, z) AS {POINTS},
  r AS (SELECT point_id, channel, power, 1 / (sqrt((ch.x - pt.x) ** 2 + (ch.y - pt.y) ** 2 + (ch.z - pt.z) ** 2) + 20) AS raw FROM pw JOIN ch USING (channel), pt),
  s AS (SELECT point_id, channel, power, raw / max(raw) OVER (PARTITION BY point_id) AS pattern FROM r), u AS (SELECT * FROM s UNION ALL SELECT NULL, channel, first(power), max(pattern) FROM s GROUP BY channel)
  SELECT point_id, round(corr(power, pattern), 5) + 0.0 AS r FROM u GROUP BY 1""")
def q_pattern_correlation(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d)
    return rounded_all(M.pattern_correlation(M.channel_power(rows, ["channel"]), channel_places(rows), points(spark)), "r", digits=5)


@query("SELECT event_type AS channel, count(value) AS n, round(min(value), 6) + 0.0 AS min, round(max(value), 6) + 0.0 AS max, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std FROM events GROUP BY 1")
def q_summary(spark: SparkSession, d: str) -> DataFrame:
    from gridscore.session import table

    return rounded_all(M.summary(table(spark, d, "events").withColumnRenamed("event_type", "channel"), ["channel"]), "min", "max", "mean", "std")


@query("SELECT DISTINCT p_brand AS name FROM part ANTI JOIN (SELECT DISTINCT 'Brand#1' || (l_linenumber % 5 + 1) AS p_brand FROM lineitem) USING (p_brand)")
def q_missing_names(spark: SparkSession, d: str) -> DataFrame:
    from gridscore.session import table

    names = table(spark, d, "part").select(F.col("p_brand").alias("name")).distinct()
    present = table(spark, d, "lineitem").select(F.concat(F.lit("Brand#1"), (F.col("l_linenumber") % 5 + 1).cast("string")).alias("name")).distinct()
    return M.missing_names(names, present, ["name"])


@query("""SELECT s_suppkey AS channel_id, CASE WHEN regexp_matches(s_name, '[13579]') THEN 'L' WHEN regexp_matches(s_name, '[2468]|10') THEN 'R' WHEN lower(s_name) LIKE '%z%' OR abs(s_acctbal) <= 3 THEN 'M' WHEN s_acctbal < -3 THEN 'L' ELSE 'R' END AS older,
  CASE WHEN regexp_extract(s_name, '(\\d+)$', 1) <> '' THEN CASE WHEN CAST(right(s_name, 1) AS INT) % 2 = 1 THEN 'L' ELSE 'R' END WHEN lower(s_name) LIKE '%z%' THEN 'M' WHEN s_acctbal < -3 THEN 'L' WHEN s_acctbal > 3 THEN 'R' ELSE 'M' END AS side FROM supplier""")
def q_channel_side(spark: SparkSession, d: str) -> DataFrame:
    from gridscore.functions.geometry import channel_side
    from gridscore.session import table

    n, x = F.col("s_name"), F.col("s_acctbal")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("channel_id"), channel_side_by_digit(n, x).alias("older"), channel_side(n, x).alias("side"))
