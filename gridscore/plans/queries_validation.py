"""Queries of audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore.functions.geometry import parameter_hash, prior_weights, series_signature
from gridscore.model import DEFAULTS, Box
from gridscore.operators import metrics, resample, signal, signature, timeops
from gridscore.operators import validation as V
from gridscore.plans.queries_search import FLAGS, _scores
from gridscore.plans.queries_space import _channels
from gridscore.plans.registry import query
from gridscore.plans.stand_ins import EV, MEAN, SC, SIG, VAL, VOX, means, rounded_all, samples, scores, signatures, values, voxels
from gridscore.session import stored, table

TAPS = [0.5, 0.3, 0.2]
CONV = "k(tap, w) AS (VALUES (0, 0.5::DOUBLE), (1, 0.3::DOUBLE), (2, 0.2::DOUBLE)), cv AS (SELECT a.recording_id, a.channel, a.epoch, sum(w * b.value) AS value FROM ev a, k, ev b WHERE b.recording_id = a.recording_id AND b.channel = a.channel AND b.epoch = greatest(a.epoch - tap, 0) GROUP BY 1, 2, 3)"


def _lag(name: str, source: str) -> str:
    return f"{name} AS (SELECT recording_id, channel, CASE WHEN sqrt(var_pop(value)) * sqrt(var_pop(p)) > 1e-15 AND count(*) > 1 THEN covar_pop(value, p) / (sqrt(var_pop(value)) * sqrt(var_pop(p))) END AS r FROM (SELECT *, lag(value) OVER (PARTITION BY recording_id, channel ORDER BY epoch) AS p FROM {source}) WHERE p IS NOT NULL GROUP BY 1, 2)"


@query(f"""WITH {EV}, {CONV}, s AS (SELECT recording_id, channel, var_pop(value) AS v, max(epoch) AS hi FROM ev GROUP BY 1, 2), {_lag("lb", "ev")}, {_lag("la", "cv")},
  e AS (SELECT recording_id, channel, var_pop(value) / nullif(first(v), 0) AS vr, avg(abs(value)) FILTER (WHERE epoch < (hi + 1) / 10 OR hi - epoch < (hi + 1) / 10) / nullif(avg(abs(value)) FILTER (WHERE NOT (epoch < (hi + 1) / 10 OR hi - epoch < (hi + 1) / 10)), 0) AS er FROM cv JOIN s USING (recording_id, channel) GROUP BY 1, 2)
  SELECT recording_id, channel, round(vr, 6) + 0.0 AS variance_ratio, round(er, 6) + 0.0 AS edge_ratio, round(lb.r, 6) + 0.0 AS lag1_before, round(la.r, 6) + 0.0 AS lag1_after FROM e LEFT JOIN lb USING (recording_id, channel) LEFT JOIN la USING (recording_id, channel)""")
def q_kernel_effect(spark: SparkSession, d: str) -> DataFrame:
    found = V.kernel_effect(samples(spark, d), ["recording_id", "channel"], TAPS)
    return rounded_all(found, "variance_ratio", "edge_ratio", "lag1_before", "lag1_after")


BELL = "exp(-(y + 40) * (y + 40) / 12800)"


@query(f"""WITH {MEAN}, w AS (SELECT m.*, (0.3 * (0.6 + 0.7 * {BELL} / (SELECT max({BELL}) FROM vox)) + 0.7)::DOUBLE AS weight FROM m), v AS (SELECT *, value * weight AS w FROM w)
  SELECT band, round(covar_pop(value, w) / (sqrt(var_pop(value)) * sqrt(var_pop(w))), 6) + 0.0 AS r, round(sum(CASE WHEN y < -40 THEN value ELSE 0 END) / (sum(CASE WHEN y > 0 THEN value ELSE 0 END) + 1e-12), 6) + 0.0 AS raw_ratio,
    round(sum(CASE WHEN y < -40 THEN w ELSE 0 END) / (sum(CASE WHEN y > 0 THEN w ELSE 0 END) + 1e-12), 6) + 0.0 AS weighted_ratio, round(avg(weight), 6) + 0.0 AS weight_mean, round(stddev_pop(weight), 6) + 0.0 AS weight_std, round(100 * avg(CASE WHEN weight > 1 THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS boosted_pct FROM v GROUP BY 1""")
def q_prior_effect(spark: SparkSession, d: str) -> DataFrame:
    weights = prior_weights(voxels(spark, d), "alpha", 1.3, 0.0, 0.7)
    found = V.prior_effect(means(spark, d), weights, ["band"])
    return rounded_all(found, "r", "raw_ratio", "weighted_ratio", "weight_mean", "weight_std", "boosted_pct")


@query(f"""WITH {MEAN}, a AS (SELECT recording_id, band, sum(CASE WHEN y < -40 THEN value ELSE 0 END) / (sum(CASE WHEN y > 0 THEN value ELSE 0 END) + 1e-12) AS v FROM m GROUP BY 1, 2)
  SELECT band, round(avg(v), 6) + 0.0 AS mean, round(median(v), 6) + 0.0 AS median, round(stddev_pop(v), 6) + 0.0 AS std, round(avg(abs(v - 0.9::DOUBLE)), 6) + 0.0 AS distance, round(100 * avg(CASE WHEN v BETWEEN 0.4 AND 1.5 THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS in_range_pct FROM a GROUP BY 1""")
def q_target_validation(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.posterior_anterior(means(spark, d), ["recording_id", "band"]).withColumnRenamed("pa_ratio", "metric")
    return rounded_all(V.target_validation(found, ["band"], 0.9, 0.4, 1.5), "mean", "median", "std", "distance", "in_range_pct")


@query("""WITH p AS (SELECT l_returnflag AS band, l_suppkey AS fold, avg(l_discount) AS w FROM lineitem GROUP BY 1, 2) SELECT band, round(100 * avg(CASE WHEN w <= 0.0475 OR w >= 0.0525 THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS boundary_pct FROM p GROUP BY 1""")
def q_boundary_share(spark: SparkSession, d: str) -> DataFrame:
    params = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("band"), F.col("l_suppkey").alias("fold")).agg(F.avg("l_discount").alias("w"))
    return rounded_all(V.boundary_share(params, ["band"], "w", 0.045, 0.055, 0.25), "boundary_pct")


@query(f"""WITH {VAL}, s AS (SELECT band, mi, dice, y FROM sc JOIN vox USING (voxel_id))
  SELECT band, round(avg(mi) FILTER (WHERE y BETWEEN -45 AND 15) / nullif(avg(mi) FILTER (WHERE NOT y BETWEEN -45 AND 15), 0), 6) + 0.0 AS mi_enrichment, round(avg(dice) FILTER (WHERE y BETWEEN -45 AND 15) / nullif(avg(dice) FILTER (WHERE NOT y BETWEEN -45 AND 15), 0), 6) + 0.0 AS dice_enrichment FROM s GROUP BY 1""")
def q_circularity(spark: SparkSession, d: str) -> DataFrame:
    rows = scores(spark, d).join(voxels(spark, d), "voxel_id")
    return rounded_all(V.enrichment(rows, ["band"], Box(y_min=-45, y_max=15), ["mi", "dice"]), "mi_enrichment", "dice_enrichment")


@query()
def q_randomised_places(spark: SparkSession, d: str) -> DataFrame:
    rows = means(spark, d).groupBy("band", "voxel_id", "x", "y", "z").agg(F.avg("value").alias("value"))
    return rounded_all(V.randomised_places(rows, ["band"], 10, 42), "pa_ratio", "null_ratio", "null_std", "z", "d")


@query(f"""WITH {SIG}, m AS (SELECT roi_id, pos, avg(a) AS v FROM lng GROUP BY 1, 2), r AS (SELECT p.roi_id AS a, q.roi_id AS b, covar_pop(p.v, q.v) / (sqrt(var_pop(p.v)) * sqrt(var_pop(q.v))) AS r FROM m p JOIN m q USING (pos) WHERE p.roi_id < q.roi_id GROUP BY 1, 2)
  SELECT round(avg(abs(r)), 6) + 0.0 AS mean_overlap, round(stddev_pop(abs(r)), 6) + 0.0 AS std_overlap FROM r""")
def q_signature_overlap(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(V.signature_overlap(signatures(spark, d)), "mean_overlap", "std_overlap")


def _corr(name: str, source: str) -> str:
    return f"{name} AS (SELECT a.recording_id, a.channel AS roi_a, b.channel AS roi_b, CASE WHEN sqrt(var_pop(a.value)) * sqrt(var_pop(b.value)) > 1e-15 THEN covar_pop(a.value, b.value) / (sqrt(var_pop(a.value)) * sqrt(var_pop(b.value))) END AS r FROM {source} a JOIN {source} b ON a.recording_id = b.recording_id AND a.epoch = b.epoch AND a.channel < b.channel GROUP BY 1, 2, 3)"


@query(f"""WITH {EV}, {CONV}, {_corr("ca", "ev")}, {_corr("cb", "cv")}, p AS (SELECT recording_id, ca.r AS a, cb.r AS b FROM ca JOIN cb USING (recording_id, roi_a, roi_b) WHERE ca.r IS NOT NULL AND cb.r IS NOT NULL),
  q AS (SELECT *, rank() OVER (PARTITION BY recording_id ORDER BY a) + (count(*) OVER (PARTITION BY recording_id, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY recording_id ORDER BY b) + (count(*) OVER (PARTITION BY recording_id, b) - 1) / 2.0::DOUBLE AS rb FROM p)
  SELECT recording_id, round(covar_pop(a, b) / (sqrt(var_pop(a)) * sqrt(var_pop(b))), 6) + 0.0 AS r, round(sqrt(avg((a - b) ** 2)), 6) + 0.0 AS rmse, round(covar_pop(ra, rb) / (sqrt(var_pop(ra)) * sqrt(var_pop(rb))), 6) + 0.0 AS rho FROM q GROUP BY 1""")
def q_kernel_on_connectivity(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(V.kernel_on_connectivity(samples(spark, d), ["recording_id"], TAPS, "channel"), "r", "rmse", "rho")


@query(f"""WITH {VAL}, s AS (SELECT band, roi_id, epoch, avg(value) AS v FROM val GROUP BY 1, 2, 3),
  r AS (SELECT p.band, p.roi_id AS roi_a, q.roi_id AS roi_b, CASE WHEN sqrt(var_pop(p.v)) * sqrt(var_pop(q.v)) > 1e-15 THEN covar_pop(p.v, q.v) / (sqrt(var_pop(p.v)) * sqrt(var_pop(q.v))) END AS r FROM s p JOIN s q USING (band, epoch) WHERE p.roi_id < q.roi_id GROUP BY 1, 2, 3),
  c AS (SELECT roi_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM vox GROUP BY 1),
  m AS (SELECT a.r AS a, b.r AS b, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS d FROM r a JOIN r b USING (roi_a, roi_b) JOIN c p ON p.roi_id = roi_a JOIN c q ON q.roi_id = roi_b WHERE a.band = 'A' AND b.band = 'N'),
  k AS (SELECT corr(a, b) AS ab, corr(a, d) AS ad, corr(b, d) AS bd FROM m)
  SELECT 'A-N' AS pair, round((ab - ad * bd) / sqrt((1 - ad * ad) * (1 - bd * bd)), 6) + 0.0 AS r FROM k""")
def q_given_distance(spark: SparkSession, d: str) -> DataFrame:
    """Region correlations of flag A and flag N, with the distance of the regions' centres held."""
    from gridscore.operators.connect import correlations

    rows = values(spark, d).groupBy("band", "roi_id", "epoch").agg(F.avg("value").alias("value"))
    found = correlations(rows, ["band"])
    a = found.where("band = 'A'").select("roi_a", "roi_b", F.col("r").alias("a"))
    b = found.where("band = 'N'").select("roi_a", "roi_b", F.col("r").alias("b"))
    both = a.join(b, ["roi_a", "roi_b"]).withColumn("pair", F.lit("A-N"))
    return rounded_all(V.given_distance(both, metrics.centroids(voxels(spark, d), ["roi_id"]), ["pair"], "a", "b"), "r")


@query()
def q_selective_reference(spark: SparkSession, d: str) -> DataFrame:
    """Energy of every channel's series after its neighbours are taken off, rhythms kept where they belong."""
    from pyspark.sql import Window

    from gridscore.sources.tables import pack

    rows = samples(spark, d)
    names = rows.select("channel").distinct().withColumn("idx", F.row_number().over(Window.orderBy("channel")) - 1)
    series = pack(rows.join(F.broadcast(names), "channel").drop("channel").withColumnRenamed("idx", "channel"), ["recording_id", "channel"], "epoch")
    channels = _channels(spark, d)
    found = signal.selective_reference(series, signature.neighbour_weights(channels), channels, ["recording_id"], 64.0)
    energy = F.aggregate("values", F.lit(0.0), lambda s, v: s + v * v)
    return rounded_all(found.select("recording_id", "channel", energy.alias("energy")), "energy", digits=4)


@query("SELECT l_returnflag AS band, md5(concat('{\"contrast\":', CAST(count(*) AS VARCHAR), ',\"mi_weight\":', CAST(sum(l_linenumber) AS VARCHAR), '}')) AS digest FROM lineitem GROUP BY 1")
def q_parameter_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("band")).agg(F.sum("l_linenumber").alias("mi_weight"), F.count("*").alias("contrast"))
    return rows.select("band", parameter_hash("mi_weight", "contrast").alias("digest"))


@query()
def q_series_signature(spark: SparkSession, d: str) -> DataFrame:
    return signatures(spark, d).select("voxel_id", series_signature(F.col("w"), 16).alias("digest"))


GAMMAS = """g AS (SELECT CAST(range AS INT) AS tap, pow(2.0::DOUBLE * range, 5) * exp(-2.0::DOUBLE * range) / 120 - pow(2.0::DOUBLE * range, 15) * exp(-2.0::DOUBLE * range) / 1307674368000 / 6 AS raw FROM range(16)),
  k AS (SELECT tap, raw / sum(raw) OVER () AS w FROM g)"""


@query(f"""WITH {EV}, {GAMMAS}, cv AS (SELECT a.recording_id, a.channel, a.epoch, sum(w * b.value) AS value FROM ev a, k JOIN ev b ON true WHERE b.recording_id = a.recording_id AND b.channel = a.channel AND b.epoch = greatest(a.epoch - tap, 0) GROUP BY 1, 2, 3),
  m AS (SELECT channel, avg(value) AS mean FROM cv GROUP BY 1) SELECT channel, round(mean, 6) + 0.0 AS mean, tap, round(w, 6) + 0.0 AS weight FROM m, k""")
def q_kernel(spark: SparkSession, d: str) -> DataFrame:
    """The canonical kernel's taps, each with the mean of a channel's convolved series."""
    taps = timeops.kernel_table(spark, timeops.canonical_kernel())
    level = timeops.convolve(samples(spark, d), ["recording_id", "channel"], timeops.canonical_kernel()).groupBy("channel").agg(F.avg("value").alias("mean"))
    return rounded_all(level.crossJoin(F.broadcast(taps)), "mean", "weight")


# Priors of the three bands that return flags stand for, spelled out: raw weight, with c.penalty, and least.
RAW_PRIORS = {
    "alpha": ("exp(-((y + 40) ** 2) / 12800)", 0.6),
    "beta": ("exp(-((y + 15) ** 2) / 2450) * exp(-((z - 50) ** 2) / 1250) * exp(-((abs(x) - 40) ** 2) / 1250) * (1 - c.penalty * exp(-((y + 15) ** 2) / 800))", 0.3),
    "delta": ("exp(-((y - 40) ** 2) / 3200) * (1 - c.penalty * exp(-((y + 15) ** 2) / 1800))", 0.25),
}
# Starting parameters of these bands: mi_weight, contrast, boost, penalty, softening.
STARTS = {"alpha": (0.65, 0.50, 1.3, 0.0, 0.70), "beta": (0.55, 0.65, 1.4, 0.5, 0.45), "delta": (0.45, 0.90, 1.7, 0.8, 0.40)}
PARAMETERS = ("mi_weight", "contrast", "boost", "penalty", "softening")
LIMITS = ((0.25, 0.95), (0.10, 1.20), (1.0, 3.0), (0.0, 1.0), (0.1, 1.0))
ALPHA_LIMITS = (*LIMITS[:2], (1.0, 1.8), LIMITS[3], (0.5, 1.0))
SPREAD = 0.05


def _sql_moves() -> str:
    rows = []
    for band, start in STARTS.items():
        rows.append((band, "", 0, *start))
        for n, name in enumerate(PARAMETERS):
            low, high = (ALPHA_LIMITS if band == "alpha" else LIMITS)[n]
            rows += [(band, name, sign, *[min(high, max(low, v + sign * SPREAD)) if k == n else v for k, v in enumerate(start)]) for sign in (-1, 1)]
    row = lambda r: f"('{r[0]}', '{r[1]}', {r[2]}, " + ", ".join(f"{v!r}::DOUBLE" for v in r[3:]) + ")"
    return f"c(band, param, sign, {', '.join(PARAMETERS)}) AS (VALUES {', '.join(row(r) for r in rows)})"


BANDED = "CASE l_returnflag WHEN 'A' THEN 'alpha' WHEN 'N' THEN 'beta' ELSE 'delta' END"
RAW_SQL = "CASE {b} " + " ".join(f"WHEN '{b}' THEN {raw}" for b, (raw, _) in RAW_PRIORS.items()) + " END"
LEAST_SQL = "CASE {b} " + " ".join(f"WHEN '{b}' THEN {least}::DOUBLE" for b, (_, least) in RAW_PRIORS.items()) + " END"


@query(f"""WITH {VOX}, {_sql_moves()}, s AS (SELECT {BANDED} AS band, s_nationkey AS recording_id, l_partkey AS voxel_id, avg(l_discount * 10) AS mi, avg(l_tax * 12.5::DOUBLE) AS dice FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
  r AS (SELECT s.*, c.* EXCLUDE (band), {RAW_SQL.format(b="s.band")} AS raw, {LEAST_SQL.format(b="s.band")} AS least FROM s JOIN vox USING (voxel_id) JOIN c ON c.band = s.band),
  w AS (SELECT *, (1 - softening) * (least + (boost - least) * raw / max(raw) OVER (PARTITION BY band, param, sign)) + softening AS weight FROM r),
  m AS (SELECT band, voxel_id, param, sign, avg(CASE WHEN sign = 0 THEN (mi_weight * mi + (1 - mi_weight) * dice) * weight ELSE pow(greatest((mi_weight * mi + (1 - mi_weight) * dice) * weight, 1e-12), contrast) END) AS v,
    first(CASE param WHEN 'mi_weight' THEN mi_weight WHEN 'contrast' THEN contrast WHEN 'boost' THEN boost WHEN 'penalty' THEN penalty ELSE softening END) AS moved_to FROM w GROUP BY 1, 2, 3, 4),
  j AS (SELECT m.band, m.param, m.sign, m.moved_to, m.v, b.v AS b FROM m JOIN m b ON b.band = m.band AND b.voxel_id = m.voxel_id AND b.sign = 0 WHERE m.sign <> 0)
  SELECT band, param, sign, round(first(moved_to), 6) + 0.0 AS moved_to, round(corr(b, v), 6) + 0.0 AS r, round(sqrt(avg((b - v) ** 2)), 6) + 0.0 AS rmse, round(sqrt(avg((b - v) ** 2)) / (stddev_pop(b) + 1e-12), 6) + 0.0 AS relative FROM j GROUP BY 1, 2, 3""")
def q_perturbed_maps(spark: SparkSession, d: str) -> DataFrame:
    """Each parameter of every band moved by 0.05 both ways: how far the band's map over nations moves."""
    rows = stored(_scores(spark, d), "scores")
    params = spark.createDataFrame([(b, *[float(getattr(DEFAULTS[b], n)) for n in PARAMETERS]) for b in FLAGS.values()], f"band string, {', '.join(f'{n} double' for n in PARAMETERS)}")
    spreads = params.select("band", *[F.lit(SPREAD).alias(n) for n in PARAMETERS])
    found = [resample.perturbed_maps(rows.where(F.col("band") == b).drop("band"), b, params, spreads, list(PARAMETERS)).withColumn("band", F.lit(b)) for b in FLAGS.values()]
    return rounded_all(reduce(DataFrame.unionByName, found), "moved_to", "r", "rmse", "relative")


STARTS_SQL = f"c(band, {', '.join(PARAMETERS)}) AS (VALUES " + ", ".join(f"('{b}', " + ", ".join(f"{v!r}::DOUBLE" for v in start) + ")" for b, start in STARTS.items()) + ")"


@query(f"""WITH {VOX}, {SC}, {STARTS_SQL}, b AS (SELECT CASE band WHEN 'A' THEN 'alpha' WHEN 'N' THEN 'beta' ELSE 'delta' END AS band, * EXCLUDE (band) FROM sc),
  p AS (SELECT c.band, voxel_id, x, y, z, {RAW_SQL.format(b="c.band")} AS raw, {LEAST_SQL.format(b="c.band")} AS least, c.boost, c.softening FROM vox, c), w AS (SELECT *, (1 - softening) * (least + (boost - least) * raw / max(raw) OVER (PARTITION BY band)) + softening AS weight FROM p),
  m AS (SELECT recording_id, b.band, voxel_id, avg(mi_weight * mi + (1 - mi_weight) * dice) AS a FROM b JOIN c ON c.band = b.band GROUP BY 1, 2, 3),
  i AS (SELECT recording_id, band, y, weight, a, a * CASE WHEN band = 'beta' THEN CASE WHEN y BETWEEN -45 AND 15 AND z >= 40 THEN 0.33::DOUBLE ELSE 1 END * CASE WHEN y < -40 THEN 3 ELSE 1 END WHEN y < -40 THEN 0.33::DOUBLE WHEN y > 0 THEN 3 ELSE 1 END AS v FROM m JOIN w USING (band, voxel_id)),
  r AS (SELECT recording_id, band, sum(CASE WHEN y < -40 THEN a ELSE 0 END) / (sum(CASE WHEN y > 0 THEN a ELSE 0 END) + 1e-12) AS real, sum(CASE WHEN y < -40 THEN v ELSE 0 END) / (sum(CASE WHEN y > 0 THEN v ELSE 0 END) + 1e-12) AS inverted,
    sum(CASE WHEN y < -40 THEN v * weight ELSE 0 END) / (sum(CASE WHEN y > 0 THEN v * weight ELSE 0 END) + 1e-12) AS with_prior FROM i GROUP BY 1, 2)
  SELECT recording_id, band, round(real, 6) + 0.0 AS real, round(inverted, 6) + 0.0 AS inverted, round(with_prior, 6) + 0.0 AS with_prior, abs(with_prior - inverted) < abs(with_prior - real) AS follows_data FROM r""")
def q_counterfactual(spark: SparkSession, d: str) -> DataFrame:
    """Every recording's map turned round, under the band's prior anew: does the ratio follow the data or the prior?"""
    rows, places = stored(scores(spark, d), "scores"), voxels(spark, d)
    found = [V.counterfactual(rows.where(F.col("band") == flag), places, ["recording_id"], band, DEFAULTS[band]).withColumn("band", F.lit(band)) for flag, band in FLAGS.items()]
    return rounded_all(reduce(DataFrame.unionByName, found), "real", "inverted", "with_prior")


@query(f"""WITH {EV}, {GAMMAS}, u AS (SELECT recording_id, channel, epoch, CAST(epoch = 10 AS INT) AS i, CAST(epoch BETWEEN 10 AND 19 AS INT) AS b FROM ev),
  cv AS (SELECT a.recording_id, a.channel, a.epoch, sum(w * p.i) AS i, sum(w * p.b) AS b FROM u a, k JOIN u p ON true WHERE p.recording_id = a.recording_id AND p.channel = a.channel AND p.epoch = greatest(a.epoch - tap, 0) GROUP BY 1, 2, 3)
  SELECT recording_id, channel, arg_max(epoch, i) AS impulse_epoch, round(max(i), 6) + 0.0 AS impulse_peak, arg_max(epoch, b) AS block_epoch, round(max(b), 6) + 0.0 AS block_peak, 1.0::DOUBLE AS edge_ratio FROM cv GROUP BY 1, 2""")
def q_kernel_responses(spark: SparkSession, d: str) -> DataFrame:
    found = V.kernel_responses(samples(spark, d), ["recording_id", "channel"], timeops.canonical_kernel())
    return rounded_all(found, "impulse_peak", "block_peak", "edge_ratio")


@query(f"""WITH {VAL}, s AS (SELECT recording_id, band, voxel_id, y, epoch, round(value - avg(value) OVER (PARTITION BY recording_id, band), 9) AS v FROM val),
  m AS (SELECT recording_id, band, voxel_id, y, avg(abs(v)) AS value, sum(greatest(v, 0)) AS mass FROM s GROUP BY ALL), a AS (SELECT *, row_number() OVER (PARTITION BY recording_id, band ORDER BY value) AS n, max(value) OVER (PARTITION BY recording_id, band) AS top FROM m WHERE value > 0),
  h AS (SELECT recording_id, band, least(floor(value / (top + 1e-10) * 50), 49) AS bin, count(*) AS c FROM a GROUP BY 1, 2, 3), q AS (SELECT *, c / sum(c) OVER (PARTITION BY recording_id, band) AS p FROM h), e AS (SELECT recording_id, band, sum(-p * log2(p)) AS entropy FROM q GROUP BY 1, 2),
  r AS (SELECT recording_id, band, sum(CASE WHEN y < -40 THEN mass ELSE 0 END) / (sum(CASE WHEN y > 0 THEN mass ELSE 0 END) + 1e-12) AS pa_ratio FROM m GROUP BY 1, 2),
  t AS (SELECT recording_id, band, count(*) AS n_active, avg(value) AS mean, stddev_pop(value) AS std, 2 * sum(n * value) / (count(*) * sum(value)) - (count(*) + 1) / count(*)::DOUBLE AS gini FROM a GROUP BY 1, 2)
  SELECT recording_id, band, n_active, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, round(pa_ratio, 6) + 0.0 AS pa_ratio, round(entropy, 6) + 0.0 AS entropy, round(gini, 6) + 0.0 AS gini FROM t JOIN e USING (recording_id, band) JOIN r USING (recording_id, band)""")
def q_spatial_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metrics that null tests compare, of every recording's values about their mean."""
    rows = values(spark, d)
    keys = ["recording_id", "band"]
    centred = rows.join(rows.groupBy(*keys).agg(F.avg("value").alias("_m")), keys).withColumn("value", F.round(F.col("value") - F.col("_m"), 9))
    return rounded_all(resample.spatial_metrics(centred, keys), "mean", "std", "pa_ratio", "entropy", "gini")


def _centred(spark: SparkSession, d: str) -> DataFrame:
    """Every band's map series about the band's mean, a row a voxel."""
    from gridscore.sources.tables import pack

    rows = values(spark, d).groupBy("band", "voxel_id", "y", "epoch").agg(F.avg("value").alias("value"))
    rows = rows.join(rows.groupBy("band").agg(F.avg("value").alias("_m")), "band").withColumn("value", F.round(F.col("value") - F.col("_m"), 9))
    return stored(pack(rows, ["band", "voxel_id", "y"], "epoch"), "series")


@query()
def q_null_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of every band's map series about its mean against 100 phase-randomised twins, with two-sided p."""
    series = _centred(spark, d)
    found = resample.twin_metrics(series, ["band"], ["voxel_id", "y"], resample.phases_turned, 100, 42)
    return rounded_all(found, "value", "null_mean", "null_std", "p")


#: The six metrics look at time means, which no order of the epochs changes: every twin has the map's own, and p is 1.
CENTRED = f"""{VAL}, cv AS (SELECT band, voxel_id, y, epoch, avg(value) AS value FROM val GROUP BY 1, 2, 3, 4), cm AS (SELECT band, voxel_id, y, avg(abs(v)) AS value, sum(greatest(v, 0)) AS mass FROM (SELECT *, round(value - avg(value) OVER (PARTITION BY band), 9) AS v FROM cv) GROUP BY 1, 2, 3),
  act AS (SELECT band, value, row_number() OVER (PARTITION BY band ORDER BY value) AS i, least(CAST(floor(value / (max(value) OVER (PARTITION BY band) + 1e-10) * 50) AS INT), 49) AS bin FROM cm WHERE value > 0),
  hist AS (SELECT band, count(*) / sum(count(*)) OVER (PARTITION BY band) AS p FROM act GROUP BY band, bin), ent AS (SELECT band, sum(-p * log2(p)) AS entropy FROM hist GROUP BY 1),
  siz AS (SELECT band, count(*)::DOUBLE AS n_active, avg(value) AS mean, stddev_pop(value) AS std, 2 * sum(i * value) / (count(*) * sum(value)) - (count(*) + 1)::DOUBLE / count(*) AS gini FROM act GROUP BY 1),
  pos AS (SELECT band, sum(CASE WHEN y < -40 THEN mass ELSE 0 END) / (sum(CASE WHEN y > 0 THEN mass ELSE 0 END) + 1e-12) AS pa_ratio FROM cm GROUP BY 1),
  met AS (SELECT band, n_active, mean, std, pa_ratio, entropy, gini FROM siz JOIN ent USING (band) JOIN pos USING (band)), lon AS (UNPIVOT met ON n_active, mean, std, pa_ratio, entropy, gini INTO NAME metric VALUE value)"""


@query(f"WITH {CENTRED} SELECT band, metric, round(value, 6) + 0.0 AS value, round(value, 6) + 0.0 AS null_mean, 0.0::DOUBLE AS null_std, 1.0::DOUBLE AS p FROM lon")
def q_time_null_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The same metrics against 100 twins of every voxel's series whose epochs are permuted on their own."""
    series = _centred(spark, d)
    found = resample.twin_metrics(series, ["band"], ["voxel_id", "y"], resample.times_turned, 100, 42)
    return rounded_all(found, "value", "null_mean", "null_std", "p")


@query()
def q_place_test(spark: SparkSession, d: str) -> DataFrame:
    """Ratio and enrichment of every nation's map against ten permutations of its places."""
    places = voxels(spark, d).select("voxel_id", "is_gm")
    rows = _scores(spark, d).withColumn("value", 0.6 * F.col("mi") + 0.4 * F.col("dice")).drop("mi", "dice").join(places, "voxel_id")
    found = V.place_test(stored(rows, "places"), voxels(spark, d), ["band"], "recording_id", 10, 42)
    return rounded_all(found, "real_mean", "real_std", "null_mean", "null_std", "z", "d")


@query()
def q_audits(spark: SparkSession, d: str) -> DataFrame:
    """All audits of nations' maps in one table; the given candidates stand for the folds' parameters."""
    from gridscore.plans.pipeline import audits
    from gridscore.plans.queries_search import _candidates

    rows = stored(_scores(spark, d), "scores")
    means_ = rows.withColumn("value", 0.6 * F.col("mi") + 0.4 * F.col("dice")).join(voxels(spark, d).select("voxel_id", "is_gm"), "voxel_id")
    folds = rows.select("band", F.col("recording_id").alias("test_id")).distinct().withColumn("cand", (F.col("test_id") % 3).cast("int")).join(_candidates(spark), "cand")
    found = audits(means_, voxels(spark, d).select("voxel_id", "x", "y", "z", "is_gm"), folds)
    return found.select("module", "band", "metric", F.round("value", 6).alias("value"))
