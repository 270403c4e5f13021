"""Queries of connectivity and of statistics on groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore.functions.geometry import effect_size, risk, significance
from gridscore.operators import connect as C
from gridscore.operators import resample as R
from gridscore.plans.registry import query
from gridscore.plans.stand_ins import EV, MEAN, VAL, means, rounded, rounded_all, samples, values
from gridscore.session import dealt, stored, table

PAIRS = "p AS (SELECT a.recording_id, a.epoch, a.channel AS roi_a, b.channel AS roi_b, a.value AS x, b.value AS y FROM ev a JOIN ev b USING (recording_id, epoch) WHERE a.channel < b.channel)"
R_OF = "CASE WHEN sqrt(var_pop(x)) * sqrt(var_pop(y)) > 1e-15 THEN covar_pop(x, y) / (sqrt(var_pop(x)) * sqrt(var_pop(y))) END"


@query(f"WITH {EV}, {PAIRS} SELECT recording_id, roi_a, roi_b, round({R_OF}, 6) + 0.0 AS r FROM p GROUP BY 1, 2, 3")
def q_roi_corr(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(C.correlations(samples(spark, d), ["recording_id"], "channel"), "r")


@query(f"WITH {EV}, {PAIRS}, c AS (SELECT recording_id, roi_a, roi_b, {R_OF} AS r FROM p GROUP BY 1, 2, 3) SELECT roi_a, roi_b, round(avg(r), 6) + 0.0 AS r, round(avg(atanh(greatest(-0.999999, least(0.999999, r)))), 6) + 0.0 AS z FROM c GROUP BY 1, 2")
def q_fisher_z(spark: SparkSession, d: str) -> DataFrame:
    found = C.correlations(samples(spark, d), ["recording_id"], "channel").withColumn("z", C.fisher_z(F.col("r")))
    both = C.group_mean(found, []).join(C.group_mean(found, [], "z"), ["roi_a", "roi_b"])
    return rounded_all(both, "r", "z")


@query(f"""WITH {VAL}, s AS (SELECT band, avg(value) AS a, avg(value * value) AS b, avg(x) AS g, roi_id FROM val GROUP BY band, roi_id), c AS (SELECT band, corr(a, b) AS ab, corr(a, g) AS ag, corr(b, g) AS bg FROM s GROUP BY 1)
  SELECT band, round((ab - ag * bg) / sqrt((1 - ag * ag) * (1 - bg * bg)), 6) + 0.0 AS r FROM c""")
def q_partial_given_dist(spark: SparkSession, d: str) -> DataFrame:
    rows = values(spark, d).groupBy("band", "roi_id").agg(F.avg("value").alias("a"), F.avg(F.col("value") * F.col("value")).alias("b"), F.avg("x").alias("g"))
    return rounded_all(C.partial_given(rows, ["band"], "a", "b", "g"), "r")


@query(f"""WITH {EV}, k AS (SELECT channel, epoch, recording_id, value, recording_id * 7 % 13 AS w FROM ev), r AS (SELECT channel, rank() OVER (PARTITION BY channel ORDER BY value) + (count(*) OVER (PARTITION BY channel, value) - 1) / 2.0::DOUBLE AS x,
    rank() OVER (PARTITION BY channel ORDER BY w) + (count(*) OVER (PARTITION BY channel, w) - 1) / 2.0::DOUBLE AS y FROM k) SELECT channel, round({R_OF}, 6) + 0.0 AS r FROM r GROUP BY 1""")
def q_spearman(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d).withColumn("w", F.col("recording_id") * 7 % 13)
    return rounded_all(C.rank_correlation(rows, ["channel"], "value", "w"), "r")


@query(f"""WITH {MEAN}, g AS (SELECT band, voxel_id, avg(value) AS a, avg(value * CASE WHEN y < -40 THEN 1.0 / 3 WHEN y > 0 THEN 3 ELSE 1 END::DOUBLE) AS b FROM m GROUP BY 1, 2)
  SELECT band, round(covar_pop(a, b) / (sqrt(var_pop(a)) * sqrt(var_pop(b))), 6) + 0.0 AS r, round(sqrt(avg((a - b) ** 2)), 6) + 0.0 AS rmse FROM g GROUP BY 1""")
def q_map_difference(spark: SparkSession, d: str) -> DataFrame:
    rows = means(spark, d)
    inverted = R.invert_regions(rows).groupBy("band", "voxel_id").agg(F.avg("value").alias("b"))
    plain = rows.groupBy("band", "voxel_id").agg(F.avg("value").alias("a"))
    return rounded_all(C.difference(plain.join(inverted, ["band", "voxel_id"]), ["band"], "a", "b"), "r", "rmse")


@query()
def q_shrunk_partial(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(C.shrunk_partial(samples(spark, d), ["recording_id"], "channel"), "partial")


@query(f"""WITH {EV}, m AS (SELECT channel, epoch AS rater, recording_id AS subject, value FROM ev), g AS (SELECT channel, avg(value) AS g FROM m GROUP BY 1), s AS (SELECT channel, subject, avg(value) AS a FROM m GROUP BY 1, 2), r AS (SELECT channel, rater, avg(value) AS a FROM m GROUP BY 1, 2),
  q AS (SELECT channel, (SELECT count(*) FROM s WHERE s.channel = g.channel) AS n, (SELECT count(*) FROM r WHERE r.channel = g.channel) AS k, (SELECT sum((a - g) ** 2) FROM s WHERE s.channel = g.channel) AS ss, (SELECT sum((a - g) ** 2) FROM r WHERE r.channel = g.channel) AS sr, (SELECT sum((value - g) ** 2) FROM m WHERE m.channel = g.channel) AS st FROM g),
  f AS (SELECT channel, n, k * ss / (n - 1) AS msr, n * sr / (k - 1) AS msc, (st - k * ss - n * sr) / ((n - 1) * (k - 1)) AS mse FROM q) SELECT channel, round((msr - mse) / (msr + (msc - mse) / n), 6) + 0.0 AS icc FROM f""")
def q_icc(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(R.icc_2k(samples(spark, d), ["channel"], "recording_id", "epoch"), "icc")


@query(f"""WITH {MEAN}, x AS (SELECT band, roi_id, value, median(value) OVER (PARTITION BY band, roi_id) AS med FROM m), a AS (SELECT band, roi_id, first(med) AS median, median(abs(value - med)) AS mad, count(*) AS n FROM x GROUP BY 1, 2)
  SELECT band, roi_id, round(median, 6) + 0.0 AS median, round(mad, 6) + 0.0 AS mad, round(1.4826 * mad, 6) + 0.0 AS robust_std, round(greatest(median - 1.96 * 1.4826 * mad / sqrt(n), 0), 6) + 0.0 AS low, round(least(median + 1.96 * 1.4826 * mad / sqrt(n), 1), 6) + 0.0 AS high FROM a""")
def q_robust_mad(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(R.robust(means(spark, d), ["band", "roi_id"]), "median", "mad", "robust_std", "low", "high")


GROUP = "round(value, 9) AS value, y < -20 AS g"


@query(f"""WITH {MEAN}, v AS (SELECT band, {GROUP} FROM m), r AS (SELECT *, rank() OVER (PARTITION BY band ORDER BY value) + (count(*) OVER (PARTITION BY band, value) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY band, value) AS t FROM v),
  s AS (SELECT band, sum(r) FILTER (WHERE g) AS s, count(*) FILTER (WHERE g)::DOUBLE AS n1, count(*) FILTER (WHERE NOT g)::DOUBLE AS n2, sum(t * t - 1.0::DOUBLE) AS ties FROM r GROUP BY 1)
  SELECT band, s - n1 * (n1 + 1) / 2 AS u, n1, n2, round((s - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) + 0.0 AS z FROM s""")
def q_mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    rows = means(spark, d).select("band", F.round("value", 9).alias("value"), (F.col("y") < -20).alias("g"))
    return rounded_all(R.mann_whitney(rows, ["band"], "g"), "z")


@query(f"""WITH {MEAN}, v AS (SELECT band, {GROUP} FROM m), e AS (SELECT band, (avg(value) FILTER (WHERE g) - avg(value) FILTER (WHERE NOT g)) / sqrt((var_samp(value) FILTER (WHERE g) + var_samp(value) FILTER (WHERE NOT g)) / 2) AS d FROM v GROUP BY 1)
  SELECT band, round(d, 6) + 0.0 AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS size FROM e""")
def q_cohen_d(spark: SparkSession, d: str) -> DataFrame:
    rows = means(spark, d).select("band", F.round("value", 9).alias("value"), (F.col("y") < -20).alias("g"))
    return R.cohen_d(rows, ["band"], "g").select("band", rounded("d").alias("d"), effect_size(F.col("d")).alias("size"))


@query("""WITH v AS (SELECT l_returnflag AS band, l_linestatus AS g, l_quantity AS value FROM lineitem), z AS (SELECT band, g, abs(value - median(value) OVER (PARTITION BY band, g)) AS z FROM v),
  p AS (SELECT band, g, count(*) AS n, avg(z) AS zm, sum(z) AS zs, sum(z * z) AS z2 FROM z GROUP BY 1, 2), t AS (SELECT band, sum(n) AS n, count(*) AS k, sum(zs) / sum(n) AS grand, sum(n * zm * zm) AS b, sum(z2 - n * zm * zm) AS w FROM p GROUP BY 1)
  SELECT band, round((n - k) * (b - n * grand * grand) / ((k - 1) * w), 6) + 0.0 AS w, CAST(k - 1 AS BIGINT) AS df1, CAST(n - k AS BIGINT) AS df2 FROM t""")
def q_levene(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("band"), F.col("l_linestatus").alias("g"), F.col("l_quantity").alias("value"))
    return rounded_all(R.levene(rows, ["band"], "g"), "w")


@query(f"""WITH {MEAN}, r AS (SELECT recording_id, band, sum(CASE WHEN y < -40 THEN value ELSE 0 END) / (sum(CASE WHEN y > 0 THEN value ELSE 0 END) + 1e-12) AS a,
    sum(CASE WHEN y < -40 THEN value / 3 ELSE 0 END) / (sum(CASE WHEN y > 0 THEN value * 3 ELSE 0 END) + 1e-12) AS b FROM m GROUP BY 1, 2)
  SELECT recording_id, band, round(a, 6) + 0.0 AS original, round(b, 6) + 0.0 AS inverted, CASE WHEN abs(b * 1.5 - a) <= abs(b * 1.5 - b) THEN 'original' ELSE 'inverted' END AS closer FROM r""")
def q_inversion(spark: SparkSession, d: str) -> DataFrame:
    from gridscore.operators.metrics import posterior_anterior

    keys = ["recording_id", "band"]
    rows = means(spark, d)
    a = posterior_anterior(rows, keys).select(*keys, F.col("pa_ratio").alias("original"))
    b = posterior_anterior(R.invert_regions(rows), keys).select(*keys, F.col("pa_ratio").alias("inverted"))
    joined = a.join(b, keys)
    return joined.select(*keys, rounded("original").alias("original"), rounded("inverted").alias("inverted"), R.closer_to(F.col("inverted") * 1.5, F.col("original"), F.col("inverted")).alias("closer"))


@query(f"""WITH {MEAN}, a AS (SELECT recording_id, band, sum(CASE WHEN y < -40 THEN value ELSE 0 END) / (sum(CASE WHEN y > 0 THEN value ELSE 0 END) + 1e-12) AS metric FROM m GROUP BY 1, 2),
  s AS (SELECT band, avg(metric) AS mean, stddev_pop(metric) AS std, 100 * avg(CASE WHEN metric BETWEEN 0.4 AND 1.5 THEN 1.0::DOUBLE ELSE 0 END) AS in_range_pct, avg(abs(metric - 0.9)) AS deviation FROM a GROUP BY 1)
  SELECT band, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, round(in_range_pct, 6) + 0.0 AS in_range_pct, round(deviation, 6) + 0.0 AS deviation, round(100 * std / (abs(mean) + 1e-12), 6) + 0.0 AS cv, CASE WHEN 100 * std / (abs(mean) + 1e-12) < 30 THEN 'stable' ELSE 'unstable' END AS verdict,
    CASE WHEN in_range_pct > 50 THEN 'HIGH' WHEN in_range_pct > 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM s""")
def q_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    from gridscore.operators.metrics import posterior_anterior

    found = posterior_anterior(means(spark, d), ["recording_id", "band"]).withColumnRenamed("pa_ratio", "metric")
    out = R.sensitivity(found, ["band"], F.lit(0.9), F.lit(0.4), F.lit(1.5)).withColumn("risk", risk(F.col("in_range_pct")))
    return rounded_all(out, "mean", "std", "in_range_pct", "deviation", "cv")


@query()
def q_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrapped best blend per band: which of three weights has the best mean ratio when suppliers are resampled."""
    rows = means(spark, d).groupBy("band", "recording_id").agg(F.avg("value").alias("v"), F.avg(F.when(F.col("y") < 0, F.col("value")).otherwise(0.0)).alias("p"))
    scored = rows.select("band", "recording_id", F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7))).alias("w"), "v", "p").withColumn("m", F.col("w") * F.col("v") - F.abs(F.col("p") - F.col("w") * 0.5))
    boots = R.bootstrap_pick(scored, ["band"], "recording_id", "w", "m", 100, 42)
    return rounded_all(R.spread_of(boots, ["band"], "w"), "mean", "median", "std", "low", "high")


@query()
def q_perm_null(spark: SparkSession, d: str) -> DataFrame:
    """Six metrics of every band's mean map against maps whose weights are permuted over their places."""
    rows = stored(means(spark, d).groupBy("band", "voxel_id", "x", "y", "z").agg(F.avg("value").alias("value")), "maps")
    null = stored(R.permutation_metrics(rows, ["band"], 500, 42), "null")
    found = R.null_table(R.weight_metrics(rows, ["band"]), null, ["band"], R.WEIGHT_METRICS).withColumn("stars", significance(F.col("p")))
    return rounded_all(found, "value", "null_mean", "null_std", "p")


@query()
def q_time_null(spark: SparkSession, d: str) -> DataFrame:
    """Lag-1 correlation of every channel's series against series whose days are permuted."""
    from gridscore.operators.timeops import lag1_array
    from gridscore.sources.tables import pack

    keys = ["recording_id", "channel"]
    series = stored(pack(samples(spark, d), keys, "epoch"), "series")
    r = lag1_array(F.col("values")).alias("r")
    null = R.time_permuted(series, keys, 100, 42).select("channel", "perm", r).groupBy("channel", "perm").agg(F.avg("r").alias("r"))
    real = series.select("channel", r).groupBy("channel").agg(F.avg("r").alias("r"))
    return rounded_all(R.two_sided(real, null, ["channel"], "r"), "r", "null_mean", "null_std", "p")


@query()
def q_bootstrap_folds(spark: SparkSession, d: str) -> DataFrame:
    """Which of three weights lies nearest to half the nations' ratios, for every nation held out, when the others are resampled."""
    from gridscore.operators.metrics import posterior_anterior

    nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("recording_id"), F.col("s_nationkey").alias("nation"))
    ratios = posterior_anterior(means(spark, d).join(nations, "recording_id"), ["band", "nation"])
    scored = ratios.select("band", "nation", F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7))).alias("w"), "pa_ratio").withColumn("m", -F.abs(F.col("w") - F.col("pa_ratio") * 0.53))
    return rounded_all(R.bootstrap_folds(scored, ["band"], "nation", "w", "m", 100, 42), "mean", "median", "std", "low", "high")


@query()
def q_phase_null(spark: SparkSession, d: str) -> DataFrame:
    """Mean size of series against their phase-randomised twins: amplitudes, and so power, stay; how values spread doesn't."""
    from gridscore.sources.tables import pack

    keys = ["recording_id", "channel"]
    packed = stored(pack(samples(spark, d), keys, "epoch"), "series")
    # small series make many twins, which are what a task's work grows with
    found = R.phase_randomised(dealt(packed, packed.count() * 100, *keys), keys, 100, 42, summed=True).select(*keys, "size", "null_mean", "null_std", "p", "power", "null_power")
    return rounded_all(found, "power", "null_power", "size", "null_mean", "null_std", "p")
