"""Queries of operators along epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore.operators import timeops as T
from gridscore.plans.registry import query
from gridscore.plans.stand_ins import EV, rounded_all, samples
from gridscore.session import table

RC = ["recording_id", "channel"]
W = "WINDOW w AS (PARTITION BY recording_id, channel ORDER BY epoch)"


@query("""WITH s AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx, value FROM events),
  e AS (SELECT *, CAST(sample_idx // 10 AS INT) AS epoch FROM s), k AS (SELECT recording_id, epoch FROM e GROUP BY 1, 2 HAVING count(*) = 10)
  SELECT recording_id, epoch, sample_idx, value FROM e SEMI JOIN k USING (recording_id, epoch)""")
def q_epoch(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("recording_id"), (F.row_number().over(by) - 1).cast("bigint").alias("sample_idx"), "value")
    return T.epochs(rows, 10, ["recording_id"])


@query(f"""WITH {EV}, s AS (SELECT *, lag(value) OVER w AS p FROM ev {W}),
  f AS (SELECT recording_id, channel, coalesce(greatest(-0.99, least(0.99, covar_pop(CASE WHEN p IS NOT NULL THEN value END, p) / greatest(var_samp(p), 1e-12))), 0) AS phi, avg(value) FILTER (WHERE p IS NOT NULL) AS my, avg(p) AS mp, avg(value) AS m FROM s GROUP BY 1, 2)
  SELECT recording_id, channel, epoch, round(phi, 6) + 0.0 AS phi, round(CASE WHEN p IS NULL THEN value - m ELSE value - (my - phi * mp) - phi * p END, 6) + 0.0 AS value FROM s JOIN f USING (recording_id, channel)""")
def q_ar1(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(T.ar1(samples(spark, d), RC), "phi", "value")


@query(f"""WITH {EV}, g AS (SELECT recording_id, channel, max(CASE WHEN value <> 0 THEN 1 ELSE 0 END) AS i FROM ev GROUP BY 1, 2),
  a AS (SELECT ev.recording_id, avg(value) AS m, stddev_samp(value) AS s FROM ev JOIN g USING (recording_id, channel) WHERE i = 1 GROUP BY 1),
  b AS (SELECT epoch, avg(value) FILTER (WHERE value > 0) AS m, stddev_pop(value) FILTER (WHERE value > 0) AS s FROM ev GROUP BY 1), c AS (SELECT epoch, avg(value) AS m, stddev_pop(value) AS s FROM ev GROUP BY 1),
  n AS (SELECT epoch, avg(value) FILTER (WHERE value <> 0) AS m, stddev_pop(value) FILTER (WHERE value <> 0) AS s FROM ev GROUP BY 1), u AS (
  SELECT 'global' AS mode, recording_id, channel, ev.epoch, CASE WHEN i = 1 AND a.s > 1e-10 THEN (value - a.m) / a.s ELSE value END AS v FROM ev JOIN g USING (recording_id, channel) JOIN a USING (recording_id)
  UNION ALL SELECT 'active', recording_id, channel, epoch, CASE WHEN value > 0 AND b.s > 1e-10 THEN (value - b.m) / b.s ELSE value END FROM ev JOIN b USING (epoch)
  UNION ALL SELECT 'all', recording_id, channel, epoch, CASE WHEN c.s > 1e-10 THEN (value - c.m) / c.s ELSE value END FROM ev JOIN c USING (epoch)
  UNION ALL SELECT 'nonzero', recording_id, channel, epoch, CASE WHEN value <> 0 AND n.s > 1e-10 THEN (value - n.m) / n.s ELSE value END FROM ev JOIN n USING (epoch))
  SELECT mode, recording_id, channel, epoch, round(v, 6) + 0.0 AS value FROM u""")
def q_zscore_modes(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d)
    found = T.z_score(rows, ["recording_id"], "global", voxel=["channel"]).withColumn("mode", F.lit("global"))
    for mode in ("active", "all", "nonzero"):
        found = found.unionByName(T.z_score(rows, ["epoch"], mode).withColumn("mode", F.lit(mode)))
    return rounded_all(found, "value")


@query(f"""WITH {EV}, x AS (SELECT recording_id, channel, epoch, epoch AS o, value, true AS own FROM ev UNION ALL SELECT recording_id, channel, epoch, -1 - epoch, value, false FROM ev WHERE epoch < 3
    UNION ALL SELECT recording_id, channel, epoch, 2 * (SELECT max(epoch) FROM ev) + 1 - epoch, value, false FROM ev WHERE (SELECT max(epoch) FROM ev) - epoch < 3),
  s AS (SELECT *, avg(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY recording_id, channel ORDER BY o ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS share FROM x)
  SELECT recording_id, channel, epoch, CASE WHEN round(share, 9) >= 0.35 THEN value ELSE 0 END AS value FROM s WHERE own""")
def q_temporal_keep(spark: SparkSession, d: str) -> DataFrame:
    return T.temporal_keep(samples(spark, d), RC, 3, 0.35)


@query(f"""WITH {EV}, s AS (SELECT *, sum(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY recording_id, channel ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 AS share FROM ev)
  SELECT recording_id, channel, epoch, CASE WHEN round(share, 9) >= 0.5 THEN value ELSE 0 END AS value FROM s""")
def q_temporal_zero(spark: SparkSession, d: str) -> DataFrame:
    return T.temporal_keep(samples(spark, d), RC, 4, 0.5, edge="zero")


TAPS = T.canonical_kernel()


@query(f"""WITH {EV}, k(tap, w) AS (VALUES {", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(TAPS))})
  SELECT a.recording_id, a.channel, a.epoch, round(sum(w * b.value), 6) + 0.0 AS value FROM ev a, k, ev b WHERE b.recording_id = a.recording_id AND b.channel = a.channel AND b.epoch = greatest(a.epoch - tap, 0) GROUP BY 1, 2, 3""")
def q_fir(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(T.convolve(samples(spark, d), RC, TAPS), "value")


@query(f"""WITH {EV}, k(tap, w) AS (VALUES (0, 0.5::DOUBLE), (1, 0.3::DOUBLE), (2, 0.2::DOUBLE))
  SELECT a.recording_id, a.channel, a.epoch, round(sum(w * b.value), 6) + 0.0 AS value FROM ev a, k, ev b WHERE b.recording_id = a.recording_id AND b.channel = a.channel AND b.epoch = greatest(a.epoch - tap, 0) GROUP BY 1, 2, 3""")
def q_fir_packed(spark: SparkSession, d: str) -> DataFrame:
    from gridscore.sources.tables import pack, unpack

    packed = pack(samples(spark, d), RC, "epoch").withColumn("values", T.convolve_packed(F.col("values"), [0.5, 0.3, 0.2]))
    return rounded_all(unpack(packed, RC, "epoch"), "value")


@query(f"""WITH {EV}, s AS (SELECT *, abs(value - lag(value) OVER w) AS d FROM ev {W}), m AS (SELECT recording_id, channel, 1 / (1 + coalesce(avg(d), 0)) AS f FROM s GROUP BY 1, 2)
  SELECT recording_id, channel, epoch, round(value * f, 6) + 0.0 AS value FROM ev JOIN m USING (recording_id, channel)""")
def q_smoothness(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(T.smoothness(samples(spark, d), RC), "value")


LAG = f"s AS (SELECT *, lag(value) OVER w AS p FROM ev {W})"


@query(f"WITH {EV}, {LAG} SELECT recording_id, channel, round(CASE WHEN sqrt(var_pop(value)) * sqrt(var_pop(p)) > 1e-15 AND count(*) > 1 THEN covar_pop(value, p) / (sqrt(var_pop(value)) * sqrt(var_pop(p))) END, 6) + 0.0 AS r FROM s WHERE p IS NOT NULL GROUP BY 1, 2")
def q_lag1_corr(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(T.lag1_correlation(samples(spark, d), RC), "r")


@query(f"""WITH {EV}, {LAG}, r AS (SELECT recording_id, channel, covar_pop(value, p) / nullif(sqrt(var_pop(value)) * sqrt(var_pop(p)), 0) AS r FROM s WHERE p IS NOT NULL GROUP BY 1, 2),
  m AS (SELECT channel, avg(r) AS rho, count(*) AS n FROM r GROUP BY 1) SELECT channel, round(rho, 6) + 0.0 AS rho, round(n * 30 / (1 + 29 * rho), 6) + 0.0 AS effective FROM m""")
def q_effective_n(spark: SparkSession, d: str) -> DataFrame:
    found = T.lag1_correlation(samples(spark, d), RC).groupBy("channel").agg(F.avg("r").alias("rho"), F.count("*").alias("n"))
    return rounded_all(found.select("channel", "rho", T.effective_n(F.col("rho"), F.col("n"), F.lit(30)).alias("effective")), "rho", "effective")


@query(f"""WITH {EV}, f AS (SELECT recording_id, channel, coalesce(regr_slope(value, epoch::DOUBLE), 0) AS b, avg(epoch::DOUBLE) AS mx, avg(value) AS my FROM ev GROUP BY 1, 2)
  SELECT recording_id, channel, epoch, round(value - my - b * (epoch - mx), 6) + 0.0 AS value FROM ev JOIN f USING (recording_id, channel)""")
def q_detrend(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(T.detrend(samples(spark, d), RC), "value")


@query(f"""WITH {EV}, g AS (SELECT *, avg(value) OVER (PARTITION BY recording_id, epoch) AS g FROM ev), b AS (SELECT recording_id, channel, coalesce(sum(g * value) / nullif(sum(g * g), 0), 0) AS b FROM g GROUP BY 1, 2)
  SELECT recording_id, channel, epoch, round(value - b * g, 6) + 0.0 AS value FROM g JOIN b USING (recording_id, channel)""")
def q_gsr(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(T.regress_global(samples(spark, d), ["recording_id"], ["channel"]), "value")


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, channel ORDER BY value DESC, epoch) AS r FROM ev) SELECT recording_id, channel, epoch AS peak_epoch FROM r WHERE r = 1")
def q_peak_epoch(spark: SparkSession, d: str) -> DataFrame:
    return T.peak_epoch(samples(spark, d), RC)
