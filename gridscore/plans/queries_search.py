"""Queries of parameter search: lineitem's return flags are searched as bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore.model import TARGETS
from gridscore.operators import search as S
from gridscore.operators.signature import radius_count
from gridscore.plans.queries_metrics import RAW, SCORED
from gridscore.plans.registry import query
from gridscore.plans.stand_ins import SC, VAL, VOX, means, rounded, rounded_all, scores, values, voxels
from gridscore.session import dealt, stored, table

#: Candidates that both sides spell out: mi_weight, contrast, boost, penalty, softening.
CANDIDATES = [(0, 0.3, 0.5, 1.3, 0.0, 0.7), (1, 0.6, 0.8, 1.6, 0.2, 0.6), (2, 0.9, 1.0, 1.1, 0.5, 0.9)]
NAMES = ["mi_weight", "contrast", "boost", "penalty", "softening"]


#: Return flags as bands.
FLAGS = {"A": "alpha", "N": "beta", "R": "delta"}


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Time means of every flag over nations: a supplier's nation is the recording, so that each covers most voxels."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    band = F.element_at(F.create_map(*[F.lit(x) for pair in FLAGS.items() for x in pair]), F.col("l_returnflag"))
    slim = rows.select(band.alias("band"), F.col("s_nationkey").alias("recording_id"), F.col("l_partkey").alias("voxel_id"), (F.col("l_discount") * 10).alias("mi"), (F.col("l_tax") * 12.5).alias("dice"))
    means_ = dealt(slim, table(spark, d, "lineitem").count(), "voxel_id").groupBy("band", "recording_id", "voxel_id").agg(F.avg("mi").alias("mi"), F.avg("dice").alias("dice"))
    return means_.join(voxels(spark, d).select("voxel_id", "x", "y", "z"), "voxel_id")


def _for_all(candidates: DataFrame) -> DataFrame:
    """The candidates for every band."""
    return candidates.withColumn("band", F.explode(F.array(*[F.lit(b) for b in FLAGS.values()])))


def _given_statistics(spark: SparkSession, d: str) -> DataFrame:
    return stored(S.band_statistics(stored(_scores(spark, d), "scores"), _for_all(_candidates(spark))), "statistics")


def _candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CANDIDATES, "cand int, " + ", ".join(f"{n} double" for n in NAMES))


BACK, FRONT, MIDDLE = "y <= -40", "y >= 0", "y BETWEEN -45 AND 15"
BETA = f"{MIDDLE} AND z >= 40 AND abs(x) BETWEEN 10 AND 55"
LOSO = f"""{VOX}, s AS (SELECT CASE l_returnflag WHEN 'A' THEN 'alpha' WHEN 'N' THEN 'beta' ELSE 'delta' END AS band, s_nationkey AS recording_id, l_partkey AS voxel_id, avg(l_discount * 10) AS mi, avg(l_tax * 12.5) AS dice FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
  c(cand, w, c, b, p, o) AS (VALUES {", ".join(f"({a}, {', '.join(f'{v!r}::DOUBLE' for v in rest)})" for a, *rest in CANDIDATES)}),
  sv AS (SELECT s.*, c.*, x, y, z, CASE band WHEN 'alpha' THEN 0.6 WHEN 'beta' THEN 0.3 ELSE 0.25 END::DOUBLE AS least,
    CASE band WHEN 'alpha' THEN exp(-((y + 40) ** 2) / 12800) WHEN 'beta' THEN exp(-((y + 15) ** 2) / 2450) * exp(-((z - 50) ** 2) / 1250) * exp(-((abs(x) - 40) ** 2) / 1250) * (1 - p * exp(-((y + 15) ** 2) / 800))
      ELSE exp(-((y - 40) ** 2) / 3200) * (1 - p * exp(-((y + 15) ** 2) / 1800)) END AS raw FROM s JOIN vox USING (voxel_id), c),
  h AS (SELECT *, (w * mi + (1 - w) * dice) * ((1 - o) * (least + (b - least) * raw / max(raw) OVER (PARTITION BY band, cand)) + o) AS h1 FROM sv),
  k AS (SELECT band, cand, recording_id, x, y, z, CASE WHEN c = 1 THEN h1 ELSE pow(greatest(h1, 1e-12), c) END AS h FROM h),
  f AS (SELECT DISTINCT band, recording_id AS test_id FROM k), t AS (SELECT f.test_id, k.* FROM f JOIN k ON k.band = f.band AND k.recording_id <> f.test_id),
  e AS (SELECT band, cand, test_id, min(h) AS lo, max(h) AS hi FROM t GROUP BY 1, 2, 3), n AS (SELECT t.*, (h - lo) / (hi - lo) AS v FROM t JOIN e USING (band, cand, test_id)),
  r AS (SELECT band, cand, test_id, CASE band WHEN 'alpha' THEN sum(CASE WHEN {BACK} THEN v ELSE 0 END) / (sum(CASE WHEN {FRONT} THEN v ELSE 0 END) + 1e-12) WHEN 'beta' THEN sum(CASE WHEN {BETA} THEN v ELSE 0 END) / (sum(v) + 1e-12)
      ELSE avg(v) FILTER (WHERE {FRONT}) / (avg(v) FILTER (WHERE {BACK}) + 1e-12) END AS raw, 100 * sum(CASE WHEN {MIDDLE} THEN v ELSE 0 END) / (sum(v) + 1e-12) AS share, avg(v) FILTER (WHERE y > 0) / (avg(v) FILTER (WHERE y < -40) + 1e-12) AS front FROM n GROUP BY 1, 2, 3),
  q AS (SELECT *, CASE band WHEN 'alpha' THEN 0.9 WHEN 'beta' THEN 0.22 ELSE 0.85 END::DOUBLE AS aim, CASE band WHEN 'alpha' THEN 0.275 WHEN 'beta' THEN 0.07 ELSE 0.225 END::DOUBLE AS width,
    CASE band WHEN 'alpha' THEN raw BETWEEN 0.4 AND 1.5 WHEN 'beta' THEN raw BETWEEN 0.12 AND 0.4 ELSE raw BETWEEN 0.5 AND 1.4 END AS inside,
    CASE WHEN band = 'beta' AND share > 35 THEN exp(-pow(share - 35, 2) / 800) WHEN band = 'delta' AND front > 1.5 THEN exp(-pow(front - 1.5, 2) / 4.5) WHEN band = 'delta' AND front < 0.8 THEN exp(-pow(0.8 - front, 2) / 0.5) ELSE 1 END AS pen FROM r),
  m AS (SELECT band, cand, test_id, CASE WHEN inside THEN least(1, 1.15 / (1 + pow((raw - aim) / width, 2))) ELSE 1 / (1 + pow((raw - aim) / width, 2)) END * pen AS main FROM q)"""


@query(f"WITH {LOSO} SELECT band, cand, test_id, round(main::DOUBLE, 6) + 0.0 AS main FROM m")
def q_loso_metric(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate's metric with every recording left out, from sums; the SQL scales and sums each fold anew."""
    found = S.left_out(_given_statistics(spark, d))
    return found.select("band", "cand", "test_id", rounded(S._metrics(list(FLAGS.values()))).alias("main"))


@query(f"WITH {LOSO}, b AS (SELECT band, test_id, cand, row_number() OVER (PARTITION BY band, test_id ORDER BY round(main::DOUBLE, 9) DESC, cand) AS r FROM m) SELECT band, test_id, cand FROM b WHERE r = 1")
def q_loso_pick(spark: SparkSession, d: str) -> DataFrame:
    found = S.left_out(_given_statistics(spark, d)).withColumn("main", S._metrics(list(FLAGS.values())))
    return found.groupBy("band", "test_id").agg(F.max_by("cand", F.struct(F.round("main", 9), -F.col("cand"))).alias("cand"))


@query()
def q_loso_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole leave-one-out search of every band: shared candidates, then refinement around each fold's best."""
    return rounded_all(S.optimise_bands(stored(_scores(spark, d), "scores"), list(FLAGS.values())), "objective", *NAMES, "keep_top_pct", "smoothing_fwhm")


@query(f"""WITH {LOSO.split("f AS (SELECT DISTINCT")[0].rstrip().rstrip(",")}, e AS (SELECT *, (h - min(h) OVER w) / (max(h) OVER w - min(h) OVER w) AS v FROM k WHERE cand = recording_id % 3 WINDOW w AS (PARTITION BY band, recording_id))
  SELECT band, recording_id AS test_id, round(sum(CASE WHEN y < -40 THEN v ELSE 0 END) / (sum(CASE WHEN y > 0 THEN v ELSE 0 END) + 1e-12), 6) + 0.0 AS pa_ratio, round(100 * sum(CASE WHEN y < -70 THEN v ELSE 0 END) / (sum(v) + 1e-12), 6) + 0.0 AS occipital_pct FROM e GROUP BY 1, 2""".replace("max(raw) OVER (PARTITION BY band, cand)", "max(raw) OVER (PARTITION BY band, cand, recording_id)"))
def q_fold_tests(spark: SparkSession, d: str) -> DataFrame:
    """Every nation left out, with one of the three candidates as its fold's parameters."""
    rows = stored(_scores(spark, d), "scores")
    folds = rows.select("band", F.col("recording_id").alias("test_id")).distinct().withColumn("cand", (F.col("test_id") % 3).cast("int")).join(_candidates(spark), "cand")
    return rounded_all(S.tested(rows, folds), "pa_ratio", "occipital_pct")


@query()
def q_fit_weights(spark: SparkSession, d: str) -> DataFrame:
    """Both levels in one run: consensus of all folds, outliers among the left-out recordings, and the second level's rounds."""
    from gridscore.plans.pipeline import fit_report

    isolation = stored(radius_count(voxels(spark, d)).join(voxels(spark, d).select("voxel_id", "i", "j", "k"), ["i", "j", "k"]).select("voxel_id", "n_near"), "isolation")
    return rounded_all(fit_report(stored(_scores(spark, d), "scores"), list(FLAGS.values()), stored(_volume(spark, d), "volume"), isolation), "value")


@query("""WITH p AS (SELECT l_returnflag AS band, l_suppkey AS fold, avg(l_discount) AS mi_weight, avg(l_tax) AS contrast FROM lineitem GROUP BY 1, 2), u AS (SELECT band, 'mi_weight' AS param, mi_weight AS v FROM p UNION ALL SELECT band, 'contrast', contrast FROM p),
  a AS (SELECT band, param, avg(v) AS mean, stddev_pop(v) AS std, max(v) - min(v) AS range FROM u GROUP BY 1, 2)
  SELECT band, param, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, round(range, 6) + 0.0 AS range, round(100 * std / (abs(mean) + 1e-12), 6) + 0.0 AS cv, CASE WHEN 100 * std / (abs(mean) + 1e-12) < 30 THEN 'stable' ELSE 'unstable' END AS verdict FROM a""")
def q_param_stability(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(S.parameter_stability(_fold_params(spark, d), ["mi_weight", "contrast"]), "mean", "std", "range", "cv")


def _fold_params(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("band"), F.col("l_suppkey").alias("fold"))
    return rows.agg(F.avg("l_discount").alias("mi_weight"), F.avg("l_tax").alias("contrast"), F.avg("l_quantity").alias("objective"))


@query("""WITH p AS (SELECT l_returnflag AS band, l_suppkey AS fold, avg(l_discount) AS mi_weight, avg(l_tax) AS contrast, avg(l_quantity) AS objective FROM lineitem GROUP BY 1, 2)
  SELECT band, round(median(mi_weight), 6) + 0.0 AS mi_weight, round(median(contrast), 6) + 0.0 AS contrast, round(avg(objective), 6) + 0.0 AS objective_mean, round(stddev_pop(objective), 6) + 0.0 AS objective_std FROM p GROUP BY 1""")
def q_param_median(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(S.consensus(_fold_params(spark, d), ["mi_weight", "contrast"]), "mi_weight", "contrast", "objective_mean", "objective_std")


#: Values of the older grid search by band and fold, from rows h (with `by` columns), and what they come to.
def _grid_sql(by: str) -> str:
    k = f"{by}, " if by else ""
    return f"""p AS (SELECT {k}w, fold, sum(CASE WHEN y < -40 THEN h ELSE 0 END) AS a, sum(CASE WHEN y >= -40 AND y < 0 THEN h ELSE 0 END) AS b, sum(CASE WHEN y >= 0 THEN h ELSE 0 END) AS c, kurtosis_pop(h) AS gamma,
    sum(CASE WHEN y < -40 THEN h ELSE 0 END) / (sum(CASE WHEN y > 0 THEN h ELSE 0 END) + 1e-12) AS alpha, sum(CASE WHEN y BETWEEN -40 AND 0 THEN h ELSE 0 END) / (sum(h) + 1e-12) AS beta, sum(CASE WHEN y BETWEEN -10 AND 60 AND abs(x) <= 40 THEN h ELSE 0 END) / (sum(h) + 1e-12) AS theta FROM h GROUP BY ALL),
  e AS (SELECT * EXCLUDE (a, b, c), -(a / (a + b + c + 1e-12) * ln(a / (a + b + c + 1e-12)) + b / (a + b + c + 1e-12) * ln(b / (a + b + c + 1e-12)) + c / (a + b + c + 1e-12) * ln(c / (a + b + c + 1e-12))) AS delta FROM p),
  u AS (UNPIVOT e ON alpha, beta, theta, delta, gamma INTO NAME band VALUE v), s AS (SELECT {k}band, w, max(v) FILTER (WHERE fold < 0) AS value, 1 - stddev_pop(v) FILTER (WHERE fold >= 0) / (avg(v) FILTER (WHERE fold >= 0) + 1e-12) AS stability FROM u GROUP BY ALL),
  g AS (SELECT {k}band, w, value, stability, stability * CASE band WHEN 'alpha' THEN 1 - least(1, abs(value - 6) / 6) WHEN 'beta' THEN 1 - least(1, abs(value - 0.575) / 0.575) WHEN 'theta' THEN 1 - least(1, abs(value - 0.2) / 0.2) ELSE value END AS metric FROM s),
  pick AS (SELECT {k}band, CASE band WHEN 'alpha' THEN least(w, 0.85) WHEN 'beta' THEN greatest(w, 0.45) WHEN 'theta' THEN least(w, 0.7) ELSE w END AS mi_weight FROM g QUALIFY row_number() OVER (PARTITION BY {k}band ORDER BY round(metric::DOUBLE, 9) DESC, w) = 1)"""


#: Months of a quarter's place are the folds on both sides.
WEIGHTS = ", ".join(f"({w!r}::DOUBLE)" for w in S.GRID)
GRID_SQL = f"""{VOX}, {SC}, a AS (SELECT voxel_id, x, y, epoch, avg(mi) AS mi, avg(dice) AS dice FROM sc JOIN vox USING (voxel_id) GROUP BY 1, 2, 3, 4), b AS (SELECT *, epoch % 3 AS fold FROM a UNION ALL SELECT *, -1 FROM a),
  t AS (SELECT voxel_id, x, y, fold, avg(mi) AS mi, avg(dice) AS dice FROM b GROUP BY 1, 2, 3, 4), h AS (SELECT w, fold, x, y, w * mi + (1 - w) * dice AS h FROM t, (VALUES {WEIGHTS}) v(w)), {_grid_sql("")}"""


def _grid_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    epochs = table(spark, d, "lineitem").select(F.month("l_shipdate").alias("epoch")).distinct()
    return scores(spark, d).join(voxels(spark, d), "voxel_id"), epochs.withColumn("fold", F.col("epoch") % 3)


@query(f"WITH {GRID_SQL} SELECT band, w AS mi_weight, round(value, 6) + 0.0 AS value, round(stability, 6) + 0.0 AS stability, round(metric, 6) + 0.0 AS metric FROM g")
def q_kfold_grid(spark: SparkSession, d: str) -> DataFrame:
    rows, assignment = _grid_rows(spark, d)
    return rounded_all(S.grid_search(rows, list(S.GRID_RULES), assignment=assignment), "value", "stability", "metric")


@query(f"WITH {GRID_SQL} SELECT band, mi_weight FROM pick")
def q_kfold_pick(spark: SparkSession, d: str) -> DataFrame:
    rows, assignment = _grid_rows(spark, d)
    return S.grid_pick(S.grid_search(rows, list(S.GRID_RULES), assignment=assignment))


@query(f"""WITH {VOX}, {SC}, nat AS (SELECT s_nationkey AS r, epoch, voxel_id, avg(mi) AS mi, avg(dice) AS dice FROM sc JOIN supplier ON recording_id = s_suppkey GROUP BY 1, 2, 3), b AS (SELECT *, epoch % 3 AS fold FROM nat UNION ALL SELECT *, -1 FROM nat),
  t AS (SELECT r, voxel_id, x, y, fold, avg(mi) AS mi, avg(dice) AS dice FROM b JOIN vox USING (voxel_id) GROUP BY 1, 2, 3, 4, 5), ids AS (SELECT DISTINCT r AS test_id FROM t), h AS (SELECT test_id, w, fold, x, y, w * mi + (1 - w) * dice AS h FROM ids JOIN t ON r <> test_id, (VALUES {WEIGHTS}) v(w)), {_grid_sql("test_id")},
  o AS (SELECT test_id, mi_weight, voxel_id, y, mi_weight * mi + (1 - mi_weight) * dice AS v FROM (SELECT DISTINCT test_id, mi_weight FROM pick) JOIN nat ON r = test_id JOIN vox USING (voxel_id)),
  z AS (SELECT test_id, mi_weight, voxel_id, y, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS v FROM o WINDOW w AS (PARTITION BY test_id, mi_weight)), m AS (SELECT test_id, mi_weight, voxel_id, y, avg(v) AS v FROM z GROUP BY ALL),
  l AS (SELECT test_id, mi_weight, sum(CASE WHEN y < -40 THEN v ELSE 0 END) / (sum(CASE WHEN y > 0 THEN v ELSE 0 END) + 1e-12) AS pa, 100 * sum(CASE WHEN y < -70 THEN v ELSE 0 END) / (sum(v) + 1e-12) AS oc FROM m GROUP BY ALL)
  SELECT band, test_id, mi_weight, round(pa, 6) + 0.0 AS pa_ratio, round(oc, 6) + 0.0 AS occipital_pct FROM pick JOIN l USING (test_id, mi_weight)""")
def q_grid_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """For every nation left out: the weight that all others' values favour, and what the nation comes to with it."""
    rows, assignment = _grid_rows(spark, d)
    nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("recording_id"), F.col("s_nationkey").alias("_n"))
    pooled = rows.join(nations, "recording_id").groupBy(F.col("_n").alias("recording_id"), "epoch", "voxel_id", "x", "y").agg(F.avg("mi").alias("mi"), F.avg("dice").alias("dice"))
    return rounded_all(S.grid_leave_one_out(pooled, list(S.GRID_RULES), assignment), "pa_ratio", "occipital_pct")


@query(f"""WITH {VOX}, {SC}, nat AS (SELECT s_nationkey AS recording_id, epoch, voxel_id, avg(mi) AS mi, avg(dice) AS dice FROM sc JOIN supplier ON recording_id = s_suppkey GROUP BY 1, 2, 3), b AS (SELECT *, epoch % 3 AS fold FROM nat UNION ALL SELECT *, -1 FROM nat),
  t AS (SELECT recording_id, voxel_id, x, y, fold, avg(mi) AS mi, avg(dice) AS dice FROM b JOIN vox USING (voxel_id) GROUP BY 1, 2, 3, 4, 5), h AS (SELECT recording_id, w, fold, x, y, w * mi + (1 - w) * dice AS h FROM t, (VALUES {WEIGHTS}) v(w)), {_grid_sql("recording_id").replace("y BETWEEN -10 AND 60 AND abs(x) <= 40", "y >= 20 AND abs(x) <= 30")}
  SELECT recording_id, band, mi_weight FROM pick""")
def q_single_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every nation searched alone over the grid of weights, theta in its narrower box."""
    rows, assignment = _grid_rows(spark, d)
    nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("recording_id"), F.col("s_nationkey").alias("_n"))
    pooled = rows.join(nations, "recording_id").groupBy(F.col("_n").alias("recording_id"), "epoch", "voxel_id", "x", "y").agg(F.avg("mi").alias("mi"), F.avg("dice").alias("dice"))
    found = S.grid_search(pooled, list(S.GRID_RULES), assignment=assignment, keys=["recording_id"], theta=S.SINGLE_THETA)
    return S.grid_pick(found, ["recording_id"])


def _volume(spark: SparkSession, d: str) -> DataFrame:
    """Values of nations over months; what lies below the mean is inactive."""
    nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("recording_id"), F.col("s_nationkey").alias("_n"))
    rows = values(spark, d).join(nations, "recording_id")
    band = F.element_at(F.create_map(*[F.lit(x) for pair in FLAGS.items() for x in pair]), F.col("band"))
    found = rows.groupBy(F.col("_n").alias("recording_id"), band.alias("band"), "voxel_id", "i", "j", "k", "x", "y", "z", "epoch").agg(F.avg("value").alias("value"))
    return found.withColumn("value", F.when(F.round("value", 9) >= 0.45, F.col("value")).otherwise(0.0))


GLOBAL = [(0, 1, 4), (1, 3, 9), (2, 7, 20)]


@query(f"""WITH {VAL}, v AS (SELECT s_nationkey AS r, CASE band WHEN 'A' THEN 'alpha' WHEN 'N' THEN 'beta' ELSE 'delta' END AS band, voxel_id, i, j, k, x, y, z, epoch, avg(value) AS value FROM val JOIN supplier ON recording_id = s_suppkey GROUP BY ALL),
  vol AS (SELECT * REPLACE (CASE WHEN round(value, 9) >= 0.45 THEN value ELSE 0 END AS value) FROM v), iso AS (SELECT a.voxel_id, count(*) AS n FROM vox a JOIN vox b ON (a.i - b.i) ** 2 + (a.j - b.j) ** 2 + (a.k - b.k) ** 2 <= 6.25 GROUP BY 1),
  f AS (SELECT *, count(*) OVER s AS n, sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r, band, voxel_id ORDER BY epoch ROWS BETWEEN CURRENT ROW AND CURRENT ROW) / 1 AS s1, sum(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY r, band, voxel_id ORDER BY epoch ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS s3,
    sum(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY r, band, voxel_id ORDER BY epoch ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS s7 FROM vol WINDOW s AS (PARTITION BY r, band, voxel_id)),
  c(cand, win, cells) AS (VALUES {", ".join(str(g) for g in GLOBAL)}),
  k AS (SELECT cand, win, cells, r, band, voxel_id, x, y, z, n, avg(CASE WHEN n > win AND round(CASE win WHEN 1 THEN s1 WHEN 3 THEN s3 ELSE s7 END, 9) < 0.3 THEN 0 ELSE value END) AS v FROM f, c GROUP BY ALL),
  m AS (SELECT cand, r, band, x, y, z, CASE WHEN iso.n < cells AND k.n <= win THEN v * 0.1 ELSE v END AS value FROM k JOIN iso USING (voxel_id)),
  q AS (SELECT cand, r, band, CASE band WHEN 'alpha' THEN {RAW} WHEN 'beta' THEN sum(CASE WHEN {BETA} THEN value ELSE 0 END) / (sum(value) + 1e-12) ELSE avg(value) FILTER (WHERE {FRONT}) / (avg(value) FILTER (WHERE {BACK}) + 1e-12) END AS raw,
    100 * sum(CASE WHEN {MIDDLE} THEN value ELSE 0 END) / (sum(value) + 1e-12) AS share, avg(value) FILTER (WHERE y > 0) / (avg(value) FILTER (WHERE y < -40) + 1e-12) AS front FROM m GROUP BY 1, 2, 3),
  w AS (SELECT cand, band, CASE band WHEN 'alpha' THEN {SCORED.format(lo=0.4, hi=1.5, t=0.9, s=0.275)} WHEN 'beta' THEN {SCORED.format(lo=0.12, hi=0.4, t=0.22, s=0.07)} * CASE WHEN share > 35 THEN exp(-pow(share - 35, 2) / 800) ELSE 1 END
    ELSE {SCORED.format(lo=0.5, hi=1.4, t=0.85, s=0.225)} * coalesce(CASE WHEN front > 1.5 THEN exp(-pow(front - 1.5, 2) / 4.5) WHEN front < 0.8 THEN exp(-pow(0.8 - front, 2) / 0.5) END, 1) END AS metric FROM q)
  SELECT cand, band, round(avg(metric)::DOUBLE * 0.8, 6) + 0.0 AS score FROM w GROUP BY 1, 2""")
def q_global_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of three pairs of temporal window and cluster size, for each band over all nations."""
    isolation = stored(radius_count(voxels(spark, d)).join(voxels(spark, d).select("voxel_id", "i", "j", "k"), ["i", "j", "k"]).select("voxel_id", "n_near"), "isolation")
    given = spark.createDataFrame(GLOBAL, "cand int, temporal_window int, least_cells int")
    targets = {b: TARGETS[b] for b in FLAGS.values()}
    sums = S.windowed_sums(stored(_volume(spark, d), "volume"), sorted({w for _, w, _ in GLOBAL}), isolation, max(n for _, _, n in GLOBAL), targets)
    return rounded_all(S.global_scores(sums, given, targets), "score")


@query()
def q_global_search(spark: SparkSession, d: str) -> DataFrame:
    """The second level's search over all bands and nations: the best pair after each round."""
    isolation = stored(radius_count(voxels(spark, d)).join(voxels(spark, d).select("voxel_id", "i", "j", "k"), ["i", "j", "k"]).select("voxel_id", "n_near"), "isolation")
    return rounded_all(S.optimise_global(stored(_volume(spark, d), "volume"), {b: TARGETS[b] for b in FLAGS.values()}, isolation), "min_cluster_mm3", "score")


@query()
def q_lhs(spark: SparkSession, d: str) -> DataFrame:
    """A Latin hypercube's candidates scored on all folds of every band: objective and its parts."""
    points = S.latin_hypercube(spark, {n: S.BOUNDS[n] for n in NAMES}, 5, 42)
    rows = stored(_scores(spark, d), "scores")
    found = S.evaluate(S.band_statistics(rows, _for_all(points)), S.folds(rows, "recording_id", 3, 42))
    return rounded_all(found, "main", "stability", "objective")


@query(f"""WITH {VAL}, m AS (SELECT recording_id, band, voxel_id, y, avg(value) AS value FROM val GROUP BY 1, 2, 3, 4), t AS (SELECT recording_id, band, sum(CASE WHEN y < -40 THEN value ELSE 0 END) / (sum(CASE WHEN y > 0 THEN value ELSE 0 END) + 1e-12) AS p, 100 * sum(CASE WHEN y < -70 THEN value ELSE 0 END) / (sum(value) + 1e-12) AS o FROM m GROUP BY 1, 2)
  SELECT recording_id, band, concat_ws(', ', CASE WHEN NOT p BETWEEN 0.6 AND 1.4 THEN 'pa_ratio' END, CASE WHEN o < 30 THEN 'occipital_pct' END) AS reasons FROM t WHERE NOT p BETWEEN 0.6 AND 1.4 OR o < 30""")
def q_outliers(spark: SparkSession, d: str) -> DataFrame:
    from gridscore.operators.metrics import posterior_anterior

    tests = posterior_anterior(means(spark, d), ["recording_id", "band"])
    return S.outliers(tests, (0.6, 1.4), 30.0).select("recording_id", "band", "reasons")


@query("""WITH b AS (SELECT l_returnflag AS band, avg(l_discount) AS m, stddev_pop(l_discount) AS s, avg(l_tax) AS c, stddev_pop(l_tax) AS t FROM lineitem GROUP BY 1), k(param, sign) AS (VALUES ('', 0), ('mi_weight', -1), ('mi_weight', 1), ('contrast', -1), ('contrast', 1))
  SELECT band, param, sign, round(m + CASE WHEN param = 'mi_weight' THEN sign * s ELSE 0 END, 6) + 0.0 AS mi_weight, round(c + CASE WHEN param = 'contrast' THEN sign * t ELSE 0 END, 6) + 0.0 AS contrast FROM b, k""")
def q_perturb(spark: SparkSession, d: str) -> DataFrame:
    from gridscore.operators.resample import perturbations

    by = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("band"))
    base = by.agg(F.avg("l_discount").alias("mi_weight"), F.avg("l_tax").alias("contrast"))
    spread = by.agg(F.stddev_pop("l_discount").alias("mi_weight"), F.stddev_pop("l_tax").alias("contrast"))
    found = perturbations(base, spread, ["mi_weight", "contrast"]).select("band", "param", "sign", "mi_weight", "contrast")
    return rounded_all(found, "mi_weight", "contrast")
