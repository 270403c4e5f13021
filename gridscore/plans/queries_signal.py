"""Queries of signal kernels: an embedding is read as a series of 64 samples at 64 Hz."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore.operators import signal as S
from gridscore.plans.registry import query
from gridscore.plans.stand_ins import rounded, rounded_all, samples, signatures


def _series(spark: SparkSession, d: str) -> DataFrame:
    return signatures(spark, d).select("voxel_id", F.col("roi_id").alias("recording_id"), F.col("w").alias("values"))


@query("""WITH lng AS (SELECT vec_id AS voxel_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), k AS (SELECT range AS k FROM range(8, 14)),
  s AS (SELECT voxel_id, k, sum(v * cos(2 * pi() * k * pos / 64)) AS c, sum(v * sin(2 * pi() * k * pos / 64)) AS s FROM lng, k GROUP BY 1, 2) SELECT voxel_id, round(sum(c * c + s * s) / 4096, 6) + 0.0 AS power FROM s GROUP BY 1""")
def q_band_power_dft(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(S.dft_power(_series(spark, d), ["voxel_id"], 64.0, 64, 8, 13), "power")


@query()
def q_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Relative band envelopes of every series."""
    found = S.envelopes(_series(spark, d), 64.0, bands={"theta": (4, 8), "alpha": (8, 13), "beta": (13, 30)})
    return found.select("voxel_id", F.explode("power").alias("band", "power")).withColumn("power", rounded("power"))


@query("""WITH lng AS (SELECT vec_id AS voxel_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
  seg AS (SELECT voxel_id, s, pos - 16 * s AS n, v - avg(v) OVER (PARTITION BY voxel_id, s) AS v FROM lng, range(3) u(s) WHERE pos BETWEEN 16 * s AND 16 * s + 31), win AS (SELECT voxel_id, s, n, v * (0.5 - 0.5 * cos(2 * pi() * n / 32)) AS v FROM seg),
  p AS (SELECT voxel_id, s, k, pow(sum(v * cos(2 * pi() * k * n / 32)), 2) + pow(sum(v * sin(2 * pi() * k * n / 32)), 2) AS p FROM win, range(4, 7) u(k) GROUP BY 1, 2, 3)
  SELECT voxel_id, round(sum(CASE k WHEN 5 THEN 2 ELSE 1 END * p) / 3 * 2 / 768, 9) + 0.0 AS power FROM p GROUP BY 1""")
def q_welch(spark: SparkSession, d: str) -> DataFrame:
    return rounded_all(S.welch_power(_series(spark, d), 64.0, 8, 13, 32).select("voxel_id", "power"), "power", digits=9)


@query()
def q_bandpass(spark: SparkSession, d: str) -> DataFrame:
    """Energy of every series before and after a notch and a band-pass, and after halving the rate."""
    energy = F.aggregate("values", F.lit(0.0), lambda s, v: s + v * v)
    rows = _series(spark, d).withColumn("before", energy)
    found = S.resample(S.bandpass(S.notch(rows, 64.0, 20.0), 64.0, 4, 12), 2)
    return rounded_all(found.select("voxel_id", "before", energy.alias("after")), "before", "after")


@query()
def q_ica_score(spark: SparkSession, d: str) -> DataFrame:
    """Artifact scores of components: series as components of their label, event users' mean values as mixing weights."""
    parts = _series(spark, d).select("recording_id", F.col("voxel_id").alias("component"), "values")
    names = F.array(*[F.lit(n) for n in ("O1", "Oz", "Fp1", "C3", "Fz")])
    channel = samples(spark, d).groupBy("channel").agg(F.avg(F.abs("value")).alias("m"))
    from pyspark.sql import Window

    numbered = channel.withColumn("name", F.element_at(names, F.row_number().over(Window.orderBy("channel")))).where("name is not null")
    mixing = parts.crossJoin(F.broadcast(numbered)).select("recording_id", "component", "name", (F.col("m") * F.element_at("values", (F.length("name") * 3 + F.ascii("name") % 20).cast("int"))).alias("weight"))
    found = S.artifact_scores(S.component_features(parts, 64.0), mixing, ["recording_id"])
    return found.select("recording_id", "component", rounded("score").alias("score"), "reasons", "flagged")


#: Entries of an embedding that stand for a component's features, scaled so that every rule has cases; and for its weights.
FEATURES = {"kurtosis": (1, 100), "lf_ratio": (2, 4), "hf_ratio": (3, 2), "flatness": (4, 6), "acf": (5, 5), "alpha_ratio": (6, 4), "beta_ratio": (7, 4), "theta_ratio": (8, 4), "delta_ratio": (9, 5)}
CHANNELS = {"O1": 11, "Oz": 12, "Pz": 13, "Fp1": 14, "AF3": 15, "C3": 16, "CP4": 17, "Fz": 18, "F1": 19, "T7": 20}


def _protected(band: str, group: str, steps: tuple) -> str:
    """Cases of one band, the strongest first."""
    cases = " ".join(f"WHEN {band}_ratio > {least} AND {group} > {over} THEN '{word}'" for word, least, over in steps)
    return f"CASE {cases} END AS p_{band}"


_BANDS = {
    "alpha": ("posterior", (("strong", 0.5, 1.3), ("mod", 0.35, 1.1), ("weak", 0.25, 1.0))), "beta": ("central", (("strong", 0.4, 1.3), ("mod", 0.3, 1.1), ("weak", 0.25, 1.0))),
    "theta": ("midline", (("strong", 0.4, 1.3), ("mod", 0.3, 1.1), ("weak", 0.25, 1.0))),
}


@query(f"""WITH e AS (SELECT label AS recording_id, vec_id AS component, embedding::DOUBLE[] AS e FROM embeddings), f AS (SELECT recording_id, component, {", ".join(f"{'e[1]' if n == 'kurtosis' else f'abs(e[{k}])'} * {by} AS {n}" for n, (k, by) in FEATURES.items())} FROM e),
  mx AS (SELECT recording_id, component, name, abs(e[k]) AS w FROM e, (VALUES {", ".join(f"('{n}', {k})" for n, k in CHANNELS.items())}) n(name, k)),
  sh AS (SELECT recording_id, component, max(w) AS most, median(w) AS middle, avg(w) FILTER (WHERE name IN ('O1', 'Oz', 'Pz')) / (avg(w) + 1e-12) AS posterior, avg(w) FILTER (WHERE name IN ('Fp1', 'AF3')) / (avg(w) + 1e-12) AS frontal,
    avg(w) FILTER (WHERE name IN ('C3', 'CP4')) / (avg(w) + 1e-12) AS central, avg(w) FILTER (WHERE name IN ('Fz', 'F1')) / (avg(w) + 1e-12) AS midline FROM mx GROUP BY 1, 2),
  z AS (SELECT *, (kurtosis - avg(kurtosis) OVER r) / (stddev_pop(kurtosis) OVER r + 1e-12) AS zk FROM f JOIN sh USING (recording_id, component) WINDOW r AS (PARTITION BY recording_id)),
  p AS (SELECT *, zk > 2.5 AND lf_ratio > 0.3 AND frontal > 1.5 AS eye, hf_ratio > 0.15 AND zk > 1.5 AS muscle, most > 5 * middle AS noise, flatness > 0.8 AS line, acf < 0.3 AS spiky, {", ".join(_protected(b, *v) for b, v in _BANDS.items())},
    CASE WHEN delta_ratio > 0.4 AND frontal < 1.3 AND lf_ratio < 0.5 THEN CASE WHEN delta_ratio > 0.6 THEN 'strong' ELSE 'weak' END END AS p_delta FROM z),
  s AS (SELECT recording_id, component, 3.0::DOUBLE * CAST(eye AS INT) + 2.5 * CAST(muscle AS INT) + 2 * CAST(noise AS INT) + 1.5 * CAST(line AS INT) + CAST(spiky AS INT) - CASE p_alpha WHEN 'strong' THEN 6 WHEN 'mod' THEN 4 WHEN 'weak' THEN 2.5 ELSE 0 END
    - CASE p_beta WHEN 'strong' THEN 4 WHEN 'mod' THEN 2.5 WHEN 'weak' THEN 1.5 ELSE 0 END - CASE p_theta WHEN 'strong' THEN 3.5 WHEN 'mod' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END - CASE p_delta WHEN 'strong' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END AS score,
    concat_ws('+', CASE WHEN eye THEN 'EOG' END, CASE WHEN muscle THEN 'EMG' END, CASE WHEN noise THEN 'Channel_noise' END, CASE WHEN line THEN 'Line_noise' END, CASE WHEN spiky THEN 'Spiky' END, 'PROTECT_' || p_alpha || '_alpha', 'PROTECT_' || p_beta || '_beta', 'PROTECT_' || p_theta || '_theta', 'PROTECT_' || p_delta || '_delta') AS reasons FROM p)
  SELECT recording_id, component, round(score, 6) + 0.0 AS score, reasons, score >= 3 AS flagged FROM s""")
def q_artifact_scores(spark: SparkSession, d: str) -> DataFrame:
    """The rules of artifact scores on given features and weights."""
    e = lambda k: F.element_at("values", k)
    rows = _series(spark, d).withColumnRenamed("voxel_id", "component")
    features = rows.select("recording_id", "component", *[((e(k) if n == "kurtosis" else F.abs(e(k))) * by).alias(n) for n, (k, by) in FEATURES.items()])
    weights = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), e(k).alias("weight")) for n, k in CHANNELS.items()])).alias("m")
    found = S.artifact_scores(features, rows.select("recording_id", "component", weights).select("recording_id", "component", "m.*"), ["recording_id"])
    return found.select("recording_id", "component", rounded("score").alias("score"), "reasons", "flagged")


@query("""WITH lng AS (SELECT label AS recording_id, vec_id AS component, generate_subscripts(embedding, 1) - 1 AS sample_idx, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
  m AS (SELECT label AS recording_id, vec_id AS component, c.range AS channel, CAST(embedding[c.range + 1] AS DOUBLE) AS weight FROM embeddings, range(4) c), r AS (SELECT recording_id, component FROM m WHERE channel = 0 AND weight > 0.1)
  SELECT recording_id, channel, sample_idx, round(sum(weight * value), 6) + 0.0 AS value FROM lng JOIN m USING (recording_id, component) ANTI JOIN r USING (recording_id, component) GROUP BY 1, 2, 3""")
def q_remix(spark: SparkSession, d: str) -> DataFrame:
    parts = _series(spark, d).withColumnRenamed("voxel_id", "component")
    sources = parts.select("recording_id", "component", F.posexplode("values").alias("sample_idx", "value"))
    mixing = parts.select("recording_id", "component", F.posexplode(F.slice("values", 1, 4)).alias("channel", "weight"))
    return rounded_all(S.remix(sources, mixing, mixing.where("channel = 0 and weight > 0.1"), ["recording_id"]), "value")
