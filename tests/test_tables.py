"""Sources, sinks, streaming and compositions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscore.model import DEFAULTS, TARGETS, Params, PostParams
from gridscore.plans import pipeline
from gridscore.sources import tables
from gridscore.streaming.epochs import stream_epochs


def test_coordinates(spark, tmp_path):
    (tmp_path / "c.txt").write_text("Fz 1.0 2 3\nbad line\n\nCz  0 -5 4.5\nPz a b c\n")
    found = tables.read_coordinates(spark, str(tmp_path / "c.txt")).orderBy("name").collect()
    assert [(r.name, r.x, r.y, r.z) for r in found] == [("Cz", 0.0, -5.0, 24.5), ("Fz", 1.0, 2.0, 23.0)]


def test_channel_overrides(spark):
    channels = spark.createDataFrame([("Fz", 10.0, 10.0, 10.0), ("Cz", 10.0, 10.0, 10.0)], "name string, x double, y double, z double")
    over = spark.createDataFrame([("Cz", 1.0, 2.0, 3.0)], "name string, x double, y double, z double")
    found = {r.name: (r.x, r.y, r.z) for r in tables.channel_table(channels, over).collect()}
    assert found["Cz"] == (1.0, 2.0, 3.0) and np.allclose(found["Fz"], (8.8, 4.856, 56.8))


def test_scores_round_trip_and_first_folder_wins(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "alpha", 1, 0, 0.5, 0.25), ("r2", "alpha", 1, 0, 0.1, 0.2)], "recording_id string, band string, voxel_id long, epoch int, mi double, dice double")
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    tables.write_scores(rows.where("recording_id = 'r1'"), a)
    tables.write_scores(rows.withColumn("mi", F.lit(9.0)), b)
    tables.write_scores(rows.where("recording_id = 'r1'").withColumn("mi", F.lit(7.0)), a)
    found = {r.recording_id: r.mi for r in tables.read_scores(spark, [a, b]).collect()}
    assert found == {"r1": 7.0, "r2": 9.0}


def test_metrics_and_parameters(spark, tmp_path):
    wide = spark.createDataFrame([("r1", "alpha", 60.0, 30.0)], "recording_id string, band string, posterior_pct double, anterior_pct double")
    tables.write_metrics(tables.long_metrics(wide, ["recording_id", "band"], ["posterior_pct", "anterior_pct"]), f"{tmp_path}/m")
    assert tables.read_metrics(spark, f"{tmp_path}/m").first().pa_ratio == 2.0
    defaults = spark.createDataFrame([(b, *vars(p).values()) for b, p in DEFAULTS.items()], "band string, " + ", ".join(f"{n} double" for n in vars(Params())))
    old = spark.createDataFrame([("alpha", "0.7"), ("beta", '{"contrast": 0.9}')], "band string, body string")
    found = {r.band: r for r in tables.convert_legacy(old, defaults).collect()}
    assert found["alpha"].mi_weight == 0.7 and found["beta"].contrast == 0.9 and found["beta"].mi_weight == 0.55 and len(found) == 5
    tables.write_params(defaults.where("band = 'alpha'").withColumn("boost", F.lit(1.1)), f"{tmp_path}/p")
    assert {r.band: r.boost for r in tables.read_params(spark, f"{tmp_path}/p", defaults).collect()}["alpha"] == 1.1


def test_stream_epochs(spark, tmp_path):
    rows = spark.sql("select timestamp_seconds(id) as ts, 'r' as recording_id, 'c' as channel_id, double(id) as value from range(10)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = stream_epochs(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("append").format("memory").queryName("epochs").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination(60)
    assert all(r.n <= 2 for r in spark.table("epochs").collect())


def _world(spark):
    rng = np.random.default_rng(5)
    channels = spark.createDataFrame([(k, s, float(x), float(y), 60.0) for k, (s, x, y) in enumerate([("L", -40, 30), ("R", 40, 30), ("M", 0, 0), ("L", -40, -60), ("R", 40, -60), ("M", 0, -90)])], "idx int, side string, x double, y double, z double")
    voxels = spark.createDataFrame([(i * 16 + j * 4 + k, i, j, k, -30.0 + 20 * i, -90.0 + 40 * j, 20.0 * k, 1 + (i + j) % 3, True) for i in range(4) for j in range(4) for k in range(4)], "voxel_id long, i int, j int, k int, x double, y double, z double, roi_id int, is_gm boolean")
    series = spark.createDataFrame([(f"r{r}", c, rng.normal(size=500).tolist()) for r in range(3) for c in range(6)], "recording_id string, channel int, values array<double>")
    return channels, voxels, series


def test_compositions(spark):
    channels, voxels, series = _world(spark)
    scores = pipeline.stored(pipeline.score_recordings(series, channels, voxels, 125.0, 125), "scores")
    assert scores.count() == 3 * 5 * 64 * 4
    ends = scores.groupBy("recording_id", "band", "epoch").agg(F.min("mi").alias("lo"), F.max("mi").alias("hi")).agg(F.min("lo"), F.max("hi")).first()
    assert ends[0] == 0.0 and ends[1] == 1.0
    volume = pipeline.build_volume(scores, voxels, "alpha", DEFAULTS["alpha"])
    located = volume.join(voxels.select("voxel_id", "i", "j", "k"), ["i", "j", "k"])
    out = pipeline.postprocess(located, PostParams(keep=40, floor_abs=5, min_cluster_mm3=10.0))
    assert out.count() == located.count()
    report = pipeline.validate(scores.where("band = 'alpha'").withColumnRenamed("mi", "value"), voxels.select("voxel_id", "x", "y", "z"), ["recording_id"])
    assert {r.metric for r in report.collect()} >= {"entropy", "gini", "dispersion", "concentration", "pa_ratio"}


def test_fit_weights(spark):
    _, voxels, _ = _world(spark)
    rng = np.random.default_rng(6)
    rows = [(f"r{r}", "alpha", v, float(a), float(b)) for r in range(4) for v, (a, b) in enumerate(rng.uniform(0, 1, (64, 2)))]
    scores = spark.createDataFrame(rows, "recording_id string, band string, voxel_id long, mi double, dice double").join(voxels.select("voxel_id", "x", "y", "z"), "voxel_id")
    folds, consensus = pipeline.fit_weights(scores, ["alpha"], n=4, rounds=2)
    assert folds.count() == 4 and 0.35 <= consensus.first().mi_weight <= 0.92


def test_both_levels_in_one_run(spark, monkeypatch):
    """The report holds what its parts give on their own."""
    from gridscore.operators import search

    monkeypatch.setattr(search, "GLOBAL_BOUNDS", {**search.GLOBAL_BOUNDS, "temporal_window": (3, 4)})  # two windows are enough here
    _, voxels, _ = _world(spark)
    rng = np.random.default_rng(11)
    rows = [(f"r{r}", b, v, float(x), float(y)) for b in ("alpha", "delta") for r in range(4) for v, (x, y) in enumerate(rng.uniform(0, 1, (64, 2)))]
    scores = pipeline.stored(spark.createDataFrame(rows, "recording_id string, band string, voxel_id long, mi double, dice double").join(voxels.select("voxel_id", "x", "y", "z"), "voxel_id"), "scores")
    volume = pipeline.stored(scores.selectExpr("recording_id", "band", "voxel_id", "x", "y", "z", "explode(sequence(0, 5)) AS epoch", "mi").withColumn("value", F.when(F.pmod(F.xxhash64("voxel_id", "epoch"), F.lit(3)) > 0, F.col("mi")).otherwise(0.0)).drop("mi"), "volume")
    isolation = voxels.select("voxel_id", F.lit(6).alias("n_near"))
    found = {(r.level, r.band, r.name): r.value for r in pipeline.fit_report(scores, ["alpha", "delta"], volume, isolation, n=4, rounds=1).collect()}
    folds = pipeline.stored(search.optimise_bands(scores, ["alpha", "delta"], n=4, rounds=1), "folds")
    for r in search.consensus(folds, ["mi_weight", "boost"]).collect():
        assert found[1, r.band, "mi_weight"] == pytest.approx(r.mi_weight) and found[1, r.band, "boost"] == pytest.approx(r.boost) and found[1, r.band, "folds"] == 4
    tests = search.tested(scores, folds)
    odd = {r.band: r["count"] for r in search.outliers(tests).groupBy("band").count().collect()}
    assert all(found[1, b, "outliers"] == odd.get(b, 0) for b in ("alpha", "delta"))
    rounds = {r.round: r.score for r in search.optimise_global(volume, {b: TARGETS[b] for b in ("alpha", "delta")}, isolation).collect()}
    assert all(found[2, "all", f"score_round_{k}"] == pytest.approx(v) for k, v in rounds.items())


def test_audits_are_those_of_their_operators(spark):
    from gridscore.operators import metrics, resample, search, validation

    _, voxels, _ = _world(spark)
    rng = np.random.default_rng(12)
    rows = [(f"r{r}", b, v, float(x), float(y), float(x + y)) for b in ("alpha", "beta") for r in range(3) for v, (x, y) in enumerate(rng.uniform(0.1, 1, (64, 2)))]
    means = pipeline.stored(spark.createDataFrame(rows, "recording_id string, band string, voxel_id long, mi double, dice double, value double").join(voxels.select("voxel_id", "x", "y", "z", "is_gm"), "voxel_id"), "means")
    folds = means.select("band", F.col("recording_id").alias("test_id")).distinct().select("*", *[F.pmod(F.xxhash64("test_id", F.lit(n)), F.lit(100)).cast("double").alias(n) for n in ("mi_weight", "contrast", "boost", "penalty", "softening")])
    found = {(r.module, r.band, r.metric): r.value for r in pipeline.audits(means, voxels.select("voxel_id", "x", "y", "z", "is_gm"), folds, 3, 1).collect()}
    assert {m for m, _, _ in found} == {"spatial", "robust", "target", "circularity", "parameters", "reliability", "variances", "places"}
    for r in search.parameter_stability(folds, ["boost", "penalty"]).collect():
        assert found["parameters", r.band, f"{r.param}_cv"] == pytest.approx(r.cv, abs=1e-6)
    for r in resample.icc_2k(means, ["band"], "voxel_id", "recording_id").collect():
        assert found["reliability", r.band, "icc"] == pytest.approx(r.icc, abs=1e-6)
    for r in metrics.gini(means.groupBy("band", "voxel_id").agg(F.avg("value").alias("value")), ["band"]).collect():
        assert found["spatial", r.band, "gini"] == pytest.approx(r.gini, abs=1e-6)
    for r in validation.place_test(means, voxels, ["band"], "recording_id", 3, 1).collect():
        assert found["places", r.band, f"{r.metric}_d"] == pytest.approx(r.d, abs=1e-6)
    for b in ("alpha", "beta"):
        own = means.where(F.col("band") == b)
        assert found["circularity", b, "mi_enrichment"] == pytest.approx(validation.enrichment(own, ["band"], TARGETS[b].region, ["mi"]).first().mi_enrichment, abs=1e-6)
        raw = metrics.band_metric(own, ["recording_id"], b).toPandas().raw
        assert found["target", b, "mean"] == pytest.approx(raw.mean(), abs=1e-6)


def test_recordings_and_coverage_from_files(spark, tmp_path):
    samples = spark.createDataFrame([("r", c, k, float(k * c)) for c in (1, 2) for k in range(5)], "recording_id string, channel_id int, sample_idx long, value double").withColumn("channel_id", F.col("channel_id").cast("string"))
    samples.write.parquet(str(tmp_path / "samples"))
    read = tables.read_samples(spark, str(tmp_path / "samples"))
    assert sorted(map(tuple, read.select("recording_id", "channel_id", "sample_idx", "value").collect())) == sorted(map(tuple, samples.collect()))
    packed = tables.pack(read, ["recording_id", "channel_id"])
    assert {r.channel_id: list(r["values"]) for r in packed.collect()} == {"1": [0.0, 1.0, 2.0, 3.0, 4.0], "2": [0.0, 2.0, 4.0, 6.0, 8.0]}
    coverage = spark.createDataFrame([(2, 50, 10), (1, 40, 0)], "roi_id int, total int, active int")
    tables.coverage_report(coverage, spark.createDataFrame([(1, "front"), (2, "back")], "roi_id int, name string"), str(tmp_path / "report"))
    back = spark.read.option("header", True).csv(str(tmp_path / "report")).collect()
    assert {(r.roi_id, r.active, r.name) for r in back} == {("1", "0", "front"), ("2", "10", "back")}
