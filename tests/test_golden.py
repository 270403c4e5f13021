"""Hand-computed cases of single operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscore.functions import geometry
from gridscore.model import TARGETS
from gridscore.operators import connect, lattice, metrics, resample, score, search, signal, signature, timeops, topk

W = [0.05, 0.11, 0.11, 0.21, 0.25, 0.05, 0.16, 0.11]
S = [0.3, 0.2, 0.5, 0.42, 0.6, 0.1, 0.2, 0.7]


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(1, W)], "voxel_id int, w array<double>"), spark.createDataFrame([(7, S)], "epoch int, v array<double>")


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, k, float(v)) for k, v in enumerate(values)], "recording_id string, epoch int, value double")


def column(df, order, name="value"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_ranks_and_dice(spark, pair):
    w, v = pair
    ranks = score.long_form(w, ["voxel_id"], "w", value="a").select("pos", score.average_rank(["voxel_id"], "a").alias("r"))
    assert column(ranks, "pos", "r") == [1.5, 4.0, 4.0, 7.0, 8.0, 1.5, 6.0, 4.0]
    assert score.dice_scores(w, v, ["voxel_id"]).first().dice == pytest.approx(0.545064114, abs=1e-8)
    assert score.dice_scores(w, v, ["voxel_id"], ranked=True).first().dice == pytest.approx(0.886419753, abs=1e-8)


def test_bins_and_information(spark, pair):
    w, v = pair
    assert w.select(score.bin_array(F.col("w"), 4)).first()[0] == [0, 1, 1, 3, 3, 0, 2, 1]
    assert v.select(score.bin_array(F.col("v"), 4)).first()[0] == [1, 0, 2, 2, 3, 0, 0, 3]
    for method in ("bits", "arrow"):
        assert score.mutual_information(w, v, ["voxel_id", "epoch"], ["voxel_id"], ["epoch"], method=method).first().mi == pytest.approx(0.099228092, abs=1e-8)
    flat = spark.createDataFrame([(1, [2.0] * 4)], "voxel_id int, w array<double>")
    assert flat.select(score.bin_array(F.col("w"), 4)).first()[0] == [2, 2, 2, 2]
    assert score.mutual_information(flat, spark.createDataFrame([(7, S[:4])], "epoch int, v array<double>"), ["voxel_id", "epoch"], ["voxel_id"], ["epoch"]).first().mi >= 0


def test_min_max_of_flat_group_is_zero(spark):
    assert {r.value for r in score.min_max(series(spark, [3, 3, 3]), ["recording_id"], ["value"]).collect()} == {0.0}


def test_ar1(spark):
    found = timeops.ar1(series(spark, [1, 2, 4, 3, 5, 6]), ["recording_id"])
    assert found.first().phi == pytest.approx(0.56)
    assert column(found, "epoch") == pytest.approx([-2.5, -0.88, 0.56, -1.56, 1.0, 0.88])
    assert column(timeops.ar1(series(spark, [4]), ["recording_id"]), "epoch") == [0.0]


def test_active_share_reflects(spark):
    found = timeops.active_share(series(spark, [1, 0, 0, 1, 1, 0, 0, 0, 1]), ["recording_id"], 3)
    assert column(found, "epoch", "share") == pytest.approx([2 / 3, 1 / 3, 1 / 3, 2 / 3, 2 / 3, 1 / 3, 0, 1 / 3, 2 / 3])


def test_convolution(spark):
    rows = series(spark, [2, 4, 6, 8])
    assert column(timeops.convolve(rows, ["recording_id"], [0.5, 0.3, 0.2]), "epoch") == pytest.approx([2, 3, 4.6, 6.6])
    packed = spark.createDataFrame([([2.0, 4.0, 6.0, 8.0],)], "values array<double>")
    assert packed.select(timeops.convolve_packed(F.col("values"), [0.5, 0.3, 0.2])).first()[0] == pytest.approx([2, 3, 4.6, 6.6])


def test_canonical_kernel():
    k = timeops.canonical_kernel()
    assert len(k) == 16 and sum(k) == pytest.approx(1) and k[1] == pytest.approx(0.086553, abs=1e-6) and int(np.argmax(k)) == 3 and int(np.argmin(k)) == 8


def test_target_score(spark):
    rows = spark.createDataFrame([(1.2,), (2.0,)], "raw double")
    assert [r[0] for r in rows.select(metrics.target_score(TARGETS["alpha"], F.col("raw"))).collect()] == pytest.approx([0.525094340, 0.058823529], abs=1e-8)


def test_prior(spark):
    rows = spark.createDataFrame([(y, 0.0, float(y), 0.0) for y in (-80, -40, 0, 40)], "voxel_id int, x double, y double, z double")
    found = geometry.prior_weights(rows, "alpha", 1.3, 0.0, 0.7)
    assert column(found, "voxel_id", "weight") == pytest.approx([1.065324, 1.09, 1.065324, 1.007371], abs=1e-6)


def test_gini_and_icc(spark):
    assert metrics.gini(series(spark, [1, 1, 2, 4, 8]), ["recording_id"]).first().gini == pytest.approx(0.425)
    table = [[9, 2, 5, 8], [6, 1, 3, 2], [8, 4, 6, 8], [7, 1, 2, 6], [10, 5, 6, 9], [6, 2, 4, 7]]
    rows = spark.createDataFrame([("a", s, r, float(v)) for s, row in enumerate(table) for r, v in enumerate(row)], "g string, s int, r int, value double")
    assert resample.icc_2k(rows, ["g"], "s", "r").first().icc == pytest.approx(0.620050548, abs=1e-8)


def test_gaussian_taps():
    taps = [w for _, w in lattice.gaussian_taps(3 / 2.355 / 2)]
    assert taps == pytest.approx([1e-5, 0.004524, 0.182505, 0.625923, 0.182505, 0.004524, 1e-5], abs=6e-6)


def test_radius_count_of_full_lattice(spark):
    found = signature.radius_count(geometry.lattice(spark, 7, 7, 7)).where("i = 3 and j = 3 and k = 3").first()
    assert found.n_near == 81


def test_top_k_keeps_ties(spark):
    rows = series(spark, [5, 3, 3, 1])
    assert column(topk.keep_top(rows, ["recording_id"], 2), "epoch") == [5, 3, 3, 0]
    assert column(topk.keep_top(rows, ["recording_id"], 9), "epoch") == [5, 3, 3, 1]


def test_components(spark):
    cells = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (1, 1, 0), (3, 0, 0), (2, 2, 1)], "i int, j int, k int").withColumn("band", F.lit("a"))
    found = lattice.components(cells, ["band"])
    assert sorted(r.size for r in found.select("component", "size").distinct().collect()) == [1, 1, 3]


def test_drop_small_brings_back_the_largest(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, 2.0), (5, 5, 5, 9.0), (9, 9, 9, 8.0)], "i int, j int, k int, value double").withColumn("band", F.lit("a"))
    assert sorted(r.value for r in lattice.drop_small(cells, ["band"], 2, 0.0, 0).collect()) == [1.0, 2.0]
    assert sorted(r.value for r in lattice.drop_small(cells, ["band"], 2, 0.75, 0).collect()) == [1.0, 2.0, 8.0, 9.0]


def test_scatter_last_voxel_wins(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, 1.0), (2, 0, 0, 0, 5.0), (3, None, 0, 0, 7.0)], "voxel_id int, i int, j int, k int, value double").withColumn("epoch", F.lit(0))
    assert [r.value for r in lattice.scatter(rows, ["epoch"]).collect()] == [5.0]


def test_zero_phase_filter_keeps_its_band():
    t = np.arange(500) / 250
    x = np.stack([np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 40 * t)])
    y = signal.zero_phase(*signal.butter_band(8, 13, 250), x)
    assert np.abs(y[0, 100:400] - x[0, 100:400]).max() < 0.05 and np.abs(y[1, 200:300]).max() < 0.01


def test_envelope_ranks_the_right_band(spark):
    t = np.arange(500) / 250
    rows = spark.createDataFrame([(1, (np.sin(2 * np.pi * 10 * t)).tolist())], "id int, values array<double>")
    power = signal.envelopes(rows, 250.0).first().power
    assert max(power, key=power.get) == "alpha"


def test_transform_power_matches_numpy(spark):
    x = np.random.default_rng(0).normal(size=64)
    rows = spark.createDataFrame([(1, x.tolist())], "id int, values array<double>")
    expected = (np.abs(np.fft.rfft(x)[8:14]) ** 2).sum() / 64**2
    assert signal.dft_power(rows, ["id"], 64.0, 64, 8, 13).first().power == pytest.approx(expected)


def test_unmixing_finds_sources(spark):
    rng = np.random.default_rng(1)
    s = np.stack([np.sign(np.sin(np.arange(2000) / 17)), rng.uniform(-1, 1, 2000)])
    x = (np.array([[1.0, 0.5], [0.3, 1.0]]) @ s).T
    mean, _, unmixing = signal.unmix(spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>"), 2)
    found = (x - mean) @ unmixing.T
    assert (np.abs(np.corrcoef(found.T, s)[:2, 2:]).max(1) > 0.98).all()


def test_phase_randomised_series_keep_their_power(spark):
    rows = spark.createDataFrame([(1, [1.0, 3.0, -2.0, 5.0, 0.5, 1.5])], "id int, values array<double>")
    for r in resample.phase_randomised(rows, ["id"], 3, 42).collect():
        assert np.abs(np.fft.rfft(r.values)) == pytest.approx(np.abs(np.fft.rfft([1.0, 3.0, -2.0, 5.0, 0.5, 1.5])))


def test_leave_one_out_identity(spark):
    """Sums per recording give what scaling and summing every fold anew gives."""
    rng = np.random.default_rng(3)
    voxels, recordings = 60, 5
    xyz = rng.uniform(-100, 80, (voxels, 3))
    mi, dice = rng.uniform(0, 1, (2, voxels, recordings))
    rows = spark.createDataFrame([(f"r{r}", v, *map(float, xyz[v]), float(mi[v, r]), float(dice[v, r])) for v in range(voxels) for r in range(recordings)], "recording_id string, voxel_id int, x double, y double, z double, mi double, dice double")
    cands = spark.createDataFrame([(0, 0.4, 0.7, 1.3, 0.0, 0.6)], "cand int, mi_weight double, contrast double, boost double, penalty double, softening double")
    found = {r.test_id: r.m for r in search.left_out(search.statistics(rows, cands, "alpha")).withColumn("m", search._metric("alpha")).collect()}
    y = xyz[:, 1]
    raw = np.exp(-((y + 40) ** 2) / 12800)
    weight = 0.4 * (0.6 + 0.7 * raw / raw.max()) + 0.6
    h = np.maximum((0.4 * mi + 0.6 * dice) * weight[:, None], 1e-12) ** 0.7
    for r in range(recordings):
        own = np.delete(h, r, 1)
        mean = ((own - own.min()) / (own.max() - own.min())).mean(1)
        ratio = mean[y <= -40].sum() / (mean[y >= 0].sum() + 1e-12)
        s = 1 / (1 + ((ratio - 0.9) / 0.275) ** 2)
        assert found[f"r{r}"] == pytest.approx(min(1.0, s * 1.15) if 0.4 <= ratio <= 1.5 else s, abs=1e-9)


def test_draws_are_the_same_on_every_partitioning(spark):
    rows = spark.range(200).select(F.col("id").alias("voxel_id"), (F.col("id") % 7).cast("double").alias("x"), F.lit("a").alias("band"))
    shuffle = lambda df: sorted(map(tuple, resample.shuffled(df, ["band"], ["x"], "voxel_id", 2, 42).select("perm", "voxel_id", "x").collect()))
    assert shuffle(rows) == shuffle(rows.repartition(7))


def test_tails():
    assert resample.beta_tail(4.0, 1, 10) == pytest.approx(0.0734, abs=2e-4)
    assert resample.beta_tail(0.0, 1, 10) == 1.0


def test_normal_tail(spark):
    p = spark.createDataFrame([(1.959964,)], "z double").select(resample.normal_p(F.col("z"))).first()[0]
    assert p == pytest.approx(0.05, abs=1e-5) and math.isfinite(p)


def test_constant_series_have_no_correlation(spark):
    rows = series(spark, [1, 1, 1]).withColumn("roi_id", F.lit(1)).unionByName(series(spark, [1, 2, 3]).withColumn("roi_id", F.lit(2)))
    assert connect.correlations(rows, ["recording_id"]).first().r is None


def test_empty_tables_give_no_rows(spark):
    none = series(spark, [1]).limit(0)
    for found in (timeops.ar1(none, ["recording_id"]), timeops.temporal_keep(none, ["recording_id"]), timeops.detrend(none, ["recording_id"]), topk.keep_top(none, ["recording_id"], 2), metrics.gini(none, ["recording_id"]), metrics.entropy(none, ["recording_id"])):
        assert found.count() == 0
