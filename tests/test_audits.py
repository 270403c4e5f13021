"""Resampling, null tests and audits against plain computations on small tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridscore.functions.geometry import series_signature
from gridscore.operators import connect, metrics, resample, search, topk, validation


@pytest.fixture(scope="module")
def maps(spark):
    rng = np.random.default_rng(3)
    rows = [("a", int(s), int(v), float(rng.gamma(2.0)), float(v * 3 - 20), float(v * 15 - 90), float(v % 4), v % 3 > 0) for s in range(3) for v in range(12)]
    return spark.createDataFrame(rows, "band string, recording_id int, voxel_id int, value double, x double, y double, z double, is_gm boolean")


def _ratios(frame, voxels):
    grey, v, y = frame[frame.is_gm], frame.value.clip(lower=0), frame.y
    room = voxels[voxels.is_gm]
    back, front = grey.value[grey.y < -40].sum() / ((room.y < -40).sum() + 1e-12), grey.value[grey.y > 0].sum() / ((room.y > 0).sum() + 1e-12)
    return v[y < -40].sum() / (v[y > 0].sum() + 1e-12), back / (front + 1e-12)


def test_shuffled_is_a_permutation_of_each_group(maps):
    moved = resample.shuffled(maps, ["band", "recording_id"], ["x", "y", "z"], "voxel_id", 3, 7).toPandas()
    real = maps.toPandas()
    assert len(moved) == 3 * len(real)
    for (subject, _), part in moved.groupby(["recording_id", "perm"]):
        own = real[real.recording_id == subject].set_index("voxel_id")
        assert sorted(part.y) == sorted(own.y) and (part.set_index("voxel_id").value.sort_index() == own.value.sort_index()).all()
    orders = {p: tuple(part.sort_values(["recording_id", "voxel_id"]).y) for p, part in moved.groupby("perm")}
    assert len(set(orders.values())) == 3


def test_place_test(maps):
    voxels = maps.where("recording_id = 0").select("voxel_id", "y", "is_gm")
    found = validation.place_test(maps, voxels, ["band"], "recording_id", 4, 42).toPandas().set_index("metric")
    moved = resample.shuffled(maps, ["band", "recording_id"], ["x", "y", "z", "is_gm"], "voxel_id", 4, 42).toPandas()
    room = voxels.toPandas()
    real = np.array([_ratios(p, room) for _, p in maps.toPandas().groupby("recording_id")])
    null = np.array([_ratios(p, room) for _, p in moved.groupby(["recording_id", "perm"])])
    for k, name in enumerate(("pa_ratio", "enrichment")):
        a, b, row = real[:, k], null[:, k], found.loc[name]
        u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
        d = (a.mean() - b.mean()) / np.sqrt((a.std() ** 2 + b.std() ** 2) / 2 + 1e-12)
        assert np.allclose([row.real_mean, row.real_std, row.null_mean, row.null_std, row.u, row.d], [a.mean(), a.std(), b.mean(), b.std(), u, d])


def test_map_metrics_and_their_null_table(spark):
    rng = np.random.default_rng(5)
    cube = rng.normal(size=(5, 30, 4)).round(3)
    rows = [(p, v, float(v * 5 - 90), t, float(cube[p, v, t])) for p in range(5) for v in range(30) for t in range(4)]
    volume = spark.createDataFrame(rows, "perm int, voxel_id int, y double, epoch int, value double")
    found = resample.spatial_metrics(volume, ["perm"]).toPandas().set_index("perm")
    y = np.arange(30) * 5 - 90
    for p in range(5):
        size, mass = np.abs(cube[p]).mean(1), cube[p].clip(0).sum(1)
        n = len(size)
        counts = np.bincount(np.minimum((size / (size.max() + 1e-10) * 50).astype(int), 49))
        share = counts[counts > 0] / n
        gini = 2 * (np.arange(1, n + 1) * np.sort(size)).sum() / (n * size.sum()) - (n + 1) / n
        want = [n, size.mean(), size.std(), mass[y < -40].sum() / (mass[y > 0].sum() + 1e-12), -(share * np.log2(share)).sum(), gini]
        assert np.allclose(found.loc[p, ["n_active", "mean", "std", "pa_ratio", "entropy", "gini"]].astype(float), want)
    null = spark.createDataFrame([("b", 1.0, 4.0), ("b", 2.0, 4.0), ("b", 3.0, 4.0), ("b", 6.0, 4.0)], "band string, m double, n double")
    real = spark.createDataFrame([("b", 5.0, 4.0)], "band string, m double, n double")
    out = resample.null_table(real, null, ["band"], ["m", "n"]).toPandas().set_index("metric")
    assert out.p.to_dict() == {"m": 0.5, "n": 1.0} and out.null_mean["m"] == 3.0


def test_phases_do_not_depend_on_partitions_and_differ(spark):
    series = spark.createDataFrame([(k, [float((k * j) % 7) for j in range(n)]) for k, n in enumerate((8, 9, 8, 1, 0), 1)] + [(9, None)], "id int, values array<double>")
    one, two = (resample.phase_randomised(series.repartition(n), ["id"], 3, 1).toPandas().sort_values(["id", "perm"])["values"].tolist() for n in (1, 5))
    assert len(one) == 18 and all((a is None and b is None) or np.allclose(a, b) for a, b in zip(one, two, strict=True))
    assert not np.allclose(one[0], one[1])
    angles = resample._angles(np.arange(-2000, 2000), 5)
    assert angles.min() >= 0 and angles.max() < 2 * np.pi and abs(angles.mean() - np.pi) < 0.05 and len(np.unique(angles)) == angles.size


def test_bootstrap_picks_the_best_mean_of_what_was_drawn(spark):
    rng = np.random.default_rng(2)
    table = pd.DataFrame([("b", s, w, float(rng.normal())) for s in range(6) for w in (0.3, 0.5, 0.7)], columns=["band", "s", "w", "m"])
    found = resample.bootstrap_pick(spark.createDataFrame(table), ["band"], "s", "w", "m", 12, 42).toPandas().set_index("boot").w
    draws = resample.draws(spark, 12, 6, 42).toPandas()
    wide = table.pivot(index="s", columns="w", values="m")
    for boot, part in draws.groupby("boot"):
        assert len(part) == 6 and found[boot] == wide.loc[part.pick].mean().idxmax()


def test_bootstrap_of_every_fold(spark):
    """Draws of each fold, taken from its table of multiplicities, and all else by pandas."""
    rng = np.random.default_rng(6)
    subjects = [11, 3, 7, 5, 2]
    table = pd.DataFrame([(b, s, w, float(rng.normal())) for b in "xy" for s in subjects for w in (0.3, 0.5, 0.7) for _ in range(1 + s % 2)], columns=["band", "s", "w", "m"])
    df = spark.createDataFrame(table).unionByName(spark.createDataFrame([("lone", 1, 0.5, 1.0)], "band string, s long, w double, m double"))
    found = resample.bootstrap_folds(df, ["band"], "s", "w", "m", 25, 9).toPandas().set_index(["band", "test_id"])
    assert len(found) == 10
    times = resample.fold_draws(spark.createDataFrame([("x", 5), ("y", 5)], "band string, _n long"), ["band"], 25, 9).toPandas()
    assert (times.pick != times.fold).all() and (times.groupby(["band", "fold", "boot"]).times.sum() == 4).all()
    order = sorted(subjects)
    for (band, fold), part in times.groupby(["band", "fold"]):
        picks = []
        for _, draw in part.groupby("boot"):
            rows = pd.concat([table[(table.band == band) & (table.s == order[k])] for k, n in zip(draw.pick, draw.times, strict=True) for _ in range(n)])
            picks.append(rows.groupby("w").m.mean().idxmax())
        row = found.loc[(band, order[fold])]
        assert np.allclose(row[["mean", "median", "std", "low", "high"]].astype(float), [np.mean(picks), np.median(picks), np.std(picks), *np.quantile(picks, [0.025, 0.975])])


def test_places_are_permuted_for_every_size():
    for n in [*range(1, 400), 1023, 1024, 1025, 65_537, 99_991]:
        places = np.arange(n)
        for key in (0, -(2**63), 123_456_789):
            got = resample.permuted_places(places, np.full(n, n), np.full(n, key))
            assert np.array_equal(np.sort(got), places)
    mixed = resample.permuted_places(np.tile(np.arange(7), 3), np.full(21, 7), np.repeat([1, 2, 3], 7))
    assert len({tuple(p) for p in mixed.reshape(3, 7)}) == 3
    # places go everywhere alike: chi-squared of where the first of 10 goes over 20,000 keys, 9 degrees of freedom
    first = resample.permuted_places(np.zeros(20_000, dtype=np.int64), np.full(20_000, 10), np.arange(20_000))
    assert ((np.bincount(first, minlength=10) - 2000) ** 2 / 2000).sum() < 28
    # and neighbours don't stay together
    big = resample.permuted_places(np.arange(100_000), np.full(100_000, 100_000), np.full(100_000, 5))
    assert abs(np.corrcoef(big, np.arange(100_000))[0, 1]) < 0.02 and (np.abs(np.diff(big)) < 50).mean() < 0.01


def test_shuffles_do_not_depend_on_partitions(maps):
    one, two = (resample.shuffled(maps.repartition(n), ["band", "recording_id"], ["x", "y"], "voxel_id", 2, 3).toPandas().sort_values(["recording_id", "voxel_id", "perm"]).reset_index(drop=True) for n in (1, 5))
    assert one[["voxel_id", "perm", "x", "y", "z", "value"]].equals(two[["voxel_id", "perm", "x", "y", "z", "value"]])
    assert (one.y == 15.0 * ((one.x + 20) / 3) - 90).all()  # moved columns move together


def test_times_are_permuted_in_their_rows(spark):
    from gridscore.operators.timeops import lag1_array, lag1_correlation

    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=n).round(3).tolist()) for k, n in enumerate((9, 30, 2, 1, 0))] + [(7, [2.0] * 6), (8, None)]
    series = spark.createDataFrame(rows, "id int, values array<double>")
    one, two = (resample.time_permuted(series.repartition(n), ["id"], 40, 1).toPandas().sort_values(["id", "perm"])["values"].tolist() for n in (1, 5))
    assert one == two and len(one) == 40 * len(rows)
    own = {k: v for k, v in rows}
    drawn = resample.time_permuted(series, ["id"], 40, 1).collect()
    assert all((r["values"] is None and own[r.id] is None) or sorted(r["values"]) == sorted(own[r.id]) for r in drawn)
    assert len({tuple(r["values"]) for r in drawn if r.id == 1}) == 40
    first = np.array([r["values"] for r in drawn if r.id == 0])
    assert len({tuple(c) for c in first.T}) == 9  # no place keeps its value
    long = series.select("id", F.posexplode("values").alias("epoch", "value"))
    want = {r.id: r.r for r in lag1_correlation(long, ["id"]).collect()}
    for r in series.select("id", lag1_array(F.col("values")).alias("r")).collect():
        assert r.r == (None if want.get(r.id) is None else pytest.approx(want[r.id]))
    plan = resample.time_permuted(series, ["id"], 3, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_null_table_of_permuted_times(spark):
    rng = np.random.default_rng(7)
    rows = [("b", v, 10.0 * v - 95, (rng.normal(size=8) * (v % 5 > 0)).round(4).tolist()) for v in range(20)]
    series = spark.createDataFrame(rows, "band string, voxel_id int, y double, values array<double>")
    keys = ["band", "voxel_id", "y"]
    found = resample.null_metrics(series, ["band"], keys[1:], resample.time_permuted(series, keys, 6, 2)).toPandas().set_index("metric")
    assert len(found) == 6 and (found.p == 1).all() and np.allclose(found.value, found.null_mean) and np.allclose(found.null_std, 0)
    assert found.value["n_active"] == 16
    turned = resample.null_metrics(series, ["band"], keys[1:], resample.phase_randomised(series, keys, 6, 2)).toPandas().set_index("metric")
    assert turned.null_std["mean"] > 0 and np.allclose(turned.value, found.value)


def test_shrunk_partial_against_numpy(spark):
    x = np.random.default_rng(4).normal(size=(20, 4)) @ np.array([[1, 0.5, 0, 0], [0, 1, 0.3, 0], [0, 0, 1, 0.8], [0, 0, 0, 1]])
    series = spark.createDataFrame([("s", int(e), int(r), float(x[e, r])) for e in range(20) for r in range(4)], "recording_id string, epoch int, roi_id int, value double")
    found = connect.shrunk_partial(series, ["recording_id"]).toPandas().pivot(index="roi_a", columns="roi_b", values="partial").to_numpy()
    c = x - x.mean(0)
    n, p = c.shape
    cov = c.T @ c / n
    mu = np.trace(cov) / p
    gap = ((cov - mu * np.eye(p)) ** 2).sum()
    noise = sum(((np.outer(row, row) - cov) ** 2).sum() for row in c) / n**2
    weight = min(noise, gap) / gap
    inverse = np.linalg.inv((1 - weight) * cov + weight * mu * np.eye(p))
    want = -inverse / np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    np.fill_diagonal(want, 1.0)
    assert np.allclose(found, want)


def test_correlation_takes_rows_without_nulls(spark):
    rows = [(1.0, 2.0), (2.0, None), (3.0, 1.0), (None, 9.0), (4.0, 7.0), (9.0, 3.0)]
    found = metrics.correlation(spark.createDataFrame(rows, "a double, b double"), [], "a", "b").first().r
    frame = pd.DataFrame(rows).dropna()
    assert np.isclose(found, np.corrcoef(frame[0], frame[1])[0, 1])


def test_exact_sample_and_signature(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    a, b = ({tuple(r) for r in topk.exact_sample(df.repartition(n), 5, "id", 1, ["g"]).collect()} for n in (1, 7))
    assert a == b and len(a) == 15 and {g for _, g in a} == {0, 1, 2}
    one = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0, 2.0, 4.0],)], "w array<double>").select(series_signature(F.col("w"), 2).alias("two"), series_signature(F.col("w"), 3).alias("three")).toPandas()
    assert one.two.nunique() == 1 and one.three.nunique() == 2


def test_hypercube_has_one_point_a_stratum(spark):
    bounds = {"a": (0.0, 1.0), "b": (-3.0, 5.0)}
    found = search.latin_hypercube(spark, bounds, 20, 9).toPandas()
    for name, (lo, hi) in bounds.items():
        assert sorted(((found[name] - lo) / (hi - lo) * 20).astype(int)) == list(range(20))
    assert abs(found.a.corr(found.b)) < 0.9
