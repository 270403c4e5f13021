"""Steps that must not grow beyond their input: what is exploded is never broadcast, and rows of one cell stay apart."""

from __future__ import annotations

import itertools

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridscore.model import DEFAULTS
from gridscore.operators import metrics, resample, search, signature, timeops, validation
from gridscore.plans import catalogue, pipeline


def optimised(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_draws_are_merged(spark):
    table = pd.DataFrame([("b", s, w, s * w) for s in range(6) for w in (0.3, 0.5)], columns=["band", "s", "w", "m"])
    found = resample.bootstrap_pick(spark.createDataFrame(table), ["band"], "s", "w", "m", 12, 42)
    assert "strategy=merge" in optimised(found) and found.count() == 12


def test_pairs_within_reach_of_points_that_share_places(spark):
    rng = np.random.default_rng(4)
    rows = [(n, float(x * 4), float(y * 5), float(z * 3)) for n, (x, y, z) in enumerate(rng.integers(0, 5, (80, 3)))]
    df = spark.createDataFrame(rows, "voxel_id long, x double, y double, z double")
    found = signature.neighbours_within(df, 6.0)
    want = {(a[0], b[0]) for a, b in itertools.product(rows, rows) if np.linalg.norm(np.subtract(a[1:], b[1:])) <= 6.0}
    assert sorted((r.a, r.b) for r in found.collect()) == sorted(want)
    assert "strategy=merge" in optimised(found)


def test_rows_of_a_cell_are_counted_before_they_are_sent(spark):
    """A cell is sent to each step once however many rows it holds; cells alone give the number of cells."""
    rows = [(i, j, 0) for i in range(3) for j in range(3) for _ in range(1 + i)]
    cells = spark.createDataFrame(rows, "i int, j int, k int")
    found = {(r.i, r.j): r.n_near for r in signature.radius_count(cells, 1.0).collect()}
    assert len(found) == 9 and found[1, 1] == 2 * 3 + 1 + 3 and found[0, 0] == 1 + 1 + 2
    plan = signature.radius_count(cells, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.rindex("count(1)")  # the plan is printed from its end


def test_cells_near_a_cell_are_counted_once(spark, tmp_path):
    """21,000 parts: the last thousand share cells with the first."""
    from gridscore.plans import catalogue

    spark.range(21_000).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").write.parquet(str(tmp_path / "part.parquet"))
    found = catalogue.queries()["q_radius_count"](spark, str(tmp_path)).toPandas()
    assert len(found) == 20_000 and found.n_near.max() == 81


def test_a_mean_on_the_margin_is_within_it(spark):
    w = [0.0475, 0.0475 + 7e-18, 0.04750000000000002, 0.05249999999999998, 0.0525, 0.05]
    rows = spark.createDataFrame([("b", v) for v in w], "band string, w double")
    assert validation.boundary_share(rows, ["band"], "w", 0.045, 0.055, 0.25).first().boundary_pct == pytest.approx(100 * 5 / 6)


def test_volumes_keep_voxels_that_share_a_cell(spark):
    voxels = spark.createDataFrame([(v, v % 4, 0, 0, 10.0 * v, -50.0, 5.0) for v in range(8)], "voxel_id long, i int, j int, k int, x double, y double, z double")
    scores = spark.createDataFrame([("r", "alpha", v, e, 0.1 * v, 0.05 * v + 0.01 * e) for v in range(8) for e in range(2)], "recording_id string, band string, voxel_id long, epoch int, mi double, dice double")
    found = pipeline.build_volume(scores, voxels, "alpha", DEFAULTS["alpha"])
    assert found.columns == ["recording_id", "band", "epoch", "i", "j", "k", "value"] and found.count() == 16


def test_permuted_places_are_merged(spark):
    maps = spark.createDataFrame([("b", v, float(v), float(v)) for v in range(12)], "band string, voxel_id int, value double, x double")
    assert "strategy=merge" in optimised(resample.shuffled(maps, ["band"], ["x"], "voxel_id", 3, 7))


def test_twins_as_arrays_against_twins_as_rows(spark):
    """Phases drawn alike: all six metrics and both p's agree; no twin is a row of what is shuffled."""
    rng = np.random.default_rng(7)
    rows = [(b, v, 10.0 * v - 95, (rng.normal(size=8 - v % 2) * (v % 5 > 0)).round(4).tolist()) for b in "xy" for v in range(20)]
    series = spark.createDataFrame([*rows, ("x", 20, 0.0, None), ("x", 21, 0.0, [])], "band string, voxel_id int, y double, values array<double>")
    keys = ["band", "voxel_id", "y"]
    some = series.where("size(values) > 0")
    want = resample.null_metrics(some, ["band"], keys[1:], resample.phase_randomised(some, keys, 6, 2)).toPandas().set_index(["band", "metric"]).sort_index()
    got = resample.twin_metrics(some, ["band"], keys[1:], resample.phases_turned, 6, 2).toPandas().set_index(["band", "metric"]).sort_index()
    assert np.allclose(got[want.columns].astype(float), want.astype(float), atol=1e-9)
    still = resample.twin_metrics(some, ["band"], keys[1:], resample.times_turned, 6, 2).toPandas()
    assert (still.p == 1).all() and np.allclose(still.value, still.null_mean)


def test_scores_are_dealt_before_they_are_grouped(spark, sf_dir, monkeypatch):
    """Tasks grow with rows, and one exchange serves every aggregate over a voxel: none is begun in a file's split."""
    from gridscore import session
    from gridscore.plans.stand_ins import means

    monkeypatch.setattr(session, "ROWS", 500)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = means(spark, sf_dir)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
        assert rows > 2000 and found.rdd.getNumPartitions() == -(-rows // 500)
        assert plan.count("Exchange hashpartitioning") == 1 and "HashAggregate" not in plan[plan.index("Exchange hashpartitioning") :]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_scores_are_not_dealt_by_their_few_epochs(spark, sf_dir):
    from gridscore.operators import search
    from gridscore.plans.queries_search import _grid_rows

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for scores beyond it
    try:
        plan = search.grid_sums(*(lambda rows, folds: (rows, ["recording_id"], folds))(*_grid_rows(spark, sf_dir)))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [epoch" not in plan and plan.count("BroadcastHashJoin [epoch") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")


def test_places_are_scored_once(spark, monkeypatch):
    """Five voxels at two places (one without y): a signature a place and band, and every voxel has its place's scores."""
    from gridscore.model import BANDS
    from gridscore.operators import score

    channels = spark.createDataFrame([(k, "LMR"[k % 3], -40.0 + 20 * k, 15.0 * k - 30, 5.0 * k) for k in range(6)], "idx long, side string, x double, y double, z double")
    voxels = spark.createDataFrame([(v, *[(-30.0, -50.0, 10.0), (12.0, None, 4.0)][v % 2]) for v in range(5)] + [(5, 12.0, 30.0, 4.0)], "voxel_id long, x double, y double, z double")
    snapshots = spark.createDataFrame([("r", b, 0, [float((7 * k + len(b)) % 5) for k in range(6)]) for b in BANDS], "recording_id string, band string, epoch int, v array<double>")
    real, sent = score.pair_scores, []
    monkeypatch.setattr(score, "pair_scores", lambda df, *args, **kwargs: sent.append(df.count()) or real(df, *args, **kwargs))
    found = pipeline.score_snapshots(snapshots, channels, voxels).toPandas()
    assert sent == [3 * len(BANDS)] and sorted(found.columns) == sorted(["recording_id", "band", "epoch", "voxel_id", "mi", "dice"])
    assert len(found) == 6 * len(BANDS) and found.groupby(["band", found.voxel_id.where(found.voxel_id == 5, found.voxel_id % 2)]).mi.nunique(dropna=False).max() == 1


def test_surfaces_meet_an_epoch_once(spark):
    """Values as summed a row a vertex, epoch and channel; absent and null values count for nothing; nothing is grouped by vertex."""
    places = [(0, -10.0, 20.0, 5.0), (1, 30.0, -40.0, 0.0), (3, 0.0, 0.0, 60.0)]
    channels = spark.createDataFrame([(k, "M", x, y, z) for k, x, y, z in places], "idx long, side string, x double, y double, z double")
    vertices = spark.createDataFrame([(v, 7.0 * v - 20, 30.0 - 11 * v, 4.0 * v) for v in range(6)], "vertex_id long, x double, y double, z double")
    given = [(0, 0, 1.5), (1, 0, 2.0), (3, 0, -1.0), (0, 1, 3.0), (3, 1, None), (1, 2, None), (2, 2, 9.0), (2, 3, 9.0)]
    plan = signature.project_surface(vertices, channels, spark.createDataFrame(given, "idx long, epoch int, value double"))
    found = {(r.vertex_id, r.epoch): r.value for r in plan.collect()}
    for v in range(6):
        p = np.array([7.0 * v - 20, 30.0 - 11 * v, 4.0 * v])
        w = {k: np.exp(-np.sum((p - np.array(at)) ** 2) / 1800) for k, *at in places}
        for e in range(3):
            sums = [w[k] / sum(w.values()) * x for k, t, x in given if t == e and k in w and x is not None]
            assert found.pop((v, e)) == (pytest.approx(sum(sums)) if sums else None)
    assert not found and "groupBy" not in optimised(plan) and "Aggregate [vertex_id" not in optimised(plan)


def test_permuted_sums_are_those_of_the_shuffled_rows(spark, monkeypatch):
    """Several arrays of values and of flags a group; no row a permutation is made."""
    monkeypatch.setattr(resample, "VALUES", 4)
    monkeypatch.setattr(resample, "FLAGS", 8)
    rows = [(b, v, float((v * 7) % 5), float(v % 9 * 20 - 90), v % 3 > 0) for b, n in (("a", 19), ("b", 3)) for v in range(n)]
    df = spark.createDataFrame(rows, "band string, voxel_id int, value double, y double, is_gm boolean").repartition(5)
    zones = [F.col("y") < -40, F.col("is_gm") & (F.col("y") > 0)]
    found = resample.permuted_sums(df, ["band"], zones, "voxel_id", 3, 7)
    moved = resample.shuffled(df, ["band"], ["y", "is_gm"], "voxel_id", 3, 7)
    want = moved.groupBy("band", "perm").agg(*[F.sum(F.when(z, F.col("value")).otherwise(0.0)).alias(f"s{i}") for i, z in enumerate(zones)])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "Generate explode(sequence(0, 2" not in optimised(found)


@pytest.mark.parametrize("name", ["q_postprocess", "q_postprocess_older"])
def test_postprocessed_voxels_that_share_a_cell_are_those_of_the_sql(spark, sf_dir, tmp_path, name):
    """Parts 20,000 keys apart share a cell; clusters meet each of its voxels once for every one that is kept."""
    con = duckdb.connect()
    keys = {"part": "p_partkey + 20000 * r as p_partkey", "lineitem": "l_partkey + 20000 * r as l_partkey, l_discount * (1 + r) as l_discount"}
    for t, moved in keys.items():
        con.execute(f"copy (select t.* replace ({moved}) from range(3) x(r), '{sf_dir}/{t}.parquet' t) to '{tmp_path}/{t}.parquet'")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = con.sql(catalogue.oracle_sql()[name]).df()
    found = catalogue.queries()[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    assert len(want) == len(found) and (name == "q_postprocess" or want.duplicated().any())
    by = list(want.columns)
    assert (want.sort_values(by).to_numpy() == found.sort_values(by).to_numpy()).all()


def test_permutation_metrics_are_those_of_the_shuffled_rows(spark, monkeypatch):
    """All six of the reference, for weights and for places, over several arrays of both; no row a permutation is made."""
    monkeypatch.setattr(resample, "VALUES", 4)
    monkeypatch.setattr(resample, "PLACES", 8)
    rows = [(b, v, float((v * 7) % 5) / 4, float(v % 4 * 30 - 45), float(v % 9 * 20 - 90), float(v % 3)) for b, n in (("a", 21), ("b", 3)) for v in range(n)]
    df = spark.createDataFrame([*rows, ("c", 0, 0.0, 1.0, 2.0, 3.0), ("b", 9, None, 1.0, 2.0, 3.0)], "band string, voxel_id int, value double, x double, y double, z double").repartition(5)
    found = resample.permutation_metrics(df, ["band"], 3, 7)
    assert "Generate explode(sequence(0, 2" not in optimised(found)
    moved = resample.shuffled(df, ["band"], ["x", "y", "z"], "voxel_id", 3, 7)
    own = ["band", "perm"]
    want = resample.weight_metrics(moved.where("value is not null"), own).toPandas().set_index(own).sort_index()
    got = found.toPandas().set_index(own).sort_index()
    assert len(got) == 9 and list(got.columns) == ["entropy", "gini", "variation", "concentration", "dispersion", "pa_ratio"]
    assert np.allclose(got, want[got.columns], atol=1e-9) and got.loc["a"].entropy.nunique() == 1 and got.loc["a"].dispersion.nunique() > 1


def test_keyed_places_are_the_permuted_ones():
    for size in (1, 2, 3, 7, 64, 1000):
        for key in (5, -(1 << 62)):
            places = np.arange(size)
            assert (resample.keyed_places(places, size, key) == resample.permuted_places(places, np.full(size, size), np.full(size, key))).all()


def test_windowed_sums_are_those_of_filtered_rows(spark):
    """Gaps, series shorter than the window, voxels of any isolation, and a volume of several tasks."""
    rng = np.random.default_rng(8)
    rows = [(r, b, v, float(v % 5 * 30 - 60), float(v % 7 * 25 - 90), float(v % 3 * 40), e, float(max(0.0, rng.normal()))) for r in range(2) for b in ("alpha", "delta") for v in range(40) for e in range(rng.integers(1, 8)) if e != 2]
    volume = spark.createDataFrame(rows, "recording_id int, band string, voxel_id int, x double, y double, z double, epoch int, value double").repartition(6)
    isolation = spark.createDataFrame([(v, v % 12) for v in range(30)], "voxel_id int, n_near int")
    asked = [(0, 1, 4), (1, 3, 9), (2, 4, 5)]
    targets = {b: search.TARGETS[b] for b in ("alpha", "delta")}
    sums = search.windowed_sums(volume, [1, 3, 4], isolation, 9, targets)
    found = {(r.cand, r.band): r.score for r in search.global_scores(sums, spark.createDataFrame(asked, "cand int, temporal_window int, least_cells int"), targets).collect()}
    for cand, window, least in asked:
        kept = timeops.temporal_keep(volume.withColumn("_raw", F.col("value")), ["recording_id", "band", "voxel_id"], window, 0.3, "zero")
        value = F.when(F.count("*") > window, F.avg("value")).otherwise(F.avg("_raw"))
        means = kept.groupBy("recording_id", "band", "voxel_id", "x", "y", "z").agg(value.alias("value"), F.count("*").alias("n")).join(isolation, "voxel_id", "left")
        damped = means.withColumn("value", F.when((F.coalesce("n_near", F.lit(1)) < least) & (F.col("n") <= window), 0.1).otherwise(1.0) * F.col("value"))
        for band in targets:
            want = metrics.band_metric(damped.where(F.col("band") == band), ["recording_id"], band).agg(F.avg("metric")).first()[0]
            assert found[cand, band] == pytest.approx(want * 0.8)


def test_equal_voxels_are_searched_once(spark):
    """Copies of voxels weigh in the statistics as often as they occur, and are one row of what the rounds scan."""
    rng = np.random.default_rng(9)
    rows = [(b, r, v, float(v % 3 * 30 - 30), float(v % 4 * 40 - 90), 50.0, float(rng.integers(1, 4)) / 4, float(rng.integers(1, 3)) / 2) for b in ("alpha", "beta") for r in range(3) for v in range(30)]
    scores = spark.createDataFrame(rows, "band string, recording_id int, voxel_id int, x double, y double, z double, mi double, dice double")
    candidates = spark.createDataFrame([(b, 0, 0.3, 0.5, 1.3, 0.4, 0.7) for b in ("alpha", "beta")], "band string, cand int, mi_weight double, contrast double, boost double, penalty double, softening double")
    twice = scores.unionByName(scores.withColumn("voxel_id", F.col("voxel_id") + 100))
    gathered = search.gathered(twice, ["alpha", "beta"])
    assert gathered.count() == search.gathered(scores, ["alpha", "beta"]).count() < scores.count()
    one, two = ({(r.band, r.recording_id): r.asDict() for r in search.band_statistics(df, candidates).collect()} for df in (scores, gathered))
    for key, r in one.items():
        assert two[key]["n_all"] == 60 and (two[key]["lo"], two[key]["hi"]) == pytest.approx((r["lo"], r["hi"]))
        assert [two[key][f"s_{z}"] for z in search.ZONES] == pytest.approx([2 * r[f"s_{z}"] for z in search.ZONES])


def test_moves_are_columns(spark):
    """Maps under moved parameters are columns of one aggregate by voxel; no score meets a row of moves."""
    rows = [(r, v, float(v * 9 - 60), float(v * 20 - 100), 30.0, (v * r % 5 + 1) / 6, (v + r) % 4 / 4) for r in range(3) for v in range(12)]
    scores = spark.createDataFrame(rows, "recording_id int, voxel_id int, x double, y double, z double, mi double, dice double")
    names = ["mi_weight", "penalty"]
    given = [("beta", 0.55, 0.5, 0.65, 1.4, 0.45)]
    params = spark.createDataFrame(given, "band string, mi_weight double, penalty double, contrast double, boost double, softening double")
    spreads = spark.createDataFrame([("beta", 0.05, 0.9)], "band string, mi_weight double, penalty double")
    found = resample.perturbed_maps(scores, "beta", params, spreads, names)
    assert optimised(found).count("Join") == 1
    moved = {(r.param, r.sign): r for r in found.collect()}
    assert sorted(moved) == [(n, s) for n in sorted(names) for s in (-1, 1)] and moved["penalty", 1].moved_to == 1.0
    assert all(0 < r.r <= 1 and r.rmse > 0 for r in moved.values())


def test_summed_phases_are_those_of_the_twins(spark):
    """What becomes of all twins of a series where it is made, against rows of twins; series of two lengths."""
    rng = np.random.default_rng(10)
    rows = [(s, c, [float(x) for x in rng.normal(size=6 + s % 2)]) for s in range(5) for c in "ab"]
    series, keys = spark.createDataFrame(rows, "id int, c string, values array<double>").repartition(3), ["id", "c"]
    found = {(r.id, r.c): r for r in resample.phase_randomised(series, keys, 7, 3, summed=True).collect()}
    twins = resample.phase_randomised(series, keys, 7, 3).toPandas()
    assert len(found) == len(rows)
    for i, c, own in rows:
        made = np.stack(twins[(twins.id == i) & (twins.c == c)]["values"].tolist())
        size, real, r = np.abs(made).mean(1), np.abs(own).mean(), found[i, c]
        p = (np.abs(size - size.mean()) >= abs(real - size.mean()) - 1e-12).mean()
        assert np.allclose([r.power, r["size"], r.null_power, r.null_mean, r.null_std, r.p], [np.square(own).mean(), real, np.square(made).mean(), size.mean(), size.std(), p])
