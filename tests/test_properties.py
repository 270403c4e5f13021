"""Properties that hold for any input, on drawn inputs."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridscore.operators import lattice, metrics, score, timeops
from gridscore.operators.components import connected_components
from gridscore.operators.resample import beta_tail

few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@few
@given(st.integers(0, 2**31))
def test_scores_stay_in_range(spark, seed):
    rng = np.random.default_rng(seed)
    w = spark.createDataFrame([(k, rng.uniform(0, 1, 12).round(2).tolist()) for k in range(20)], "voxel_id int, w array<double>")
    v = spark.createDataFrame([(k, rng.uniform(0, 1, 12).round(2).tolist()) for k in range(5)], "epoch int, v array<double>")
    keys = ["voxel_id", "epoch"]
    for ranked in (False, True):
        assert score.dice_scores(w, v, keys, ranked).where("dice < 0 or dice > 1").count() == 0
    a = score.mutual_information(w, v, keys, ["voxel_id"], ["epoch"]).withColumnRenamed("mi", "a")
    b = score.mutual_information(w, v, keys, ["voxel_id"], ["epoch"], method="arrow").withColumnRenamed("mi", "b")
    assert a.join(b, keys).where("a < 0 or abs(a - b) > 1e-9").count() == 0


@few
@given(st.lists(st.floats(0, 100), min_size=2, max_size=30), st.integers(0, 1000))
def test_gini_ignores_order(spark, values, seed):
    rng = np.random.default_rng(seed)
    one = spark.createDataFrame([("a", float(v)) for v in values], "k string, value double")
    other = spark.createDataFrame([("a", float(v)) for v in rng.permutation(values)], "k string, value double").repartition(3)
    x, y = metrics.gini(one, ["k"]).first().gini, metrics.gini(other, ["k"]).first().gini
    assert x == pytest.approx(y, abs=1e-9) and -1e-9 <= x <= 1


@few
@given(st.floats(-50, 50), st.integers(1, 40))
def test_convolution_of_a_constant_is_that_constant(spark, level, n):
    rows = spark.createDataFrame([("a", k, float(level)) for k in range(n)], "k string, epoch int, value double")
    assert all(r.value == pytest.approx(level, abs=1e-9) for r in timeops.convolve(rows, ["k"], timeops.canonical_kernel()).collect())


def _roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@few
@given(st.integers(0, 2**31))
def test_components_match_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(k, k + 1) for k in range(100, 140)]  # and a long path
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    expected = _roots({n for e in edges for n in e}, edges)
    assert found == {n: expected[n] for e in edges for n in e if e[0] != e[1]}


@few
@given(st.integers(0, 2**31))
def test_lattice_components_match_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    cells = {tuple(map(int, c)) for c in rng.integers(0, 5, (40, 3))}
    rows = spark.createDataFrame([("a", *c) for c in cells], "band string, i int, j int, k int")
    edges = [(a, b) for a in cells for b in cells if sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1]
    expected = _roots(cells, edges)
    sizes = {c: sum(expected[d] == expected[c] for d in cells) for c in cells}
    assert {(r.i, r.j, r.k): r.size for r in lattice.components(rows, ["band"]).collect()} == sizes


@given(st.floats(0.01, 50), st.integers(1, 40), st.integers(1, 40))
def test_tail_is_a_falling_probability(f, d1, d2):
    assert 0 <= beta_tail(f * 1.5, d1, d2) <= beta_tail(f, d1, d2) + 1e-12 <= 1 + 1e-9


def test_temporal_windows_of_both_parities(spark):
    rows = spark.createDataFrame([("a", k, float(k % 2)) for k in range(7)], "k string, epoch int, value double")
    for w in (1, 2, 3, 4):
        shares = [r.share for r in timeops.active_share(rows, ["k"], w).orderBy("epoch").collect()]
        padded = [1.0 * (k % 2) for k in range(7)]
        whole = padded[:w][::-1] + padded + padded[-w:][::-1]
        assert shares == pytest.approx([np.mean(whole[w + k - w // 2 : w + k - w // 2 + w]) for k in range(7)])
        assert timeops.temporal_keep(rows, ["k"], w, chunk=3).where(F.col("value") < 0).count() == 0
