"""Stencils and components by cubes, and scores by bit slices, against plain loops."""

from __future__ import annotations

from collections import deque
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscore.operators import lattice, score, tiles

SHAPE = (19, 9, 17)


@pytest.fixture(scope="module")
def volume(spark):
    """Two volumes of scattered cells, some of them 0 or less, over several cubes."""
    rng = np.random.default_rng(2)
    plain = {}
    for g in ("a", "b"):
        cells = [c for c in product(*map(range, SHAPE)) if rng.random() < 0.3]
        plain[g] = {c: float(np.round(rng.normal() + 0.5, 3)) for c in cells}
    rows = [(g, *c, v) for g, cells in plain.items() for c, v in cells.items()]
    return plain, spark.createDataFrame(rows, "g string, i int, j int, k int, value double").repartition(5)


def _got(df, value="value"):
    out = {}
    for r in df.collect():
        assert (r.i, r.j, r.k) not in out.setdefault(r.g, {})
        out[r.g][r.i, r.j, r.k] = r[value] if value else None
    return out


def _back(x, n):
    x %= 2 * n
    return 2 * n - 1 - x if x >= n else x


def _scattered(cells, sigmas, shape=None):
    for axis, sigma in enumerate(sigmas):
        out = {}
        for c, v in cells.items():
            for by, w in lattice.gaussian_taps(sigma):
                to = list(c)
                to[axis] = _back(c[axis] + by, shape[axis]) if shape else c[axis] + by
                out[tuple(to)] = out.get(tuple(to), 0.0) + w * v
        cells = out
    return cells


@pytest.mark.parametrize(("sigmas", "masked", "shape"), [((0.8, 0.8, 0.8), True, None), ((0.5, 1.1, 0.0), True, None), ((2.0, 2.0, 2.0), False, SHAPE), ((0.7, 0.7, 0.7), False, None), ((3.0, 0.6, 0.6), False, SHAPE)])
def test_gaussians(volume, sigmas, masked, shape):
    plain, df = volume
    found = _got(lattice.smooth(df, ["g"], sigmas, masked=masked, shape=shape))
    for g, cells in plain.items():
        want = _scattered(cells, sigmas, None if masked else shape)
        if masked:
            want = {c: want[c] for c, v in cells.items() if v > 0}
        assert found[g].keys() == want.keys()
        for c, v in want.items():
            assert found[g][c] == pytest.approx(v, abs=1e-12)


SIX = [(a, b, c) for a, b, c in product((-1, 0, 1), repeat=3) if abs(a) + abs(b) + abs(c) == 1]


def _near(c, steps=SIX):
    return [tuple(p + q for p, q in zip(c, s, strict=True)) for s in steps]


def _inside(c):
    return all(0 <= x < n for x, n in zip(c, SHAPE, strict=True))


def test_maxima_and_morphology(volume):
    plain, df = volume
    most = _got(lattice.maximum(df, ["g"], shape=SHAPE))
    clean = _got(lattice.clean_mask(df, ["g"], SHAPE, 0.2))
    for g, cells in plain.items():
        want = {}
        for c, v in cells.items():
            for to in _near(c, list(product((-1, 0, 1), repeat=3))):
                if _inside(to):
                    want[to] = max(want.get(to, v), v)
        assert most[g] == want
        grow = lambda m: m | {n for c in m for n in _near(c)}
        shrink = lambda m: {c for c in m if all(n in m for n in _near(c))}
        cut = np.quantile([v for v in cells.values() if v > 0], 0.2)
        opened = {c for c in grow(shrink({c for c, v in cells.items() if v > cut})) if _inside(c)}
        kept = {c for c in grow(shrink(grow(opened))) if _inside(c)}
        assert clean.get(g, {}).keys() == kept & cells.keys()
    full = df.sparkSession.range(19 * 9 * 17).selectExpr("'g' AS g", "cast(id % 19 as int) AS i", "cast(id div 19 % 9 as int) AS j", "cast(id div 171 as int) AS k", "1.0D + id AS value")
    # a full lattice loses only where erosion meets its edge, and gets most of it back
    assert lattice.erode(full, ["g"]).count() == 17 * 7 * 15 and lattice.dilate(full, ["g"], SHAPE).count() == 19 * 9 * 17


def _groups(cells):
    left, out = set(cells), []
    while left:
        group, todo = set(), deque([left.pop()])
        while todo:
            c = todo.popleft()
            group.add(c)
            for n in _near(c):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(group)
    return out


def test_components(volume):
    plain, df = volume
    snake = [(x if y // 2 % 2 == 0 else 30 - x, y, 5) for y in range(0, 24, 2) for x in range(31)] + [(30 if y // 2 % 2 == 0 else 0, y + 1, 5) for y in range(0, 22, 2)]
    negative = [(-9, -8, -1), (-9, -8, 0), (-9, -8, 2)]
    rows = df.select("g", "i", "j", "k").unionByName(df.sparkSession.createDataFrame([("s", *c) for c in snake * 2] + [("n", *c) for c in negative], "g string, i int, j int, k int"))
    found = {}
    for r in lattice.components(rows, ["g"]).collect():
        found[r.g, r.i, r.j, r.k] = (tuple(r.component), r["size"])
    for g, cells in {**{g: list(c) for g, c in plain.items()}, "s": snake, "n": negative}.items():
        for group in _groups(cells):
            for c in group:
                assert found.pop((g, *c)) == ((g, *min(group)), len(group))
    assert not found
    assert lattice.components(rows.limit(0), ["g"]).count() == 0 and lattice.smooth(df.limit(0), ["g"], (1.0,) * 3).count() == 0


def test_what_is_exchanged_grows_with_cubes(spark):
    full = spark.range(32**3).selectExpr("'g' AS g", "cast(id % 32 as int) AS i", "cast(id div 32 % 32 as int) AS j", "cast(id div 1024 as int) AS k", "1.0D AS value")
    cubes = tiles.packed(full, ["g"], "value", 8)
    around = tiles.surrounded(cubes, ["g"], 3, 8)
    assert cubes.count() == 64 and around.count() == 6**3  # those outside get what spreads beyond the edge
    assert around.selectExpr("sum(size(at))").first()[0] == 32**3 * (14 / 8) ** 3
    named = [x for x in lattice.smooth(full, ["g"], (0.8,) * 3)._jdf.queryExecution().toString().split("\n") if "Generate explode" in x]
    assert not named


@pytest.mark.parametrize(("channels", "other"), [(5, 5), (64, 64), (65, 65), (150, 150), (9, 7)])
def test_bit_slices_count_as_loops_do(spark, channels, other):
    rng = np.random.default_rng(channels)
    w = [np.round(rng.random(channels), 2).tolist() for _ in range(6)] + [[1.0] * channels, None]
    v = [np.round(rng.random(other), 1).tolist() for _ in range(4)] + [None]
    a, b = spark.createDataFrame(list(enumerate(w)), "voxel_id int, w array<double>"), spark.createDataFrame(list(enumerate(v)), "epoch int, v array<double>")
    found = {(r.voxel_id, r.epoch): r for r in score.pair_scores(a, b, ["voxel_id", "epoch"], n=5, alpha=0.25, eps=1e-9, agreement=True).collect()}
    assert len(found) == 7 * 4
    for (p, q), r in found.items():
        cut = lambda x: np.minimum(np.floor((np.array(x) - min(x)) / (max(x) - min(x)) * 5), 4).astype(int) if max(x) > min(x) else np.full(len(x), 2)
        x, y = cut(w[p]), cut(v[q])
        n = min(len(x), len(y))
        joint = np.full((5, 5), 0.25)
        np.add.at(joint, (x[:n], y[:n]), 1.0)
        joint /= joint.sum()
        assert r.mi == pytest.approx(max(0, (joint * np.log(joint / (np.outer(joint.sum(1), joint.sum(0)) + 1e-9))).sum()), abs=1e-12)
        assert r.agreement == pytest.approx((x[:n] == y[:n]).sum() / len(x))
        rank = lambda x: np.array([(np.array(x) < e).sum() + ((np.array(x) == e).sum() + 1) / 2 for e in x]) / len(x)
        s, t = rank(w[p]), rank(v[q])
        assert r.dice == pytest.approx(2 * (s[:n] * t[:n]).sum() / ((s**2).sum() + (t**2).sum()), abs=1e-11)


def test_scaled_scores_join_no_pairs(spark):
    a = spark.createDataFrame([(k, [float(k % 3), float(k), 1.0, 0.0]) for k in range(9)], "voxel_id int, w array<double>")
    b = spark.createDataFrame([(k, [float(k), 1.0, 2.0, 0.5]) for k in range(3)], "epoch int, v array<double>")
    found = score.scaled_scores(a, b, ["voxel_id", "epoch"], ["epoch"])
    ends = found.groupBy("epoch").agg(F.min("mi"), F.max("mi"), F.min("dice"), F.max("dice")).collect()
    assert all(tuple(r)[1:] == (0.0, 1.0, 0.0, 1.0) for r in ends)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "BroadcastHashJoin" in plan  # only the ends are joined, a row an epoch
