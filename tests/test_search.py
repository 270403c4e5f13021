"""Search statistics of all bands and their folds against a row-by-row version."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridscore.functions.geometry import raw_prior, scaled_prior
from gridscore.model import PRIORS, TARGETS
from gridscore.operators import search

BANDS = sorted(PRIORS)


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(8)
    places = rng.uniform([-70, -110, -40], [70, 70, 80], (60, 3)).round(1)
    rows = [(b, f"r{r}", v, *map(float, places[v]), float(rng.random()), float(rng.random())) for b in BANDS for r in range(7) for v in range(60) if rng.random() < 0.9]
    return spark.createDataFrame(rows, "band string, recording_id string, voxel_id int, x double, y double, z double, mi double, dice double").repartition(5)


@pytest.fixture(scope="module")
def candidates(spark):
    rng = np.random.default_rng(9)
    rows = [(b, 3 * c, *map(float, rng.uniform([0.2, 0.4, 1.0, 0.0, 0.0], [0.9, 1.3, 2.0, 0.6, 1.0]))) for b in BANDS for c in range(4)]
    rows += [(b, 99, 0.5, 1.0, 1.2, 0.0, 0.0) for b in BANDS]
    return spark.createDataFrame(rows, "band string, cand int, mi_weight double, contrast double, boost double, penalty double, softening double")


def _plain(scores, candidates, band):
    """Every row with every candidate."""
    prior, (inside, against) = PRIORS[band], search._regions(TARGETS[band])
    own, given = scores.where(F.col("band") == band), candidates.where(F.col("band") == band).drop("band")
    rows = own.crossJoin(given).withColumn("raw", raw_prior(prior, F.col("penalty"), F.col("x"), F.col("y"), F.col("z")))
    most = rows.groupBy("cand").agg(F.max("raw").alias("most"))
    weight = scaled_prior(F.col("raw"), F.col("most"), prior.least, F.col("boost"), F.col("softening"))
    h = (F.col("mi_weight") * F.col("mi") + (1 - F.col("mi_weight")) * F.col("dice")) * weight
    h = F.when(F.col("contrast") == 1.0, h).otherwise(F.pow(F.greatest(h, F.lit(1e-12)), F.col("contrast")))
    zones = {"in": inside, "against": against, "all": F.lit(True), "front": F.col("y") > 0, "back": F.col("y") < -40, "middle": F.col("y").between(-45, 15)}
    sums = [f(F.when(c, F.col("h") if p == "s" else F.lit(1)).otherwise(0)).alias(f"{p}_{n}") for n, c in zones.items() for p, f in (("s", F.sum), ("n", F.sum))]
    return rows.join(most, "cand").withColumn("h", h).groupBy("cand", "recording_id").agg(*sums, F.min("h").alias("lo"), F.max("h").alias("hi")).withColumn("band", F.lit(band))


def test_statistics_of_all_bands(scores, candidates, monkeypatch):
    monkeypatch.setattr(search, "CANDIDATES", 2)
    monkeypatch.setattr(search, "ROWS", 7)
    keys = ["band", "cand", "recording_id"]
    found = search.band_statistics(scores, candidates)
    got = found.toPandas().set_index(keys).sort_index()
    want = reduce(lambda a, b: a.unionByName(b), [_plain(scores, candidates, b) for b in BANDS]).toPandas().set_index(keys).sort_index()
    assert got.index.equals(want.index) and len(got) == 5 * 5 * 7
    for c in want.columns:
        assert np.allclose(got[c], want[c], rtol=1e-10), c
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _metrics(spark, frame):
    df = spark.createDataFrame(frame)
    return df.withColumn("m", search._metrics(BANDS)).toPandas().m.to_numpy()


def test_folds_are_those_of_recordings_left_in(spark, scores, candidates):
    stats = search.band_statistics(scores, candidates)
    plain = stats.toPandas()
    fold = {f"r{k}": k % 3 for k in range(7)}
    assignment = spark.createDataFrame(list(fold.items()), "recording_id string, fold int")
    found = search.evaluate(stats, assignment).toPandas().set_index(["band", "cand", "test_id"])
    names = [f"{p}_{z}" for z in search.ZONES for p in ("s", "n")]
    mains, parts = [], []
    for (band, cand), group in plain.groupby(["band", "cand"]):
        for test in fold:
            rest = group[group.recording_id != test]
            ends = {"lo": rest.lo.min(), "hi": rest.hi.max()}
            mains.append({"band": band, "cand": cand, "test_id": test, **rest[names].sum().to_dict(), **ends})
            for k in range(3):
                mine = rest[rest.recording_id.map(fold) == k]
                parts.append({"band": band, "cand": cand, "test_id": test, **mine[names].sum().to_dict(), **ends})
    mains, parts = pd.DataFrame(mains), pd.DataFrame(parts)
    mains["m"], parts["m"] = _metrics(spark, mains), _metrics(spark, parts)
    for r in mains.itertuples():
        m = parts[(parts.band == r.band) & (parts.cand == r.cand) & (parts.test_id == r.test_id)].m.to_numpy()
        stability = 1 - m.std() / (m.mean() + 1e-12)
        row = found.loc[(r.band, r.cand, r.test_id)]
        assert np.allclose([row.main, row.stability, row.objective], [r.m, stability, r.m * max(0.1, stability) - max(0, 0.15 - stability)])


def test_a_search_of_all_bands_is_that_of_each(scores):
    two = ["alpha", "delta"]
    both = search.optimise_bands(scores, two, n=4, rounds=2).toPandas().sort_values(["band", "test_id"]).reset_index(drop=True)
    assert len(both) == 14 and both.groupby("band").test_id.nunique().eq(7).all() and (both.mi_weight.between(0.3, 0.85)).all()
    start = search.optimise_bands(scores, two, n=4, rounds=0).toPandas().sort_values(["band", "test_id"]).reset_index(drop=True)
    assert (both.objective >= start.objective - 1e-12).all()
    one = search.optimise_band(scores.where("band = 'delta'").drop("band"), "delta", n=4, rounds=0).toPandas().sort_values("test_id").reset_index(drop=True)
    same = start[start.band == "delta"].reset_index(drop=True)
    assert np.allclose(one[same.columns.drop(["band", "test_id"])].astype(float), same.drop(columns=["band", "test_id"]).astype(float))
