"""Operators on packed series against those on a row an epoch."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscore.operators import timeops


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(4)
    cells = [("a", v, rng.normal(size=n).round(3) * (rng.random(n) < 0.7)) for v, n in enumerate((1, 2, 3, 8, 30, 30, 5))] + [("a", 9, np.zeros(6)), ("a", 10, np.full(7, 2.5)), ("b", 1, rng.normal(size=12))]
    return spark.createDataFrame([(g, v, e, float(x)) for g, v, values in cells for e, x in enumerate(values)], "band string, voxel_id int, epoch int, value double").repartition(4)


def _rows(df):
    return {(r.band, r.voxel_id, r.epoch): r.value for r in df.collect()}


def _same(packed, plain):
    got, want = _rows(timeops.unpacked_series(packed, ["band", "voxel_id"])), _rows(plain)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_packed_series_agree_with_rows(series):
    keys = ["band", "voxel_id"]
    packed = timeops.packed_series(series, keys)
    _same(packed, series)
    _same(packed.withColumn("values", timeops.ar1_packed(F.col("values"))), timeops.ar1(series, keys))
    _same(timeops.z_score_packed(packed, ["band"]), timeops.z_score(series, ["band"]))
    taps = timeops.canonical_kernel()
    _same(packed.withColumn("values", timeops.convolve_packed(F.col("values"), taps)), timeops.convolve(series, keys, taps))
    for window, least in ((3, 0.3), (4, 0.5), (7, 0.35), (1, 0.3)):
        _same(packed.withColumn("values", timeops.temporal_packed(F.col("values"), window, least)), timeops.temporal_keep(series, keys, window, least))
    both = packed.withColumn("values", timeops.temporal_packed(F.col("values"))).withColumn("values", timeops.convolve_packed(F.col("values"), taps))
    _same(both, timeops.convolve(timeops.temporal_keep(series, keys), keys, taps))
    assert "Window" not in both._jdf.queryExecution().executedPlan().toString()
