"""Ranks and quantiles of large groups against plain computations, and how they are spread over tasks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridscore.operators import connect, lattice, metrics, order, resample


@pytest.fixture(scope="module")
def rows(spark):
    """One group with most rows, a third of them alike; small groups; values that tie; nulls."""
    rng = np.random.default_rng(5)
    big = pd.DataFrame({"g": "big", "v": np.where(rng.random(60_000) < 0.34, 1.5, np.round(rng.normal(size=60_000), 3))})
    some = pd.DataFrame({"g": [f"s{k % 30}" for k in range(900)], "v": np.round(rng.normal(size=900), 1)})
    few = pd.DataFrame({"g": ["one", "two", "two", "flat", "flat", "flat", "none"], "v": [3.0, -1.0, 4.0, 2.0, 2.0, 2.0, None]})
    plain = pd.concat([big, some, few], ignore_index=True)
    plain["id"], plain["w"] = range(len(plain)), np.round(rng.normal(size=len(plain)) + plain.v.fillna(0), 2)
    return plain, spark.createDataFrame(plain).withColumn("v", F.nanvl("v", F.lit(None))).repartition(6)


def test_ranks(rows):
    plain, df = rows
    found = order.with_rank(df, ["g"], "v", "r").select("id", "r").toPandas().set_index("id").r
    want = plain.groupby("g").v.rank(method="average", na_option="top").set_axis(plain.id)
    assert found.loc[want.index].to_numpy() == pytest.approx(want.to_numpy())


def test_ranks_of_several_keys_and_of_null_ones(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 1, 2.0), (None, 1, 5.0), ("a", None, 0.0), ("a", None, -0.0), ("a", 2, float("nan")), ("a", 2, 1.0)], "a string, b int, v double")
    got = sorted(((r.a, r.b, r.r) for r in order.with_rank(df, ["a", "b"], "v", "r").collect()), key=str)
    assert got == sorted([(None, 1, 1.5), (None, 1, 1.5), (None, 1, 3.0), ("a", None, 1.5), ("a", None, 1.5), ("a", 2, 2.0), ("a", 2, 1.0)], key=str)
    assert order.with_rank(df.limit(0), ["a"], "v").count() == 0 and order.quantiles(df.limit(0), ["a"], "v", {"m": 0.5}).count() == 0


SHARES = {"least": 0.0, "low": 0.025, "third": 1 / 3, "middle": 0.5, "high": 0.95, "most": 1.0}


@pytest.mark.parametrize("accuracy", [2000, 3])
def test_quantiles_have_the_digits_of_percentile(rows, monkeypatch, accuracy):
    monkeypatch.setattr(order, "ACCURACY", accuracy)
    plain, df = rows
    found = order.quantiles(df, ["g"], "v", SHARES)
    want = df.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in SHARES.items()])
    assert found.columns == ["g", *SHARES] and sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {r.g: r.middle for r in found.collect()}["big"] == pytest.approx(plain[plain.g == "big"].v.median())


def test_a_bracket_that_misses_is_looked_up_again(rows, monkeypatch):
    _, df = rows
    slim, marks = df.selectExpr("g", "v AS _v"), df.selectExpr("g").distinct().selectExpr("g", "0 AS _i", "1.0D AS _at", "100.0D AS _low", "100.5D AS _high")
    assert order._looked_up(slim, marks, ["g"]).where("_below is not null").count() == 0
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, a: F.array(*[F.lit(100.0)] * 2))  # a sketch that is wrong
    found = order.quantiles(df, ["g"], "v", {"m": 0.5})
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, df.groupBy("g").agg(F.median("v")).collect()), key=str)


def test_one_group_is_spread_over_tasks(spark):
    """A million rows of one group: no range holds more than a few times its share, and a quantile sorts few of them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        df = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.xxhash64("id") % 700_000).cast("double").alias("v"))
        counts = order.value_counts(df, ["g"], "v").withColumn("task", F.spark_partition_id())
        sizes = [r.n for r in counts.groupBy("task").agg(F.count("*").alias("n"), F.max("before")).collect()]  # else no window is needed
        assert len(sizes) >= 8 and max(sizes) < 0.25 * sum(sizes)
        assert counts.agg(F.max(F.col("before") + F.col("n"))).first()[0] == 1_000_000
        seen = []
        running = order.running
        order.running = lambda c, *a: seen.append(c.count()) or running(c, *a)
        try:
            got = order.quantiles(df, ["g"], "v", {"m": 0.5}).first().m
        finally:
            order.running = running
        assert got == df.agg(F.median("v")).first()[0] and seen[0] < 10_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_statistics_of_ranks(rows):
    plain, df = rows
    whole, known = df.where("v is not null").withColumn("t", F.col("id") % 3 == 0), plain[plain.v.notna()]
    gini = {r.g: r.gini for r in metrics.gini(whole.withColumn("v", F.abs("v")), ["g"], "v").collect()}
    u = {r.g: r for r in resample.mann_whitney(whole, ["g"], "t", "v").collect()}
    rho = {r.g: r.r for r in connect.rank_correlation(whole, ["g"], "v", "w").collect()}
    for g, part in known.groupby("g"):
        v, n = np.sort(np.abs(part.v.to_numpy())), len(part)
        assert gini[g] == pytest.approx(2 * (np.arange(1, n + 1) * v).sum() / (n * v.sum()) - (n + 1) / n)
        own = part.id % 3 == 0
        assert u[g].u == pytest.approx(part.v.rank()[own].sum() - own.sum() * (own.sum() + 1) / 2) and (u[g].n1, u[g].n2) == (own.sum(), n - own.sum())
        if n > 30:
            assert rho[g] == pytest.approx(part.v.rank().corr(part.w.rank()))
    a, b = known[known.g == "big"].query("id % 3 == 0").v, known[known.g == "big"].query("id % 3 != 0").v
    ties = known[known.g == "big"].v.value_counts()
    n = len(a) + len(b)
    spread = math.sqrt(len(a) * len(b) / 12 * (n + 1 - (ties**3 - ties).sum() / (n * (n - 1))))
    assert u["big"].z == pytest.approx((u["big"].u - len(a) * len(b) / 2) / spread)


def test_statistics_of_quantiles(rows):
    plain, df = rows
    known = plain[plain.v.notna()]
    got = {r.g: r for r in resample.robust(df, ["g"], "v").collect()}
    levene = {r.g: r.w for r in resample.levene(df.where("v is not null").withColumn("t", F.col("id") % 2), ["g"], "t", "v").collect()}
    cut = metrics.threshold_positive(df, ["g"], 0.9, "v").toPandas().set_index("id").v
    for g, part in known.groupby("g"):
        mad = (part.v - part.v.median()).abs().median()
        assert (got[g].median, got[g].mad, got[g].robust_std) == (pytest.approx(part.v.median()), pytest.approx(mad), pytest.approx(1.4826 * mad))
        if (part.v > 0).any():
            kept = part.v.where(part.v >= np.quantile(part.v[part.v > 0], 0.9), 0.0)
            assert cut.loc[part.id].to_numpy() == pytest.approx(kept.to_numpy())
    assert got["none"].median is None
    part = known[known.g == "big"]
    z = (part.v - part.groupby(part.id % 2).v.transform("median")).abs()
    groups = [z[part.id % 2 == k] for k in (0, 1)]
    between = sum(len(x) * (x.mean() - z.mean()) ** 2 for x in groups)
    assert levene["big"] == pytest.approx((len(z) - 2) * between / sum(((x - x.mean()) ** 2).sum() for x in groups))
    cells = df.where("g = 'big'").selectExpr("g", "cast(id % 20 as int) AS i", "cast(id div 20 % 20 as int) AS j", "cast(id div 400 as int) AS k", "v AS value")
    assert lattice.clean_mask(cells, ["g"], (20, 20, 160)).count() > 0
