"""Bitmaps of voxels against sets, and the versioned store through failed writes, old versions and new sessions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridscore.operators import masks
from gridscore.sources.store import ScoreStore


def _sets(found):
    out = {}
    for r in found.collect():
        assert r.voxel_id not in out.setdefault(r.g, set())
        out[r.g].add(r.voxel_id)
    return out


def test_masks_are_sets(spark):
    rng = random.Random(3)
    plain = {name: {g: {rng.randrange(-200, 700) for _ in range(rng.choice((0, 5, 300)))} | {63, 64} for g in "ab"} for name in ("one", "two", "three")}
    plain["two"]["b"] = {5}
    rows = {name: spark.createDataFrame([(g, v) for g, vs in sets.items() for v in vs for _ in range(2)] + [("a", None)], "g string, voxel_id long") for name, sets in plain.items()}
    made = {name: masks.mask(df, ["g"]) for name, df in rows.items()}
    for name, m in made.items():
        assert _sets(masks.members(m, ["g"])) == plain[name]
        assert {r.g: r.n for r in masks.size(m, ["g"]).collect()} == {g: len(s) for g, s in plain[name].items()}
    every = list(made.values())
    both = {g: set.intersection(*[plain[n][g] for n in plain]) for g in "ab"}
    assert _sets(masks.members(masks.intersection(every, ["g"]), ["g"])) == {g: s for g, s in both.items() if s}
    assert _sets(masks.members(masks.union(every, ["g"]), ["g"])) == {g: set.union(*[plain[n][g] for n in plain]) for g in "ab"}
    less = {g: plain["one"][g] - plain["two"][g] for g in "ab"}
    assert _sets(masks.members(masks.difference(made["one"], made["two"], ["g"]), ["g"])) == {g: s for g, s in less.items() if s}
    kept = masks.within(rows["three"].withColumn("bits", F.lit("clash")), made["one"], ["g"])
    assert kept.columns == ["g", "voxel_id", "bits"] and sorted((r.g, r.voxel_id) for r in kept.collect()) == sorted((g, v) for g in "ab" for v in plain["three"][g] & plain["one"][g] for _ in range(2))
    assert masks.mask(rows["one"], ["g"], where=F.lit(None).cast("boolean")).count() == 0


def _scores(spark, band, recordings, mi):
    return spark.range(200).selectExpr(f"'{band}' AS band", "id AS voxel_id", f"{mi}D + id AS mi").crossJoin(spark.createDataFrame([(r,) for r in recordings], "recording_id long")).select("band", "recording_id", "voxel_id", "mi")


def test_versions(spark, tmp_path):
    store = ScoreStore(spark, str(tmp_path / "s"), buckets=4)
    assert store.version() == 0 and store.manifest().count() == 0
    with pytest.raises(ValueError, match="empty"):
        store.read()
    assert store.write(_scores(spark, "alpha", [1, 2], 0).unionByName(_scores(spark, "beta", [1], 5))) == 1
    assert store.write(_scores(spark, "alpha", [2, 3], 1000)) == 2
    sums = lambda df: {(r.band, r.recording_id): r.s for r in df.groupBy("band", "recording_id").agg(F.min("mi").alias("s")).collect()}
    assert sums(store.read()) == {("alpha", 1): 0, ("alpha", 2): 1000, ("alpha", 3): 1000, ("beta", 1): 5}
    assert sums(store.read(1)) == {("alpha", 1): 0, ("alpha", 2): 0, ("beta", 1): 5} and store.read().count() == 800
    fail = F.udf(lambda v: v / (v - 150), "double")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        store.write(_scores(spark, "alpha", [1], 7).withColumn("mi", fail(F.col("voxel_id").cast("double"))))
    assert store.version() == 2 and sums(store.read())["alpha", 1] == 0
    todo = spark.createDataFrame([("alpha", 1), ("alpha", 4), ("beta", 1), ("beta", 2)], "band string, recording_id long")
    assert sorted(map(tuple, store.pending(todo).collect())) == [("alpha", 4), ("beta", 2)]
    # another session knows no tables, only the folder
    for t in spark.catalog.listTables():
        if t.name.startswith("gridscore_part"):
            spark.sql(f"DROP TABLE {t.name}")
    assert sums(ScoreStore(spark, str(tmp_path / "s"), buckets=4).read())["alpha", 2] == 1000


def test_stores_join_without_a_shuffle(spark, tmp_path):
    one, two = (ScoreStore(spark, str(tmp_path / n), buckets=4) for n in "ab")
    one.write(_scores(spark, "alpha", [1], 0))
    two.write(_scores(spark, "alpha", [9], 50))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = one.read().alias("a").join(two.read().alias("b"), "voxel_id").select("voxel_id", (F.col("b.mi") - F.col("a.mi")).alias("d"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 200 and {r.d for r in joined.collect()} == {50.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
