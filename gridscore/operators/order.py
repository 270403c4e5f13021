"""Ranks and exact quantiles of groups of any size: no group is sorted in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscore.session import stored

#: A quantile is bracketed by a sketch that is off by n / ACCURACY places at most, twice that to either side.
ACCURACY = 2000


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in columns], F.lit(True))


def running(counts: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """counts (one row a group and value, `n` rows each) with `before`: how many rows of the group have smaller values.

    Values are dealt into ranges over (keys, value), so a group lies in as many ranges as it fills; each range is summed
    on its own, and a range's offset is the sum of the group's earlier ranges' totals, of which there is one a range.
    A null value is the smallest, NaN the largest.
    """
    ranged = counts.repartitionByRange(*[F.col(k).asc_nulls_first() for k in (*keys, value)]).withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    totals = ranged.groupBy(*keys, "_range").agg(F.sum(n).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_range")  # a row a range
    offsets = totals.withColumn("_offset", F.sum("_total").over(earlier) - F.col("_total")).drop("_total")
    within = Window.partitionBy(*keys, "_range").orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("_sum", F.sum(n).over(within) - F.col(n))
    joined = summed.join(offsets, _same(summed, offsets, [*keys, "_range"]))
    return joined.select(*[summed[c] for c in counts.columns], (F.col("_sum") + F.col("_offset")).alias("before"))


def value_counts(df: DataFrame, keys: list[str], value: str, **also: Column) -> DataFrame:
    """keys, value, n, `also` (further aggregates) and before: running() over the distinct values of each group."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), *[c.alias(name) for name, c in also.items()])
    return running(counts, keys, value)


def with_rank(df: DataFrame, keys: list[str], value: str, rank: str = "rank") -> DataFrame:
    """df with the average rank of `value` within keys, ties sharing the mean of their places.

    Distinct values are counted before they are shuffled, ranked by running(), and joined back by an equi-join, whose
    frequent values Spark may split. df is stored first: a value that is worked out twice need not be the same.
    """
    df = stored(df, "unranked")
    ranks = value_counts(df, keys, value).select(*keys, value, (F.col("before") + (F.col("n") + 1) / 2.0).alias("_rank"))
    ranks = ranks.select(*[F.col(c).alias(f"_r_{c}") for c in (*keys, value)], "_rank")
    on = reduce(Column.__and__, [df[c].eqNullSafe(F.col(f"_r_{c}")) for c in (*keys, value)])
    return df.join(ranks, on).select(*[df[c] for c in df.columns if c != rank], F.col("_rank").alias(rank))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and a column for each of `shares`: the exact quantiles of a group's values, as percentile() interpolates them.

    A first pass counts and sketches each group; a second one counts the values below the sketch's bracket as one and
    those within it one by one, and the places asked for are looked up among their running counts. So buffers stay as
    small as a sketch, and what is sorted is about 4 / ACCURACY of the rows. A place that a bracket should miss is
    looked up once more among all values. Nulls don't count; a group of nulls only has null quantiles. df is read twice:
    store it where its values are worked out, above all if they are then compared with the quantiles.
    """
    names, room = list(shares), 2.0 / ACCURACY
    slim = df.select(*keys, F.col(value).cast("double").alias("_v"))
    cuts = [c for p in shares.values() for c in (max(0.0, p - room), min(1.0, p + room))]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(float(c)) for c in cuts]), F.lit(ACCURACY))
    known = stored(slim.groupBy(*keys).agg(F.count("_v").alias("_n"), sketch.alias("_cuts")), "sketch")
    places = []
    for i, p in enumerate(shares.values()):
        low = F.lit(None).cast("double") if cuts[2 * i] == 0.0 else F.col("_cuts")[2 * i]
        high = F.lit(None).cast("double") if cuts[2 * i + 1] == 1.0 else F.col("_cuts")[2 * i + 1]
        places.append(F.struct(F.lit(i).alias("_i"), (p * (F.col("_n") - 1)).alias("_at"), low.alias("_low"), high.alias("_high")))
    marks = known.where("_n > 0").select(*keys, F.explode(F.array(*places)).alias("m")).select(*keys, "m.*")
    found = _looked_up(slim, marks, keys)
    missed = found.where("_below is null or _above is null")
    if not missed.isEmpty():
        again = _looked_up(slim, missed.select(*keys, "_i", "_at", F.lit(None).cast("double").alias("_low"), F.lit(None).cast("double").alias("_high")), keys)
        found = found.where("_below is not null and _above is not null").unionByName(again)
    down, up = F.floor("_at"), F.ceil("_at")
    between = F.when((down == up) | (F.col("_below") == F.col("_above")), F.col("_below")).otherwise((up - F.col("_at")) * F.col("_below") + (F.col("_at") - down) * F.col("_above"))
    each = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, between)).alias(name) for i, name in enumerate(names)])
    groups = known.select(*keys) if keys else known.select("_n")
    return groups.join(each, _same(groups, each, keys), "left").select(*[groups[k] for k in keys], *names)


def _looked_up(slim: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """marks with the values at the whole places around `_at`; null where the value lies outside the bracket."""
    marks = stored(marks, "marks")
    own = marks.select(*[F.col(k).alias(f"_m_{k}") for k in keys], "_i", "_low", "_high")
    on = reduce(Column.__and__, [slim[k].eqNullSafe(F.col(f"_m_{k}")) for k in keys], F.lit(True))
    inside = F.when(F.col("_low").isNull() | (F.col("_v") >= F.col("_low")), F.struct("_v"))  # null: below the bracket
    rows = slim.where("_v is not null").join(own, on).where(F.col("_high").isNull() | (F.col("_v") <= F.col("_high")))
    counts = rows.select(*keys, "_i", inside.alias("_w")).groupBy(*keys, "_i", "_w").agg(F.count("*").alias("n"))
    summed = running(counts, [*keys, "_i"], "_w")
    joined = marks.join(summed, _same(marks, summed, [*keys, "_i"]), "left")
    holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
    value = lambda place: F.max(F.when(holds(place), F.col("_w._v")))
    return joined.groupBy(*[marks[c] for c in (*keys, "_i", "_at")]).agg(value(F.floor("_at")).alias("_below"), value(F.ceil("_at")).alias("_above"))
