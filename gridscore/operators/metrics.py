"""Aggregates over voxels: thresholds, band metrics, zones, regions, concentration and localisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscore.functions.geometry import in_box, zone
from gridscore.model import TARGETS, Box, Target
from gridscore.operators.order import quantiles, value_counts
from gridscore.operators.score import bin_value
from gridscore.session import stored

EPS = 1e-12


def sum_where(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(0.0))


def threshold_positive(df: DataFrame, keys: list[str], share: float, value: str = "value") -> DataFrame:
    """Values below the quantile `share` of the positive ones of their group become 0; groups without any stay as they are."""
    df = stored(df, "raw")
    cut = quantiles(df.where(F.col(value) > 0), keys, value, {"_cut": share})
    return df.join(cut, keys, "left").withColumn(value, F.when(F.col(value) < F.col("_cut"), 0.0).otherwise(F.col(value))).drop("_cut")


def normalise_and_threshold(df: DataFrame, keys: list[str], share: float, value: str = "value") -> DataFrame:
    """Non-zero values become z-scores within keys (population deviation), those nearer to 0 than the quantile `share` of |z| become 0."""
    some = df.where(F.col(value) != 0)
    moments = some.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    scored = stored(df.join(moments, keys, "left").withColumn("_z", F.when(F.col(value) != 0, F.try_divide(F.col(value) - F.col("_m"), F.col("_s")))), "scored")
    cut = quantiles(scored.where("_z is not null").withColumn("_z", F.abs("_z")), keys, "_z", {"_cut": share})
    kept = F.when(F.abs("_z") >= F.col("_cut"), F.col("_z")).otherwise(0.0)
    return scored.join(cut, keys, "left").withColumn(value, kept).drop("_m", "_s", "_z", "_cut")


def target_value(target: Target, value: Column) -> Column:
    """The raw metric of one group as an aggregate: a ratio of sums or means over boxes, or a box's share or odds."""
    inside = in_box(target.region)
    own = sum_where(inside, value)
    if target.kind in ("ratio", "mean_ratio"):
        other = in_box(target.against or Box())
        rest = sum_where(other, value)
        if target.kind == "mean_ratio":
            own, rest = F.avg(F.when(inside, value)), F.avg(F.when(other, value))
        return F.when(F.max(inside.cast("int")) + F.max(other.cast("int")) == 2, own / (rest + EPS)).otherwise(0.0)
    share = own / (F.sum(value) + EPS)
    return F.when(F.max(inside.cast("int")) == 1, share if target.kind == "proportion" else share / (1 - share + EPS)).otherwise(0.0)


def target_score(target: Target, raw: Column) -> Column:
    """1 at the target, falling as a Cauchy curve; a raw value in range gains 15 percent, up to 1."""
    spread = (target.high - target.low) / 4 if target.high - target.low >= 4e-6 else 1.0
    score = 1 / (1 + F.pow((raw - target.value) / spread, F.lit(2.0)))
    return F.when(raw.between(target.low, target.high), F.least(F.lit(1.0), score * 1.15)).otherwise(score)


def penalty_of(band: str, front_over_back: Column, middle_pct: Column) -> Column:
    """Factor for a band's implausible layouts."""
    # fixed values: where a layout becomes implausible, and twice the squared width of the fall beyond
    if band == "delta":
        f = front_over_back
        return F.coalesce(F.when(f > 1.5, F.exp(-F.pow(f - 1.5, F.lit(2.0)) / 4.5)).when(f < 0.8, F.exp(-F.pow(0.8 - f, F.lit(2.0)) / 0.5)), F.lit(1.0))
    if band == "beta":
        return F.when(middle_pct > 35, F.exp(-F.pow(middle_pct - 35, F.lit(2.0)) / 800)).otherwise(1.0)
    return F.lit(1.0)


def band_penalty(band: str, value: Column) -> Column:
    """penalty_of() one group, as an aggregate."""
    y = F.col("y")
    return penalty_of(band, F.avg(F.when(y > 0, value)) / (F.avg(F.when(y < -40, value)) + EPS), 100 * sum_where(y.between(-45, 15), value) / (F.sum(value) + EPS))


def band_metric(df: DataFrame, keys: list[str], band: str, value: str = "value", target: Target | None = None) -> DataFrame:
    """keys, raw, and metric (score times penalty) of the time-mean values of located voxels; one aggregate."""
    target = target or TARGETS[band]
    v = F.col(value)
    found = df.groupBy(*keys).agg(target_value(target, v).alias("raw"), band_penalty(band, v).alias("_penalty"))
    return found.select(*keys, "raw", (target_score(target, F.col("raw")) * F.col("_penalty")).alias("metric"))


def posterior_anterior(df: DataFrame, keys: list[str], value: str = "value", cut: float = -40.0, front: float = 0.0) -> DataFrame:
    """keys, pa_ratio and occipital_pct of located values."""
    v, y = F.col(value), F.col("y")
    return df.groupBy(*keys).agg((sum_where(y < cut, v) / (sum_where(y > front, v) + EPS)).alias("pa_ratio"), (100 * sum_where(y < -70, v) / (F.sum(v) + EPS)).alias("occipital_pct"))


def positive_ratio(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys and pa_ratio of positive mass."""
    return posterior_anterior(df.withColumn("_p", F.greatest(F.col(value), F.lit(0.0))), keys, "_p").select(*keys, "pa_ratio")


def posterior_enrichment(df: DataFrame, voxels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys and enrichment: positive mass per grey voxel, posterior over anterior; voxels count whether active or not."""
    room = voxels.where("is_gm").agg(F.sum((F.col("y") < -40).cast("int")).alias("_post"), F.sum((F.col("y") > 0).cast("int")).alias("_ant"))
    v, y = F.greatest(F.col(value), F.lit(0.0)), F.col("y")
    sums = df.where("is_gm").groupBy(*keys).agg(sum_where(y < -40, v).alias("_p"), sum_where(y > 0, v).alias("_a"))
    ratio = (F.col("_p") / (F.col("_post") + EPS)) / (F.col("_a") / (F.col("_ant") + EPS) + EPS)
    return sums.crossJoin(F.broadcast(room)).select(*keys, ratio.alias("enrichment"))


def distribution(df: DataFrame, keys: list[str], n_cells: int, active: float = 0.001, value: str = "value") -> DataFrame:
    """Active count, coverage, posterior, anterior and left shares, mean and deviation of voxels' time-mean |value|."""
    voxel = df.groupBy(*keys, "voxel_id").agg(F.avg(F.abs(value)).alias("_v"), F.first("x").alias("x"), F.first("y").alias("y")).where(F.col("_v") > active)
    share = lambda c: F.avg(c.cast("double"))
    return voxel.groupBy(*keys).agg(
        F.count("*").alias("total_active"), (100.0 * F.count("*") / n_cells).alias("coverage_pct"), share(F.col("y") < -40).alias("posterior_frac"),
        share(F.col("y") > 0).alias("anterior_frac"), share(F.col("x") < 0).alias("left_frac"), F.avg("_v").alias("mean_value"), F.stddev_pop("_v").alias("std_value"),
    )


def zone_shares(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, zone, pct of positive mass, n_active and mean of the active values."""
    positive = F.greatest(F.col(value), F.lit(0.0))
    zones = df.groupBy(*keys, zone(F.col("y")).alias("zone")).agg(F.sum(positive).alias("_s"), F.sum((F.col(value) > 0).cast("long")).alias("n_active"), F.coalesce(F.avg(F.when(F.col(value) > 0, F.col(value))), F.lit(0.0)).alias("mean"))
    # six rows a group
    total = F.sum("_s").over(Window.partitionBy(*keys))
    return zones.select(*keys, "zone", (100 * F.col("_s") / (total + EPS)).alias("pct"), "n_active", "mean")


def region_coverage(df: DataFrame, voxels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, roi_id, total, active voxels, coverage, mean, max and status of every region, active or not."""
    active = df.where(F.col(value) > 0).groupBy(*keys, "roi_id").agg(F.countDistinct("voxel_id").alias("active"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    totals = voxels.where("roi_id > 0").groupBy("roi_id").agg(F.count("*").alias("total"))
    grid = df.select(*keys).distinct().crossJoin(F.broadcast(totals)) if keys else totals
    found = grid.join(active, [*keys, "roi_id"], "left").fillna(0, ["active"]).fillna(0.0, ["mean", "max"])
    status = F.when(F.col("active") > 100, "Covered").when(F.col("active") > 0, "Weak").otherwise("Missing")
    return found.withColumn("coverage_pct", 100.0 * F.col("active") / F.greatest(F.col("total"), F.lit(1))).withColumn("status", status)


def region_series(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, roi_id, epoch and the region's mean; regions that are 0 throughout go."""
    series = df.groupBy(*keys, "roi_id", "epoch").agg(F.avg(value).alias("value"))
    some = series.groupBy(*keys, "roi_id").agg(F.max(F.abs("value")).alias("_m")).where("_m > 0").drop("_m")
    return series.join(some, [*keys, "roi_id"], "left_semi")


def region_peaks(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, roi_id, mean, std, max, n_voxels, and the epoch at which the region's mean is largest (the first of ties)."""
    plain = df.groupBy(*keys, "roi_id").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("max"), F.countDistinct("voxel_id").alias("n_voxels"))
    means = df.groupBy(*keys, "roi_id", "epoch").agg(F.round(F.avg(value), 9).alias("_m"))
    peaks = means.groupBy(*keys, "roi_id").agg(F.max_by("epoch", F.struct("_m", -F.col("epoch"))).alias("peak_epoch"))
    return plain.join(peaks, [*keys, "roi_id"])


def centroids(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count("*").alias("n"))


def mean_signature(signatures: DataFrame, keys: list[str], values: str = "w") -> DataFrame:
    """keys, pos and the mean entry there of the group's arrays."""
    return signatures.select(*keys, F.posexplode(values).alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg("v").alias("value"))


def entropy(df: DataFrame, keys: list[str], value: str = "value", bins: int = 50) -> DataFrame:
    """keys and entropy in bits of the histogram of values over 0 to their largest; 0 where that isn't positive."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    binned = df.join(top, keys).where((F.col("_top") > 0) & (F.col(value) >= 0))
    counts = binned.groupBy(*keys, bin_value(F.col(value), F.lit(0.0), F.col("_top") + 1e-10, bins).alias("_bin")).count()
    # at most `bins` rows a group from here
    share = F.col("count") / F.sum("count").over(Window.partitionBy(*keys))
    found = counts.withColumn("_p", share).groupBy(*keys).agg(F.sum(-F.col("_p") * F.log2("_p")).alias("entropy"))
    return top.join(found, keys, "left").select(*keys, F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def gini(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys and gini: 2 sum(i v) / (n sum v) - (n + 1) / n over the sorted values; 0 where the sum is 0."""
    v, k = F.col(value), F.col("n")
    total, n = F.sum(k * v), F.sum(k)
    places = k * F.col("before") + k * (k + 1) / 2.0  # the sum of the places of k equal values
    counts = value_counts(df.where(v.isNotNull()), keys, value)
    return counts.groupBy(*keys).agg(F.coalesce(F.try_divide(2 * F.sum(places * v), n * total) - (n + 1) / n, F.lit(0.0)).alias("gini"))


def variation(value: str = "value") -> Column:
    return F.stddev_pop(value) / (F.avg(value) + 1e-10)


def dispersion(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys and dispersion: weighted mean distance from the weighted centre; 0 where the weights' sum isn't positive."""
    v = F.col(value)
    centre = df.groupBy(*keys).agg(F.sum(v).alias("_t"), *[F.try_divide(F.sum(v * F.col(c)), F.sum(v)).alias(f"_{c}") for c in "xyz"])
    d = F.sqrt(reduce(Column.__add__, [(F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in "xyz"]))
    found = df.join(centre, keys).where("_t > 0").groupBy(*keys).agg((F.sum(v * d) / F.sum(v)).alias("dispersion"))
    return centre.join(found, keys, "left").select(*keys, F.coalesce("dispersion", F.lit(0.0)).alias("dispersion"))


def concentration(df: DataFrame, keys: list[str], share: float = 0.95, value: str = "value") -> DataFrame:
    """keys and concentration: mass at or above the quantile `share`, over all mass."""
    df = stored(df.select(*keys, value), "mass")
    cut = quantiles(df, keys, value, {"_cut": share})
    v = F.col(value)
    return df.join(cut, keys).groupBy(*keys).agg((sum_where(v >= F.col("_cut"), v) / (F.sum(v) + 1e-10)).alias("concentration"))


def zone_entropy(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys and entropy in nats of the shares of three zones: y below -40, to 0, and above."""
    y, v = F.col("y"), F.col(value)
    sums = df.groupBy(*keys).agg(sum_where(y < -40, v).alias("_a"), sum_where((y >= -40) & (y < 0), v).alias("_b"), sum_where(y >= 0, v).alias("_c"))
    total = F.col("_a") + F.col("_b") + F.col("_c") + EPS
    terms = [F.when(F.col(c) > 0, -F.col(c) / total * F.log(F.col(c) / total)).otherwise(0.0) for c in ("_a", "_b", "_c")]
    return sums.select(*keys, reduce(Column.__add__, terms).alias("entropy"))


def spatial_kurtosis(value: str = "value") -> Column:
    """Excess kurtosis with population moments."""
    return F.kurtosis(value)


def temporal_stability(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys and stability: 1 / (1 + deviation / mean), 1 for a constant series."""
    s, m = F.stddev_pop(value), F.avg(value)
    return df.groupBy(*keys).agg(F.when(s > 0, 1 / (1 + s / (m + 1e-8))).otherwise(1.0).alias("stability"))


def channel_share(signatures: DataFrame, keys: list[str], channels: list[int], values: str = "w") -> DataFrame:
    """keys, the share of a signature on some channels, and its three largest channels."""
    w = F.col(values)
    part = F.aggregate(F.filter(F.transform(w, lambda v, i: F.when(i.isin(channels), v)), lambda v: v.isNotNull()), F.lit(0.0), lambda s, v: s + v)
    top = F.slice(F.reverse(F.array_sort(F.transform(w, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))), 1, 3)
    return signatures.select(*keys, part.alias("share"), F.transform(top, lambda s: -s["i"]).alias("top"))


def share_summary(shares: DataFrame, keys: list[str]) -> DataFrame:
    return shares.groupBy(*keys).agg(F.avg("share").alias("mean"), F.median("share").alias("median"), F.min("share").alias("min"), F.max("share").alias("max"))


def boosted_anatomy(weights: DataFrame, keys: list[str], weight: str = "weight", high: float = 1.05, low: float = 0.95) -> DataFrame:
    """keys, class (boosted, suppressed, neutral), and counts by zone, side and region: grouping sets in one pass."""
    kind = F.when(F.col(weight) > high, "boosted").when(F.col(weight) < low, "suppressed").otherwise("neutral")
    rows = weights.withColumn("class", kind).withColumn("zone", zone(F.col("y")))
    sets = [[F.col(c) for c in (*keys, "class", by)] for by in ("zone", "side", "roi_id")]
    return rows.groupingSets(sets, *[*keys, "class", "zone", "side", "roi_id"]).agg(F.count("*").alias("n"))


def channel_power(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return samples.groupBy(*keys).agg(F.avg(F.col(value) * F.col(value)).alias("power"))


def localise(power: DataFrame, channels: DataFrame, keys: list[str], points: DataFrame) -> DataFrame:
    """keys, method and least error to the points, of four estimates from channel power: the strongest channel, the
    weighted mean of the five and of the three strongest, and of those above the upper quartile."""
    located = power.join(F.broadcast(channels), "channel")
    ranked = located.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("power"), "channel")))
    quartile = power.groupBy(*keys).agg(F.percentile("power", F.lit(0.75)).alias("_q"))
    joined = ranked.join(quartile, keys)
    methods = {"max_channel": "_r = 1", "top5_weighted": "_r <= 5", "center_of_mass": "power > _q", "triangulation": "_r <= 3"}
    estimates = []
    for name, test in methods.items():
        w = F.when(F.expr(test), F.col("power")).otherwise(0.0)
        estimates.append(joined.groupBy(*keys).agg(*[F.try_divide(F.sum(w * F.col(c)), F.sum(w)).alias(c) for c in "xyz"]).withColumn("method", F.lit(name)))
    every = reduce(DataFrame.unionByName, estimates).alias("e").crossJoin(F.broadcast(points.alias("p")))
    d = F.sqrt(F.expr("(e.x - p.x) * (e.x - p.x) + (e.y - p.y) * (e.y - p.y) + (e.z - p.z) * (e.z - p.z)"))
    return every.groupBy(*[f"e.{k}" for k in keys], "e.method").agg(F.min(d).alias("error"))


def coverage_diagnostics(channels: DataFrame, points: DataFrame) -> DataFrame:
    """point_id, channels within 30 and 50 of each point, and the point's distance from the origin."""
    d = F.sqrt(F.expr("(c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) + (c.z - p.z) * (c.z - p.z)"))
    pairs = channels.alias("c").crossJoin(F.broadcast(points.alias("p"))).select("p.point_id", d.alias("d"), F.expr("sqrt(p.x * p.x + p.y * p.y + p.z * p.z)").alias("depth"))
    return pairs.groupBy("point_id").agg(F.sum((F.col("d") < 30).cast("long")).alias("within_30"), F.sum((F.col("d") < 50).cast("long")).alias("within_50"), F.first("depth").alias("depth"))


def signal_quality(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys and snr: mean square over variance; null for a constant signal."""
    return samples.groupBy(*keys).agg(F.try_divide(F.avg(F.col(value) * F.col(value)), F.var_pop(value)).alias("snr"))


def pattern_correlation(power: DataFrame, channels: DataFrame, points: DataFrame) -> DataFrame:
    """point_id and r between channel power and 1 / (distance + 20), for each point, and for the largest over points
    (point_id null); null where either is constant."""
    d = F.sqrt(F.expr("(c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) + (c.z - p.z) * (c.z - p.z)"))
    rows = power.join(F.broadcast(channels), "channel").alias("c").crossJoin(F.broadcast(points.alias("p"))).select("p.point_id", "c.channel", "c.power", (1 / (d + 20)).alias("raw"))
    most = rows.groupBy("point_id").agg(F.max("raw").alias("_m"))
    scaled = rows.join(F.broadcast(most), "point_id").withColumn("pattern", F.col("raw") / F.col("_m"))
    both = scaled.select("point_id", "channel", "power", "pattern").unionByName(scaled.groupBy("channel").agg(F.first("power").alias("power"), F.max("pattern").alias("pattern")).withColumn("point_id", F.lit(None).cast(dict(points.dtypes)["point_id"])))
    return correlation(both, ["point_id"], "power", "pattern")


def correlation(df: DataFrame, keys: list[str], a: str, b: str, name: str = "r") -> DataFrame:
    """keys and Pearson's r over rows where neither side is null; null where either is constant, which ANSI mode's corr()
    would raise on."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    moved = F.covar_pop(x, y)
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return df.groupBy(*keys).agg(F.when(spread > 1e-15, moved / spread).alias(name))


def summary(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def missing_names(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return expected.join(present, on, "left_anti")
