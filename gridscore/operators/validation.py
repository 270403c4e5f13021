"""Audits of scores and volumes: kernel behaviour, prior effect, targets, circularity, randomised places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscore.functions.geometry import in_box, prior_weights
from gridscore.model import Box, Params
from gridscore.operators import connect, metrics, resample, timeops
from gridscore.session import stored

EPS = 1e-12


def kernel_effect(series: DataFrame, keys: list[str], taps: list[float], value: str = "value", order: str = "epoch") -> DataFrame:
    """keys, variance_ratio (after over before), edge_ratio (mean absolute value of the first and last tenth over that of
    the rest, after) and lag1_before and lag1_after of series under a causal kernel; null for constant series."""
    after = timeops.convolve(series, keys, taps, value, order)
    span = series.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.var_pop(value).alias("_v"))
    tenth = (F.col("_hi") - F.col("_lo") + 1) / 10
    edge = (F.col(order) - F.col("_lo") < tenth) | (F.col("_hi") - F.col(order) < tenth)
    size = F.abs(value)
    found = after.join(span, keys).groupBy(*keys).agg(
        F.try_divide(F.var_pop(value), F.first("_v")).alias("variance_ratio"),
        F.try_divide(F.avg(F.when(edge, size)), F.avg(F.when(~edge, size))).alias("edge_ratio"),
    )
    before_r = timeops.lag1_correlation(series, keys, value, order).withColumnRenamed("r", "lag1_before")
    after_r = timeops.lag1_correlation(after, keys, value, order).withColumnRenamed("r", "lag1_after")
    return found.join(before_r, keys, "left").join(after_r, keys, "left")


def prior_effect(means: DataFrame, weights: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, r between raw and weighted maps, both maps' ratios, and the weights' mean, deviation and percent boosted."""
    both = means.join(weights.select("voxel_id", "weight"), "voxel_id").withColumn("_w", F.col(value) * F.col("weight"))
    raw = metrics.posterior_anterior(both, keys, value).select(*keys, F.col("pa_ratio").alias("raw_ratio"))
    weighted = metrics.posterior_anterior(both, keys, "_w").select(*keys, F.col("pa_ratio").alias("weighted_ratio"))
    stats = both.groupBy(*keys).agg(F.avg("weight").alias("weight_mean"), F.stddev_pop("weight").alias("weight_std"), (100 * F.avg((F.col("weight") > 1).cast("double"))).alias("boosted_pct"))
    return metrics.correlation(both, keys, value, "_w").join(raw, keys).join(weighted, keys).join(stats, keys)


def target_validation(found: DataFrame, keys: list[str], target: float, low: float, high: float, value: str = "metric") -> DataFrame:
    """keys, mean, median and deviation of a metric over recordings, mean distance from its target, percent in range."""
    v = F.col(value)
    return found.groupBy(*keys).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.avg(F.abs(v - target)).alias("distance"), (100 * F.avg(v.between(low, high).cast("double"))).alias("in_range_pct"))


def boundary_share(params: DataFrame, keys: list[str], name: str, low: float, high: float, margin: float = 0.05) -> DataFrame:
    """keys and percent of rows whose parameter lies within a margin (of the range) of either bound. A parameter that is a
    mean may lie on the margin but for its last bits, which hang on the order of summing; it counts as within."""
    edge = (high - low) * margin + EPS
    near = (F.col(name) <= low + edge) | (F.col(name) >= high - edge)
    return params.groupBy(*keys).agg((100 * F.avg(near.cast("double"))).alias("boundary_pct"))


def enrichment(values: DataFrame, keys: list[str], box: Box, names: list[str]) -> DataFrame:
    """keys and, for each column, its mean inside a box over that outside; null where either side is empty or 0."""
    inside = in_box(box)
    ratio = lambda n: F.try_divide(F.avg(F.when(inside, F.col(n))), F.avg(F.when(~inside, F.col(n)))).alias(f"{n}_enrichment")
    return values.groupBy(*keys).agg(*[ratio(n) for n in names])


def randomised_places(means: DataFrame, keys: list[str], n_perm: int, seed: int, id_: str = "voxel_id", value: str = "value") -> DataFrame:
    """keys, real ratio, the mean of ratios with permuted places, Cohen's d and Mann-Whitney U of real against permuted
    voxel values in the posterior half."""
    real = metrics.positive_ratio(means, keys, value)
    moved = resample.shuffled(means, keys, ["x", "y", "z"], id_, n_perm, seed)
    null = metrics.positive_ratio(moved, [*keys, "perm"], value).groupBy(*keys).agg(F.avg("pa_ratio").alias("null_ratio"), F.stddev_samp("pa_ratio").alias("null_std"))
    back = F.col("y") < -40
    both = means.where(back).select(*keys, value, F.lit(True).alias("real")).unionByName(moved.where(back & (F.col("perm") == 0)).select(*keys, value, F.lit(False).alias("real")))
    u = resample.mann_whitney(both, keys, "real", value).select(*keys, "u", "z")
    d = resample.cohen_d(both, keys, "real", value)
    return real.join(null, keys).join(u, keys, "left").join(d, keys, "left")


def place_test(means: DataFrame, voxels: DataFrame, keys: list[str], subject: str, n_perm: int, seed: int, id_: str = "voxel_id", value: str = "value") -> DataFrame:
    """keys, metric (pa_ratio, enrichment), means and deviations over subjects with real and with permuted places, and
    Mann-Whitney's u, its z and Cohen's d between the two.

    means: keys, subject, voxel_id, value, x, y, z and is_gm; each subject's places are permuted on their own. What is
    ranked is one ratio a subject and permutation.
    """
    own, y = [*keys, subject], F.col("y")
    means = stored(means.withColumn("_p", F.greatest(F.col(value), F.lit(0.0))), "places")
    zones = [y < -40, y > 0, F.col("is_gm") & (y < -40), F.col("is_gm") & (y > 0)]
    moved = resample.permuted_sums(means, own, zones, id_, n_perm, seed, "_p")
    real = means.groupBy(*own).agg(*[metrics.sum_where(z, F.col("_p")).alias(f"s{i}") for i, z in enumerate(zones)])
    # a subject without grey places has no enrichment, and takes no part
    grey = means.where("is_gm").select(*own).distinct()
    room = voxels.where("is_gm").agg(F.sum((y < -40).cast("int")).alias("_post"), F.sum((y > 0).cast("int")).alias("_ant"))
    sums = real.withColumn("real", F.lit(True)).unionByName(moved.drop("perm").withColumn("real", F.lit(False)))
    sums = sums.join(grey, own).crossJoin(F.broadcast(room))
    ratio = F.col("s0") / (F.col("s1") + EPS)
    enriched = (F.col("s2") / (F.col("_post") + EPS)) / (F.col("s3") / (F.col("_ant") + EPS) + EPS)
    pairs = F.array(F.struct(F.lit("pa_ratio").alias("metric"), ratio.alias("v")), F.struct(F.lit("enrichment").alias("metric"), enriched.alias("v")))
    both = stored(sums.select(*keys, "real", F.explode(pairs).alias("m")).select(*keys, "real", "m.*"), "ratios")
    by = [*keys, "metric"]
    one, two = F.when(F.col("real"), F.col("v")), F.when(~F.col("real"), F.col("v"))
    sizes = both.groupBy(*by).agg(F.avg(one).alias("real_mean"), F.stddev_pop(one).alias("real_std"), F.avg(two).alias("null_mean"), F.stddev_pop(two).alias("null_std"))
    pooled = F.sqrt((F.col("real_std") * F.col("real_std") + F.col("null_std") * F.col("null_std")) / 2 + EPS)
    d = ((F.col("real_mean") - F.col("null_mean")) / pooled).alias("d")
    return sizes.join(resample.mann_whitney(both, by, "real", "v").select(*by, "u", "z"), by).select(*by, "real_mean", "real_std", "null_mean", "null_std", "u", "z", d)


def counterfactual(scores: DataFrame, voxels: DataFrame, keys: list[str], band: str, params: Params) -> DataFrame:
    """keys, posterior-anterior ratios of the real map, of the inverted one and of the inverted one under the prior anew,
    and follows_data: whether the last is nearer to the inverted than to the real ratio.

    scores: keys, voxel_id, mi and dice of one band, a row an epoch. The prior at rest weighs 1, so that the inverted
    ratio is also the one without prior.
    """
    weights = prior_weights(voxels, band, params.boost, params.penalty, params.softening).select("voxel_id", "x", "y", "z", "weight")
    blend = params.mi_weight * F.col("mi") + (1 - params.mi_weight) * F.col("dice")
    rows = scores.groupBy(*keys, "voxel_id").agg(F.avg(blend).alias("_a")).join(weights, "voxel_id")
    rows = rows.withColumn("_b", F.col("_a") * resample.inversion(band)).withColumn("_c", F.col("_b") * F.col("weight"))
    y = F.col("y")
    ratio = lambda c: metrics.sum_where(y < -40, F.col(c)) / (metrics.sum_where(y > 0, F.col(c)) + EPS)
    found = rows.groupBy(*keys).agg(ratio("_a").alias("real"), ratio("_b").alias("inverted"), ratio("_c").alias("with_prior"))
    nearer = F.abs(F.col("with_prior") - F.col("inverted")) < F.abs(F.col("with_prior") - F.col("real"))
    return found.withColumn("follows_data", nearer)


def kernel_responses(series: DataFrame, keys: list[str], taps: list[float], at: int = 10, width: int = 10, order: str = "epoch") -> DataFrame:
    """keys, impulse_epoch, impulse_peak, block_epoch, block_peak and edge_ratio: where and how high an impulse and a
    block at epoch `at` peak under the kernel on the series' own epochs (the earliest of equal peaks), and a constant's
    first value over its middle one. Series that end before `at` peak at 0."""
    o = F.col(order)
    rows = series.select(*keys, order, (o == at).cast("double").alias("_i"), o.between(at, at + width - 1).cast("double").alias("_b"), F.lit(1.0).alias("_c"))
    for c in ("_i", "_b", "_c"):
        rows = timeops.convolve(rows, keys, taps, c, order)
    span = rows.groupBy(*keys).agg(F.min(order).alias("_lo"), F.expr(f"(min({order}) + max({order})) div 2").alias("_mid"))
    peak = lambda c: F.max(F.struct(F.round(c, 12).alias("v"), (-o).alias("o")))
    found = rows.join(span, keys).groupBy(*keys).agg(
        peak("_i").alias("_p"), peak("_b").alias("_q"), F.try_divide(F.max(F.when(o == F.col("_lo"), F.col("_c"))), F.max(F.when(o == F.col("_mid"), F.col("_c")))).alias("edge_ratio")
    )
    return found.select(*keys, (-F.col("_p.o")).alias("impulse_epoch"), F.col("_p.v").alias("impulse_peak"), (-F.col("_q.o")).alias("block_epoch"), F.col("_q.v").alias("block_peak"), "edge_ratio")


def signature_overlap(signatures: DataFrame, region: str = "roi_id", values: str = "w") -> DataFrame:
    """Mean and deviation of |r| between the regions' mean signatures."""
    mean = metrics.mean_signature(signatures, [region], values).withColumnRenamed("pos", "epoch")
    pairs = connect.correlations(mean, [], region)
    return pairs.agg(F.avg(F.abs("r")).alias("mean_overlap"), F.stddev_pop(F.abs("r")).alias("std_overlap"))


def kernel_on_connectivity(series: DataFrame, keys: list[str], taps: list[float], region: str = "roi_id") -> DataFrame:
    """keys, Pearson's and Spearman's r and rmse between the regions' correlations before and after a kernel."""
    before = connect.correlations(series, keys, region).withColumnRenamed("r", "a")
    after = connect.correlations(timeops.convolve(series, [*keys, region], taps), keys, region).withColumnRenamed("r", "b")
    both = before.join(after, [*keys, "roi_a", "roi_b"]).where("a is not null and b is not null")
    return connect.difference(both, keys, "a", "b").join(connect.rank_correlation(both, keys, "a", "b").withColumnRenamed("r", "rho"), keys)


def given_distance(matrices: DataFrame, centres: DataFrame, keys: list[str], a: str, b: str, region: str = "roi_id") -> DataFrame:
    """keys and the partial correlation of two region matrices (roi_a, roi_b, a, b) given the distance of the centres."""
    p, q = (centres.select(F.col(region).alias(n), F.struct("x", "y", "z").alias(f"_{n}")) for n in ("roi_a", "roi_b"))
    gap = lambda c: (F.col(f"_roi_a.{c}") - F.col(f"_roi_b.{c}")) * (F.col(f"_roi_a.{c}") - F.col(f"_roi_b.{c}"))
    rows = matrices.join(F.broadcast(p), "roi_a").join(F.broadcast(q), "roi_b").withColumn("_d", F.sqrt(gap("x") + gap("y") + gap("z")))
    return connect.partial_given(rows, keys, a, b, "_d")
