"""Operators along epochs: whitening, z-scores, consistency, convolution, trends and lags."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridscore.functions.columns import let, total


def epochs(samples: DataFrame, size: int, keys: list[str], index: str = "sample_idx") -> DataFrame:
    """samples with `epoch` (tumbling, `size` samples each); samples of an incomplete last epoch go."""
    cut = samples.withColumn("epoch", F.floor(F.col(index) / size).cast("int"))
    whole = cut.groupBy(*keys, "epoch").agg(F.count("*").alias("_n")).where(F.col("_n") == size).drop("_n")
    return cut.join(whole, [*keys, "epoch"], "left_semi")


def densify(df: DataFrame, keys: list[str], grid: DataFrame, value: str = "value", fill: float = 0.0) -> DataFrame:
    """Every key of df with every row of a grid (such as epochs), all of which the result holds; absent values are `fill`."""
    whole = df.select(*keys).distinct().crossJoin(grid)  # Spark broadcasts the grid if it is small, by its size
    return whole.join(df, [*keys, *grid.columns], "left").fillna(fill, [value])


def lagged(keys: list[str], value: str = "value", order: str = "epoch") -> Column:
    return F.lag(value, 1).over(Window.partitionBy(*keys).orderBy(order))


def ar1(df: DataFrame, keys: list[str], value: str = "value", order: str = "epoch") -> DataFrame:
    """df with `phi` and `value` replaced by first-order residuals.

    phi is the population covariance of neighbours over the sample variance of the earlier ones, within +-0.99; the
    first residual is the value less the series' mean. Series of one epoch, and constant ones, have phi 0.
    """
    steps = df.withColumn("_prev", lagged(keys, value, order))
    y, p = F.col(value), F.col("_prev")
    pair = F.when(p.isNotNull(), y)
    fits = steps.groupBy(*keys).agg(F.covar_pop(pair, p).alias("_cov"), F.var_samp(p).alias("_var"), F.avg(pair).alias("_my"), F.avg(p).alias("_mp"), F.avg(y).alias("_m"))
    phi = F.coalesce(F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.col("_cov") / F.greatest(F.col("_var"), F.lit(1e-12)))), F.lit(0.0))
    fits = fits.withColumn("phi", phi)
    rest = F.when(p.isNull(), y - F.col("_m")).otherwise(y - (F.col("_my") - F.col("phi") * F.col("_mp")) - F.col("phi") * p)
    return steps.join(fits, keys).withColumn(value, rest).drop("_prev", "_cov", "_var", "_my", "_mp", "_m")


def z_score(df: DataFrame, scope: list[str], mode: str = "global", value: str = "value", voxel: list[str] | None = None) -> DataFrame:
    """df with z-scores within `scope`.

    global: over voxels that are active at some epoch, sample deviation; all: over all values, population deviation;
    active: over positive values; nonzero: over non-zero values (both population). Values outside stay; a flat group
    stays as it is.
    """
    v = F.col(value)
    if mode == "global":
        ever = df.groupBy(*(voxel or ["voxel_id"]), *scope).agg(F.max((v != 0).cast("int")).alias("_in"))
        rows = df.join(ever, [*(voxel or ["voxel_id"]), *scope])
        chosen, spread = F.col("_in") == 1, F.stddev_samp
    else:
        rows = df
        chosen, spread = {"all": F.lit(True), "active": v > 0, "nonzero": v != 0}[mode], F.stddev_pop
    moments = [F.avg(F.when(chosen, v)).alias("_m"), spread(F.when(chosen, v)).alias("_s")]
    found = rows.groupBy(*scope).agg(*moments) if scope else rows.agg(*moments)
    joined = rows.join(found, scope) if scope else rows.crossJoin(F.broadcast(found))
    return joined.withColumn(value, F.when(chosen & (F.col("_s") > 1e-10), (v - F.col("_m")) / F.col("_s")).otherwise(v)).drop("_m", "_s", "_in")


def _mirrored(df: DataFrame, keys: list[str], order: str, window: int) -> DataFrame:
    """df with the first and last epochs of each series repeated in reverse before and after it (edge value included)."""
    span = Window.partitionBy(*keys)
    ends = df.withColumn("_lo", F.min(order).over(span)).withColumn("_hi", F.max(order).over(span)).withColumn("_own", F.lit(True))
    o = F.col(order)
    before = ends.where(o - F.col("_lo") < window).withColumn(order, (2 * F.col("_lo") - 1 - o).cast(dict(df.dtypes)[order])).withColumn("_own", F.lit(False))
    after = ends.where(F.col("_hi") - o < window).withColumn(order, (2 * F.col("_hi") + 1 - o).cast(dict(df.dtypes)[order])).withColumn("_own", F.lit(False))
    return ends.unionByName(before).unionByName(after).drop("_lo", "_hi")


def active_share(df: DataFrame, keys: list[str], window: int, edge: str = "reflect", value: str = "value", order: str = "epoch") -> DataFrame:
    """df with `share`: how many of the `window` epochs around each are active (value > 0).

    Windows reach window // 2 epochs back and the rest ahead. edge "reflect" mirrors the series (epochs must be
    gapless), "zero" counts what lies beyond as inactive and divides by the window all the same.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window // 2), window - 1 - window // 2)
    active = (F.col(value) > 0).cast("double")
    if edge == "zero":
        return df.withColumn("share", F.sum(active).over(w) / window)
    return _mirrored(df, keys, order, window).withColumn("share", F.avg(active).over(w)).where("_own").drop("_own")


def temporal_keep(df: DataFrame, keys: list[str], window: int = 3, least: float = 0.3, edge: str = "reflect", chunk: int | None = None, value: str = "value", order: str = "epoch") -> DataFrame:
    """df with values set to 0 where too few neighbours in time are active; chunk: series are cut into such lengths first."""
    rows, own = df, keys
    if chunk:
        rows, own = df.withColumn("_chunk", F.floor(F.col(order) / chunk)), [*keys, "_chunk"]
    kept = active_share(rows, own, window, edge, value, order)
    return kept.withColumn(value, F.when(F.round("share", 9) >= least, F.col(value)).otherwise(0.0)).drop("share", "_chunk")


def canonical_kernel(tr: float = 2.0, length: float = 32.0, a1: int = 6, a2: int = 16, ratio: float = 1 / 6) -> list[float]:
    """Difference of two gamma densities sampled every tr seconds, summing to 1."""
    times = [k * tr for k in range(int(length / tr))]
    density = lambda t, a: t ** (a - 1) * math.exp(-t) / math.factorial(a - 1)
    raw = [density(t, a1) - ratio * density(t, a2) for t in times]
    return [x / sum(raw) for x in raw]


def kernel_table(spark: SparkSession, taps: list[float]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(taps)), "tap int, weight double")


def convolve(df: DataFrame, keys: list[str], taps: list[float], value: str = "value", order: str = "epoch") -> DataFrame:
    """df with `value` convolved causally; before its first epoch a series holds its first value. Epochs are gapless."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    terms = [F.lit(float(t)) * (F.coalesce(F.lag(value, k).over(w), first) if k else F.col(value)) for k, t in enumerate(taps)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn(value, total)


def convolve_packed(values: Column, taps: list[float]) -> Column:
    """convolve() of an array column, without a window."""
    kernel = F.array(*[F.lit(float(t)) for t in taps])
    one = lambda v, i: F.aggregate(F.sequence(F.lit(0), F.lit(len(taps) - 1)), F.lit(0.0), lambda s, k: s + F.get(kernel, k) * F.get(v, F.greatest(i - k, F.lit(0))))
    # bound once: a column that a projection before makes would be worked out again for each tap
    return let(values, lambda v: F.transform(v, lambda _, i: one(v, i)))


def packed_series(df: DataFrame, keys: list[str], value: str = "value", order: str = "epoch") -> DataFrame:
    """keys, epochs and values: a row a series, in order of its epochs."""
    gathered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))
    return df.groupBy(*keys).agg(gathered.alias("_s")).select(*keys, F.transform("_s", lambda s: s["o"]).alias("epochs"), F.transform("_s", lambda s: s["v"]).alias("values"))


def unpacked_series(series: DataFrame, keys: list[str], value: str = "value", order: str = "epoch") -> DataFrame:
    """packed_series() as a row an epoch."""
    return series.select(*keys, F.explode(F.arrays_zip("epochs", "values")).alias("_s")).select(*keys, F.col("_s.epochs").alias(order), F.col("_s.values").alias(value))


def ar1_packed(values: Column) -> Column:
    """ar1() of one series at rest, without a window or a join."""

    def fitted(m: Column) -> Column:
        n = m["n"] - 1
        means = F.struct((total(m["y"]) / n).alias("y"), (total(m["p"]) / n).alias("p"))
        moments = lambda c: F.struct(
            (total(F.zip_with(m["y"], m["p"], lambda y, p: (y - c["y"]) * (p - c["p"]))) / n).alias("cov"), (total(F.transform(m["p"], lambda p: (p - c["p"]) * (p - c["p"]))) / F.greatest(n - 1, F.lit(1))).alias("var")
        )
        phi = lambda s: F.greatest(F.lit(-0.99), F.least(F.lit(0.99), s["cov"] / F.greatest(s["var"], F.lit(1e-12))))
        rest = lambda c: let(let(moments(c), phi), lambda f: F.zip_with(m["y"], m["p"], lambda y, p: y - (c["y"] - f * c["p"]) - f * p))
        first = F.array(m["v"][0] - total(m["v"]) / m["n"])
        return F.when(n > 0, F.concat(first, let(means, rest))).otherwise(first)

    n = F.size(values)
    parts = F.struct(values.alias("v"), F.slice(values, 2, F.greatest(n - 1, F.lit(0))).alias("y"), F.slice(values, 1, F.greatest(n - 1, F.lit(0))).alias("p"), n.alias("n"))
    return F.when(n > 0, let(parts, fitted)).otherwise(values)


def z_score_packed(series: DataFrame, scope: list[str], values: str = "values") -> DataFrame:
    """z_score() in mode global of series at rest: sums over a series are made in its row, then a row a task and scope moves.

    Deviations are from the mean of a first aggregate, so nothing cancels.
    """
    v = F.col(values)
    active = F.exists(v, lambda x: x != 0)
    rows = series.withColumn("_in", active)
    some = rows.where("_in")
    means = some.groupBy(*scope).agg((F.sum(total(v)) / F.sum(F.size(v))).alias("_m"), F.sum(F.size(v)).alias("_n"))
    squares = some.join(means, scope).groupBy(*scope, "_m", "_n").agg(F.sum(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m")))).alias("_ss"))
    found = squares.select(*scope, "_m", F.sqrt(F.try_divide(F.col("_ss"), F.col("_n") - 1)).alias("_s"))
    scaled = F.when(F.col("_in") & (F.col("_s") > 1e-10), F.transform(v, lambda x: (x - F.col("_m")) / F.col("_s"))).otherwise(v)
    return rows.join(found, scope, "left").withColumn(values, scaled).drop("_m", "_s", "_in")


def temporal_packed(values: Column, window: int = 3, least: float = 0.3) -> Column:
    """temporal_keep() of one series at rest whose epochs are gapless, mirrored at its ends."""

    def kept(m: Column) -> Column:
        n = m["n"]

        def near(i: Column) -> Column:
            places = F.sequence(i - window // 2, i + (window - 1 - window // 2))
            seen = F.transform(places, lambda k: F.get(m["v"], F.when(k < 0, -1 - k).when(k >= n, 2 * n - 1 - k).otherwise(k)))
            return F.filter(seen, lambda x: x.isNotNull())

        share = lambda i: let(near(i), lambda x: F.size(F.filter(x, lambda e: e > 0)) / F.size(x))
        return F.transform(m["v"], lambda x, i: F.when(F.round(share(i), 9) >= least, x).otherwise(0.0))

    return let(F.struct(values.alias("v"), F.size(values).alias("n")), kept)


def smoothness(df: DataFrame, keys: list[str], value: str = "value", order: str = "epoch") -> DataFrame:
    """df with `value` times 1 / (1 + mean absolute step) of its series; a series of one epoch keeps its value."""
    steps = df.withColumn("_d", F.abs(F.col(value) - lagged(keys, value, order)))
    mean = steps.groupBy(*keys).agg((1 / (1 + F.coalesce(F.avg("_d"), F.lit(0.0)))).alias("_w"))
    return steps.join(mean, keys).withColumn(value, F.col(value) * F.col("_w")).drop("_d", "_w")


def lag1_correlation(df: DataFrame, keys: list[str], value: str = "value", order: str = "epoch") -> DataFrame:
    """keys and r between neighbours in time; null where either side is constant or there are fewer than two pairs."""
    steps = df.withColumn("_p", lagged(keys, value, order)).where("_p is not null")
    spread = F.sqrt(F.var_pop(value)) * F.sqrt(F.var_pop("_p"))
    return steps.groupBy(*keys).agg(F.when((spread > 1e-15) & (F.count("*") > 1), F.covar_pop(value, "_p") / spread).alias("r"))


def lag1_array(values: Column) -> Column:
    """lag1_correlation() of one series at rest, worked out inside its row."""

    def moments(m: Column) -> Column:
        centre = lambda x: total(x) / m["n"]
        return let(F.struct(centre(m["x"]).alias("a"), centre(m["y"]).alias("b")), lambda c: F.struct(total(F.transform(m["x"], lambda v: (v - c["a"]) * (v - c["a"]))).alias("xx"), total(F.transform(m["y"], lambda v: (v - c["b"]) * (v - c["b"]))).alias("yy"), total(F.zip_with(m["x"], m["y"], lambda v, w: (v - c["a"]) * (w - c["b"]))).alias("xy"), m["n"].alias("n")))

    def r(s: Column) -> Column:
        spread = F.sqrt(s["xx"] / s["n"]) * F.sqrt(s["yy"] / s["n"])
        return F.when(spread > 1e-15, s["xy"] / s["n"] / spread)

    n = F.size(values) - 1
    both = F.struct(F.slice(values, 1, n).alias("x"), F.slice(values, 2, n).alias("y"), n.alias("n"))
    return F.when(n > 1, let(both, lambda m: let(moments(m), r)))


def detrend(df: DataFrame, keys: list[str], value: str = "value", order: str = "epoch") -> DataFrame:
    """df less each series' least-squares line; a series of one epoch becomes 0."""
    x, y = F.col(order).cast("double"), F.col(value)
    fits = df.groupBy(*keys).agg(F.coalesce(F.try_divide(F.covar_pop(x, y), F.var_pop(x)), F.lit(0.0)).alias("_b"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    return df.join(fits, keys).withColumn(value, y - F.col("_my") - F.col("_b") * (x - F.col("_mx"))).drop("_b", "_mx", "_my")


def regress_global(df: DataFrame, scope: list[str], series: list[str], value: str = "value", order: str = "epoch") -> DataFrame:
    """df less its projection on the mean over series at each epoch; unchanged where that mean is 0 throughout."""
    mean = df.groupBy(*scope, order).agg(F.avg(value).alias("_g"))
    rows = df.join(mean, [*scope, order])
    beta = rows.groupBy(*scope, *series).agg(F.coalesce(F.try_divide(F.sum(F.col("_g") * F.col(value)), F.sum(F.col("_g") * F.col("_g"))), F.lit(0.0)).alias("_b"))
    return rows.join(beta, [*scope, *series]).withColumn(value, F.col(value) - F.col("_b") * F.col("_g")).drop("_g", "_b")


def peak_epoch(df: DataFrame, keys: list[str], value: str = "value", order: str = "epoch") -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(order, F.struct(F.col(value), -F.col(order))).alias("peak_epoch"))


def effective_n(rho: Column, subjects: Column, repeats: Column) -> Column:
    """Subjects x repeats over the design effect 1 + (repeats - 1) rho."""
    return subjects * repeats / (1 + (repeats - 1) * rho)
