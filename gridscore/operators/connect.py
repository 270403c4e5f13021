"""Connectivity of regions: correlation, Fisher z, shrunk partial correlation and group means."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscore.operators.metrics import correlation
from gridscore.operators.order import with_rank


def region_pairs(series: DataFrame, keys: list[str], region: str = "roi_id", value: str = "value") -> DataFrame:
    """keys, epoch, roi_a < roi_b and both values: an equi-join at each epoch over its regions (tens of them)."""
    a = series.select(*keys, "epoch", F.col(region).alias("roi_a"), F.col(value).alias("x"))
    b = series.select(*keys, "epoch", F.col(region).alias("roi_b"), F.col(value).alias("y"))
    return a.join(b, [*keys, "epoch"]).where("roi_a < roi_b")


def correlations(series: DataFrame, keys: list[str], region: str = "roi_id", value: str = "value") -> DataFrame:
    """keys, roi_a, roi_b and r; null where a series is constant."""
    return correlation(region_pairs(series, keys, region, value), [*keys, "roi_a", "roi_b"], "x", "y")


def fisher_z(r: Column) -> Column:
    return F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r)))


def group_mean(matrices: DataFrame, keys: list[str], r: str = "r") -> DataFrame:
    return matrices.groupBy(*keys, "roi_a", "roi_b").agg(F.avg(r).alias(r))


def shrunk_partial(series: DataFrame, keys: list[str], region: str = "roi_id", value: str = "value") -> DataFrame:
    """keys, roi_a, roi_b (all pairs, the diagonal 1) and partial: correlation given all other regions.

    The covariance is shrunk towards its mean variance by the Ledoit-Wolf weight. Moments are sums over epochs; what
    meets in one task is a matrix of regions (48 x 48 or so), not a series.
    """
    centred = series.join(series.groupBy(*keys, region).agg(F.avg(value).alias("_m")), [*keys, region]).withColumn("_c", F.col(value) - F.col("_m"))
    a = centred.select(*keys, "epoch", F.col(region).alias("roi_a"), F.col("_c").alias("x"))
    b = centred.select(*keys, "epoch", F.col(region).alias("roi_b"), F.col("_c").alias("y"))
    both = a.join(b, [*keys, "epoch"]).withColumn("xy", F.col("x") * F.col("y"))
    moments = both.groupBy(*keys, "roi_a", "roi_b").agg(F.avg("xy").alias("cov"), F.avg(F.col("xy") * F.col("xy")).alias("sq"), F.count("*").alias("n"))
    kinds = dict(moments.dtypes)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(frame["roi_a"].unique())
        shape = lambda c: frame.pivot(index="roi_a", columns="roi_b", values=c).reindex(index=names, columns=names).fillna(0.0).to_numpy()
        cov, sq, n, p = shape("cov"), shape("sq"), float(frame["n"].max()), len(names)
        mu = np.trace(cov) / p
        gap = ((cov - mu * np.eye(p)) ** 2).sum() / p
        noise = min(((sq - cov**2).sum() / p) / n, gap)
        weight = noise / gap if gap > 0 else 0.0
        precision = np.linalg.pinv((1 - weight) * cov + weight * mu * np.eye(p))
        scale = np.sqrt(np.maximum(np.diag(precision), 1e-300))
        partial = -precision / np.outer(scale, scale)
        np.fill_diagonal(partial, 1.0)
        out = pd.DataFrame({k: frame[k].iloc[0] for k in keys}, index=range(p * p))
        out["roi_a"], out["roi_b"], out["partial"] = np.repeat(names, p), np.tile(names, p), partial.ravel()
        return out

    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "roi_a", "roi_b"]) + ", partial double"
    return moments.groupBy(*keys).applyInPandas(solve, schema)


def partial_given(df: DataFrame, keys: list[str], a: str, b: str, given: str) -> DataFrame:
    """keys and r of a and b with a third variable held: the closed form of three correlations."""
    ab, ag, bg = (correlation(df, keys, p, q, n) for p, q, n in ((a, b, "_ab"), (a, given, "_ag"), (b, given, "_bg")))
    joined = ab.join(ag, keys).join(bg, keys) if keys else ab.crossJoin(ag).crossJoin(bg)
    r = (F.col("_ab") - F.col("_ag") * F.col("_bg")) / F.sqrt(F.nullif((1 - F.col("_ag") * F.col("_ag")) * (1 - F.col("_bg") * F.col("_bg")), F.lit(0.0)))
    return joined.select(*keys, r.alias("r"))


def rank_correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys and Spearman's r: Pearson's of average ranks."""
    return correlation(with_rank(with_rank(df, keys, a, "_ra"), keys, b, "_rb"), keys, "_ra", "_rb")


def difference(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, r and rmse between two columns."""
    rmse = df.groupBy(*keys).agg(F.sqrt(F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))).alias("rmse"))
    return correlation(df, keys, a, b).join(rmse, keys) if keys else correlation(df, keys, a, b).crossJoin(rmse)
