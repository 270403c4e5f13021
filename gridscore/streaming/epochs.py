"""Tumbling epochs over a stream of samples: an extension, since the operators themselves are batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_epochs(samples: DataFrame, seconds: int = 2, late: str = "10 seconds") -> DataFrame:
    """recording_id, channel_id, epoch start, n, mean and power per window; samples later than `late` are dropped."""
    keyed = samples.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "recording_id", "channel_id")
    found = keyed.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg(F.col("value") * F.col("value")).alias("power"))
    return found.select("recording_id", "channel_id", F.col("w.start").alias("epoch_start"), "n", "mean", "power")
