"""Sources and sinks: recordings, coordinate files, keyed score tables, parameters, checkpoints and reports."""

from __future__ import annotations

from dataclasses import fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridscore.model import METRIC, PARAMS, SCORE, Params


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    from gridscore.model import SAMPLE

    return spark.read.schema(SAMPLE).parquet(path)


def pack(samples: DataFrame, keys: list[str], index: str = "sample_idx", value: str = "value") -> DataFrame:
    """keys and values in index order: the form at rest, a row a series."""
    ordered = F.array_sort(F.collect_list(F.struct(index, value)))
    return samples.groupBy(*keys).agg(F.transform(ordered, lambda s: s[value]).alias("values"))


def unpack(series: DataFrame, keys: list[str], index: str = "sample_idx", value: str = "value") -> DataFrame:
    return series.select(*keys, F.posexplode("values").alias(index, value))


def channel_table(channels: DataFrame, overrides: DataFrame) -> DataFrame:
    """channels with coordinates: those of `overrides` by name, else the rescaled ones."""
    o = F.broadcast(overrides.select("name", *[F.col(c).alias(f"_{c}") for c in "xyz"]))
    own = {"x": F.col("x") * 0.88, "y": F.col("y") * 0.88 * 1.12 - 5, "z": F.col("z") * 0.88 + 48}
    joined = channels.join(o, "name", "left").withColumns({f"_{c}": F.coalesce(f"_{c}", e) for c, e in own.items()})
    return joined.drop("x", "y", "z").withColumnsRenamed({f"_{c}": c for c in "xyz"})


def read_coordinates(spark: SparkSession, path: str, lift: float = 20.0) -> DataFrame:
    """name, x, y, z of lines with four fields parted by white space; z is lifted; other lines are skipped."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") == 4)
    numbers = parts.select(F.col("p")[0].alias("name"), *[F.expr(f"try_cast(p[{k}] as double)").alias(c) for k, c in enumerate("xyz", 1)])
    return numbers.dropna().withColumn("z", F.col("z") + lift)


def write_scores(scores: DataFrame, path: str) -> None:
    """Write scores by band and recording; partitions that are written again replace their old selves only."""
    scores.write.option("partitionOverwriteMode", "dynamic").partitionBy("band", "recording_id").mode("overwrite").parquet(path)


def read_scores(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Scores from several folders; of a band and recording, the first folder that has it counts."""
    parts = [spark.read.schema(SCORE).parquet(p).withColumn("_rank", F.lit(k)) for k, p in enumerate(paths)]
    every = reduce(DataFrame.unionByName, parts)
    first = every.groupBy("band", "recording_id").agg(F.min("_rank").alias("_rank"))
    return every.join(first, ["band", "recording_id", "_rank"], "left_semi").drop("_rank")


def complete(scores: DataFrame, id_: str, part: str, n_parts: int) -> DataFrame:
    """Rows of ids that have all n_parts parts."""
    whole = scores.groupBy(id_).agg(F.countDistinct(part).alias("_n")).where(F.col("_n") == n_parts).drop("_n")
    return scores.join(whole, id_, "left_semi")


def missing_cells(ids: DataFrame, parts: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """The grid of ids and parts (a small table) less what is present."""
    return ids.crossJoin(F.broadcast(parts)).join(present, on, "left_anti")


def stack(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def pending(todo: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """What is left to do: rows of todo whose keys aren't done."""
    return todo.join(done, on, "left_anti")


def long_metrics(df: DataFrame, keys: list[str], names: list[str], digits: int = 6) -> DataFrame:
    """keys, metric and value, one row a metric."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.round(F.col(n).cast("double"), digits).alias("value")) for n in sorted(names)])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.orderBy("metric").write.mode("overwrite").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str, keys: list[str] = ["recording_id", "band"]) -> DataFrame:  # noqa: B006
    """Metrics pivoted, with pa_ratio: the direct one, else posterior over anterior percent."""
    names = ["pa_ratio", "posterior_pct", "anterior_pct"]
    wide = spark.read.schema(METRIC).option("header", True).csv(path).groupBy(*keys).pivot("metric", names).agg(F.first("value"))
    return wide.withColumn("pa_ratio", F.coalesce("pa_ratio", F.try_divide("posterior_pct", "anterior_pct")))


def coverage_report(coverage: DataFrame, names: DataFrame, path: str) -> None:
    coverage.join(F.broadcast(names), "roi_id", "left").orderBy("roi_id").write.mode("overwrite").option("header", True).csv(path)


def with_defaults(defaults: DataFrame, params: DataFrame, on: str = "band") -> DataFrame:
    """The defaults' rows, each value replaced where params has one."""
    p = F.broadcast(params).alias("p")
    rest = [c for c in defaults.columns if c != on]
    return defaults.alias("d").join(p, on, "left").select(on, *[F.coalesce(f"p.{c}", f"d.{c}").alias(c) if c in params.columns else F.col(f"d.{c}") for c in rest])


def write_params(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").json(path)


def read_params(spark: SparkSession, path: str, defaults: DataFrame) -> DataFrame:
    return with_defaults(defaults, spark.read.schema(PARAMS).json(path))


def convert_legacy(old: DataFrame, defaults: DataFrame) -> DataFrame:
    """Full parameter rows from band and body: a bare number is the weight, an object holds any of the parameters."""
    names = [f.name for f in fields(Params)]
    m = F.from_json("body", "map<string,double>")
    given = old.select("band", F.when(F.expr("try_cast(body as double)").isNull(), m).alias("m"), F.expr("try_cast(body as double)").alias("w"))
    values = {n: F.coalesce(F.col("m")[n], F.col("w")) if n == "mi_weight" else F.col("m")[n] for n in names}
    return with_defaults(defaults, given.select("band", *[c.alias(n) for n, c in values.items()]))


def first_by_priority(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row a key from several tables, the first table's before the others'."""
    every = stack([t.withColumn("_p", F.lit(k)) for k, t in enumerate(tables)])
    return every.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_p"))).where("_r = 1").drop("_p", "_r")
