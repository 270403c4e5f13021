"""Scalar functions of coordinates and names: boxes, lattices, zones, priors and attenuation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore.model import DEPTH_LAYERS, HEAD_BOX, NOT_GREY, PRIORS, SIGMA_BASE, SIGMA_SCALE, SIGMA_ZONES, ZONES, Box, Prior


def in_box(box: Box, x: Column | None = None, y: Column | None = None, z: Column | None = None) -> Column:
    """Whether a point lies in a box, edges included; open sides don't restrict."""
    x, y, z = (F.col(n) if c is None else c for n, c in zip("xyz", (x, y, z), strict=True))
    limits = [(y, box.y_min, box.y_max), (z, box.z_min, box.z_max), (F.abs(x), box.abs_x_min, box.abs_x_max)]
    tests = [c >= lo for c, lo, _ in limits if lo is not None] + [c <= hi for c, _, hi in limits if hi is not None]
    return reduce(Column.__and__, tests, F.lit(True))


def in_region(points: DataFrame, regions: DataFrame, by: str = "band") -> DataFrame:
    """points joined with a small table of boxes on `by`, with `inside`; null limits are open."""
    p, r = points.alias("p"), F.broadcast(regions).alias("r")
    tests = [f"coalesce(p.{c} >= r.{c}_min, true) and coalesce(p.{c} <= r.{c}_max, true)" for c in ("y", "z")]
    tests.append("coalesce(abs(p.x) >= r.abs_x_min, true) and coalesce(abs(p.x) <= r.abs_x_max, true)")
    return p.join(r, by).withColumn("inside", F.expr(" and ".join(tests)))


def to_index(c: Column, origin: float, step: float, size: int, truncate: bool = False) -> Column:
    """Lattice index of a coordinate, or null beyond the lattice; rounds half up, or truncates for parity."""
    at = (c - origin) / step
    index = (F.when(at < 0, F.ceil(at)).otherwise(F.floor(at)) if truncate else F.floor(at + 0.5)).cast("int")
    return F.when(index.between(0, size - 1), index)


def to_coordinate(index: Column, origin: float, step: float) -> Column:
    return F.lit(float(origin)) + F.lit(float(step)) * index


def lattice(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """All cells (i, j, k) of a lattice, made where they are used."""
    cells = spark.range(nx * ny * nz)
    return cells.select((F.col("id") % nx).cast("int").alias("i"), (F.expr(f"id div {nx}") % ny).cast("int").alias("j"), F.expr(f"id div {nx * ny}").cast("int").alias("k"))


def channel_side(name: Column, x: Column, gap: float = 3.0) -> Column:
    """L or R by the parity of the name's last digits, M for a name with z, else by the sign of x beyond a gap."""
    digits = F.regexp_extract(name, r"(\d+)$", 1)
    by_x = F.when(x < -gap, "L").when(x > gap, "R").otherwise("M")
    return F.when((digits != "") & (F.substring(digits, -1, 1).cast("int") % 2 == 1), "L").when(digits != "", "R").when(F.lower(name).contains("z"), "M").otherwise(by_x)


def channel_side_by_digit(name: Column, x: Column, gap: float = 3.0) -> Column:
    """The older rule: any odd digit in the name is L, else any even one or ten is R."""
    return F.when(name.rlike("[13579]"), "L").when(name.rlike("[2468]|10"), "R").when(F.lower(name).contains("z") | (F.abs(x) <= gap), "M").when(x < -gap, "L").otherwise("R")


def voxel_side(x: Column, gap: float = 3.0) -> Column:
    return F.when(F.abs(x) <= gap, "MID").when(x < -gap, "LH").otherwise("RH")


def adaptive_sigma(y: Column, band: str | None = None, base: float = SIGMA_BASE) -> Column:
    """Width of a voxel's weights by its zone along y and its band."""
    *edged, (_, last) = SIGMA_ZONES
    zone = reduce(lambda c, e: c.when(y < e[0], e[1]), edged, F.when(F.lit(False), 0.0)).otherwise(last)
    return zone * F.lit(base * SIGMA_SCALE.get(band or "", 1.0))


def zone(y: Column) -> Column:
    """One of six zones along y; upper edges belong to the zone."""
    *edged, (last, _) = ZONES
    return reduce(lambda c, e: c.when(y <= e[1], e[0]), edged, F.when(F.lit(False), "")).otherwise(last)


def _bell(c: Column, centre: float, width: float) -> Column:
    return F.exp(-F.pow(c - centre, F.lit(2.0)) / (2 * width**2))


def penalty_bell(prior: Prior, y: Column) -> Column:
    """How much of a prior's penalty meets a place: 1 at its centre, 0 throughout where the prior has none."""
    return _bell(y, *prior.penalty) if prior.penalty else F.lit(0.0)


def raw_prior(prior: Prior, penalty: Column | float, x: Column, y: Column, z: Column) -> Column:
    """A band's prior before it is scaled: its peaks, damped around the centre that it penalises."""
    peaks = []
    for p in prior.peaks:
        terms = [_bell(c, *axis) for c, axis in ((y, p.y), (z, p.z), (F.abs(x), p.abs_x)) if axis]
        peaks.append(F.lit(p.weight) * reduce(Column.__mul__, terms))
    weight = reduce(Column.__add__, peaks)
    penalty = F.lit(penalty) if isinstance(penalty, (int, float)) else penalty
    return weight * F.when(penalty > 0, 1 - penalty * penalty_bell(prior, y)).otherwise(1.0) if prior.penalty else weight


def scaled_prior(raw: Column, most: Column, least: float | Column, boost: Column, softening: Column) -> Column:
    """Scale to least..boost by the largest raw weight, then blend with 1."""
    least = F.lit(least) if isinstance(least, float) else least
    weight = F.when(most > 1e-12, least + (boost - least) * raw / most).otherwise(least)
    return F.when(softening > 0, (1 - softening) * weight + softening).otherwise(weight)


def prior_weights(voxels: DataFrame, band: str, boost: float = 1.5, penalty: float = 0.0, softening: float = 1.0) -> DataFrame:
    """voxels with `weight`: the band's spatial prior, scaled by its largest value over these voxels (one row, broadcast).

    A band without a prior weighs 1 everywhere; an empty table stays empty.
    """
    if band not in PRIORS:
        return voxels.withColumn("weight", F.lit(1.0))
    raw = voxels.withColumn("_raw", raw_prior(PRIORS[band], penalty, F.col("x"), F.col("y"), F.col("z")))
    most = raw.agg(F.max("_raw").alias("_most"))
    weight = scaled_prior(F.col("_raw"), F.col("_most"), PRIORS[band].least, F.lit(float(boost)), F.lit(float(softening)))
    return raw.crossJoin(F.broadcast(most)).withColumn("weight", weight).drop("_raw", "_most")


def depth_attenuation(x: Column, y: Column, z: Column) -> Column:
    """Factor that damps low, far-front, far-back and central points."""
    layers = reduce(lambda c, e: c.when(z < e[0], e[1]), DEPTH_LAYERS, F.when(F.lit(False), 0.0)).otherwise(1.0)
    radius = F.sqrt(x * x + y * y + z * z)
    return layers * F.when(F.abs(y) > 70, 0.8).otherwise(1.0) * F.when(radius < 50, 0.1).otherwise(1.0)


def in_head(x: Column, y: Column, z: Column) -> Column:
    return reduce(Column.__and__, [c.between(*HEAD_BOX[n]) for n, c in (("x", x), ("y", y), ("z", z))])


def is_grey(name: Column) -> Column:
    """Whether a region's name holds none of the words for other tissue."""
    return ~F.lower(name).rlike("|".join(NOT_GREY))


def first_part(name: Column) -> Column:
    """The recording in a file name: what stands before the first underscore."""
    return F.split_part(name, F.lit("_"), F.lit(1))


def version_tag(name: Column) -> Column:
    return F.regexp_extract(name, r"_v(.*)\.csv", 1)


def parameter_hash(*columns: str) -> Column:
    """Digest of parameter values, whatever the order in which they are named."""
    return F.md5(F.to_json(F.struct(*sorted(columns))))


def series_signature(values: Column, n: int = 1000) -> Column:
    """Digest of a series' first n values, for content-addressed reuse."""
    return F.sha1(F.to_json(F.slice(values, 1, n)))


def significance(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def effect_size(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def risk(share: Column, high: float = 50.0, medium: float = 25.0) -> Column:
    return F.when(share > high, "HIGH").when(share > medium, "MEDIUM").otherwise("LOW")
