"""Signatures of voxels over channels, and other theta, range and radius joins against small geometry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscore.functions.columns import let, total
from gridscore.functions.geometry import adaptive_sigma
from gridscore.operators.score import pair_up
from gridscore.session import dealt


def _distance(p: Column, q: Column) -> Column:
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]) + (p["z"] - q["z"]) * (p["z"] - q["z"]))


def _with_channels(voxels: DataFrame, channels: DataFrame) -> DataFrame:
    """voxels with `c`: all channels (idx, side, x, y, z) and their distances, in idx order. A montage has tens of rows."""
    gathered = channels.agg(F.array_sort(F.collect_list(F.struct("idx", "side", "x", "y", "z"))).alias("_channels"))
    here = F.struct("x", "y", "z")
    entries = F.transform("_channels", lambda c: F.struct(c["idx"].alias("idx"), c["side"].alias("side"), _distance(here, c).alias("d")))
    return voxels.crossJoin(F.broadcast(gathered)).withColumn("c", entries).drop("_channels")


def _normalised(w: Column, fallback: Column) -> Column:
    return let(w, lambda v: let(total(v), lambda t: F.when(t > 1e-12, F.transform(v, lambda e: e / t)).otherwise(fallback)))


def signatures(voxels: DataFrame, channels: DataFrame, band: str | None = None, cut: float = 200.0, least: int = 8, same: float = 0.85, cross: float = 0.25, middle: float = 0.80, gap: float = 3.0) -> DataFrame:
    """voxels with `w`: Gaussian weights over the channels, in idx order, that sum to 1.

    Weights fall with distance by the voxel's zone and end at `cut`; where fewer than `least` exceed 0.01 the nearest
    `least` channels (by idx where equally near) get 0.05 at least; channels across the midline weigh `cross`, on the voxel's side `same`, and for
    midline voxels both sides `middle`. Where nothing is left the nearest channel takes all.
    """
    side = F.when(F.col("x") < -gap, "L").when(F.col("x") > gap, "R").otherwise("M")
    decay = adaptive_sigma(F.col("y"), band)
    voxel = F.struct(F.col("c").alias("c"), side.alias("side"), (2 * decay * decay).alias("s"))

    def raw(m: Column) -> Column:
        return F.transform(m["c"], lambda c: F.when(c["d"] > cut, 0.0).otherwise(F.exp(-c["d"] * c["d"] / m["s"])))

    def floored(m: Column, r: Column) -> Column:
        place = lambda c: F.struct(c["d"].alias("d"), c["idx"].alias("idx"))
        last = F.element_at(F.array_sort(F.transform(m["c"], place)), F.least(F.lit(least), F.size(m["c"])))
        few = F.size(F.filter(r, lambda v: v > 0.01)) < least
        # where enough exceed 0.01 there is no last one to raise
        return let(F.when(few, last), lambda e: F.zip_with(r, m["c"], lambda v, c: F.when(place(c) <= e, F.greatest(v, F.lit(0.05))).otherwise(v)))

    def sided(m: Column, w: Column) -> Column:
        return F.zip_with(w, m["c"], lambda v, c: v * F.when(c["side"] == "M", 1.0).when(m["side"] == "M", middle).when(c["side"] == m["side"], same).otherwise(cross))

    def nearest(m: Column) -> Column:
        first = F.array_min(F.transform(m["c"], lambda c: F.struct(c["d"], c["idx"])))
        return let(first["idx"], lambda k: F.transform(m["c"], lambda c: F.when(c["idx"] == k, 1.0).otherwise(0.0)))

    w = let(voxel, lambda m: let(raw(m), lambda r: let(floored(m, r), lambda v: _normalised(sided(m, v), nearest(m)))))
    return _with_channels(voxels, channels).withColumn("w", w).drop("c")


def ranged_signatures(voxels: DataFrame, channels: DataFrame, sigma: float = 35.0, low: float = 10.0, high: float = 150.0, k: int = 3) -> DataFrame:
    """voxels with `w` over the channels within low..high of the voxel, or over the k nearest where none is."""
    rows = _with_channels(voxels, channels)

    def weighed(c: Column) -> Column:
        kth = F.element_at(F.array_sort(F.transform(c, lambda e: e["d"])), F.least(F.lit(k), F.size(c)))
        some = F.exists(c, lambda e: e["d"].between(low, high))
        # between low and high where some is, else up to the k-th nearest
        ends = F.struct(F.when(some, F.lit(low)).otherwise(0.0).alias("lo"), F.when(some, F.lit(high)).otherwise(kth).alias("hi"))
        return let(ends, lambda m: F.transform(c, lambda e: F.when(e["d"].between(m["lo"], m["hi"]), F.exp(-e["d"] * e["d"] / (2 * sigma**2))).otherwise(0.0)))

    w = let(F.col("c"), lambda c: _normalised(weighed(c), F.transform(c, lambda e: F.lit(0.0))))
    return rows.withColumn("w", w).drop("c")


def neighbour_weights(channels: DataFrame, sigma: float = 30.0, taper: float = 60.0, end: float = 100.0) -> DataFrame:
    """a, b and w: each channel's decayed weights over the others, tapered to nothing, summing to 1 for each a."""
    a, b = channels.select(F.col("idx").alias("a"), "x", "y", "z").alias("p"), channels.select(F.col("idx").alias("b"), "x", "y", "z").alias("q")
    d = F.sqrt(F.expr("(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)"))
    pairs = a.join(F.broadcast(b), F.col("a") != F.col("b")).select("a", "b", d.alias("d")).where(F.col("d") <= end)
    decay = F.exp(-F.col("d") * F.col("d") / (2 * sigma**2)) * F.when(F.col("d") > taper, F.exp(-F.pow((F.col("d") - taper) / 20.0, F.lit(2.0)))).otherwise(1.0)
    weighed = pairs.withColumn("w", decay)
    total = F.sum("w").over(Window.partitionBy("a"))
    return weighed.withColumn("w", F.when(total >= 1e-6, F.col("w") / total).otherwise(0.0)).drop("d")


def subtract_neighbours(samples: DataFrame, weights: DataFrame, keys: list[str], channel: str = "channel", value: str = "value") -> DataFrame:
    """samples with `value` less the weighted sum of its neighbours' at the same keys."""
    spread = samples.select(*keys, F.col(channel).alias("b"), F.col(value).alias("_v")).join(F.broadcast(weights), "b")
    around = spread.groupBy(*keys, F.col("a").alias(channel)).agg(F.sum(F.col("w") * F.col("_v")).alias("_around"))
    return samples.join(around, [*keys, channel], "left").withColumn(value, F.col(value) - F.coalesce("_around", F.lit(0.0))).drop("_around")


def label_voxels(voxels: DataFrame, atlas: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """voxels with their region by cell; with a mask, only the cells in it."""
    kept = voxels.join(mask.select("i", "j", "k"), ["i", "j", "k"], "left_semi") if mask is not None else voxels
    return kept.join(atlas, ["i", "j", "k"])


def overlay_atlases(voxels: DataFrame, lower: DataFrame, upper: DataFrame) -> DataFrame:
    """voxels with the upper atlas's region where it has one, else the lower's; unlabelled cells go."""
    both = voxels.join(lower.withColumnRenamed("roi_id", "_low"), ["i", "j", "k"], "left").join(upper.withColumnRenamed("roi_id", "_up"), ["i", "j", "k"], "left")
    return both.withColumn("roi_id", F.coalesce(F.when(F.col("_up") > 0, F.col("_up")), "_low")).where("roi_id > 0").drop("_low", "_up")


def offsets_within(radius: float) -> Column:
    """All lattice steps (di, dj, dk) of length up to radius, as an array to explode."""
    r = int(radius)
    steps = [(a, b, c) for a in range(-r, r + 1) for b in range(-r, r + 1) for c in range(-r, r + 1) if a * a + b * b + c * c <= radius * radius]
    return F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(c).alias("dk")) for a, b, c in steps])


def radius_count(cells: DataFrame, radius: float = 2.5) -> DataFrame:
    """i, j, k and n_near of each cell: how many of the rows lie within radius steps of it, its own included.

    Rows of one cell are counted first; then a cell sends one row to each step within reach and keeps those that meet a
    cell: an equi-join, never all pairs, that doesn't grow with the rows a cell.
    """
    held = cells.groupBy("i", "j", "k").agg(F.count("*").alias("_rows"))
    sent = held.withColumn("o", F.explode(offsets_within(radius)))
    reached = sent.select((F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), (F.col("k") + F.col("o.dk")).alias("k"), "_rows")
    counts = reached.groupBy("i", "j", "k").agg(F.sum("_rows").alias("n_near"))
    return held.drop("_rows").join(counts.hint("merge"), ["i", "j", "k"])


def neighbours_within(points: DataFrame, radius: float, key: str = "voxel_id") -> DataFrame:
    """a, b and d of all points within radius of each other: bucketed by cells of that size, 27 cells looked into.

    Distances are worked out once a pair of places, however many points share a place; the points are then joined to
    both ends. What is exploded is merged, never broadcast: Spark takes it for as small as what it is exploded from.
    """
    place = ["x", "y", "z"]
    home = [F.floor(F.col(c) / radius).alias(f"_{c}") for c in place]
    places = points.where("x is not null and y is not null and z is not null").select(*place).distinct().select(F.struct(*place).alias("p"), *home)
    visits = places.withColumnRenamed("p", "q").withColumn("o", F.explode(offsets_within(1.75)))
    visits = visits.select("q", *[(F.col(f"_{c}") + F.col(f"o.{d}")).alias(f"_{c}") for c, d in zip(place, ("di", "dj", "dk"), strict=True)])
    near = places.join(visits.hint("merge"), ["_x", "_y", "_z"]).withColumn("d", _distance(F.col("p"), F.col("q"))).where(F.col("d") <= radius)
    ends = near.select(*[F.col(f"{e}.{c}").alias(f"_{e}{c}") for e in "pq" for c in place], "d")

    def met(pairs: DataFrame, end: str, name: str) -> DataFrame:
        own = points.select(F.col(key).alias(name), *[F.col(c).alias(f"_{end}{c}") for c in place])
        return pairs.hint("merge").join(own, [f"_{end}{c}" for c in place])

    return met(met(ends, "p", "a"), "q", "b").select("a", "b", "d")


def project_surface(vertices: DataFrame, channels: DataFrame, envelopes: DataFrame, sigma: float = 30.0) -> DataFrame:
    """vertex_id, epoch and value: channel envelopes (idx, epoch, value) spread by normalised Gaussian weights.

    An epoch's values become one array in the channels' order, and a vertex meets an epoch once: no row a vertex, epoch and
    channel, and no aggregate over them. A channel without a value at an epoch counts for nothing there. Vertices are dealt
    first, since a table of few files makes few tasks.
    """
    rows = _with_channels(dealt(vertices, vertices.count(), "vertex_id"), channels)
    w = F.transform("c", lambda c: F.exp(-c["d"] * c["d"] / (2 * sigma**2)))
    weighed = rows.select("vertex_id", let(w, lambda v: _normalised(v, v)).alias("_w"))
    order = channels.agg(F.array_sort(F.collect_list("idx")).alias("_order"))
    own = envelopes.join(F.broadcast(channels.select("idx")), "idx", "left_semi").groupBy("epoch", "idx").agg(F.sum("value").alias("value"))
    epochs = own.groupBy("epoch").agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("_known")).crossJoin(F.broadcast(order))
    epochs = epochs.select("epoch", F.transform("_order", lambda k: F.try_element_at("_known", k)).alias("_v"))
    parts = F.filter(F.zip_with("_w", "_v", lambda a, b: a * b), lambda v: v.isNotNull())
    value = let(parts, lambda v: F.when(F.size(v) > 0, total(v)))
    return pair_up(weighed, epochs).select("vertex_id", "epoch", value.alias("value"))


def fill_ribbon(ribbons: DataFrame, values: DataFrame, origin: tuple[float, float, float], step: tuple[float, float, float], shape: tuple[int, int, int], points: int = 10, decay: float = 1.5) -> DataFrame:
    """i, j, k, epoch and value: each vertex's value carried to the cells around `points` places from its outer to its
    inner point, less with distance; the largest value of a cell stays. Values aren't negative.

    ribbons: vertex_id, outer and inner (x, y, z structs); values: vertex_id, epoch, value.
    """
    rows = ribbons.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("_t", F.col("_n") / float(max(1, points - 1)))
    cells = [F.rint((F.col(f"outer.{c}") * (1 - F.col("_t")) + F.col(f"inner.{c}") * F.col("_t") - o) / s).cast("int").alias(f"_{n}") for c, n, o, s in zip("xyz", "ijk", origin, step, strict=True)]
    inside = " and ".join(f"_{n} between 0 and {size - 1}" for n, size in zip("ijk", shape, strict=True))
    spread = rows.select("vertex_id", *cells).where(inside).distinct().withColumn("o", F.explode(offsets_within(1.75)))
    weight = F.exp(-F.sqrt(F.col("o.di") * F.col("o.di") + F.col("o.dj") * F.col("o.dj") + F.col("o.dk") * F.col("o.dk")) / decay)
    moved = spread.select("vertex_id", *[(F.col(f"_{n}") + F.col(f"o.d{n}")).alias(n) for n in "ijk"], weight.alias("w"))
    kept = moved.where(" and ".join(f"{n} between 0 and {size - 1}" for n, size in zip("ijk", shape, strict=True))).groupBy("vertex_id", "i", "j", "k").agg(F.max("w").alias("w"))
    return kept.join(values, "vertex_id").groupBy("i", "j", "k", "epoch").agg(F.max(F.col("w") * F.col("value")).alias("value"))
