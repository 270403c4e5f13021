"""Parameter search with leave-one-out and k-fold scoring from sufficient statistics of one aggregate a round.

The hybrid is rescaled by its smallest and largest value over a fold's training recordings. That is affine, so the sums,
minima and maxima of the unscaled values per (candidate, recording) give every fold's metric by arithmetic: a left-out
sum is the total less its own part, a left-out extreme is the best or the second best.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridscore.functions.batches import grouped
from gridscore.functions.geometry import in_box, penalty_bell, raw_prior, scaled_prior
from gridscore.model import BAND_BOUNDS, BOUNDS, CONFIDENCE, DEFAULTS, GLOBAL_BOUNDS, PRIORS, SPACING, TARGETS, WEIGHT_CAPS, Box, Target
from gridscore.operators.metrics import EPS, penalty_of, posterior_anterior, target_score
from gridscore.operators.resample import uniform
from gridscore.operators.score import hybrid
from gridscore.session import dealt, stored


def latin_hypercube(spark: SparkSession, bounds: dict[str, tuple[float, float]], n: int, seed: int, whole: tuple[str, ...] = ("temporal_window",)) -> DataFrame:
    """cand and one column per parameter: n points, one in each of n strata of every parameter."""
    rows = spark.range(n).select(F.col("id").cast("int").alias("cand"))
    for name, (lo, hi) in bounds.items():
        draw = F.xxhash64("cand", F.lit(name), F.lit(seed))
        stratum = F.row_number().over(Window.orderBy(draw, "cand")) - 1  # n is a few dozen
        value = lo + (stratum + uniform("cand", F.lit(name), F.lit(seed + 1))) / n * (hi - lo)
        rows = rows.withColumn(name, F.round(value).cast("double") if name in whole else value)
    return rows


def refine(best: DataFrame, bounds: dict[str, tuple[float, float]], n: int, round_: int, seed: int) -> DataFrame:
    """n candidates around each best row, uniform in a box 0.4^round as wide as the bounds, clipped to them."""
    rows = best.withColumn("cand", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for name, (lo, hi) in bounds.items():
        half = (hi - lo) * 0.4**round_ / 2
        low, high = F.greatest(F.lit(float(lo)), F.col(name) - half), F.least(F.lit(float(hi)), F.col(name) + half)
        rows = rows.withColumn(name, low + uniform("cand", F.lit(name), F.lit(seed + round_), *[c for c in best.columns if c not in bounds]) * (high - low))
    return rows


def folds(df: DataFrame, id_: str, k: int, seed: int) -> DataFrame:
    """id and fold 0..k-1 of each distinct id, balanced, by hash order. Ids are recordings."""
    return df.select(id_).distinct().withColumn("fold", (F.row_number().over(Window.orderBy(F.xxhash64(id_, F.lit(seed)), id_)) - 1) % k)


def _regions(target: Target) -> tuple[Column, Column]:
    return in_box(target.region), in_box(target.against) if target.against else F.lit(True)


#: Candidates that a block of rows is met with at once, and rows of a block.
CANDIDATES, ROWS = 64, 4096
SPATIAL, BLEND = ("boost", "penalty", "softening"), ("mi_weight", "contrast")


def _candidate_arrays(candidates: DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """Parameters of each band's candidates as arrays: a few numbers a candidate, of which a round has one set of folds'."""
    frame = candidates.select("band", "cand", *SPATIAL, *BLEND).toPandas().sort_values(["band", "cand"])
    return {band: {c: part[c].to_numpy() for c in ("cand", *SPATIAL, *BLEND)} for band, part in frame.groupby("band")}


def _chosen(bands: list[str], f: Callable[[str], Column]) -> Column:
    """f of the row's band."""
    return reduce(lambda c, b: c.when(F.col("band") == b, f(b)), bands, F.when(F.lit(False), f(bands[0])))


def _zone_bits(bands: list[str], targets: dict[str, Target]) -> Column:
    """The row's zones under its band's target as bits."""
    y = F.col("y")
    region, against = (_chosen(bands, lambda b, i=i: _regions(targets[b])[i]) for i in range(2))
    zones = {"in": region, "against": against, "all": F.lit(True), "front": y > 0, "back": y < -40, "middle": y.between(-45, 15)}
    return reduce(Column.__add__, [F.when(zones[name], 1 << i).otherwise(0) for i, name in enumerate(ZONES)]).cast("int")


def _fields(rows: DataFrame, bands: list[str]) -> DataFrame:
    """rows with what a candidate needs of a voxel: its band's prior without the penalty, the penalty's bell, and its zones as
    bits."""
    x, y, z = (F.col(c) for c in "xyz")
    whole = _chosen(bands, lambda b: raw_prior(PRIORS[b], 0.0, x, y, z))
    bell = _chosen(bands, lambda b: penalty_bell(PRIORS[b], y))
    return rows.withColumns({"_prior": whole, "_bell": bell, "_zones": _zone_bits(bands, TARGETS)})


def _penalised(prior: np.ndarray, bell: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return prior[:, None] * (1 - np.maximum(penalty, 0.0) * bell[:, None])


def _vectors(rows: DataFrame, run: Callable, columns: list[str], keys: list[str]) -> DataFrame:
    """keys and, for each of columns, the sum (s_), least (lo_) or largest (hi_) of the vectors that tasks send."""
    kinds = ", ".join(f"{k} {kind}" for k, kind in rows.select(*keys).dtypes)
    each = rows.mapInArrow(run, f"{kinds}, {', '.join(f'{c} array<double>' for c in columns)}")
    how = {"s": Summarizer.sum, "l": Summarizer.min, "h": Summarizer.max}
    return each.groupBy(*keys).agg(*[vector_to_array(how[c[0]](array_to_vector(F.col(c)))).alias(c) for c in columns])


def gathered(scores: DataFrame, bands: list[str]) -> DataFrame:
    """band, recording_id, what candidates need of a place, mi, dice, and how many voxels are alike in all of these (_weight).

    Voxels whose places have the same prior and zones (a lattice repeats them, and many priors leave axes out) and whose
    scores agree come to the same for every candidate, so that they are worked out once, however many rounds follow.
    scores are stored. A recording's rows lie together in a task, so that a batch holds few recordings.
    """
    rows = _fields(scores.where(F.col("band").isin(bands)), bands).withColumns({c: F.col(c).cast("double") for c in ("mi", "dice")})
    kinds = ["band", "recording_id", "_prior", "_bell", "_zones", "mi", "dice"]
    alike = dealt(rows.select(*kinds), scores.count(), *kinds).groupBy(*kinds).agg(F.count("*").alias("_weight"))
    return stored(alike.sortWithinPartitions("band", "recording_id"), "gathered")


def band_statistics(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """band, cand, recording_id, sums and counts of the region, of what it is held against and of all, and the extremes.

    scores: band, recording_id, voxel_id, x, y, z, mi, dice, means over time already; candidates: band, cand, mi_weight,
    contrast, boost, penalty, softening. Candidates go with the tasks as arrays; a task holds a block of rows against a
    block of candidates, and sends one vector of sums a recording and band, which Spark adds up. No row is copied. The
    priors' scales come from the distinct places first. scores may be gathered() already, as they are for several rounds.
    """
    given = _candidate_arrays(candidates)
    bands = sorted(given)
    least = {b: PRIORS[b].least for b in bands}
    whole = scores if "_weight" in scores.columns else gathered(scores, bands)
    rows = whole.where(F.col("band").isin(bands))
    kind = rows.schema["recording_id"]

    def scales(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = {b: np.full(len(given[b]["cand"]), -np.inf) for b in bands}
        for batch in batches:
            names, prior, bell = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for b in bands:
                own = np.flatnonzero(names == b)
                for k in range(0, len(own), ROWS):
                    part = own[k : k + ROWS]
                    for c in range(0, len(most[b]), CANDIDATES):
                        block = slice(c, c + CANDIDATES)
                        most[b][block] = np.maximum(most[b][block], _penalised(prior[part], bell[part], given[b]["penalty"][block]).max(0))
        yield pa.RecordBatch.from_arrays([pa.array(bands, pa.string()), pa.array([most[b] for b in bands], pa.list_(pa.float64()))], names=["band", "h"])

    scale = {r.band: np.array(r.h) for r in _vectors(rows.select("band", "_prior", "_bell").distinct(), scales, ["h"], ["band"]).collect()}

    def weights(b: str, prior: np.ndarray, bell: np.ndarray, block: slice) -> np.ndarray:
        p, most = {c: given[b][c][block] for c in SPATIAL}, scale[b][block]
        raised = least[b] + (p["boost"] - least[b]) * _penalised(prior, bell, p["penalty"]) / np.where(most > 1e-12, most, 1.0)
        weight = np.where(most > 1e-12, raised, least[b])
        return np.where(p["softening"] > 0, (1 - p["softening"]) * weight + p["softening"], weight)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            prior, bell, mi, dice, times = (batch.column(k).to_numpy() for k in (2, 3, 5, 6, 7))
            inside = (batch.column(4).to_numpy()[:, None] >> np.arange(len(ZONES)) & 1) * times[:, None].astype(np.float64)
            first, code = grouped([batch.column(0), batch.column(1)])
            for at, places in zip(first.tolist(), np.split(np.argsort(code, kind="stable"), np.cumsum(np.bincount(code))[:-1]), strict=True):
                b, recording = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                n = len(given[b]["cand"])
                if (b, recording) not in held:
                    held[b, recording] = [np.zeros((len(ZONES), n)), np.zeros(len(ZONES)), np.full(n, np.inf), np.full(n, -np.inf)]
                total, count, low, high = held[b, recording]
                for k in range(0, len(places), ROWS):
                    part = places[k : k + ROWS]
                    count += inside[part].sum(0)
                    for c in range(0, n, CANDIDATES):
                        block = slice(c, c + CANDIDATES)
                        w, power = given[b]["mi_weight"][block], given[b]["contrast"][block]
                        h = (w * mi[part, None] + (1 - w) * dice[part, None]) * weights(b, prior[part], bell[part], block)
                        h = np.where(power == 1.0, h, np.maximum(h, 1e-12) ** power)
                        total[:, block] += inside[part].T @ h
                        low[block], high[block] = np.minimum(low[block], h.min(0)), np.maximum(high[block], h.max(0))
        for (b, recording), (total, count, low, high) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.string()), pa.array([recording], recordings), *[pa.array([x.ravel()], pa.list_(pa.float64())) for x in (total, count, low, high)]], names=["band", "recording_id", "s", "s_n", "l", "h"])

    recordings = to_arrow_type(kind.dataType)
    found = _vectors(rows.select("band", "recording_id", "_prior", "_bell", "_zones", "mi", "dice", "_weight"), sums, ["s", "s_n", "l", "h"], ["band", "recording_id"])
    numbers = candidates.groupBy("band").agg(F.array_sort(F.collect_list("cand")).alias("_cands"))  # as many as a task holds anyway
    each = found.join(numbers, "band").select("band", "recording_id", "s", "s_n", "l", "h", F.size("_cands").alias("_size"), F.posexplode("_cands").alias("_at", "cand"))
    at = F.col("_at")
    parts = [F.get("s", at + i * F.col("_size")).alias(f"s_{z}") for i, z in enumerate(ZONES)] + [F.get("s_n", F.lit(i)).cast("long").alias(f"n_{z}") for i, z in enumerate(ZONES)]
    return each.select("band", "cand", "recording_id", *parts, F.get("l", at).alias("lo"), F.get("h", at).alias("hi"))


def statistics(scores: DataFrame, candidates: DataFrame, band: str) -> DataFrame:
    """band_statistics() of one band's scores and candidates, without `band`."""
    return band_statistics(scores.withColumn("band", F.lit(band)), candidates.withColumn("band", F.lit(band))).drop("band")


ZONES = ("in", "against", "all", "front", "back", "middle")


def metric_of(band: str, sums: dict[str, Column], counts: dict[str, Column], low: Column, high: Column, target: Target | None = None) -> Column:
    """A band's metric from zone sums and counts of unscaled values and the extremes that scale them."""
    target = target or TARGETS[band]
    flat = high <= low
    s = {z: F.when(flat, sums[z]).otherwise((sums[z] - counts[z] * low) / F.nullif(high - low, F.lit(0.0))) for z in ZONES}
    mean = lambda z: F.try_divide(s[z], counts[z])
    if target.kind in ("ratio", "mean_ratio"):
        a, b = (mean("in"), mean("against")) if target.kind == "mean_ratio" else (s["in"], s["against"])
        raw = F.when((counts["in"] > 0) & (counts["against"] > 0), a / (b + EPS)).otherwise(0.0)
    else:
        share = s["in"] / (s["all"] + EPS)
        raw = F.when(counts["in"] > 0, share if target.kind == "proportion" else share / (1 - share + EPS)).otherwise(0.0)
    return target_score(target, raw) * penalty_of(band, mean("front") / (mean("back") + EPS), 100 * s["middle"] / (s["all"] + EPS))


def _metric(band: str, low: str = "lo", high: str = "hi") -> Column:
    return metric_of(band, {z: F.col(f"s_{z}") for z in ZONES}, {z: F.col(f"n_{z}") for z in ZONES}, F.col(low), F.col(high))


def _metrics(bands: list[str]) -> Column:
    """_metric() of the row's band."""
    return reduce(lambda c, b: c.when(F.col("band") == b, _metric(b)), bands, F.when(F.lit(False), F.lit(0.0)))


def left_out(stats: DataFrame) -> DataFrame:
    """band (where stats have it), cand, test_id and the statistics of all other recordings, by arithmetic from the totals
    and the best two extremes, each of which is an aggregate: no recording's numbers are gathered."""
    keys = ["band", "cand"] if "band" in stats.columns else ["cand"]
    r = F.col("recording_id")
    # no window or list: the recording with the extreme, then the extreme of the rest
    totals = stats.groupBy(*keys).agg(
        *[F.sum(f"{p}_{z}").alias(f"t_{p}_{z}") for z in ZONES for p in ("s", "n")], F.count("*").alias("_count"), F.min(F.struct("lo", "recording_id")).alias("_low"), F.max(F.struct("hi", "recording_id")).alias("_high")
    )
    rows = stats.join(totals, keys).where("_count > 1")
    second = rows.groupBy(*keys).agg(F.min(F.when(r != F.col("_low.recording_id"), F.col("lo"))).alias("_low2"), F.max(F.when(r != F.col("_high.recording_id"), F.col("hi"))).alias("_high2"))
    less = {f"{p}_{z}": F.col(f"t_{p}_{z}") - F.col(f"{p}_{z}") for z in ZONES for p in ("s", "n")}
    ends = {"lo": F.when(r == F.col("_low.recording_id"), F.col("_low2")).otherwise(F.col("_low.lo")), "hi": F.when(r == F.col("_high.recording_id"), F.col("_high2")).otherwise(F.col("_high.hi"))}
    return rows.join(second, keys).select(*keys, r.alias("test_id"), *[c.alias(n) for n, c in (less | ends).items()])


def evaluate(stats: DataFrame, assignment: DataFrame, floor: float = 0.1, threshold: float = 0.15) -> DataFrame:
    """band, cand, test_id, main, stability and objective of every candidate with every recording left out.

    stats: band_statistics(); assignment: recording_id, fold. Stability is 1 less the variation of the metric over the
    folds of the recordings that are left in, all scaled alike; the objective is main x max(floor, stability) less what
    stability falls short of the threshold. A fold without its left-out recording is its total less that one's numbers,
    so rows go with recordings times folds, not with recordings squared.
    """
    stats = stored(stats.join(assignment, "recording_id"), "statistics")
    bands = [r.band for r in stats.select("band").distinct().collect()]
    names = [f"{p}_{z}" for z in ZONES for p in ("s", "n")]
    main = stored(left_out(stats.drop("fold")).withColumn("main", _metrics(bands)).select("band", "cand", "test_id", "main", "lo", "hi"), "main")
    totals = stats.groupBy("band", "cand", "fold").agg(*[F.sum(n).alias(f"t_{n}") for n in names])
    own = stats.select("band", "cand", F.col("recording_id").alias("test_id"), F.col("fold").alias("_own"), *[F.col(n).alias(f"o_{n}") for n in names])
    rows = main.join(own, ["band", "cand", "test_id"]).join(totals, ["band", "cand"])
    mine = F.when(F.col("fold") == F.col("_own"), 1).otherwise(0)
    less = rows.select("band", "cand", "test_id", "main", "lo", "hi", *[(F.col(f"t_{n}") - mine * F.col(f"o_{n}")).alias(n) for n in names]).where("n_all > 0")
    scored = less.withColumn("_m", _metrics(bands))
    stability = 1 - F.stddev_pop("_m") / (F.avg("_m") + EPS)
    found = scored.groupBy("band", "cand", "test_id").agg(F.first("main").alias("main"), stability.alias("stability"))
    objective = F.col("main") * F.greatest(F.lit(floor), F.col("stability")) - F.greatest(F.lit(0.0), threshold - F.col("stability"))
    return found.withColumn("objective", objective)


def best_of(found: DataFrame, candidates: DataFrame, names: list[str]) -> DataFrame:
    """band, test_id, objective and the parameters of each fold's best candidate; the smaller number where they tie."""
    best = found.groupBy("band", "test_id").agg(F.max_by(F.struct("objective", "cand"), F.struct(F.round("objective", 12), -F.col("cand"))).alias("b"))
    return best.select("band", "test_id", "b.*").join(candidates, ["band", "cand"]).select("band", "test_id", "objective", *names)


def cap(band: str, weight: Column) -> Column:
    low, high = WEIGHT_CAPS.get(band, (0.30, 0.85))
    return F.greatest(F.lit(low), F.least(F.lit(high), weight))


def optimise_bands(scores: DataFrame, bands: list[str], n: int = 20, rounds: int = 3, k: int = 3, seed: int = 42, tolerance: float = 0.001) -> DataFrame:
    """band, test_id, best parameters and objective of every leave-one-out fold of every band.

    Stage 1 shares one set of spatial candidates over all folds; later rounds evaluate the distinct candidates of all
    folds. A round is one pass over all bands' scores. A band is done when none of its folds improves by more than the
    tolerance.
    """
    spark = scores.sparkSession
    # the last two shape the volume later; they are drawn and kept with the rest
    intensity = {p: BOUNDS[p] for p in (*BLEND, "keep_top_pct", "smoothing_fwhm")}
    names = [*intensity, *SPATIAL]
    assignment = stored(folds(scores, "recording_id", k, seed), "folds")
    scores = gathered(scores, bands)

    def drawn(b: str) -> DataFrame:
        spatial = {p: BAND_BOUNDS.get(b, {}).get(p, BOUNDS[p]) for p in SPATIAL}
        points = latin_hypercube(spark, spatial, n, seed).withColumns({p: F.lit(float(getattr(DEFAULTS[b], p))) for p in intensity})
        return points.select(F.lit(b).alias("band"), "cand", *names)

    first = stored(reduce(DataFrame.unionByName, [drawn(b) for b in bands]), "candidates")
    best = stored(best_of(evaluate(band_statistics(scores, first), assignment), first, names), "best")
    open_ = list(bands)
    for r in range(rounds):
        size = max(4, n // (r + 1))
        going = best.where(F.col("band").isin(open_))
        if r == 0:
            points = latin_hypercube(spark, intensity, size, seed + 1)
            mine = going.drop(*intensity).crossJoin(F.broadcast(points.drop("cand")))  # `size` rows
        else:
            mine = refine(going, intensity, size, r, seed)
        mine = stored(mine.select("band", "test_id", *names), "asked")
        # equal candidates of several folds are evaluated once
        number = F.row_number().over(Window.partitionBy("band").orderBy(*names)) - 1
        distinct = stored(mine.select("band", *names).distinct().withColumn("cand", number.cast("int")), "candidates")
        owned = mine.join(distinct, ["band", *names]).select("band", "test_id", "cand").distinct()
        scored = evaluate(band_statistics(scores, distinct), assignment).join(owned, ["band", "test_id", "cand"])
        both = best.alias("a").join(best_of(scored, distinct, names).alias("b"), ["band", "test_id"], "left")
        better = F.coalesce(F.expr(f"b.objective > a.objective + {tolerance}"), F.lit(False))
        following = both.select("band", "test_id", *[F.when(better, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in ("objective", *names)], better.alias("_moved"))
        following = stored(following, "best")
        moved = {row.band for row in following.where("_moved").select("band").distinct().collect()}
        best = following.drop("_moved")
        open_ = [b for b in open_ if b in moved or r == 0]
        if not open_:
            break
    weight = reduce(lambda c, b: c.when(F.col("band") == b, cap(b, F.col("mi_weight"))), bands, F.when(F.lit(False), F.lit(0.0)))
    return best.withColumn("mi_weight", weight)


def optimise_band(scores: DataFrame, band: str, **options: float) -> DataFrame:
    """optimise_bands() of one band's scores."""
    return optimise_bands(scores.withColumn("band", F.lit(band)), [band], **options)


def tested(scores: DataFrame, best: DataFrame) -> DataFrame:
    """band, test_id, pa_ratio and occipital_pct: what every left-out recording comes to with its fold's parameters, under the
    prior and rescaled by its own extremes. scores as in band_statistics(); best: band, test_id and parameters."""
    keys = ["band", "test_id"]
    bands = [r.band for r in best.select("band").distinct().collect()]
    rows = stored(scores.withColumnRenamed("recording_id", "test_id").join(best.select(*keys, *SPATIAL, *BLEND), keys), "tested")
    x, y, z = (F.col(c) for c in "xyz")
    raw = reduce(lambda c, b: c.when(F.col("band") == b, raw_prior(PRIORS[b], F.col("penalty"), x, y, z)), bands, F.when(F.lit(False), F.lit(0.0)))
    least = reduce(lambda c, b: c.when(F.col("band") == b, F.lit(PRIORS[b].least)), bands, F.when(F.lit(False), F.lit(0.0)))
    most = rows.groupBy(*keys).agg(F.max(raw).alias("_most"))
    weight = scaled_prior(raw, F.col("_most"), least, F.col("boost"), F.col("softening"))
    found = hybrid(rows.join(most, keys), keys, F.col("mi_weight"), F.col("contrast"), weight, kept=True)
    return posterior_anterior(found, keys, "hybrid").select(*keys, "pa_ratio", "occipital_pct")


def consensus(best: DataFrame, names: list[str]) -> DataFrame:
    """band, the median of each parameter over folds, and mean and deviation of the objective."""
    return best.groupBy("band").agg(*[F.median(n).alias(n) for n in names], F.avg("objective").alias("objective_mean"), F.stddev_pop("objective").alias("objective_std"))


def parameter_stability(best: DataFrame, names: list[str], limit: float = 30.0) -> DataFrame:
    """band, param, mean, std, cv in percent, range and verdict over folds."""
    long = best.select("band", F.explode(F.array(*[F.struct(F.lit(n).alias("param"), F.col(n).alias("v")) for n in names])).alias("p")).select("band", "p.*")
    found = long.groupBy("band", "param").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), (F.max("v") - F.min("v")).alias("range"))
    cv = 100 * F.col("std") / (F.abs("mean") + EPS)
    return found.withColumn("cv", cv).withColumn("verdict", F.when(cv < limit, "stable").otherwise("unstable"))


def outliers(tests: DataFrame, pa_limits: tuple[float, float] = (0.1, 10.0), occipital_least: float = 5.0) -> DataFrame:
    """Rows of held-out metrics outside their limits, with the reasons."""
    reasons = F.concat_ws(", ", F.when(~F.col("pa_ratio").between(*pa_limits), F.lit("pa_ratio")), F.when(F.col("occipital_pct") < occipital_least, F.lit("occipital_pct")))
    return tests.withColumn("reasons", reasons).where("reasons <> ''")


#: Fixed values of the older grid search: weights tried, and by band the region, its target share and the cap on the weight.
GRID = tuple(round(0.3 + 0.1 * i, 1) for i in range(7))
GRID_RULES = {"alpha": ("ratio", 6.0, (None, 0.85)), "beta": ("share", 0.575, (0.45, None)), "theta": ("share", 0.20, (None, 0.70)), "delta": ("entropy", None, (None, None)), "gamma": ("kurtosis", None, (None, None))}


#: Boxes of the older grid search: beta's and theta's, and theta's where one recording is searched alone.
GRID_BOXES = {"beta": Box(y_min=-40, y_max=0), "theta": Box(y_min=-10, y_max=60, abs_x_max=40)}
SINGLE_THETA = Box(y_min=20, abs_x_max=30)
_GRID_SUMS = ("back", "front", "middle", "rest", "beta", "theta", "n", "p1", "p2", "p3", "p4")


def grid_sums(scores: DataFrame, keys: list[str], assignment: DataFrame, weights: tuple[float, ...] = GRID, theta: Box = GRID_BOXES["theta"]) -> DataFrame:
    """keys, mi_weight, fold and the sums that every band's value is made of; fold -1 is all epochs.

    scores: keys, voxel_id, epoch, x, y, mi, dice, averaged over what keys leave out; assignment: epoch, fold, a row an
    epoch, which is broadcast: dealt by their few epochs the scores would meet in as few tasks. One aggregate serves all
    bands, and sums of several recordings add up.
    """
    means = scores.groupBy(*keys, "voxel_id", "x", "y", "epoch").agg(F.avg("mi").alias("mi"), F.avg("dice").alias("dice")).join(F.broadcast(assignment), "epoch")
    twice = means.withColumn("fold", F.explode(F.array(F.lit(-1).cast("long"), F.col("fold").cast("long"))))
    rows = twice.groupBy(*keys, "voxel_id", "x", "y", "fold").agg(F.avg("mi").alias("mi"), F.avg("dice").alias("dice"))
    rows = rows.withColumn("mi_weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    h, y = F.col("_h"), F.col("y")
    zones = {"back": y < -40, "front": y > 0, "middle": (y >= -40) & (y < 0), "rest": y >= 0, "beta": in_box(GRID_BOXES["beta"]), "theta": in_box(theta)}
    sums = [F.sum(F.when(c, h).otherwise(0.0)).alias(n) for n, c in zones.items()] + [F.count("*").alias("n"), *[F.sum(F.pow(h, F.lit(float(k)))).alias(f"p{k}") for k in range(1, 5)]]
    return rows.withColumn("_h", F.col("mi_weight") * F.col("mi") + (1 - F.col("mi_weight")) * F.col("dice")).groupBy(*keys, "mi_weight", "fold").agg(*sums)


def _grid_value(band: str) -> Column:
    """A band's value from grid_sums()."""
    kind = GRID_RULES[band][0]
    if kind == "ratio":
        return F.col("back") / (F.col("front") + EPS)
    if kind == "share":
        return F.col(band) / (F.col("p1") + EPS)
    if kind == "kurtosis":
        m, n = F.col("p1") / F.col("n"), F.col("n")
        second = F.col("p2") / n - m * m
        fourth = F.col("p4") / n - 4 * m * F.col("p3") / n + 6 * m * m * F.col("p2") / n - 3 * F.pow(m, F.lit(4.0))
        return F.try_divide(fourth, second * second) - 3
    parts = [F.col("back"), F.col("middle"), F.col("rest")]
    total = reduce(Column.__add__, parts) + EPS
    return reduce(Column.__add__, [F.when(p > 0, -p / total * F.log(p / total)).otherwise(0.0) for p in parts])


def grid_scored(sums: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """keys, band, mi_weight, value, stability and metric of every band from grid_sums().

    alpha: posterior over anterior against its target ratio; beta and theta: a region's share against its target;
    delta: entropy of three zones; gamma: kurtosis over voxels; each times stability over the folds.
    """
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), _grid_value(b).alias("_v"), F.lit(GRID_RULES[b][1]).cast("double").alias("_target")) for b in bands])).alias("b")
    found = sums.select(*keys, "mi_weight", "fold", each).select(*keys, "mi_weight", "fold", "b.*")
    of_folds = F.when(F.col("fold") >= 0, F.col("_v"))
    stability = 1 - F.stddev_pop(of_folds) / (F.avg(of_folds) + EPS)
    scored = found.groupBy(*keys, "band", "_target", "mi_weight").agg(F.max(F.when(F.col("fold") < 0, F.col("_v"))).alias("value"), stability.alias("stability"))
    closeness = F.when(F.col("_target").isNull(), F.col("value")).otherwise(1 - F.least(F.lit(1.0), F.abs(F.col("value") - F.col("_target")) / F.col("_target")))
    return scored.withColumn("metric", closeness * F.col("stability")).drop("_target")


def grid_search(scores: DataFrame, bands: list[str], k: int = 3, seed: int = 42, weights: tuple[float, ...] = GRID, assignment: DataFrame | None = None, keys: list[str] | None = None, theta: Box = GRID_BOXES["theta"]) -> DataFrame:
    """band, mi_weight, value, stability and metric of each weight over k folds of epochs (scores: voxel_id, epoch, x, y,
    mi, dice), or over the folds given; with keys (recording_id) each recording is searched alone."""
    keys = keys or []
    return grid_scored(grid_sums(scores, keys, folds(scores, "epoch", k, seed) if assignment is None else assignment, weights, theta), keys, bands)


def grid_pick(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, band and its best weight of the grid (the first of ties), raised or capped for the band."""
    best = found.groupBy(*(keys or []), "band").agg(F.max_by("mi_weight", F.struct(F.round("metric", 9), -F.col("mi_weight"))).alias("mi_weight"))
    w = F.col("mi_weight")
    for b, (_, _, (low, high)) in GRID_RULES.items():
        own = F.greatest(w, F.lit(low if low is not None else 0.0))
        w = F.when(F.col("band") == b, F.least(own, F.lit(high if high is not None else 1.0))).otherwise(w)
    return best.withColumn("mi_weight", w)


def grid_leave_one_out(scores: DataFrame, bands: list[str], assignment: DataFrame, weights: tuple[float, ...] = GRID) -> DataFrame:
    """band, test_id, mi_weight, pa_ratio and occipital_pct: for every recording left out, the weight that the others'
    pooled values favour, and what the recording itself comes to with it, rescaled by its own extremes.

    Pools are totals less the recording's own sums, so one aggregate over all scores serves every fold.
    """
    sums = stored(grid_sums(scores, ["recording_id"], assignment, weights), "grid")
    whole = sums.groupBy("mi_weight", "fold").agg(*[F.sum(c).alias(f"t_{c}") for c in _GRID_SUMS])
    left = sums.join(whole, ["mi_weight", "fold"]).select(F.col("recording_id").alias("test_id"), "mi_weight", "fold", *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in _GRID_SUMS])
    picked = stored(grid_pick(grid_scored(left.where("n > 0"), ["test_id"], bands), ["test_id"]), "picked")
    # caps lie off the grid, so the recording's own values are made anew, once for each weight that was picked
    ours = scores.withColumnRenamed("recording_id", "test_id").join(picked.select("test_id", "mi_weight").distinct(), "test_id")
    h = F.col("mi_weight") * F.col("mi") + (1 - F.col("mi_weight")) * F.col("dice")
    ours = ours.withColumn("_h", h)
    means = ours.groupBy("test_id", "mi_weight", "voxel_id", "y").agg(F.avg("_h").alias("_h"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    part = lambda c: [F.sum(F.when(c, F.col("_h")).otherwise(0.0)), F.sum(c.cast("int"))]
    zones = {"back": F.col("y") < -40, "front": F.col("y") > 0, "occipital": F.col("y") < -70, "all": F.lit(True)}
    found = means.groupBy("test_id", "mi_weight").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), *[c.alias(f"{p}_{z}") for z, cond in zones.items() for p, c in zip("sn", part(cond), strict=True)])
    # scaling is affine: a zone's scaled sum is its sum less its count times the lowest, over the range
    scaled = lambda z: F.when(F.col("_hi") > F.col("_lo"), (F.col(f"s_{z}") - F.col(f"n_{z}") * F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col(f"s_{z}"))
    tested = found.select("test_id", "mi_weight", (scaled("back") / (scaled("front") + EPS)).alias("pa_ratio"), (100 * scaled("occipital") / (scaled("all") + EPS)).alias("occipital_pct"))
    return picked.join(tested, ["test_id", "mi_weight"]).select("band", "test_id", "mi_weight", "pa_ratio", "occipital_pct")


def windowed_sums(volume: DataFrame, windows: list[int], isolation: DataFrame, cells: int, targets: dict[str, Target], share: float = 0.3) -> DataFrame:
    """recording_id, band, near, epochs, temporal_window, and the sums (s_) and counts (n_) by zone of voxels' time means after
    the temporal filter with zero edges, for each window; a series no longer than the window isn't filtered.

    volume is stored: recording_id, band, voxel_id, x, y, z, epoch, value; isolation: voxel_id, n_near, which counts up to
    `cells`, as epochs do up to one beyond the windows. A series is one array, which all windows are laid over where it
    is; what moves after that is one row of sums a class and batch.
    """
    keys, most = ["recording_id", "band"], max(windows) + 1
    bands = sorted(targets)
    rows = volume.where(F.col("band").isin(bands)).select(*keys, "voxel_id", "epoch", F.col("value").cast("double").alias("value"), _zone_bits(bands, targets).alias("_zones"))
    packed = dealt(rows, volume.count(), "voxel_id").groupBy(*keys, "voxel_id", "_zones").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "value"))), lambda r: r["value"]).alias("_v"))
    near = F.least(F.coalesce("n_near", F.lit(1)), F.lit(cells)).cast("int")
    located = packed.join(isolation, "voxel_id", "left").select(*keys, near.alias("near"), "_zones", "_v")
    parts = [f"n_{z}" for z in ZONES] + [f"s_{w}_{z}" for w in windows for z in ZONES]
    kinds = ", ".join(f"{k} {kind}" for k, kind in rows.select(*keys).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column(4).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            v = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            starts, at = ends - lengths, np.arange(len(v))
            low, high = np.repeat(starts, lengths), np.repeat(ends, lengths)
            inside = batch.column(3).to_numpy()[:, None] >> np.arange(len(ZONES)) & 1
            epochs = np.minimum(lengths, most).astype(np.int32)
            first, code = grouped([batch.column(k) for k in range(3)] + [pa.array(epochs)])
            active = np.concatenate([[0], np.cumsum(v > 0)])
            raw = np.add.reduceat(v, starts) / lengths
            found = [np.bincount(code, inside[:, z], len(first)) for z in range(len(ZONES))]
            for w in windows:
                seen = active[np.minimum(at + w - w // 2, high)] - active[np.maximum(at - w // 2, low)]
                kept = np.add.reduceat(np.where(np.round(seen / w, 9) >= share, v, 0.0), starts) / lengths
                mean = np.where(lengths > w, kept, raw)
                found += [np.bincount(code, mean * inside[:, z], len(first)) for z in range(len(ZONES))]
            own = [batch.column(k).take(pa.array(first)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(epochs[first]), *map(pa.array, found)], names=[*keys, "near", "epochs", *parts])

    each = located.mapInArrow(run, f"{kinds}, near int, epochs int, {', '.join(f'{c} double' for c in parts)}")
    sums = each.groupBy(*keys, "near", "epochs").agg(*[F.sum(c).alias(c) for c in parts])
    of_windows = F.explode(F.array(*[F.struct(F.lit(w).alias("temporal_window"), *[F.col(f"s_{w}_{z}").alias(f"s_{z}") for z in ZONES]) for w in windows])).alias("w")
    return sums.select(*keys, "near", "epochs", *[f"n_{z}" for z in ZONES], of_windows).select(*keys, "near", "epochs", *[f"n_{z}" for z in ZONES], "w.*")


def global_scores(sums: DataFrame, candidates: DataFrame, targets: dict[str, Target]) -> DataFrame:
    """cand, band and score of global candidates (cand, temporal_window, least_cells) over windowed_sums(): the metric averaged
    over recordings, weighted by the target's confidence.

    Voxels with fewer than least_cells near are damped, but only where the series is no longer than the window: the
    temporal filter's means replace the damped ones.
    """
    rows = sums.join(F.broadcast(candidates), "temporal_window")
    damp = F.when((F.col("near") < F.col("least_cells")) & (F.col("epochs") <= F.col("temporal_window")), 0.1).otherwise(1.0)
    totals = rows.groupBy("cand", "band", "recording_id").agg(*[F.sum(F.col(f"s_{z}") * damp).alias(f"s_{z}") for z in ZONES], *[F.sum(f"n_{z}").alias(f"n_{z}") for z in ZONES])
    s, n = ({z: F.col(f"{p}_{z}") for z in ZONES} for p in "sn")
    bands = sorted(targets)
    metric = _chosen(bands, lambda b: metric_of(b, s, n, F.lit(0.0), F.lit(1.0), targets[b]))
    weight = _chosen(bands, lambda b: F.lit(CONFIDENCE.get(targets[b].confidence, 0.5)))
    return totals.where(F.col("band").isin(bands)).groupBy("cand", "band").agg(F.avg(metric).alias("_m")).select("cand", "band", (F.col("_m") * weight).alias("score"))


def optimise_global(volume: DataFrame, targets: dict[str, Target], isolation: DataFrame, n: int = 15, rounds: int = 2, near: int = 8, seed: int = 42, tolerance: float = 0.001) -> DataFrame:
    """round, temporal_window, min_cluster_mm3 and score of the best candidate after each round: the defaults with n
    candidates of a Latin hypercube, then `near` around the best, twice.

    The temporal filter runs once over all whole windows that the bounds allow; a round is arithmetic on their sums.
    """
    spark = volume.sparkSession
    names = list(GLOBAL_BOUNDS)
    low, high = GLOBAL_BOUNDS["temporal_window"]
    cells = max(4, math.floor(GLOBAL_BOUNDS["min_cluster_mm3"][1] / SPACING**3)) + 1
    sums = stored(windowed_sums(volume, list(range(round(low), round(high) + 1)), isolation, cells, targets), "windowed")
    start = {"temporal_window": 3.0, "min_cluster_mm3": 25.0}
    first = spark.range(1).select(F.lit(-1).alias("cand"), *[F.lit(start[p]).alias(p) for p in names])
    made = latin_hypercube(spark, GLOBAL_BOUNDS, n, seed).unionByName(first)
    best: DataFrame | None = None
    trail = []
    for r in range(rounds + 1):
        if best is not None:
            made = refine(best.select(*names), GLOBAL_BOUNDS, near, r, seed).withColumn("temporal_window", F.round("temporal_window"))
        made = stored(made.select("cand", *names), "candidates")
        asked = made.select("cand", F.col("temporal_window").cast("int"), F.greatest(F.lit(4), F.floor(F.col("min_cluster_mm3") / SPACING**3)).alias("least_cells"))
        scored = global_scores(sums, asked, targets).groupBy("cand").agg(F.avg("score").alias("score")).join(made, "cand")
        top = scored.agg(F.max_by(F.struct("score", *names), F.struct(F.round("score", 12), -F.col("cand"))).alias("b")).select("b.*")
        if best is not None:
            both = top.select(F.struct("score", *names).alias("new")).crossJoin(best.select(F.struct("score", *names).alias("old")))  # one row each
            top = both.select(F.when(F.col("new.score") > F.col("old.score") + tolerance, F.col("new")).otherwise(F.col("old")).alias("b")).select("b.*")
        best = stored(top, "best")
        trail.append(best.withColumn("round", F.lit(r)))
    return reduce(DataFrame.unionByName, trail).select("round", *names, "score")
