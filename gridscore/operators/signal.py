"""Signal kernels on rows that each hold one series: filters, envelopes, band power, component features and unmixing.

Kernels are vectorised over an Arrow batch of series; sums over samples are Spark aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscore.model import BANDS
from gridscore.session import stored


def butter_band(low: float, high: float, fs: float, order: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a digital Butterworth band-pass: analogue poles moved to the band, then to the z-plane."""
    warp = lambda f: 2 * fs * math.tan(math.pi * f / fs)
    lo, hi = warp(low), warp(high)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = poles * (hi - lo) / 2
    root = np.sqrt(half**2 - lo * hi)
    moved = np.concatenate([half + root, half - root])
    gain = (hi - lo) ** order
    z_poles = (2 * fs + moved) / (2 * fs - moved)
    z_zeros = np.concatenate([np.ones(order), -np.ones(order)])
    k = (gain * (2 * fs) ** order / np.prod(2 * fs - moved)).real
    return k * np.poly(z_zeros).real, np.poly(z_poles).real


def notch_coefficients(f0: float, q: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    w = 2 * math.pi * f0 / fs
    beta = math.tan(w / q / 2)
    gain = 1 / (1 + beta)
    return gain * np.array([1, -2 * math.cos(w), 1]), np.array([1, -2 * gain * math.cos(w), 2 * gain - 1])


def _recursive(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed along the last axis, all rows side by side."""
    out = np.empty_like(x)
    for t in range(x.shape[1]):
        v = x[:, t]
        y = b[0] * v + state[:, 0]
        state[:, :-1] = state[:, 1:] + b[1:-1] * v[:, None] - a[1:-1] * y[:, None]
        state[:, -1] = b[-1] * v - a[-1] * y
        out[:, t] = y
    return out


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering of rows, padded oddly by three filter lengths, started in the steady state."""
    pad = min(3 * len(b), x.shape[1] - 1)
    if x.shape[1] < 2:
        return x
    left, right = 2 * x[:, :1] - x[:, pad:0:-1], 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    y = np.concatenate([left, x, right], axis=1)
    n = len(b) - 1
    companion = np.eye(n) - np.vstack([-a[1:], np.eye(n)[:-1]]).T
    steady = np.linalg.solve(companion, b[1:] - a[1:] * b[0])
    y = _recursive(b, a, y, steady * y[:, :1])
    y = _recursive(b, a, y[:, ::-1].copy(), steady * y[:, -1:])[:, ::-1]
    return y[:, pad : y.shape[1] - pad]


def _analytic(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * gain, axis=1)


def _by_length(values: pd.Series, kernel) -> list:  # noqa: ANN001
    """Apply a kernel to the rows of each length together."""
    out: list = [None] * len(values)
    sizes = np.array([0 if v is None else len(v) for v in values])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        if size:
            made = kernel(np.stack([np.asarray(values.iloc[k], dtype=np.float64) for k in at]))
            for k, row in zip(at, made, strict=True):
                out[k] = row
    return out


def _mapped(df: DataFrame, values: str, kernel, kind: str, name: str) -> DataFrame:  # noqa: ANN001
    rest = [c for c in df.columns if c != name]
    kinds = dict(df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = _by_length(frame[values], kernel)
            yield frame.assign(**{name: made})[[*rest, name]]

    return df.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + f", `{name}` {kind}")


def bandpass(df: DataFrame, fs: float, low: float, high: float, order: int = 4, values: str = "values") -> DataFrame:
    """Series filtered to a band, without phase shift; null series stay null."""
    b, a = butter_band(low, min(high, fs / 2 - 1), fs, order)
    return _mapped(df, values, lambda x: list(zero_phase(b, a, x)), "array<double>", values)


def notch(df: DataFrame, fs: float, f0: float = 50.0, q: float = 30.0, values: str = "values") -> DataFrame:
    b, a = notch_coefficients(f0, q, fs)
    return _mapped(df, values, lambda x: list(zero_phase(b, a, x)), "array<double>", values)


def envelopes(df: DataFrame, fs: float, relative: bool = True, values: str = "values", bands: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """df with `power`: a map from band to the mean amplitude of the series in it, over that of 1..80 Hz if relative."""
    edges = bands or BANDS
    filters = {n: butter_band(lo, min(hi, fs / 2 - 1), fs) for n, (lo, hi) in edges.items() if lo < fs / 2 - 1}
    broad = butter_band(1.0, min(80.0, fs / 2 - 1), fs)

    def kernel(x: np.ndarray) -> list[dict[str, float]]:
        mean = lambda c: np.abs(_analytic(zero_phase(*c, x))).mean(1)
        base = mean(broad) + 1e-12 if relative else np.ones(len(x))
        found = {n: mean(c) / base for n, c in filters.items()}
        return [{n: float(v[k]) for n, v in found.items()} for k in range(len(x))]

    return _mapped(df, values, kernel, "map<string,double>", "power")


def _welch(x: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    size = min(size, x.shape[1])
    step = max(1, size - size // 2)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    starts = range(0, x.shape[1] - size + 1, step)
    parts = [np.abs(np.fft.rfft((x[:, s : s + size] - x[:, s : s + size].mean(1, keepdims=True)) * window, axis=1)) ** 2 for s in starts]
    power = np.mean(parts, axis=0) / (fs * (window**2).sum())
    power[:, 1 : (-1 if size % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(size, 1 / fs), power


def _area(f: np.ndarray, p: np.ndarray, keep: np.ndarray) -> np.ndarray:
    return np.trapezoid(p[:, keep], f[keep], axis=1) if keep.any() else np.zeros(len(p))


def welch_power(df: DataFrame, fs: float, low: float, high: float, size: int = 1024, values: str = "values") -> DataFrame:
    """df with `power`: the area under Welch's spectrum from low to high."""
    def kernel(x: np.ndarray) -> list[float]:
        f, p = _welch(x, fs, size)
        return _area(f, p, (f >= low) & (f <= high)).tolist()

    return _mapped(df, values, kernel, "double", "power")


def dft_power(df: DataFrame, keys: list[str], fs: float, n: int, low: float, high: float, values: str = "values") -> DataFrame:
    """keys and power: the squared moduli of the transform's terms from low to high Hz, over n^2; joins and sums only."""
    spark = df.sparkSession
    terms = [k for k in range(n // 2 + 1) if low <= k * fs / n <= high]
    angle = 2 * math.pi * F.col("k") * F.col("pos") / n
    basis = spark.createDataFrame([(k,) for k in terms], "k int").crossJoin(spark.range(n).select(F.col("id").cast("int").alias("pos"))).select("k", "pos", F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    long = df.select(*keys, F.posexplode(F.col(values).cast("array<double>")).alias("pos", "v")).join(F.broadcast(basis), "pos")
    parts = long.groupBy(*keys, "k").agg(F.sum(F.col("v") * F.col("c")).alias("_c"), F.sum(F.col("v") * F.col("s")).alias("_s"))
    return parts.groupBy(*keys).agg((F.sum(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")) / (n * n)).alias("power"))


#: Ranges of the spectral shares that describe a component.
SHARES = {"lf": (0.0, 2.0), "hf": (30.0, 100.0), "delta": (1, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30), "gamma": (30, 80)}


def component_features(components: DataFrame, fs: float, values: str = "values") -> DataFrame:
    """components with std, kurtosis (bias-corrected, 3 for a normal), mad, spectral shares, flatness and acf at 20 ms."""
    names = ["std", "kurtosis", "mad", *[f"{n}_ratio" for n in SHARES], "flatness", "acf"]

    def kernel(x: np.ndarray) -> list[dict[str, float]]:
        n = x.shape[1]
        c = x - x.mean(1, keepdims=True)
        m2, m4 = (c**2).mean(1), (c**4).mean(1)
        kurt = np.where(m2 > 0, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m4 / np.maximum(m2, 1e-300) ** 2 - 3 * (n - 1)) + 3, 0.0) if n > 3 else np.zeros(len(x))
        f, p = _welch(x, fs, 1024)
        total = _area(f, p, np.ones(len(f), dtype=bool)) + 1e-12
        lag = int(fs * 0.02)
        acf = (c[:, lag:] * c[:, : n - lag]).sum(1) / ((c**2).sum(1) + 1e-12) if lag < n else np.zeros(len(x))
        rows = {"std": x.std(1), "kurtosis": kurt, "mad": np.median(np.abs(x - np.median(x, 1, keepdims=True)), 1), "flatness": np.exp(np.log(p + 1e-12).mean(1)) / (p.mean(1) + 1e-12), "acf": acf}
        rows |= {f"{k}_ratio": _area(f, p, (f < hi) if k == "lf" else (f >= lo) & (f <= hi)) / total for k, (lo, hi) in SHARES.items()}
        return [{k: float(rows[k][i]) for k in names} for i in range(len(x))]

    found = _mapped(components, values, kernel, "map<string,double>", "_f")
    return found.withColumns({n: F.col("_f")[n] for n in names}).drop("_f")


#: Groups of channels, and what a component in them gains or loses.
GROUPS = {
    "posterior": ("O1", "O2", "Oz", "PO3", "PO4", "PO7", "PO8", "POz", "P1", "P2", "P3", "P4", "P7", "P8", "Pz", "Iz"),
    "frontal": ("Fp1", "Fp2", "Fpz", "AF7", "AF8", "AF3", "AF4"),
    "central": ("C1", "C2", "C3", "C4", "C5", "C6", "Cz", "FC1", "FC2", "FC3", "FC4", "FC5", "FC6", "FCz", "CP1", "CP2", "CP3", "CP4", "CP5", "CP6", "CPz"),
    "midline": ("Fz", "FCz", "Cz", "F1", "F2", "FC1", "FC2", "AFz"),
}
PROTECTED = {
    "alpha": ("posterior", 0.25, ((0.50, 1.3, -6.0), (0.35, 1.1, -4.0), (None, 1.0, -2.5))),
    "beta": ("central", 0.25, ((0.40, 1.3, -4.0), (0.30, 1.1, -2.5), (None, 1.0, -1.5))),
    "theta": ("midline", 0.25, ((0.40, 1.3, -3.5), (0.30, 1.1, -2.0), (None, 1.0, -1.0))),
}
#: The score from which a component is flagged, by mode.
THRESHOLDS = {"conservative": 4.0, "standard": 3.0, "aggressive": 2.0}


def artifact_scores(features: DataFrame, mixing: DataFrame, keys: list[str], mode: str = "standard") -> DataFrame:
    """features (keys, component, ...) with score, reasons and flagged; mixing: keys, component, name of channel, weight.

    Evidence for eye, muscle, channel and line noise adds up; activity where its rhythm belongs takes off.
    """
    w = F.abs("weight")
    group = [F.avg(F.when(F.col("name").isin(*names), w)).alias(f"_{g}") for g, names in GROUPS.items()]
    shape = mixing.groupBy(*keys, "component").agg(F.avg(w).alias("_all"), F.max(w).alias("_max"), F.median(w).alias("_med"), *group)
    by = Window.partitionBy(*keys)  # tens of components a recording
    rows = features.join(shape, [*keys, "component"]).withColumn("_zk", (F.col("kurtosis") - F.avg("kurtosis").over(by)) / (F.stddev_pop("kurtosis").over(by) + 1e-12))
    overall = F.col("_all") + 1e-12
    over = lambda g: F.coalesce(F.col(f"_{g}") / overall, F.lit(0.0))
    # fixed values: what each kind of evidence takes, and the points it gives
    rules: list[tuple[Column, float, str]] = [
        ((F.col("_zk") > 2.5) & (F.col("lf_ratio") > 0.3) & (over("frontal") > 1.5), 3.0, "EOG"),
        ((F.col("hf_ratio") > 0.15) & (F.col("_zk") > 1.5), 2.5, "EMG"),
        (F.col("_max") > 5 * F.col("_med"), 2.0, "Channel_noise"),
        (F.col("flatness") > 0.8, 1.5, "Line_noise"),
        (F.col("acf") < 0.3, 1.0, "Spiky"),
    ]
    for band, (g, least, steps) in PROTECTED.items():
        share, done = F.col(f"{band}_ratio"), F.lit(False)
        for (at, dominance, points), word in zip(steps, ("strong", "mod", "weak"), strict=True):
            test = (share > least) & (over(g) > dominance) & (F.lit(True) if at is None else share > at) & ~done
            rules.append((test, points, f"PROTECT_{word}_{band}"))
            done = done | test
    calm = (F.col("delta_ratio") > 0.40) & (over("frontal") < 1.3) & (F.col("lf_ratio") < 0.5)
    rules += [(calm & (F.col("delta_ratio") > 0.60), -2.0, "PROTECT_strong_delta"), (calm & (F.col("delta_ratio") <= 0.60), -1.0, "PROTECT_weak_delta")]
    score = reduce(Column.__add__, [F.when(test, points).otherwise(0.0) for test, points, _ in rules])
    reasons = F.concat_ws("+", *[F.when(test, name) for test, _, name in rules])
    scored = rows.withColumn("score", score).withColumn("reasons", reasons).withColumn("flagged", F.col("score") >= THRESHOLDS[mode])
    return scored.drop("_all", "_max", "_med", "_zk", *[f"_{g}" for g in GROUPS])


def remix(sources: DataFrame, mixing: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, channel, sample_idx and value without the removed components."""
    kept = mixing.join(removed.select(*keys, "component"), [*keys, "component"], "left_anti")
    return sources.join(kept, [*keys, "component"]).groupBy(*keys, "channel", "sample_idx").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def unmix(samples: DataFrame, n_channels: int, rounds: int = 50, tolerance: float = 1e-6, seed: int = 42, values: str = "x") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, mixing, unmixing) of one recording whose samples are rows of `values`, one entry a channel.

    Symmetric fixed-point iteration: whitening and each round are sums over samples, added up per partition and then
    over partitions; the driver holds matrices of n_channels x n_channels only.
    """
    x = stored(samples.select(F.col(values).cast("array<double>").alias("x")), "samples")

    def added(kernel) -> np.ndarray:  # noqa: ANN001
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = 0.0
            for frame in frames:
                if len(frame):
                    total = total + kernel(np.stack(frame["x"].to_numpy()))
            if not np.isscalar(total):
                yield pd.DataFrame({"pos": np.arange(total.size), "v": total.ravel()})

        rows = x.mapInPandas(run, "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect()
        return np.array([r.v for r in sorted(rows, key=lambda r: r.pos)])

    c = n_channels
    first = added(lambda m: np.concatenate([[len(m)], m.sum(0), (m.T @ m).ravel()]))
    n, mean = first[0], first[1 : 1 + c] / first[0]
    values_, vectors = np.linalg.eigh(first[1 + c :].reshape(c, c) / n - np.outer(mean, mean))
    keep = values_ > 1e-10 * values_.max()
    white = (vectors[:, keep] / np.sqrt(values_[keep])).T
    k = int(keep.sum())
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):
        def step(m: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            z = (m - mean) @ white.T
            g = np.tanh(z @ w.T)
            return np.concatenate([(g.T @ z).ravel(), (1 - g**2).sum(0)])

        found = added(step) / n
        u, _, v = np.linalg.svd(found[: k * k].reshape(k, k) - found[k * k :, None] * w)
        new = u @ v
        change = np.abs(np.abs((new * w).sum(1)) - 1).max()
        w = new
        if change < tolerance:
            break
    unmixing = w @ white
    return mean, np.linalg.pinv(unmixing), unmixing


def selective_reference(samples: DataFrame, weights: DataFrame, channels: DataFrame, keys: list[str], fs: float, posterior: float = -40.0, frontal: float = 20.0, middle: float = 10.0) -> DataFrame:
    """keys, channel and values less their neighbours', with rhythms kept where they belong.

    Alpha stays whole on posterior channels and by halves on central ones, a share of beta comes back on central and a
    little theta on midline channels. samples: keys, channel, values (arrays over time).
    """
    from gridscore.operators.signature import subtract_neighbours

    def banded(lo: float, hi: float, name: str) -> DataFrame:
        return bandpass(samples.select(*keys, "channel", "values"), fs, lo, hi).withColumnRenamed("values", name)

    rows = samples
    for lo, hi, name in ((8, 13, "_a"), (13, 30, "_b"), (4, 8, "_t")):
        rows = rows.join(banded(lo, hi, name), [*keys, "channel"])
    rows = rows.join(F.broadcast(channels.select(F.col("idx").alias("channel"), F.col("x").alias("_x"), F.col("y").alias("_y"))), "channel")
    long = rows.select(*keys, "channel", "_x", "_y", F.posexplode(F.arrays_zip("values", "_a", "_b", "_t")).alias("sample_idx", "s"))
    back, front = F.col("_y") < posterior, F.col("_y") > frontal
    central = ~back & ~front
    alpha = F.col("s._a")
    # half of a central channel's alpha is spread over what is referenced and half of that is added back whole
    sent = F.when(back, F.col("s.values") - alpha).when(central, F.col("s.values") - alpha + 0.5 * alpha + 0.25 * alpha).otherwise(F.col("s.values"))
    kept = F.when(back, alpha).when(central, 0.25 * alpha + 0.3 * F.col("s._b")).otherwise(0.0) + F.when(F.abs("_x") < middle, 0.1 * F.col("s._t")).otherwise(0.0)
    parts = long.select(*keys, "channel", "sample_idx", sent.alias("value"), kept.alias("_kept"))
    flat = subtract_neighbours(parts, weights, [*keys, "sample_idx"])
    total = flat.withColumn("value", F.col("value") + F.col("_kept"))
    return total.groupBy(*keys, "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))), lambda s: s["value"]).alias("values"))


def resample(df: DataFrame, factor: int, values: str = "values") -> DataFrame:
    """Every factor-th sample after frequencies beyond the new half rate are cut in the transform (a polyphase filter's
    edges differ)."""
    def kernel(x: np.ndarray) -> list[np.ndarray]:
        f = np.fft.rfft(x, axis=1)
        f[:, x.shape[1] // (2 * factor) + 1 :] = 0
        return list(np.fft.irfft(f, n=x.shape[1], axis=1)[:, ::factor])

    return _mapped(df, values, kernel, "array<double>", values)
