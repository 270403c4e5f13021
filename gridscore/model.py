"""Schemas and the fixed values of bands, targets, priors and search bounds."""

from __future__ import annotations

from dataclasses import dataclass, field

SAMPLE = "recording_id string, channel_id string, sample_idx long, value double"
CHANNEL = "channel_id int, name string, x double, y double, z double, side string"
VOXEL = "voxel_id long, i int, j int, k int, x double, y double, z double, roi_id int, is_gm boolean"
SCORE = "recording_id string, band string, voxel_id long, epoch int, mi double, dice double"
VOLUME = "recording_id string, band string, voxel_id long, epoch int, value double"
METRIC = "recording_id string, band string, metric string, value double"
PARAMS = "band string, mi_weight double, contrast double, boost double, penalty double, softening double, keep_top_pct double, smoothing_fwhm double"
FOLD = "band string, fold int, test_id string, params map<string,double>, best_metric double, test_metrics map<string,double>"

# Frequency bands in Hz, and how much wider or narrower a band's spatial weights are.
BANDS = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30), "gamma": (30, 80)}
SIGMA_SCALE = {"delta": 1.15, "theta": 1.05, "alpha": 1.0, "beta": 0.9, "gamma": 0.8}
SIGMA_BASE = 35.0
# Upper edges of y zones, with the zone's factor on sigma.
SIGMA_ZONES = ((-90.0, 1.5), (-70.0, 1.3), (-40.0, 1.2), (0.0, 1.0), (None, 1.1))


@dataclass(frozen=True)
class Box:
    """Inclusive limits; None leaves a side open."""

    y_min: float | None = None
    y_max: float | None = None
    z_min: float | None = None
    z_max: float | None = None
    abs_x_min: float | None = None
    abs_x_max: float | None = None


@dataclass(frozen=True)
class Target:
    """What a band's spatial metric should come to; kind is ratio, mean_ratio, proportion or proportion_ratio."""

    kind: str
    value: float
    low: float
    high: float
    confidence: str
    region: Box
    against: Box | None = None


# Targets of each band.
TARGETS = {
    "alpha": Target("ratio", 0.9, 0.4, 1.5, "MEDIUM", Box(y_max=-40), Box(y_min=0)),
    "beta": Target("proportion", 0.22, 0.12, 0.40, "MEDIUM", Box(y_min=-45, y_max=15, z_min=40, abs_x_min=10, abs_x_max=55)),
    "theta": Target("ratio", 1.4, 0.9, 2.2, "LOW-MEDIUM", Box(abs_x_max=15, y_min=10, y_max=60, z_min=15, z_max=65), Box(abs_x_min=25, y_min=10, y_max=60, z_min=5)),
    "gamma": Target("proportion_ratio", 1.8, 0.8, 4.0, "LOW", Box(y_max=-60, z_max=40)),
    "delta": Target("mean_ratio", 0.85, 0.5, 1.4, "MEDIUM", Box(y_min=0), Box(y_max=-40)),
}
# What a target's confidence weighs.
CONFIDENCE = {"HIGH": 1.0, "MEDIUM": 0.8, "LOW-MEDIUM": 0.6, "LOW": 0.4}


@dataclass(frozen=True)
class Peak:
    """A product of Gaussians over some axes: (centre, width) of y, z and |x|."""

    weight: float
    y: tuple[float, float]
    z: tuple[float, float] | None = None
    abs_x: tuple[float, float] | None = None


@dataclass(frozen=True)
class Prior:
    least: float
    peaks: tuple[Peak, ...]
    penalty: tuple[float, float] | None = None


# Spatial priors.
PRIORS = {
    "alpha": Prior(0.60, (Peak(1.0, (-40, 80)),)),
    "beta": Prior(0.30, (Peak(1.0, (-15, 35), (50, 25), (40, 25)),), (-15, 20)),
    "theta": Prior(0.25, (Peak(1.0, (35, 25), (45, 20), (0, 15)),), (-15, 30)),
    "delta": Prior(0.25, (Peak(1.0, (40, 40)),), (-15, 30)),
    "gamma": Prior(0.35, (Peak(0.5, (-70, 35)), Peak(0.5, (25, 30)))),
}


@dataclass(frozen=True)
class Params:
    """Weights of one band's hybrid score."""

    mi_weight: float = 0.55
    contrast: float = 0.6
    boost: float = 1.5
    penalty: float = 0.0
    softening: float = 0.5
    keep_top_pct: float = 0.9
    smoothing_fwhm: float = 1.0


# Where the search starts, how far it goes, and what the result is held to.
DEFAULTS = {
    "delta": Params(0.45, 0.90, 1.7, 0.8, 0.40, 0.85, 1.0),
    "theta": Params(0.65, 0.85, 1.6, 0.7, 0.55, 0.90, 1.0),
    "alpha": Params(0.65, 0.50, 1.3, 0.0, 0.70, 0.90, 1.5),
    "beta": Params(0.55, 0.65, 1.4, 0.5, 0.45, 0.85, 1.0),
    "gamma": Params(0.40, 0.90, 1.2, 0.3, 0.70, 0.80, 1.0),
}
BOUNDS = {"mi_weight": (0.25, 0.95), "contrast": (0.10, 1.20), "boost": (1.0, 3.0), "penalty": (0.0, 1.0), "softening": (0.1, 1.0), "keep_top_pct": (0.60, 0.98), "smoothing_fwhm": (0.0, 3.0)}
BAND_BOUNDS = {"alpha": {"softening": (0.50, 1.0), "boost": (1.0, 1.8)}}
GLOBAL_BOUNDS = {"min_cluster_mm3": (10.0, 80.0), "temporal_window": (1.0, 7.0)}
WEIGHT_CAPS = {"alpha": (0.35, 0.92), "beta": (0.35, 0.65), "theta": (0.35, 0.75), "gamma": (0.35, 0.75), "delta": (0.30, 0.70)}
# Fixed value: edge of a cell in mm.
SPACING = 2.0


@dataclass(frozen=True)
class PostParams:
    """Steps of post-processing and their settings."""

    # fixed values: what the current pipeline starts from
    ar1: bool = True
    fir: bool = True
    fwhm: float = 1.0
    keep: int = 15000
    min_cluster_mm3: float = 25.0
    floor_pct: float = 0.5
    floor_abs: int = 25000
    window: int = 3
    share: float = 0.3
    chunk: int | None = None
    order: tuple[str, ...] = field(default=("ar1", "zscore", "smooth", "sparsify", "clusters", "temporal", "fir"))


# Bounds of the head's box, layers of depth with their factors, and names of what isn't grey matter.
HEAD_BOX = {"x": (-78, 78), "y": (-112, 76), "z": (-70, 85)}
DEPTH_LAYERS = ((-10.0, 0.0), (10.0, 0.3), (30.0, 0.6))
NOT_GREY = ("white matter", "ventricle", "background", "brain-stem", "vessel", "csf", "corpus callosum", "brainstem")
# Six zones along y by their upper edges.
ZONES = (("very_posterior", -85.0), ("occipital", -70.0), ("posterior", -40.0), ("central", 0.0), ("anterior", 40.0), ("frontal", None))
