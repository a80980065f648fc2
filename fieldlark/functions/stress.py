"""Condition indices, and stress classes by growth stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import clip, col, finite, lookup, normalised

#: Lower edges of the classes none, mild, moderate and high, by stage.
THRESHOLDS = {
    "initial": (0.55, 0.40, 0.28, 0.18),
    "development": (0.60, 0.45, 0.32, 0.20),
    "mid-season": (0.70, 0.55, 0.40, 0.25),
    "late-season": (0.55, 0.40, 0.28, 0.18),
    "mature": (0.45, 0.32, 0.22, 0.12),
    "default": (0.60, 0.45, 0.32, 0.20),
}
SEVERITIES = {-1: "no_data", 0: "none", 1: "mild", 2: "moderate", 3: "high", 4: "severe"}


def optram(ndvi, str_, edges: dict) -> Column:
    """Soil moisture between a dry and a wet edge, both lines in NDVI."""
    missing = {"dry_intercept", "dry_slope", "wet_intercept", "wet_slope"} - set(edges)
    if missing:
        raise KeyError(f"edges lack {sorted(missing)}")
    dry = edges["dry_intercept"] + edges["dry_slope"] * col(ndvi)
    wet = edges["wet_intercept"] + edges["wet_slope"] * col(ndvi)
    return normalised(col(str_) - dry, wet - dry)


def vci(x, lo, hi) -> Column:
    return normalised(col(x) - col(lo), col(hi) - col(lo))


def tci(x, lo, hi) -> Column:
    return normalised(col(hi) - col(x), col(hi) - col(lo))


def vhi(v, t, alpha: float = 0.5) -> Column:
    return alpha * col(v) + (1.0 - alpha) * col(t)


def tvdi(ndvi, lst, dry: tuple[float, float], wet) -> Column:
    """``wet`` is a constant or a line like ``dry``."""
    d = dry[0] + dry[1] * col(ndvi)
    w = wet[0] + wet[1] * col(ndvi) if isinstance(wet, tuple) else F.lit(float(wet))
    return normalised(col(lst) - w, d - w)


def cwsi(canopy, air, lower, upper) -> Column:
    return normalised(col(canopy) - col(air) - col(lower), col(upper) - col(lower))


def classify(index, stage, thresholds: dict | None = None, higher_is_stress: bool = False) -> dict[str, Column]:
    """condition, severity (-1 where missing), label, stressed; unknown stages take the default thresholds."""
    table = thresholds or THRESHOLDS
    x = clip(finite(index), 0.0, 1.0)
    x = 1.0 - x if higher_is_stress else x
    cut = [F.coalesce(lookup({k: v[i] for k, v in table.items()}, col(stage)), F.lit(table["default"][i])) for i in range(4)]
    severity = F.when(x.isNull(), -1).when(x >= cut[0], 0).when(x >= cut[1], 1).when(x >= cut[2], 2).when(x >= cut[3], 3).otherwise(4)
    return {"condition": x, "severity": severity, "label": lookup(SEVERITIES, severity), "stressed": severity >= 1}


def bucket(x, edges=(0.15, 0.35, 0.6)) -> Column:
    """Number of edges at or below x."""
    return sum(((col(x) >= e).cast("int") for e in edges), F.lit(0))
