"""Radar backscatter: units, terrain flattening and polarimetric features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import EPS, at_least, clip, col


def to_db(linear, eps: float = EPS) -> Column:
    return 10.0 * F.log10(at_least(linear, eps))


def to_linear(db) -> Column:
    return F.pow(F.lit(10.0), col(db) / 10.0)


def terrain_flatten(sigma0, incidence_deg=None, reference_deg: float = 40.0) -> Column:
    """Unchanged without a local incidence angle."""
    if incidence_deg is None:
        return col(sigma0)
    flat = col(sigma0) * F.cos(F.radians(F.lit(reference_deg))) / at_least(F.cos(F.radians(col(incidence_deg))), EPS)
    return F.when(col(incidence_deg).isNull(), col(sigma0)).otherwise(flat)


def features(vv, vh, in_db: bool = False, eps: float = EPS) -> dict[str, Column]:
    """vv and vh in dB, their ratio (linear, dB, and under a second name), and the radar vegetation index."""
    v, h = (to_linear(vv), to_linear(vh)) if in_db else (at_least(vv, 0.0), at_least(vh, 0.0))
    ratio = h / at_least(v, eps)
    ratio_db = to_db(h, eps) - to_db(v, eps)
    return {"vv": to_db(v, eps), "vh": to_db(h, eps), "vh_vv_ratio": ratio, "ratio_db": ratio_db, "cross_ratio_db": ratio_db, "rvi": 4.0 * h / at_least(v + h, eps)}


def edge_free(vv_db, vh_db, floor_db: float = -30.0) -> Column:
    return (col(vv_db) > floor_db) & (col(vh_db) > floor_db)


def ndvi_proxy(rvi) -> Column:
    return clip(0.55 + 0.45 * F.tanh(1.2 * col(rvi) - 0.6), 0.0, 1.0)


def features_db(vv_db, vh_db) -> dict[str, Column]:
    """The scene-server twin: the ratio as a difference in dB, the index from linear power."""
    v, h = to_linear(vv_db), to_linear(vh_db)
    return {"vh_vv_ratio": col(vh_db) - col(vv_db), "rvi": 4.0 * h / (v + h)}
