"""Optical preprocessing: cloud masks, reflectance scaling, bandpass harmonisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import clip, col, finite, lookup

#: Scene classes that are no clear surface.
INVALID_SCL = (0, 1, 2, 3, 8, 9, 10)
#: Fixed values: (slope, intercept) of each band, and other names of bands.
BANDPASS = {"blue": (0.9778, -0.0040), "green": (1.0053, -0.0009), "red": (0.9765, 0.0009), "nir": (0.9983, -0.0001), "swir1": (0.9987, -0.0011), "swir2": (1.0030, -0.0012)}
BAND_NAMES = {
    "b": "blue", "b2": "blue", "g": "green", "b3": "green", "r": "red", "b4": "red", "n": "nir", "nir8": "nir", "b8": "nir", "b8a": "nir",
    "swir": "swir1", "swir16": "swir1", "b11": "swir1", "swir22": "swir2", "b12": "swir2",
}


def scl_valid(scl, invalid=INVALID_SCL) -> Column:
    return ~col(scl).isin(*invalid)


def score_valid(score, threshold: float = 0.6) -> Column:
    """A missing score counts as cloudy."""
    return F.coalesce(finite(score), F.lit(0.0)) >= threshold


def qa_clear(qa, cloud_bit: int = 3, shadow_bit: int = 4) -> Column:
    bit = lambda b: F.shiftright(col(qa), b).bitwiseAND(F.lit(1)) == 0
    return bit(cloud_bit) & bit(shadow_bit)


def landsat_clear(qa) -> Column:
    """Dilated cloud, cirrus, cloud and shadow bits (1-4) all unset."""
    return col(qa).bitwiseAND(F.lit(30)) == 0


def masked(band, valid: Column) -> Column:
    return F.when(valid, col(band))


def scale_reflectance(dn, scale: float = 1e-4, offset: float = 0.0, bounded: bool = True) -> Column:
    x = col(dn) * scale + offset
    return clip(x, 0.0, 1.0) if bounded else x


def scale_landsat(dn, bounded: bool = True) -> Column:
    return scale_reflectance(dn, 2.75e-5, -0.2, bounded)


def band_name(name) -> Column:
    """The canonical name of a band or one of its other names; NULL for an unknown one."""
    key = F.lower(F.trim(col(name)))
    return F.when(key.isin(*BANDPASS), key).otherwise(lookup(BAND_NAMES, key))


def harmonise(reflectance, band, bounded: bool = True) -> Column:
    """Sentinel-2 to OLI bandpass; ``band`` a literal name or a column of names."""
    if isinstance(band, str) and band.lower() in BANDPASS | BAND_NAMES:
        slope, intercept = BANDPASS[BAND_NAMES.get(band.lower(), band.lower())]
        x = col(reflectance) * slope + intercept
    else:
        name = band_name(band)
        x = col(reflectance) * lookup({k: v[0] for k, v in BANDPASS.items()}, name) + lookup({k: v[1] for k, v in BANDPASS.items()}, name)
    return clip(x, 0.0, 1.0) if bounded else x


def cross_calibrate(source, gain, bias) -> Column:
    return col(gain) * col(source) + col(bias)
