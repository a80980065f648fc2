"""Spectral indices; each is NULL where its denominator vanishes or an input is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import col, safe_divide


def normalised_difference(a, b) -> Column:
    return safe_divide(col(a) - col(b), col(a) + col(b))


def ndvi(nir, red):
    return normalised_difference(nir, red)


def evi(nir, red, blue, g=2.5, c1=6.0, c2=7.5, l=1.0):  # noqa: E741
    return safe_divide(g * (col(nir) - col(red)), col(nir) + c1 * col(red) - c2 * col(blue) + l)


def evi2(nir, red, g=2.5, c=2.4, l=1.0):  # noqa: E741
    return safe_divide(g * (col(nir) - col(red)), col(nir) + c * col(red) + l)


def savi(nir, red, l=0.5):  # noqa: E741
    return safe_divide((1.0 + l) * (col(nir) - col(red)), col(nir) + col(red) + l)


def msavi(nir, red):
    a = 2.0 * col(nir) + 1.0
    inside = a * a - 8.0 * (col(nir) - col(red))
    return F.when(inside >= 0, (a - F.sqrt(inside)) / 2.0)


def gcvi(nir, green):
    return safe_divide(nir, green) - 1.0


def ndre(nir, red_edge):
    return normalised_difference(nir, red_edge)


def ndwi_gao(nir, swir1):
    return normalised_difference(nir, swir1)


def ndwi_mcfeeters(green, nir):
    return normalised_difference(green, nir)


def ndmi(nir_n, swir1):
    return normalised_difference(nir_n, swir1)


def nmdi(nir, swir1, swir2):
    d = col(swir1) - col(swir2)
    return safe_divide(col(nir) - d, col(nir) + d)


def psri(red, blue, red_edge):
    return safe_divide(col(red) - col(blue), red_edge)


def sar_rvi(vv, vh):
    return safe_divide(4.0 * col(vh), col(vv) + col(vh))


def sar_cross_ratio(vv, vh):
    return safe_divide(vh, vv)


def str_index(swir):
    return safe_divide((1.0 - col(swir)) * (1.0 - col(swir)), 2.0 * col(swir))


#: Each index by name: the function and the bands it needs, in order.
RECIPES = {
    "ndvi": (ndvi, ("nir", "red")),
    "evi": (evi, ("nir", "red", "blue")),
    "evi2": (evi2, ("nir", "red")),
    "savi": (savi, ("nir", "red")),
    "msavi": (msavi, ("nir", "red")),
    "gcvi": (gcvi, ("nir", "green")),
    "ndre": (ndre, ("nir", "red_edge")),
    "ndwi_gao": (ndwi_gao, ("nir", "swir1")),
    "ndwi_mcfeeters": (ndwi_mcfeeters, ("green", "nir")),
    "ndmi": (ndmi, ("nir_n", "swir1")),
    "nmdi": (nmdi, ("nir", "swir1", "swir2")),
    "psri": (psri, ("red", "blue", "red_edge")),
    "sar_rvi": (sar_rvi, ("vv", "vh")),
    "sar_cross_ratio": (sar_cross_ratio, ("vv", "vh")),
    "str": (str_index, ("swir1",)),
}


def available(columns, which=None) -> dict[str, Column]:
    """Every wanted index whose bands are among ``columns``; others, and unknown names, are skipped."""
    have = set(columns)
    names = RECIPES if which is None else [n for n in which if n in RECIPES]
    return {n: RECIPES[n][0](*RECIPES[n][1]) for n in names if have.issuperset(RECIPES[n][1])}


def stack(df: DataFrame, which=None) -> DataFrame:
    return df.withColumns(available(df.columns, which))


def server_set(nir="nir", red="red", blue="blue", green="green", swir1="swir1", swir2="swir2") -> dict[str, Column]:
    """The scene-server twin of five indices: broad NIR in ndmi, swir2 in str with a floored denominator."""
    den = 2.0 * col(swir2)
    return {
        "ndvi_s": normalised_difference(nir, red),
        "evi_s": evi(nir, red, blue),
        "ndwi_s": normalised_difference(green, nir),
        "ndmi_s": normalised_difference(nir, swir1),
        "str_s": (1.0 - col(swir2)) * (1.0 - col(swir2)) / F.when(den < 1e-4, F.lit(1e-4)).otherwise(den),
    }
