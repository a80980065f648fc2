"""Cells of a latitude/longitude quadtree, polygons, and Web-Mercator tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col



def step(res) -> Column:
    """Side of a cell in degrees."""
    return 60.0 / F.pow(F.lit(2.0), F.greatest(col(res), F.lit(0)).cast("double"))


def _named(res, row: Column, column: Column) -> Column:
    return F.format_string("f%02d%08x%08x", col(res).cast("int"), row.cast("long"), column.cast("long"))


def cell(lat, lng, res=9) -> Column:
    """The cell's token: resolution, row and column."""
    return _named(res, F.floor((col(lat) + 90.0) / step(res)), F.floor((col(lng) + 180.0) / step(res)))


def parts(token) -> tuple[Column, Column, Column]:
    """(resolution, row, column) of a token."""
    t = col(token)
    number = lambda at: F.conv(F.substring(t, at, 8), 16, 10).cast("long")
    return F.substring(t, 2, 2).cast("int"), number(4), number(12)


def centre(token) -> tuple[Column, Column]:
    res, row, column = parts(token)
    s = step(res)
    return (row.cast("double") + 0.5) * s - 90.0, (column.cast("double") + 0.5) * s - 180.0


def parent(token, res=None) -> Column:
    """The cell that holds this one's centre, one resolution up unless told otherwise."""
    own, _, _ = parts(token)
    to = F.greatest(own - 1 if res is None else col(res), F.lit(0))
    lat, lng = centre(token)
    return cell(lat, lng, to)


def children(token) -> Column:
    """The four cells one resolution down, sorted."""
    res, row, column = parts(token)
    return F.array_sort(F.array(*[_named(res + 1, row * 2 + i, column * 2 + j) for i in (0, 1) for j in (0, 1)]))


def disk(token, k: int = 1) -> Column:
    """The (2k+1) x (2k+1) block around a cell, sorted: columns go on around the globe, rows end at the poles."""
    res, row, column = parts(token)
    rows, columns = (F.round(d / step(res)).cast("long") for d in (180.0, 360.0))
    around = F.sequence(F.lit(-k), F.lit(k))
    held = F.filter(F.transform(around, lambda i: row + i), lambda r: (r >= 0) & (r < rows))
    block = F.flatten(F.transform(held, lambda r: F.transform(around, lambda j: _named(res, r, F.pmod(column + j, columns)))))
    return F.array_sort(F.array_distinct(block))


def inside(lng, lat, ring: list[tuple[float, float]]) -> Column:
    """Ray casting: an odd number of edges lie to the east."""
    x, y = col(lng), col(lat)
    crossed = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            at = (x2 - x1) * (y - y1) / (y2 - y1) + x1
            crossed = crossed + (((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at)).cast("int")
    return crossed % 2 == 1


def tile_bounds(z, x, y) -> dict[str, Column]:
    n = F.pow(F.lit(2.0), col(z).cast("double"))
    lat = lambda t: F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * t / n))))
    return {"west": col(x) / n * 360.0 - 180.0, "south": lat(col(y) + 1), "east": (col(x) + 1) / n * 360.0 - 180.0, "north": lat(col(y))}


def tile(lng, lat, z: int) -> tuple[Column, Column]:
    n = 2**z
    x = ((col(lng) + 180.0) / 360.0 * float(n)).cast("int")
    r = F.radians(col(lat))
    y = ((1.0 - F.asinh(F.tan(r)) / math.pi) / 2.0 * float(n)).cast("int")
    held = lambda c: F.greatest(F.lit(0), F.least(F.lit(n - 1), c))
    return held(x), held(y)


def unit_hash(*parts_) -> Column:
    """A number in [0, 1) from the SHA-256 of the parts joined by slashes."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("/", *[col(p) if isinstance(p, Column) else F.lit(p) for p in parts_]), 256), 1, 12), 16, 10)
    return (h.cast("long") % 10000) / 10000.0
