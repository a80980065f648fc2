"""Points in many polygons: a quadtree cover of each polygon, joined to the points' cells.

A polygon is covered by cells that lie wholly in it, as coarse as they can be, and
by cells of the finest resolution that its border touches. A point of an
interior cell is in the polygon by its key alone. A border cell keeps
the few edges that touch it and whether its reference point is inside: a point of it
is told by the edges that the way from there to the point crosses. So no ring is carried beyond the
first cells, and points meet polygons by equality of cells only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.core import col
from ..session import scratch, spread

#: Where the reference point of a cell lies in it: off the lines that coordinates tend to lie on.
REF_X, REF_Y = 0.4142135623730951, 0.5772156649015329
#: Degrees by which a cell is widened when edges are sought: an interior cell keeps that far from the border.
MARGIN = 1e-9
COVER = ["polygon_id", "level", "row", "col", "interior", "inside", "edges"]


def edges_of(ring: Column) -> Column:
    """The edges (x1, y1, x2, y2) of a ring of (lng, lat), which needn't repeat its first point."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, nxt, lambda a, b: F.struct(a["lng"].cast("double").alias("x1"), a["lat"].cast("double").alias("y1"), b["lng"].cast("double").alias("x2"), b["lat"].cast("double").alias("y2")))


def _at_y(e: Column, y: Column) -> Column:
    return (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]


def _at_x(e: Column, x: Column) -> Column:
    return (e["y2"] - e["y1"]) * (x - e["x1"]) / (e["x2"] - e["x1"]) + e["y1"]


def _between(v: Column, a: Column, b: Column) -> Column:
    return (v > F.least(a, b)) & (v <= F.greatest(a, b))


def odd_east(edges: Column, x: Column, y: Column) -> Column:
    """Ray casting over a whole ring: an odd number of edges lie to the east."""
    hit = lambda e: F.when((e["y1"] > y) != (e["y2"] > y), x < _at_y(e, y)).otherwise(False)
    return F.size(F.filter(edges, hit)) % 2 == 1


def odd_way(edges: Column, xa: Column, ya: Column, xb: Column, yb: Column) -> Column:
    """Whether the way from (xa, ya) east or west to xb, then north or south to yb, crosses an odd number of edges.

    A point on an edge counts as a hair to the east of it, as it does in ray casting.
    """
    flat = lambda e: F.when((e["y1"] > ya) != (e["y2"] > ya), _between(_at_y(e, ya), xa, xb)).otherwise(False)

    def steep(e):
        rises = (e["x2"] - e["x1"]) * (e["y2"] - e["y1"]) > 0
        above = lambda y: (_at_x(e, xb) > y) | ((_at_x(e, xb) == y) & rises)
        return F.when((e["x1"] > xb) != (e["x2"] > xb), above(ya) != above(yb)).otherwise(False)

    return F.aggregate(edges, F.lit(0), lambda n, e: n + flat(e).cast("int") + steep(e).cast("int")) % 2 == 1


def _touching(edges: Column, x0: Column, y0: Column, side: Column) -> Column:
    """The edges that touch a cell's box, or nearly do."""
    left, low, right, top = x0 - MARGIN, y0 - MARGIN, x0 + side + MARGIN, y0 + side + MARGIN

    def near(e):
        over = (F.least(e["x1"], e["x2"]) <= right) & (F.greatest(e["x1"], e["x2"]) >= left) & (F.least(e["y1"], e["y2"]) <= top) & (F.greatest(e["y1"], e["y2"]) >= low)
        turn = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        corners = [turn(x, y) for x in (left, right) for y in (low, top)]
        return over & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)

    return F.filter(edges, near)


def _placed(level: Column, row: Column, column: Column) -> tuple[Column, Column, Column]:
    side = geo.step(level)
    return column.cast("double") * side - 180.0, row.cast("double") * side - 90.0, side


def _shapes(polygons: DataFrame, polygon_id: str, ring: str) -> tuple[DataFrame, DataFrame]:
    """(shapes, members): each different ring once, as (shape, ring), and which polygons have it, as (polygon_id, shape).

    Rings without points or with a missing coordinate have no shape.
    """
    spark = polygons.sparkSession
    place = lambda p: F.struct(p["lng"].cast("double").alias("lng"), p["lat"].cast("double").alias("lat"))
    held = polygons.where((F.size(ring) > 0) & F.forall(F.col(ring), lambda p: p["lng"].isNotNull() & p["lat"].isNotNull())).select(F.col(polygon_id).alias("polygon_id"), F.transform(F.col(ring), place).alias("ring"))
    path = scratch(spark, "shapes")
    held.select("ring").distinct().select(F.monotonically_increasing_id().alias("shape"), "ring").write.parquet(path)
    shapes = spark.read.schema("shape long, ring array<struct<lng:double,lat:double>>").parquet(path)
    return shapes, held.join(shapes, "ring").select("polygon_id", "shape")


def _once(*columns: Column) -> Column:
    """The columns as a row of a generator, past which no filter is pushed that would compute them anew."""
    return F.inline(F.array(F.struct(*columns)))


def cover(polygons: DataFrame, finest: int = 9, coarsest: int = 0, polygon_id: str = "polygon_id", ring: str = "ring") -> DataFrame:
    """(polygon_id, level, row, col, interior, inside, edges): the cells of each polygon, no two of which overlap.

    Polygons are rings array<struct<lng, lat>> of the plane of degrees; one of fewer than three points,
    or with a missing coordinate, covers nothing. The cover of a polygon grows with its border, not with its
    area, and is written to the shared folder level by level.
    """
    spark = polygons.sparkSession
    whole = polygons.select(F.col(polygon_id).alias("polygon_id"), edges_of(F.col(ring)).alias("edges")).where((F.size(ring) >= 3) & F.forall(F.col(ring), lambda p: p["lng"].isNotNull() & p["lat"].isNotNull()))
    whole = spread(whole.where("size(edges) >= 3"), F.xxhash64("edges"))
    ends = lambda a, b, f: f(F.transform("edges", lambda e: e[a]))
    side = geo.step(F.lit(coarsest))
    spans = {n: (F.floor((ends(c, None, F.array_min) + o) / side), F.floor((ends(c, None, F.array_max) + o) / side)) for n, c, o in (("row", "y1", 90.0), ("col", "x1", 180.0))}
    cells = whole.select("*", F.explode(F.sequence(*spans["row"])).alias("row")).select("*", F.explode(F.sequence(*spans["col"])).alias("col")).withColumn("level", F.lit(coarsest))
    x0, y0, s = _placed(F.col("level"), F.col("row"), F.col("col"))
    cells = cells.select("polygon_id", "level", "row", "col", _once(odd_east(F.col("edges"), x0 + s * REF_X, y0 + s * REF_Y).alias("inside"), _touching(F.col("edges"), x0, y0, s).alias("edges")))
    parts = []
    for level in range(coarsest, finest + 1):
        path = scratch(spark, f"cover-{level}")
        held = cells.where((F.size("edges") > 0) | F.col("inside"))
        held.withColumn("interior", F.size("edges") == 0).write.partitionBy("interior").parquet(path)
        cells = spark.read.schema("polygon_id " + dict(whole.dtypes)["polygon_id"] + ", level int, row long, col long, inside boolean, edges array<struct<x1:double,y1:double,x2:double,y2:double>>, interior boolean").parquet(path)
        parts.append(cells if level == finest else cells.where("interior"))
        split = cells.where("not interior")
        quads = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
        split = split.select("*", F.explode(quads).alias("q")).withColumns({"up_row": F.col("row"), "up_col": F.col("col")})
        split = split.withColumns({"level": F.col("level") + 1, "row": F.col("row") * 2 + F.col("q.i"), "col": F.col("col") * 2 + F.col("q.j")})
        ux, uy, us = _placed(F.col("level") - 1, F.col("up_row"), F.col("up_col"))
        x0, y0, s = _placed(F.col("level"), F.col("row"), F.col("col"))
        crossed = odd_way(F.col("edges"), ux + us * REF_X, uy + us * REF_Y, x0 + s * REF_X, y0 + s * REF_Y)
        cells = split.select("polygon_id", "level", "row", "col", _once((F.col("inside") != crossed).alias("inside"), _touching(F.col("edges"), x0, y0, s).alias("edges")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*COVER)


def contained(points: DataFrame, covered: DataFrame, point_id: str, lng: str = "lng", lat: str = "lat", salts: int = 1) -> DataFrame:
    """(point_id, polygon_id) of every point in every polygon that holds it, once.

    A point meets a polygon in one cell at most. ``salts`` deals the points of a cell
    out to so many keys, at that many copies of the cover, for cells that hold a large share of the points
    (beyond what adaptive execution splits). Points without coordinates are in no polygon.
    """
    levels = [r["level"] for r in covered.select("level").distinct().collect()]  # as many as levels
    if not levels:
        return points.select(point_id).limit(0).crossJoin(covered.select("polygon_id").limit(0))
    x, y = col(lng).cast("double"), col(lat).cast("double")
    # rows and columns at each level follow from those at the finest
    keys = [F.struct(F.lit(n).alias("level"), F.floor((y + 90.0) / geo.step(F.lit(n))).alias("row"), F.floor((x + 180.0) / geo.step(F.lit(n))).alias("col")) for n in levels]
    salt = F.pmod(F.xxhash64(point_id), F.lit(salts)).cast("int")
    asked = points.where(x.isNotNull() & y.isNotNull()).select(point_id, x.alias("__x"), y.alias("__y"), salt.alias("salt"), F.inline(F.array(*keys)))
    held = covered.select(*COVER, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    met = asked.join(held, ["level", "row", "col", "salt"])
    x0, y0, s = _placed(F.col("level"), F.col("row"), F.col("col"))
    there = F.col("interior") | (F.col("inside") != odd_way(F.col("edges"), x0 + s * REF_X, y0 + s * REF_Y, F.col("__x"), F.col("__y")))
    return met.where(there).select(point_id, "polygon_id")


def within(points: DataFrame, polygons: DataFrame, point_id: str, finest: int = 9, polygon_id: str = "polygon_id", ring: str = "ring", lng: str = "lng", lat: str = "lat", salts: int = 1) -> DataFrame:
    """(point_id, polygon_id) of every point in every polygon that holds it, once.

    Each different place is held against each different shape: points at one place and polygons of one ring are told together.
    """
    held = points.where(F.col(lng).isNotNull() & F.col(lat).isNotNull()).select(F.col(point_id).alias("__id"), F.struct(F.col(lng).cast("double").alias("x"), F.col(lat).cast("double").alias("y")).alias("place"))
    places = held.select("place").distinct().select("place", "place.x", "place.y")
    shapes, members = _shapes(polygons, polygon_id, ring)
    pairs = contained(places, cover(shapes, finest, 0, "shape"), "place", "x", "y", salts).withColumnRenamed("polygon_id", "shape")
    named = pairs.join(members, "shape").select("place", "polygon_id")
    return held.join(named, "place").select(F.col("__id").alias(point_id), F.col("polygon_id").alias(polygon_id))


def cells_of(polygons: DataFrame, res: int = 9, polygon_id: str = "polygon_id", ring: str = "ring") -> DataFrame:
    """(polygon_id, cell): the cells whose centre lies in the polygon; of a polygon too small for any, the cell of its points' mean.

    Polygons of one ring are covered once.
    """
    shapes, members = _shapes(polygons, polygon_id, ring)
    return _cells_of(shapes.withColumnRenamed("shape", "polygon_id"), res).withColumnRenamed("polygon_id", "shape").join(members, "shape").select("polygon_id", "cell")


def _cells_of(polygons: DataFrame, res: int) -> DataFrame:
    ring = "ring"
    found = cover(polygons, res)
    x0, y0, s = _placed(F.col("level"), F.col("row"), F.col("col"))
    border = found.where("not interior").where(F.col("inside") != odd_way(F.col("edges"), x0 + s * REF_X, y0 + s * REF_Y, x0 + s * 0.5, y0 + s * 0.5)).select("polygon_id", "row", "col")
    times = F.expr(f"shiftleft(1, {int(res)} - level)")
    inner = lambda c: F.explode(F.sequence(F.col(c) * times, (F.col(c) + 1) * times - 1))
    whole = found.where("interior").select("polygon_id", "level", "row", inner("col").alias("c")).select("polygon_id", inner("row").alias("row"), F.col("c").alias("col"))
    named = F.format_string("f%02d%08x%08x", F.lit(res), "row", "col")
    cells = border.unionByName(whole).select("polygon_id", named.alias("cell"))
    mean = lambda k: F.aggregate(F.col(ring), F.lit(0.0), lambda t, p: t + p[k].cast("double")) / F.size(ring)
    small = polygons.select("polygon_id", geo.cell(mean("lat"), mean("lng"), res).alias("cell")).where("cell is not null")
    return cells.unionByName(small.join(cells.select("polygon_id").distinct(), "polygon_id", "left_anti"))
