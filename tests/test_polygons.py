"""The polygon cover and joins on it against plain ray casting."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldlark.operators import polygons

RING = "array<struct<lng:double,lat:double>>"


def inside(ring, x, y):
    n = 0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            n += 1
    return n % 2 == 1


def made(rnd, n):
    out = []
    for i in range(n):
        cx, cy, r = rnd.uniform(-150, 150), rnd.uniform(-60, 60), rnd.choice([0.05, 1, 8, 25])
        k = rnd.randint(3, 30)
        ring = [(cx + r * (0.4 + rnd.random()) * math.cos(2 * math.pi * j / k), cy + r * (0.4 + rnd.random()) * math.sin(2 * math.pi * j / k)) for j in range(k)]
        out.append((i, ring))
    # along the grid's own lines; crossing itself; with its first point repeated
    out += [(900, [(-60.0, -30.0), (0.0, -30.0), (0.0, 30.0), (-60.0, 30.0)]), (901, [(10.0, 10.0), (40.0, 40.0), (40.0, 10.0), (10.0, 40.0)]), (902, [(5.0, 5.0), (9.0, 5.0), (9.0, 9.0), (5.0, 5.0)])]
    return out


@pytest.mark.parametrize("finest,salts", [(0, 1), (3, 3), (6, 1)])
def test_points_in_polygons(spark, finest, salts):
    rnd = random.Random(finest)
    shapes = made(rnd, 40)
    pts = [(i, rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for i in range(1500)] + [(2000 + i, shapes[i][1][0][0] + rnd.gauss(0, 1), shapes[i][1][0][1] + rnd.gauss(0, 1)) for i in range(40) for _ in range(5)]
    pts += [(1, 5.5, 5.1), (3000, None, 1.0), (3001, 1.0, None)]
    bad = [(950, None), (951, []), (952, [(0.0, 0.0), (1.0, 1.0)]), (953, [(0.0, 0.0), (None, 1.0), (1.0, 1.0)])]
    df = spark.createDataFrame(shapes + bad, f"polygon_id long, ring {RING}")
    covered = polygons.cover(df, finest)
    points = spark.createDataFrame([(*p, "x") for p in pts], "id long, lng double, lat double, level string")
    got = Counter(map(tuple, polygons.contained(points, covered, "id", salts=salts).collect()))
    assert got == Counter((i, k) for i, x, y in pts for k, ring in shapes if x is not None and y is not None and inside(ring, x, y)) and got
    plan = polygons.contained(points, covered, "id", salts=salts)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
    assert polygons.contained(points, polygons.cover(df.limit(0), finest), "id").count() == 0


def test_cover_is_thin(spark):
    """Interior cells are few and coarse; the number of border cells follows the border."""
    ring = [(-40.0, -40.0), (40.3, -40.0), (40.3, 40.3), (-40.0, 40.3)]
    df = spark.createDataFrame([(1, ring)], f"polygon_id int, ring {RING}")
    n = {res: Counter(r.interior for r in polygons.cover(df, res).collect()) for res in (3, 5)}
    assert n[5][False] < 5 * n[3][False] and n[5][True] < 6 * n[3][True]
    area = sum((60 / 2**r.level) ** 2 for r in polygons.cover(df, 5).where("interior").collect())
    assert 0.9 * 80.3**2 < area < 80.3**2
    assert max(r.n for r in polygons.cover(df, 5).select(F.size("edges").alias("n")).collect()) <= 2


def test_cells_of_polygons(spark):
    rnd = random.Random(12)
    shapes = made(rnd, 25)
    df = spark.createDataFrame([*shapes, (960, [])], f"polygon_id long, ring {RING}")
    for res in (1, 4):
        side = 60 / 2**res
        want = Counter()
        for i, ring in shapes:
            xs, ys = [p[0] for p in ring], [p[1] for p in ring]
            own = {(r, c) for r in range(math.floor((min(ys) + 90) / side), math.floor((max(ys) + 90) / side) + 1) for c in range(math.floor((min(xs) + 180) / side), math.floor((max(xs) + 180) / side) + 1) if inside(ring, (c + 0.5) * side - 180, (r + 0.5) * side - 90)}
            if not own:
                own = {(math.floor((sum(ys) / len(ys) + 90) / side), math.floor((sum(xs) / len(xs) + 180) / side))}
            want.update((i, f"f{res:02d}{r:08x}{c:08x}") for r, c in own)
        assert Counter(map(tuple, polygons.cells_of(df, res).collect())) == want


def test_places_and_shapes_are_told_once(spark, monkeypatch):
    """Polygons of one ring are covered once and points at one place judged once; every pair still comes out, ids given twice too."""
    rnd = random.Random(8)
    shapes = made(rnd, 6)
    copies = [(1000 * k + i, ring) for k in range(20) for i, ring in shapes] + [(1000, shapes[1][1]), (970, None), (971, [(0.0, 0.0), (None, 1.0), (1.0, 1.0)])]
    places = [(rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for _ in range(60)] + [(ring[0][0] + 0.3, ring[0][1] - 0.2) for _, ring in shapes]
    pts = [(100 * k + i, x, y) for k in range(5) for i, (x, y) in enumerate(places)] + [(3, *places[-1]), (4000, None, 1.0)]
    covered, judged = [], []
    cover, contained = polygons.cover, polygons.contained
    monkeypatch.setattr(polygons, "cover", lambda p, *a: covered.append(p.count()) or cover(p, *a))
    monkeypatch.setattr(polygons, "contained", lambda p, *a: judged.append(p.count()) or contained(p, *a))
    points = spark.createDataFrame(pts, "id long, lng double, lat double")
    got = Counter(map(tuple, polygons.within(points, spark.createDataFrame(copies, f"polygon_id long, ring {RING}"), "id", 4).collect()))
    want = Counter((i, k) for i, x, y in pts for k, ring in copies if x is not None and ring and all(p[0] is not None for p in ring) and inside(ring, x, y))
    assert got == want and len(want) > 100
    assert covered == [len({tuple(ring) for _, ring in shapes})] and judged == [len(set(places))]


def test_cells_of_copies_are_found_once(spark, monkeypatch):
    shapes = made(random.Random(9), 3)
    rows = [(1000 * k + i, ring) for k in range(15) for i, ring in shapes]
    covered, cover = [], polygons.cover
    monkeypatch.setattr(polygons, "cover", lambda p, *a: covered.append(p.count()) or cover(p, *a))
    got = Counter(map(tuple, polygons.cells_of(spark.createDataFrame(rows, f"polygon_id long, ring {RING}").coalesce(1), 3).collect()))
    of = lambda k: Counter({c: n for (i, c), n in got.items() if i == k})
    assert covered == [len({tuple(ring) for _, ring in shapes})]
    assert all(of(i) and of(1000 * k + i) == of(i) for k in range(15) for i, _ in shapes)


def test_work_heavy_for_its_bytes_is_spread(spark):
    """A table of one small file is read by one task; the observations of its sensors are made by several."""
    from datetime import date

    from fieldlark.sources import tables

    sensors = spark.range(40).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("sensor")).coalesce(1)
    out = tables.synthetic(spark, sensors, "optical_sr", date(2024, 1, 1), date(2024, 3, 1), 2, 2, ("red",))
    counts = [n for n in out.rdd.glom().map(len).collect() if n]
    assert len(counts) > 4 and sum(counts) == 40 * 8
