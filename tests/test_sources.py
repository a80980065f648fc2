"""Data sources of the library's own: scenes, chunks, exports, feature collections."""

from __future__ import annotations

import json
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlark.sources import chunks, exports, features, items


def test_items_are_pruned_while_planning(spark, tmp_path):
    day = date(2024, 1, 1)
    rows = [(f"c{i % 3}", day + timedelta(days=i % 40), float(i * 7 % 360 - 180), float(i * 13 % 160 - 80), float(i), None if i % 5 == 0 else f"s{i}") for i in range(4000)]
    rows += [("c0", None, 1.0, 2.0, 3.0, "no day"), ("c1", day, float("nan"), 5.0, 1.0, "no place"), (None, day, 1.0, 1.0, 1.0, "x")]
    df = spark.createDataFrame(rows, "collection string, date date, lng double, lat double, nir double, tag string")
    path = f"file://{tmp_path}/scenes"
    items.write_items(df, path, [F.col("collection"), F.col("date"), F.floor(F.col("lng") / 60)], ["collection", "date", "lng", "lat"], ["lat"])
    whole = items.read_items(spark, path, split=1)
    files = whole.rdd.getNumPartitions()
    assert Counter(map(tuple, whole.drop("lng").collect())) == Counter((r[0], r[1], *r[3:]) for r in rows)
    c = F.col
    asked = {
        "day": c("date") == F.lit(day + timedelta(days=3)), "days": c("date").between(F.lit(day), F.lit(day + timedelta(days=1))), "kind": c("collection") == "c1", "kinds": c("collection").isin("c1", "c9"),
        "box": (c("lng") >= -10) & (c("lng") < 5) & (c("lat") > 70), "never": c("date") > F.lit(date(2030, 1, 1)), "far": c("lng") > 1000, "mixed": (c("collection") == "c2") & (c("date") < F.lit(day + timedelta(days=2))) & c("tag").isNotNull(),
    }
    for name, where in asked.items():
        got = whole.where(where)
        assert Counter(str(tuple(r)) for r in got.collect()) == Counter(str(tuple(r)) for r in df.where(where).collect()), name
        assert got.rdd.getNumPartitions() < files / 2, name
    assert whole.where(asked["never"]).rdd.getNumPartitions() == 1
    assert items.read_items(spark, path, ["date", "nir"]).columns == ["date", "nir"]
    assert items.read_items(spark, path).rdd.getNumPartitions() == 1  # small files share a partition
    items.write_items(df.limit(0), path, [F.col("date")], ["date"])
    assert items.read_items(spark, path).count() == 0


def test_chunk_coding_loses_nothing():
    rng = np.random.default_rng(1)
    for cells, days in ((1, 1), (3, 50), (40, 512)):
        values = np.cumsum(rng.normal(size=(cells, days)), 1).round(2)
        there = rng.random((cells, days)) < 0.8
        values[0, 0] = -0.0
        got, held = chunks.decoded(chunks.coded(values, there), cells, days)
        assert np.array_equal(held, there) and np.array_equal(got[there], values[there]) and not np.signbit(got[0, 0]) != np.signbit(-0.0) * there[0, 0]
    slow = np.repeat(rng.random((100, 8)), 64, axis=1)
    assert len(chunks.coded(slow, np.ones(slow.shape, bool))) < slow.nbytes / 20


def test_chunks_round_trip_and_keyed_reads(spark, tmp_path):
    day = date(2023, 11, 1)
    rows = [(f"k{k:03d}", day + timedelta(days=3 * i + k % 3), float(k) + i / 7 if (k + i) % 6 else None, i if i % 4 else None) for k in range(60) for i in range(90)]
    df = spark.createDataFrame(rows, "cell string, day date, vi double, n int").repartition(4)
    path = f"file://{tmp_path}/chunks"
    chunks.write_chunks(df, path, "cell", F.substring("cell", 1, 3), "day", ["vi", "n"], 64)
    whole = chunks.read_chunks(spark, path)
    assert whole.dtypes == [("cell", "string"), ("day", "date"), ("vi", "double"), ("n", "double")]
    want = Counter((c, d, v, None if n is None else float(n)) for c, d, v, n in rows)
    assert Counter(map(tuple, whole.collect())) == want
    one = whole.where((F.col("cell") == "k017") & F.col("day").between(F.lit(date(2024, 1, 1)), F.lit(date(2024, 1, 31))))
    assert Counter(map(tuple, one.collect())) == Counter({r: n for r, n in want.items() if r[0] == "k017" and date(2024, 1, 1) <= r[1] <= date(2024, 1, 31)})
    assert chunks.read_chunks(spark, path, ["n", "cell"]).where("cell in ('k001', 'k059')").count() == 180

    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

    def planned(*filters):
        src = chunks.Chunks({"path": path})
        reader = src.reader(whole.schema)
        assert reader.pushFilters(list(filters)) == list(filters)
        places = [p for r in reader.partitions() for p in r.places]
        return len(places), sum(p[2] for p in places)

    every = planned()
    keyed = planned(EqualTo(("cell",), "k017"), GreaterThanOrEqual(("day",), date(2024, 6, 1)))
    assert keyed[0] == 2 and keyed[1] < every[1] / 10  # of one block, the chunks since then
    chunks.write_chunks(df.limit(0), path, "cell", F.col("cell"), "day", ["vi"])
    assert chunks.read_chunks(spark, path).count() == 0 and len(list((tmp_path / "chunks").iterdir())) == 2


def test_a_failed_write_leaves_the_store_as_it_was(spark, tmp_path):
    day = date(2024, 1, 1)
    df = spark.createDataFrame([(1, day, 1.0), (2, day, 2.0)], "cell long, date date, vi double")
    path = f"file://{tmp_path}/kept"
    chunks.write_chunks(df, path, "cell", F.col("cell"), "date", ["vi"])
    before = sorted(p.name for p in (tmp_path / "kept").iterdir())
    for bad in (df.union(df), spark.createDataFrame([(None, day, 1.0)], df.schema)):
        with pytest.raises(Exception, match="more than one row|a row without"):
            chunks.write_chunks(bad, path, "cell", F.col("cell"), "date", ["vi"])
    assert sorted(p.name for p in (tmp_path / "kept").iterdir()) == before
    assert chunks.read_chunks(spark, path).count() == 2


def test_exports_hold_as_a_whole(spark, tmp_path):
    day = date(2024, 1, 1)
    rows = [(day + timedelta(days=8 * (i % 70)), i, float(i % 17), None if i % 3 else "x") for i in range(3000)] + [(None, 1, 1.0, "no window")]
    df = spark.createDataFrame(rows, "window_start date, cell long, lat double, note string").repartition(3)
    path = f"file://{tmp_path}/export"
    exports.write_export(df, path, "window_start", ["lat", "cell"], ["cell"])
    first = {day + timedelta(days=8 * k) for k in range(64)}
    want = [r for r in rows if r[0] in first]
    assert Counter(map(tuple, exports.read_export(spark, path).collect())) == Counter(want)
    said = exports.manifest(spark, path)
    got = {r.window: tuple(r)[1:] for r in said.groupBy("window").agg(F.sum("n"), F.min("least_lat"), F.max("most_lat"), F.min("least_cell"), F.max("most_cell")).collect()}
    of = {w: [r for r in want if r[0] == w] for w in first}
    assert got == {w: (len(v), min(r[2] for r in v), max(r[2] for r in v), min(r[1] for r in v), max(r[1] for r in v)) for w, v in of.items()}
    assert all((tmp_path / "export" / next(p.name for p in (tmp_path / "export").iterdir() if p.is_dir()) / r.file).exists() for r in said.collect())
    two = [day, day + timedelta(days=16)]
    assert Counter(map(tuple, exports.read_export(spark, path, two).collect())) == Counter(r for r in want if r[0] in two)
    # a task fails: the former export is still there, and nothing else
    before = sorted(p.name for p in (tmp_path / "export").iterdir())
    bad = df.withColumn("lat", F.when(F.col("cell") == 2999, F.raise_error(F.lit("broken scene")).cast("double")).otherwise(F.col("lat")))
    with pytest.raises(Exception, match="broken scene"):
        exports.write_export(bad, path, "window_start", most=None)
    assert sorted(p.name for p in (tmp_path / "export").iterdir()) == before
    assert exports.read_export(spark, path).count() == len(want)
    exports.write_export(df, path, "window_start", most=None)
    assert exports.read_export(spark, path).count() == 3000
    exports.write_export(df.limit(0), path, "window_start", ["lat"])
    assert exports.read_export(spark, path).count() == 0 and exports.manifest(spark, path).count() == 0


@pytest.mark.parametrize("split", [1 << 20, 997, 64, 7])
def test_features_of_any_split(spark, tmp_path, split):
    """Brackets and marks within strings, backslashes at borders, members in any order, objects that are no features."""
    rng = np.random.default_rng(5)
    names = ['plain', 'a } ] { [', 'say \\"hi\\"', 'back\\\\', '\\\\\\"{', 'é👍 ü', '{\\"type\\": \\"Feature\\"}']
    want, parts = Counter(), []
    for i in range(120):
        raw = names[int(rng.integers(len(names)))]
        name = json.loads(f'"{raw}"')
        series = [round(float(x), 2) for x in rng.random(rng.integers(0, 4))]
        own = [f'"properties": {{"name": "{raw}", "dr_series": {json.dumps(series)}, "deep": {{"x": [[1, {{"y": 2}}]]}}}}', '"type": "Feature"', f'"id": {i}', '"geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [1, 2]]]}']
        parts.append("{" + (", " if i % 2 else ",\n ").join(own[k] for k in rng.permutation(4)) + "}")
        want[i, name, tuple(series)] += 1
    parts.insert(3, '{"type": "Other", "id": 999}')
    half = len(parts) // 2
    for k, some in enumerate((parts[:half], parts[half:])):
        text = '{"type": "FeatureCollection", "crs": {"properties": {"name": "[{"}}, "features": [' + ",\n".join(some) + "]}"
        (tmp_path / f"f{k}.geojson").write_text(text, encoding="utf-8")
    if split < 50:
        (tmp_path / "f0.geojson").unlink()
        want = Counter({r: n for r, n in want.items() if r[0] >= half - 1})
        split = len(text.encode()) // 40 + 1
    got = features.read_features(spark, str(tmp_path), "id long, properties struct<name:string,dr_series:array<double>>", split)
    assert got.columns == ["id", "properties"]
    assert Counter((r.id, r.properties.name, tuple(r.properties.dr_series)) for r in got.collect()) == want


def test_features_of_empty_collections(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    (tmp_path / "b.geojson").write_text("")
    assert features.read_features(spark, str(tmp_path), "id long").count() == 0
