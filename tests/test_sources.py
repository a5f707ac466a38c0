import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.operators import grid, model
from terracell.plans import suitability
from terracell.sources import geotiff, sinks, vector
from tests.conftest import rows


def test_elevation_model_round_trip(spark, tmp_path):
    band = np.arange(12, dtype=np.float32).reshape(3, 4)
    band[0, 0], band[1, 1], band[2, 3] = np.nan, -9999, 9500
    path = tmp_path / "dem.tif"
    path.write_bytes(geotiff.encode(band, (700_000.0, 6_600_000.0), 10.0, -9999))
    got = {(r.ix, r.iy): r for r in geotiff.read_dem(spark, str(path)).collect()}
    assert len(got) == 12 and got[1, 0].z == 1.0 and got[1, 0].x == 700_015.0 and got[0, 1].y == 6_599_985.0
    assert all(got[c].z is None for c in ((0, 0), (1, 1), (3, 2)))
    out = tmp_path / "out.tif"
    geotiff.write_band(geotiff.read_dem(spark, str(path)), "z", str(out), (700_000.0, 6_600_000.0), 10.0)
    again, info = geotiff.decode(out.read_bytes())
    assert info["nodata"] == -9999 and again[0, 1] == 1.0 and again[0, 0] == -9999


def test_lzw():
    # "-----" with clear and end codes: 256, 45, 258, 258, 257 in nine bits
    bits = "".join(f"{c:09b}" for c in (256, 45, 258, 258, 257)).ljust(48, "0")
    assert geotiff._unlzw(int(bits, 2).to_bytes(6, "big")) == b"-----"
    with pytest.raises(ValueError):
        geotiff.decode(b"II\0\0\0\0\0\0")


def save(path, value):
    path.write_text(json.dumps(value, ensure_ascii=False))
    return str(path)


def test_features(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"ESSENCE": "Hêtre", "TFV": "x"}, "geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 2.5], [1, 4], [1, 2]]]}},
        {"type": "Feature", "properties": {"species": None}, "geometry": None},
    ]
    df = vector.geojson(spark, save(tmp_path / "f.json", {"type": "FeatureCollection", "features": features}))
    assert rows(df.select("kind", "xmin", "ymin", "xmax", "ymax")) == sorted([("Polygon", 1.0, 2.0, 3.0, 4.0), (None, None, None, None, None)], key=repr)
    assert rows(vector.normal_forest(df, "s").select("essence", "essence_canonical", "tree_score", "source")) == sorted([("Hêtre", "hetre", 0.3, "s"), (None, "unknown", 0.25, "s")], key=repr)
    assert vector.in_box(df, 0, 0, 1, 2).count() == 1 and vector.in_box(df, 4, 0, 5, 2).count() == 0
    assert {r.geology_canonical for r in vector.normal_geology(df, "s").collect()} == {"unknown"}
    assert {(r.nom, r.water_type_key) for r in vector.normal_water(df, "s").collect()} == {("Sans nom", "unknown")}


def test_elements_observations_points_forecast(spark, tmp_path):
    node = [{"lat": 45.0, "lon": 5.0}, {"lat": 45.1, "lon": 5.2}]
    elements = [{"type": "way", "id": 1, "tags": {"waterway": "river"}, "geometry": node}, {"type": "way", "id": 1, "tags": {"waterway": "river"}, "geometry": node},
                {"type": "way", "id": 2, "tags": {"tunnel": "yes"}, "geometry": node}, {"type": "way", "id": 3, "tags": {"layer": "-1"}, "geometry": node}]
    got = vector.map_elements(spark, save(tmp_path / "e.json", {"elements": elements}))
    assert rows(got.select("id", "xmin", "ymax")) == [(1, 5.0, 45.1)]
    boxes = [{"nom": "a", "xmin": 1, "xmax": 2, "ymin": 3, "ymax": 4, "score_override": 0.9}, {"nom": "b", "essences": {"Frêne": 0.5, "Orme": 0.5}}]
    assert [(s, round(v, 4)) for s, v in rows(vector.observations(spark, save(tmp_path / "o.json", boxes)).select("seq", "score"))] == [(0, 0.9), (1, 0.975)]
    points = {"results": [{"id": 1, "location": "45.1,5.2", "quality_grade": "research"}, {"id": 2, "location": "bad"}, {"id": 3, "location": "45.2,5.3", "quality_grade": "needs_id"}]}
    assert rows(vector.citizen_points(spark, save(tmp_path / "c.json", points)).select("seq", "lat", "value")) == [(0, 45.1, 0.9), (2, 45.2, 0.75)]
    days = {"data_day": {"time": ["2024-01-01", "2024-01-02"], "temperature_mean": [3.0, None], "precipitation": [1.0]}}
    got = vector.forecast(spark, save(tmp_path / "w.json", days)).select(F.col("day").cast("string"), "t", "rain", "rh")
    assert rows(got) == [("2024-01-01", 3.0, 1.0, 70.0), ("2024-01-02", 10.0, 0.0, 70.0)]


def test_sinks(spark, sf, tmp_path):
    regions = suitability._clusters(spark, "/root/testdata/sf0.01").withColumns({"x": F.col("x") + 900_000, "y": F.col("y") + 6_500_000, "altitude": F.lit(None).cast("double")})
    table = sinks.hotspot_table(regions, 0.8, top=5)
    assert table.columns == list(sinks.HOTSPOT_COLUMNS)
    got = table.orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and all(a.mean_score >= b.mean_score for a, b in zip(got, got[1:], strict=False))
    sinks.write_hotspots(table, str(tmp_path / "h"))
    assert spark.read.option("header", True).csv(str(tmp_path / "h")).count() == len(got)
    cells = suitability.scored_cells(spark, sf)
    document = json.loads(sinks.report(model.run_stats(cells, "score"), table, "zone").first().value)
    assert document["zone"] == "zone" and len(document["hotspots"]) == len(got) and document["statistics"]["n_cells"] == 1500
    sinks.export_cells(cells, str(tmp_path / "g"), 10.0, 0.0, 0.0, 0.3)
    assert spark.read.parquet(str(tmp_path / "g")).where("score < 0.3 or prob_label is null").count() == 0
    coded = spark.createDataFrame([(0.5, 200.0), (None, None)], "s double, a double").select(*[c.alias(k) for k, c in sinks.data_channels(F.col("s"), F.col("a")).items()])
    assert rows(coded) == sorted([(100, 2, 188), (255, 0, 0)], key=repr)


def test_projection_and_grid(spark):
    df = spark.createDataFrame([(46.5, 3.0), (45.0001, 5.0)], "lat double, lon double")
    x, y = grid.to_metric(F.col("lat"), F.col("lon"))
    there = df.withColumns({"x": x, "y": y})
    assert [(round(r.x, 1), round(r.y, 1)) for r in there.collect()] == [(700000.0, 6600000.0), (857581.6, 6435425.9)]
    lat, lon = grid.to_degrees(F.col("x"), F.col("y"))
    assert [(round(r.a, 9), round(r.b, 9)) for r in there.select(lat.alias("a"), lon.alias("b")).collect()] == [(46.5, 3.0), (45.0001, 5.0)]
    cells = grid.cells(spark, 0, 0, 100, 50, 10)
    assert cells.count() == 50 and cells.where("ix = 0 and iy = 0").first().y == 45.0 and cells.where("ix = 9 and iy = 4").first().x == 95.0
    ix, iy = grid.cell_of(F.lit(101.0), F.lit(51.0), 0, 50, 10, 10, 5)
    assert cells.select(ix.alias("a"), iy.alias("b")).first() == (9, 0)
    assert [grid.auto_cell_size(a) for a in (500, 501, 7363, 9000)] == [5.0, 10.0, 50.0, 100.0]
    assert grid.grid_size((1000, 500), 10)["cells"] == 5000


def test_stream_of_events(spark, sf, tmp_path):
    from terracell.streaming.live import daily_measures

    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    started = daily_measures(stream).writeStream.outputMode("append").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    started.awaitTermination(120)
    final, whole = spark.table("days"), daily_measures(events)
    assert 0 < final.count() <= whole.count() and final.exceptAll(whole).count() == 0
