import math

import pytest
from pyspark.sql import functions as F

from terracell.operators import nearby
from tests.conftest import rows

SCHEMA = "checkpoint_id bigint, lat double, lon double, id string, cell int, x string"


def arc(a, b):
    la, lo, lb, mo = map(math.radians, (a[0], a[1], b[0], b[1]))
    h = math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lo - mo) / 2) ** 2
    return 2 * nearby.EARTH_M * math.asin(math.sqrt(h))


def brute(points, radius):
    ok = [(i, a, o) for i, a, o in points if i is not None and a is not None and o is not None and -90 <= a <= 90 and -180 <= o <= 180 and (a, o) != (0, 0)]
    return sorted({(min(i, j), max(i, j)) for i, a, o in ok for j, b, p in ok if i < j and arc((a, o), (b, p)) <= radius}, key=repr)


def frame(spark, points):
    return spark.createDataFrame([(i, a, o, "q", 1, "z") for i, a, o in points], SCHEMA)


POINTS = [
    (1, 45.0, 5.0), (2, 45.0001, 5.0), (3, 45.0002, 5.0), (4, 45.0, 5.0), (5, None, 5.0), (6, 45.0, None),
    (7, 95.0, 5.0), (8, 0.0, 0.0), (9, 0.0, 0.0), (10, 45.0, 200.0), (11, 89.99999, 10.0), (12, 89.99999, -170.0),
    (13, 10.0, 179.99999), (14, 10.0, -179.99999), (15, -45.0, 5.0), (16, 45.00013, 5.00001), (None, 45.0, 5.0),
]


def test_pairs_match_brute_force(spark):
    got = rows(nearby.pairs_within(frame(spark, POINTS), "checkpoint_id", "lat", "lon", 15.0))
    assert got == brute(POINTS, 15.0)
    assert (11, 12) in got and (13, 14) in got and (1, 4) in got


def test_crowded_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(nearby, "HOT_CELL", 50)
    crowd = [(k, 45.0 + (k % 20) * 1e-5, 5.0 + (k // 20) * 1e-5) for k in range(1, 301)]
    assert rows(nearby.pairs_within(frame(spark, crowd), "checkpoint_id", "lat", "lon", 3.0)) == brute(crowd, 3.0)


def test_empty_table(spark):
    assert rows(nearby.pairs_within(frame(spark, []), "checkpoint_id", "lat", "lon", 15.0)) == []


def test_same_id_twice_is_no_pair(spark):
    assert rows(nearby.pairs_within(frame(spark, [(1, 45.0, 5.0), (1, 45.0, 5.0)]), "checkpoint_id", "lat", "lon", 15.0)) == []


@pytest.mark.parametrize("few", [100_000, 0])
def test_wide_radius_and_many_crowded_cells(spark, monkeypatch, few):
    monkeypatch.setattr(nearby, "HOT_CELL", 20)
    monkeypatch.setattr(nearby, "FEW_CELLS", few)
    crowd = [(k, 45.0 + (k % 12) * 2e-3, 5.0 + (k // 12) * 3e-3) for k in range(1, 121)]
    assert rows(nearby.pairs_within(frame(spark, crowd), "checkpoint_id", "lat", "lon", 800.0)) == brute(crowd, 800.0)


def test_regions(spark):
    outlines = [("notch", [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [2.0, 1.0], [0.0, 4.0]]), ("box", [[4.0, 0.0], [6.0, 0.0], [6.0, 2.0], [4.0, 2.0]]), ("none", None)]
    regions = spark.createDataFrame(outlines, "name string, corners array<array<double>>")
    points = frame(spark, [(1, 1.0, 1.0), (2, 3.0, 2.0), (3, 1.0, 4.0), (4, None, 1.0), (5, 0.0, 2.0)])
    got = rows(nearby.regions_of_points(points, "checkpoint_id", "lon", "lat", regions, "name", "corners"))
    assert got == [(1, "notch"), (3, "box"), (3, "notch"), (5, "notch")]
    assert rows(nearby.regions_of_points(points.limit(0), "checkpoint_id", "lon", "lat", regions, "name", "corners")) == []
    assert rows(nearby.regions_of_points(points, "checkpoint_id", "lon", "lat", regions.where("false"), "name", "corners")) == []


def test_regions_in_blocks(spark):
    regions = spark.createDataFrame([(f"r{k}", [[float(k), 0.0], [k + 2.0, 0.0], [k + 2.0, 1.0], [float(k), 1.0]]) for k in range(9)], "name string, corners array<array<double>>")
    points = frame(spark, [(k, 0.5, k + 0.5) for k in range(10)])
    whole = rows(nearby.regions_of_points(points, "checkpoint_id", "lon", "lat", regions, "name", "corners"))
    assert len(whole) == 18 and rows(nearby.regions_of_points(points, "checkpoint_id", "lon", "lat", regions, "name", "corners", block=2)) == whole


def test_repartitioning_changes_nothing(spark, sf):
    df = spark.read.parquet(f"{sf}/terrain_checkpoints.parquet")
    a = rows(nearby.pairs_within(df, "checkpoint_id", "lat", "lon", 15.0))
    assert a == rows(nearby.pairs_within(df.repartition(7).orderBy(F.desc("checkpoint_id")), "checkpoint_id", "lat", "lon", 15.0))
