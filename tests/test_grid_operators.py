import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.functions import curves
from terracell.operators import focal, graph, model, weather


def frame(spark, array, name="v"):
    rows = [(x, y, None if np.isnan(array[y, x]) else float(array[y, x])) for y in range(array.shape[0]) for x in range(array.shape[1])]
    return spark.createDataFrame(rows, f"ix int, iy int, {name} double")


def back(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["iy"], r["ix"]] = np.nan if r[name] is None else float(r[name])
    return out


RNG = np.random.default_rng(5)
RANDOM = RNG.random((13, 17))


@pytest.mark.parametrize("tile", [None, 4, 7])
def test_distance_across_tiles(spark, tile, monkeypatch):
    mask = (RNG.random((13, 17)) < 0.08).astype(float)
    real = focal.tiled
    monkeypatch.setattr(focal, "tiled", lambda df, v, h, k, o: real(df, v, h, k, o, tile))
    got = back(focal.distance_within(frame(spark, mask), "v", 6, "d"), "d", mask.shape)
    y, x = np.nonzero(mask)
    yy, xx = np.indices(mask.shape)
    want = np.sqrt(((yy[..., None] - y) ** 2 + (xx[..., None] - x) ** 2).min(-1)) if len(y) else np.full(mask.shape, 99.0)
    want[want > 6] = np.nan
    assert np.allclose(got, want, equal_nan=True)


def test_distance_without_any_target(spark):
    assert np.isnan(back(focal.distance_within(frame(spark, np.zeros((4, 5))), "v", 3, "d"), "d", (4, 5))).all()


@pytest.mark.parametrize("mirror", [False, True])
def test_gaussian(spark, mirror):
    w = focal.gaussian_weights(1.0)
    pad = np.pad(RANDOM, 4, mode="reflect" if mirror else "edge")
    want = sum(w[j] * w[i] * pad[j : j + 13, i : i + 17] for j in range(9) for i in range(9))
    assert np.allclose(back(focal.gaussian(frame(spark, RANDOM), "v", 1.0, "g", mirror), "g", RANDOM.shape), want)


def test_normalized_gaussian_leaves_nulls_out(spark):
    holed = RANDOM.copy()
    holed[3:6, 4:9] = np.nan
    same = np.where(np.isnan(holed), np.nan, 0.5)
    got = back(focal.normalized_gaussian(frame(spark, same), "v", 1.0, "g"), "g", same.shape)
    assert np.allclose(got, 0.5)


def flood(mask):
    label, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if label[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not label[a, b]:
                label[a, b] = n
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return label


@pytest.mark.parametrize("share", [0.2, 0.45, 1.0])
def test_components_across_tiles(spark, share):
    mask = RNG.random((30, 40)) < share
    df = frame(spark, mask.astype(float)).where("v > 0")
    got = np.nan_to_num(back(graph.components(df, 40, tile=8), "region", mask.shape)).astype(int)
    assert (got == flood(mask)).all()


def test_no_components(spark):
    assert graph.components(frame(spark, np.zeros((3, 3))).where("v > 0"), 3).count() == 0


def test_region_stats_keep_four_cells(spark):
    rows = [(x, 0, 1, 0.5, None, None, n, None) for x, n in enumerate("baab")] + [(x, 5, 2, 0.9, 1.0, 1.0, "a", "g") for x in range(3)]
    df = spark.createDataFrame(rows, "ix int, iy int, region long, score double, altitude double, slope double, species string, geology string")
    got = graph.region_stats(df, 10.0, 4).collect()
    assert [(r.region, r.n_cells, r.dominant_species, r.dominant_geology, r.altitude) for r in got] == [(1, 4, "a", None, 0.0)]
    assert got[0].compactness == pytest.approx(4 * math.pi * 400 / 40**2)


def test_flow_runs_down_a_long_valley(spark):
    height = np.array([[float(300 - x) for x in range(200)]])
    g = focal.flow_direction(frame(spark, height), "v", 1.0)
    acc = back(graph.flow_accumulation(g, 200), "acc", height.shape)
    assert acc[0].tolist() == [float(x + 1) for x in range(200)]


def test_flat_ground_has_no_flow_and_no_aspect(spark):
    flat = frame(spark, np.ones((3, 3)))
    assert {r.flow for r in focal.flow_direction(flat, "v", 1.0).collect()} == {-1}
    assert {(r.slope, r.aspect) for r in focal.slope_aspect(flat, "v", 1.0).collect()} == {(0.0, -1.0)}


def test_aspect_points_uphill_or_down(spark):
    south = frame(spark, np.array([[9.0 - y] * 3 for y in range(3)]))  # falls to the south
    assert {round(r.aspect) for r in focal.slope_aspect(south, "v", 1.0).where("ix = 1 and iy = 1").collect()} == {0}
    assert {round(r.aspect) for r in focal.slope_aspect(south, "v", 1.0, downhill=True).where("ix = 1 and iy = 1").collect()} == {180}


KNOTS = [
    (curves.ALTITUDE, {149: 0, 150: 0, 175: 0.5, 200: 1, 600: 1, 750: 0.5, 900: 0, 901: 0}),
    (curves.SLOPE, {0: 1, 15: 1, 30: 0.55, 40: 0.15, 50: 0, 51: 0}),
    (curves.ROUGHNESS, {3: 1, 12: 0, 13: 0}),
    (curves.TWI, {2.9: 0.1, 3: 0.1, 6: 1, 10: 1, 14: 0.1, 18: 0, 19: 0}),
    (curves.WATER, {0: 0.3, 2.5: 0.4, 5: 1, 80: 1, 1000: 0, 1001: 0}),
    (curves.URBAN, {14.9: 0, 15: 0.05, 100: 0.6, 175: 0.8, 250: 1}),
    (curves.CONTACT, {50: 1, 200: 0.5, 500: 0.2, 900: 0.2}),
    (curves.EDGE, {5: 1, 20: 0.5, 50: 0.1, 60: 0.1}),
    (curves.CANOPY, {19: 0.4, 20: 0.8, 40: 1, 70: 0.6, 90: 0.2}),
]


@pytest.mark.parametrize("curve, knots", KNOTS)
def test_curves_at_their_knots(spark, curve, knots):
    df = spark.createDataFrame([(float(x), float(v)) for x, v in knots.items()] + [(None, None), (float("nan"), None)], "x double, v double")
    for r in df.withColumn("s", curve.of(F.col("x"))).collect():
        if r.v is None:
            assert r.s == curve.missing
        else:
            assert r.s == pytest.approx(r.v, abs=1e-9) and 0 <= r.s <= 1


def test_weights_and_missing_criteria(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, None), (None, None)], "a double, b double")
    score, coverage = model.weighted({"a": F.col("a"), "b": F.col("b")}, {"a": 0.75, "b": 0.25, "c": 0.0})
    assert [(r.s, r.c) for r in df.select(score.alias("s"), coverage.alias("c")).collect()] == [(1.0, 1.0), (0.875, 0.75), (None, 0.0)]


def test_classes_are_closed_on_the_left(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.15, 0.3, 0.45, 0.6, 0.75, 1.0, None)], "s double")
    assert [r.c for r in df.select(model.class_of(F.col("s")).alias("c")).collect()] == [0, 1, 2, 3, 4, 5, 5, -1]


def test_closing_fills_gaps_and_shrinks_at_the_border(spark):
    m = np.zeros((7, 7))
    m[3, 2] = m[3, 4] = m[0, 0] = 1
    got = np.nan_to_num(back(focal.close_mask(frame(spark, m), "v", "c").withColumn("c", F.col("c").cast("int")), "c", m.shape))
    assert got[3, 3] == 1 and got[3, 2] == 1 and got[0, 0] == 0


def test_burst_after_rain(spark):
    days = [("2024-01-0%d" % (k + 1), t, 5.0, r, 70.0, 5.0) for k, (t, r) in enumerate([(9.0, 12.0), (9.0, 12.0), (13.0, 0.0), (13.0, 0.0), (13.0, 3.0)])]
    df = spark.createDataFrame(days, "day string, t double, tmin double, rain double, rh double, wind double")
    got = {r.day[-1]: (r.bonus, r.intensity, r.recent) for r in weather.daily(df).collect()}
    assert got == {"1": (None, None, 0.0), "2": (None, None, 12.0), "3": (0.26, "fort", 24.0), "4": (0.15, "fort", 24.0), "5": (None, None, 12.0)}
