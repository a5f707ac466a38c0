import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.operators import polygons, spatial
from tests.conftest import rows

SHAPE = "seq int, parts array<array<array<double>>>"


def cells(spark, nx, ny):
    return spark.createDataFrame([(x, y) for x in range(nx) for y in range(ny)], "ix int, iy int")


def hits(spark, shapes, nx=12, ny=9, **how):
    return rows(polygons.cells_in_shapes(cells(spark, nx, ny), spark.createDataFrame(shapes, SHAPE), **how))


def near(px, py, a, b):
    (ax, ay), (bx, by) = a, b
    d2 = (bx - ax) ** 2 + (by - ay) ** 2
    t = 0.0 if d2 == 0 else max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / d2))
    return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))


def holds(x, y, ring):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def test_square_by_centres_and_touched(spark):
    square = [(1, [[[2.25, 3.25], [4.75, 3.25], [4.75, 5.75], [2.25, 5.75]]])]
    assert hits(spark, square, touched=False) == [(x, y, 1) for x in (2, 3, 4) for y in (3, 4, 5)]
    small = [(1, [[[2.6, 3.6], [3.2, 3.6], [3.2, 3.9]]])]
    assert hits(spark, small, touched=False) == []
    assert hits(spark, small, touched=True) == [(2, 3, 1), (3, 3, 1)]


@pytest.mark.parametrize("band", [512, 3])
@pytest.mark.parametrize("reach", [0.0, 1.3])
def test_random_polygons_by_centres(spark, monkeypatch, band, reach):
    monkeypatch.setattr(polygons, "BAND", band)
    rng = random.Random(band)
    shapes = [(k, [[[rng.uniform(-3, 15), rng.uniform(-3, 12)] for _ in range(rng.randint(3, 7))]]) for k in range(12)]
    want = set()
    for k, (ring,) in shapes:
        for x in range(12):
            for y in range(9):
                if holds(x + 0.5, y + 0.5, ring) or reach and min(near(x + 0.5, y + 0.5, a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) <= reach:
                    want.add((x, y, k))
    assert set(hits(spark, shapes, touched=False, reach=reach)) == want


@pytest.mark.parametrize("reach", [0.0, 0.7])
def test_lines_touch_what_lies_under_them(spark, reach):
    rng = random.Random(4)
    shapes = [(k, [[[rng.uniform(0, 12), rng.uniform(0, 9)] for _ in range(3)]]) for k in range(6)]
    want = set()
    for k, (line,) in shapes:
        for a, b in zip(line, line[1:], strict=False):
            for t in np.linspace(0, 1, 800):
                px, py = a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])
                for turn in np.linspace(0, 2 * math.pi, 48) if reach else [0.0]:
                    x, y = math.floor(px + (reach - 1e-9) * math.cos(turn)) if reach else math.floor(px), math.floor(py + (reach - 1e-9) * math.sin(turn)) if reach else math.floor(py)
                    if 0 <= x < 12 and 0 <= y < 9:
                        want.add((x, y, k))
    got = set(hits(spark, shapes, filled=False, reach=reach))
    assert want <= got
    for x, y, k in got - want:  # only cells that the sampled places just miss
        line = shapes[k][1][0]
        corners = min(near(x + i / 8, y + j / 8, a, b) for i in range(9) for j in range(9) for a, b in zip(line, line[1:], strict=False))
        assert corners <= reach + 0.1


def test_odd_shapes(spark):
    shapes = [
        (1, None), (2, []), (3, [[]]), (4, [[[1.0, 1.0]]]), (5, [[[None, 1.0], [2.0, 2.0], [1.0, 2.0]]]),
        (6, [[[float("nan"), 1.0], [2.0, 2.0], [1.0, 2.0]]]), (7, [[[-1e7, -1e7], [1e7, -1e7], [1e7, 1e7], [-1e7, 1e7]]]),
        (8, [[[100.0, 100.0], [101.0, 100.0], [100.0, 101.0]]]),
    ]
    got = hits(spark, shapes, nx=3, ny=3)
    assert got == sorted([(1, 1, 4)] + [(x, y, 7) for x in range(3) for y in range(3)])
    assert rows(polygons.cells_in_shapes(cells(spark, 2, 2).limit(0), spark.createDataFrame(shapes, SHAPE))) == []
    assert hits(spark, shapes[:1]) == []


def test_hole_and_repeated_rows_and_burning(spark):
    outer, hole = [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]], [[3.0, 3.0], [6.0, 3.0], [6.0, 6.0], [3.0, 6.0]]
    shapes = spark.createDataFrame([(1, [outer, hole], 0.5), (1, [outer, hole], 0.5), (2, [hole], 0.25)], "seq int, parts array<array<array<double>>>, score double")
    from functools import partial

    within = partial(polygons.cells_in_shapes, touched=False)
    got = {(r.ix, r.iy): r.score for r in spatial.burn_max(cells(spark, 10, 9), shapes, "score", within=within).collect()}
    assert len(got) == 90 and got[4, 4] == 0.25 and got[0, 0] == 0.5 and got[9, 0] == 0.0
    assert sum(r.inside for r in spatial.burn_mask(cells(spark, 10, 9), shapes.where("seq = 1"), within).collect()) == 72


@pytest.mark.parametrize("work", [1, 40])
def test_large_shapes_by_bands_and_stretches(spark, monkeypatch, work):
    monkeypatch.setattr(polygons, "WORK", work)
    monkeypatch.setattr(polygons, "BAND", 3)
    monkeypatch.setattr(polygons, "STRETCH", 5)
    rng = random.Random(work)
    shapes = [(k, [[[rng.uniform(-3, 15), rng.uniform(-3, 12)] for _ in range(rng.randint(3, 7))]]) for k in range(12)] + [(12, None), (13, [[], [[2.0]]])]
    want = {(x, y): max((k for k, parts in shapes[:12] if holds(x + 0.5, y + 0.5, parts[0])), default=-1) for x in range(12) for y in range(9)}
    whole = spark.createDataFrame(shapes, SHAPE)
    found = polygons.burned(cells(spark, 12, 9), polygons.spans(whole, "parts", (0, 0, 11, 8), touched=False), F.col("seq"), ["seq"], "last")
    assert {(r.ix, r.iy): -1 if r.last is None else r.last for r in found.collect()} == want


def test_burning_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        shapes = spark.createDataFrame([(k, [[[0.2, 0.2], [k % 7 + 0.5, 0.2], [k % 7 + 0.5, 1.5], [0.2, 1.5]]]) for k in range(20)], SHAPE)
        found = polygons.burn_code(cells(spark, 9, 3), shapes, "seq", ["seq"])
        want = {(x, y): max((k for k in range(20) if y < 2 and x <= k % 7), default=0) for x in range(9) for y in range(3)}
        assert {(r.ix, r.iy): r.code for r in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
