import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terracell.functions.geometry import BoxTree, ear_clip, in_triangles, regular_polygon


def area(p):
    x, y = p[:, 0], p[:, 1]
    return abs(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y)) / 2


@pytest.mark.parametrize(
    "polygon",
    [
        [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)],  # a notch
        [(0, 0), (2, 0), (4, 0), (4, 2), (0, 2)],  # a straight corner
        [(0, 0), (0, 3), (3, 3), (3, 0), (0, 0)],  # clockwise and closed
        regular_polygon(15.0, 8),
    ],
)
def test_triangles_cover_the_polygon(polygon):
    p = np.array(polygon, float)
    t = p[ear_clip(p)]
    total = sum(area(x) for x in t)
    closed = p[:-1] if (p[0] == p[-1]).all() else p
    assert total == pytest.approx(area(closed))


def test_too_few_corners_give_no_triangle():
    assert len(ear_clip(np.array([(0, 0), (1, 1)]))) == 0


@given(st.lists(st.tuples(st.floats(-5, 5), st.floats(-5, 5), st.floats(0, 2), st.floats(0, 2)), max_size=40), st.lists(st.tuples(st.floats(-6, 6), st.floats(-6, 6)), max_size=20))
@settings(max_examples=60, deadline=None)
def test_hierarchy_finds_every_box(boxes, points):
    b = np.array(boxes, float).reshape(-1, 4)
    low, high = b[:, :2], b[:, :2] + b[:, 2:]
    p = np.array(points, float).reshape(-1, 2)
    who, box = BoxTree(low, high).candidates(p)
    want = {(i, j) for i in range(len(p)) for j in range(len(b)) if (low[j] <= p[i]).all() and (p[i] <= high[j]).all()}
    assert set(zip(who.tolist(), box.tolist(), strict=True)) == want


def test_border_counts_as_inside():
    t = np.array([[(0, 0), (2, 0), (0, 2)]] * 3, float)
    assert in_triangles(np.array([(1, 0), (1, 1), (1.1, 1.1)]), t).tolist() == [True, True, False]
