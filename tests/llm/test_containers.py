import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terracell.llm import containers


@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
@settings(max_examples=150, deadline=None)
def test_no_container_overflows(sizes):
    sizes = np.array(sizes)
    place = containers.fill(sizes, 100)
    load = np.bincount(place, weights=sizes)
    assert len(place) == len(sizes) and load.max() <= 100 and (load > 0).all()


@given(st.lists(st.integers(1, 50), min_size=1, max_size=30), st.integers(1, 8))
@settings(max_examples=100, deadline=None)
def test_differencing_keeps_all_items(sizes, k):
    sizes = np.array(sizes)
    place, top = containers.difference(sizes, k)
    load = np.bincount(place, weights=sizes, minlength=k)
    assert len(load) == k and load.sum() == sizes.sum() and load.max() == top


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(1).integers(20, 600, 1000)
    place, top = containers.difference(sizes, 150)
    assert top < sizes.sum() / 150 * 1.05


def packed(spark, data, capacity=100):
    df = spark.createDataFrame([(i, s, 0, 7) for i, s in data], "doc_id bigint, tokens bigint, piece int, container_id bigint")
    return containers.pack(df, "doc_id", "tokens", capacity)


def test_splits_only_what_is_too_large(spark):
    data = [(1, 100), (2, 101), (3, 250), (4, 30), (5, 30), (6, None), (7, 0), (8, 30), (8, 30), (None, 5)]
    out = packed(spark, data).collect()
    pieces = {}
    for r in out:
        pieces.setdefault(r.item_id, []).append((r.piece, r.first_token, r.tokens))
    assert sorted(pieces[2]) == [(0, 0, 100), (1, 100, 1)] and sorted(pieces[3]) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert sorted(pieces[1]) == [(0, 0, 100)] and len(pieces[8]) == 2 and set(pieces) == {1, 2, 3, 4, 5, 8}
    load = {}
    for r in out:
        load[r.container_id] = load.get(r.container_id, 0) + r.tokens
    assert max(load.values()) <= 100 and sum(load.values()) == 100 + 101 + 250 + 30 * 4


def test_blocks_and_report(spark):
    rng = np.random.default_rng(3)
    data = [(k, int(s)) for k, s in enumerate(rng.integers(10, 900, 6000))]
    df = packed(spark, data, 2048)
    report = containers.fill_report(df, 2048).first()
    assert report.over_capacity == 0 and report.tokens == sum(s for _, s in data) and report.fill > 0.97
    assert df.count() == len(data) and df.select("item_id").distinct().count() == len(data)


def test_empty(spark):
    assert packed(spark, []).collect() == []


@pytest.mark.parametrize("sizes", [[100], [100, 100], [51, 51, 51], [1] * 100])
def test_small_cases_are_best(sizes):
    assert len(set(containers.fill(np.array(sizes), 100).tolist())) == {1: 1, 2: 2, 3: 3, 100: 1}[len(sizes)]
