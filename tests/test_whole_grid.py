"""Queries over all rows of a grid of more than 12 rows."""

import pytest

from terracell.plans import fixtures as fx
from terracell.plans import suitability
from tests.oracle import compare, connect

LARGER = "/root/testdata/sf0.01"
NAMES = ("checkpoint_concordance", "resample_bilinear", "resample_nearest", "rasterize_mask", "point_boost", "score_contact", "cluster_stats")


@pytest.mark.parametrize("name", NAMES)
def test_all_rows_take_part(spark, name):
    compare(suitability.QUERIES[name](spark, LARGER), connect(LARGER), suitability.ORACLE[name])


def test_rows_of_an_empty_grid(spark):
    assert fx.rows(spark.createDataFrame([], "ix int, iy int")) == 0
