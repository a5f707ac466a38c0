"""What must hold whatever the size of the tables: seen from the plans, and from larger grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.operators import focal, model
from tests.test_oracle import QUERIES

BURNING = ("polygon_best", "polygon_centres", "polygon_mask", "polygon_max", "polygon_buffer", "polygon_last", "urban_mask")
DISTANCES = ("contact_score", "edge_score", "fill_any_distance")


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", BURNING)
def test_runs_of_cells_are_never_broadcast(spark, sf, name):
    """A small table of shapes has any number of runs, which a broadcast would gather on the driver."""
    assert "Broadcast" not in plan_of(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", DISTANCES)
def test_no_window_is_read_anew_for_each_cell(spark, sf, name):
    """A frame up to the end of a column takes time with the square of its length."""
    assert "unboundedfollowing" not in plan_of(QUERIES[name](spark, sf)).lower()


@pytest.mark.parametrize("batch", [3, 10_000])
def test_nearest_of_ragged_rows(spark, batch):
    rng = np.random.default_rng(batch)
    cells = [(x, y, int(v) if v < 3 else None) for x in range(9) for y in range(11) if rng.random() < 0.8 for v in [rng.integers(20)]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(cells, "ix int, iy int, v int")
        got = {(r.ix, r.iy): (r.d2, r.value) for r in focal.nearest(df, F.col("v").isNotNull(), F.col("v")).collect()}
        none = focal.nearest(df, F.col("v") > 90, F.col("v")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(cells) == len(none) and all(r.d2 is None and r.value is None for r in none)
    columns = {x for x, _, v in cells if v is not None}
    for x, y, _ in cells:
        # a source counts in the rows of its own column that exist, so the search starts from these
        seen = [min(((abs(b - y), b, v) for a, b, v in cells if a == c and v is not None)) + (c,) for c in columns if any((a, b) == (c, y) for a, b, _ in cells)]
        best = min(((d * d + (c - x) ** 2, b, c, v) for d, b, v, c in seen), default=None)
        assert got[x, y] == ((None, None) if best is None else (best[0], best[3]))


def test_the_model_joins_no_plan_with_itself(spark, sf):
    """Stages that join all before them double the plan each time, until the driver cannot hold it."""
    plan = plan_of(QUERIES["suitability_end_to_end"](spark, sf))
    assert plan.count("Join") <= 8 and len(plan.splitlines()) < 200


def test_columns_that_go_along(spark):
    """Distances and the settled score beside the other columns are what the operators give one by one."""
    rng = np.random.default_rng(5)
    cells = [(x, y, f"{x}/{y}", bool(rng.random() < 0.1), bool(rng.random() < 0.02), float(rng.random()), float(rng.random() * 16), float(rng.random() * 40)) for x in range(30) for y in range(40)]
    df = spark.createDataFrame(cells, "ix int, iy int, name string, a boolean, b boolean, v double, slope double, z double")
    lime = F.when(F.col("ix") % 3 == 0, 0.7).otherwise(1.0)
    got = model.settled(focal.distances(df, {"da": "a", "db": "b"}), "v", "slope", "z", lime, "a", "s").collect()
    apart = {m: {(r.ix, r.iy): r.d for r in focal.distance(df, m, "d").collect()} for m in "ab"}
    lowered = df.drop("v").join(model.monotony(df, "v", "slope", "z", "v", "a"), ["ix", "iy"]).withColumn("v", F.when(~F.col("a"), F.col("v") * lime))
    smooth = {(r.ix, r.iy): r.s for r in focal.normalized_gaussian(lowered, "v", 2.0, "s").collect()}
    assert len(got) == len(cells) and {r.name for r in got} == {c[2] for c in cells}
    for r in got:
        assert r.name == f"{r.ix}/{r.iy}" and (r.da, r.db) == (apart["a"][r.ix, r.iy], apart["b"][r.ix, r.iy])
        assert r.s == pytest.approx(smooth[r.ix, r.iy], abs=1e-12)
