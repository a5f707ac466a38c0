"""Areas and points against cells: equi-joins with exact tests.

Burning works alike for boxes and for polygons or lines: ``within`` says which cells an area
holds, by default :func:`cells_in_boxes`, else for instance
``partial(polygons.cells_in_shapes, parts="parts", touched=True)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 32
Within = Callable[[DataFrame, DataFrame], DataFrame]


def _buckets(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / BUCKET).cast("long"), F.floor(high / BUCKET).cast("long"))


def cells_in_boxes(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every (cell, box) with the cell inside the box, borders included.

    ``boxes``: ``xmin, ymin, xmax, ymax`` in cell units and any further columns. Boxes go to
    the buckets they touch, cells to the one they lie in; the join is an equi-join on the
    bucket with the exact test as a filter. Boxes with a null side hold nothing.
    """
    placed = boxes.where("xmin <= xmax and ymin <= ymax").withColumn("__bx", F.explode(_buckets(F.col("xmin"), F.col("xmax"))))
    placed = placed.withColumn("__by", F.explode(_buckets(F.col("ymin"), F.col("ymax"))))
    at = cells.withColumns({"__bx": F.floor(F.col("ix") / BUCKET).cast("long"), "__by": F.floor(F.col("iy") / BUCKET).cast("long")})
    return at.join(placed, ["__bx", "__by"]).where("ix between xmin and xmax and iy between ymin and ymax").drop("__bx", "__by")


def burn_mask(cells: DataFrame, areas: DataFrame, within: Within = cells_in_boxes) -> DataFrame:
    """``ix, iy, inside`` for all cells."""
    hit = within(cells.select("ix", "iy"), areas).select("ix", "iy").distinct()
    return cells.select("ix", "iy").join(hit.withColumn("inside", F.lit(True)), ["ix", "iy"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def burn_code(cells: DataFrame, areas: DataFrame, code: str, order: list[str], within: Within = cells_in_boxes) -> DataFrame:
    """``ix, iy, code`` for all cells: of the areas over a cell the one last in ``order``, 0 where there is none."""
    hit = within(cells.select("ix", "iy"), areas)
    best = hit.groupBy("ix", "iy").agg(F.max_by(code, F.struct(*order)).alias("code"))
    return cells.select("ix", "iy").join(best, ["ix", "iy"], "left").withColumn("code", F.coalesce("code", F.lit(0)))


def burn_max(cells: DataFrame, areas: DataFrame, score: str, fill: float = 0.0, within: Within = cells_in_boxes) -> DataFrame:
    """``ix, iy, score`` for all cells: the greatest score of the areas over it."""
    best = within(cells.select("ix", "iy"), areas).groupBy("ix", "iy").agg(F.max(score).alias("score"))
    return cells.select("ix", "iy").join(best, ["ix", "iy"], "left").withColumn("score", F.coalesce("score", F.lit(fill)))


def first_of_boxes(cells: DataFrame, boxes: DataFrame, value: str, seq: str) -> DataFrame:
    """``ix, iy, value`` of the first box (by ``seq``) over each covered cell."""
    return cells_in_boxes(cells.select("ix", "iy"), boxes).groupBy("ix", "iy").agg(F.min_by(value, seq).alias(value))


def first_point_near(cells: DataFrame, points: DataFrame, radius: float, value: str, seq: str, current: str) -> DataFrame:
    """``ix, iy, value``: of the points within ``radius`` cells, the first by ``seq`` whose value exceeds the cell's current one.

    Points go to all buckets that their circle touches.
    """
    boxes = points.withColumns({"xmin": F.col("px") - radius, "xmax": F.col("px") + radius, "ymin": F.col("py") - radius, "ymax": F.col("py") + radius})
    hit = cells_in_boxes(cells.select("ix", "iy", current), boxes)
    near = (F.col("ix") - F.col("px")) ** 2 + (F.col("iy") - F.col("py")) ** 2 <= radius * radius
    return hit.where(near & (F.col(current) < F.col(value))).groupBy("ix", "iy").agg(F.min_by(value, seq).alias(value))


def drop_repeats(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by ``order``; pre-aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, *[F.col(f"__r.{c}") for c in rest])
