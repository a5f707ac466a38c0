"""Land cover from map pixels, and the arithmetic of map tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell import fixed


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue (degrees), saturation and value of 8-bit colours."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (high - low).cast("double")
    turn = (
        F.when(span == 0, 0.0)
        .when(high == r, F.pmod((g - b) / span, F.lit(6.0)))
        .when(high == g, (b - r) / span + 2.0)
        .otherwise((r - g) / span + 4.0)
    )
    return 60.0 * turn, F.when(high == 0, 0.0).otherwise(span / high), high / 255.0


def colour_class(df: DataFrame, r: str, g: str, b: str, out: str, valid: str | None = None) -> DataFrame:
    """Adds ``out``: the number of the first colour rule that fits, 0 for none, -1 where there is no picture.

    Hue, saturation and value are worked out in a projection of their own, once a row; the
    rules only compare them.
    """
    h, s, v = hsv(F.col(r), F.col(g), F.col(b))
    df = df.withColumns({"__h": h, "__s": s, "__v": v})
    rule = F.when(~F.col(valid), -1) if valid else F.when(F.lit(False), -1)
    for k, (_, h0, h1, s0, s1, v0, v1) in enumerate(fixed.COLOUR_RULES, 1):
        rule = rule.when(F.col("__h").between(h0, h1) & F.col("__s").between(s0, s1) & F.col("__v").between(v0, v1), k)
    return df.withColumn(out, rule.otherwise(0)).drop("__h", "__s", "__v")


def green_score(cls: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, fixed.GREEN_SCORES)), F.when(cls >= 0, cls)), F.lit(0.3))


def quality(df: DataFrame, cls: str) -> DataFrame:
    """One row: pixels, classified ones, ones without picture, and the share classified of those with one."""
    c = F.col(cls)
    seen = F.count_if(c >= 0)
    return df.agg(
        F.count("*").alias("pixels_total"),
        F.count_if(c > 0).alias("pixels_classified"),
        F.count_if(c == -1).alias("pixels_nodata"),
        F.round(100.0 * F.count_if(c > 0) / F.nullif(seen, F.lit(0)), 6).alias("pct_classified"),
    )


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180.0) / 360.0 * (1 << zoom)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    return F.floor((1.0 - mercator_y(lat) / math.pi) / 2.0 * (1 << zoom)).cast("long")


def tile_x_last(lon: Column, zoom: int) -> Column:
    """The last tile that begins west of a longitude."""
    return (F.ceil((lon + 180.0) / 360.0 * (1 << zoom)) - 1).cast("long")


def tile_y_last(lat: Column, zoom: int) -> Column:
    """The last tile that begins north of a latitude."""
    return (F.ceil((1.0 - mercator_y(lat) / math.pi) / 2.0 * (1 << zoom)) - 1).cast("long")


def bounds_of_tiles(tiles: DataFrame, zoom: int) -> DataFrame:
    """One row: ``west, south, east, north`` of tiles ``x, y``."""
    return tiles.agg(
        tile_lon(F.min("x"), zoom).alias("west"), tile_lat(F.max("y") + 1, zoom).alias("south"), tile_lon(F.max("x") + 1, zoom).alias("east"), tile_lat(F.min("y"), zoom).alias("north")
    )


def mercator_y(lat: Column) -> Column:
    rad = F.radians(lat)
    return F.log(F.tan(rad) + 1 / F.cos(rad))


def tile_lon(x: Column, zoom: int) -> Column:
    return x / (1 << zoom) * 360.0 - 180.0


def tile_lat(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / (1 << zoom)))))


def tiles_of_boxes(boxes: DataFrame, zoom: int) -> DataFrame:
    """All map tiles that cover boxes ``box_id, west, south, east, north``: ``box_id, x, y``."""
    x = F.sequence(tile_x(F.col("west"), zoom), tile_x(F.col("east"), zoom))
    y = F.sequence(tile_y(F.col("north"), zoom), tile_y(F.col("south"), zoom))
    return boxes.select("box_id", F.explode(x).alias("x"), y.alias("ys")).select("box_id", "x", F.explode("ys").alias("y"))


def optimal_zoom(cell: float, lat: float) -> int:
    """The least zoom whose pixels are no larger than a cell."""
    return next((z for z in range(1, 20) if 156543.03392 * math.cos(math.radians(lat)) / 2**z <= cell), 19)
