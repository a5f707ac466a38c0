"""Regular grids of cells as DataFrames: building, lookup, resampling, projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The parameters of the conformal conic projection EPSG:2154 (GRS80).
_A, _F = 6378137.0, 1 / 298.257222101
_PHI1, _PHI2, _PHI0, _LAM0 = (math.radians(d) for d in (44.0, 49.0, 46.5, 3.0))
_X0, _Y0 = 700_000.0, 6_600_000.0
_E = math.sqrt(2 * _F - _F * _F)


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (_E * math.sin(phi)) ** 2)


def _t(phi: float) -> float:
    return math.tan(math.pi / 4 - phi / 2) / ((1 - _E * math.sin(phi)) / (1 + _E * math.sin(phi))) ** (_E / 2)


_N = (math.log(_m(_PHI1)) - math.log(_m(_PHI2))) / (math.log(_t(_PHI1)) - math.log(_t(_PHI2)))
_G = _m(_PHI1) / (_N * _t(_PHI1) ** _N)
_RHO0 = _A * _G * _t(_PHI0) ** _N


def to_metric(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in EPSG:2154 of WGS84 degrees, in closed form; null for positions out of range and at the south pole."""
    valid = (lat > -90) & (lat <= 90) & lon.between(-180, 180)
    phi, lam = F.radians(F.when(valid, lat)), F.radians(F.when(valid, lon))
    e = F.lit(_E) * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - e) / (1 + e), F.lit(_E / 2))
    rho = F.lit(_A * _G) * F.pow(t, F.lit(_N))
    theta = F.lit(_N) * (lam - _LAM0)
    return _X0 + rho * F.sin(theta), _Y0 + _RHO0 - rho * F.cos(theta)


def to_degrees(x: Column, y: Column, rounds: int = 6) -> tuple[Column, Column]:
    """(lat, lon) in WGS84 degrees of EPSG:2154 metres; the latitude is iterated to far below a millimetre."""
    dx, dy = x - _X0, _RHO0 - (y - _Y0)
    rho = F.sqrt(dx * dx + dy * dy)
    t = F.pow(rho / (_A * _G), F.lit(1 / _N))
    phi = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(rounds):
        e = F.lit(_E) * F.sin(phi)
        phi = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - e) / (1 + e), F.lit(_E / 2)))
    return F.degrees(phi), F.degrees(F.atan2(dx, dy) / _N + _LAM0)


def cells(spark: SparkSession, west: float, south: float, east: float, north: float, cell: float) -> DataFrame:
    """The cells of a box, row 0 in the north: ``cell_id, ix, iy, x, y`` with centres spread evenly inside the box."""
    nx, ny = int((east - west) / cell), int((north - south) / cell)
    ix, iy = F.col("id") % nx, F.floor(F.col("id") / nx)
    step_x = (east - west - cell) / max(nx - 1, 1)
    step_y = (north - south - cell) / max(ny - 1, 1)
    return spark.range(nx * ny).select(
        F.col("id").alias("cell_id"),
        ix.cast("int").alias("ix"),
        iy.cast("int").alias("iy"),
        (west + cell / 2 + ix * step_x).alias("x"),
        (north - cell / 2 - iy * step_y).alias("y"),
    )


def cell_of(x: Column, y: Column, west: float, north: float, cell: float, nx: int, ny: int) -> tuple[Column, Column]:
    """(ix, iy) of the cell whose centre is nearest, the border cells for points outside."""
    clamp = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v).cast("int")))
    return clamp((x - west) / cell, nx), clamp((north - y) / cell, ny)


def auto_cell_size(area_km2: float) -> float:
    """Metres per cell for an area. The ladder of sizes."""
    return next((size for limit, size in ((500, 5.0), (2000, 10.0), (8000, 50.0)) if area_km2 <= limit), 100.0)


def grid_size(area_m: tuple[float, float], cell: float) -> dict[str, float]:
    nx, ny = int(area_m[0] / cell), int(area_m[1] / cell)
    return {"nx": nx, "ny": ny, "cells": nx * ny, "ram_mb": nx * ny * 4 * 15 / 1e6}


def resample(source: DataFrame, value: str, size: tuple[int, int], to: tuple[int, int], nearest: bool = False) -> DataFrame:
    """A grid laid over another of ``to`` = (nx, ny) cells, corner on corner: ``ix, iy, value``.

    Every target cell takes its four (or one) source cells by equi-joins on computed
    indices; null source cells carry no weight, and the target is null where the nearest
    source cell is.
    """
    (sx, sy), (tx, ty) = size, to
    scale = lambda n, m: (n - 1) / (m - 1) if m > 1 else 0.0
    target = source.sparkSession.range(tx * ty).select((F.col("id") % tx).cast("int").alias("ix"), F.floor(F.col("id") / tx).cast("int").alias("iy"))
    u, v = F.col("ix") * scale(sx, tx), F.col("iy") * scale(sy, ty)
    cells_in = source.select(F.col("ix").alias("jx"), F.col("iy").alias("jy"), F.col(value).cast("double").alias("z"))
    if nearest:
        at = target.withColumns({"jx": F.floor(u + 0.5).cast("int"), "jy": F.floor(v + 0.5).cast("int")})
        return at.join(cells_in, ["jx", "jy"], "left").select("ix", "iy", F.col("z").alias(value))
    corners = F.array(
        *[
            F.struct(
                F.least(F.floor(u) + dx, F.lit(sx - 1)).cast("int").alias("jx"),
                F.least(F.floor(v) + dy, F.lit(sy - 1)).cast("int").alias("jy"),
                ((u - F.floor(u) if dx else 1 - (u - F.floor(u))) * (v - F.floor(v) if dy else 1 - (v - F.floor(v)))).alias("w"),
            )
            for dx in (0, 1)
            for dy in (0, 1)
        ]
    )
    spread = target.select("ix", "iy", F.explode(corners).alias("c")).select("ix", "iy", "c.*").where("w > 0")
    near = F.max_by(F.col("z").isNull(), F.struct(F.col("w"), -F.col("jy"), -F.col("jx")))
    return (
        spread.join(cells_in, ["jx", "jy"], "left")
        .groupBy("ix", "iy")
        .agg(F.when(~near, F.sum(F.col("w") * F.coalesce("z", F.lit(0.0)))).alias(value))
    )
