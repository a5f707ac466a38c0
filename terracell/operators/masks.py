"""Masks and measures from polygon and line layers, and what land cover makes of a grid."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell import fixed
from terracell.functions import curves
from terracell.operators import focal, polygons, spatial


def burn_layers(cells: DataFrame, areas: DataFrame | None, lines: DataFrame | None, reach: float = 0.0, lines_reach: float | None = None) -> DataFrame:
    """Every (cell, shape) of cells that areas or lines touch, widened by so many cells."""
    extent = polygons.extent_of(cells)
    within = partial(polygons.cells_in_shapes, cells, extent=extent)
    found = [within(areas, reach=reach)] if areas is not None else []
    found += [within(lines, reach=reach if lines_reach is None else lines_reach, filled=False)] if lines is not None else []
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def mask_of(cells: DataFrame, areas: DataFrame | None, lines: DataFrame | None, reach: float = 0.0, lines_reach: float | None = None) -> DataFrame:
    """``ix, iy, inside`` for all cells."""
    return spatial.burn_mask(cells, cells, lambda c, _: burn_layers(c, areas, lines, reach, lines_reach))


def water_distance(cells: DataFrame, areas: DataFrame | None, lines: DataFrame | None, cell: float) -> DataFrame:
    """``ix, iy, water, dist_water``: cells that touch water (lines two metres wide to either side), and the metres to the nearest."""
    wet = mask_of(cells, areas, lines, lines_reach=2.0 / cell).withColumnRenamed("inside", "water")
    far = focal.distance(wet, "water", "__d")
    return wet.join(far, ["ix", "iy"]).select("ix", "iy", "water", (F.col("__d") * cell).alias("dist_water"))


def water_bonus(cells: DataFrame, areas: DataFrame | None, lines: DataFrame | None, cell: float, bonus: str = "bonus") -> DataFrame:
    """``ix, iy, factor``: the greatest bonus of the water within 100 m, never under one."""
    keep = lambda df: None if df is None else df.select("parts", F.col(bonus).alias("__b"))
    return spatial.burn_max(cells, cells, "__b", 1.0, lambda c, _: burn_layers(c, keep(areas), keep(lines), 100.0 / cell)).select("ix", "iy", F.greatest(F.col("score"), F.lit(1.0)).alias("factor"))


def water_score(distance: Column, factor: Column) -> Column:
    """The curve of the distance times the bonus, at most one; 0.3 where there is no water at all."""
    return F.least(F.lit(1.0), F.coalesce(curves.WATER.of(distance), F.lit(0.3)) * factor)


def contact_distance(cells: DataFrame, lines: DataFrame, cell: float) -> DataFrame:
    """``ix, iy, dist_contact``: metres to the nearest cell that a contact line touches."""
    met = mask_of(cells, None, lines)
    return focal.distance(met, "inside", "__d").select("ix", "iy", (F.col("__d") * cell).alias("dist_contact"))


def edge_distance(cells: DataFrame, mask: str, cell: float) -> DataFrame:
    """``ix, iy, dist_edge``: metres to the nearest set cell that has a neighbour (of four) outside the mask."""
    inner = focal.erode(cells.select("ix", "iy", F.coalesce(F.col(mask), F.lit(False)).alias("__m")), "__m", "__in", cross=True)
    edge = inner.select("ix", "iy", (F.col("__m") & ~F.col("__in")).alias("__e"))
    return focal.distance(edge, "__e", "__d").select("ix", "iy", (F.col("__d") * cell).alias("dist_edge"))


def density_limit(cell: float, radius: float = 30.0) -> tuple[int, int]:
    """(size, least): the box around a cell and how many cells of it must be built up for the cell to stay."""
    size = 2 * max(2, round(radius / cell)) + 1
    return size, max(1, round(0.61 * min(1.0, 10.0 / cell) * size * size))


def urban_mask(cells: DataFrame, areas: DataFrame, cell: float, kind: str = "urban_type", buffer: float = 10.0, dense: bool = True) -> DataFrame:
    """``ix, iy, urban`` for all cells of a full rectangle: those of built-up areas.

    Each type is burned on its own, loses the cells with too few of its kind in the box
    around, and grows over four neighbours by its buffer; a cell is built up if any type
    reaches it. The runs of a tile and its halo go over a mask, type by type and in batches,
    so memory depends neither on the number of areas nor on that of types. Types are compared
    in small letters; those without a buffer of their own, and buildings, get ``buffer``.
    """
    values = urban_lists(cells, areas, polygons.extent_of(cells), cell, kind, buffer, dense)
    return polygons.looked_up(cells, values, "urban").withColumn("urban", F.coalesce("urban", F.lit(False)))


def urban_lists(cells: DataFrame, areas: DataFrame, extent: tuple[int, int, int, int], cell: float, kind: str = "urban_type", buffer: float = 10.0, dense: bool = True) -> DataFrame:
    """The lists of :func:`urban_mask` by row and stretch of columns, for :func:`polygons.looked_up`."""
    x0, y0, x1, y1 = extent
    named = areas.select("parts", F.coalesce(F.lower(kind), F.lit("")).alias("__t"))
    size, least = density_limit(cell)
    r = size // 2 if dense else 0
    other = round(buffer / cell)
    steps = {t: 0 if t in fixed.BUILDINGS else round(b / cell) for t, b in fixed.URBAN_BUFFERS.items()} | dict.fromkeys(fixed.BUILDINGS, other)
    halo, wide = r + max(other, *steps.values()), polygons.STRETCH
    high = max(wide, 4 * halo)
    keys = ["__ty", "__tx"]

    def tiles(low: str, up: str, side: int, first: int, last: int) -> Column:
        return F.explode(F.sequence(F.greatest(F.floor((F.col(low) - halo) / side), F.lit(first // side)), F.least(F.floor((F.col(up) + halo) / side), F.lit(last // side))))

    found = polygons.spans(named, "parts", extent).select("__t", "iy", "x0", "x1")
    there = cells.where("ix is not null and iy is not null").select(F.lit(None).cast("string").alias("__t"), F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("x0"), F.col("ix").cast("long").alias("x1"))
    placed = there.unionByName(found).withColumn("__ty", tiles("iy", "iy", high, y0, y1)).withColumn("__tx", tiles("x0", "x1", wide, x0, x1))
    sorted_ = placed.repartition(*keys).sortWithinPartitions(*keys, "__t")  # the cells that exist come first

    def kept(mask: np.ndarray, top: int, left: int) -> np.ndarray:
        if not dense:
            return mask
        total = np.pad(mask.astype(np.int64).cumsum(0).cumsum(1), ((r + 1, r), (r + 1, r)), mode="edge")
        total[: r + 1], total[:, : r + 1] = 0, 0
        n = 2 * r + 1
        around = total[n:, n:] - total[:-n, n:] - total[n:, :-n] + total[:-n, :-n]
        y, x = np.arange(mask.shape[0]) + top, np.arange(mask.shape[1]) + left
        span = lambda c, a, b: np.maximum(np.minimum(c + r, b) - np.maximum(c - r, a) + 1, 1)
        return mask & (around / (span(y, y0, y1)[:, None] * span(x, x0, x1)) * (size * size) >= least)

    def grown(mask: np.ndarray, by: int) -> np.ndarray:
        for _ in range(by):
            more = mask.copy()
            more[1:] |= mask[:-1]
            more[:-1] |= mask[1:]
            more[:, 1:] |= mask[:, :-1]
            more[:, :-1] |= mask[:, 1:]
            mask = more
        return mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (high + 2 * halo, wide + 2 * halo)
        now: tuple | None = None  # tile row, tile column, type
        marks, exist, built = np.zeros((shape[0], shape[1] + 1), np.int64), np.zeros(shape, bool), np.zeros(shape, bool)

        def close() -> None:
            ty, tx, t = now
            mask = marks.cumsum(axis=1)[:, :-1] > 0
            if t is None:
                exist[:] = mask
            else:
                built[:] |= grown(kept(mask & exist, ty * high - halo, tx * wide - halo), steps.get(t, other))
            marks[:] = 0

        def lists() -> pa.RecordBatch:
            core = built[halo : halo + high, halo : halo + wide]
            some = np.flatnonzero(core.any(axis=1))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * wide), pa.array(core[some].ravel()))
            return pa.RecordBatch.from_arrays([pa.array(some + now[0] * high), pa.array(np.full(len(some), now[1])), values], ["__poly_y", "__poly_s", "__poly_l"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ty, tx, y, a, b = (batch.column(c).to_numpy() for c in (*keys, "iy", "x0", "x1"))
            types = batch.column("__t").dictionary_encode()
            code = types.indices.fill_null(-1).to_numpy()
            names = types.dictionary.to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], (ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1]) | (code[1:] != code[:-1])]))
            for i, j in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                own = (int(ty[i]), int(tx[i]), names[code[i]] if code[i] >= 0 else None)
                if now is not None and own != now:
                    close()
                    if own[:2] != now[:2]:
                        yield lists()
                        exist[:], built[:] = False, False
                now = own
                row, left = y[i:j] - own[0] * high + halo, own[1] * wide - halo
                np.add.at(marks, (row, np.clip(a[i:j] - left, 0, shape[1])), 1)
                np.add.at(marks, (row, np.clip(b[i:j] - left + 1, 0, shape[1])), -1)
        if now is not None:
            close()
            yield lists()

    return sorted_.select(*keys, "__t", "iy", "x0", "x1").mapInArrow(run, "__poly_y bigint, __poly_s bigint, __poly_l array<boolean>")


def _landcover_kernel(values: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Green score, built-up and wet cells of colour classes, packed as green + 2 * urban + 4 * water."""

    def grown(mask: np.ndarray, r: int) -> np.ndarray:
        wide = np.pad(mask & there, r)
        h, w = mask.shape
        return np.logical_or.reduce([wide[i : i + h, j : j + w] for i in range(2 * r + 1) for j in range(2 * r + 1)]) & there

    cls = np.nan_to_num(values, nan=-1.0).astype(np.int64)
    scores = np.array([0.3, *fixed.GREEN_SCORES])
    green = scores[np.where((cls >= 0) & (cls < len(fixed.GREEN_SCORES)), cls + 1, 0)]
    urban = focal._median(grown(np.isin(cls, fixed.ROADS), 1).astype(float), there, 5) > 0
    water = focal._median(grown(np.isin(cls, fixed.WATERS), 2).astype(float), there, 3) > 0
    return focal._median(green, there, 3) + 2.0 * urban + 4.0 * water


def landcover_masks(df: DataFrame, cls: str, altitude: Column | None = None, slope: Column | None = None) -> DataFrame:
    """``ix, iy, urban, green, water`` of the colour classes of a full rectangle of cells.

    Roads grow by a cell and are smoothed by a 5 x 5 median, water by two cells and 3 x 3,
    the green score by 3 x 3; all in one pass over tiles with a halo. High or steep ground
    (where given) that is neither road nor water is at least 0.4 green, roads are not green.
    """
    packed = focal.tiled(df, cls, 4, _landcover_kernel, "__p")
    p = F.col("__p")
    water, urban = p >= 4.0, F.pmod(p, F.lit(4.0)) >= 2.0
    green = F.round(F.pmod(p, F.lit(2.0)), 9)
    out = packed.select("ix", "iy", urban.alias("urban"), green.alias("green"), water.alias("water"))
    if altitude is not None:
        high = F.coalesce(altitude > 400.0, F.lit(False)) | (F.coalesce(slope > 20.0, F.lit(False)) if slope is not None else F.lit(False))
        out = out.join(df.select("ix", "iy", high.alias("__high")), ["ix", "iy"])
        out = out.withColumn("green", F.when(F.col("__high") & ~F.col("urban") & ~F.col("water"), F.greatest("green", F.lit(0.4))).otherwise(F.col("green"))).drop("__high")
    return out.withColumn("green", F.when(F.col("urban"), 0.0).otherwise(F.col("green")))


def modulate(df: DataFrame, green: str, tree: str, vegetation: list[str], water: str) -> DataFrame:
    """The vegetation criteria times the green score, which under trees is at least 0.80, and there the water criterion at least 0.15."""
    wood = F.coalesce(F.col(tree) > 0.05, F.lit(False))
    clear = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(green)))
    shade = F.when(wood, F.greatest(clear, F.lit(0.80))).otherwise(clear)
    return df.withColumns({c: F.col(c) * shade for c in vegetation} | {water: F.when(wood, F.greatest(F.col(water), F.lit(0.15))).otherwise(F.col(water))})


def favourable_density(df: DataFrame, tree: str, cell: float, out: str, radius: float = 30.0) -> DataFrame:
    """Adds the share of cells with a tree score of 0.7 or more in the box around."""
    size = max(3, int(2 * radius / cell) + 1)
    df = df.withColumn("__f", (F.col(tree) >= 0.7).cast("double"))
    return focal.box_mean(df, "__f", size + (size % 2 == 0), out).drop("__f")


def is_blank(pixels: DataFrame) -> DataFrame:
    """One row: whether more than 95 % of the pixels are nearly white."""
    white = (F.col("r") > 250) & (F.col("g") > 250) & (F.col("b") > 250)
    return pixels.agg((F.avg(white.cast("double")) > 0.95).alias("blank"))
