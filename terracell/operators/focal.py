"""Neighbourhood operators on a grid of cells ``ix, iy``.

Boxes, gradients and morphology are windows over rows and then over columns, which stay in
the JVM: two shuffles, whatever the size of the neighbourhood. Kernels whose weights depend
on the offset (Gaussian, distance, median) work on tiles with a halo: one shuffle, in which
a cell is copied only to the tiles whose halo it lies in.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def _row(r: int):
    return Window.partitionBy("iy").orderBy("ix").rangeBetween(-r, r)


def _column(r: int):
    return Window.partitionBy("ix").orderBy("iy").rangeBetween(-r, r)


def box_sum(df: DataFrame, r: int, columns: dict[str, Column], fold: Callable = F.sum) -> DataFrame:
    """Adds the fold of each column over the (2r+1) x (2r+1) cells around; cells beyond the border do not exist."""
    names = {k: f"__{k}" for k in columns}
    df = df.withColumns({names[k]: c for k, c in columns.items()})
    df = df.withColumns({n: fold(n).over(_row(r)) for n in names.values()})
    df = df.withColumns({k: fold(n).over(_column(r)) for k, n in names.items()})
    return df.drop(*names.values())


def box_mean(df: DataFrame, value: str, size: int, out: str) -> DataFrame:
    """The mean of the cells that exist in a size x size box; nulls are left out."""
    r = size // 2
    some = box_sum(df, r, {"__s": F.col(value), "__n": F.col(value).isNotNull().cast("int")})
    return some.withColumn(out, F.col("__s") / F.nullif(F.col("__n"), F.lit(0))).drop("__s", "__n")


def box_std(df: DataFrame, value: str, size: int, out: str) -> DataFrame:
    """The population standard deviation in a size x size box."""
    v = F.col(value)
    some = box_sum(df, size // 2, {"__s": v, "__q": v * v, "__n": v.isNotNull().cast("int")})
    n = F.nullif(F.col("__n"), F.lit(0))
    spread = F.col("__q") / n - F.pow(F.col("__s") / n, 2)
    return some.withColumn(out, F.sqrt(F.greatest(spread, F.lit(0.0)))).drop("__s", "__q", "__n")


def _around(df: DataFrame, value: str) -> DataFrame:
    """Adds the nine values around each cell as ``__nw ... __se``; beyond the border the border's own value."""
    row = Window.partitionBy("iy").orderBy("ix")
    v = F.col(value)
    df = df.withColumn("__r", F.struct(F.coalesce(F.lag(v).over(row), v).alias("w"), v.alias("c"), F.coalesce(F.lead(v).over(row), v).alias("e")))
    column = Window.partitionBy("ix").orderBy("iy")
    return df.withColumns(
        {"__n": F.coalesce(F.lag("__r").over(column), "__r"), "__s": F.coalesce(F.lead("__r").over(column), "__r")}
    )


def slope_aspect(df: DataFrame, value: str, cell: float, downhill: bool = False) -> DataFrame:
    """Adds ``slope`` (degrees) and ``aspect`` (bearing of the uphill direction, -1 on flat ground) by Horn's 3 x 3 gradient.

    ``downhill`` turns the bearing round. Row 0 lies in the north.
    """
    return _around(df, value).withColumns(_horn(cell, downhill)).drop("__r", "__n", "__s")


def _horn(cell: float, downhill: bool = False) -> dict[str, Column]:
    """Slope and aspect from the columns of :func:`_around`."""
    c = {f"{a}{b}": F.col(f"__{a}.{b}") for a in "nrs" for b in "wce"}
    gx = ((c["ne"] + 2 * c["re"] + c["se"]) - (c["nw"] + 2 * c["rw"] + c["sw"])) / (8 * cell)
    gy = ((c["nw"] + 2 * c["nc"] + c["ne"]) - (c["sw"] + 2 * c["sc"] + c["se"])) / (8 * cell)
    steep = F.sqrt(gx * gx + gy * gy)
    bearing = F.pmod(F.degrees(F.atan2(gx, gy)) + (180.0 if downhill else 0.0), F.lit(360.0))
    return {"slope": F.degrees(F.atan(steep)), "aspect": F.when(steep < 1e-8, -1.0).when(steep.isNotNull(), bearing)}


# The eight directions in order, as (dx, dy).
DIRECTIONS = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))


def flow_direction(df: DataFrame, value: str, cell: float) -> DataFrame:
    """Adds ``flow``: 0 to 7 (north, then clockwise) towards the steepest drop, the first of equals; -1 in pits and on flats."""
    return _around(df, value).withColumn("flow", _steepest(value, cell)).drop("__r", "__n", "__s")


def _steepest(value: str, cell: float) -> Column:
    """The direction of the steepest drop from the columns of :func:`_around`."""
    names = ("__n.c", "__n.e", "__r.e", "__s.e", "__s.c", "__s.w", "__r.w", "__n.w")
    drops = [
        F.struct(((F.col(value) - F.col(n)) / (cell * math.hypot(dx, dy))).alias("drop"), F.lit(-k).alias("turn"))
        for k, (n, (dx, dy)) in enumerate(zip(names, DIRECTIONS, strict=True))
    ]
    best = F.greatest(*drops)
    return F.when(best["drop"] > 0, -best["turn"]).otherwise(-1)


def central_slope(df: DataFrame, value: str, cell: float, out: str) -> DataFrame:
    """Adds the tangent of the slope by central differences, one-sided at the border."""
    row, column = Window.partitionBy("iy").orderBy("ix"), Window.partitionBy("ix").orderBy("iy")
    df = df.withColumn("__gx", _along(F.col(value), row, cell)).withColumn("__gy", _along(F.col(value), column, cell))
    return df.withColumn(out, F.sqrt(F.col("__gx") ** 2 + F.col("__gy") ** 2)).drop("__gx", "__gy")


def _along(v: Column, w, cell: float) -> Column:
    a, b = F.lag(v).over(w), F.lead(v).over(w)
    steps = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    return F.when(steps > 0, (F.coalesce(b, v) - F.coalesce(a, v)) / (steps * cell)).otherwise(0.0)


def terrain(df: DataFrame, value: str, cell: float) -> DataFrame:
    """Adds ``slope, aspect, flow`` and ``tan`` (:func:`slope_aspect`, :func:`flow_direction`, :func:`central_slope`) in one pass over rows and one over columns."""
    row, column = Window.partitionBy("iy").orderBy("ix"), Window.partitionBy("ix").orderBy("iy")
    df = _around(df.withColumn("__gx", _along(F.col(value), row, cell)), value).withColumn("__gy", _along(F.col(value), column, cell))
    df = df.withColumns({**_horn(cell), "flow": _steepest(value, cell), "tan": F.sqrt(F.col("__gx") ** 2 + F.col("__gy") ** 2)})
    return df.drop("__r", "__n", "__s", "__gx", "__gy")


def dilate(df: DataFrame, mask: str, out: str, iterations: int = 1, cross: bool = False) -> DataFrame:
    """Adds the mask grown by one cell as often as given, over eight neighbours or over four (``cross``)."""
    df = df.withColumn(out, F.coalesce(F.col(mask).cast("boolean"), F.lit(False)))
    if not cross:
        return box_sum(df, iterations, {out: F.col(out)}, F.max) if iterations else df
    for _ in range(iterations):
        df = df.withColumn("__line", F.max(out).over(_row(1))).withColumn(out, F.col("__line") | F.max(out).over(_column(1))).drop("__line")
    return df


def erode(df: DataFrame, mask: str, out: str, iterations: int = 1, outside: bool = False, cross: bool = False) -> DataFrame:
    """Adds the mask shrunk over eight neighbours, or over four (``cross``). ``outside``: whether cells beyond the border count as set."""
    df = df.withColumn("__not", ~F.coalesce(F.col(mask), F.lit(False)))
    if cross and not outside:  # beside the windows over rows, so that they share a shuffle
        df = df.withColumn("__row", F.count("*").over(_row(iterations)))
    df = dilate(df, "__not", "__grown", iterations, cross)
    kept = ~F.col("__grown")
    if not outside:  # a border cell has neighbours that do not exist
        whole = 2 * iterations + 1
        if cross:
            df = df.withColumn("__col", F.count("*").over(_column(iterations)))
            kept = kept & (F.col("__row") == whole) & (F.col("__col") == whole)
        else:
            df = box_sum(df, iterations, {"__all": F.lit(1)})
            kept = kept & (F.col("__all") == whole * whole)
    return df.withColumn(out, kept).drop("__not", "__grown", "__all", "__row", "__col")


def close_mask(df: DataFrame, mask: str, out: str, iterations: int = 1) -> DataFrame:
    """Adds the mask grown and then shrunk; set cells touching the border are shrunk there."""
    return erode(dilate(df, mask, "__wide", iterations), "__wide", out, iterations).drop("__wide")


def density_filter(df: DataFrame, mask: str, size: int, least: int, out: str) -> DataFrame:
    """Adds the mask where the box mean times the full box area reaches ``least``."""
    df = df.withColumn("__m", F.col(mask).cast("double"))
    df = box_mean(df, "__m", size, "__d")
    return df.withColumn(out, F.col(mask) & (F.col("__d") * (size * size) >= least)).drop("__m", "__d")


def tiled(df: DataFrame, value: str | list[str], halo: int, kernel: Callable[..., np.ndarray], out: str, tile: int | None = None, keep: list[str] | None = None, extent: tuple[int, int, int, int] | None = None) -> DataFrame:
    """``ix, iy, out``: a numpy kernel run on tiles with a halo; with ``keep`` these columns of ``df`` instead of ``ix, iy``.

    ``kernel(values, there)`` gets the values of a tile and its halo (NaN where null), a list
    of them where ``value`` is a list, and which of these cells exist, as far as any do. A
    tile holds at most (tile + 2 halo) squared cells, so no task grows with the data. With
    ``extent`` (first column and row, last column and row of ``df``) no cell goes to a tile
    that has none of its own.
    """
    side = tile or max(256, 4 * halo)
    names = [value] if isinstance(value, str) else value
    rest = [f for f in df.schema.fields if f.name in (keep or [])]
    rows = df.select(F.col("ix").cast("long").alias("__x"), F.col("iy").cast("long").alias("__y"), *[F.col(n).cast("double").alias(f"__v{i}") for i, n in enumerate(names)], *[f.name for f in rest])

    def span(c: str, k: int) -> Column:
        low, high = F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side)
        return F.sequence(low, high) if extent is None else F.sequence(F.greatest(low, F.lit(extent[k] // side)), F.least(high, F.lit(extent[k + 2] // side)))

    placed = rows.withColumn("__tx", F.explode(span("__x", 0))).withColumn("__ty", F.explode(span("__y", 1)))
    own = (F.floor(F.col("__x") / side) == F.col("__tx")) & (F.floor(F.col("__y") / side) == F.col("__ty"))
    placed = placed.withColumns({f.name: F.when(own, F.col(f.name)) for f in rest})  # a halo is there for its values only
    given = [f.name for f in rest] if keep else ["__x", "__y"]

    def run(key: tuple, cells: pa.Table) -> pa.Table:
        x, y = (cells.column(c).to_numpy() for c in ("__x", "__y"))
        left, top = key[0].as_py() * side, key[1].as_py() * side
        core = (x >= left) & (x < left + side) & (y >= top) & (y < top + side)
        result = np.zeros(0)
        if core.any():
            x, y = x - x.min(), y - y.min()
            shape = (int(y.max()) + 1, int(x.max()) + 1)
            layers, there = np.full((len(names), *shape), np.nan), np.zeros(shape, bool)
            there[y, x] = True
            for i in range(len(names)):
                layers[i][y, x] = cells.column(f"__v{i}").to_numpy()
            result = np.asarray(kernel(layers[0] if isinstance(value, str) else list(layers), there)[y[core], x[core]], float)
        return cells.select(given).filter(pa.array(core)).append_column(out, pa.array(result))

    fields = [StructField(f.name, f.dataType) for f in rest] if keep else [StructField(n, LongType()) for n in given]
    done = placed.groupBy("__tx", "__ty").applyInArrow(run, StructType([*fields, StructField(out, DoubleType())]))
    found = F.when(~F.isnan(out), F.col(out)).alias(out)
    return done.select(*given, found) if keep else done.select(F.col("__x").alias("ix"), F.col("__y").alias("iy"), found)


def gaussian_weights(sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def _edge_index(there: np.ndarray, mirror: bool, axis: int, r: int) -> np.ndarray:
    """For each place and shift the place to read: clamped or mirrored (without the edge) to the cells that exist."""
    line = there.any(axis=1 - axis)
    some = np.flatnonzero(line)
    low, high = int(some[0]), int(some[-1])
    at = np.arange(len(line))[:, None] + np.arange(-r, r + 1)[None, :]
    if mirror and high > low:
        period = 2 * (high - low)
        at = np.abs((at - low) % period)
        return np.where(at > high - low, period - at, at) + low
    return np.clip(at, low, high)


def gaussian(df: DataFrame, value: str, sigma: float, out: str, mirror: bool = False) -> DataFrame:
    """``ix, iy, out``: Gaussian mean of radius int(4 sigma + 0.5); the border value goes on beyond the border, or is mirrored.

    Nulls count as 0 (use :func:`normalized_gaussian` to leave them out). The grid is a
    full rectangle.
    """
    w = gaussian_weights(sigma)
    r = len(w) // 2

    def kernel(values: np.ndarray, there: np.ndarray) -> np.ndarray:
        z = np.nan_to_num(values)
        for axis in (1, 0):
            at = _edge_index(there, mirror, axis, r)
            z = sum(w[k] * np.take(z, at[:, k], axis=axis) for k in range(len(w)))
        return z

    return tiled(df, value, r, kernel, out)


def normalized_gaussian(df: DataFrame, value: str, sigma: float, out: str) -> DataFrame:
    """``ix, iy, out``: Gaussian mean over the cells that have a value; 0 where none is near."""
    w = gaussian_weights(sigma)
    return tiled(df, value, len(w) // 2, lambda values, there: smoothed(values, there, w), out)


def smoothed(values: np.ndarray, there: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The mean by the weights of the values that are not NaN, 0 where none is near."""
    have = ~np.isnan(values)
    num, den = np.nan_to_num(values), have.astype(float)
    for axis in (1, 0):
        at = _edge_index(there, False, axis, len(w) // 2)
        num = sum(w[k] * np.take(num, at[:, k], axis=axis) for k in range(len(w)))
        den = sum(w[k] * np.take(den, at[:, k], axis=axis) for k in range(len(w)))
    return np.where(den > 1e-10, num / np.maximum(den, 1e-10), 0.0)


def _reflect_index(there: np.ndarray, axis: int, r: int) -> np.ndarray:
    """For each place and shift the place to read: mirrored with the edge repeated."""
    some = np.flatnonzero(there.any(axis=1 - axis))
    low, n = int(some[0]), int(some[-1] - some[0] + 1)
    at = np.abs(np.arange(there.shape[axis])[:, None] + np.arange(-r, r + 1)[None, :] - low + 0.5) % (2 * n)
    return (np.where(at > n, 2 * n - at, at) - 0.5).astype(np.int64) + low


def _median(values: np.ndarray, there: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    y, x = _reflect_index(there, 0, r), _reflect_index(there, 1, r)
    return np.median(np.stack([values[y[:, i]][:, x[:, j]] for i in range(size) for j in range(size)]), axis=0)


def median(df: DataFrame, value: str, size: int, out: str) -> DataFrame:
    """``ix, iy, out``: the median of size x size cells of a full rectangle, mirrored beyond the border."""
    return tiled(df, value, size // 2, lambda values, there: _median(values, there, size), out)


def median3(df: DataFrame, value: str, out: str) -> DataFrame:
    """``ix, iy, out``: the median of 3 x 3 cells, the border repeated beyond it."""
    return median(df, value, 3, out)


def _search(x: np.ndarray, row: np.ndarray, have: np.ndarray, sy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(d2, place) for each cell of whole rows: the least squared distance to the row ``sy`` of a column of its row that has one, and that column's place."""
    g = np.where(have, (sy - row).astype(float) ** 2, np.inf)
    best, source = g.copy(), np.arange(len(x))
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    most, line = np.maximum.reduceat(best, begin), np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(x))))
    wide = np.diff(np.append(begin, len(x)))
    d, open_ = 1, np.arange(len(x))
    while True:  # cells of a row may be missing, so shifts go by place and distances by column
        rest = (wide > d) & (most > d * d)
        open_ = open_[rest[line[open_]]]
        if not len(open_):
            return best, source
        for shift in (-d, d):
            come = open_ + shift
            inside = (come >= 0) & (come < len(x))
            to, come = open_[inside], come[inside]
            same = (row[come] == row[to]) & have[come]
            to, come = to[same], come[same]
            far = g[come] + (x[to] - x[come]).astype(float) ** 2
            old = source[to]
            first = (sy[come] < sy[old]) | (sy[come] == sy[old]) & (x[come] < x[old])
            wins = (far < best[to]) | (far == best[to]) & first
            best[to[wins]], source[to[wins]] = far[wins], come[wins]
        most = np.maximum.reduceat(best, begin)
        d += 1


def _by_rows(solve: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that gives whole rows of the grid, many at once, to ``solve``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last row so far, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column("iy").to_numpy()
            if held and held[-1].column("iy")[0].as_py() != row[0]:
                yield solve(pa.concat_batches(held))
                held = []
            cut = int(np.searchsorted(row, row[-1]))
            if cut:
                yield solve(pa.concat_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield solve(pa.concat_batches(held))

    return run


def _row_of(at: Column) -> tuple[Column, Column]:
    """The last value of ``at`` above each cell in its column, and below; a frame up to the end would be read anew for each cell."""
    return tuple(F.last(at, True).over(Window.partitionBy("ix").orderBy(o)) for o in ("iy", F.desc("iy")))


def nearest(df: DataFrame, there: Column, value: Column) -> DataFrame:
    """``ix, iy, d2, value``: the squared distance in cells to the nearest cell for which ``there`` holds, and its value.

    Exact for any distance: the nearest such cell of the column above and below by windows
    that run down and up, then for each row the least sum of squares over its columns; whole
    rows, many at once, go through numpy. Of equally near cells the first by row, then by
    column, counts. Without any such cell both are null.
    """
    kind = df.select(value.alias("v")).schema[0].dataType.simpleString()
    at = F.when(there, F.struct(F.col("iy").cast("long").alias("y"), value.alias("v")))
    y = F.col("iy").cast("long")
    up, down = _row_of(F.col("__at"))
    near = F.when(F.col("__d").isNull() | (y - F.col("__u.y") <= F.col("__d.y") - y), F.col("__u")).otherwise(F.col("__d"))
    cells = df.select("ix", "iy", at.alias("__at")).withColumn("__u", up).withColumn("__d", down)
    cells = cells.select(F.col("ix").cast("long"), y.alias("iy"), near.alias("n")).select("ix", "iy", F.col("n.y").alias("y"), F.col("n.v").alias("v"))

    def solve(rows: pa.RecordBatch) -> pa.RecordBatch:
        have = rows.column("y").is_valid().to_numpy(zero_copy_only=False)
        best, source = _search(rows.column("ix").to_numpy(), rows.column("iy").to_numpy(), have, rows.column("y").fill_null(0).to_numpy())
        found = np.isfinite(best)
        d2 = pa.array(np.where(found, best, 0).astype(np.int64), mask=~found)
        return pa.RecordBatch.from_arrays([rows.column("ix"), rows.column("iy"), d2, rows.column("v").take(pa.array(source, mask=~found))], ["ix", "iy", "d2", "value"])

    return cells.repartition("iy").sortWithinPartitions("iy", "ix").mapInArrow(_by_rows(solve), f"ix long, iy long, d2 long, value {kind}")


def distances(df: DataFrame, masks: dict[str, str]) -> DataFrame:
    """Adds for each mask (name of the new column: column of the mask) what :func:`distance` gives, all in one pass that takes the other columns along."""
    y, kept = F.col("iy").cast("long"), df.schema.fields
    marks = {out: F.when(F.coalesce(F.col(m).cast("boolean"), F.lit(False)), y) for out, m in masks.items()}
    cells = df.withColumns({f"__at_{o}": c for o, c in marks.items()})
    ways = {o: _row_of(F.col(f"__at_{o}")) for o in masks}
    cells = cells.withColumns({f"__u_{o}": w[0] for o, w in ways.items()}).withColumns({f"__d_{o}": w[1] for o, w in ways.items()})

    def near(o: str) -> Column:
        u, d = F.col(f"__u_{o}"), F.col(f"__d_{o}")
        return F.when(d.isNull() | (y - u <= d - y), u).otherwise(d).alias(f"__y_{o}")

    names, outs = [f.name for f in kept], list(masks)
    cells = cells.select(*names, *[near(o) for o in outs])

    def solve(rows: pa.RecordBatch) -> pa.RecordBatch:
        x, row = (rows.column(c).to_numpy().astype(np.int64) for c in ("ix", "iy"))
        more = []
        for o in outs:
            sy = rows.column(f"__y_{o}")
            best = _search(x, row, sy.is_valid().to_numpy(zero_copy_only=False), sy.fill_null(0).to_numpy())[0]
            found = np.isfinite(best)
            more.append(pa.array(np.sqrt(np.where(found, best, 0.0)), mask=~found))
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *more], [*names, *outs])

    kind = StructType([*(StructField(f.name, f.dataType) for f in kept), *(StructField(o, DoubleType()) for o in outs)])
    return cells.repartition("iy").sortWithinPartitions("iy", "ix").mapInArrow(_by_rows(solve), kind)


def distance(df: DataFrame, mask: str, out: str) -> DataFrame:
    """``ix, iy, out``: exact Euclidean distance in cells to the nearest set cell, however far; null where there is none."""
    some = nearest(df, F.coalesce(F.col(mask).cast("boolean"), F.lit(False)), F.lit(1))
    return some.select("ix", "iy", F.sqrt("d2").alias(out))


def fill_nearest(df: DataFrame, value: str, out: str) -> DataFrame:
    """``ix, iy, out``: the value, or for null cells that of the nearest cell that has one, however far."""
    return nearest(df, F.col(value).isNotNull(), F.col(value)).select("ix", "iy", F.col("value").alias(out))


def distance_within(df: DataFrame, mask: str, radius: int, out: str) -> DataFrame:
    """``ix, iy, out``: exact Euclidean distance in cells to the nearest set cell, null beyond ``radius``."""

    def kernel(values: np.ndarray, there: np.ndarray) -> np.ndarray:
        far = float(radius + 1) ** 2 * 4
        up = np.where(np.nan_to_num(values) > 0, 0.0, np.inf)
        n = len(up)
        steps = np.arange(n)[:, None]
        below = steps - np.maximum.accumulate(np.where(up == 0, steps, -(10**6)), axis=0)
        above = np.minimum.accumulate(np.where(up == 0, steps, 10**6)[::-1], axis=0)[::-1] - steps
        g = np.minimum(np.minimum(below, above).astype(float) ** 2, far)
        best = g.copy()
        for d in range(1, radius + 1):
            best[:, d:] = np.minimum(best[:, d:], g[:, :-d] + d * d)
            best[:, :-d] = np.minimum(best[:, :-d], g[:, d:] + d * d)
        return np.where(best <= radius * radius, np.sqrt(best), np.nan)

    numbers = df.select("ix", "iy", F.coalesce(F.col(mask).cast("boolean").cast("int"), F.lit(0)).alias("__m"))
    return tiled(numbers, "__m", radius, kernel, out)


def nearest_fill(df: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    """``ix, iy, out``: the value, or for null cells that of the nearest cell within ``radius`` (of equals the first by row, then column)."""
    shifts = sorted(((dx * dx + dy * dy, dy, dx) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)))
    shifts = [s for s in shifts if s[0] <= radius * radius]

    def kernel(values: np.ndarray, there: np.ndarray) -> np.ndarray:
        out_values = values.copy()
        h, w = values.shape
        for _, dy, dx in shifts[1:]:
            gap = np.isnan(out_values) & there
            if not gap.any():
                break
            y, x = np.nonzero(gap)
            inside = (y + dy >= 0) & (y + dy < h) & (x + dx >= 0) & (x + dx < w)
            y, x = y[inside], x[inside]
            out_values[y, x] = np.where(np.isnan(values[y + dy, x + dx]), out_values[y, x], values[y + dy, x + dx])
        return out_values

    return tiled(df, value, radius, kernel, out)
