"""Polygons and lines against cells: every shape becomes runs of cells, which meet the cells by an equi-join.

A shape is a list of parts, each a list of (x, y) in cell units; cell (ix, iy) is the square
from (ix, iy) to (ix + 1, iy + 1), its lower borders included. The parts of a polygon are
rings, closed where they are not, and a place inside an odd number of them is inside (so
rings may be holes or further polygons). All edges of some shapes meet all their rows at once
in numpy; a shape with more than ``WORK`` of these pairs is cut into bands of rows for it.

Burning resolves the runs of a stretch of a row in their order, before they meet any cell, so
a cell meets one list of values however many shapes lie over it. Joins never broadcast: how
many runs a shape has is not to be seen from the size of its table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND = 512
STRETCH = 256
WORK = 1 << 20


def _edges(parts: pa.ListArray, filled: bool) -> tuple[np.ndarray, np.ndarray]:
    """(shape, edge) of the edges (x1, y1, x2, y2) of all parts; without those of shapes with a point that is not two finite numbers."""
    of_shape, of_part, of_point = parts.offsets.to_numpy(), parts.values.offsets.to_numpy(), parts.values.values.offsets.to_numpy()
    numbers = parts.values.values.values.to_numpy(zero_copy_only=False)
    numbers = np.concatenate([numbers, [np.nan, np.nan]])  # where points without numbers at the end begin
    start = of_point[:-1]
    place = np.where((np.diff(of_point) >= 2)[:, None], np.column_stack([numbers[start], numbers[start + 1]]), np.nan)
    size = np.diff(of_part[of_shape[0] : of_shape[-1] + 1])
    shape = np.repeat(np.repeat(np.arange(len(parts)), np.diff(of_shape)), size)
    first, last = of_part[of_shape[0]], of_part[of_shape[-1]]
    after = np.arange(first, last) + 1
    ends = np.cumsum(size)[size > 0] - 1
    after[ends] = first + (ends - size[size > 0] + 1 if filled else ends)
    edge = np.column_stack([place[first:last], place[after]])
    bad = np.zeros(len(parts), bool)
    bad[shape[~np.isfinite(edge).all(axis=1)]] = True
    good = ~bad[shape]
    return shape[good], edge[good]


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number) of all whole numbers from low to high."""
    many = np.maximum(high - low + 1, 0)
    owner = np.repeat(np.arange(len(low)), many)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)


def _across(edge: np.ndarray, reach: float, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest x within ``reach`` of each edge on the line at height ``y``."""
    x1, y1, x2, y2 = edge.T
    low, high = np.full(len(y), np.inf), np.full(len(y), -np.inf)
    for x, at in ((x1, y1), (x2, y2)):
        h = reach * reach - (y - at) ** 2
        there = h >= 0
        w = np.sqrt(np.where(there, h, 0.0))
        low, high = np.where(there, np.minimum(low, x - w), low), np.where(there, np.maximum(high, x + w), high)
    size = np.hypot(x2 - x1, y2 - y1)
    nx, ny = -(y2 - y1) / np.where(size > 0, size, 1.0) * reach, (x2 - x1) / np.where(size > 0, size, 1.0) * reach
    for sign in (1.0, -1.0) if reach else (0.0,):
        ax, ay, bx, by = x1 + sign * nx, y1 + sign * ny, x2 + sign * nx, y2 + sign * ny
        there = (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by)) & (ay != by)
        x = ax + (bx - ax) * (y - ay) / np.where(there, by - ay, 1.0)
        low, high = np.where(there, np.minimum(low, x), low), np.where(there, np.maximum(high, x), high)
    return low, high


def runs(shape: np.ndarray, edge: np.ndarray, first: np.ndarray, last: np.ndarray, filled: bool, touched: bool, reach: float) -> tuple[np.ndarray, ...]:
    """(shape, row, from, to) of the cells of many shapes, each cell once a shape.

    ``edge`` (n, 4) belongs to the shapes ``shape``; rows ``first`` to ``last`` (by edge) are
    looked at. A cell belongs to a shape if its centre is inside or within ``reach`` of it;
    with ``touched`` if any place of it is.
    """
    ylow, yhigh = np.minimum(edge[:, 1], edge[:, 3]), np.maximum(edge[:, 1], edge[:, 3])
    found: list[tuple[np.ndarray, ...]] = []
    if filled:
        owner, row = _expand(np.maximum(np.floor(ylow), first).astype(np.int64), np.minimum(np.floor(yhigh), last).astype(np.int64))
        x1, y1, x2, y2 = edge[owner].T
        centre = row + 0.5
        crosses = (y1 > centre) != (y2 > centre)
        owner, row, x1, y1, x2, y2, centre = (v[crosses] for v in (owner, row, x1, y1, x2, y2, centre))
        x = (x2 - x1) * (centre - y1) / (y2 - y1) + x1
        order = np.lexsort((x, row, shape[owner]))
        whose, row, x = shape[owner][order], row[order], x[order]
        found.append((whose[::2], row[::2], np.ceil(x[::2] - 0.5), np.ceil(x[1::2] - 0.5) - 1))
    if touched or reach:
        owner, row = _expand(np.maximum(np.floor(ylow - reach), first).astype(np.int64), np.minimum(np.floor(yhigh + reach), last).astype(np.int64))
        some = edge[owner]
        x1, y1, x2, y2 = some.T
        bottom = np.maximum(row if touched else row + 0.5, ylow[owner] - reach)
        top = np.minimum(row + 1.0 if touched else row + 0.5, yhigh[owner] + reach)
        meets = bottom <= top
        owner, row, some, bottom, top = (v[meets] for v in (owner, row, some, bottom, top))
        x1, y1, x2, y2 = some.T
        # both ends of the strip are convex in y, so their extremes lie nearest to the outermost ends of the edge
        low = _across(some, reach, np.clip(np.where(x1 <= x2, y1, y2), bottom, top))[0]
        high = _across(some, reach, np.clip(np.where(x1 >= x2, y1, y2), bottom, top))[1]
        a, b = (np.floor(low), np.floor(high)) if touched else (np.ceil(low - 0.5), np.floor(high - 0.5))
        found.append((shape[owner], row, a, b))
    whose, row, a, b = (np.concatenate([f[k] for f in found]) for k in range(4)) if found else (np.zeros(0),) * 4
    real = (a <= b) & np.isfinite(a) & np.isfinite(b)
    whose, row, a, b = (v[real] for v in (whose, row, a, b))
    if not len(a):
        return (np.zeros(0, np.int64),) * 4
    order = np.lexsort((a, row, whose))  # runs of one shape and row that meet become one
    whose, row, a, b = (v[order].astype(np.int64) for v in (whose, row, a, b))
    group = np.cumsum(np.concatenate([[True], (whose[1:] != whose[:-1]) | (row[1:] != row[:-1])]))
    span = np.int64(b.max() - a.min() + 4)
    start, stop = a - a.min() + group * span, np.maximum.accumulate(b - a.min() + group * span)
    fresh = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1] + 1]))
    ends = np.concatenate([fresh[1:], [len(a)]]) - 1
    return whose[fresh], row[fresh], a[fresh], stop[ends] - group[ends] * span + a.min()


def spans(shapes: DataFrame, parts: str, extent: tuple[int, int, int, int], touched: bool = True, reach: float = 0.0, filled: bool = True) -> DataFrame:
    """The runs of cells of each shape: ``iy, x0, x1`` and all columns but ``parts``; no cell twice.

    ``extent``: the first and last column and row that count, (x0, y0, x1, y1). ``touched``:
    all cells that the shape touches, else those whose centre it holds. ``reach`` widens the
    shape by so many cells, with round corners. ``filled`` False: the parts are lines. Null
    or empty shapes, and points that are not finite numbers, hold nothing.
    """
    rest = [c for c in shapes.columns if c != parts]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shapes.select(*rest).schema)
    x0, y0, x1, y1 = extent
    band, work = BAND, WORK

    def pieces(shape: np.ndarray, edge: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(shape, edge, first, last) of what is looked at together."""
        low = np.clip(np.floor(np.minimum(edge[:, 1], edge[:, 3]) - reach), y0, y1 + 1).astype(np.int64)
        high = np.clip(np.floor(np.maximum(edge[:, 1], edge[:, 3]) + reach), y0 - 1, y1).astype(np.int64)
        there = low <= high
        shape, edge, low, high = (v[there] for v in (shape, edge, low, high))
        if not len(shape):
            return
        begin = np.flatnonzero(np.concatenate([[True], shape[1:] != shape[:-1]]))
        each, sofar = np.add.reduceat(high - low + 1, begin), 0
        stops = []
        for k, n in enumerate(each.tolist()):
            if k and sofar + n > work:
                stops.append(begin[k])
                sofar = 0
            sofar += n
        for at, some in zip(np.split(np.arange(len(shape)), stops), np.split(high - low + 1, stops), strict=True):
            if some.sum() <= work:
                yield shape[at], edge[at], np.full(len(at), y0), np.full(len(at), y1)
                continue
            for k in range(low[at].min() // band, high[at].max() // band + 1):
                near = at[(low[at] < (k + 1) * band) & (high[at] >= k * band)]
                if len(near):
                    yield shape[near], edge[near], np.full(len(near), max(y0, k * band)), np.full(len(near), min(y1, (k + 1) * band - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(*_edges(batch.column(parts), filled)):
                whose, row, a, b = runs(*piece, filled, touched, reach)
                a, b = np.maximum(a, x0), np.minimum(b, x1)
                inside = a <= b
                keep = pa.array(whose[inside])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(keep) for c in rest), pa.array(row[inside]), pa.array(a[inside]), pa.array(b[inside])], [*rest, "iy", "x0", "x1"])

    at = shapes.where(F.col(parts).isNotNull()).withColumn(parts, F.col(parts).cast("array<array<array<double>>>"))
    return at.select(*rest, parts).mapInArrow(run, f"{fields + ', ' if rest else ''}iy bigint, x0 bigint, x1 bigint")


def extent_of(cells: DataFrame) -> tuple[int, int, int, int]:
    """The first and last column and row of some cells, by one aggregation; without cells one that holds nothing."""
    r = cells.agg(F.min("ix"), F.min("iy"), F.max("ix"), F.max("iy")).first()
    return (0, 0, -1, -1) if r[0] is None else tuple(map(int, r))


def cells_in_shapes(
    cells: DataFrame, shapes: DataFrame, parts: str = "parts", touched: bool = True, reach: float = 0.0, filled: bool = True, extent: tuple[int, int, int, int] | None = None
) -> DataFrame:
    """Every (cell, shape) with the cell in the shape (see :func:`spans`), each once.

    Runs are cut at every 256th column; cells and runs meet in an equi-join on the row and
    the stretch of columns. Columns of the shapes must have other names than those of the cells.
    """
    found = _placed(spans(shapes, parts, extent or extent_of(cells), touched, reach, filled))
    return _stretched(cells).join(found.hint("merge"), ["__poly_y", "__poly_s"]).where("ix between x0 and x1").drop("__poly_y", "__poly_s", "x0", "x1")


def _placed(found: DataFrame) -> DataFrame:
    """Runs with their row ``__poly_y``, one row for each stretch ``__poly_s`` of columns."""
    return found.withColumn("__poly_s", F.explode(F.sequence(F.floor(F.col("x0") / STRETCH), F.floor(F.col("x1") / STRETCH)))).withColumnRenamed("iy", "__poly_y")


def _stretched(cells: DataFrame) -> DataFrame:
    return cells.withColumns({"__poly_s": F.floor(F.col("ix") / STRETCH), "__poly_y": F.col("iy").cast("long")})


def looked_up(cells: DataFrame, values: DataFrame, out: str) -> DataFrame:
    """``ix, iy, out``: for all cells their place in the list ``__poly_l`` of their row and stretch; null where there is none."""
    return all_looked_up(cells.select("ix", "iy"), {out: values})


def all_looked_up(cells: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """``cells`` with a column for each layer of such lists; the cells are shuffled once for all."""
    at = _stretched(cells)
    for out, values in layers.items():
        place = F.get("__poly_l", (F.col("ix") - F.col("__poly_s") * STRETCH).cast("int"))
        at = at.join(values.hint("merge"), ["__poly_y", "__poly_s"], "left").select(*at.columns, place.alias(out))
    return at.drop("__poly_y", "__poly_s")


def burned(cells: DataFrame, found: DataFrame, value: Column, order: list[str], out: str) -> DataFrame:
    """``ix, iy, out`` for all cells: of the runs ``found`` (see :func:`spans`) over a cell the value of the one last in ``order``, null where there is none."""
    return looked_up(cells, lists_of(found, value, order), out)


def lists_of(found: DataFrame, value: Column, order: list[str]) -> DataFrame:
    """The lists that :func:`looked_up` takes, of the value of the run last in ``order`` over each cell.

    The runs of a stretch of a row go over its cells one after the other, in batches.
    """
    kind = found.select(value.alias("v")).schema[0].dataType.simpleString()
    keys = ["__poly_y", "__poly_s"]
    runs_ = _placed(found).withColumn("__poly_v", value).repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, "x0", "x1", "__poly_v")
    side = STRETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, pa.Array] | None = None  # the last stretch so far, which may go on in the next batch

        def lists(y: np.ndarray, s: np.ndarray, values: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(y), pa.array(s), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * side), values)], [*keys, "__poly_l"])

        for batch in batches:
            if not batch.num_rows:
                continue
            y, s, a, b = (batch.column(c).to_numpy() for c in (*keys, "x0", "x1"))
            fresh = np.concatenate([[True], (y[1:] != y[:-1]) | (s[1:] != s[:-1])])
            group, begin = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
            values, place = batch.column("__poly_v"), np.full((len(begin), side), -1)
            if held is not None:
                if held[:2] == (y[0], s[0]):
                    place[0] = np.arange(side) + len(values)
                    values = pa.concat_arrays([values, held[2]])
                else:
                    yield lists(np.array([held[0]]), np.array([held[1]]), held[2])
            owner, x = _expand(np.maximum(a, s * side), np.minimum(b, s * side + side - 1))
            place[group[owner], x - s[owner] * side] = owner  # of several the last stays
            flat = place.ravel()
            values = values.take(pa.array(flat, mask=flat < 0))
            done = len(begin) - 1
            held = (int(y[begin[-1]]), int(s[begin[-1]]), values.slice(done * side))
            if done:
                yield lists(y[begin[:-1]], s[begin[:-1]], values.slice(0, done * side))
        if held is not None:
            yield lists(np.array([held[0]]), np.array([held[1]]), held[2])

    return runs_.mapInArrow(run, f"__poly_y bigint, __poly_s bigint, __poly_l array<{kind}>")


def _over(cells: DataFrame, shapes: DataFrame, parts: str, touched: bool, reach: float) -> DataFrame:
    return spans(shapes, parts, extent_of(cells), touched, reach)


def burn_mask(cells: DataFrame, shapes: DataFrame, parts: str = "parts", touched: bool = True, reach: float = 0.0) -> DataFrame:
    """``ix, iy, inside`` for all cells."""
    found = burned(cells, _over(cells, shapes.select(parts), parts, touched, reach), F.lit(True), [], "inside")
    return found.withColumn("inside", F.coalesce("inside", F.lit(False)))


def burn_code(cells: DataFrame, shapes: DataFrame, code: str, order: list[str], parts: str = "parts", touched: bool = True, reach: float = 0.0) -> DataFrame:
    """``ix, iy, code`` for all cells: of the shapes over a cell the one last in ``order``, 0 where there is none."""
    kept = shapes.select(*dict.fromkeys([code, *order, parts]))
    return burned(cells, _over(cells, kept, parts, touched, reach), F.col(code), order, "code").withColumn("code", F.coalesce("code", F.lit(0)))


def burn_max(cells: DataFrame, shapes: DataFrame, score: str, fill: float = 0.0, parts: str = "parts", touched: bool = True, reach: float = 0.0) -> DataFrame:
    """``ix, iy, score`` for all cells: the greatest score of the shapes over it."""
    found = _over(cells, shapes.where(F.col(score).isNotNull()).select(score, parts), parts, touched, reach)
    return burned(cells, found, F.col(score), [score], "score").withColumn("score", F.coalesce("score", F.lit(fill)))
