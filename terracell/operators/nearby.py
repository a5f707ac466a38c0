"""Points near other points, and regions that hold points."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions.geometry import BoxTree, ear_clip, in_triangles, regular_polygon

EARTH_M = 6_371_008.8
CELL_M = 500.0
HOT_CELL = 20_000
FEW_CELLS = 100_000  # crowded cells that are broadcast at most


def valid_position(lat: Column, lon: Column) -> Column:
    """Both coordinates present and in range, not both zero."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def _key(x: Column, y: Column, z: Column) -> Column:
    part = [F.floor(v).cast("long") + 20_000 for v in (x, y, z)]
    return part[0] * 1_600_000_000 + part[1] * 40_000 + part[2]


def _pairs_in(cell: np.ndarray, home: np.ndarray, ident: np.ndarray, lat: np.ndarray, lon: np.ndarray, radius: float, side: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (owner of a region, point in it) of rows of the same cell."""
    la, lo = np.radians(lat), np.radians(lon)
    xyz = np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)]) * EARTH_M
    east = np.column_stack([-np.sin(lo), np.cos(lo), np.zeros_like(lo)])
    north = np.column_stack([-np.sin(la) * np.cos(lo), -np.sin(la) * np.sin(lo), np.cos(la)])
    _, first, rank = np.unique(cell, return_index=True, return_inverse=True)
    # each cell gets its own stretch of the first axis, so that one hierarchy serves all cells of the batch
    placed = xyz - xyz[first][rank]
    placed[:, 0] += rank * (8 * side)
    outline = regular_polygon(radius * (1 + 1e-6) + 1e-3)
    triangle = outline[ear_clip(outline)]
    reach = np.abs(outline).max() + 1e-3
    # a leaf of the hierarchy holds the triangles around one owner; its box is that of the turned outline
    half = reach * np.sqrt(east**2 + north**2) + 0.01
    tree = BoxTree(placed - half, placed + half)
    points = np.flatnonzero(home)
    found_a, found_b = [], []
    step = 20_000
    for k in range(0, len(points), step):  # bounds the memory of the frontier
        some = points[k : k + step]
        who, owner = tree.candidates(placed[some])
        point = some[who]
        wanted = (ident[owner] < ident[point]) & (cell[owner] == cell[point])
        point = np.repeat(point[wanted], len(triangle))
        owner = np.repeat(owner[wanted], len(triangle))
        which = np.tile(np.arange(len(triangle)), int(wanted.sum()))
        apart = xyz[point] - xyz[owner]
        flat = np.column_stack([(apart * east[owner]).sum(1), (apart * north[owner]).sum(1)])
        inside = in_triangles(flat, triangle[which], reach * reach * 1e-9)
        point, owner, apart = point[inside], owner[inside], apart[inside]
        arc = 2 * EARTH_M * np.arcsin(np.minimum(1, np.sqrt((apart**2).sum(1)) / (2 * EARTH_M)))
        near = arc <= radius
        both = np.unique(np.column_stack([owner[near], point[near]]), axis=0)  # a point on the side of two triangles counts once
        found_a.append(ident[both[:, 0]])
        found_b.append(ident[both[:, 1]])
    return np.concatenate(found_a or [np.zeros(0, np.int64)]), np.concatenate(found_b or [np.zeros(0, np.int64)])


def _fresh(table: pa.Table) -> np.ndarray:
    """Where another cell, or another part of a cell, begins."""
    cell, part = table.column("cell").to_numpy(), table.column("part").to_numpy()
    return np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])


def _near_batches(radius: float, side: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def work(table: pa.Table) -> pa.RecordBatch:
            col = lambda n: table.column(n).to_numpy()
            a, b = _pairs_in(np.cumsum(_fresh(table)), col("home"), col("id"), col("lat"), col("lon"), radius, side)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["id_a", "id_b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 50_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(_fresh(table))[-1])  # rows come in order of cell; the last cell may go on
            if cut:
                yield work(table.slice(0, cut))
                table = table.slice(cut)
            held, rows = table.to_batches(), table.num_rows
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return run


def pairs_within(df: DataFrame, ident: str, lat: str, lon: str, radius_m: float) -> DataFrame:
    """All pairs of rows at most ``radius_m`` metres apart on the sphere: ``id_a < id_b``.

    Each row owns a polygon around its circle, cut into triangles by ear clipping. The
    triangles go to the cells of a grid on the sphere that they touch, and there into a
    bounding-volume hierarchy in which every row of the cell looks up the triangles that
    hold it. Candidates are tested exactly, first against the triangle, then by distance.
    A row is looked up in its own cell only, so each pair comes out once.

    The grid is laid through space (x, y, z of the unit sphere), so poles and the date line
    need no care. Rows without valid coordinates take part in nothing; rows with the same
    coordinates and different ids are pairs; a null id takes no part; repeated rows with the
    same id are no pair with each other. Cells with more than 20 000 rows are split: their
    looking-up rows go to several tasks, each with a copy of the triangles of the cell. The
    cells are 500 m wide, or five times the radius where that is more; the radius is meant to be
    small against the sphere (up to some ten kilometres), since circles are laid out flat.
    """
    side = max(CELL_M, 5 * radius_m)
    la, lo = F.radians(F.col("lat")), F.radians(F.col("lon"))
    scale = EARTH_M / side
    rows = (
        df.select(df[ident].cast("long").alias("id"), df[lat].cast("double").alias("lat"), df[lon].cast("double").alias("lon"))
        .where(valid_position(F.col("lat"), F.col("lon")) & F.col("id").isNotNull())
        .withColumns({"x": F.cos(la) * F.cos(lo) * scale, "y": F.cos(la) * F.sin(lo) * scale, "z": F.sin(la) * scale})
    )
    reach = radius_m * 1.2 / side
    around = F.array_distinct(
        F.array(
            *[
                _key(F.col("x") + sx * reach, F.col("y") + sy * reach, F.col("z") + sz * reach)
                for sx in (-1, 1)
                for sy in (-1, 1)
                for sz in (-1, 1)
            ]
        )
    )
    rows = rows.withColumn("own", _key(F.col("x"), F.col("y"), F.col("z")))
    hot = rows.groupBy(F.col("own").alias("cell")).count().where(F.col("count") > HOT_CELL).select("cell", F.ceil(F.col("count") / HOT_CELL).cast("int").alias("parts"))
    placed = rows.select("id", "lat", "lon", "own", F.explode(around).alias("cell")).select("id", "lat", "lon", "cell", (F.col("own") == F.col("cell")).alias("home"))
    few = hot.limit(FEW_CELLS + 1).collect()
    if not few:
        parts = placed.withColumn("part", F.lit(0))
    else:
        if len(few) <= FEW_CELLS:  # else the join shuffles both sides
            hot = F.broadcast(df.sparkSession.createDataFrame(few, hot.schema))
        parts = placed.join(hot, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        turn = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        parts = parts.select("id", "lat", "lon", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "home", turn.alias("turn"))
        parts = parts.select("id", "lat", "lon", "cell", "part", (F.col("home") & (F.col("turn") == F.col("part"))).alias("home"))
    return parts.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_near_batches(radius_m, side), "id_a bigint, id_b bigint")


def regions_of_points(
    points: DataFrame, ident: str, x: str, y: str, regions: DataFrame, region_id: str, corners: str, block: int = 50_000
) -> DataFrame:
    """The regions that hold each point: ``point_id, region_id``, borders included.

    ``corners`` of ``regions`` is an array of (x, y) structs or two-element arrays, the
    outline of a simple polygon. The polygons are ear-clipped into triangles and put into
    a bounding-volume hierarchy that every task gets by broadcast; they are counted first,
    and more than ``block`` of them go against the points in blocks of about that many. A
    point on the border of two triangles of a region is assigned to it once, a point on the
    border of two regions to both, since regions may overlap. Null ids or coordinates give
    no row, null or degenerate outlines hold nothing.
    """
    known = regions.select(regions[region_id].cast("string").alias("name"), regions[corners].cast("array<array<double>>").alias("outline")).where(F.size("outline") >= 3)
    at = points.select(points[ident].cast("long").alias("point_id"), points[x].cast("double").alias("x"), points[y].cast("double").alias("y")).dropna()
    blocks = max(1, math.ceil(known.count() / block))
    found = None
    for k in range(blocks):
        some = known.where(F.pmod(F.xxhash64("name", "outline"), F.lit(blocks)) == k) if blocks > 1 else known
        part = at.mapInPandas(_regions_at(points.sparkSession.sparkContext.broadcast(_triangles(some.collect()))), "point_id bigint, region_id string")
        found = part if found is None else found.unionByName(part)
    return found


def _triangles(taken: list) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names of regions, the triangles of all of them, and the number of the region of each."""
    names, shapes, owner = [], [], []
    for name, outline in taken:
        polygon = np.array(outline, float)
        cut = ear_clip(polygon)
        shapes.append(polygon[cut].reshape(-1, 3, 2))
        owner += [len(names)] * len(cut)
        names.append(name)
    return names, np.concatenate(shapes or [np.zeros((0, 3, 2))]), np.array(owner, np.int64)


def _regions_at(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, triangle, whose = shared.value
        tree = BoxTree(triangle.min(1), triangle.max(1))
        for batch in batches:
            at = batch[["x", "y"]].to_numpy(float)
            who, box = tree.candidates(at)
            inside = in_triangles(at[who], triangle[box]) if len(who) else np.zeros(0, bool)
            both = np.unique(np.column_stack([who[inside], whose[box[inside]]]), axis=0)
            yield pd.DataFrame({"point_id": batch["point_id"].to_numpy()[both[:, 0]], "region_id": pd.Series([names[k] for k in both[:, 1]], dtype=object)})

    return run


def box_corners(west: str, south: str, east: str, north: str) -> Column:
    """The outline of a box."""
    return F.array(*[F.array(F.col(a), F.col(b)) for a, b in ((west, south), (east, south), (east, north), (west, north))])
