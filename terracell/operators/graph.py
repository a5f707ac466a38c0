"""Connected regions and flow on a grid of cells."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracell.functions.checkpoint import cut
from terracell.operators.focal import DIRECTIONS

TILE = 256


def components(df: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """Regions of cells that touch over eight neighbours: ``ix, iy, region``, numbered from 1 in raster order of their first cell.

    ``df`` holds the set cells only (``ix, iy``). Regions are found within tiles first;
    then only the pairs of tile regions that touch across a border go through rounds of
    least-label propagation, and the lineage is cut each few rounds.
    """
    ident = F.col("iy").cast("long") * width + F.col("ix")
    cells = df.select(F.col("ix").cast("long"), F.col("iy").cast("long")).distinct().withColumn("id", ident)
    tiles = cells.groupBy(F.floor(F.col("ix") / tile).alias("tx"), F.floor(F.col("iy") / tile).alias("ty"))
    local = cut(tiles.applyInPandas(_label_runs(tile), "id long, ix long, iy long, label long"))
    border = local.where(
        (F.col("ix") % tile).isin(0, tile - 1) | (F.col("iy") % tile).isin(0, tile - 1)
    )
    ahead = [(1, 0), (1, 1), (0, 1), (-1, 1)]
    reach = border.select("label", F.explode(F.array(*[F.struct((F.col("ix") + dx).alias("ix"), (F.col("iy") + dy).alias("iy")) for dx, dy in ahead])).alias("n")).select(
        F.col("label").alias("a"), "n.ix", "n.iy"
    )
    links = reach.join(border.select(F.col("label").alias("b"), "ix", "iy"), ["ix", "iy"]).where("a <> b").select("a", "b").distinct()
    links = cut(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    root = cut(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        # least root among neighbours, then the root of that root
        seen = links.join(root.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = root.join(seen, "a").select("a", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = step.select(F.col("a").alias("root"), F.col("root").alias("over"))
        after = cut(step.join(jump, "root", "left").select("a", F.coalesce("over", "root").alias("root"), "old"))
        if after.where("root <> old").limit(1).count() == 0:
            break
        root = after.select("a", "root")
    merged = local.join(root.withColumnRenamed("a", "label"), "label", "left").select("ix", "iy", F.coalesce("root", "label").alias("first"))
    # numbers 1, 2, ... by counting the first cells per stretch of the raster, without one global sort in a task
    heads = merged.select("first").distinct().withColumn("block", F.floor(F.col("first") / (width * tile)))
    before = heads.groupBy("block").count()
    sums = before.select("block", (F.sum("count").over(Window.orderBy("block")) - F.col("count")).alias("base"))
    number = heads.join(F.broadcast(sums), "block").select("first", (F.col("base") + F.row_number().over(Window.partitionBy("block").orderBy("first"))).alias("region"))
    return merged.join(number, "first").select("ix", "iy", "region")


def _label_runs(tile: int):
    """A function that labels one tile by joining its rows' runs with a union-find."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["iy", "ix"])
        x, y, ident = (pdf[c].to_numpy() for c in ("ix", "iy", "id"))
        new = np.concatenate([[True], (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)])
        start = np.flatnonzero(new)
        stop = np.concatenate([start[1:], [len(x)]]) - 1
        row, left, right = y[start], x[start], x[stop]
        up = list(range(len(start)))

        def root(a: int) -> int:
            while up[a] != a:
                up[a] = up[up[a]]
                a = up[a]
            return a

        i = 0
        for j in range(len(start)):  # runs come by row; i walks through the row above
            while i < j and (row[i] < row[j] - 1 or row[i] == row[j] - 1 and right[i] < left[j] - 1):
                i += 1
            k = i
            while k < j and row[k] == row[j] - 1 and left[k] <= right[j] + 1:
                a, b = root(k), root(j)
                up[max(a, b)] = min(a, b)
                k += 1
        top = np.array([root(k) for k in range(len(start))], np.int64)
        label = ident[start][top][np.cumsum(new) - 1]
        return pd.DataFrame({"id": ident, "ix": x, "iy": y, "label": label})

    return run


def region_stats(cells: DataFrame, cell: float, least: int, west: float = 0.0, north: float = 0.0) -> DataFrame:
    """One row for each region of at least ``least`` cells.

    ``cells``: ``ix, iy, region, score, altitude, slope, species, geology``. Missing numbers
    count as 0 in the means; the dominant names are the most frequent ones, of equals the
    first in the alphabet. The perimeter counts cells with a neighbour (of four) outside.
    """
    row, column = Window.partitionBy("iy").orderBy("ix"), Window.partitionBy("ix").orderBy("iy")
    r = F.col("region")

    def same(w, k: int, at: str):
        other = F.lag if k < 0 else F.lead
        beside = F.abs(other(at).over(w) - F.col(at)) == 1
        return F.coalesce(beside & (other("region").over(w) == r), F.lit(False))

    edge = ~(same(row, -1, "ix") & same(row, 1, "ix") & same(column, -1, "iy") & same(column, 1, "iy"))
    marked = cells.withColumn("__edge", edge.cast("int"))
    n = F.count("*")
    around = F.sum("__edge") * cell
    return (
        marked.groupBy("region")
        .agg(
            n.alias("n_cells"),
            (n * cell * cell).alias("size_m2"),
            F.avg(F.coalesce("score", F.lit(0.0))).alias("mean_score"),
            F.max(F.coalesce("score", F.lit(0.0))).alias("max_score"),
            (west + (F.avg("ix") + 0.5) * cell).alias("x"),
            (north - (F.avg("iy") + 0.5) * cell).alias("y"),
            F.avg(F.coalesce("altitude", F.lit(0.0))).alias("altitude"),
            F.avg(F.coalesce("slope", F.lit(0.0))).alias("mean_slope"),
            F.mode("species", True).alias("dominant_species"),
            F.mode("geology", True).alias("dominant_geology"),
            F.when(around > 0, 4 * math.pi * n * cell * cell / (around * around)).otherwise(0.0).alias("compactness"),
        )
        .where(F.col("n_cells") >= least)
    )


def flow_accumulation(df: DataFrame, width: int, cell_area: float = 1.0) -> DataFrame:
    """``ix, iy, acc``: the area that drains through each cell, itself included.

    ``df`` has ``ix, iy, flow`` (0 to 7, -1 where the flow ends). Flow runs strictly down,
    so it is a forest; sums are doubled along it: after k rounds every cell holds what lies
    up to 2^k - 1 steps above it and knows the cell 2^k steps below. The longest path needs
    about log2 of its length rounds, each one aggregation and one join.
    """
    offsets = F.array(*[F.lit(dy * width + dx) for dx, dy in DIRECTIONS])
    ident = F.col("iy").cast("long") * width + F.col("ix")
    state = df.select("ix", "iy", ident.alias("id"), F.lit(float(cell_area)).alias("acc"), F.when(F.col("flow") >= 0, ident + F.get(offsets, F.col("flow"))).alias("down"))
    state = cut(state)
    while True:
        given = state.where("down is not null").groupBy(F.col("down").alias("id")).agg(F.sum("acc").alias("more"))
        below = state.select(F.col("id").alias("down"), F.col("down").alias("next"))
        state = cut(
            state.join(given, "id", "left")
            .join(below, "down", "left")
            .select("ix", "iy", "id", (F.col("acc") + F.coalesce("more", F.lit(0.0))).alias("acc"), F.col("next").alias("down"))
        )
        if state.where("down is not null").limit(1).count() == 0:
            return state.select("ix", "iy", "acc")
