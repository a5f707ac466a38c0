"""The multi-criteria model: weighting, exclusion, penalties, classes, summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell import fixed
from terracell.operators import focal, graph


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within the limits; null stays null, which greatest and least alone would pass over."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def weighted(scores: dict[str, Column], weights: dict[str, float] = fixed.WEIGHTS) -> tuple[Column, Column]:
    """(score, coverage): the weighted mean of the criteria that are not null, lowered by the weight that is missing.

    One projection; a criterion without weight is not looked at.
    """
    used = {k: w for k, w in weights.items() if w > 0}
    have = sum((F.when(scores[k].isNotNull(), w).otherwise(0.0) for k, w in used.items() if k in scores), F.lit(0.0))
    total = sum((F.coalesce(scores[k] * w, F.lit(0.0)) for k, w in used.items() if k in scores), F.lit(0.0))
    coverage = have / sum(used.values())
    return clip(F.try_divide(total, have) * (0.5 + 0.5 * coverage)), coverage


def exclusions(df: DataFrame) -> dict[str, Column]:
    """The hard exclusions as boolean columns; null counts as not excluded.

    ``df``: ``urban, water, nodata, geology, slope, altitude, twi, dist_urban``.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    return {
        "urban": no(F.col("urban")),
        "water": no(F.col("water")),
        "nodata": no(F.col("nodata")),
        "geology": no(F.col("geology").isin(*fixed.EXCLUDED_GEOLOGY)),
        "slope": no(F.col("slope") > 50),
        "altitude": no((F.col("altitude") < 100) | (F.col("altitude") > 1400)),
        "waterlogged": no(F.col("twi") > 18),
        "near_urban": no((F.col("dist_urban") < 15) & ~no(F.col("urban"))),
    }


def fade(score: Column, cells_to_excluded: Column, buffer_m: float, cell: float) -> Column:
    """The score lowered towards excluded cells over the buffer, whose width is at least one cell."""
    width = max(1, round(buffer_m / cell))
    return score * F.least(F.lit(1.0), F.coalesce(cells_to_excluded, F.lit(float(width))) / width)


def dry_limestone(score: Column, applies: Column, roughness: Column, twi: Column) -> Column:
    """The score lowered on dry limestone, the more the rougher and drier; missing measures leave it."""
    return F.when(F.coalesce(applies, F.lit(False)), score * dry_factor(roughness, twi)).otherwise(score)


def dry_factor(roughness: Column, twi: Column) -> Column:
    drop = 0.4 * clip(roughness / 10) + 0.6 * clip((8 - twi) / 6)
    return F.coalesce(clip(1 - 0.5 * drop, 0.5), F.lit(1.0))


def monotony(df: DataFrame, score: str, slope: str, altitude: str, out: str, excluded: str | None = None, radius: int = 50) -> DataFrame:
    """``ix, iy, out``: the score lowered by up to 15 % where the ground is flat and even over a wide radius.

    The share of flat cells (under 8 degrees) and the spread of the altitude are Gaussian
    means of half the radius, in one pass over tiles; only where the spread stays under 15 m
    does flatness count. Excluded and missing scores stay. Missing altitudes count as 0.
    """
    w = focal.gaussian_weights(radius / 2.0)
    ground = df.select("ix", "iy", (F.col(slope) < 8).cast("double").alias("__f"), F.col(altitude).alias("__z"))
    even = focal.tiled(ground, ["__f", "__z"], len(w) // 2, lambda values, there: _even(values, there, w), "__m")
    stays = F.coalesce(F.col(excluded), F.lit(False)) if excluded else F.lit(False)
    lowered = F.when(stays, F.col(score)).otherwise(F.col(score) * (1 - 0.15 * F.coalesce("__m", F.lit(0.0))))
    return df.join(even, ["ix", "iy"]).select("ix", "iy", lowered.alias(out))


def _even(values: list[np.ndarray], there: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The share of flat cells around, 0 where the altitude spreads."""
    flat, z = map(np.nan_to_num, values)
    layers = [flat, z, z * z]
    for axis in (1, 0):
        at = focal._edge_index(there, False, axis, len(w) // 2)
        layers = [sum(w[k] * np.take(x, at[:, k], axis=axis) for k in range(len(w))) for x in layers]
    share, mean, square = layers
    return np.where(np.sqrt(np.maximum(square - mean**2, 0.0)) < 15.0, np.clip(share, 0.0, 1.0), 0.0)


def settled(df: DataFrame, score: str, slope: str, altitude: str, factor: Column, excluded: str, out: str, radius: int = 50, sigma: float = 2.0, extent: tuple[int, int, int, int] | None = None) -> DataFrame:
    """``df`` with ``out``: the score lowered as by :func:`monotony`, times ``factor``, then smoothed over the cells not excluded.

    All in one pass over tiles that takes the other columns along; excluded cells get what is
    smoothed around them.
    """
    wide, near = focal.gaussian_weights(radius / 2.0), focal.gaussian_weights(sigma)

    def kernel(values: list[np.ndarray], there: np.ndarray) -> np.ndarray:
        flat, z, v, times = values
        return focal.smoothed(v * (1 - 0.15 * _even([flat, z], there, wide)) * times, there, near)

    layers = {"__f": (F.col(slope) < 8).cast("double"), "__z": F.col(altitude), "__v": F.when(~F.col(excluded), F.col(score)), "__t": factor}
    return focal.tiled(df.withColumns(layers), list(layers), len(wide) // 2 + len(near) // 2, kernel, out, keep=df.columns, extent=extent)


def hotspots(df: DataFrame, width: int, cell: float, threshold: float = 0.65, least: int = 4, limit: int | None = None) -> DataFrame:
    """The regions of high scores (see :func:`graph.region_stats`), the highest mean first where ``limit`` asks for the top.

    ``df``: a full rectangle ``ix, iy, score, altitude, slope, species, geology``. High cells
    are closed over eight neighbours first; cells that closing adds count in all means.
    """
    hot = df.withColumn("__hot", F.coalesce(F.col("score") >= threshold, F.lit(False)))
    hot = focal.close_mask(hot, "__hot", "__closed").where("__closed").drop("__hot", "__closed")
    named = graph.components(hot, width)
    stats = graph.region_stats(hot.join(named, ["ix", "iy"]), cell, least)
    return stats if limit is None else stats.orderBy(F.desc("mean_score"), "region").limit(limit)


def validate(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each criterion: ``criterion, missing, low, high, valid``; values may leave 0..1 by a thousandth."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    long = df.select(F.expr(f"stack({len(columns)}, {pairs}) as (criterion, s)"))
    stats = long.groupBy("criterion").agg(F.count_if(F.col("s").isNull()).alias("missing"), F.min("s").alias("low"), F.max("s").alias("high"))
    return stats.withColumn("valid", F.coalesce((F.col("low") >= -0.001) & (F.col("high") <= 1.001), F.lit(False)))


def class_of(score: Column) -> Column:
    """0 to 5 by the class limits, the limit itself in the upper class; -1 for null."""
    return F.when(score.isNull(), -1).otherwise(sum((F.when(score >= t, 1).otherwise(0) for t in fixed.CLASS_LIMITS), F.lit(0)))


def class_name(cls: Column) -> Column:
    return F.get(F.array(*map(F.lit, fixed.CLASS_NAMES)), cls)


def distribution(df: DataFrame, score: str) -> DataFrame:
    """``class, label, n``."""
    return df.groupBy(class_of(F.col(score)).alias("class")).agg(F.count("*").alias("n")).select("class", class_name(F.col("class")).alias("label"), "n")


def run_stats(df: DataFrame, score: str) -> DataFrame:
    """One row: number of cells, spread of the scores, cells that are high, medium and low, and their share of all cells."""
    s = F.col(score)
    share = lambda c: F.round(100.0 * F.count_if(c) / F.nullif(F.count("*"), F.lit(0)), 6)
    high, medium = s >= 0.7, (s >= 0.4) & (s < 0.7)
    return df.agg(
        F.count("*").alias("n_cells"),
        F.round(F.min(s), 6).alias("score_min"),
        F.round(F.max(s), 6).alias("score_max"),
        F.round(F.avg(s), 6).alias("score_mean"),
        F.round(F.median(s), 6).alias("score_median"),
        F.round(F.stddev_pop(s), 6).alias("score_std"),
        F.count_if(high).alias("n_high"),
        F.count_if(medium).alias("n_medium"),
        F.count_if(s < 0.4).alias("n_low"),
        share(high).alias("pct_high"),
        share(medium).alias("pct_medium"),
    )


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each criterion: min, max, mean, median, population deviation, share of zeros and of high values."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    long = df.select(F.expr(f"stack({len(columns)}, {pairs}) as (criterion, s)"))
    s = F.col("s")
    return long.groupBy("criterion").agg(
        F.round(F.min(s), 6).alias("min"),
        F.round(F.max(s), 6).alias("max"),
        F.round(F.avg(s), 6).alias("mean"),
        F.round(F.median(s), 6).alias("median"),
        F.round(F.stddev_pop(s), 6).alias("std"),
        F.round(100.0 * F.count_if(s == 0) / F.count("*"), 6).alias("pct_zero"),
        F.round(100.0 * F.count_if(s >= 0.7) / F.count("*"), 6).alias("pct_high"),
    )
