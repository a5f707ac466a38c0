"""Results as files: hotspots, report and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell import fixed
from terracell.operators import grid, model

HOTSPOT_COLUMNS = (
    "rank", "id", "x_l93", "y_l93", "lat", "lon", "n_cells", "size_m2", "mean_score", "max_score", "altitude", "mean_slope",
    "dominant_species", "dominant_geology", "compactness", "confidence", "google_maps",
)


def hotspot_table(regions: DataFrame, confidence: float | None = None, top: int | None = None) -> DataFrame:
    """Regions ranked by mean score (of equals the lower number first), with degrees and a map link; missing values stay null."""
    from pyspark.sql import Window

    lat, lon = grid.to_degrees(F.col("x"), F.col("y"))
    order = Window.orderBy(F.desc("mean_score"), "id")
    ranked = regions.withColumns({"mean_score": F.bround("mean_score", 4), "id": F.col("region")})
    if top is not None:  # the ranking then sees no more than the report needs
        ranked = ranked.orderBy(F.desc("mean_score"), "id").limit(top)
    ranked = ranked.withColumns({"lat": F.bround(lat, 6), "lon": F.bround(lon, 6), "rank": F.row_number().over(order)})
    return ranked.select(
        "rank", "id", F.bround("x", 1).alias("x_l93"), F.bround("y", 1).alias("y_l93"), "lat", "lon", "n_cells", "size_m2", "mean_score",
        F.bround("max_score", 4).alias("max_score"), F.bround("altitude", 1).alias("altitude"), F.bround("mean_slope", 1).alias("mean_slope"),
        "dominant_species", "dominant_geology", F.bround("compactness", 3).alias("compactness"), F.lit(confidence).cast("double").alias("confidence"),
        F.format_string("https://www.google.com/maps?q=%.6f,%.6f", "lat", "lon").alias("google_maps"),
    )


def write_hotspots(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report(stats: DataFrame, table: DataFrame, zone: str) -> DataFrame:
    """One JSON document: zone, statistics and the top thirty hotspots."""
    top = table.where("rank <= 30").agg(F.sort_array(F.collect_list(F.struct(*HOTSPOT_COLUMNS))).alias("hotspots"))
    one = F.lit(1).alias("one")
    both = stats.select(one, F.struct("*").alias("statistics")).join(top.select(one, "hotspots"), "one")
    return both.select(F.to_json(F.struct(F.lit(zone).alias("zone"), "statistics", "hotspots")).alias("value"))


def export_cells(cells: DataFrame, path: str, cell: float, west: float, north: float, threshold: float = 0.3) -> None:
    """Cells with a score of at least the threshold as Parquet: box, class and label beside all columns."""
    x, y = west + F.col("ix") * cell, north - F.col("iy") * cell
    cls = model.class_of(F.col("score"))
    boxed = cells.where(F.col("score") >= threshold).withColumns(
        {"xmin": x, "xmax": x + cell, "ymax": y, "ymin": y - cell, "prob_class": cls, "prob_label": model.class_name(cls)}
    )
    boxed.write.mode("overwrite").parquet(path)


def data_channels(score, altitude) -> dict:
    """Score and altitude as three bytes: score times 200 (255 missing), altitude plus 500 in two bytes."""
    shifted = F.coalesce((altitude + 500).cast("int"), F.lit(0))
    return {
        "red": F.coalesce(F.bround(score * 200).cast("int"), F.lit(255)),
        "green": F.shiftright(shifted, 8).bitwiseAND(F.lit(255)),
        "blue": shifted.bitwiseAND(F.lit(255)),
    }


def class_names() -> tuple[str, ...]:
    return fixed.CLASS_NAMES
