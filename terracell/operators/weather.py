"""Daily suitability from weather: ordered windows over days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the daily criteria.
WEIGHTS = {"temp": 0.25, "frost": 0.20, "rain": 0.15, "recent": 0.20, "humidity": 0.10, "wind": 0.10}
DRY_MM, BURST_MM, INTENSE_MM = 2.0, 10.0, 20.0


def clip01(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def temperature(t: Column) -> Column:
    return F.when(t.between(10, 20), 1.0).when((t <= 5) | (t >= 25), 0.0).when(t < 10, (t - 5) / 5).otherwise((25 - t) / 5)


def frost(t: Column) -> Column:
    return clip01((t + 3.0) / 5.0)


def rain_today(p: Column) -> Column:
    return F.when(p <= 1, 1.0).when(p <= 5, 1.0 - 0.4 * (p - 1) / 4).otherwise(F.greatest(F.lit(0.0), 0.6 - (p - 5) / 20))


def rain_before(c: Column) -> Column:
    return F.when(c.between(2, 15), 1.0).when(c < 2, F.greatest(F.lit(0.2), c / 2)).otherwise(F.greatest(F.lit(0.3), 1 - (c - 15) / 30))


def humidity(h: Column) -> Column:
    return F.when(h.between(60, 90), 1.0).when(h < 60, F.greatest(F.lit(0.2), h / 60)).otherwise(F.greatest(F.lit(0.5), 1 - (h - 90) / 10))


def wind(w: Column) -> Column:
    return clip01((37.5 - w) / 22.5)


def level(score: Column) -> Column:
    return F.when(score >= 0.75, 4).when(score >= 0.55, 3).when(score >= 0.40, 2).when(score >= 0.25, 1).otherwise(0)


def daily(df: DataFrame, place: list[str] | None = None) -> DataFrame:
    """Scores of each day: ``df`` has ``day, t, tmin, rain, rh, wind`` and may have columns that name the place.

    Adds ``recent`` (rain of the three days before), ``base`` (weighted score), ``bonus`` and
    ``intensity`` of a burst (a dry, mild day after rain), ``score`` and ``level``. Windows
    are ordered by day within the place, so each place is a task's worth of rows at most.
    """
    order = Window.partitionBy(*(place or [F.lit(0)])).orderBy("day")
    three = order.rowsBetween(-3, -1)
    base = (
        WEIGHTS["temp"] * temperature(F.col("t"))
        + WEIGHTS["frost"] * frost(F.col("tmin"))
        + WEIGHTS["rain"] * rain_today(F.col("rain"))
        + WEIGHTS["recent"] * rain_before(F.col("recent"))
        + WEIGHTS["humidity"] * humidity(F.col("rh"))
        + WEIGHTS["wind"] * wind(F.col("wind"))
    )
    df = df.withColumns(
        {
            "recent": F.coalesce(F.sum("rain").over(three), F.lit(0.0)).cast("double"),
            "__wet": F.coalesce(F.count_if(F.col("rain") > DRY_MM).over(three), F.lit(0)),
            "__warm": F.avg("t").over(three),
            "__dry1": F.coalesce(F.lag("rain", 1).over(order) <= DRY_MM, F.lit(False)),
            "__dry2": F.coalesce(F.lag("rain", 2).over(order) <= DRY_MM, F.lit(False)),
            "__dry3": F.coalesce(F.lag("rain", 3).over(order) <= DRY_MM, F.lit(False)),
        }
    )
    run = F.when(~F.col("__dry1"), 0).when(~F.col("__dry2"), 1).when(~F.col("__dry3"), 2).otherwise(3)
    is_burst = (F.col("rain") <= DRY_MM) & (F.col("t") >= 8) & (F.col("recent") >= BURST_MM) & (F.col("__wet") >= 1)
    intense = F.col("recent") >= INTENSE_MM
    bonus = F.when(intense, 0.20).otherwise(0.12) + F.when(F.col("t") - F.col("__warm") >= 3.0, 0.06).otherwise(0.0)
    bonus = bonus * F.when(run > 0, F.greatest(F.lit(0.4), 1 - 0.25 * run)).otherwise(1.0)
    df = df.withColumns(
        {
            "base": base,
            "bonus": F.when(is_burst, F.round(bonus, 3)),
            "intensity": F.when(is_burst & intense, "fort").when(is_burst, "modéré"),
        }
    )
    df = df.withColumn("score", clip01(F.col("base") + F.coalesce("bonus", F.lit(0.0))))
    return df.withColumn("level", level(F.col("score"))).drop("__wet", "__warm", "__dry1", "__dry2", "__dry3")
