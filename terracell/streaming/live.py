"""The daily weather measures kept up to date from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_measures(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts of each kind of event by day from a stream with ``ts, event_type``.

    Events up to ``late`` behind the newest one are counted; a day comes out once it can no
    longer change. On a batch DataFrame the same aggregation runs at once.
    """
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    n = lambda kind: F.count_if(F.col("event_type") == kind).alias(kind)
    per_day = stamped.groupBy(F.window("ts", "1 day").alias("w")).agg(n("view"), n("error"), n("click"), n("purchase"))
    return per_day.select(F.to_date("w.start").alias("day"), "view", "error", "click", "purchase")
