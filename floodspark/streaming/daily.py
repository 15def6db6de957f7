"""Daily means of a pixel stream, as a watermarked tumbling window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_means(pixels: DataFrame, band: str, late: str = "1 day") -> DataFrame:
    """(day, y, x, mean, n) of a stream (or a batch) of pixels with an event time ``ts``."""
    return (
        pixels.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("w"), "y", "x")
        .agg(F.avg(band).alias("mean"), F.count(band).alias("n"))
        .select(F.col("w.start").alias("day"), "y", "x", "mean", "n")
    )
