"""Fuzzy membership functions of one band, and overlays of several, as Columns.

NULL (masked) stays NULL in memberships; ``or`` and ``and`` skip it, the other overlays do not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gaussian(x: Column, mid: float, spread: float) -> Column:
    return F.exp(-spread * F.pow(x - mid, F.lit(2)))


def near(x: Column, mid: float, spread: float) -> Column:
    return 1 / (1 + spread * F.pow(x - mid, F.lit(2)))


def large(x: Column, mid: float, spread: float) -> Column:
    return F.try_divide(F.lit(1.0), 1 + F.pow(x / mid, F.lit(float(-spread))))


def small(x: Column, mid: float, spread: float) -> Column:
    return F.try_divide(F.lit(1.0), 1 + F.pow(x / mid, F.lit(float(spread))))


def _by_moments(px: DataFrame, band: str, name: str, mean_scaling: float, std_scaling: float, large_values: bool) -> DataFrame:
    moments = px.groupBy("scene_id").agg(F.avg(band).alias("__mean"), F.stddev_pop(band).alias("__std"))
    mean, spread = F.col("__mean") * mean_scaling, F.col("__std") * std_scaling
    share = F.try_divide(spread, F.col(band) - mean + spread)
    value = (1 - share) if large_values else share
    return px.join(moments, "scene_id", "left").withColumn(name, value * (F.col(band) >= mean).cast("int")).drop("__mean", "__std")


def mslarge(px: DataFrame, band: str, name: str, mean_scaling: float = 1.0, std_scaling: float = 1.0) -> DataFrame:
    """Membership of large values by the scene's mean and deviation; 0 below the scaled mean."""
    return _by_moments(px, band, name, mean_scaling, std_scaling, True)


def mssmall(px: DataFrame, band: str, name: str, mean_scaling: float = 1.0, std_scaling: float = 1.0) -> DataFrame:
    """The complement of ``mslarge`` on the same pixels (values from the scaled mean on)."""
    return _by_moments(px, band, name, mean_scaling, std_scaling, False)


def linear(x: Column, low: float, high: float) -> Column:
    """Rises from 0 at ``low`` to 1 at ``high``; falls instead if ``low > high``."""
    a, b = min(low, high), max(low, high)
    rise = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a)))
    value = rise if low <= high else 1 - rise
    return F.when(x.isNotNull(), value)


def zmf(x: Column, low: float, high: float) -> Column:
    """Z-shaped fall from 1 at ``low`` to 0 at ``high``; its complement if ``low > high``."""
    a, b = min(low, high), max(low, high)
    mid = (a + b) / 2
    fall = (
        F.when(x < a, 1.0)
        .when(x >= b, 0.0)
        .when(x < mid, 1 - 2 * F.pow((x - a) / (b - a), F.lit(2)))
        .when(x >= mid, 2 * F.pow((x - b) / (b - a), F.lit(2)))
    )
    return fall if low <= high else 1 - fall


def fuzzy_or(*layers: Column) -> Column:
    return F.greatest(*layers)


def fuzzy_and(*layers: Column) -> Column:
    return F.least(*layers)


def product(*layers: Column) -> Column:
    return reduce(lambda a, b: a * b, layers)


def fuzzy_sum(*layers: Column) -> Column:
    return 1 - product(*[1 - x for x in layers])


def gamma(*layers: Column, power: float = 0.5) -> Column:
    return F.pow(fuzzy_sum(*layers), F.lit(power)) * F.pow(product(*layers), F.lit(1 - power))


def weighted(layers: list[Column], weights: list[float]) -> Column:
    return reduce(lambda a, b: a + b, (x * w for x, w in zip(layers, weights, strict=True)))
