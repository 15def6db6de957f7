"""Fuzzy extents, histogram matching, component fusion and elevation fill steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .focal import box_stats, focal, square
from .ranks import next_value, running_counts
from .threshold import histogram, otsu

YX = ["y", "x"]


def fuzzy_otsu(
    px: DataFrame, band: str, initial: float, grid: int = 5, least: int = 1000, spread: float = 0.2, width: float = 0.25, out: str = "water"
) -> DataFrame:
    """Membership of water: 1 below the midpoint of two thresholds, a bell curve above it.

    The first threshold is Otsu's over the tiles with more than ``least`` pixels on each side of
    ``initial``, the second is Otsu's over those tiles' values below the first. All such tiles count.
    """
    tiled = px.withColumns({"ty": F.floor(F.col("y") / grid), "tx": F.floor(F.col("x") / grid)})
    low = F.col(band) < initial
    sides = tiled.groupBy("scene_id", "ty", "tx").agg(F.count(F.when(low, 1)).alias("water"), F.count(F.when(~low, 1)).alias("land"))
    both = sides.where((F.col("water") > least) & (F.col("land") > least))
    inside = tiled.join(both, ["scene_id", "ty", "tx"], "left_semi")
    first = otsu(histogram(inside, band, width, ["scene_id"]), ["scene_id"]).withColumnRenamed("threshold", "__first")
    lower = inside.join(first, "scene_id").where(F.col(band) < F.col("__first"))
    second = otsu(histogram(lower, band, width, ["scene_id"]), ["scene_id"]).withColumnRenamed("threshold", "__second")
    middle = first.join(second, "scene_id").select("scene_id", ((F.col("__first") + F.col("__second")) / 2).alias("__mid"))
    away = F.col(band) - F.col("__mid")
    value = F.when(away < 0, 1.0).otherwise(F.exp(-spread * away * away))
    return px.join(middle, "scene_id", "left").withColumn(out, value).drop("__mid")


def match_histograms(px: DataFrame, predictor: str, target: str, out: str = "dn") -> DataFrame:
    """``predictor`` with the distribution of ``target``: the least target value whose cumulative share reaches its own.

    Exact for any values: equal ones are counted, the counts are ranked over ranges, and the ranks of both, each
    times the other's number of values, are merged in one order. NULL predictors stay NULL, as do all if
    there is no target value.
    """

    def ranked(column: str) -> DataFrame:
        counts = px.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("n"))
        return running_counts(counts, [], "__v")

    own, other = ranked(predictor), ranked(target)
    # Whole numbers of 38 digits: counts of both sides can be multiplied.
    sizes = [r.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("decimal(19,0)").alias("__of")) for r in (other, own)]
    keyed = [r.crossJoin(F.broadcast(s)).withColumn("__key", F.col("upto").cast("decimal(19,0)") * F.col("__of")) for r, s in zip((own, other), sizes)]
    left = keyed[0].select("__key", F.lit(0).alias("__side"), "__v", F.lit(None).cast("double").alias("__to"))
    right = keyed[1].select("__key", F.lit(1).alias("__side"), "__v", F.col("__v").cast("double").alias("__to"))
    found = next_value(left.unionAll(right), ["__key", "__side", "__v"], "__to", out).where("__side = 0")
    return px.join(found.select(F.col("__v").alias("__own"), out), F.col(predictor) == F.col("__own"), "left").drop("__own")


def pca_fusion(
    px: DataFrame,
    band: str,
    stats: DataFrame,
    match_stats: DataFrame,
    centre: tuple[float, float],
    component: tuple[float, float],
    inverse: bool = True,
    limit: float = 3.75,
    out: str = "df_index",
) -> DataFrame:
    """First component of a band and of its likeness on another sensor's scale, within +-``limit``.

    ``stats`` and ``match_stats`` have (y, x, mean, std): the band's and the other sensor's by pixel.
    """
    own = stats.select(*YX, F.col("mean").alias("__m"), F.col("std").alias("__s"))
    other = match_stats.select(*YX, F.col("mean").alias("__mm"), F.col("std").alias("__ms"))
    z = F.try_divide(F.col(band) - F.col("__m"), F.col("__s")) * (-1 if inverse else 1)
    likeness = F.col("__mm") + z * F.col("__ms")
    first = component[0] * (F.col(band) - centre[0]) + component[1] * (likeness - centre[1])
    clamped = F.when(first.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), first)))
    return px.join(own, YX).join(other, YX).withColumn(out, clamped).drop("__m", "__s", "__mm", "__ms")


def mean_fill_step(px: DataFrame, level: str, mask: str, out: str, r: int = 1) -> DataFrame:
    """One step of mean boundary elevations: the box mean of the known levels, inside the mask."""
    got = box_stats(px, level, r, "__")
    return got.withColumn(out, F.when(F.col(mask) == 1, F.col("__mean"))).drop("__mean", "__var", "__count")


def nearest_fill_step(px: DataFrame, level: str, mask: str, out: str) -> DataFrame:
    """One step of nearest boundary elevations: a known level stays, else the least side neighbour's, else the least corner's."""
    side = F.abs("dy") + F.abs("dx") == 1
    got = focal(px, [level], square(1, centre=False), __side=F.min(F.when(side, F.col(level))), __corner=F.min(F.when(~side, F.col(level))))
    return got.withColumn(out, F.when(F.col(mask) == 1, F.coalesce(level, "__side", "__corner"))).drop("__side", "__corner")
