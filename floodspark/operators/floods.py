"""Flood extraction, durations, depths, terrain corrections and fusion, over pixel DataFrames."""

from __future__ import annotations

import math
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .costs import cumulative_costs
from .edges import edge_otsu
from .focal import box_stats, modified_median_zscore
from .threshold import bmax_otsu, threshold_extent
from .tiles import TILE, Tile, box_sum, distance2, gradients, tiled, weighted_mean, window_extreme

YX = ["y", "x"]


def discrete_difference(observed: Column, reference: Column) -> Column:
    """1 where water is observed but not in the reference; masked like the observation."""
    flood = (F.coalesce(observed, F.lit(0)) + 2 * F.coalesce(reference, F.lit(0)) == 1).cast("int")
    return F.when(observed.isNotNull(), flood)


def extract_flood(px: DataFrame, water: str, occurrence: DataFrame, threshold: float = 75, out: str = "flood") -> DataFrame:
    """Water that is not permanent (occurrence above ``threshold``)."""
    permanent = occurrence.select(*YX, (F.col("occurrence") > threshold).cast("int").alias("__perm"))
    return px.join(permanent, YX, "left").withColumn(out, discrete_difference(F.col(water), F.col("__perm"))).drop("__perm")


def flood_duration(px: DataFrame, water: str) -> DataFrame:
    """(y, x, days) from the first to the last day with water; pixels without water are left out."""
    day = F.when(F.col(water) == 1, F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")))
    return px.groupBy(*YX).agg((F.max(day) - F.min(day)).alias("days")).where("days IS NOT NULL")


def log_amplitude_ratio(observed: Column, reference: Column, in_units: str = "db") -> Column:
    """log10 of the amplitude ratio of two bands in decibels or ``power``."""
    if in_units not in ("db", "power"):
        raise NotImplementedError(f"units {in_units}")
    if in_units == "power":
        return F.log10(F.try_divide(F.sqrt(observed), F.sqrt(reference)))
    return _decibel_log_ratio(observed.cast("double"), reference.cast("double"))


@F.pandas_udf(DoubleType())
def _decibel_log_ratio(observed: pd.Series, reference: pd.Series) -> pd.Series:
    """By the C library's pow and log10, which the SQL has too: ratios often lie on a threshold or a bucket's edge, where
    the last bit that those of the JVM or of numpy give otherwise decides."""

    def power(v: float) -> float:
        try:
            return math.pow(10.0, v / 10)
        except OverflowError:
            return math.inf

    def ratio(a: float, b: float) -> float | None:
        if a != a or b != b:
            return None
        a, b = math.sqrt(power(a)), math.sqrt(power(b))
        share = a / b if b else 0.0
        return math.log10(share) if share > 0 else None

    return pd.Series([ratio(a, b) for a, b in zip(observed.tolist(), reference.tolist())], dtype="float64")


def amplitude_change(
    px: DataFrame, observed: str, reference: str, in_units: str = "db", segmentation: str | None = "edgeotsu", invert: bool = False, out: str = "water", **kwargs
) -> DataFrame:
    """Change by the log amplitude ratio ``lar``: 1 below its scene's threshold (inverted: above), found by ``edgeotsu`` or ``bmaxotsu``.

    Without a segmentation only the ratio is added. ``kwargs`` go to the threshold's function; ``initial`` is 0 by default.
    """
    if segmentation not in ("edgeotsu", "bmaxotsu", None):
        raise NotImplementedError(f"segmentation {segmentation}")
    d = px.withColumn("lar", log_amplitude_ratio(F.col(observed), F.col(reference), in_units))
    if segmentation is None:
        return d
    cuts = (edge_otsu if segmentation == "edgeotsu" else bmax_otsu)(d, "lar", **{"initial": 0.0, "width": 0.01, **kwargs})
    return threshold_extent(d, "lar", cuts, invert, out)


#: The cost of a metre of water and how far from dry land costs are followed, in metres.
WATER_COST, REACH = 10_000.0, 5_000.0


def water_depth(
    px: DataFrame,
    water: str,
    dem: DataFrame,
    smooth: int = 3,
    outlier_test: bool = False,
    cell: float = 30.0,
    reach: float = REACH,
    out: str = "depth",
    tile: int = TILE,
) -> DataFrame:
    """Depth of water pixels: the level of the dry pixel that the cheapest path over water starts from, minus their own elevation.

    Three path costs from all dry pixels (not water, or masked) are followed over the grid, with a dry
    pixel's own cost 0, 1 and its elevation; the third's part over the first, divided by the second's, is the level. Depths
    are smoothed by a box mean that dry pixels enter with 0, and are not negative. Water that no path
    reaches within ``reach`` metres has NULL. ``outlier_test`` repairs the elevation first: outliers of the
    water's elevation, one metre up, become the median of their neighbours in a surface without outliers.
    """
    d = px.join(dem.select(*YX, F.col("elevation").alias("__z")), YX)
    wet = F.coalesce(F.col(water) == 1, F.lit(False))
    if outlier_test:
        d = modified_median_zscore(d, "__z", "__even").withColumn("__raised", F.when(wet, F.col("__z") + 1))
        d = modified_median_zscore(d, "__raised", "__z", fill="__even").drop("__even", "__raised")
    dry = ~wet & F.col("__z").isNotNull()
    own = {"__c0": F.lit(0.0), "__c1": F.lit(1.0), "__c2": F.col("__z")}
    costs = d.select("scene_id", *YX, dry.alias("__dry"), *[F.when(dry, v).when(wet, WATER_COST).alias(c) for c, v in own.items()])
    paths = cumulative_costs(costs, list(own), "__dry", tile)
    d = d.join(paths, ["scene_id", *YX], "left")
    level = F.try_divide(F.col("__c2") - F.col("__c0"), F.col("__c1") - F.col("__c0"))
    level = F.when(F.col("__c0") / WATER_COST * cell <= reach, level)
    raw = F.when(dry, F.lit(0.0)).otherwise(level - F.col("__z"))
    d = box_stats(d.withColumn("__raw", raw), "__raw", smooth, "__").where(wet)
    depth = F.when(F.col("__raw").isNotNull(), F.greatest(F.col("__mean"), F.lit(0.0)))
    return d.withColumn(out, depth).drop("__raw", "__mean", "__var", "__count", "__z", *own)


def downscale_fraction(px: DataFrame, fraction: str, dem: DataFrame, cell: int, out: str = "water") -> DataFrame:
    """Fine water from a coarse fraction: the lowest part of the range of elevations around a pixel is wet.

    The range is that of the pixels with a fraction above 0 within ``cell`` rows and columns; where there
    is none, NULL.
    """

    def wet(tile: Tile) -> dict[str, np.ndarray]:
        z, f = tile["elevation"], tile[fraction]
        some = np.where(f > 0, z, np.nan)
        low, high = window_extreme(some, cell), window_extreme(some, cell, np.fmax)
        level = low + (high - low) * f
        return {out: np.where(np.isnan(level) | np.isnan(z), np.nan, (z >= low) & (z < level))}

    d = px.join(dem.select(*YX, "elevation"), YX)
    return tiled(d, [fraction, "elevation"], cell, wet, f"{out} int").drop("elevation")


def slope_and_aspect(gx: np.ndarray, gy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Degrees of slope, and of the direction downhill clockwise from north; rows grow southwards."""
    return np.degrees(np.arctan(np.hypot(gx, gy))), (450.0 - np.degrees(np.arctan2(gy, -gx))) % 360.0


def terrain(dem: DataFrame, cell: float = 30.0, tile: int = TILE) -> DataFrame:
    """Adds ``slope`` and ``aspect`` in degrees (Horn's gradients; a missing neighbour takes the centre's value)."""

    def relief(part: Tile) -> dict[str, np.ndarray]:
        slope, aspect = slope_and_aspect(*gradients(part["elevation"], cell))
        return {"slope": slope, "aspect": aspect}

    got = tiled(dem.withColumn("scene_id", F.lit(0)), ["elevation"], 1, relief, "slope double, aspect double", tile)
    return got.select(*dem.columns, "slope", "aspect")


def headings(px: DataFrame, angle: str = "angle", cell: float = 30.0, tile: int = TILE) -> DataFrame:
    """(scene_id, heading): a scene's look direction, the mean aspect of its incidence angles."""

    def turned(part: Tile) -> dict[str, np.ndarray]:
        return {"__aspect": slope_and_aspect(*gradients(part[angle], cell))[1]}

    return tiled(px.select("scene_id", *YX, angle), [angle], 1, turned, "__aspect double", tile).groupBy("scene_id").agg(F.avg("__aspect").alias("heading"))


def slope_correction(
    px: DataFrame,
    bands: list[str],
    relief: DataFrame,
    heading: float | None = None,
    model: str = "volume",
    buffer: float = 0.0,
    in_units: str = "db",
    out_units: str = "same",
    cell: float = 30.0,
    tile: int = TILE,
) -> DataFrame:
    """Radiometric terrain correction; pixels in layover or shadow, or within ``buffer`` metres of one, are masked.

    ``relief`` has slope and aspect by pixel; ``heading`` is the look direction in degrees, by default each
    scene's own (``headings``). Adds ``local_inc_angle`` in degrees. Bands are in decibels or ``power`` and stay so,
    unless ``out_units`` is other: then decibels come out as power and power as decibels. A buffer reaches 10 pixels
    at most and does not grow from beyond the scene.
    """
    if model not in ("volume", "surface"):
        raise NotImplementedError(f"model {model}")
    if in_units not in ("db", "power"):
        raise ValueError("in_units must be db or power")
    if out_units not in ("same", "other", None):
        raise ValueError("out_units must be same or other")
    rad = pi / 180
    d = px.join(relief.select(*YX, "slope", "aspect"), YX)
    if heading is None:
        d = d.join(headings(px, cell=cell, tile=tile).withColumnRenamed("heading", "__heading"), "scene_id")
    else:
        d = d.withColumn("__heading", F.lit(float(heading)))
    phi = (F.col("__heading") - F.col("aspect")) * rad
    alpha_r = F.atan(F.tan(F.col("slope") * rad) * F.cos(phi))
    alpha_az = F.atan(F.tan(F.col("slope") * rad) * F.sin(phi))
    theta = F.col("angle") * rad
    if model == "volume":
        factor = F.tan(pi / 2 - theta + alpha_r) / F.tan(pi / 2 - theta)
    else:
        factor = F.cos(pi / 2 - theta) / (F.cos(alpha_az) * F.cos(pi / 2 - theta + alpha_r))
    seen = (alpha_r < theta) & (alpha_r > -(pi / 2 - theta))
    incidence = F.degrees(F.acos(F.cos(alpha_az) * F.cos(theta - alpha_r)))
    d = d.withColumns({"__seen": F.coalesce(seen, F.lit(False)).cast("int"), "__factor": factor, "local_inc_angle": incidence})
    if buffer > 0:

        def away(part: Tile) -> dict[str, np.ndarray]:
            far = np.sqrt(distance2(part["__seen"] == 0, 10)) * cell
            return {"__seen": (far > buffer) & (part["__seen"] == 1)}

        d = tiled(d, ["__seen"], 10, away, "__seen int", tile)
    out = {}
    decibels = (in_units == "db") == (out_units == "same")
    for b in bands:
        power = F.pow(F.lit(10.0), F.col(b) / 10) if in_units == "db" else F.col(b)
        flat = power / F.cos(F.col("angle") * rad) / F.col("__factor")
        out[b] = F.when(F.col("__seen") == 1, 10 * F.when(flat > 0, F.log10(flat)) if decibels else flat)
    return d.withColumns(out).drop("slope", "aspect", "__heading", "__seen", "__factor")


def illumination_correction(
    px: DataFrame, bands: list[str], relief: DataFrame, azimuth: float | str, zenith: float | str, model: str = "rotation"
) -> DataFrame:
    """Topographic correction of optical bands: cosine, c, scsc or rotation.

    The sun's azimuth and zenith, in degrees, are numbers or columns that hold those of each scene. The fits
    of bands on the light that a slope gets are one for each scene.
    """
    if model not in ("cosine", "c", "scsc", "rotation"):
        raise NotImplementedError(f"model {model}")
    rad = pi / 180
    d = px.join(relief.select(*YX, "slope", "aspect"), YX)
    sun = [F.col(a) if isinstance(a, str) else F.lit(float(a)) for a in (azimuth, zenith)]
    d = d.withColumns({"__az": sun[0].cast("double"), "__cz": F.cos(sun[1] * rad), "__sz": F.sin(sun[1] * rad)})
    cos_p, sin_p, cos_z = F.cos(F.col("slope") * rad), F.sin(F.col("slope") * rad), F.col("__cz")
    d = d.withColumn("__ci", cos_p * cos_z + sin_p * F.col("__sz") * F.cos((F.col("aspect") - F.col("__az")) * rad))
    fits = [f(b, "__ci").alias(f"__{n}_{b}") for b in bands for n, f in (("a", F.regr_slope), ("i", F.regr_intercept))]
    ci, fitted = F.col("__ci"), d.groupBy("scene_id").agg(*fits)
    d = d.join(fitted, "scene_id", "left")
    out = {}
    for b in bands:
        a, intercept = F.col(f"__a_{b}"), F.col(f"__i_{b}")
        c = F.try_divide(intercept, a)
        out[b] = {
            "cosine": F.col(b) * F.try_divide(cos_z, ci),
            "c": F.col(b) * F.try_divide(cos_z + c, ci + c),
            "scsc": F.col(b) * F.try_divide(cos_p * cos_z + c, ci + c),
            "rotation": F.col(b) - a * (ci - cos_z),
        }[model]
    return d.withColumns(out).drop("slope", "aspect", "__az", "__cz", "__sz", "__ci", *fitted.columns[1:])


def bathtub(px: DataFrame, fraction: str, hand: DataFrame, cell: int, depths: int = 20, permanent: DataFrame | None = None) -> DataFrame:
    """(scene_id, y, x, depth, water, error, away): the fill height whose water share is nearest each coarse cell's fraction.

    ``permanent`` (y, x, permanent) is water at any height. Of equal differences the greater depth counts, which is the
    union of their water maps. ``away`` is the cell's least difference; ``error`` is that only where all heights
    have it, else 0. The shares of all heights are one aggregate a cell.
    """
    d = px.join(hand.select(*YX, "hand"), YX).withColumns({"cy": F.floor(F.col("y") / cell), "cx": F.floor(F.col("x") / cell)})
    always = F.lit(False)
    if permanent is not None:
        d = d.join(permanent.select(*YX, F.col("permanent").alias("__p")), YX, "left")
        always = F.coalesce(F.col("__p") == 1, F.lit(False))
    wet = lambda depth: (F.col("hand") <= depth) | always
    shares = [F.abs(F.avg(fraction) - F.avg(wet(F.lit(k)).cast("double"))).alias(f"__{k}") for k in range(depths + 1)]
    tried = d.groupBy("scene_id", "cy", "cx").agg(*shares)
    ranked = F.array(*[F.struct(F.round(f"__{k}", 9).alias("away"), F.lit(-k).alias("deep")) for k in range(depths + 1)])
    same = F.array_max(ranked)["away"] == F.array_min(ranked)["away"]
    best = tried.select(
        "scene_id", "cy", "cx", (-F.array_min(ranked)["deep"]).alias("depth"), F.array_min(ranked)["away"].alias("away"), same.alias("__same")
    )
    got = d.join(best, ["scene_id", "cy", "cx"])
    error = F.when(F.col("__same"), F.col("away")).otherwise(F.col("away") * 0)
    return got.select("scene_id", *YX, "depth", wet(F.col("depth")).cast("int").alias("water"), error.alias("error"), "away")


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, and 0 where b is 0."""
    return np.where(b == 0, 0.0, a / np.where(b == 0, 1.0, b))


def dnns(px: DataFrame, r: int = 40, out: str = "fraction", tile: int = TILE) -> DataFrame:
    """Water fraction of mixed pixels by a dynamic search for their nearest neighbours.

    Water is an index above 0.15, land below -0.15; what lies between is mixed. Pure water is the mean of
    the water within ``r`` rows and columns. Pure land is the mean of those neighbours whose ratios of red
    and of near to short-wave infrared lie, both, below the pixel's own and above it less pure water's
    red over the pixel's short-wave infrared; ratios that differ from the latter by rounding only are equal to it,
    so that the order of sums decides no tie. Where there is none, the scene's sums of water or land over the
    number of all its pixels stand in. The fraction is the mean over the three bands of (land - pixel) /
    (land - water), within 0 and 1; a division by 0 gives 0.
    """
    bands = ["red", "nir", "swir1"]
    index = F.try_divide(F.col("green") - F.col("swir1"), F.col("green") + F.col("swir1"))
    d = px.withColumn("__i", index)
    kinds = {"w": F.col("__i") > 0.15, "l": F.col("__i") < -0.15}
    means = {f"__{k}_{b}": F.avg(kind.cast("double") * F.col(b)) for k, kind in kinds.items() for b in bands}
    extent = {c: (f"__{c}0", f"__{c}1") for c in "yx"}
    ends = [f(c).alias(n) for c, names in extent.items() for f, n in zip((F.min, F.max), names)]
    d = d.join(d.groupBy("scene_id").agg(*[m.alias(n) for n, m in means.items()], *ends), "scene_id", "left")

    def fractions(tile: Tile) -> dict[str, np.ndarray]:
        i, v = tile["__i"], {b: tile[b] for b in bands}
        known = ~np.isnan(i)
        water, land = i > 0.15, i < -0.15
        n_water = box_sum(water.astype(float), r)
        pure = {}
        for b in bands:
            mean = _over(box_sum(np.where(water, np.nan_to_num(v[b]), 0.0), r), n_water)
            pure[b] = np.where(mean == 0, tile[f"__w_{b}"], mean)
        whole = known & ~np.isnan(v["red"] + v["nir"] + v["swir1"])
        mixed = np.flatnonzero(whole & ~water & ~land & tile.own)
        ratios = [_over(v["red"], v["swir1"]), _over(v["nir"], v["swir1"])]
        reach = _over(pure["red"], v["swir1"])
        wide = [np.pad(a, r, constant_values=np.nan) for a in (*ratios, *v.values())]
        y, x = np.divmod(mixed, i.shape[1])
        row = wide[0].shape[1]
        centre = (y + r) * row + x + r
        flat = [a.ravel() for a in wide]
        tops = [a.ravel()[mixed] for a in ratios]
        reach = reach.ravel()[mixed]
        lows = [t - reach + 1e-12 * (np.abs(t) + np.abs(reach)) for t in tops]
        n, sums = np.zeros(len(mixed)), np.zeros((3, len(mixed)))
        down, right = (min(r, size - 1) for size in i.shape)  # nothing lies further off within the rectangle
        for dy in range(-down, down + 1):
            for dx in range(-right, right + 1):
                at = centre + dy * row + dx
                first, second = flat[0][at], flat[1][at]
                like = (first > lows[0]) & (first < tops[0]) & (second > lows[1]) & (second < tops[1])
                if like.any():
                    n += like
                    for k in range(3):
                        sums[k] += np.where(like, flat[2 + k][at], 0.0)
        total = np.zeros(len(mixed))
        for k, b in enumerate(bands):
            ground = np.where(n >= 1, sums[k] / np.maximum(n, 1), tile[f"__l_{b}"].ravel()[mixed])
            total += np.clip(_over(ground - v[b].ravel()[mixed], ground - pure[b].ravel()[mixed]), 0, 1)
        result = np.where(whole, np.where(water, 1.0, 0.0), np.nan)
        result.ravel()[mixed] = total / 3
        return {out: result}

    got = tiled(d, ["__i", *bands, *means], r, fractions, f"{out} double", tile, extent)
    return got.drop("__i", *means, *extent["y"], *extent["x"])


def latest_before(px: DataFrame, band: str, target: str, months: int = 2) -> DataFrame:
    """(y, x, band): the latest valid value in the ``months`` before the target date (an as-of lookup)."""
    end = F.lit(target).cast("timestamp_ntz")
    seen = px.where((F.col("ts") < end) & (F.col("ts") >= end - F.expr(f"INTERVAL {months} MONTH")) & F.col(band).isNotNull())
    return seen.groupBy(*YX).agg(F.max_by(band, F.struct("ts", "scene_id")).alias(band))


def permanent_yearly(history: DataFrame, before: int, years: int = 5, water_class: int = 3) -> DataFrame:
    """(y, x, permanent): whether a pixel was of ``water_class`` in one of the latest ``years`` before a year."""
    latest = history.where(F.col("year") < before).select("year").distinct().orderBy(F.desc("year")).limit(years)
    seen = history.join(F.broadcast(latest), "year", "left_semi")  # at most ``years`` rows
    return seen.groupBy(*YX).agg(F.coalesce(F.max((F.col("water_class") == water_class).cast("int")), F.lit(0)).alias("permanent"))


def extract_flood_yearly(px: DataFrame, water: str, history: DataFrame, before: int, out: str = "flood") -> DataFrame:
    """Water that was not permanent in the latest five years before."""
    return px.join(permanent_yearly(history, before), YX, "left").withColumn(out, discrete_difference(F.col(water), F.col("permanent"))).drop("permanent")


def extract_flood_seasonal(px: DataFrame, water: str, recurrence: DataFrame, threshold: float = 75, out: str = "flood") -> DataFrame:
    """Water that does not recur in the month of observation; ``recurrence`` has (month, y, x, recurrence)."""
    permanent = recurrence.select("month", *YX, (F.col("recurrence") > threshold).cast("int").alias("__perm"))
    joined = px.withColumn("month", F.month("ts")).join(permanent, ["month", *YX], "left")
    return joined.withColumn(out, discrete_difference(F.col(water), F.col("__perm"))).drop("month", "__perm")


def fill_depth(px: DataFrame, water: str, dem: DataFrame, steps: int = 10, boundary: str = "mean", smooth: bool = True, out: str = "depth") -> DataFrame:
    """Depth under a water level that is filled in from the water's edge, one pixel a step.

    The level of an edge pixel (water beside dry or masked pixels) is the mean elevation of the edge and
    dry pixels around it. Water further than ``steps`` from an edge has no depth. Lineage is cut every few steps.
    """
    if boundary not in ("mean", "nearest"):
        raise ValueError("boundary must be mean or nearest")
    from .fusion import mean_fill_step, nearest_fill_step
    from .lineage import cut_lineage

    d = px.join(dem.select(*YX, "elevation"), YX).withColumn("__in", F.coalesce((F.col(water) == 1).cast("int"), F.lit(0)))
    d = box_stats(d, "__in", 1, "__w_")
    edge = (F.col("__in") == 1) & (F.col("__w_mean") < 1 - 1e-9)
    d = d.withColumn("__edge", edge).drop("__w_mean", "__w_var", "__w_count")
    d = d.withColumn("__ground", F.when((F.col("__in") == 0) | F.col("__edge"), F.col("elevation")))
    d = box_stats(d, "__ground", 1, "__g_").withColumn("__level", F.when(F.col("__edge"), F.col("__g_mean")))
    d = d.drop("__g_mean", "__g_var", "__g_count", "__ground", "__edge")
    step = mean_fill_step if boundary == "mean" else nearest_fill_step
    for i in range(steps):
        d = step(d, "__level", "__in", "__level")
        if i % 4 == 3:
            d = cut_lineage(d)
    d = d.withColumn("__d", F.when(F.col("__level").isNotNull(), F.greatest(F.col("__level") - F.col("elevation"), F.lit(0.0))))
    if smooth:
        d = box_stats(d, "__d", 1, "__s_").withColumn("__d", F.when(F.col("__in") == 1, F.col("__s_mean"))).drop("__s_mean", "__s_var", "__s_count")
    return d.withColumn(out, F.col("__d")).drop("__d", "__in", "__level", "elevation")


def starfm(coarse: DataFrame, fine: DataFrame, band: str, target: str, r: int = 16, a: float = 0.5, days: int = 5, out: str = "predicted", tile: int = TILE) -> DataFrame:
    """Fine pixels predicted for the coarse scenes within ``days`` of the target, by weighted fusion.

    The base images are the latest valid values of the two months before the target. Spectral and
    temporal distances are averaged by nearness; a zero distance in time gives no weight, so NULL.
    """
    end = F.lit(target).cast("timestamp_ntz")
    away = np.arange(-r, r + 1)
    kernel = 1 + np.hypot(away[:, None], away[None, :]) / a
    seen = fine.where((F.col("ts") < end) & (F.col("ts") >= end - F.expr("INTERVAL 2 MONTH")) & F.col(band).isNotNull())
    base = seen.groupBy(*YX).agg(F.max_by(band, F.struct("ts", "scene_id")).alias("__base"), F.max("ts").alias("__t0"))
    old = latest_before(coarse, band, target).withColumnRenamed(band, "__old")
    span = F.expr(f"INTERVAL {days} DAY")
    d = coarse.where((F.col("ts") >= end - span) & (F.col("ts") < end + span)).select("scene_id", *YX, "ts", band)
    d = d.join(base, YX).join(old, YX).withColumn("__away", F.abs(F.col(band) - F.col("__old")))
    since = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("__t0").cast("timestamp"))) / 86_400_000_000.0

    def predicted(tile: Tile) -> dict[str, np.ndarray]:
        def mean(a: np.ndarray) -> np.ndarray:
            return np.where(tile.present, weighted_mean(a, kernel), np.nan)

        def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return a / np.where(b == 0, np.nan, b)

        s = mean(tile["__away"])
        close = over(np.ones_like(s), mean(s * tile["__since"]))
        return {out: over(tile["__base"], mean(over(close, mean(close)))) + s}

    # Four windows in a row: the halo holds all of them, so the scenes are shuffled once.
    got = tiled(d.withColumn("__since", since), ["__away", "__since", "__base"], 4 * r, predicted, f"{out} double", max(tile, 8 * r))
    return got.select("scene_id", *YX, "ts", out)
