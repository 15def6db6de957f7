"""Whole maps from several operators: fused series, samples, harmonics, daily water with confidence, radar water."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions.pixel import INDICES, add_indices
from .components import sizes
from .edges import edge_otsu
from .focal import close_binary, gamma_map, open_binary
from .floods import slope_correction
from .lineage import cut_lineage
from .ranks import quantile
from .threshold import histogram, otsu
from .timeseries import add_harmonics, harmonic_trend, linear_trend, years, yearly_anomalies

YX = ["y", "x"]
SAR_FEATURES = ["vv", "vh", "vv_vh_ratio", "ndpi", "nvvi", "nvhi"]


def radar_features(sar: DataFrame, relief: DataFrame) -> DataFrame:
    """Terrain-corrected radar bands, their indices, and the difference of each from its year's statistics."""
    flat = slope_correction(sar, ["vv", "vh"], relief)
    return yearly_anomalies(add_indices(flat, SAR_FEATURES[2:]), YX, SAR_FEATURES)


def fuse(optical: DataFrame, sar: DataFrame, predict: Callable[[DataFrame], DataFrame], target: str = "mndwi") -> DataFrame:
    """(sensor, scene_id, y, x, ts, target): the optical index, and what ``predict`` adds as ``target`` to radar pixels."""
    keys = ["scene_id", *YX, "ts"]
    seen = optical.select(F.lit("optical").alias("sensor"), *keys, INDICES[target]().alias(target))
    made = predict(sar).select(F.lit("radar").alias("sensor"), *keys, target)
    return seen.unionByName(made).where(F.col(target).isNotNull())


def water_strata(occurrence: Column, interval: int = 20, top: int = 80) -> Column:
    """1 for an occurrence from 0, one more for each further ``interval`` up to ``top``; NULL where masked."""
    return F.when(occurrence >= 0, F.least(F.floor(occurrence / interval), F.lit(top // interval)) + 1).cast("int")


#: The class of each of the 17 land-cover types.
LAND_CLASSES = (1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 6, 3, 5, 3, 4, 4, 6)


def strata(occurrence: Column, cover: Column, interval: int = 20, top: int = 80) -> Column:
    """The water stratum, and where there is none the land cover's class, numbered on from the water strata."""
    water_classes = top // interval + 1
    classes = F.get(F.array(*map(F.lit, LAND_CLASSES)), cover.cast("int") - 1)
    return F.coalesce(water_strata(occurrence, interval, top), (classes + water_classes).cast("int"))


def stratified_sample(px: DataFrame, stratum: str, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """At most ``n`` rows of each stratum, those of least hash of ``keys``."""
    seen = px.where(F.col(stratum).isNotNull()).withColumn("__h", F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40)))
    # Of each stratum only the rows of least hash are ranked: about 2 n + 100 of them, so that n are there.
    bound = (2 * n + 100) / F.count("*") * (1 << 40)
    sizes = seen.groupBy(stratum).agg(bound.alias("__most"))
    few = seen.join(sizes, stratum).where(F.col("__h") <= F.col("__most"))
    ranked = few.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy("__h", *keys)))
    return ranked.where(F.col("__r") <= n).select(*px.columns)


def fusion_samples(joined: DataFrame, occurrence: DataFrame, n: int, seed: int = 0, cover: DataFrame | None = None) -> DataFrame:
    """``n`` pixels of each water stratum from joined optical and radar pixels, with ``stratum``.

    With ``cover`` (y, x, cover: land-cover types from 1) also of each land class where there is no water stratum.
    """
    if cover is None:
        named = occurrence.select(*YX, water_strata(F.col("occurrence")).alias("stratum"))
    else:
        both = occurrence.select(*YX, "occurrence").join(cover.select(*YX, "cover"), YX, "full")
        named = both.select(*YX, strata(F.col("occurrence"), F.col("cover")).alias("stratum"))
    return stratified_sample(joined.join(named, YX), "stratum", n, ["scene_id", *YX], seed)


def water_harmonics(fused: DataFrame, target: str = "mndwi", n_cycles: int = 2, scale: float = 0.0001) -> DataFrame:
    """(y, x, coefficients, n, mean_x, residual_x, residual_y): harmonic fit of a fused series, as integers of ``scale``."""
    d = add_harmonics(fused.withColumns({"constant": F.lit(1.0), "time": years("ts")}), n_cycles)
    got = harmonic_trend(d, YX, target, n_cycles, output_err=True)
    return got.withColumns({c: (F.nullif(F.col(c), F.lit(float("nan"))) / scale).cast("int") for c in got.columns if c not in (*YX, "n")})


def harmonic_value(time: Column, n_cycles: int, prefix: str = "") -> Column:
    from math import pi

    value = F.col(f"{prefix}constant") + F.col(f"{prefix}time") * time
    for k in range(1, n_cycles + 1):
        value = value + F.col(f"{prefix}cos_{k}") * F.cos(2 * pi * k * time) + F.col(f"{prefix}sin_{k}") * F.sin(2 * pi * k * time)
    return value


def fusion_product(fused: DataFrame, target: str, coefficients: DataFrame, day: str, look_back: int = 30, lag: int = 4, n_cycles: int = 2) -> DataFrame:
    """(y, x, fused_product, n, mean_x, residual_x, residual_y) of one day.

    The harmonic prediction minus the linear trend of its residuals: predictions minus daily medians of
    the ``look_back`` days that end ``lag - 1`` days before. Pixels with no trend are left out. If
    ``coefficients`` has errors (n, mean_x, residual_x, residual_y), these come along as long_n and so on.
    """
    end = F.date_sub(F.to_date(F.lit(day)), lag - 1)
    when = F.to_date("ts")
    daily = (
        fused.where((when >= F.date_sub(end, look_back)) & (when < end))
        .groupBy(*YX, when.alias("ts"))
        .agg(F.percentile(target, F.lit(0.5)).alias("__seen"))
        .withColumnRenamed("ts", "__day")
    )
    names = ["constant", "time"] + [f"{f}_{k}" for k in range(1, n_cycles + 1) for f in ("cos", "sin")]
    errors = [c for c in ("n", "mean_x", "residual_x", "residual_y") if c in coefficients.columns]
    harmonic = coefficients.select(*YX, *[F.col(c).alias(f"__{c}") for c in names], *[F.col(c).alias(f"long_{c}") for c in errors])
    d = daily.join(harmonic, YX).withColumn("time", years("__day"))
    d = d.withColumn("residual", harmonic_value(F.col("time"), n_cycles, "__") - F.col("__seen"))
    trend = linear_trend(d, YX, "residual")
    now = years(F.to_date(F.lit(day)))
    value = harmonic_value(now, n_cycles, "__") - (F.col("constant") + F.col("time") * now)
    got = trend.join(harmonic, YX).withColumn("fused_product", value).where(F.col("fused_product").isNotNull())
    return got.select(*YX, "fused_product", "n", "mean_x", "residual_x", "residual_y", *[f"long_{c}" for c in errors])


def interval(error: Column, n: Column, time: Column, mean: Column, spread: Column) -> Column:
    """Half width of a regression's prediction error at ``time``."""
    away = time - mean
    return error * F.sqrt(1 + F.try_divide(F.lit(1.0), n) + F.try_divide(away * away, spread))


def confidence(value: Column, widths: list[Column], threshold: Column, draws: int = 100) -> Column:
    """Percent of ``draws`` in which ``value`` with an error within 1.96 of each width is over the threshold.

    The draws are fixed low-discrepancy sequences, one for each width, shifted by the pixel's place, so they repeat.
    """
    shift = (F.col("y") * 73 + F.col("x") * 37) % 101 / 101.0
    steps = (0.6180339887498949, 0.41421356237309515)

    def over(done: Column, i: Column) -> Column:
        drawn = value
        for width, step in zip(widths, steps):
            drawn = drawn + width * 1.96 * (2 * ((i * step + shift) % 1.0) - 1)
        return done + (drawn > threshold).cast("int")

    hits = F.aggregate(F.sequence(F.lit(1), F.lit(draws)), F.lit(0), over)
    return F.floor(hits * 100 / F.lit(draws)).cast("int")


def daily_surface_water(
    product: DataFrame, permanent: DataFrame, threshold: float | None, day: str, draws: int = 100, initial: float = 0.0, no_data: float = 0.0, length: int = 50
) -> DataFrame:
    """(y, x, water, flood, confidence) from a fusion product: over the threshold, or permanent water.

    Without a ``threshold`` it is Otsu's around the map's long edges at ``initial``, ``no_data`` if there are none.
    The confidence counts draws of the errors of the short trend and, if the product has them, of the harmonics.
    ``permanent`` has (y, x, permanent); a pixel that it lacks is not permanent.
    """
    d = product.join(permanent.select(*YX, F.col("permanent").alias("__p")), YX, "left").withColumn("__p", F.coalesce("__p", F.lit(0)))
    if threshold is None:
        one = d.withColumn("scene_id", F.lit(0))
        cut = edge_otsu(one, "fused_product", initial, no_data, length=length, buffer=10, width=0.05).select("scene_id", F.col("threshold").alias("__t"))
        d = one.join(F.broadcast(cut.limit(1)), "scene_id").drop("scene_id")
    else:
        d = d.withColumn("__t", F.lit(float(threshold)))
    wet = ((F.col("fused_product") > F.col("__t")) | (F.col("__p") == 1)).cast("int")
    now = years(F.to_date(F.lit(day)))
    kinds = [""] + ["long_"] * ("long_residual_y" in product.columns)
    widths = [F.coalesce(interval(*[F.col(k + c) for c in ("residual_y", "n")], now, *[F.col(k + c) for c in ("mean_x", "residual_x")]), F.lit(0.0)) for k in kinds]
    sure = confidence(F.col("fused_product"), widths, F.col("__t"), draws)
    return d.select(*YX, wet.alias("water"), F.when(wet == 1, 1 - F.col("__p")).otherwise(0).alias("flood"), sure.alias("confidence"))


def best_tiles(px: DataFrame, band: str, grid: int, n: int = 5, least_hand: float = 0.8) -> DataFrame:
    """(scene_id, ty, tx): the ``n`` tiles with the greatest ratio of the scene's median to their deviation."""
    tiles = px.groupBy("scene_id", F.floor(F.col("y") / grid).alias("ty"), F.floor(F.col("x") / grid).alias("tx")).agg(
        F.stddev_pop(band).alias("__s"), F.avg("hand").alias("__h")
    )
    median = quantile(px, ["scene_id"], band, 0.5, "__m")
    spread = F.when(F.col("__s") > 0, F.col("__s")).otherwise(0.00001)
    rated = tiles.where(F.col("__h") >= least_hand).join(median, "scene_id").withColumn("__ratio", F.col("__m") / spread)
    order = Window.partitionBy("scene_id").orderBy(F.desc("__ratio"), "ty", "tx")
    return rated.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).select("scene_id", "ty", "tx")


def radar_water(sar: DataFrame, relief: DataFrame, hand: DataFrame, sand: DataFrame, grid: int = 5, width: float = 0.25, r: int = 2) -> DataFrame:
    """(scene_id, y, x, water) of radar scenes: correction, speckle filter, tile thresholds and fuzzy evidence.

    A pixel is water if VV or VH is below the mean Otsu threshold of its scene's best tiles and the mean
    of five memberships (slope, height above drainage, decibels, patch size, sand) is over 0.6; then the
    map is opened and closed. ``sand`` has (y, x, sand); a missing value counts as 0.
    """
    px = slope_correction(sar, ["vv", "vh"], relief)
    for band in ("vv", "vh"):
        px = cut_lineage(gamma_map(px, band, band))
    px = px.select("scene_id", *YX, "vv", "vh").join(hand.select(*YX, "hand"), YX).join(relief.select(*YX, "slope"), YX)
    px = px.join(sand.select(*YX, "sand"), YX, "left").withColumns({"ty": F.floor(F.col("y") / grid), "tx": F.floor(F.col("x") / grid)})
    px = cut_lineage(px)
    top = quantile(px, ["scene_id"], "hand", 0.9, "__p90")
    low = px.join(top, "scene_id").where((F.col("hand") != 0) & (F.col("hand") < F.col("__p90")))
    limits = quantile(low, ["scene_id"], "hand", 0.5, "__lo").join(low.groupBy("scene_id").agg(F.stddev_pop("hand").alias("__sd")), "scene_id")
    px = px.join(limits, "scene_id", "left")
    mid = F.col("__lo") + (3 * F.col("__sd") + 5) / 2
    a, b, h = F.col("__lo"), F.col("__lo") + 3 * F.col("__sd") + 5, F.col("hand")
    below = 1 - 2 * ((h - a) / (b - a)) * ((h - a) / (b - a))
    above = 2 * ((h - b) / (b - a)) * ((h - b) / (b - a))
    by_hand = F.coalesce(F.when(h < a, 1.0).when(h >= b, 0.0).when(h < mid, below).otherwise(above), F.lit(1.0))
    evidence = [fuzzy.zmf(F.col("slope"), 0.0, 15.0), by_hand, fuzzy.small(F.coalesce("sand", F.lit(0.0)), 37.5, 8)]
    px = cut_lineage(px.withColumn("__land", evidence[0] + evidence[1] + evidence[2]).drop("__lo", "__sd"))
    # Both thresholds and both bands' patches are taken from written pixels, before any are joined.
    by = ["scene_id", "ty", "tx"]
    flagged = px
    for band in ("vv", "vh"):
        chosen = px.where(F.col(band) < 0).join(best_tiles(px, band, grid), by, "left_semi")
        cut = otsu(histogram(chosen, band, width, by), by).groupBy("scene_id").agg(F.avg("threshold").alias(f"__t{band}"))
        flagged = flagged.join(cut, "scene_id", "left").withColumn(f"__w{band}", (F.col(band) < F.col(f"__t{band}")).cast("int"))
    flagged = cut_lineage(flagged)
    px = flagged
    for band in ("vv", "vh"):
        px = px.join(sizes(flagged, f"__w{band}", f"__n{band}"), ["scene_id", *YX], "left")
        patch = fuzzy.zmf(F.coalesce(f"__n{band}", F.lit(0)).cast("double"), 10.0, 3.0)
        strength = F.try_divide(F.lit(1.0), 1 + F.pow(F.col(band) / F.col(f"__t{band}"), F.lit(-5.0)))
        wet = (F.col(f"__w{band}") == 1) & ((F.col("__land") + patch + strength) / 5 > 0.6)
        px = px.withColumn(f"__{band}", F.when(F.col(band).isNotNull(), F.coalesce(wet, F.lit(False)).cast("int")))
    both = px.select("scene_id", *YX, F.greatest("__vv", "__vh").alias("__both"))
    return close_binary(open_binary(both, "__both", "__open", r), "__open", "water", r).select("scene_id", *YX, "water")
