"""Moving-window operators over pixel DataFrames.

Windows are computed in tiles with a halo (``tiles``): one shuffle, of each pixel to the tiles it touches. Small
patterns of neighbours go through a literal table of offsets and an equi-group by (scene_id, y, x).
Neighbours that are missing or masked are skipped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantile
from .tiles import Tile, box_sum, distance2, shifts, tiled

KEYS = ["scene_id", "y", "x"]


def box_stats(px: DataFrame, band: str, r: int, prefix: str = "") -> DataFrame:
    """Adds ``mean``, ``var`` (population) and ``count`` of the (2r+1)-square window around each pixel.

    Only pixels that are there and not NULL count, wherever others are absent. A variance that is less
    than the rounding of its sums (1e-12 of the mean square) is 0.
    """

    def stats(tile: Tile) -> dict[str, np.ndarray]:
        v = tile[band]
        known = ~np.isnan(v)
        n = box_sum(known.astype(float), r)
        v = np.where(known, v, 0.0)
        of = np.where(n > 0, n, np.nan)
        mean, square = box_sum(v, r) / of, box_sum(v * v, r) / of
        var = square - mean * mean
        return {f"{prefix}mean": mean, f"{prefix}var": np.where(var <= square * 1e-12, 0.0, var), f"{prefix}count": n}

    got = tiled(px, [band], r, stats, f"{prefix}mean double, {prefix}var double, {prefix}count double")
    return got.withColumn(f"{prefix}count", F.col(f"{prefix}count").cast("long"))


def square(r: int, centre: bool = True) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if centre or dy or dx]


def neighbours(px: DataFrame, columns: list[str], offsets: list[tuple[int, int]]) -> DataFrame:
    """(scene_id, y, x, dy, dx, columns): each pixel's columns as seen from the pixels around it."""
    table = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    seen = px.select(*KEYS, *columns, F.explode(table).alias("o"))
    return seen.select(
        "scene_id", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), "o.dy", "o.dx", *columns
    )


def focal(px: DataFrame, columns: list[str], offsets: list[tuple[int, int]], **aggregates: Column) -> DataFrame:
    """``px`` with aggregates over the offsets around each of its pixels."""
    around = neighbours(px, columns, offsets).groupBy(*KEYS).agg(*[a.alias(n) for n, a in aggregates.items()])
    return px.join(around, KEYS, "left")


def gamma_map(px: DataFrame, band: str, out: str, window: int = 7, enl: float = 4.9) -> DataFrame:
    """Gamma MAP speckle filter of a band in decibels."""
    power = px.withColumn("__p", F.pow(F.lit(10.0), F.col(band) / 10))
    s = box_stats(power, "__p", window // 2, "__")
    cu = enl**-0.5
    cmax = 2**0.5 * cu
    mean, x = F.col("__mean"), F.col("__p")
    ci = F.try_divide(F.sqrt("__var"), mean)
    alpha = F.try_divide(F.lit(1 + cu * cu), ci * ci - cu * cu)
    b = alpha - (enl + 1)
    root = mean * mean * b * b + 4 * enl * alpha * mean * x
    f = F.try_divide(b * mean + F.sqrt(F.greatest(root, F.lit(0.0))), 2 * alpha)
    db = lambda v: 10 * F.when(v > 0, F.log10(v))
    value = F.when(ci <= cu, db(mean)).when(ci < cmax, db(f)).otherwise(F.col(band))
    return s.withColumn(out, F.when(F.col(band).isNotNull(), value)).drop("__p", "__mean", "__var", "__count")


#: The speckle's deviation by number of looks and by the share of pixels within the sigma range.
SPECKLE_DEVIATION = {
    1: {0.5: 0.4057, 0.6: 0.4954, 0.7: 0.5911, 0.8: 0.6966, 0.9: 0.8191, 0.95: 0.8599},
    2: {0.5: 0.2763, 0.6: 0.3388, 0.7: 0.4062, 0.8: 0.4819, 0.9: 0.5699, 0.95: 0.6254},
    3: {0.5: 0.2222, 0.6: 0.2736, 0.7: 0.3280, 0.8: 0.3892, 0.9: 0.4624, 0.95: 0.5084},
    4: {0.5: 0.1921, 0.6: 0.2348, 0.7: 0.2825, 0.8: 0.3354, 0.9: 0.3991, 0.95: 0.4391},
}


def lee_sigma(px: DataFrame, band: str, out: str, window: int = 9, sigma: float = 0.9, looks: int = 4, tk: int = 7) -> DataFrame:
    """Lee sigma filter of a band in decibels: MMSE in the window, but what has ``tk`` bright pixels around it stays.

    Bright is what reaches the scene's 99th percentile; a pixel keeps its value if its 3 x 3 window has
    at least ``tk`` of these, bright itself or not. The window's focus is right of and below its middle,
    at window // 2 + 1 if the window is odd. ``sigma`` and ``looks`` pick the speckle's deviation.
    """
    eta = SPECKLE_DEVIATION[looks][sigma] ** 2
    focus = window // 2 + window % 2
    power = px.withColumn("__p", F.pow(F.lit(10.0), F.col(band) / 10))
    top = quantile(power, ["scene_id"], "__p", 0.99, "__p99", order=band)

    def filtered(tile: Tile) -> dict[str, np.ndarray]:
        p = tile["__p"]
        known = ~np.isnan(p)
        low, high = -focus, window - 1 - focus
        n = box_sum(known.astype(float), low, high)
        n[n == 0] = np.nan
        v = np.where(known, p, 0.0)
        z, squares = box_sum(v, low, high) / n, box_sum(v * v, low, high) / n
        var = squares - z * z
        var = np.where(var <= squares * 1e-12, 0.0, var)
        b = np.where(var == 0, 0.0, (var - z * z * eta) / (1 + eta) / var)
        mmse = (1 - b) * np.abs(z) + b * p
        around = box_sum((p >= tile["__p99"]).astype(float), 1)
        value = np.where(around >= tk, p, mmse)
        return {out: np.where(known & (value > 0), 10 * np.log10(value), np.nan)}

    got = tiled(power.join(top, "scene_id", "left"), ["__p", "__p99"], max(focus, 1), filtered, f"{out} double")
    return got.drop("__p", "__p99")


def p_median(px: DataFrame, band: str, out: str, window: int = 5) -> DataFrame:
    """Mean of the medians over the cross and over the two diagonals of the window."""
    r = window // 2
    cross = [(dy, dx) for dy, dx in square(r) if dy == 0 or dx == 0]
    diagonals = [(dy, dx) for dy, dx in square(r) if abs(dy) == abs(dx)]

    def medians(tile: Tile) -> dict[str, np.ndarray]:
        v = tile[band]
        both = [median(np.stack(list(shifts(v, lines)))) for lines in (cross, diagonals)]
        return {out: np.where(np.isnan(v), np.nan, (both[0] + both[1]) / 2)}

    return tiled(px, [band], r, medians, f"{out} double")


def median(stack: np.ndarray) -> np.ndarray:
    """Medians along the first axis of the values that are no NaN; NaN without any."""
    stack = np.sort(stack, axis=0)
    n = (~np.isnan(stack)).sum(axis=0)[None]
    low, high = (np.take_along_axis(stack, np.maximum(i, 0), axis=0)[0] for i in ((n - 1) // 2, n // 2))
    return np.where(n[0] == 0, np.nan, np.where(n[0] % 2, low, low + (high - low) * 0.5))


def perona_malik(px: DataFrame, band: str, out: str, n_iters: int = 10, k: float = 3.0, method: int = 1) -> DataFrame:
    """Anisotropic diffusion on power; a missing neighbour has no flow. Methods 1 and 2 of the conductance."""
    if method not in (1, 2):
        raise NotImplementedError(f"method {method}")
    conduct = (lambda d: F.exp(-d * d / k)) if method == 1 else (lambda d: 1 / (1 + d * d / (k * k)))
    across = Window.partitionBy("scene_id", "y").orderBy("x")
    down = Window.partitionBy("scene_id", "x").orderBy("y")

    def flow(step, window: Window, axis: str) -> Column:
        """From the row before or after in the window, if that is the pixel beside."""
        beside = F.abs(step(axis).over(window) - F.col(axis)) == 1
        return F.when(beside, step("__i").over(window) - F.col("__i"))

    d = px.withColumn("__i", F.pow(F.lit(10.0), F.col(band) / 10))
    for _ in range(n_iters):
        d = d.withColumns({"__w": flow(F.lag, across, "x"), "__e": flow(F.lead, across, "x")})
        d = d.withColumns({"__n": flow(F.lag, down, "y"), "__s": flow(F.lead, down, "y")})
        flows = [F.coalesce(conduct(F.col(n)) * F.col(n), F.lit(0.0)) for n in ("__n", "__s", "__e", "__w")]
        d = d.withColumn("__i", F.col("__i") + 0.2 * (flows[0] + flows[1] + flows[2] + flows[3])).drop("__w", "__e", "__n", "__s")
    return d.withColumn(out, 10 * F.when(F.col("__i") > 0, F.log10("__i"))).drop("__i")


def modified_median_zscore(px: DataFrame, band: str, out: str, limit: float = 3.5, fill: str | None = None) -> DataFrame:
    """``fill`` (by default the band itself) with the median of the eight neighbours where the band is a high outlier of its 3 x 3 window."""
    bands = [band] + [fill] * (fill is not None)

    def replaced(tile: Tile) -> dict[str, np.ndarray]:
        v = tile[band]
        middle = median(np.stack(list(shifts(v, square(1)))))
        away = median(np.stack(list(shifts(np.abs(v - middle), square(1)))))
        z = 0.6745 * (v - middle) / np.where(away == 0, np.nan, away)
        ring = median(np.stack(list(shifts(v, square(1, centre=False)))))
        return {out: np.where(z > limit, ring, tile[fill] if fill else v)}

    return tiled(px, bands, 2, replaced, f"{out} double")


def erode(px: DataFrame, band: str, out: str, r: int = 3) -> DataFrame:
    """1 where no 0 lies within distance ``r``; masked pixels stay masked."""

    def low(tile: Tile) -> dict[str, np.ndarray]:
        return {out: np.where(np.isnan(tile[band]), np.nan, distance2(tile[band] == 0, r) > r * r)}

    return tiled(px, [band], r, low, f"{out} int")


def dilate(px: DataFrame, band: str, out: str, r: int = 3) -> DataFrame:
    """1 where a 1 lies nearer than ``r``; masked pixels stay masked."""

    def high(tile: Tile) -> dict[str, np.ndarray]:
        return {out: np.where(np.isnan(tile[band]), np.nan, distance2(tile[band] == 1, r) < r * r)}

    return tiled(px, [band], r, high, f"{out} int")


def open_binary(px: DataFrame, band: str, out: str, r: int = 3) -> DataFrame:
    return dilate(erode(px, band, "__e", r), "__e", out, r).drop("__e")


def close_binary(px: DataFrame, band: str, out: str, r: int = 3) -> DataFrame:
    return erode(dilate(px, band, "__d", r), "__d", out, r).drop("__d")


#: The halves of a 7 x 7 window by direction: the side that a directional mean is taken over.
_HALVES = (
    lambda dy, dx: dy >= 0, lambda dy, dx: dx <= dy, lambda dy, dx: dx <= 0, lambda dy, dx: dx <= -dy,
    lambda dy, dx: dy <= 0, lambda dy, dx: dx >= dy, lambda dy, dx: dx >= 0, lambda dy, dx: dx >= -dy,
)


def refined_lee(px: DataFrame, band: str, out: str) -> DataFrame:
    """Directional speckle filter of a band in decibels.

    The strongest of four gradients between the 3 x 3 means around a pixel picks one of eight halves of
    its 7 x 7 window; the noise is the mean of the five least squared variations. Of equal gradients the
    first counts; a gradient with a side off the scene does not count, and a pixel without any gradient
    keeps its value. Half windows of no variance give their mean.
    """
    spots = [(dy, dx) for dy in (-2, 0, 2) for dx in (-2, 0, 2)]

    def filtered(tile: Tile) -> dict[str, np.ndarray]:
        p = 10.0 ** (tile[band] / 10)
        known = ~np.isnan(p)
        n = box_sum(known.astype(float), 1)
        n[n == 0] = np.nan
        near = np.where(known, p, 0.0)
        mean, squares = box_sum(near, 1) / n, box_sum(near * near, 1) / n
        var = squares - mean * mean
        var = np.where(var <= squares * 1e-12, 0.0, var)
        # Windows stand only around pixels of the scene.
        mean, var = (np.where(tile.present, a, np.nan) for a in (mean, var))
        ratio = np.sort(np.stack(list(shifts(var / np.where(mean == 0, np.nan, mean * mean), spots))), axis=0)[:5]
        of = (~np.isnan(ratio)).sum(axis=0)
        noise = np.nansum(ratio, axis=0) / np.where(of == 0, np.nan, of)
        m = list(shifts(mean, spots))
        across = [(m[1], m[7]), (m[6], m[2]), (m[3], m[5]), (m[0], m[8])]
        steep = np.stack([np.abs(a - b) for a, b in across])
        flat = np.isnan(steep).all(axis=0)
        chosen = np.nan_to_num(steep, nan=-1.0).argmax(axis=0)
        a, b = (np.take_along_axis(np.stack([pair[i] for pair in across]), chosen[None], axis=0)[0] for i in (0, 1))
        half = chosen + np.where(a - m[4] > m[4] - b, 0, 4)
        out_mean, out_var = np.full(p.shape, np.nan), np.full(p.shape, np.nan)
        for k, inside in enumerate(_HALVES):
            side = np.stack(list(shifts(p, [(dy, dx) for dy, dx in square(3) if inside(dy, dx)])))
            here = (half == k) & ~flat
            count = (~np.isnan(side)).sum(axis=0)
            count = np.where(count == 0, np.nan, count)
            middle = np.nansum(side, axis=0) / count
            out_mean[here] = middle[here]
            out_var[here] = (np.nansum((side - middle) ** 2, axis=0) / count)[here]
        signal = (out_var - out_mean * out_mean * noise) / (noise + 1)
        share = signal / np.where(out_var == 0, np.nan, out_var)
        value = out_mean + np.where(np.isnan(share), 0.0, share) * (p - out_mean)
        value = np.where(np.isnan(value), p, value)
        return {out: np.where(known & (value > 0), 10 * np.log10(value), np.nan)}

    return tiled(px, [band], 3, filtered, f"{out} double")
