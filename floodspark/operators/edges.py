"""Canny edges and the Otsu threshold around long ones."""

from __future__ import annotations

from math import ceil, pi, tan

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import patch_sizes, patches
from .focal import KEYS
from .threshold import histogram, otsu
from .tiles import TILE, Tile, gradients, shifts, tiled, weighted_mean, window_extreme

def thinned(v: np.ndarray, sigma: float) -> np.ndarray:
    """Gradient of ``v``, smoothed by a Gaussian, where it is greatest across the edge, else 0.

    The neighbours across lie on the nearest of four axes. Of two equal ones the first along the axis counts.
    """
    if sigma > 0:
        away = np.arange(-ceil(3 * sigma), ceil(3 * sigma) + 1)
        bell = np.exp(-(away**2) / (2 * sigma * sigma))
        v = np.where(np.isnan(v), np.nan, weighted_mean(v, np.outer(bell, bell)))
    gx, gy = gradients(v)
    size = np.nan_to_num(np.sqrt(gx * gx + gy * gy))
    flat, steep = np.abs(gy) <= tan(pi / 8) * np.abs(gx), np.abs(gy) >= tan(3 * pi / 8) * np.abs(gx)
    axis = np.where(flat, 0, np.where(steep, 1, np.where(gx * gy > 0, 2, 3)))
    out = np.zeros(v.shape)
    for k, (dy, dx) in enumerate(((0, 1), (1, 0), (1, 1), (1, -1))):
        before, after = shifts(size, [(-dy, -dx), (dy, dx)], 0.0)
        out = np.where((axis == k) & (size > before) & (size >= after), size, out)
    return np.where(np.isnan(v), np.nan, out)


def canny(
    px: DataFrame, band: str, out: str = "edge", threshold: float = 0.05, sigma: float = 0.0, low: float | None = None, tile: int = TILE
) -> DataFrame:
    """Adds the gradient's size where an edge runs, 0 where none does, and NULL where the band is masked.

    An edge is a thinned gradient above ``threshold``. With ``low``, gradients above it are edges too if a
    chain of them leads to one above ``threshold``, over however many tiles.
    """

    def found(part: Tile) -> dict[str, np.ndarray]:
        size = thinned(part[band], sigma)
        least = threshold if low is None else min(low, threshold)
        return {out: np.where(size > least, size, np.where(np.isnan(size), np.nan, 0.0))}

    got = tiled(px, [band], ceil(3 * sigma) + 2, found, f"{out} double", tile)
    if low is None:
        return got
    chains = patches(got.withColumn("__on", (F.col(out) > 0).cast("int")), "__on")
    sizes = got.select(*KEYS, F.col(out).alias("__size"))
    linked = chains.join(sizes, KEYS).groupBy("scene_id", "label").agg(F.max("__size").alias("__top")).where(F.col("__top") > threshold)
    kept = chains.join(linked, ["scene_id", "label"], "left_semi").select(*KEYS, F.lit(True).alias("__linked"))
    return got.join(kept, KEYS, "left").withColumn(out, F.when((F.col(out) == 0) | F.col("__linked"), F.col(out)).otherwise(F.col(out) * 0)).drop("__linked")


def edge_otsu(
    px: DataFrame,
    band: str,
    initial: float,
    no_data: float | None = None,
    canny_threshold: float = 0.05,
    canny_sigma: float = 0.0,
    canny_lt: float = 0.05,
    connected: int = 200,
    length: int = 50,
    buffer: int = 1,
    width: float = 0.25,
    tile: int = TILE,
) -> DataFrame:
    """(scene_id, threshold) by Otsu from the pixels within ``buffer`` rows and columns of a long edge.

    Edges are those of the pixels below ``initial``; a long one has ``length`` connected pixels, all with a
    gradient below ``canny_lt`` or none (``connected`` is where counting ends). Scenes without one have ``no_data``.
    """
    marked = canny(px.withColumn("__low", (F.col(band) < initial).cast("int")), "__low", "__edge", canny_threshold, canny_sigma, tile=tile)
    edge, faint = F.col("__edge") > 0, F.col("__edge") < canny_lt
    kinds = {"__clear": edge & ~faint}
    if canny_lt > canny_threshold:
        kinds["__faint"] = edge & faint
    for name, kind in kinds.items():
        marked = marked.withColumn(name, F.coalesce(kind.cast("int"), F.lit(0)))
        marked = patch_sizes(marked, name, f"{name}_size", connected)
    long = F.greatest(*[F.coalesce(f"{n}_size", F.lit(0)) for n in kinds] + [F.lit(0)]) >= length

    def near(part: Tile) -> dict[str, np.ndarray]:
        return {"__near": window_extreme(part["__long"], buffer, np.fmax)}

    spread = tiled(marked.withColumn("__long", long.cast("int")), ["__long"], buffer, near, "__near int", tile)
    cut = otsu(histogram(spread.where(F.col("__near") == 1), band, width, ["scene_id"]), ["scene_id"])
    scenes = px.select("scene_id").distinct()
    return scenes.join(cut, "scene_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(no_data).cast("double")))
