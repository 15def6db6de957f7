"""Histogram thresholds: Otsu per scene, on the most bimodal tiles, and what they tell apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .focal import KEYS, neighbours


def histogram(px: DataFrame, band: str, width: float, by: list[str], ordered: bool = False) -> DataFrame:
    """(by, bucket, n, mean) with buckets of fixed width; masked pixels do not count.

    ``ordered`` adds up a bucket's pixels by row and column, so that its mean, which pixels may equal, has the same last
    bit however they are dealt. A bucket is then sorted by one task: this is for few pixels a group.
    """
    v = F.col(band)
    if not ordered:
        return px.where(v.isNotNull()).groupBy(*by, F.floor(v / width).alias("bucket")).agg(F.count("*").alias("n"), F.avg(band).alias("mean"))
    d = px.where(v.isNotNull()).select(*by, F.floor(v / width).alias("bucket"), *[c for c in KEYS if c not in by], v.alias("__v"))
    inside = Window.partitionBy(*by, "bucket").orderBy(*KEYS)
    run = {"n": F.row_number().over(inside), "__s": F.sum("__v").over(inside.rowsBetween(Window.unboundedPreceding, 0))}
    last = d.withColumns(run | {"__last": F.lead(F.lit(1)).over(inside).isNull()}).where("__last")
    return last.select(*by, "bucket", F.col("n").cast("long").alias("n"), (F.col("__s") / F.col("n")).alias("mean"))


def adaptive_histogram(px: DataFrame, band: str, by: list[str], max_buckets: int = 255, finest: int = -9) -> DataFrame:
    """(by, bucket, n, mean, width): the width is the least power of 2, from 2 ** ``finest``, that leaves few enough buckets.

    The pixels are counted once, in the finest buckets; a group's buckets are these, halved in number while
    there are more than ``max_buckets``, rounded up to a power of 2, from its first to its last. So they do not depend
    on how the pixels are dealt.
    """
    most = 1 << (max_buckets - 1).bit_length()
    v = F.col(band).cast("double")
    fine = px.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, F.floor(v / 2.0**finest).alias("__fine"))
    fine = fine.agg(F.count("*").alias("n"), F.sum(v).alias("s"))
    ends = fine.groupBy(*by).agg(F.min("__fine").alias("__lo"), F.max("__fine").alias("__hi"))
    span = lambda k: F.shiftright("__hi", k) - F.shiftright("__lo", k)
    halvings = F.lit(62)
    for k in range(61, -1, -1):
        halvings = F.when(span(k) < most, F.lit(k)).otherwise(halvings)
    widths = ends.select(*by, halvings.cast("int").alias("__k"))
    rolled = fine.join(widths, by).withColumn("bucket", F.expr("shiftright(__fine, __k)"))
    merged = rolled.groupBy(*by, "bucket", "__k").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))
    return merged.select(*by, "bucket", "n", "mean", (F.pow(F.lit(2.0), F.col("__k")) * 2.0**finest).alias("width"))


def otsu(hist: DataFrame, by: list[str]) -> DataFrame:
    """(by, threshold): the bucket mean at the greatest between-class sum of squares.

    Of equal values the lowest bucket counts; the last bucket leaves no second class and never wins
    unless it is alone.
    """
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    weighted = F.col("n") * F.col("mean")
    h = hist.withColumns(
        {"__n": F.sum("n").over(before), "__s": F.sum(weighted).over(before), "__all_n": F.sum("n").over(whole), "__all_s": F.sum(weighted).over(whole)}
    )
    mean = F.col("__all_s") / F.col("__all_n")
    first = F.col("__s") / F.col("__n")
    second = F.try_divide(F.col("__all_s") - F.col("__s"), F.col("__all_n") - F.col("__n"))
    bss = F.col("__n") * F.pow(first - mean, F.lit(2)) + (F.col("__all_n") - F.col("__n")) * F.pow(second - mean, F.lit(2))
    rank = F.struct(F.coalesce(F.round(bss, 6), F.lit(-1.0)).alias("bss"), (-F.col("bucket")).alias("first"))
    return h.groupBy(*by).agg(F.max_by("mean", rank).alias("threshold"))


def otsu_extent(px: DataFrame, band: str, out: str = "water", width: float = 0.25) -> DataFrame:
    """1 where the band is below its scene's Otsu threshold, else 0; masked pixels stay masked.

    A threshold is the mean of a bucket, which pixels may equal; what differs from it by rounding only is not below it, so that
    the order of sums decides nothing.
    """
    cut = otsu(histogram(px, band, width, ["scene_id"]), ["scene_id"])
    joined = px.join(cut, "scene_id", "left")
    below = F.col("threshold") - F.col(band) > 1e-12 * F.abs("threshold")
    return joined.withColumn(out, below.cast("int"))


def _moments(px: DataFrame, band: str, initial: float, cell: int) -> DataFrame:
    """(scene_id, ty, tx, moments) of squares of ``cell`` pixels: numbers, sums and squares below the initial threshold and in all."""
    valid = px.where(F.col(band).isNotNull()).withColumns({f"t{c}": F.floor(F.col(c) / cell) for c in "yx"})
    v, low = F.col(band).cast("double"), F.col(band) < initial
    return valid.groupBy("scene_id", "ty", "tx").agg(
        F.count("*").alias("n"),
        F.sum(v).alias("s"),
        F.sum(v * v).alias("q"),
        F.count(F.when(low, 1)).alias("n_low"),
        F.coalesce(F.sum(F.when(low, v)), F.lit(0.0)).alias("s_low"),
    )


def _bmax(m: DataFrame) -> DataFrame:
    """(scene_id, ty, tx, bmax) of moments. A square all on one side of the initial threshold counts as -25 or 0 on the other."""
    n, low = F.col("n"), F.col("n_low")
    p = F.when(low == 0, 0.9999).otherwise(low / n)
    first = F.coalesce(F.try_divide(F.col("s_low"), low), F.lit(-25.0))
    second = F.coalesce(F.try_divide(F.col("s") - F.col("s_low"), n - low), F.lit(0.0))
    mean, square = F.col("s") / n, F.col("q") / n
    var = square - mean * mean
    var = F.when(var <= square * 1e-12, 2.0).otherwise(var)
    return m.select("scene_id", "ty", "tx", F.round(p * (1 - p) * F.pow(first - second, F.lit(2)) / var, 6).alias("bmax"))


def tile_scores(px: DataFrame, band: str, initial: float, grid: int) -> DataFrame:
    """(scene_id, ty, tx, bmax): how bimodal each tile is about an initial threshold."""
    return _bmax(_moments(px, band, initial, grid))


def bimodal_tiles(px: DataFrame, band: str, initial: float, grid: int, least: float = 0.75, iters: int = 1) -> DataFrame:
    """(scene_id, ty, tx, bmax) of the squares of ``grid / 2 ** (iters - 1)`` pixels that are bimodal, as are all that they lie in.

    The pixels are read once: their moments are added up in the finest squares, and those of the coarser
    ones are sums of these.
    """
    finest = grid >> (iters - 1)
    if grid != finest << (iters - 1):
        raise ValueError(f"a grid of {grid} pixels can't be halved {iters - 1} times")
    base = _moments(px, band, initial, finest)
    sums = ("n", "s", "q", "n_low", "s_low")
    chosen = None
    for level in range(iters - 1, -1, -1):
        up = {f"t{c}": F.floor(F.col(f"t{c}") / (1 << level)) for c in "yx"}
        rolled = base.withColumns(up).groupBy("scene_id", "ty", "tx").agg(*[F.sum(c).alias(c) for c in sums]) if level else base
        scored = _bmax(rolled).where(F.col("bmax") > least)
        if chosen is not None:
            parents = chosen.select("scene_id", F.col("ty").alias("__py"), F.col("tx").alias("__px"))
            inside = (F.floor(F.col("ty") / 2) == F.col("__py")) & (F.floor(F.col("tx") / 2) == F.col("__px"))
            scored = scored.alias("own").join(parents.alias("up"), (F.col("own.scene_id") == F.col("up.scene_id")) & inside, "left_semi")
        chosen = scored
    return chosen


def bmax_otsu(
    px: DataFrame,
    band: str,
    initial: float,
    grid: int = 5,
    least: float = 0.75,
    max_boxes: int | None = 100,
    width: float = 0.25,
    iters: int = 1,
    thresh_no_data: float | None = None,
) -> DataFrame:
    """(scene_id, threshold) from the ``max_boxes`` most bimodal tiles of each scene; scenes without one have ``thresh_no_data``.

    With ``iters`` the grid is halved so often, within the tiles found before. Tiles are ranked
    downwards by score, ties by their row and column.
    """
    finest = grid >> (iters - 1)
    chosen = bimodal_tiles(px, band, initial, grid, least, iters)
    if max_boxes is not None:
        ranked = Window.partitionBy("scene_id").orderBy(F.desc("bmax"), "ty", "tx")
        chosen = chosen.withColumn("__r", F.row_number().over(ranked)).where(F.col("__r") <= max_boxes)
    squares = px.withColumns({f"t{c}": F.floor(F.col(c) / finest) for c in "yx"})
    inside = squares.join(chosen, ["scene_id", "ty", "tx"], "left_semi")
    cut = otsu(histogram(inside, band, width, ["scene_id"], ordered=max_boxes is not None), ["scene_id"])
    if thresh_no_data is None:
        return cut
    scenes = px.select("scene_id").distinct()
    return scenes.join(cut, "scene_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(thresh_no_data).cast("double")))


def threshold_extent(px: DataFrame, band: str, cuts: DataFrame, invert: bool = False, out: str = "water") -> DataFrame:
    """1 below (or, inverted, above) the threshold of the pixel's scene, else 0; NULL where either is missing."""
    joined = px.join(cuts.select("scene_id", F.col("threshold").alias("__cut")), "scene_id", "left")
    side = F.col(band) > F.col("__cut") if invert else F.col(band) < F.col("__cut")
    return joined.withColumn(out, side.cast("int")).drop("__cut")


def modis_flood(red: str = "red", nir: str = "nir", swir2: str = "swir2"):
    ratio = F.try_divide(F.col(nir) + 0.00135, F.col(red) + 0.10811)
    return ((ratio < 0.7) & (F.col(red) < 0.2027) & (F.col(swir2) < 0.06757)).cast("int")


__all__ = ["KEYS", "bmax_otsu", "histogram", "modis_flood", "neighbours", "otsu", "otsu_extent", "threshold_extent", "tile_scores"]
