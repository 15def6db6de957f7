"""Scene collections: catalogue predicates, sensor quality masks, joins, merges and time reductions.

A dataset is two lazy DataFrames: ``pixels`` (scene_id, y, x, ts, bands) and its region and period. Every
method returns a new dataset; nothing runs before an action.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixel import extract_bits, rescale

OPTICAL_BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")
KEYS = ("scene_id", "y", "x", "ts")


@dataclass(frozen=True)
class Dataset:
    pixels: DataFrame
    region: tuple[int, int, int, int] | None = None  # y0, x0, y1, x1, half open
    start: str | None = None
    end: str | None = None

    def qa(self, px: DataFrame) -> DataFrame:
        """Sensor subclasses mask bad pixels here."""
        return px

    @classmethod
    def load(cls, pixels: DataFrame, region=None, start=None, end=None, use_qa: bool = False) -> Dataset:
        px = pixels
        if region:
            y0, x0, y1, x1 = region
            px = px.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
        if start:
            px = px.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        if end:
            px = px.where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
        made = cls(px, region, start, end)
        return replace(made, pixels=made.qa(px)) if use_qa else made

    @classmethod
    def from_collection(cls, pixels: DataFrame) -> Dataset:
        """An existing collection, with the extent of its pixels and the first and last (exclusive) of its days."""
        ends = pixels.agg(
            *[f(c).alias(f"{n}{c}") for c in "yx" for n, f in (("lo", F.min), ("hi", F.max))],
            F.date_format(F.min("ts"), "yyyy-MM-dd").alias("start"),
            F.date_format(F.date_add(F.to_date(F.max("ts")), 1), "yyyy-MM-dd").alias("end"),
        ).first()
        region = None if ends["loy"] is None else (ends["loy"], ends["lox"], ends["hiy"] + 1, ends["hix"] + 1)
        return cls(pixels, region, ends["start"], ends["end"])

    @property
    def bands(self) -> list[str]:
        return [c for c in self.pixels.columns if c not in KEYS]

    def scenes(self) -> DataFrame:
        """One row for each scene: time and footprint."""
        return self.pixels.groupBy("scene_id").agg(
            F.min("ts").alias("ts"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1")
        )

    def n_images(self) -> int:
        return self.scenes().count()

    def dates(self) -> DataFrame:
        return self.scenes().select("scene_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("date"))

    def apply_func(self, func: Callable[..., DataFrame], **kwargs) -> Dataset:
        return replace(self, pixels=self.pixels.transform(func, **kwargs))

    apply = apply_func

    def pipe(self, steps: list) -> Dataset:
        """Functions, or (function, keyword arguments), one after the other in a single plan."""
        out = self
        for step in steps:
            func, kwargs = step if isinstance(step, tuple) else (step, {})
            out = out.apply_func(func, **kwargs)
        return out

    def filter(self, condition: Column) -> Dataset:
        """Scenes whose metadata (scene_id, ts, y0, x0, y1, x1) meet the condition."""
        return replace(self, pixels=self.pixels.join(self.scenes().where(condition).select("scene_id"), "scene_id", "left_semi"))

    def select(self, *bands: str | Column) -> Dataset:
        return replace(self, pixels=self.pixels.select(*KEYS, *bands))

    def clip(self, region: tuple[int, int, int, int]) -> Dataset:
        return Dataset.load(self.pixels, region)

    def merge(self, other: Dataset) -> Dataset:
        return replace(self, pixels=self.pixels.unionByName(other.pixels, allowMissingColumns=True))

    def pairs(self, other: Dataset, days: int = 1) -> DataFrame:
        """(scene_id, other_id, other_ts): scenes within ``days`` whose footprints overlap.

        The interval join is an equi-join on day buckets: each left scene looks into its own bucket of
        ``days`` days and the ones beside it.
        """
        span = days * 86_400_000_000
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        left = self.scenes().withColumn("us", us)
        left = left.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("us") / span) + i for i in (-1, 0, 1)])))
        right = other.scenes().withColumn("us", us).withColumn("bucket", F.floor(F.col("us") / span))
        right = right.select("bucket", *[F.col(c).alias(f"other_{c}") for c in ("scene_id", "ts", "us", "y0", "x0", "y1", "x1")])
        near = F.abs(F.col("us") - F.col("other_us")) <= span
        meet = (F.col("y0") <= F.col("other_y1")) & (F.col("other_y0") <= F.col("y1")) & (F.col("x0") <= F.col("other_x1")) & (F.col("other_x0") <= F.col("x1"))
        return left.join(right, "bucket").where(near & meet).select("scene_id", F.col("other_scene_id").alias("other_id"), "other_ts")

    def join(self, other: Dataset, days: int = 1) -> Dataset:
        """Pixels with the bands of the latest valid matching scene of ``other`` appended.

        Both sides' pixels are laid on one time line for each place, the left ones ``days`` later, where
        the last valid value of ``other`` before a pixel is the wanted one unless it is too old. So each
        pixel is shuffled once for its scene's time and once for its place, however many scenes match.
        """
        span = days * 86_400_000_000
        right = other.bands
        us = F.unix_micros(F.col("ts").cast("timestamp"))

        def timed(px: DataFrame) -> DataFrame:
            times = px.groupBy("scene_id").agg(F.min("ts").alias("ts")).select("scene_id", us.alias("__us"))
            return px.where("y IS NOT NULL AND x IS NOT NULL").join(times.where("__us IS NOT NULL"), "scene_id")

        own = timed(self.pixels)
        left = own.select("y", "x", (F.col("__us") + span).alias("__at"), F.struct(*[F.col(c) for c in self.pixels.columns]).alias("__own"))
        values = F.struct(*[F.col(b).alias(b) for b in right])
        theirs = timed(other.pixels.select("scene_id", "y", "x", "ts", *right))
        theirs = theirs.select("y", "x", F.col("__us").alias("__at"), F.col("scene_id").alias("__id"), values.alias("__theirs"))
        both = left.unionByName(theirs, allowMissingColumns=True)
        line = Window.partitionBy("y", "x").orderBy("__at", F.col("__own").isNotNull(), "__id")
        before = line.rowsBetween(Window.unboundedPreceding, 0)
        last = {f"__last_{b}": F.struct(F.col("__at").alias("at"), F.col("__theirs")[b].alias("value")) for b in right}
        last = {n: F.last(F.when(F.col("__theirs")[b].isNotNull(), v), ignorenulls=True).over(before) for b, (n, v) in zip(right, last.items())}
        seen = F.last(F.when(F.col("__own").isNull(), F.col("__at")), ignorenulls=True).over(before)
        found = both.withColumns({"__seen": seen, **last}).where(F.col("__own").isNotNull() & (F.col("__at") - F.col("__seen") <= 2 * span))
        latest = [F.when(F.col("__at") - F.col(f"__last_{b}.at") <= 2 * span, F.col(f"__last_{b}.value")).alias(b) for b in right]
        return replace(self, pixels=found.select("__own.*", *latest))

    def aggregate_time(self, reducer: Callable = F.avg, dates: DataFrame | None = None, period: int = 1) -> DataFrame:
        """(ts, y, x, bands) reduced over each day, or over ``period`` days from each row of ``dates`` (day)."""
        if dates is None:
            return self.pixels.groupBy(F.date_trunc("day", "ts").alias("ts"), "y", "x").agg(*[reducer(b).alias(b) for b in self.bands])
        windows = dates.select(
            F.col("day").alias("start"), F.explode(F.sequence("day", F.date_add("day", period - 1))).alias("day")
        )
        daily = self.pixels.withColumn("day", F.to_date("ts")).join(windows, "day")
        return daily.groupBy(F.col("start").alias("ts"), "y", "x").agg(*[reducer(b).alias(b) for b in self.bands])

    def mosaic(self) -> DataFrame:
        """(y, x, bands): the latest valid value of each pixel."""
        order = F.struct("ts", "scene_id")
        return self.pixels.groupBy("y", "x").agg(*[F.max_by(b, F.when(F.col(b).isNotNull(), order)).alias(b) for b in self.bands])

    def reduce(self, **aggregates: Column) -> DataFrame:
        return self.pixels.groupBy("y", "x").agg(*[a.alias(n) for n, a in aggregates.items()])

    def band_pass(self, gain: dict[str, float], bias: dict[str, float], bias_scale: float = 1.0) -> Dataset:
        bands = {b: F.col(b) * gain[b] + bias.get(b, 0.0) * bias_scale for b in gain}
        return replace(self, pixels=self.pixels.withColumns(bands))


def mask(px: DataFrame, bands: list[str], valid: Column) -> DataFrame:
    return px.withColumns({b: F.when(valid, F.col(b)) for b in bands})


def deduplicate(px: DataFrame, group: Column, order: Column, bands: list[str]) -> DataFrame:
    """One image for each group: the valid value of the last in order, with the group's first and last time."""
    return px.groupBy(group.alias("take"), "y", "x").agg(
        *[F.max_by(b, F.when(F.col(b).isNotNull(), order)).alias(b) for b in bands], F.min("ts").alias("ts"), F.max("ts").alias("ts_end")
    )


class Sentinel1(Dataset):
    def qa(self, px: DataFrame) -> DataFrame:
        angle = F.col("angle")
        return mask(px, ["vv", "vh"], (angle > 30.63993) & (angle < 45.23993))

    @staticmethod
    def add_orbit_band(px: DataFrame, orbit: str = "orbit") -> DataFrame:
        return px.withColumn("orbit_band", F.when(F.col(orbit) == "DESCENDING", 0).otherwise(1))

    def pass_only(self, orbit: Column, direction: str) -> Sentinel1:
        return replace(self, pixels=self.pixels.where(orbit == direction))


class Landsat(Dataset):
    def qa(self, px: DataFrame) -> DataFrame:
        good = (F.col("qa_pixel").bitwiseAND(F.lit(0b111111)) == 0) & (F.col("qa_radsat") == 0)
        return mask(px, list(OPTICAL_BANDS), good)

    @staticmethod
    def scaled(px: DataFrame) -> DataFrame:
        return px.withColumns({b: rescale(F.col(b), 0.0000275, -0.2) for b in OPTICAL_BANDS})


class Modis(Dataset):
    #: The bits of state_1km that must be clear.
    STATE_BITS = (10, 2, 12, 13)
    #: The bit ranges of qc_500m (end exclusive) that must be zero, one for each band used.
    QUALITY_FIELDS = ((2, 5), (6, 9), (10, 13), (14, 17), (22, 25), (26, 29))

    def qa(self, px: DataFrame) -> DataFrame:
        """Masks by state, zenith and, where the pixels have it, ``qc_500m``."""
        good = F.abs("zenith") < 6000
        for bit in self.STATE_BITS:
            good = good & (extract_bits(F.col("state_1km"), bit) == 0)
        if "qc_500m" in px.columns:
            for start, end in self.QUALITY_FIELDS:
                good = good & (extract_bits(F.col("qc_500m"), start, end) == 0)
        return mask(px, [b for b in OPTICAL_BANDS if b in px.columns], good)


class Viirs(Dataset):
    #: The bits of the quality columns that must be clear.
    QUALITY_BITS = {"qf3": (1, 3), "qf4": (0, 1, 2, 3)}

    def qa(self, px: DataFrame) -> DataFrame:
        """Masks by cloud, shadow, zenith and, where the pixels have them, ``qf3`` and ``qf4``."""
        good = (F.abs("zenith") < 6000) & (extract_bits(F.col("qf1"), 2) == 0) & (extract_bits(F.col("qf2"), 3) == 0)
        for column, bits in self.QUALITY_BITS.items():
            for bit in bits if column in px.columns else ():
                good = good & (extract_bits(F.col(column), bit) == 0)
        return mask(px, [b for b in OPTICAL_BANDS if b in px.columns], good)


class Sentinel2(Dataset):
    def qa(self, px: DataFrame) -> DataFrame:
        """Masks clouds; with ``scl`` and ``azimuth`` (degrees of the sun) also their shadows, grown by a margin."""
        if {"scl", "azimuth"} <= set(px.columns):
            return self.shadow_mask(px)
        return mask(px, [b for b in OPTICAL_BANDS if b in px.columns], F.col("cloud_probability") <= 40)

    @staticmethod
    def shadow_mask(px: DataFrame, reach: int = 30, shrink: int = 2, grow: int = 10, dark: float = 0.175) -> DataFrame:
        """Masks clouds and the dark land pixels within ``reach`` of a cloud, away from the sun.

        Pixels lie on parallel rays along their scene's direction away from the sun; on each, one window has
        the last cloud before a pixel, whatever the reach. The mask then loses what is nearer than
        ``shrink`` to its border and grows by ``grow`` pixels. A missing probability is no cloud.
        """
        from ..operators.tiles import Tile, distance2, tiled

        away = F.radians(F.col("azimuth") + 180)  # clockwise from north; rows grow southwards
        dx, dy = F.sin(away), -F.cos(away)
        ray = F.floor(F.col("x") * dy - F.col("y") * dx + 0.5)
        d = px.withColumns({"__ray": ray, "__along": F.round(F.col("x") * dx + F.col("y") * dy, 6)})
        cloud = F.coalesce(F.col("cloud_probability") > 40, F.lit(False))
        before = Window.partitionBy("scene_id", "__ray").orderBy("__along").rangeBetween(Window.unboundedPreceding, 0)
        last = F.max(F.when(cloud, F.col("__along"))).over(before)
        shade = F.coalesce(F.col("__along") - last <= reach, F.lit(False))
        shadow = F.coalesce(shade & (F.col("nir") < dark) & (F.col("scl") != 6), F.lit(False))
        d = d.withColumn("__bad", (cloud | shadow).cast("int")).drop("__ray", "__along")

        def spread(part: Tile) -> dict[str, np.ndarray]:
            core = (part["__bad"] == 1) & (distance2(part["__bad"] == 0, shrink) > shrink * shrink)
            return {"__hit": distance2(core, grow) <= grow * grow}

        d = tiled(d, ["__bad"], shrink + grow, spread, "__hit int")
        masked = mask(d, [b for b in OPTICAL_BANDS if b in px.columns], F.col("__hit") == 0)
        return masked.select(px.columns)


def tile_region(spark, region: tuple[float, float, float, float], grid: float, keep: str | None = None) -> DataFrame:
    """(w, s, e, n) boxes of a grid snapped to multiples of ``grid`` over a region.

    ``keep`` is None (all), ``intersect``, ``contain`` or ``centroid``.
    """
    if keep not in (None, "intersect", "contain", "centroid"):
        raise ValueError(f"keep must be intersect, contain or centroid, not {keep}")
    w, s, e, n = region
    axis = lambda lo, hi: F.explode(F.sequence(F.lit(int(lo // grid)), F.lit(int(-(-hi // grid)) - 1)))
    boxes = spark.range(1).select(axis(w, e).alias("i")).select("i", axis(s, n).alias("j"))
    boxes = boxes.select(*[(F.col(c) * grid).alias(k) for c, k in (("i", "w"), ("j", "s"))])
    boxes = boxes.withColumns({"e": F.col("w") + grid, "n": F.col("s") + grid})
    if keep == "contain":
        return boxes.where((F.col("w") >= w) & (F.col("s") >= s) & (F.col("e") <= e) & (F.col("n") <= n))
    if keep == "intersect":
        return boxes.where((F.col("w") <= e) & (F.col("e") >= w) & (F.col("s") <= n) & (F.col("n") >= s))
    if keep == "centroid":
        x, y = (F.col("w") + F.col("e")) / 2, (F.col("s") + F.col("n")) / 2
        return boxes.where(x.between(w, e) & y.between(s, n))
    return boxes


def decode_date(text: str | Column) -> Column:
    """Timestamp of a date in one of the four accepted formats, else NULL."""
    formats = ("yyyyMMdd", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    value = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in formats])


def bbox_of(table: DataFrame, column: str, name: str) -> DataFrame:
    """(w, s, e, n) of the rows whose ``column`` is ``name``."""
    return table.where(F.col(column) == name).agg(F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"))


def admin_bbox(table: DataFrame, name: str, level: int = 1) -> DataFrame:
    if level not in (0, 1, 2):
        raise ValueError("level must be 0, 1 or 2")
    return bbox_of(table, f"ADM{level}_NAME", name)


def with_export_names(px: DataFrame, prefix: str, suffix: str = "") -> DataFrame:
    """Adds ``name``: prefix, scene time and suffix, as the scenes' export names."""
    parts = [F.lit(prefix), F.date_format(F.min("ts"), "yyyyMMddHHmmss")] + ([F.lit(suffix)] if suffix else [])
    return px.join(px.groupBy("scene_id").agg(F.concat_ws("_", *parts).alias("name")), "scene_id")


def export(px: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One write for all scenes, partitioned by name columns."""
    if not isinstance(px, DataFrame):
        raise TypeError("a DataFrame of pixels is needed")
    if not path:
        raise ValueError("a path is needed")
    writer = px.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def mosaic_exports(tiles: DataFrame, path: str, expected: int, tile: str = "tile", by: list[str] | None = None) -> DataFrame:
    """Writes the mosaic of exported tiles to ``path`` and returns it as read back; nothing is written if a tile is missing.

    ``tiles`` has the pixels (y, x, bands) of all tiles, ``tile`` names each one's tile. Where tiles overlap, the
    first valid value in the order of the tiles' names counts, band by band.
    """
    found = tiles.agg(F.countDistinct(tile)).first()[0]
    if found < expected:
        raise ValueError(f"{found} of {expected} tiles are there")
    keys = [*(by or []), "y", "x"]
    bands = [c for c in tiles.columns if c not in (*keys, tile)]
    first = [F.min_by(b, F.when(F.col(b).isNotNull(), F.col(tile))).alias(b) for b in bands]
    export(tiles.groupBy(*keys).agg(*first), path, by)
    return tiles.sparkSession.read.parquet(path)
