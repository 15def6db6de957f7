"""Cheapest paths over the pixels of a scene, of any length, in tiles.

Each tile is solved by relaxing its pixels from their eight neighbours until nothing improves. What a
path needs from beside the tile are the pixels along its border: costs and path costs of rims alone
travel between tiles. A round solves again only the tiles beside a rim that improved, until none does,
so the rounds are as many as tiles that a cheapest path crosses. A task holds one tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .tiles import TILE

PLACE = ["scene_id", "ty", "tx"]
_STEPS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def relax(path: np.ndarray, cost: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Least path costs where ``free``, from those that ``path`` has; a step costs the mean of its ends' costs times its length.

    The outermost rows and columns only give. NaN costs can't be crossed.
    """
    cost = np.where(np.isnan(cost), np.inf, cost)
    path = path.copy()
    inner = (slice(1, -1), slice(1, -1))
    h, w = path.shape
    open_ = free[inner]
    moves = []
    for dy, dx in _STEPS:
        there = (slice(1 + dy, h - 1 + dy), slice(1 + dx, w - 1 + dx))
        moves.append((there, (cost[inner] + cost[there]) / 2 * (2.0**0.5 if dy and dx else 1.0)))
    while True:
        before = path[inner].copy()
        for there, step in moves:
            path[inner] = np.where(open_, np.fmin(path[inner], path[there] + step), path[inner])
        if np.array_equal(before, path[inner]):
            return path


def _packed(px: DataFrame, costs: list[str], source: str, tile: int) -> DataFrame:
    """(scene_id, ty, tx, y0, x0, h, w, source, cost): one row a tile, its arrays as bytes."""
    at = [F.floor(F.col(c) / tile).alias(f"t{c}") for c in "yx"]
    kind = px.schema["scene_id"].dataType.simpleString()

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        y, x = (rows.column(c).to_numpy().astype(np.int64) for c in "yx")
        y0, x0 = int(y.min()), int(x.min())
        h, w = int(y.max()) - y0 + 1, int(x.max()) - x0 + 1
        first = np.zeros((h, w), np.uint8)
        first[y - y0, x - x0] = rows.column(source).fill_null(False).to_numpy(zero_copy_only=False)
        grids = np.full((len(costs), h, w), np.nan)
        for i, c in enumerate(costs):
            grids[i, y - y0, x - x0] = rows.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
        values = [*(k.as_py() for k in key), y0, x0, h, w, first.tobytes(), grids.tobytes()]
        types = [rows.schema.field("scene_id").type, *[pa.int64()] * 6, pa.binary(), pa.binary()]
        return pa.table([pa.array([v], t) for v, t in zip(values, types)], names=[*PLACE, "y0", "x0", "h", "w", "source", "cost"])

    schema = f"scene_id {kind}, ty long, tx long, y0 long, x0 long, h long, w long, source binary, cost binary"
    wanted = px.select("scene_id", "y", "x", *at, source, *costs)
    return cut_lineage(wanted.groupBy(*PLACE).applyInArrow(pack, schema))


def _solver(n: int, tile: int, rim: bool):
    """Paths of packed tiles whose column ``halo`` lists pixels beside them: (y, x, path, cost) of all pixels, or of the rim's."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("y0", "x0", "h", "w", "source", "cost", "halo")}
                h, w = row["h"], row["w"]
                inside = (slice(1, h + 1), slice(1, w + 1))
                first = np.zeros((h + 2, w + 2), bool)
                first[inside] = np.frombuffer(row["source"], np.uint8).reshape(h, w)
                cost = np.full((n, h + 2, w + 2), np.nan)
                cost[(slice(None), *inside)] = np.frombuffer(row["cost"]).reshape(n, h, w)
                path = np.full((n, h + 2, w + 2), np.inf)
                path[:, first] = 0.0
                for pixel in row["halo"] or []:
                    y, x = pixel["y"] - row["y0"] + 1, pixel["x"] - row["x0"] + 1
                    # Rows and columns that the tile has no pixel in can lie between.
                    if 0 <= y < h + 2 and 0 <= x < w + 2:
                        path[:, y, x], cost[:, y, x] = pixel["path"], pixel["cost"]
                free = np.zeros((h + 2, w + 2), bool)
                free[inside] = ~first[inside]
                with np.errstate(invalid="ignore"):
                    path = np.stack([relax(p, c, free & ~np.isnan(c)) for p, c in zip(path, cost)])[(slice(None), *inside)]
                chosen = np.isfinite(path).all(axis=0)
                if rim:
                    y, x = np.arange(h) + row["y0"], np.arange(w) + row["x0"]
                    edge = [np.isin(a % tile, (0, tile - 1)) for a in (y, x)]
                    chosen &= edge[0][:, None] | edge[1][None, :]
                y, x = np.nonzero(chosen)
                inner = cost[(slice(None), *inside)]
                lists = [pa.array(list(a[:, y, x].T), pa.list_(pa.float64())) for a in (path, inner)]
                scene = pa.array([batch.column("scene_id")[i].as_py()] * len(y), batch.schema.field("scene_id").type)
                places = [pa.array(v, pa.int64()) for v in (y + row["y0"], x + row["x0"])]
                yield pa.RecordBatch.from_arrays([scene, *places, *lists], names=["scene_id", "y", "x", "path", "cost"])

    return solve


def _beside(rims: DataFrame, tile: int, changed: Column) -> DataFrame:
    """(scene_id, ty, tx, halo, changed): the rim pixels beside each tile, and whether one of them changed."""

    def touched(axis: str) -> Column:
        return F.explode(F.array_distinct(F.array(*[F.floor((F.col(axis) + s) / tile) for s in (-1, 0, 1)])))

    spread = rims.withColumn("__changed", changed).select("*", touched("y").alias("ty")).select("*", touched("x").alias("tx"))
    others = spread.where((F.col("ty") != F.floor(F.col("y") / tile)) | (F.col("tx") != F.floor(F.col("x") / tile)))
    return others.groupBy(*PLACE).agg(F.collect_list(F.struct("y", "x", "path", "cost")).alias("halo"), F.max("__changed").alias("__changed"))


def cumulative_costs(px: DataFrame, costs: list[str], source: str, tile: int = TILE) -> DataFrame:
    """(scene_id, y, x, costs): for each pixel and cost column the cheapest path's cost from a pixel where ``source`` holds.

    Sources have 0; a step between two of the eight neighbours costs the mean of both pixels' costs times
    its length. Pixels with a NULL cost are not crossed; those that no path reaches are left out.
    """
    kind = px.schema["scene_id"].dataType.simpleString()
    schema = f"scene_id {kind}, y long, x long, path array<double>, cost array<double>"
    tiles = _packed(px, costs, source, tile)
    alone = tiles.withColumn("halo", F.lit(None).cast("array<struct<y: bigint, x: bigint, path: array<double>, cost: array<double>>>"))
    rims = cut_lineage(alone.mapInArrow(_solver(len(costs), tile, True), schema).withColumn("__new", F.lit(True)))
    while True:
        halos = _beside(rims, tile, F.col("__new"))
        active = tiles.join(halos.where("__changed").drop("__changed"), PLACE)
        solved = active.mapInArrow(_solver(len(costs), tile, True), schema)
        old = rims.drop("__new").withColumnRenamed("path", "__old").withColumnRenamed("cost", "__cost")
        both = old.join(solved, ["scene_id", "y", "x"], "full")
        better = F.coalesce(F.exists(F.zip_with("path", "__old", lambda a, b: a < b), lambda less: less), F.col("path").isNotNull())
        merged = both.select(
            "scene_id", "y", "x", F.coalesce("path", "__old").alias("path"), F.coalesce("cost", "__cost").alias("cost"), better.alias("__new")
        )
        rims = cut_lineage(merged)
        if rims.where("__new").isEmpty():
            break
    halos = _beside(rims, tile, F.lit(True)).drop("__changed")
    solved = tiles.join(halos, PLACE, "left").mapInArrow(_solver(len(costs), tile, False), schema)
    types = dict(px.dtypes)
    places = [F.col(c).cast(types[c]) for c in "yx"]
    return solved.select("scene_id", *places, *[F.col("path")[i].alias(c) for i, c in enumerate(costs)])
