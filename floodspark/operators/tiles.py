"""Tiles with a halo: windows of any shape over pixel DataFrames, each pixel sent once to every tile that it touches.

A scene is cut into squares of ``tile`` pixels; a tile's task gets its own pixels and those within ``halo``
of them, as arrays of one Arrow batch, and returns its own pixels' rows with new columns. A pixel far
from a border goes to one tile only, so the shuffle grows with the halo's share of a tile, (1 + 2 halo / tile)^2,
and not with the window's area; chains of windows need one shuffle if the halo holds all of them. A task
holds one tile, whatever the scene's size. Absent pixels and masked ones (NULL) are NaN in the arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TILE = 128


@dataclass
class Tile:
    """Arrays over the rectangle that the pixels of a tile and its halo span; ``y0`` and ``x0`` are its first row and column.

    ``present`` marks where there is a pixel, ``own`` where there is one of the tile itself.
    """

    bands: dict[str, np.ndarray]
    present: np.ndarray
    own: np.ndarray
    y0: int
    x0: int

    def __getitem__(self, band: str) -> np.ndarray:
        return self.bands[band]


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def tiled(
    px: DataFrame,
    bands: list[str],
    halo: int,
    work: Callable[[Tile], dict[str, np.ndarray]],
    added: str,
    tile: int = TILE,
    extent: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """``px`` with the columns ``added`` (a schema), which ``work`` computes from arrays of ``bands``; NaN becomes NULL.

    ``extent`` names the columns of each scene's least and greatest ``y`` and ``x``, where they are known: then no pixel goes
    to a tile beyond them. Columns of ``px`` that ``added`` names are replaced. Rows that repeat a pixel are all kept, and one of them counts.
    """
    new = StructType.fromDDL(added)
    kept = [c for c in px.columns if c not in new.names]
    schema = StructType([px.schema[c] for c in kept] + new.fields)
    types = {f.name: pa.int32() if f.dataType.typeName() == "integer" else pa.float64() for f in new.fields}

    def touched(axis: str):
        ends = [F.floor((F.col(axis) + s * halo) / tile) for s in (-1, 1)]
        if extent is not None:
            ends = [keep(end, F.floor(F.col(c) / tile)) for keep, end, c in zip((F.greatest, F.least), ends, extent[axis])]
        return F.explode(F.sequence(*ends))

    spread = px.select("*", touched("y").alias("__ty")).select("*", touched("x").alias("__tx"))

    def worked(key: tuple, rows: pa.Table) -> pa.Table:
        _, ty, tx = (k.as_py() for k in key)
        y, x = (rows.column(c).to_numpy().astype(np.int64) for c in "yx")
        own = (y // tile == ty) & (x // tile == tx)
        if not own.any():
            return pa.table({f: rows.column(f).slice(0, 0) for f in kept} | {n: pa.array([], t) for n, t in types.items()})
        at = y - y.min(), x - x.min()
        shape = int(at[0].max()) + 1, int(at[1].max()) + 1
        present, mine = np.zeros(shape, bool), np.zeros(shape, bool)
        present[at] = True
        mine[at] = own
        grids = {}
        for band in bands:
            grids[band] = np.full(shape, np.nan)
            grids[band][at] = _numbers(rows.column(band))
        with np.errstate(all="ignore"):
            made = work(Tile(grids, present, mine, int(y.min()), int(x.min())))
        out = {c: rows.column(c).filter(pa.array(own)) for c in kept}
        for name, kind in types.items():
            values = made[name][at][own]
            blank = np.isnan(values) if values.dtype.kind == "f" else np.zeros(len(values), bool)
            whole = np.where(blank, 0, values).astype(np.int32) if kind == pa.int32() else values.astype(float)
            out[name] = pa.array(whole, kind, mask=blank)
        return pa.table(out)

    return spread.groupBy("scene_id", "__ty", "__tx").applyInArrow(worked, schema)


def shifts(a: np.ndarray, offsets: list[tuple[int, int]], fill: float = np.nan) -> Iterator[np.ndarray]:
    """For each offset (dy, dx) the array of the values that far away, ``fill`` beyond the rectangle."""
    r = max(max(abs(dy), abs(dx)) for dy, dx in offsets)
    wide = np.pad(a, r, constant_values=fill)
    h, w = a.shape
    for dy, dx in offsets:
        yield wide[r + dy : r + dy + h, r + dx : r + dx + w]


def window_extreme(a: np.ndarray, r: int, best=np.fmin) -> np.ndarray:
    """Least (or, with ``np.fmax``, greatest) value of the (2r + 1)-square windows; NaN where there is none."""
    for axis in (0, 1):
        steps = [(0, d) if axis else (d, 0) for d in range(-r, r + 1)]
        out = a
        for shifted in shifts(a, steps):
            out = best(out, shifted)
        a = out
    return a


def box_sum(a: np.ndarray, low: int, high: int | None = None) -> np.ndarray:
    """Sums over windows of offsets ``low`` to ``high`` on both axes, by default -low to low; beyond the rectangle is 0."""
    low, high = (-low, low) if high is None else (low, high)
    for axis in (1, 0):
        steps = [(0, d) if axis else (d, 0) for d in range(low, high + 1)]
        out = np.zeros_like(a)
        for shifted in shifts(a, steps, 0.0):
            out = out + shifted
        a = out
    return a


def correlate(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sums of the window's values by the kernel's weights; NaN and what lies beyond the rectangle count as 0."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    wide = np.pad(np.nan_to_num(a, nan=0.0), ((ry, ry), (rx, rx)))
    out = np.zeros(a.shape)
    for dy in range(kernel.shape[0]):
        lines = np.lib.stride_tricks.sliding_window_view(wide[dy : dy + a.shape[0]], kernel.shape[1], axis=1)
        out += np.einsum("ijk,k->ij", lines, kernel[dy])
    return out


def weighted_mean(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Mean of the window's values by the kernel's weights; only those that are there count, NaN without any."""
    return correlate(a, kernel) / _positive(correlate((~np.isnan(a)).astype(float), kernel))


def _positive(a: np.ndarray) -> np.ndarray:
    return np.where(a > 0, a, np.nan)


def distance2(sources: np.ndarray, r: int) -> np.ndarray:
    """Squared distance to the nearest source within ``r`` rows and columns, infinite beyond: columns first, then rows."""
    steps = range(-r, r + 1)
    d = np.where(sources, 0.0, np.inf)
    down = np.min([s + dy * dy for dy, s in zip(steps, shifts(d, [(dy, 0) for dy in steps], np.inf))], axis=0)
    return np.min([s + dx * dx for dx, s in zip(steps, shifts(down, [(0, dx) for dx in steps], np.inf))], axis=0)


_RING = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def gradients(v: np.ndarray, cell: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Slopes along x and y by Horn's weights of the 3 x 3 window; a missing neighbour takes the centre's value."""
    z = {o: np.where(np.isnan(a), v, a) for o, a in zip(_RING, shifts(v, _RING))}
    gx = (z[-1, 1] + 2 * z[0, 1] + z[1, 1]) - (z[-1, -1] + 2 * z[0, -1] + z[1, -1])
    gy = (z[1, -1] + 2 * z[1, 0] + z[1, 1]) - (z[-1, -1] + 2 * z[-1, 0] + z[-1, 1])
    return gx / (8 * cell), gy / (8 * cell)
