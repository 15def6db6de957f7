"""Windows, edges and paths over tile borders and gaps, against plain loops."""

import heapq
from math import hypot, isnan, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodspark.operators import costs, edges, floods, focal, threshold, tiles


def scene(spark, values, scene_id=0, at=(0, 0)):
    rows = [(scene_id, y + at[0], x + at[1], None if isnan(v) else float(v)) for y, line in enumerate(values) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "scene_id long, y int, x int, v double").repartition(3)


def grid(df, column, shape):
    out = np.full(shape, nan)
    for r in df.collect():
        out[r.y, r.x] = nan if r[column] is None else r[column]
    return out


def test_box_stats_sees_beyond_absent_rows_and_over_borders(spark):
    v = np.random.default_rng(1).normal(size=(11, 13))
    v[4, 5] = nan
    px = scene(spark, v).where("NOT (y = 0 AND x = 1) AND y <> 7 AND NOT (y > 8 AND x < 4)")
    seen = {(r.y, r.x): r.v for r in px.collect()}

    def mean(tile):
        def work(t):
            n = tiles.box_sum((~np.isnan(t["v"])).astype(float), 1)
            return {"m": tiles.box_sum(np.nan_to_num(t["v"]), 1) / np.where(n > 0, n, nan), "n": n}

        return {(r.y, r.x): (r.m, r.n) for r in tiles.tiled(px, ["v"], 1, work, "m double, n int", tile).collect()}

    got = {(r.y, r.x): (r["mean"], r["count"]) for r in focal.box_stats(px, "v", 1).collect()}
    assert set(got) == set(seen)
    for (y, x), (m, n) in got.items():
        near = [seen.get((y + dy, x + dx)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        near = [a for a in near if a is not None]
        assert n == len(near) and (m is None if not near else abs(m - np.mean(near)) < 1e-12)
    for tile in (2, 4, 100):
        assert {k: v[1] for k, v in mean(tile).items()} == {k: v[1] for k, v in got.items()}


def test_repeated_pixels_and_negative_places(spark):
    px = scene(spark, np.ones((5, 5)), at=(-3, -2))
    twice = px.unionAll(px)
    got = focal.box_stats(twice, "v", 2).collect()
    assert len(got) == 50 and {r["mean"] for r in got} == {1.0} and max(r["count"] for r in got) == 25
    assert focal.box_stats(px.limit(0), "v", 1).count() == 0


def test_a_tile_gets_its_halo_only(spark):
    px = scene(spark, np.arange(400.0).reshape(20, 20))
    seen = []

    def work(t):
        return {"n": np.full(t.present.shape, t.present.sum())}

    seen = {r.n for r in tiles.tiled(px, ["v"], 2, work, "n int", 10).collect()}
    assert seen == {144}
    assert "Window" not in focal.box_stats(px, "v", 2)._jdf.queryExecution().executedPlan().toString()


def dijkstra(cost, source):
    h, w = cost.shape
    best, heap = np.full((h, w), np.inf), []
    for y, x in zip(*np.nonzero(source)):
        best[y, x] = 0
        heap.append((0.0, y, x))
    heapq.heapify(heap)
    while heap:
        d, y, x = heapq.heappop(heap)
        if d > best[y, x]:
            continue
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                a, b = y + dy, x + dx
                if (dy or dx) and 0 <= a < h and 0 <= b < w and not source[a, b] and not isnan(cost[a, b]):
                    e = d + (cost[y, x] + cost[a, b]) / 2 * hypot(dy, dx)
                    if e < best[a, b] - 1e-12:
                        best[a, b] = e
                        heapq.heappush(heap, (e, a, b))
    return best


@pytest.mark.parametrize("tile", [5, 64])
def test_paths_cross_tiles(spark, tile):
    rng = np.random.default_rng(tile)
    cost = rng.uniform(1, 9, (11, 12))
    # A winding channel: walls with one gap each, at alternating ends.
    for k, x in enumerate((3, 7)):
        cost[:, x] = nan
        cost[0 if k % 2 else 10, x] = 2.0
    source = np.zeros(cost.shape, bool)
    source[5, 0] = True
    rows = [(s, y, x, None if isnan(c) else float(c) * (s + 1), bool(source[y, x])) for s in (0, 1) for (y, x), c in np.ndenumerate(cost)]
    px = spark.createDataFrame(rows, "scene_id long, y int, x int, c double, dry boolean")
    got = costs.cumulative_costs(px, ["c"], "dry", tile)
    for s in (0, 1):
        want, mine = dijkstra(cost * (s + 1), source), grid(got.where(F.col("scene_id") == s), "c", cost.shape)
        assert np.allclose(np.where(np.isinf(want), nan, want), mine, equal_nan=True)


def test_depth_over_many_tiles_is_that_of_one(spark):
    rng = np.random.default_rng(3)
    wet = (rng.random((30, 30)) < 0.85).astype(float)
    wet[8:27, 5:28] = 1
    z = rng.uniform(0, 20, wet.shape)
    dem = spark.createDataFrame([(y, x, float(v)) for (y, x), v in np.ndenumerate(z)], "y int, x int, elevation double")
    px = scene(spark, wet)
    small, whole = (grid(floods.water_depth(px, "v", dem, tile=t), "depth", wet.shape) for t in (16, 64))
    assert np.allclose(small, whole, equal_nan=True) and (np.isnan(small) == (wet == 0)).all()
    near = grid(floods.water_depth(px, "v", dem, reach=60.0), "depth", wet.shape)
    assert np.isnan(near[17, 16]) and not np.isnan(whole[17, 16])


def test_the_outlier_test_lowers_a_spike(spark):
    wet = np.zeros((9, 9))
    wet[2:7, 2:7] = 1
    z = np.add.outer(np.arange(9.0), np.arange(9.0)) / 10
    z[4, 4] = -500 * -1
    dem = spark.createDataFrame([(y, x, float(v)) for (y, x), v in np.ndenumerate(z)], "y int, x int, elevation double")
    rough, even = (grid(floods.water_depth(scene(spark, wet), "v", dem, smooth=0, outlier_test=t), "depth", wet.shape) for t in (False, True))
    assert rough[4, 4] == 0 and even.shape == rough.shape and np.nanmax(np.abs(even)) < 5


def test_wide_windows_are_those_of_one_tile(spark):
    rng = np.random.default_rng(5)
    bands = {b: rng.uniform(0.1, 0.9, (26, 22)) for b in ("green", "red", "nir", "swir1")}
    rows = [(0, y, x, *(float(b[y, x]) for b in bands.values())) for y in range(26) for x in range(22)]
    px = spark.createDataFrame(rows, "scene_id long, y int, x int, green double, red double, nir double, swir1 double")
    small, whole = (grid(floods.dnns(px, 5, tile=t), "fraction", (26, 22)) for t in (6, 100))
    assert np.allclose(small, whole) and len(np.unique(whole.round(6))) > 50


@pytest.mark.parametrize("sigma,low", [(0.0, None), (1.0, None), (1.0, 0.02)])
def test_canny_against_loops(spark, sigma, low):
    rng = np.random.default_rng(11)
    v = (np.hypot(*np.mgrid[-12:12, -12:12]) < 7).astype(float) + rng.normal(0, 0.05, (24, 24))
    v[3, 3] = nan
    h, w = v.shape

    def at(a, y, x):
        return a[y, x] if 0 <= y < h and 0 <= x < w else nan

    smooth = v.copy()
    if sigma:
        for y, x in np.ndindex(h, w):
            near = [(at(v, y + dy, x + dx), np.exp(-(dy * dy + dx * dx) / 2 / sigma**2)) for dy in range(-3, 4) for dx in range(-3, 4)]
            near = [(a, k) for a, k in near if not isnan(a)]
            smooth[y, x] = nan if isnan(v[y, x]) else sum(a * k for a, k in near) / sum(k for _, k in near)
    size, turn = np.zeros((h, w)), np.zeros((h, w, 2), int)
    for y, x in np.ndindex(h, w):
        if isnan(smooth[y, x]):
            continue
        z = {(a, b): at(smooth, y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)}
        z = {k: smooth[y, x] if isnan(a) else a for k, a in z.items()}
        gx = sum(k * (z[a, 1] - z[a, -1]) for a, k in ((-1, 1), (0, 2), (1, 1))) / 8
        gy = sum(k * (z[1, b] - z[-1, b]) for b, k in ((-1, 1), (0, 2), (1, 1))) / 8
        size[y, x] = hypot(gx, gy)
        degrees = np.degrees(np.arctan2(gy, gx)) % 180
        turn[y, x] = [(0, 1), (1, 1), (1, 0), (1, -1)][int(((degrees + 22.5) % 180) // 45)]
    top = np.zeros((h, w))
    for y, x in np.ndindex(h, w):
        dy, dx = turn[y, x]
        before, after = (np.nan_to_num(at(size, y + s * dy, x + s * dx)) for s in (-1, 1))
        top[y, x] = size[y, x] if size[y, x] > before + 1e-12 and size[y, x] >= after - 1e-12 and (dy or dx) else 0
    want = np.where(top > 0.1, top, 0.0)
    if low is not None:
        todo = [tuple(p) for p in np.argwhere(top > 0.1)]
        while todo:
            y, x = todo.pop()
            for a, b in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                if 0 <= a < h and 0 <= b < w and top[a, b] > low and want[a, b] == 0:
                    want[a, b] = top[a, b]
                    todo.append((a, b))
    want[np.isnan(v)] = nan
    got = grid(edges.canny(scene(spark, v), "v", threshold=0.1, sigma=sigma, low=low, tile=7), "edge", v.shape)
    assert np.allclose(got, want, equal_nan=True, atol=1e-9) and (want > 0).sum() > 20


def test_edge_otsu_finds_the_shore(spark):
    rng = np.random.default_rng(2)
    lake = np.hypot(*np.mgrid[-20:20, -20:20]) < 12
    v = np.where(lake, -22, -9) + rng.normal(0, 1, lake.shape)
    cut = edges.edge_otsu(scene(spark, v), "v", -15, length=30, buffer=2, tile=16).first().threshold
    assert -20 < cut < -11
    water = grid(threshold.threshold_extent(scene(spark, v), "v", edges.edge_otsu(scene(spark, v), "v", -15, length=30)), "water", v.shape)
    assert (water == lake).mean() > 0.97
    assert edges.edge_otsu(scene(spark, v * 0 - 30), "v", -15, no_data=-17.5).first().threshold == -17.5


def test_a_halved_grid_stays_within_bimodal_squares(spark):
    v = np.where(np.mgrid[0:32, 0:32][1] < 18, -22.0, -8.0) + np.random.default_rng(4).normal(0, 0.5, (32, 32))
    first = {(r.ty, r.tx) for r in threshold.bimodal_tiles(scene(spark, v), "v", -15, 16, 0.75, 1).collect()}
    third = {(r.ty, r.tx) for r in threshold.bimodal_tiles(scene(spark, v), "v", -15, 16, 0.75, 3).collect()}
    # Of the squares on the shore; one that is half and half has the greatest score.
    assert first == set() or third <= {(a * 4 + i, b * 4 + j) for a, b in first for i in range(4) for j in range(4)}
    low = {(r.ty, r.tx) for r in threshold.bimodal_tiles(scene(spark, v), "v", -15, 16, 0.6, 3).collect()}
    assert low == {(y, 4) for y in range(8)}
    with pytest.raises(ValueError):
        threshold.bimodal_tiles(scene(spark, v), "v", -15, 10, 0.2, 3)
