"""Operators that no longer hold a whole scene in one task, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodspark.operators import components, floods, focal, ranks, workflows
from floodspark.sources import datasets


def grid(spark, values, scene=0):
    rows = [(scene, y, x, None if v is None else float(v)) for y, line in enumerate(values) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "scene_id long, y int, x int, v double")


@pytest.mark.parametrize("tile", [3, 256])
def test_patches_do_not_depend_on_tiles(spark, tile):
    rng = random.Random(4)
    on = {(y, x) for y in range(14) for x in range(14) if rng.random() < 0.42}
    px = grid(spark, [[(y, x) in on for x in range(14)] for y in range(14)]).union(grid(spark, [[1, 0, 1]], scene=5))
    left, wanted = set(on), {}
    for start in sorted(on):
        if start in left:
            todo = [start]
            left.discard(start)
            while todo:
                y, x = todo.pop()
                wanted[y, x] = start
                beside = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= beside
                todo += beside
    got = {(r["scene_id"], r["y"], r["x"]): r["label"] for r in components.patches(px, "v", tile).collect()}
    assert got == {(0, *k): (y << 32) + x for k, (y, x) in wanted.items()} | {(5, 0, 0): 0, (5, 0, 2): 2}


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    groups = {1: rng.normal(size=1000), 2: np.array([7.0]), 3: np.repeat([1.0, 2.0], [50, 51]), 4: np.exp(rng.normal(0, 5, 777))}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [(1, None), (9, None)]
    px = spark.createDataFrame(rows, "scene_id int, v double")
    for share in (0.0, 0.5, 0.9, 0.99, 1.0):
        got = {r["scene_id"]: r["q"] for r in ranks.quantile(px, ["scene_id"], "v", share, "q").collect()}
        assert got == pytest.approx({g: np.quantile(v, share) for g, v in groups.items()})


def test_constant_windows_have_no_variance(spark):
    got = focal.box_stats(grid(spark, [[0.1] * 5 for _ in range(5)]), "v", 1).collect()
    assert {r["var"] for r in got} == {0.0} and {r["count"] for r in got} == {4, 6, 9}


def test_diffusion_does_not_cross_a_gap(spark):
    px = grid(spark, [[0.0, 10.0, 20.0]]).where("x <> 1")
    got = {r["x"]: r["out"] for r in focal.perona_malik(px, "v", "out", n_iters=3).collect()}
    assert got == pytest.approx({0: 0.0, 2: 20.0})


def test_depth_of_far_water_and_of_a_scene_without_land(spark):
    wide = grid(spark, [[0] + [1] * 12])
    dem = spark.createDataFrame([(0, x, 10.0 - x) for x in range(13)], "y int, x int, elevation double")
    got = {r["x"]: r["depth"] for r in floods.water_depth(wide, "v", dem, smooth=0).collect()}
    assert got == {x: float(x) for x in range(1, 13)}
    flooded = grid(spark, [[1] * 13])
    assert {r["depth"] for r in floods.water_depth(flooded, "v", dem).collect()} == {None}


def test_samples_of_strata(spark):
    px = spark.range(5000).selectExpr("id AS scene_id", "0 AS y", "0 AS x", "IF(id % 10 = 0, 1, IF(id = 7, 3, 2)) AS s")
    got = [r["s"] for r in workflows.stratified_sample(px, "s", 20, ["scene_id", "y", "x"]).collect()]
    assert (got.count(1), got.count(2), got.count(3)) == (20, 20, 1)


def test_collections_filter_select_clip_and_pipe(spark):
    px = grid(spark, [[1, 2], [3, 4]]).union(grid(spark, [[5, 6], [7, 8]], scene=1))
    px = px.selectExpr("scene_id", "y", "x", "make_timestamp_ntz(2024, 1, 1 + CAST(scene_id AS INT), 0, 0, 0) AS ts", "v", "v * 2 AS w")
    data = datasets.Dataset(px)
    late = data.filter(F.col("scene_id") == 1)
    assert late.n_images() == 1 and data.n_images() == 2
    assert data.select("v").bands == ["v"] and data.clip((0, 0, 1, 1)).pixels.count() == 2
    doubled = data.pipe([lambda p: p.withColumn("v", p["v"] * 2), (lambda p, k: p.withColumn("v", p["v"] + k), {"k": 1})])
    assert sorted(r["v"] for r in doubled.pixels.collect()) == [3.0, 5.0, 7.0, 9.0, 11.0, 13.0, 15.0, 17.0]
    names = {r["name"] for r in datasets.with_export_names(px, "map", "v1").select("name").collect()}
    assert names == {"map_20240101000000_v1", "map_20240102000000_v1"}


def test_collection_knows_its_extent_and_days(spark):
    px = grid(spark, [[1, 2, 3], [3, 4, 5]]).selectExpr("scene_id", "y + 4 AS y", "x", "make_timestamp_ntz(2024, 2, 28 + y, 5, 0, 0) AS ts", "v")
    data = datasets.Dataset.from_collection(px)
    assert (data.region, data.start, data.end) == ((4, 0, 6, 3), "2024-02-28", "2024-03-01")
    assert datasets.Dataset.from_collection(px.limit(0)).region is None
    assert datasets.Dataset.load(px, data.region, data.start, data.end).pixels.count() == 6


def test_mosaic_of_exported_tiles(spark, tmp_path):
    rows = [("t1", 0, 0, 1.0, None), ("t2", 0, 0, 2.0, 5.0), ("t2", 0, 1, 3.0, 6.0)]
    tiles = spark.createDataFrame(rows, "tile string, y int, x int, a double, b double")
    with pytest.raises(ValueError, match="2 of 3"):
        datasets.mosaic_exports(tiles, str(tmp_path / "out"), 3)
    got = datasets.mosaic_exports(tiles, str(tmp_path / "out"), 2)
    assert sorted(map(tuple, got.select("y", "x", "a", "b").collect())) == [(0, 0, 1.0, 5.0), (0, 1, 3.0, 6.0)]
