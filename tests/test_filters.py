"""The directional filter and the patches against plain loops on a small scene."""

import numpy as np
from pyspark.sql import functions as F

from floodspark.operators import components, focal


def scene(spark, values):
    rows = [(0, y, x, float(v)) for y, line in enumerate(values) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "scene_id long, y int, x int, v double")


def test_refined_lee_in_the_middle_of_a_scene(spark):
    db = np.random.default_rng(3).normal(-15, 3, (13, 13))
    p = 10 ** (db / 10)
    got = {(r.y, r.x): r.out for r in focal.refined_lee(scene(spark, db), "v", "out").collect()}
    box = lambda f, y, x: f(p[y - 1 : y + 2, x - 1 : x + 2])
    for y in range(4, 9):
        for x in range(4, 9):
            at = [(y + dy, x + dx) for dy in (-2, 0, 2) for dx in (-2, 0, 2)]
            m = [box(np.mean, *a) for a in at]
            noise = np.mean(sorted(box(np.var, *a) / k**2 for a, k in zip(at, m))[:5])
            pairs = [(m[1], m[7]), (m[6], m[2]), (m[3], m[5]), (m[0], m[8])]
            k = int(np.argmax([abs(a - b) for a, b in pairs]))
            a, b = pairs[k]
            turns = (k + (0 if a - m[4] > m[4] - b else 4)) // 2
            kernel = np.tril(np.ones((7, 7))) if k % 2 else np.vstack([np.zeros((3, 7)), np.ones((4, 7))])
            side = p[y - 3 : y + 4, x - 3 : x + 4][np.rot90(kernel, -turns) == 1]
            mean, var = side.mean(), side.var()
            want = mean + (var - mean**2 * noise) / (noise + 1) / var * (p[y, x] - mean)
            assert want <= 0 or abs(got[y, x] - 10 * np.log10(want)) < 1e-6


def test_patches(spark):
    grid = [[1, 1, 0, 0, 1], [0, 0, 1, 0, 1], [0, 0, 0, 0, 0], [1, 0, 0, 0, 0]]
    got = components.patch_sizes(scene(spark, grid).withColumn("w", F.col("v").cast("int")), "w")
    size = {(r.y, r.x): r["size"] for r in got.collect()}
    assert [size[k] for k in ((0, 0), (1, 2), (1, 4), (3, 0), (2, 2))] == [3, 3, 2, 1, None]
