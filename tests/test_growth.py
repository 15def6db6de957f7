"""Results that once differed from the SQL, and steps that once grew faster than their input."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from floodspark.operators import floods, threshold, timeseries
from floodspark.operators.tiles import tiled
from floodspark.sources import datasets


def test_join_takes_the_latest_valid_scene_of_many(spark):
    """Every scene matches every other one; no row is made for a pair of scenes."""
    day = "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, {}, 0)"
    left = spark.range(300).selectExpr("id AS scene_id", "0 AS y", "0 AS x", f"{day.format('int(id % 60)')} AS ts", "1.0D AS nir")
    right = spark.range(300).selectExpr("id AS scene_id", "0 AS y", "0 AS x", f"{day.format('int(id % 50)')} AS ts", "CASE WHEN id % 50 < 40 THEN double(id) END AS vv")
    got = datasets.Dataset(left).join(datasets.Dataset(right)).pixels
    assert got.count() == 300 and got.where("vv = 289").count() == 300
    assert got.columns == ["scene_id", "y", "x", "ts", "nir", "vv"]
    assert "other_id" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_join_counts_both_ends_of_the_interval(spark):
    at = "timestamp_ntz '2024-01-{}'"
    left = spark.sql(f"SELECT 1L AS scene_id, 0 AS y, 0 AS x, {at.format('10 12:00:00')} AS ts, 1.0D AS nir")
    for time, found in (("09 11:59:59", None), ("09 12:00:00", 7.0), ("11 12:00:00", 7.0), ("11 12:00:01", None)):
        right = spark.sql(f"SELECT 5L AS scene_id, 0 AS y, 0 AS x, {at.format(time)} AS ts, 7.0D AS vv")
        rows = datasets.Dataset(left).join(datasets.Dataset(right)).pixels.collect()
        assert [r.vv for r in rows] == ([] if found is None else [found])
    gone = right.selectExpr("scene_id", "y", "x", f"{at.format('10 00:00:00')} AS ts", "CAST(NULL AS double) AS vv")
    assert [r.vv for r in datasets.Dataset(left).join(datasets.Dataset(gone)).pixels.collect()] == [None]


def test_log_amplitude_ratio_has_the_bits_of_the_sql(spark):
    got = spark.range(5000).selectExpr("id", "(id * 37 % 2003) / 100.0D - 30 AS a", "-20 - (id % 49) * 0.013D AS b")
    got = got.withColumn("r", floods.log_amplitude_ratio(F.col("a"), F.col("b")))
    want = duckdb.sql("""SELECT id, log10(sqrt(pow(10.0::double, a / 10)) / sqrt(pow(10.0::double, b / 10))) FROM (
        SELECT id, (id * 37 % 2003) / 100.0::double - 30 AS a, -20 - (id % 49) * 0.013::double AS b FROM range(5000) t(id))""")
    assert {r.id: r.r for r in got.collect()} == dict(want.fetchall())
    edge = spark.createDataFrame([(None, 1.0), (1.0, None), (9000.0, 0.0), (0.0, -9000.0), (-9000.0, 0.0)], "a double, b double")
    assert [r[0] for r in edge.select(floods.log_amplitude_ratio(F.col("a"), F.col("b"))).collect()] == [None, None, float("inf"), None, None]


def test_bucket_means_do_not_depend_on_the_order_of_rows(spark):
    values = [(-21.0 - (k * 37 % 101) / 1000.0) for k in range(400)]
    rows = [(k // 50, k // 10, k % 10, v) for k, v in enumerate(values)]
    sums = {}
    for scene, _, _, v in rows:
        n, s = sums.get((scene, v // 0.25), (0, 0.0))
        sums[scene, v // 0.25] = n + 1, s + v
    for parts in (1, 7):
        px = spark.createDataFrame(rows[::-1], "scene_id long, y int, x int, v double").repartition(parts)
        got = {(r.scene_id, float(r.bucket)): (r.n, r.mean) for r in threshold.histogram(px, "v", 0.25, ["scene_id"], ordered=True).collect()}
        assert got == {k: (n, s / n) for k, (n, s) in sums.items()}


def test_a_series_of_few_pairs_needs_no_sorting(monkeypatch):
    rng = np.random.default_rng(2)
    t, v = rng.integers(0, 300, 600).astype(float), rng.normal(size=600)
    a, b = np.triu_indices(600, 1)
    dt, dv = t[b] - t[a], v[b] - v[a]
    wanted = np.median(dv[dt != 0] / dt[dt != 0])
    monkeypatch.setattr(np, "sort", None)
    assert timeseries.median_slope(t, v) == pytest.approx(wanted, abs=1e-12)


def test_tiles_beyond_a_scene_get_no_pixel(spark):
    px = spark.range(625).selectExpr("0L AS scene_id", "int(id / 25) AS y", "int(id % 25) AS x", "1.0D AS v", "0 AS y0", "24 AS y1", "0 AS x0", "24 AS x1")
    seen = spark.sparkContext.accumulator(0)

    def work(part):
        seen.add(1)
        return {"out": part["v"]}

    for tile, tiles in ((128, 1), (20, 4)):
        before = seen.value
        got = tiled(px, ["v"], 40, work, "out double", tile, {"y": ("y0", "y1"), "x": ("x0", "x1")})
        assert got.selectExpr("count(*)", "sum(out)").first() == (625, 625.0) and seen.value - before == tiles
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "greatest" in plan and "least" in plan
