"""Models, components, clusters and fits against known answers; rows of the queries that have no SQL."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from floodspark.fixtures import view
from floodspark.operators import scaling, segments, timeseries, workflows
from floodspark.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_models_fit_and_predict_on_all_scenes(spark):
    for name in ("random_forest", "gradient_boosting"):
        rows = catalogue.QUERIES[name](spark, SF).collect()
        px = view(spark, SF, "opt_px")
        assert len(rows) == px.count()
        nir = {(r.scene_id, r.y, r.x): r.nir for r in px.collect()}
        error = np.mean([(r.prediction - nir[r.scene_id, r.y, r.x]) ** 2 for r in rows])
        assert error < np.var(list(nir.values())) * 1.2 and len({r.prediction for r in rows}) > 5


def points(spark, x):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"f{i} double" for i in range(x.shape[1]))).repartition(5)


def test_components_by_svd_are_those_of_the_covariance(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + 1000
    df, names = points(spark, x), ["f0", "f1", "f2", "f3"]
    svd, eigen = scaling.pca(df, names), scaling.pca(df, names, method="eigendecomp")
    for a, b in zip(svd, eigen):
        assert np.allclose(a, b, rtol=1e-6, atol=1e-8)
    scores = scaling.apply_pca(df, names, *svd).toPandas()[[f"pc_{i}" for i in range(4)]].to_numpy()
    assert np.allclose(np.cov(scores.T, bias=True), np.eye(4), atol=1e-8)
    assert all(max(v, key=abs) > 0 for v in svd[1])
    with pytest.raises(ValueError):
        scaling.pca(df, names, method="other")
    with pytest.raises(ValueError):
        scaling.pca(df.limit(0), names)


def test_svd_keeps_small_differences_that_covariances_lose(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=300)
    x = np.stack([a, a + 1e-9 * rng.normal(size=300)], axis=1)
    want = np.linalg.svd(x - x.mean(axis=0))[1] ** 2 / 300
    assert np.allclose(scaling.pca(points(spark, x), ["f0", "f1"])[2], want, rtol=1e-4)
    df = points(spark, np.ones((5, 2)))
    centre, components, values = scaling.pca(df, ["f0", "f1"])
    assert values == [0, 0] and {r.pc_0 for r in scaling.apply_pca(df, ["f0", "f1"], centre, components, values).collect()} == {None}


@pytest.mark.parametrize("planted", [3, 5, 6])
def test_clusters_are_split_until_it_does_not_pay(spark, planted):
    rng = np.random.default_rng(planted)
    centres = np.stack([[10 * np.cos(a), 10 * np.sin(a)] for a in np.arange(planted) * 2 * np.pi / planted])
    x = np.concatenate([c + rng.normal(0, 0.4, (80, 2)) for c in centres])
    ready = VectorAssembler(inputCols=["f0", "f1"], outputCol="__x").transform(points(spark, x)).cache()
    model = segments.xmeans(ready, least=3, most=12)
    found = np.array(model.clusterCenters())
    assert len(found) == planted
    assert max(np.linalg.norm(found - c, axis=1).min() for c in centres) < 0.3
    assert {r["count"] for r in model.transform(ready).groupBy("__k").count().collect()} == {80}


def test_a_forest_finds_dark_water(spark):
    rng = np.random.default_rng(4)
    wet = rng.random(600) < 0.4
    vv = np.where(wet, -22, -9) + rng.normal(0, 1, 600)
    rows = [(0, i // 25, i % 25, float(v), float(v - 5 + e)) for i, (v, e) in enumerate(zip(vv, rng.normal(0, 1, 600)))]
    px = spark.createDataFrame(rows, "scene_id long, y int, x int, vv double, vh double")
    got = segments.semisupervised_extent(px, ["vv", "vh"], n=300, trees=10, sizes=(3, 5), cut=0.5)
    water = {(r.y, r.x): r.water for r in got.collect()}
    agree = np.mean([(water[i // 25, i % 25] == 1) <= wet[i] for i in range(600)])
    assert agree > 0.98 and sum(water.values()) > 0
    two = scaling.kmeans_extent(px, "vv", "vh", -15.0, n=50)
    assert np.mean([r.water == wet[r.y * 25 + r.x] for r in two.collect()]) > 0.98


def test_harmonic_fit_and_its_errors(spark):
    rng = np.random.default_rng(6)
    t = np.sort(rng.uniform(50, 54, 200))
    columns = [np.ones_like(t), t, np.cos(2 * np.pi * t), np.sin(2 * np.pi * t)]
    y = np.stack(columns, 1) @ [3.0, 0.5, 2.0, -1.0] + rng.normal(0, 0.3, 200)
    rows = [(1, *map(float, r), float(v)) for r, v in zip(np.stack(columns, 1), y)]
    df = spark.createDataFrame(rows, "pixel long, constant double, time double, cos_1 double, sin_1 double, v double")
    got = timeseries.harmonic_trend(df, ["pixel"], "v", 1, output_err=True).first()
    fit, squares, *_ = np.linalg.lstsq(np.stack(columns, 1), y, rcond=None)
    assert np.allclose([got.constant, got["time"], got.cos_1, got.sin_1], fit, atol=1e-6)
    want = (t.mean(), ((t - t.mean()) ** 2).sum(), (squares[0] / 200) ** 0.5)
    assert np.allclose([got.mean_x, got.residual_x, got.residual_y], want, rtol=1e-6)
    plain = timeseries.linear_trend(df, ["pixel"], "v").first()
    line = np.polyfit(t, y, 1)
    assert plain.residual_y == pytest.approx(np.sqrt(np.mean((y - np.polyval(line, t)) ** 2)))


def test_daily_water_counts_both_errors(spark):
    rows = [(y, x, (x - 5) / 10, 20, 53.0, 4.0, 0.05, 30, 53.0, 4.0, 0.3) for y in range(4) for x in range(11)]
    names = "y int, x int, fused_product double, n long, mean_x double, residual_x double, residual_y double, "
    product = spark.createDataFrame(rows, names + "long_n long, long_mean_x double, long_residual_x double, long_residual_y double")
    permanent = spark.createDataFrame([(0, 0, 1)], "y int, x int, permanent int")
    short = product.drop("long_n", "long_mean_x", "long_residual_x", "long_residual_y")
    both, one = ({(r.y, r.x): r for r in workflows.daily_surface_water(p, permanent, 0.0, "2023-01-01").collect()} for p in (product, short))
    assert both[0, 0].water == 1 and both[0, 0].flood == 0 and both[1, 10].flood == 1 and both[1, 2].water == 0
    assert one[1, 10].confidence == 100 and one[1, 1].confidence == 0
    assert 55 < both[1, 10].confidence < 100 and 0 < both[1, 1].confidence < 45


def test_a_map_without_edges_takes_the_given_threshold(spark):
    rows = [(y, x, 0.4, 20, 53.0, 4.0, 0.05) for y in range(5) for x in range(5)]
    product = spark.createDataFrame(rows, "y int, x int, fused_product double, n long, mean_x double, residual_x double, residual_y double")
    none = spark.createDataFrame([], "y int, x int, permanent int")
    for no_data, water in ((0.3, 1), (0.5, 0)):
        got = workflows.daily_surface_water(product, none, None, "2023-01-01", no_data=no_data).collect()
        assert {r.water for r in got} == {water} and len(got) == 25


#: What holds of the queries that SQL does not express: columns, rows against the view they come from, ranges.
RANGES = {
    "harmonic_trend": ("obs", "n", 1, None),
    "water_harmonics": (None, "n", 1, None),
    "pca_bands": ("opt_px", "pc_0", -9, 9),
    "daily_water_by_edges": (None, "confidence", 0, 100),
    "semisupervised_extent": ("sar_px", "water_proba", 0, 1),
    "kmeans_extent": ("sar_px", "water", 0, 1),
    "radar_water": ("sar_px", "water", 0, 1),
    "refined_lee": ("sar_px", "out", -60, 10),
}


@pytest.mark.parametrize("name", RANGES)
def test_rows_without_sql(spark, name):
    source, column, low, high = RANGES[name]
    got = catalogue.QUERIES[name](spark, SF).agg(F.count("*").alias("rows"), F.min(column).alias("low"), F.max(column).alias("high")).first()
    assert got.rows > 0 and got.low >= low and (high is None or got.high <= high)
    if source == "opt_px" or name in ("refined_lee", "semisupervised_extent"):
        assert got.rows == view(spark, SF, source).count()


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {*RANGES, "random_forest", "gradient_boosting"}
