"""The search for nearest neighbours: its whole radius, and ties of its ratios."""

from floodspark.operators import floods
from floodspark.plans import catalogue, filter_queries  # noqa: F401


def test_the_query_searches_as_far_as_the_operator(spark):
    got, wide = (catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").collect() for name in ("dnns", "dnns_wide"))
    assert sorted(got) == sorted(wide) and len(got) > 500


def test_the_order_of_sums_decides_no_tie(spark):
    """A pixel whose ratio equals the limit is no land; (0.1 + 0.2) + 0.3 and (0.3 + 0.2) + 0.1 have different last bits."""
    line = [(0.5, 0.1, 0.9, 0.01), (0.5, 0.2, 0.9, 0.01), (0.5, 0.3, 0.9, 0.01), (0.5, 0.3, 0.6, 0.5), (0.1, 0.1, 0.5, 0.5)]
    rows = [(scene, 0, x, *v) for scene, pixels in enumerate((line, line[::-1])) for x, v in enumerate(pixels)]
    px = spark.createDataFrame(rows, "scene_id long, y int, x int, green double, red double, nir double, swir1 double")
    got = {(r.scene_id, r.x): round(r.fraction, 6) for r in floods.dnns(px).collect()}
    assert (got[0, 3], got[1, 1]) == (0.541667, 0.541667)
