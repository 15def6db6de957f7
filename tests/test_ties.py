"""Comparisons that sums of doubles must not decide by their last bit."""

from floodspark.operators import threshold


def test_a_pixel_that_equals_its_threshold_is_not_below(spark):
    """The mean of 0.0001, 0.0036 and 0.0071 is 0.0036, and 0.0036000000000000003 in doubles."""
    rows = [(0, 0, x, v) for x, v in enumerate((0.0001, 0.0036, 0.0071, 5.0, 5.0, 5.0))]
    px = spark.createDataFrame(rows, "scene_id long, y int, x int, v double")
    got = {r.x: r.water for r in threshold.otsu_extent(px, "v").collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
