"""Ranks, matched distributions and buckets against sorted lists, with outliers and ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodspark.operators import fusion, ranks, threshold


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_quantiles_with_an_outlier_and_ties(spark, share):
    rng = random.Random(3)
    values = {g: [rng.choice([0.5, 1.5, rng.random()]) for _ in range(n)] + [1e300] for g, n in (("a", 400), ("b", 1), ("c", 77))}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("d", None)]
    got = {r.g: r.q for r in ranks.quantile(frame(spark, rows, "g string, v double"), ["g"], "v", share, "q").collect()}
    assert set(got) == set("abc")
    for g, vs in values.items():
        assert got[g] == pytest.approx(np.quantile(vs, share), rel=1e-12)


def test_running_counts_over_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), float(v), rng.randrange(1, 9)) for v in rng.sample(range(10_000), 900)]
    got = ranks.running_counts(frame(spark, rows, "g long, v double, n long"), ["g"], "v").collect()
    for r in got:
        assert r.upto == sum(n for g, v, n in rows if g == r.g and v <= r.v)


def test_one_outlier_changes_nothing_else(spark):
    rng = random.Random(7)
    pairs = [(rng.gauss(0, 1), rng.choice([2.0, 3.0, rng.uniform(0, 10)])) for _ in range(1500)]

    def matched(rows):
        return {r.p: r.dn for r in fusion.match_histograms(frame(spark, rows, "p double, t double"), "p", "t").collect()}

    def wanted(rows):
        p, t = (sorted(r[i] for r in rows if r[i] is not None) for i in (0, 1))
        return {v: t[-(-sum(x <= v for x in p) * len(t) // len(p)) - 1] for v in set(p)}

    plain, far = matched(pairs), matched([*pairs, (1e9, 5.0)])
    assert plain == wanted(pairs) and far == wanted([*pairs, (1e9, 5.0)])
    assert len(set(far.values())) > 400 and far[1e9] == max(t for _, t in pairs)
    uneven = [*pairs, (None, 4.0), (None, 4.5), (0.25, None), (0.25, None)]
    got = matched(uneven)
    assert got.pop(None) is None and got == wanted(uneven)
    assert set(matched([(1.0, None)]).values()) == {None} and matched([]) == {}


def test_shares_equal_the_window_function(spark):
    from pyspark.sql import Window

    rows = [(i % 3, None if i % 11 == 0 else float(i * 7 % 13)) for i in range(300)]
    df = frame(spark, rows, "g long, v double")
    want = df.withColumn("cdf", F.cume_dist().over(Window.partitionBy("g").orderBy("v")))
    got = ranks.cumulative_share(df, ["g"], "v")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_buckets_double_until_they_are_few(spark):
    rng = random.Random(9)
    rows = [(0, rng.gauss(-15, 4)) for _ in range(3000)] + [(1, 1e9), (1, 0.0), (1, 3.0), (2, 5.0), (2, None)]
    px = frame(spark, rows, "scene_id long, v double")
    got = threshold.adaptive_histogram(px, "v", ["scene_id"]).collect()
    for scene in (0, 1, 2):
        values = [v for s, v in rows if s == scene and v is not None]
        width = 2.0**-9
        while np.floor(max(values) / width) - np.floor(min(values) / width) >= 256:
            width *= 2
        own = {r.bucket: r for r in got if r.scene_id == scene}
        assert {r.width for r in own.values()} == {width}
        for bucket in own:
            inside = [v for v in values if np.floor(v / width) == bucket]
            assert own[bucket].n == len(inside) and own[bucket]["mean"] == pytest.approx(np.mean(inside))
    again = threshold.adaptive_histogram(px.repartition(1), "v", ["scene_id"]).select("scene_id", "bucket", "n", "width").collect()
    assert sorted(again) == sorted((r.scene_id, r.bucket, r.n, r.width) for r in got)
