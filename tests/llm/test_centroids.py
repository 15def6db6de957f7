"""Exact k-means against a plain version in whole numbers."""

import math
import random
from hashlib import sha256

import numpy as np
import pytest

from floodspark.llm import centroids


def brute(rows, k, rounds, size, scale=64, seed=1):
    kept = [
        (i, [math.floor(v * scale) if abs(v) < 1e300 else int(v) * scale for v in map(float, x)])
        for i, x in rows
        if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)
    ]
    named = sorted((r for r in kept if r[0] is not None), key=lambda r: (sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [x for _, x in (named + sorted((r for r in kept if r[0] is None), key=lambda r: r[1]))[:k]]

    def nearest(x):
        d = [sum((a - b) ** 2 for a, b in zip(x, y)) for y in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [[] for _ in c]
        for _, x in kept:
            own[nearest(x)[0]].append(x)
        c = [[sum(v) // len(xs) for v in zip(*xs)] if xs else old for xs, old in zip(own, c)]
    return c, sorted((i if i is not None else -1, *nearest(x)) for i, x in kept)


def compared(spark, rows, k=4, rounds=3, size=3):
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    c, sums, out = centroids.cluster(df, k=k, rounds=rounds, size=size)
    want_c, want = brute(rows, k, rounds, size)
    assert c.tolist() == want_c
    got = sorted((r.id if r.id is not None else -1, r.cluster, r.distance) for r in out.collect())
    assert got == [(i, j, d if d <= centroids.LONG else None) for i, j, d in want]
    assert int(sums.inertia.sum() if len(c) else 0) == sum(d for _, _, d in want)
    return centroids.report(c, sums, out)


def test_random_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(rng.choice([-3, 0, 3]), 0.5) for _ in range(3)]) for i in range(300)]
    report = compared(spark, rows).collect()
    assert len(report) == 300 and len({r.inertia for r in report}) == 1


def test_ties_repeats_and_odd_vectors(spark):
    rows = [(i % 5, [float(i % 3), 0.0, -0.25]) for i in range(40)]
    rows += [(None, [1.0, 2.0, 3.0]), (50, None), (51, [1.0]), (52, [1.0, None, 2.0]), (53, [1.0, math.nan, 2.0]), (54, [math.inf, 0.0, 0.0])]
    compared(spark, rows)
    compared(spark, rows, k=100)


def test_magnitudes_beyond_2_to_the_53_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1.0, 2.0**40, -(2.0**70), 3e18, 0.1, 1e305, 1e-300]) * rng.random() for _ in range(3)]) for i in range(60)]
    compared(spark, rows)
    # Products of these are just above the bound of float64; rounding them would lose the difference of 1.
    near = [(i, [2.0**20 + i % 7 / 64, 2.0**20 - i % 5 / 64, 1.0]) for i in range(50)]
    compared(spark, near)


def test_products_are_guarded():
    x = np.array([[2.0**27 - 1, 1.0], [2.0**27, 0.0]])
    c = np.array([[-(2.0**26), 1.0], [0.0, 1.0]])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s)) for s in c] for r in x]
    assert centroids.distances(x, c).tolist() == want
    assert centroids.distances(np.array([[5.0, 1.0]]), np.array([[2.0, 0.0]])).dtype == float


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    c, sums, out = centroids.cluster(df)
    assert len(c) == 0 and centroids.report(c, sums, out).count() == 0


def test_plan_has_no_shuffle_of_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    _, _, out = centroids.cluster(df, rounds=1)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        centroids.cluster(df, k=10**7)
