"""The median of slopes that is narrowed down in passes, against all pairs at once."""

import numpy as np
import pytest

from floodspark.operators.timeseries import median_slope


@pytest.mark.parametrize("held", [40, 300, 1 << 20])
@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("n", [2, 3, 10, 75, 200])
def test_median_slope(n, ties, held):
    rng = np.random.default_rng(n)
    t = rng.integers(0, 20, n).astype(float) if ties else rng.permutation(n * 3)[:n].astype(float)
    v = rng.integers(0, 3, n).astype(float) if ties else rng.normal(size=n)
    order = np.argsort(t, kind="stable")
    a, b = np.triu_indices(n, 1)
    dt, dv = (x[order][b] - x[order][a] for x in (t, v))
    slopes = dv[dt > 0] / dt[dt > 0]
    got = median_slope(t, v, held)
    assert got == pytest.approx(np.median(slopes), abs=1e-12) if len(slopes) else got is None


def test_no_pair_has_no_slope():
    assert median_slope(np.array([1.0]), np.array([2.0])) is None
    assert median_slope(np.array([1.0, 1.0]), np.array([2.0, 3.0])) is None
    assert median_slope(np.array([1.0, 2.0] * 50), np.zeros(100), 10) == 0.0
