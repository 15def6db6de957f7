"""Per-pixel time series: regressions, harmonics, smoothing, outliers."""

from __future__ import annotations

from math import pi

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS_A_YEAR = 365.25


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def years(ts: str | Column) -> Column:
    """Fractional years of 365.25 days since 1970."""
    return micros(ts) / F.lit(86_400_000_000.0) / F.lit(DAYS_A_YEAR)


def prep_inputs(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.withColumns({"constant": F.lit(1.0), "time": years("ts")}).select("pixel", "ts", "constant", "time", *keep)


def add_harmonics(df: DataFrame, n_cycles: int = 2) -> DataFrame:
    return df.withColumns({f"{n}_{k}": f(2 * pi * k * F.col("time")) for k in range(1, n_cycles + 1) for n, f in (("cos", F.cos), ("sin", F.sin))})


def linear_trend(df: DataFrame, by: list[str], y: str) -> DataFrame:
    """(by, constant, time, n, mean_x, residual_x, residual_y) of least squares of ``y`` on ``time``; residual_y is the root mean square of the residuals."""
    squares = F.regr_syy(y, "time") - F.coalesce(F.try_divide(F.pow(F.regr_sxy(y, "time"), F.lit(2)), F.regr_sxx(y, "time")), F.lit(0.0))
    got = df.where(F.col(y).isNotNull()).groupBy(*by).agg(
        F.regr_intercept(y, "time").alias("constant"),
        F.regr_slope(y, "time").alias("time"),
        F.count("*").alias("n"),
        F.avg("time").alias("mean_x"),
        F.regr_sxx(y, "time").alias("residual_x"),
        F.sqrt(F.greatest(squares, F.lit(0.0)) / F.count("*")).alias("residual_y"),
    )
    return got


def gram(df: DataFrame, by: list[str], predictors: list[str], y: str) -> DataFrame:
    """Sums of all products of predictors, and with ``y``: what any least squares needs, in one pass."""
    pairs = [F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(predictors) for j, b in enumerate(predictors) if i <= j]
    right = [F.sum(F.col(a) * F.col(y)).alias(f"h_{i}") for i, a in enumerate(predictors)]
    return df.where(F.col(y).isNotNull()).groupBy(*by).agg(*pairs, *right, F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n"))


def solve(sums: DataFrame, by: list[str], predictors: list[str], ridge: float = 0.0, output_err: bool = False) -> DataFrame:
    """(by, one coefficient for each predictor, n): the small solves, vectorised over Arrow batches.

    With ``output_err`` also mean_x and residual_x (of the second predictor, the first being constant) and residual_y, the
    root mean square of the residuals, all from the same sums.
    """
    errors = ["mean_x", "residual_x", "residual_y"] if output_err else []
    k = len(predictors)

    def solved(batches):
        import numpy as np

        for rows in batches:
            g, h = np.zeros((len(rows), k, k)), np.zeros((len(rows), k))
            for i in range(k):
                h[:, i] = rows[f"h_{i}"]
                for j in range(i, k):
                    g[:, i, j] = g[:, j, i] = rows[f"g_{i}_{j}"]
            g += ridge * np.eye(k)
            full = np.linalg.matrix_rank(g) == k if len(rows) else np.zeros(0, bool)
            out = rows[by + ["n"]].copy()
            b = np.full((len(rows), k), np.nan)
            if full.any():
                b[full] = np.linalg.solve(g[full], h[full][:, :, None])[:, :, 0]
            for i, name in enumerate(predictors):
                out[name] = b[:, i]
            if errors:
                n = rows["n"].to_numpy(float)
                out["mean_x"] = g[:, 0, 1] / n
                out["residual_x"] = g[:, 1, 1] - n * out["mean_x"] ** 2
                out["residual_y"] = np.sqrt(np.maximum(rows["yy"] - (b * h).sum(axis=1), 0) / n)
            yield out[by + predictors + ["n"] + errors]

    types = dict(sums.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in by] + [f"{p} double" for p in predictors] + ["n long"] + [f"{e} double" for e in errors])
    return sums.mapInPandas(solved, schema)


def harmonic_trend(df: DataFrame, by: list[str], y: str, n_cycles: int = 2, output_err: bool = False) -> DataFrame:
    names = ["constant", "time"] + [f"{n}_{k}" for k in range(1, n_cycles + 1) for n in ("cos", "sin")]
    return solve(gram(df, by, names, y), by, names, output_err=output_err)


def ridge_trend(df: DataFrame, by: list[str], y: str, penalty: float = 0.1) -> DataFrame:
    return solve(gram(df, by, ["constant", "time"], y), by, ["constant", "time"], penalty)


def sen_slope(df: DataFrame, by: list[str], y: str) -> DataFrame:
    """(by, time, constant): median of the slopes of all pairs of a pixel's dates, and of the offsets.

    The pairs are those of one pixel's series, which the method is defined on. They are never written
    out as rows: a task holds one series and a bounded number of its slopes at a time.
    """
    own = df.where(F.col(y).isNotNull() & F.col("time").isNotNull()).select(*by, F.col("time").alias("t"), F.col(y).alias("v"))

    def fit(series: pa.Table) -> pa.Table:
        import numpy as np

        t, v = (series.column(c).cast(pa.float64()).to_numpy() for c in ("t", "v"))
        slope = median_slope(t, v)
        found = [] if slope is None else [slope]
        out = {c: series.column(c).slice(0, len(found)) for c in by}
        return pa.table(out | {"time": pa.array(found, pa.float64()), "constant": pa.array([float(np.median(v - s * t)) for s in found], pa.float64())})

    types = dict(own.dtypes)
    return own.groupBy(*by).applyInArrow(fit, ", ".join([f"{c} {types[c]}" for c in by] + ["time double", "constant double"]))


def _median_of_all(t, v, rows: int = 64):
    """Median of all slopes of a series in the order of its dates."""
    import numpy as np

    slopes = np.empty(len(t) * (len(t) - 1) // 2)
    n = 0
    for i in range(0, len(t), rows):
        dt = t[None, i + 1 :] - t[i : i + rows, None]
        later = dt > 0
        found = (v[None, i + 1 :] - v[i : i + rows, None])[later] / dt[later]
        slopes[n : n + len(found)] = found
        n += len(found)
    if not n:
        return None
    middle = [(n - 1) // 2, n // 2]
    return float(np.partition(slopes[:n], middle)[middle].mean())


def median_slope(t, v, held: int = 1 << 20):
    """Median of ``(v_j - v_i) / (t_j - t_i)`` over all ``t_j > t_i``, or None if there are none.

    At most about ``held`` slopes are kept. Each pass takes values between the bounds as edges, and either
    finds the wanted rank at an edge or goes on strictly between two edges, so ties cannot stall it.
    Series of at most ``held`` pairs need one pass and no sorting.
    Dates and values that are not finite are left out.
    """
    import numpy as np

    finite = np.isfinite(t) & np.isfinite(v)
    t, v = t[finite], v[finite]
    order = np.argsort(t, kind="stable")
    t, v = t[order], v[order]
    if len(t) * (len(t) - 1) // 2 <= held:
        return _median_of_all(t, v)
    rows = max(1, held // (4 * max(len(t), 1)))

    def slopes(low, high):
        for i in range(0, len(t), rows):
            dt = t[None, i:] - t[i : i + rows, None]
            s = (v[None, i:] - v[i : i + rows, None])[dt > 0] / dt[dt > 0]
            yield s[(s > low) & (s < high)]

    def ranked(rank):
        low, high = -np.inf, np.inf
        while True:
            inside = sum(len(s) for s in slopes(low, high))
            if inside <= held:
                return np.sort(np.concatenate(list(slopes(low, high))))[rank]
            edges = np.unique(np.concatenate([s[:: -(-inside // held)] for s in slopes(low, high)]))
            edges = edges[np.unique(np.linspace(0, len(edges) - 1, 1024).astype(int))]
            upto, below = (
                np.cumsum(sum(np.bincount(np.searchsorted(edges, s, side), minlength=len(edges) + 1) for s in slopes(low, high)))
                for side in ("left", "right")
            )
            at = int(np.searchsorted(upto, rank, "right"))
            if at < len(edges) and below[at] <= rank:
                return edges[at]
            low, high = edges[at - 1] if at else low, edges[at] if at < len(edges) else high
            rank -= upto[at - 1] if at else 0

    n = sum(len(s) for s in slopes(-np.inf, np.inf))
    return float((ranked((n - 1) // 2) + ranked(n // 2)) / 2) if n else None


def predict_harmonics(df: DataFrame, coefficients: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    named = coefficients.select(*by, *[F.col(n).alias(f"__{n}") for n in names])
    value = sum((F.col(n) * F.col(f"__{n}") for n in names), F.lit(0.0))
    return df.join(named, by).withColumn("predicted", value).drop(*[f"__{n}" for n in names])


def dummy_days(spark, start: str, end: str) -> DataFrame:
    """One row for each day from ``start`` to ``end``, both included, with constant and time."""
    if not start or not end:
        raise ValueError("start and end are needed")
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))
    return days.withColumns({"constant": F.lit(1.0), "time": years("day")})


def temporal_smoothing(df: DataFrame, by: list[str], y: str, out: str, days: int = 10, reducer=F.avg) -> DataFrame:
    """Reduces the observations within the half-open window of ``days`` around each one."""
    day = 86_400_000_000
    window = Window.partitionBy(*by).orderBy(micros("ts")).rangeBetween((-days // 2) * day, (days // 2) * day - 1)
    return df.withColumn(out, reducer(y).over(window))


def iqr_filter(df: DataFrame, by: list[str], bands: list[str]) -> DataFrame:
    """Masks values outside 1.5 interquartile ranges of their pixel's quartiles."""
    window = Window.partitionBy(*by)
    for band in bands:
        q = [F.percentile(band, F.lit(p)).over(window) for p in (0.25, 0.75)]
        df = df.withColumns({"__lo": q[0], "__hi": q[1]})
        reach = 1.5 * (F.col("__hi") - F.col("__lo"))
        inside = (F.col(band) > F.col("__lo") - reach) & (F.col(band) < F.col("__hi") + reach)
        df = df.withColumn(band, F.when(inside, F.col(band))).drop("__lo", "__hi")
    return df


def anomalies(df: DataFrame, baseline: DataFrame, on: list[str], y: str, base: str, out: str) -> DataFrame:
    return df.join(baseline.select(*on, F.col(base).alias("__base")), on).withColumn(out, F.col(y) - F.col("__base")).drop("__base")


def yearly_anomalies(df: DataFrame, by: list[str], bands: list[str]) -> DataFrame:
    """Each band minus its mean, deviation, 5th and 95th percentile of the same pixel and year."""
    window = Window.partitionBy(*by, F.year("ts"))
    stats = {"mean": F.avg, "stdDev": F.stddev_pop, "p5": lambda b: F.percentile(b, F.lit(0.05)), "p95": lambda b: F.percentile(b, F.lit(0.95))}
    return df.withColumns({f"{b}_{n}": F.col(b) - f(b).over(window) for b in bands for n, f in stats.items()})


def robust_trend(df: DataFrame, by: list[str], y: str, rounds: int = 5, reach: float = 2.795) -> DataFrame:
    """(by, constant, time, n): least squares of ``y`` on ``time``, refitted without outliers each round.

    An outlier's residual is over ``reach`` times the median absolute residual / 0.6745 (Talwar's weights).
    All rounds are windows over the same keys, so the rows are shuffled once.
    """
    own = Window.partitionBy(*by)
    d = df.where(F.col(y).isNotNull() & F.col("time").isNotNull()).select(*by, "time", F.col(y).alias("__y")).withColumn("__in", F.lit(True))
    for _ in range(rounds):
        used = F.when(F.col("__in"), F.col("__y"))
        d = d.withColumns({"__a": F.regr_intercept(used, "time").over(own), "__b": F.regr_slope(used, "time").over(own)})
        d = d.withColumn("__r", F.abs(F.col("__y") - F.col("__a") - F.col("__b") * F.col("time")))
        spread = F.percentile("__r", F.lit(0.5)).over(own) / 0.6745
        d = d.withColumn("__s", spread).withColumn("__in", F.coalesce(F.col("__r") <= reach * F.col("__s"), F.lit(True)))
    used = F.when(F.col("__in"), F.col("__y"))
    return d.groupBy(*by).agg(
        F.regr_intercept(used, "time").alias("constant"), F.regr_slope(used, "time").alias("time"), F.count(used).alias("n")
    )
