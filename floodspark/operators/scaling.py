"""Feature scaling, encodings, components and models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def minmax_dict(df: DataFrame, features: list[str]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in features for n, f in (("min", F.min), ("max", F.max))])


def standard_dict(df: DataFrame, features: list[str]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in features for n, f in (("mean", F.avg), ("stdDev", F.stddev_pop))])


def scale(df: DataFrame, features: list[str], by: DataFrame, kind: str = "minmax") -> DataFrame:
    """Scales features by the one row of ``minmax_dict`` or ``standard_dict``; 0 range gives NULL."""
    if kind not in ("minmax", "standard"):
        raise ValueError("kind must be minmax or standard")
    joined = df.crossJoin(F.broadcast(by.limit(1)))  # one row of scalars
    if kind == "minmax":
        out = {c: F.try_divide(F.col(c) - F.col(f"{c}_min"), F.col(f"{c}_max") - F.col(f"{c}_min")) for c in features}
    else:
        out = {c: F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_stdDev")) for c in features}
    return joined.withColumns(out).select(df.columns)


def onehot(df: DataFrame, column: str, classes: list, names: list[str] | None = None) -> DataFrame:
    names = names or [f"b{i}" for i in range(len(classes))]
    return df.withColumns({n: (F.col(column) == c).cast("int") for n, c in zip(names, classes, strict=True)})


def covariance(df: DataFrame, features: list[str]) -> DataFrame:
    return df.agg(*[F.covar_pop(a, b).alias(f"{a}_{b}") for i, a in enumerate(features) for b in features[i:]])


def _decomposed(df: DataFrame, features: list[str], centre: list[float]) -> tuple[int, np.ndarray]:
    """(rows, R) of the centred features' QR decomposition: each batch's triangle, stacked and decomposed again up a tree."""
    k = len(features)

    def triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, top = 0, np.zeros((0, k))
        for batch in batches:
            block = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - centre
            rows += len(block)
            top = np.linalg.qr(np.vstack([top, block]), mode="r")
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64()), "r": [top.tobytes()]})

    def merged(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], np.linalg.qr(np.vstack([a[1], b[1]]), mode="r")

    valid = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]).dropna()
    parts = valid.mapInArrow(triangles, "rows long, r binary").rdd.map(lambda r: (r["rows"], np.frombuffer(r["r"]).reshape(-1, k)))
    return parts.treeAggregate((0, np.zeros((0, k))), merged, merged)


def pca(df: DataFrame, features: list[str], method: str = "svd") -> tuple[list[float], list[list[float]], list[float]]:
    """(centre, components, eigenvalues) of the population covariance, largest first; rows with a NULL do not count.

    ``svd`` takes the components from the centred features' triangle (its singular values squared, over
    the rows, are the eigenvalues) and squares no small differences; ``eigendecomp`` from their covariance. Only k x k
    matrices reach the driver. The largest weight of a component, the first of equal ones, is positive.
    """
    if method not in ("svd", "eigendecomp"):
        raise ValueError(f"method must be svd or eigendecomp, not {method}")
    valid = df.select(*features).dropna()
    k = len(features)
    row = valid.agg(*[F.avg(f).alias(f) for f in features]).first()
    centre = [row[f] for f in features]
    if centre[0] is None:
        raise ValueError("no row has all features")
    if method == "svd":
        rows, triangle = _decomposed(df, features, centre)
        _, singular, vectors = np.linalg.svd(np.vstack([triangle, np.zeros((k, k))]))
        values = singular**2 / rows
    else:
        row = covariance(valid, features).first()
        matrix = np.zeros((k, k))
        for i, a in enumerate(features):
            for j in range(i, k):
                matrix[i, j] = matrix[j, i] = row[f"{a}_{features[j]}"]
        values, columns = np.linalg.eigh(matrix)
        values, vectors = values[::-1], columns[:, ::-1].T
    signs = [np.sign(v[np.abs(v).argmax()]) or 1.0 for v in vectors]
    return centre, (vectors * np.array(signs)[:, None]).tolist(), values.tolist()


def apply_pca(
    df: DataFrame, features: list[str], centre: list[float], components: list[list[float]], eigenvalues: list[float] | None = None
) -> DataFrame:
    """Adds the scores ``pc_0``, ``pc_1``, ...; with ``eigenvalues`` divided by their deviations (NULL where that is 0)."""

    def project(i: int, component: list[float]) -> Column:
        score = sum((w * (F.col(f) - m) for f, m, w in zip(features, centre, component)), F.lit(0.0))
        return score if eigenvalues is None else F.try_divide(score, F.lit(max(eigenvalues[i], 0.0) ** 0.5))

    return df.withColumns({f"pc_{i}": project(i, c) for i, c in enumerate(components)})


def argmax(names: list[str]) -> Column:
    """Position of the largest of some columns; the first of equal ones."""
    layers = F.array(*map(F.col, names))
    return (F.array_position(layers, F.array_max(layers)) - 1).cast("int")


def apply_model(df: DataFrame, bands: list[str], load: Callable[[], Callable[[np.ndarray], np.ndarray]], names: list[str], output_probas: bool = False) -> DataFrame:
    """Adds a model's outputs, one column for each of ``names``, or the place of the greatest as ``class``.

    ``load`` gives, once for each task, a function from rows of bands to rows of outputs; rows with a NULL
    band have NULL outputs. Rows go through in Arrow batches, without a shuffle.
    """
    if not names:
        raise ValueError("names of the outputs are needed")
    new = [StructField(n, DoubleType()) for n in names] if output_probas else [StructField("class", IntegerType())]
    schema = StructType([f for f in df.schema if f.name not in {g.name for g in new}] + new)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            x = np.stack([batch.column(b).cast(pa.float64()).to_numpy(zero_copy_only=False) for b in bands], axis=1)
            known = ~np.isnan(x).any(axis=1)
            made = np.full((len(x), len(names)), np.nan)
            if known.any():
                made[known] = model(x[known])
            if output_probas:
                columns = [pa.array(c, pa.float64(), mask=~known) for c in made.T]
            else:
                columns = [pa.array(np.nan_to_num(made).argmax(axis=1).astype(np.int32), mask=~known)]
            kept = [batch.column(f.name) for f in schema.fields[: -len(new)]]
            yield pa.RecordBatch.from_arrays(kept + columns, names=schema.names)

    return df.mapInArrow(predicted, schema)


def random_forest(df: DataFrame, features: list[str], label: str, mode: str = "regression", n_trees: int = 30, min_leaf: int = 1, seed: int = 0):
    if mode not in ("regression", "classification", "probability"):
        raise ValueError("mode must be regression, classification or probability")
    kind = RandomForestRegressor if mode == "regression" else RandomForestClassifier
    model = kind(featuresCol="__x", labelCol=label, numTrees=n_trees, minInstancesPerNode=min_leaf, seed=seed)
    assembler = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip")
    return assembler, model.fit(assembler.transform(df))


def gradient_boosting(df: DataFrame, features: list[str], label: str, rounds: int = 20, shrinkage: float = 0.01, seed: int = 0):
    assembler = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip")
    model = GBTRegressor(featuresCol="__x", labelCol=label, maxIter=rounds, stepSize=shrinkage, lossType="absolute", seed=seed)
    return assembler, model.fit(assembler.transform(df))


def kmeans_extent(px: DataFrame, band: str, other: str, initial: float, n: int = 500, seed: int = 0, out: str = "water") -> DataFrame:
    """Two clusters of a stratified sample; the one with the lower mean of ``band`` is water."""
    valid = px.where(F.col(band).isNotNull() & F.col(other).isNotNull()).withColumn("__above", F.col(band) > initial)
    # The first of each side by a hash, chosen by a sort that keeps n rows a task.
    key = [F.xxhash64("scene_id", "y", "x", F.lit(seed)), "scene_id", "y", "x"]
    sides = [valid.where(F.col("__above") == above).orderBy(*key).limit(n) for above in (True, False)]
    sample = sides[0].unionAll(sides[1]).drop("__above")
    valid = valid.drop("__above")
    assembler = VectorAssembler(inputCols=[band, other], outputCol="__x", handleInvalid="skip")
    model = KMeans(k=2, seed=seed, featuresCol="__x", predictionCol="__k").fit(assembler.transform(sample.coalesce(1)))
    centres = model.clusterCenters()
    water = min(range(len(centres)), key=lambda i: centres[i][0])
    return model.transform(assembler.transform(valid)).withColumn(out, (F.col("__k") == water).cast("int")).drop("__x", "__k")
