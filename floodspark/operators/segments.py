"""Segmentations that need a clustering."""

from __future__ import annotations

from math import log, pi

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.clustering import KMeans as Mllib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .focal import KEYS
from .lineage import cut_lineage


def information(n: int, parts: list[tuple[int, float]], k: int) -> float:
    """Bayesian information criterion of ``n`` points in round Gaussian clusters of one variance; ``parts`` has sizes and squared distances."""
    clusters = len(parts)
    spread = sum(d for _, d in parts) / max((n - clusters) * k, 1)
    spread = max(spread, 1e-300)
    likelihood = sum(m * log(m / n) for m, _ in parts if m) - n * k / 2 * log(2 * pi * spread) - (n - clusters) * k / 2
    return likelihood - (clusters * (k + 1)) / 2 * log(n)


def xmeans(points: DataFrame, features: str = "__x", least: int = 3, most: int = 12, seed: int = 0, out: str = "__k"):
    """A k-means model with ``least`` to ``most`` clusters: each is split in two where that raises its information criterion.

    Rounds start from the centres found so far; in each, every cluster is halved by k-means of its own, and of
    the halvings that pay those that pay most are kept, up to ``most`` clusters. Ends when none pays.
    """
    size = len(points.first()[features])
    model = KMeans(k=least, seed=seed, featuresCol=features, predictionCol=out).fit(points)

    def spreads(fitted, rows: DataFrame) -> dict[int, tuple[int, float]]:
        centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in fitted.clusterCenters()])
        away = F.zip_with(vector_to_array(features), F.get(centres, F.col(out)), lambda a, b: (a - b) * (a - b))
        d2 = F.aggregate(away, F.lit(0.0), lambda s, v: s + v)
        return {r[0]: (r[1], r[2]) for r in fitted.transform(rows).groupBy(out).agg(F.count("*"), F.sum(d2)).collect()}

    while len(model.clusterCenters()) < most:
        whole = spreads(model, points)
        labelled = cut_lineage(model.transform(points))
        gains = []
        for label, (n, squares) in whole.items():
            if n < 4:
                continue
            own = labelled.where(F.col(out) == label).drop(out)
            halves = KMeans(k=2, seed=seed, featuresCol=features, predictionCol=out).fit(own)
            if len(halves.clusterCenters()) == 2:
                gain = information(n, list(spreads(halves, own).values()), size) - information(n, [(n, squares)], size)
                gains.append((gain, label, halves.clusterCenters()))
        paid = sorted((g for g in gains if g[0] > 0), key=lambda g: -g[0])[: most - len(model.clusterCenters())]
        if not paid:
            break
        split = {label: halves for _, label, halves in paid}
        centres = [c for i, old in enumerate(model.clusterCenters()) for c in split.get(i, [old])]
        model = _from_centres(points, centres, features, out)
    return model


def _from_centres(points: DataFrame, centres: list, features: str, out: str, rounds: int = 10):
    """A k-means model of Lloyd rounds from given centres."""
    from pyspark.mllib.clustering import KMeansModel as Start

    rows = points.select(vector_to_array(features).alias("v")).rdd.map(lambda r: r["v"])
    old = Mllib.train(rows, len(centres), maxIterations=rounds, initialModel=Start([list(map(float, c)) for c in centres]))
    return FixedCentres(old.clusterCenters, features, out)


class FixedCentres:
    """Clusters of given centres, nearest first, as a column expression."""

    def __init__(self, centres: list, features: str, out: str):
        self.centres, self.features, self.out = [[float(v) for v in c] for c in centres], features, out

    def clusterCenters(self) -> list:  # the name that fitted models have
        return self.centres

    def transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(self.features)
        ranked = []
        for i, centre in enumerate(self.centres):
            away = F.zip_with(x, F.array(*[F.lit(v) for v in centre]), lambda a, b: (a - b) * (a - b))
            ranked.append(F.struct(F.aggregate(away, F.lit(0.0), lambda s, v: s + v).alias("d"), F.lit(i).alias("i")))
        return df.withColumn(self.out, F.least(*ranked)["i"])


def unsupervised_forest(sample: DataFrame, features: list[str], rank: str | None = None, ranking: str = "min", trees: int = 100, sizes: tuple[int, int] = (3, 12), seed: int = 0):
    """(assembler, model): a forest that learns which cluster of ``sample`` is water.

    The number of clusters, within ``sizes``, is found by splitting (``xmeans``); water is the cluster with
    the least (or greatest) mean of ``rank``.
    """
    if ranking not in ("min", "max"):
        raise NotImplementedError("ranking must be min or max")
    rank = rank or features[0]
    assembler = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip")
    points = cut_lineage(assembler.transform(sample.select(*features)))
    model = xmeans(points, least=sizes[0], most=sizes[1], seed=seed)
    centres = model.clusterCenters()
    at = features.index(rank)
    water = (min if ranking == "min" else max)(range(len(centres)), key=lambda i: centres[i][at])
    labelled = model.transform(points).withColumn("__label", (F.col("__k") == water).cast("double"))
    forest = RandomForestClassifier(featuresCol="__x", labelCol="__label", numTrees=trees, seed=seed)
    return assembler, forest.fit(labelled)


def semisupervised_extent(px: DataFrame, bands: list[str], rank: str | None = None, ranking: str = "min", n: int = 500, seed: int = 7, cut: float | None = None, **forest) -> DataFrame:
    """``water_proba`` of an unsupervised forest over ``n`` sampled pixels, or ``water`` where it is over ``cut``."""
    valid = px.where(" AND ".join(f"`{b}` IS NOT NULL" for b in bands))
    sample = valid.orderBy(F.xxhash64(*KEYS, F.lit(seed)), *KEYS).limit(n)
    assembler, model = unsupervised_forest(sample, bands, rank, ranking, seed=seed, **forest)
    got = model.transform(assembler.transform(valid)).withColumn("water_proba", F.element_at(vector_to_array("probability"), 2))
    got = got.select(*px.columns, "water_proba")
    return got if cut is None else got.withColumn("water", (F.col("water_proba") > cut).cast("int")).drop("water_proba")
