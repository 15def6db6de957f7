"""Hashed sparse features of texts, and follow-the-regularised-leader training on a bounded sample.

Features are computed in Arrow batches by the executors, both for training and for scoring. Only the
features of the bounded, documented sample of labelled documents come to the driver, bounded in their
number too; the fitted weights have a fixed size (2 ** BITS) and are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .textblocks import U64, Block

BITS = 18
#: At most so many terms of the sample (4 bytes each) come to the driver.
TRAIN_TERMS = 16_000_000
#: (block) -> (term of each feature, document bounds); terms may repeat within a document.
Featurizer = Callable[[Block], tuple[np.ndarray, np.ndarray]]


def slots(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (hashes >> U64(64 - bits)).astype(np.int32)


def distinct_terms(terms: np.ndarray, bounds: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each document, sorted, and their bounds."""
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))
    keys = np.unique((doc << bits) | terms)
    return (keys & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(keys, np.arange(len(bounds), dtype=np.int64) << bits)


def sample_features(
    sample: DataFrame, featurizer: Featurizer, blocks_of, train_terms: int = TRAIN_TERMS
) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct terms and label of each row of a bounded (doc_id, text, label), ordered by doc_id.

    The driver gets at most ``train_terms`` terms: where the sample has more, documents are taken in
    the order of a hash of their ids up to that bound.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch.column("text")):
                terms, bounds = distinct_terms(*featurizer(block))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(terms))
                rows = pa.array(np.arange(block.first, block.last))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("label").take(rows), lists],
                    names=["doc_id", "label", "terms"],
                )

    found = cut_lineage(sample.mapInArrow(features, "doc_id long, label int, terms array<int>"))
    sizes = found.select("doc_id", F.size("terms").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    chosen, room = [], train_terms
    for row in sizes:
        room -= row["n"]
        if room < 0:
            break
        chosen.append((row["doc_id"],))
    if len(chosen) < len(sizes):
        found = found.join(F.broadcast(found.sparkSession.createDataFrame(chosen, "doc_id long")), "doc_id")
    got = found.toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    terms = got.column("terms").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.chunk(0)
    flat, edges = terms.flatten().to_numpy(), terms.offsets.to_numpy()
    rows = [flat[s - edges[0] : e - edges[0]] for s, e in zip(edges, edges[1:])]
    return rows, got.column("label").to_numpy().astype(float)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Logistic regression over binary terms with FTRL-proximal updates, one document at a time."""

    def __init__(self, bits: int = BITS, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(1 << bits)
        self.n = np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0

    def weights(self, terms=slice(None)) -> np.ndarray:
        z, n = self.z[terms], self.n[terms]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def update(self, terms: np.ndarray, gradient: float, w: np.ndarray) -> None:
        square = gradient * gradient
        n = self.n[terms]
        self.z[terms] += gradient - (np.sqrt(n + square) - np.sqrt(n)) / self.alpha * w
        self.n[terms] = n + square
        step = ((self.bias_n + square) ** 0.5 - self.bias_n**0.5) / self.alpha
        self.bias_z, self.bias_n = self.bias_z + gradient - step * self.bias, self.bias_n + square

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = 3, seed: int = 5) -> Ftrl:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                w = self.weights(rows[i])
                self.update(rows[i], float(sigmoid(self.bias + w.sum())) - labels[i], w)
        return self


def sum_by_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of rows of ``values`` between the bounds, each by itself; zero for empty documents."""
    total = np.zeros((len(bounds) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        total[some] = np.add.reduceat(values.astype(float), bounds[some], axis=0)
    return total


def active_terms(active: np.ndarray, terms: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of each document among those that the model has a weight for."""
    at = np.flatnonzero(active[terms])
    return distinct_terms(terms[at], np.searchsorted(at, bounds))
