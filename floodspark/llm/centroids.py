"""Centroid clustering in integers: exact k-means with distances by matrix products.

Vectors of ``size`` finite components are kept and become integers, floor(``scale`` * x). Squared
distances are |x|^2 - 2 x.c + |c|^2 in blocks of float64 matrix products. Every number of a block's
products is an integer below its bound size * (max |x| + max |c|)^2; below 2^53 float64 holds all of
them, and sums in any order, exactly. Blocks above that are computed with whole numbers of any size.

A round reads the blocks once, without a shuffle of rows: each task adds up its vectors by
centroid, and ``treeAggregate`` combines these sums, k * size whole numbers, whatever the input's size.
Nothing is kept in executors between rounds, so a lost one costs its tasks only.

Defined cases: null vectors, other lengths and vectors with a null, NaN or infinite component are
left out; an empty table gives an empty result; with fewer than k vectors there are as many centroids;
null ids sort last among the first centroids, and rows that repeat an id sort by their vectors; a
distance or inertia above the largest long is null, though clusters and centroids are exact still; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, ROUNDS, SIZE, SCALE, SEED = 16, 3, 64, 64, 1
EXACT, LONG, BLOCK = 2**53, 2**63 - 1, 8192
#: Bytes of centroids that travel with a task.
CENTROID_BYTES = 64 << 20


@dataclass
class Sums:
    """Whole numbers by centroid: vectors, their components' sums, and their squared distances' sum."""

    count: np.ndarray
    total: np.ndarray
    inertia: np.ndarray

    @classmethod
    def none(cls, k: int, size: int) -> Sums:
        return cls(np.zeros(k, object), np.zeros((k, size), object), np.zeros(k, object))

    def plus(self, other: Sums) -> Sums:
        return Sums(self.count + other.count, self.total + other.total, self.inertia + other.inertia)


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as float64 where all are below 2^53 and else as Python's whole numbers."""
    out = np.floor(x * float(scale))
    if not out.size or np.abs(out).max() < EXACT:
        return out
    whole = [[int(v * float(scale) // 1) if abs(v) < EXACT else int(v) * scale for v in row] for row in x.tolist()]
    return np.array(whole, object).reshape(x.shape)


def integer_parts(x: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integers) of the rows small enough for exact products, and of the others, so that a few don't slow all."""
    bound = math.isqrt(EXACT // max(x.shape[1], 1)) // 2
    small = np.abs(x).max(axis=1, initial=0) * float(scale) < bound
    for chosen in (small, ~small):
        if chosen.any():
            yield np.flatnonzero(chosen), scaled(x[chosen], scale)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``x`` to every row of ``c``, exact: float64 below 2^53, else whole numbers."""
    far = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    if x.dtype == object or c.dtype == object or x.shape[1] * far * far >= EXACT:
        x, c = _whole(x), _whole(c)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def _whole(x: np.ndarray) -> np.ndarray:
    """As Python's whole numbers, which have no bound."""
    return x if x.dtype == object else np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _floats(c: np.ndarray) -> np.ndarray:
    """Centroids as float64 if that holds them exactly."""
    return c.astype(float) if np.abs(c).max(initial=0) < EXACT else c


def sums_of(x: np.ndarray, c: np.ndarray) -> Sums:
    """Each vector's part in its nearest centroid's sums; of equal distances the smaller number counts."""
    d = distances(x, c)
    nearest = np.argmin(d, axis=1) if len(x) else np.zeros(0, int)
    least = d[np.arange(len(x)), nearest]
    out = Sums.none(len(c), x.shape[1])
    np.add.at(out.count, nearest, 1)
    np.add.at(out.inertia, nearest, np.array([int(v) for v in least.tolist()], object))
    if x.dtype != object and len(x) * np.abs(x).max(initial=0) < EXACT:
        belongs = np.zeros((len(c), len(x)))
        belongs[nearest, np.arange(len(x))] = 1
        out.total = _whole(belongs @ x)
    else:
        np.add.at(out.total, nearest, _whole(x))
    return out


def kept_vectors(df: DataFrame, id_column: str, vector: str, size: int = SIZE) -> DataFrame:
    """(id, vector) of the rows with ``size`` finite components, as doubles."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.select(F.col(f"`{id_column}`").cast("long").alias("id"), x.alias("vector")).where((F.size(x) == size) & finite)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK):
            yield batch.slice(first, BLOCK)


def blocks(kept: DataFrame, size: int) -> RDD:
    """Matrices of at most BLOCK vectors, as float64."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            yield pa.RecordBatch.from_pydict({"block": [_matrix(part.column("vector"), size).tobytes()]})

    rows = kept.select("vector").mapInArrow(packed, "block binary").rdd
    return rows.map(lambda row: np.frombuffer(row["block"], float).reshape(-1, size))


def first_centroids(kept: DataFrame, k: int, seed: int, scale: int, size: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:id``, in order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.orderBy(name.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return _whole(scaled(np.array([r[0] for r in rows], float).reshape(-1, size), scale))


def moved(c: np.ndarray, sums: Sums) -> np.ndarray:
    """Centroids at floor(sum / count) of their vectors; those without vectors stay."""
    return np.array([[t // n for t in total] if n else old.tolist() for old, total, n in zip(c, sums.total, sums.count)], object).reshape(c.shape)


def cluster(
    df: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    size: int = SIZE,
    scale: int = SCALE,
    seed: int = SEED,
    depth: int = 2,
) -> tuple[np.ndarray, Sums, DataFrame]:
    """(final centroids, sums of their vectors, rows): rows are (id, cluster, distance) of every kept vector."""
    if 8 * k * size > CENTROID_BYTES:
        raise ValueError(f"{k} centroids of {size} components are more than {CENTROID_BYTES} bytes")
    kept = kept_vectors(df, id_column, vector, size)
    c = first_centroids(kept, k, seed, scale, size)
    matrices = blocks(kept, size)

    def sums(centroids: np.ndarray) -> Sums:
        near = _floats(centroids)

        def add(done: Sums, x: np.ndarray) -> Sums:
            for _, part in integer_parts(x, scale):
                done = done.plus(sums_of(part, near))
            return done

        return matrices.treeAggregate(Sums.none(len(centroids), size), add, Sums.plus, depth)

    last = Sums.none(len(c), size)
    if len(c):
        for _ in range(rounds):
            c = moved(c, sums(c))
        last = sums(c)
    near = _floats(c)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            nearest, least = np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows, object)
            for rows, x in integer_parts(_matrix(part.column("vector"), size), scale):
                d = distances(x, near)
                nearest[rows] = best = np.argmin(d, axis=1)
                least[rows] = [int(v) if v <= LONG else None for v in d[np.arange(len(d)), best].tolist()]
            columns = [part.column("id"), pa.array(nearest), pa.array(least.tolist(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    rows = kept.mapInArrow(assigned, "id long, cluster int, distance long")
    return c, last, rows


def digest(centroid: np.ndarray) -> str:
    """sha256 of the components, as decimal whole numbers joined by commas."""
    return sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def report(c: np.ndarray, sums: Sums, rows: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    bounded = [int(v) if v <= LONG else None for v in sums.inertia.tolist()]
    total = int(sums.inertia.sum()) if len(c) else 0
    said = [(i, bounded[i], digest(c[i])) for i in range(len(c))]
    names = rows.sparkSession.createDataFrame(said, "cluster int, cluster_inertia long, centroid_sha256 string")
    inertia = F.lit(total if total <= LONG else None).cast("long")
    return rows.join(F.broadcast(names), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", inertia.alias("inertia"), "centroid_sha256"
    )
