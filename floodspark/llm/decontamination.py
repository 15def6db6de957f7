"""Benchmark decontamination by size-partitioned MinHash containment search.

Benchmark items are partitioned by their number of shingles, to the next power of two ``s``. For each
partition the documents are cut into windows of ``2 s`` shingles at every ``s``-th, so that an item
lies whole in some window however long the document is, and the Jaccard similarity of an item
that is contained to 0.8 with its window is 0.19 at least. A window and an item agree on one of ``hashes``
MinHash values with a probability of more than 0.9999 then. Minima of larger windows are minima of
smaller ones, so all partitions together cost little more than the smallest. Items of fewer than
nine shingles, for which those bounds do not hold, are looked up exactly: every document that holds
one of their shingles is a candidate.

Agreeing items are verified exactly: the share of the item's distinct shingles that the whole
document holds must be ``containment`` or more.

The benchmark is the stated query set: it is handled in blocks of about ``items_per_block`` items and
``bytes_per_block`` bytes, each broadcast on its own; documents are read once for each block and never
shuffled.

Defined cases: null and empty texts contain nothing, and items without a word are found nowhere;
an item of fewer than five words is one shingle of all its words, compared with as many consecutive
words of the documents; repeated documents give repeated results, repeated items count once; a null doc_id or item_id stays null in
the result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import U64, blocks, shingles, tokens

K, HASHES, CONTAINMENT, SMALLEST, EXACT_BELOW = 5, 48, 0.8, 16, 9
#: The driver builds an index of about so many items and bytes of text at once (at most twice as many, or one item).
ITEMS_PER_BLOCK, BYTES_PER_BLOCK = 20_000, 32 << 20
_SEEDS = np.random.default_rng(23).integers(1, 1 << 63, (256, 2)).astype(U64) | U64(1)


def _minhash(keys: np.ndarray, j: int) -> np.ndarray:
    return (keys ^ _SEEDS[j, 0]) * _SEEDS[j, 1]


def _cuts(bounds: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of ``step`` within each of the groups that ``bounds`` delimit, and their bounds."""
    sizes = np.diff(bounds)
    runs = -(-sizes // step)
    new = np.concatenate([[0], np.cumsum(runs)])
    inside = np.arange(new[-1]) - np.repeat(new[:-1], runs)
    return np.repeat(bounds[:-1], runs) + inside * step, new


class ItemIndex:
    """Shingle sets and MinHash values of one block of items whose shingles have ``k`` words."""

    def __init__(self, k: int, ids: list, sets: list[np.ndarray], hashes: int) -> None:
        self.k, self.ids, self.sets, self.hashes = k, ids, sets, hashes
        self.partitions: dict[int, list] = {}
        sizes = np.array([0 if len(s) < EXACT_BELOW else max(SMALLEST, 1 << int(len(s) - 1).bit_length()) for s in sets])
        few = np.flatnonzero(sizes == 0)
        values = np.concatenate([sets[i] for i in few]) if len(few) else np.zeros(0, U64)
        order = np.argsort(values, kind="stable")
        self.exact = values[order], np.repeat(few, [len(sets[i]) for i in few])[order]
        for size in sorted(set(sizes[sizes > 0].tolist())):
            members = np.flatnonzero(sizes == size)
            tables = []
            for j in range(hashes):
                values = np.array([_minhash(sets[i], j).min() for i in members], U64)
                order = np.argsort(values, kind="stable")
                bits = min(max(12, 6 + len(members).bit_length()), 20)
                seen = np.zeros(1 << bits, bool)
                seen[values >> U64(64 - bits)] = True
                tables.append((values[order], members[order], seen, U64(64 - bits)))
            self.partitions[size] = tables

    def search(self, keys: np.ndarray, bounds: np.ndarray, containment: float) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) of the verified pairs."""
        found: set[tuple[int, int]] = set()
        values, members = self.exact
        if len(values):
            at = np.flatnonzero(np.isin(keys, values))
            docs = np.searchsorted(bounds, at, "right") - 1
            low, high = (np.searchsorted(values, keys[at], side) for side in ("left", "right"))
            for d, lo, hi in zip(docs.tolist(), low.tolist(), high.tolist()):
                found.update((d, int(i)) for i in members[lo:hi])
        base, base_bounds = _cuts(bounds, SMALLEST)
        if not len(base):
            return []
        for j in range(self.hashes if self.partitions else 0):
            minima, level = np.minimum.reduceat(_minhash(keys, j), base), base_bounds
            size = SMALLEST
            for wanted in self.partitions:
                while size < wanted:
                    cuts, level_up = _cuts(level, 2)
                    minima, level, size = np.minimum.reduceat(minima, cuts), level_up, size * 2
                windows = minima.copy()
                inner = np.ones(len(minima), bool)
                inner[level[1:][np.diff(level) > 0] - 1] = False
                at = np.flatnonzero(inner)
                windows[at] = np.minimum(minima[at], minima[at + 1])
                values, members, seen, drop = self.partitions[wanted][j]
                hit = np.flatnonzero(seen[windows >> drop])
                if not len(hit):
                    continue
                low = np.searchsorted(values, windows[hit], "left")
                high = np.searchsorted(values, windows[hit], "right")
                docs = np.searchsorted(level, hit, "right") - 1
                for d, lo, hi in zip(docs[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
                    found.update((d, int(i)) for i in members[lo:hi])
        out, last, own = [], -1, keys[:0]
        for d, i in sorted(found):
            if d != last:
                own, last = np.unique(keys[bounds[d] : bounds[d + 1]]), d
            items = self.sets[i]
            at = np.minimum(np.searchsorted(own, items), len(own) - 1)
            shared = int((own[at] == items).sum())
            if shared >= containment * len(items) - 1e-9:
                out.append((d, i, shared))
        return out


def build_indexes(rows: list[tuple], k: int, hashes: int) -> list[ItemIndex]:
    """One index for each shingle length that the items need (``k``, or fewer for shorter items)."""
    by_length: dict[int, tuple[list, list]] = {}
    texts = pa.array([t for _, t in rows], pa.string())
    for block in blocks(texts):
        words = tokens(block)
        keys, bounds = shingles(words, k)
        for d, count in enumerate(words.counts):
            if count:
                ids, sets = by_length.setdefault(min(k, int(count)), ([], []))
                ids.append(rows[block.first + d][0])
                sets.append(np.unique(keys[bounds[d] : bounds[d + 1]]))
    return [ItemIndex(n, ids, sets, hashes) for n, (ids, sets) in sorted(by_length.items())]


def _found(texts: pa.Array, indexes: list[ItemIndex], containment: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item_id, shingles, shared) of the items found in the texts."""
    for block in blocks(texts):
        words = tokens(block)
        for index in indexes:
            keys, bounds = shingles(words, index.k)
            for d, i, shared in index.search(keys, bounds, containment):
                if words.counts[d] >= index.k:
                    yield block.first + d, index.ids[i], len(index.sets[i]), shared


def _searcher(indexes, containment: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_found(batch.column("text"), indexes.value, containment))
            ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            rest = [pa.array([r[c] for r in rows], pa.int64()) for c in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([ids, *rest], names=["doc_id", "item_id", "n_shingles", "n_shared"])

    return search


def _cleaner(indexes, containment: float):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r[0] for r in _found(batch.column("text"), indexes.value, containment)]] = False
            yield batch.filter(pa.array(keep))

    return clean


def _item_blocks(benchmark: DataFrame, k: int, hashes: int, items_per_block: int, bytes_per_block: int):
    """Broadcast indexes of the blocks of the benchmark, one after the other.

    Items are dealt by a hash into twice as many blocks until each block keeps both bounds, or is one
    item: that one is larger than the bound by itself.
    """
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    n_blocks = max(1, -(-total["n"] // items_per_block), -(-total["size"] // bytes_per_block))
    while True:
        number = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
        sizes = items.groupBy(number.alias("block")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
        over = sizes.where((F.col("n") > 1) & ((F.col("n") > 2 * items_per_block) | (F.col("size") > 2 * bytes_per_block)))
        if n_blocks == 1 or over.isEmpty():
            break
        n_blocks *= 2
    for row in sizes.select("block").orderBy("block").toLocalIterator():
        rows = [(r[0], r[1]) for r in items.where(number == row["block"]).collect()]
        yield benchmark.sparkSession.sparkContext.broadcast(build_indexes(rows, k, hashes))


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    containment: float = CONTAINMENT,
    k: int = K,
    hashes: int = HASHES,
    items_per_block: int = ITEMS_PER_BLOCK,
    bytes_per_block: int = BYTES_PER_BLOCK,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of items found in documents."""
    parts = [
        documents.select("doc_id", "text").mapInArrow(
            _searcher(indexes, containment), "doc_id long, item_id long, n_shingles long, n_shared long"
        )
        for indexes in _item_blocks(benchmark, k, hashes, items_per_block, bytes_per_block)
    ]
    if not parts:
        empty = documents.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shingles long, n_shared long")
        parts = [empty]
    found = reduce(DataFrame.unionAll, parts)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    containment: float = CONTAINMENT,
    k: int = K,
    hashes: int = HASHES,
    items_per_block: int = ITEMS_PER_BLOCK,
    bytes_per_block: int = BYTES_PER_BLOCK,
) -> DataFrame:
    """``documents`` without the rows whose text holds a benchmark item; nothing is shuffled."""
    # Packed in a struct, columns of any name pass through.
    row = F.struct(*[documents[f"`{c}`"] for c in documents.columns]).alias("row")
    packed = documents.select("text", row)
    for indexes in _item_blocks(benchmark, k, hashes, items_per_block, bytes_per_block):
        packed = packed.mapInArrow(_cleaner(indexes, containment), packed.schema)
    return packed.select("row.*")
