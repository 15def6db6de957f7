"""Variable-capacity best-fit packing of documents into training sequences.

Lengths are counted in words (maximal runs of other than white space). A document that is longer
than the largest permitted sequence is cut into pieces of that length and a rest. Pieces are dealt by
a hash into shards of about ``pieces_per_shard``, which are packed independently; nothing but ids and
lengths is shuffled. The number of shards comes from the number of pieces, and equal rows are numbered
before they are dealt, so that no id, however often it is repeated, fills a shard.

Within a shard pieces go, longest first, to the open bin with the least room that takes them. Where
none does, a bin is opened, of the permitted length that costs least for what it would hold: for each
length the bin is filled in thought with the longest pieces left that still fit, and the cost of the
least length that holds them is set against their words. In the end every bin is downsized to the
least permitted length that holds its contents. Plans that open bins of one preferred length are made
as well, and the cheapest plan of a shard counts. A bin costs its capacity plus ``bin_overhead``.

Defined cases: null and empty texts and texts of white space have no piece and are in no bin; ties
are broken by length, doc_id and piece number, so the plan does not depend on the order of the rows;
rows that repeat a doc_id are packed as often as they occur; a null doc_id stays null; extra columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .textblocks import SOLID, blocks, tokens

CAPACITIES = (512, 1024, 2048, 4096)
BIN_OVERHEAD, PIECES_PER_SHARD, COPIES_AT_ONCE = 16, 20_000, 1_000


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text"), lower=False):
            counts = tokens(block, SOLID).counts
            ids = batch.column("doc_id").slice(block.first, block.n)
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts.astype(np.int64))], names=["doc_id", "n_words"])


class Opening:
    """The capacity to open for a piece, by what the pieces after it would fill it with."""

    def __init__(self, lengths: list[int], capacities: tuple[int, ...], overhead: int) -> None:
        self.falling = [-x for x in lengths]
        self.capacities, self.overhead = capacities, overhead

    def filled(self, at: int, capacity: int) -> int:
        """Words of a bin that takes piece ``at`` and then the longest later pieces that fit."""
        falling, room, at = self.falling, capacity + self.falling[at], at + 1
        while room and (at := bisect_left(falling, -room, at)) < len(falling):
            room += falling[at]
            at += 1
        return capacity - room

    def capacity(self, at: int) -> int:
        best = None
        for capacity in self.capacities[bisect_left(self.capacities, -self.falling[at]) :]:
            words = self.filled(at, capacity)
            cost = (self.capacities[bisect_left(self.capacities, words)] + self.overhead) / words
            if best is None or cost < best[0]:
                best = cost, capacity
        return best[1]


def best_fit(lengths: list[int], open_bin: Callable[[int], int]) -> tuple[list[int], list[int]]:
    """(bin of each piece, contents of each bin) of best fit in the given order.

    ``open_bin`` gives the capacity of the bin to open for the piece of that number.
    """
    bins: list[int] = []
    fill: list[int] = []
    at_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for at, length in enumerate(lengths):
        i = bisect_left(rooms, length)
        if i < len(rooms):
            room = rooms[i]
            stack = at_room[room]
            number = stack.pop()
            if not stack:
                del at_room[room], rooms[i]
        else:
            room = open_bin(at)
            number = len(fill)
            fill.append(0)
        bins.append(number)
        fill[number] += length
        left = room - length
        if left:
            if left not in at_room:
                at_room[left] = []
                insort(rooms, left)
            at_room[left].append(number)
    return bins, fill


def pack_lengths(
    lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = BIN_OVERHEAD
) -> tuple[list[int], list[int]]:
    """(bin of each piece, capacity of each bin) of the cheapest plan; ``lengths`` in falling order."""

    def preferring(preferred: int) -> Callable[[int], int]:
        return lambda at: capacities[bisect_left(capacities, max(preferred, lengths[at]))]

    best: tuple[int, list[int], list[int]] | None = None
    for open_bin in (Opening(lengths, capacities, overhead).capacity, *map(preferring, capacities)):
        bins, fill = best_fit(lengths, open_bin)
        sizes = [capacities[bisect_left(capacities, f)] for f in fill]
        cost = sum(sizes) + overhead * len(sizes)
        if best is None or cost < best[0]:
            best = cost, bins, sizes
    return best[1], best[2]


def pieces(documents: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """(doc_id, copy, piece, start, length): what is packed, in words of the document.

    ``copy`` numbers rows of one doc_id and length. They are counted first and numbered in groups of
    ``COPIES_AT_ONCE``, so that neither the count nor the numbers of a common id come from one task.
    """
    largest = max(capacities)
    counted = documents.select("doc_id", "text").mapInArrow(_count_words, "doc_id long, n_words long").where("n_words > 0")
    alike = counted.groupBy("doc_id", "n_words").agg(F.count("*").alias("n"))
    group = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES_AT_ONCE))).alias("group")
    groups = alike.select("doc_id", "n_words", "n", group).repartition("doc_id", "n_words", "group")
    first = F.col("group") * COPIES_AT_ONCE
    copies = groups.select(
        "doc_id", "n_words", F.explode(F.sequence(first, F.least(first + COPIES_AT_ONCE, F.col("n")) - 1)).alias("copy")
    )
    cut = copies.select(
        "doc_id", "copy", "n_words", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_words") - 1) / largest).cast("int"))).alias("piece")
    )
    start = F.col("piece") * largest
    return cut.select(
        "doc_id",
        "copy",
        "piece",
        start.cast("long").alias("start"),
        F.least(F.lit(largest), F.col("n_words") - start).cast("long").alias("length"),
    )


def pack(
    documents: DataFrame,
    capacities: tuple[int, ...] = CAPACITIES,
    overhead: int = BIN_OVERHEAD,
    pieces_per_shard: int = PIECES_PER_SHARD,
) -> DataFrame:
    """(doc_id, piece, start, length, shard, bin, capacity, fill, bin_start): one row a piece.

    ``(shard, bin)`` names a sequence of ``capacity`` words, ``bin_start`` is where the piece begins in it.
    """
    capacities = tuple(sorted(capacities))
    cut = cut_lineage(pieces(documents, capacities))
    n_shards = max(1, -(-cut.count() // pieces_per_shard))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece", "length"), F.lit(n_shards))).drop("copy")

    def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, sizes = pack_lengths(rows["length"].tolist(), capacities, overhead)
        rows["bin"] = bins
        rows["capacity"] = np.array(sizes)[bins]
        by_bin = rows.groupby("bin", sort=False)["length"]
        rows["fill"] = by_bin.transform("sum")
        rows["bin_start"] = by_bin.cumsum() - rows["length"]
        return rows

    schema = "doc_id long, piece int, start long, length long, shard long, bin long, capacity long, fill long, bin_start long"
    return dealt.groupBy("shard").applyInPandas(pack_shard, schema)
