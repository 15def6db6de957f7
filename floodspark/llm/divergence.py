"""Source divergence audit: how far each source's use of words in a language is from every other source's.

Terms are counted in batches and added up by (language, source, term). A language keeps the terms of
``min_docs`` of its documents; a hash deals them over blocks of about ``block_terms``, numbered within.
Each source's counts in a block are one sparse compressed vector. Sources are seated, ``seats`` to a
language (more where that many would hold too many sources each). The vectors of a seat and block
stay in the partition that they were dealt to, once; in each round of a round-robin tournament every
seat has one opponent, one of the two travels to the other's partition, and there all pairs of
their sources are evaluated, each in both directions. Only partial sums by pair leave a meeting.
A term's divergence from its language is ranked by heaps of ``top`` within each task, whose union
is ranked once more.

All arithmetic is on whole numbers: a share is 1 + floor(10^9 (count + 1) / (all + terms)), divided
in three steps of 10^3, exact below 9 * 10^15 counts of one group; its square is below 2^63. A task
holds the vectors of two seats in one block, bounded by ``block_terms`` and the sources of a seat.

Defined cases: null text, lang and source count as ''; a language without kept terms gives 0 for every
pair; a source alone in its language has no pair; repeated rows count as often as they occur; an
empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, written

MIN_DOCS, TOP, UNIT = 3, 200, 1_000_000_000
SEATS, SEATED, BLOCK_TERMS = 4, 256, 4096
#: Terms that a task counts before it passes their counts on.
HELD_TERMS, WHOLE_BYTES = 400_000, 1 << 22
#: Languages or groups that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_COUNTS = "lang string, source string, term string, n long, docs long"


def terms_of(text: bytes) -> list[bytes] | Iterator[bytes]:
    """Runs of ASCII letters, lower-cased, and of all characters beyond ASCII; of very long texts one by one."""
    text = text.lower()
    return _TERM.findall(text) if len(text) <= WHOLE_BYTES else (m.group() for m in _TERM.finditer(text))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def passed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for first in range(0, len(terms), 50_000):
                some = terms[first : first + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(some), pa.string()),
                        pa.array([source] * len(some), pa.string()),
                        pa.array([t.decode() for t in some], pa.string()),
                        pa.array([n[t] for t in some], pa.int64()),
                        pa.array([docs[t] for t in some], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
        held.clear()

    size = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found = terms_of(text.as_py())
            size -= len(docs)
            n.update(found)
            docs.update(set(found if isinstance(found, list) else terms_of(text.as_py())))
            size += len(docs)
            if size > HELD_TERMS:
                yield from passed()
                size = 0
    yield from passed()


def count_terms(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group."""
    named = documents.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # Dealt by term once; the sums of a group and of all groups of a language need no other shuffle.
    return named.mapInArrow(_count, _COUNTS).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), where total is all counts and terms; exact for totals up to 9 * 10^15."""
    left, out = counts + 1, 0
    for _ in range(3):
        digits, left = np.divmod(left * 1000, total)
        out = out * 1000 + digits
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pack(places: np.ndarray, counts: np.ndarray) -> bytes:
    """A sparse vector: gaps between places, then counts, compressed."""
    order = np.argsort(places)
    gaps = np.diff(places[order], prepend=0).astype(np.uint16 if places.max(initial=0) < 1 << 16 else np.int64)
    wide = counts[order].astype(np.uint16 if counts.max(initial=0) < 1 << 16 else np.int64)
    head = np.array([len(places), gaps.itemsize, wide.itemsize], np.int64).tobytes()
    return zlib.compress(head + gaps.tobytes() + wide.tobytes(), 1)


def unpack(vector: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of a packed vector; a null one is empty."""
    if vector is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = zlib.decompress(vector)
    n, a, b = np.frombuffer(raw, np.int64, 3).tolist()
    kinds = {2: np.uint16, 8: np.int64}
    gaps = np.frombuffer(raw, kinds[a], n, 24).astype(np.int64)
    return np.cumsum(gaps), np.frombuffer(raw, kinds[b], n, 24 + n * a).astype(np.int64)


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [[np.array(v, np.int64) for v in batch.column(c).to_pylist()] for c in ("places", "counts")]
        packed = pa.array([pack(p, n) for p, n in zip(*lists)], pa.binary())
        reach = pa.array([int(p.max()) + 1 for p in lists[0]], pa.int32())
        columns = [*(batch.column(c) for c in ("lang", "block", "source")), packed, reach]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "block", "source", "vector", "reach"])


_PAIRS = "lang string, source string, item string, value long"
#: A seat's sources in a block: name, total, width of the block and packed vector of each.
Seat = list[tuple[str, int, int, bytes | None]]


def _dense(row: tuple) -> np.ndarray:
    _, total, width, vector = row
    places, counts = unpack(vector)
    out = np.zeros(width, np.int64)
    out[places] = counts
    return shares(out, total)


def within(lang: str, seat: Seat) -> Iterator[tuple[str, str, str, int]]:
    """Both directions of every pair of one seat's sources."""
    opened = [(row[0], _dense(row)) for row in seat]
    for i, (item, q) in enumerate(opened):
        for source, p in opened[:i]:
            yield lang, source, item, int(divergence(p, q).sum())
            yield lang, item, source, int(divergence(q, p).sum())


def between(lang: str, home: Seat, guests: Seat) -> Iterator[tuple[str, str, str, int]]:
    """Both directions of every pair of a source at home and a guest; guests are opened one at a time."""
    opened = [(row[0], _dense(row)) for row in home]
    for row in guests:
        item, q = row[0], _dense(row)
        for source, p in opened:
            yield lang, source, item, int(divergence(p, q).sum())
            yield lang, item, source, int(divergence(q, p).sum())


def opponent(seat: int, rounds: int, turn: int) -> int:
    """Whom ``seat`` of ``rounds + 1`` (an even number) meets in round ``turn``: the circle method."""
    if seat == rounds:
        return turn * (rounds + 1) // 2 % rounds
    other = (turn - seat) % rounds
    return rounds if other == seat else other


def _traveller(even: int, turn: int):
    def sent(kv: tuple) -> list[tuple]:
        """A seat under its opponent's key if it is the one that travels in this round, else nothing."""
        (lang, block, seat), sources = kv
        to = opponent(seat, even - 1, turn)
        # Of two opponents one goes, by turns, so that the work is spread.
        return [((lang, block, to), sources)] if (seat < to) == ((seat + to + turn) % 2 == 0) else []

    return sent


def _meet(kv: tuple) -> Iterator[tuple]:
    (lang, _, _), (homes, guests) = kv
    guests = list(guests)
    for home in homes:
        for guest in guests:
            yield from between(lang, home, guest)


def _beside(small: DataFrame) -> DataFrame:
    """``small`` marked for a broadcast if its rows are few; else joins shuffle."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


class Audit:
    """The tables of one run, in the shared folder: ``kept`` terms by group, ``langs`` and ``groups``."""

    def __init__(self, documents: DataFrame, min_docs: int, seats: int, block_terms: int):
        together = Window.partitionBy("lang", "term")
        counted = count_terms(documents).select(
            "lang",
            "source",
            "term",
            "n",
            F.sum("docs").over(together).alias("docs"),
            F.sum("n").over(together).alias("all"),
            (F.row_number().over(together.orderBy("source")) == 1).alias("first"),
        )
        self.kept = written(counted.where(F.col("docs") >= min_docs).drop("docs"))
        names = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
        groups = cut_lineage(documents.select(*names).distinct())
        per_lang = self.kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("terms"), F.sum("n").alias("lang_n"))
        crowd = groups.groupBy("lang").agg(F.count("*").alias("sources"))
        n_seats = F.greatest(F.lit(seats), F.ceil(F.col("sources") / SEATED)).cast("int")
        self.langs = cut_lineage(
            crowd.join(per_lang, "lang", "left").select(
                "lang",
                F.coalesce("terms", F.lit(0)).alias("terms"),
                F.coalesce("lang_n", F.lit(0)).alias("lang_n"),
                n_seats.alias("seats"),
                F.greatest(F.ceil(F.coalesce("terms", F.lit(0)) / block_terms), F.lit(1)).cast("int").alias("blocks"),
            )
        )
        sums = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        sized = groups.join(sums, ["lang", "source"], "left").join(_beside(self.langs), "lang")
        total = (F.coalesce("group_n", F.lit(0)) + F.col("terms")).alias("total")
        seat = F.pmod(F.xxhash64("source"), F.col("seats")).cast("int").alias("seat")
        self.groups = cut_lineage(sized.select("lang", "source", total, (F.col("lang_n") + F.col("terms")).alias("lang_total"), "blocks", seat))
        self.seats = self.langs.agg(F.max("seats")).first()[0] or 1

    def seated(self) -> DataFrame:
        """(lang, block, seat, sources): every source in every block of its language, gathered by seat."""
        block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
        dealt = self.kept.join(_beside(self.langs.select("lang", "blocks")), "lang").select("lang", "source", "term", "n", block)
        # Numbers of terms within a block, the same for every source.
        place = (F.dense_rank().over(Window.partitionBy("lang", "block").orderBy("term")) - 1).alias("place")
        listed = dealt.select("lang", "block", "source", "n", place).groupBy("lang", "block", "source")
        listed = listed.agg(F.collect_list("place").alias("places"), F.collect_list("n").alias("counts"))
        packed = cut_lineage(listed.mapInArrow(_pack_rows, "lang string, block int, source string, vector binary, reach int"))
        widths = packed.groupBy("lang", "block").agg(F.max("reach").alias("reach"))
        places = self.groups.select("lang", "source", "total", "seat", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        full = places.join(packed.drop("reach"), ["lang", "block", "source"], "left").join(widths, ["lang", "block"], "left")
        source = F.struct("source", "total", F.coalesce("reach", F.lit(0)).alias("width"), "vector")
        return full.groupBy("lang", "block", "seat").agg(F.collect_list(source).alias("sources"))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) of every ordered pair of sources of a language.

        ``home`` is dealt once and kept in memory or on disk; a meeting's cogroup has its partitioning, so that only
        the travellers are shuffled. What is lost with an executor is dealt again from the written tables.
        """
        rows = self.seated()
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        seats = rows.rdd.map(lambda r: ((r.lang, r.block, r.seat), [(s.source, s.total, s.width, s.vector) for s in r.sources]))
        home = seats.partitionBy(tasks).persist(StorageLevel.MEMORY_AND_DISK)
        met = [home.flatMap(lambda kv: within(kv[0][0], kv[1]))]
        even = self.seats + self.seats % 2
        for turn in range(even - 1):
            travellers = home.flatMap(_traveller(even, turn)).partitionBy(tasks)
            met.append(home.cogroup(travellers, tasks).flatMap(_meet))
        found = rows.sparkSession.createDataFrame(rows.sparkSession.sparkContext.union(met), _PAIRS)
        return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def terms(self, top: int) -> DataFrame:
        """(lang, source, item, value) of the ``top`` terms of each group and task that exceed their language's share."""
        rows = self.kept.join(_beside(self.groups.select("lang", "source", "total", "lang_total")), ["lang", "source"])
        return rows.drop("first").sortWithinPartitions("lang", "source").mapInArrow(_heaps(top), _PAIRS)


def _heaps(top: int):
    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heap = None, []

        def passed() -> Iterator[pa.RecordBatch]:
            if heap:
                names = [[x] * len(heap) for x in group]
                yield pa.RecordBatch.from_pydict(
                    {"lang": names[0], "source": names[1], "item": [t.bytes.decode() for _, t in heap], "value": [v for v, _ in heap]}
                )

        for batch in batches:
            n, everywhere, total, lang_total = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "all", "total", "lang_total"))
            p, q = shares(n, total), shares(everywhere, lang_total)
            values = divergence(p, q)
            langs, sources, terms = (batch.column(c).to_pylist() for c in ("lang", "source", "term"))
            for i in np.flatnonzero(p > q).tolist():
                if group != (langs[i], sources[i]):
                    yield from passed()
                    group, heap = (langs[i], sources[i]), []
                value = int(values[i])
                if len(heap) < top:
                    heapq.heappush(heap, (value, _Backwards(terms[i].encode())))
                elif value >= heap[0][0]:
                    heapq.heappushpop(heap, (value, _Backwards(terms[i].encode())))
        yield from passed()

    return ranked


class _Backwards:
    """Bytes in falling order, so that of equal values the first term in the alphabet is the greatest entry of a heap."""

    __slots__ = ("bytes",)

    def __init__(self, raw: bytes):
        self.bytes = raw

    def __lt__(self, other: _Backwards) -> bool:
        return self.bytes > other.bytes

    def __eq__(self, other: object) -> bool:
        return self.bytes == other.bytes


def audit(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, seats: int = SEATS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of sources, and each source's ``top`` terms."""
    tables = Audit(documents, min_docs, seats, block_terms)
    parts = [
        tables.pairs().select("lang", "source", F.lit("pair").alias("part"), "item", "value"),
        tables.terms(top).select("lang", "source", F.lit("term").alias("part"), "item", "value"),
    ]
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = [p.withColumn("rank", rank) for p in parts]
    return ranked[0].unionAll(ranked[1].where(F.col("rank") <= top))
