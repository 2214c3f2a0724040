"""Packing token sequences into as few fixed-size sequences as possible.

The plan needs only how many pieces have each length: a histogram of at most
`capacity` entries, whatever the corpus size. The planner turns it into bin
patterns and so into segments, each saying where the pieces of one length with
ranks in [lo, hi) go. Pieces are ranked within (length, salt) cells, so a length
that a third of all pieces share is still ranked by many tasks, and a join on
length places every piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.llm import text as tx
from wattloom.llm.tokens import tokenizer
from wattloom.session import cut, ship

#: Pieces that one rank cell should hold, on average, if all had one length.
CELL = 20_000
#: Rows of (partition, length) that are sent to all tasks: 24 MB.
CELLS = 1 << 20

SEGMENT = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "lo", "hi", "first", "per", "at")])


def split_tokens(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, ids: str | None = None) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of documents' token ids.

    A document's ids are its text's ids and then end_id. Only a document longer than
    capacity is cut, into capacity-sized pieces, the last one maybe shorter. A null or
    empty text has the one id end_id. Repeated rows give repeated pieces. The checksum is
    of little-endian unsigned 32-bit ids; the column ids holds them in the given numpy kind,
    deflated, as each copy of it on disk or in a shuffle is most of its row."""
    ship(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if ids else 5]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, 1):
            keys = batch.column(0).to_pylist()
            for at, flat, off in _encoded(path, batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for i, a, b in zip(range(at, len(keys)), off[:-1].tolist(), off[1:].tolist()):
                    whole = np.append(flat[a:b], np.int32(end_id)).astype("<u4")
                    for piece, s in enumerate(range(0, len(whole), capacity)):
                        part = whole[s : s + capacity]
                        row = (keys[i], piece, s, len(part), zlib.crc32(part.tobytes()))
                        rows.append((*row, zlib.compress(part.astype(ids).tobytes(), 1)) if ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _encoded(path: str, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts, bounded by characters: first text, flat ids, offsets."""
    tok = tokenizer(path)
    lo = 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + len(texts[hi] or "") <= 4_000_000):
            total += len(texts[hi] or "")
            hi += 1
        yield lo, *tok.ids([t or "" for t in texts[lo:hi]])
        lo = hi


class _Plan:
    """Collects segments while a planner fills bins."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.ranked: dict[int, int] = {}
        self.bins = 0

    def place(self, length: int, pieces: int, first: int, per: int, at: int) -> None:
        """The next `pieces` pieces of a length: `per` in each bin from `first` on, from offset `at`."""
        lo = self.ranked.get(length, 0)
        self.ranked[length] = lo + pieces
        if self.rows and per == 1:
            p = self.rows[-1]
            if p[0] == length and p[2] == lo and p[4] == 1 and p[5] == at and p[3] + p[2] - p[1] == first:
                self.rows[-1] = (length, p[1], lo + pieces, p[3], 1, at)
                return
        self.rows.append((length, lo, lo + pieces, first, per, at))


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple]:
    """Segments of best-two-fit packing.

    A bin is filled greedily with the largest unpacked pieces that fit. While a gap is
    left, its smallest piece is exchanged for the two unpacked pieces that fit the gap
    and its place most tightly, if they fill more than it. A filled pattern is repeated
    while its pieces last, so the work follows the number of lengths, not of pieces."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan = _Plan()
    while left.any():
        pattern: dict[int, int] = {}
        gap = capacity
        lengths = np.flatnonzero(left)
        free = left.copy()
        while gap and (k := np.searchsorted(lengths, gap, "right") - 1) >= 0:
            length = int(lengths[k])
            take = int(min(free[length], gap // length))
            if take:
                pattern[length] = pattern.get(length, 0) + take
                free[length] -= take
                gap -= take * length
            lengths = lengths[:k]
        while gap and pattern:
            smallest = min(pattern)
            free[smallest] += 1
            pair = _tightest_pair(free, gap + smallest)
            free[smallest] -= 1
            if not pair or sum(pair) <= smallest:
                break
            pattern[smallest] -= 1
            if not pattern[smallest]:
                del pattern[smallest]
            free[smallest] += 1
            for x in pair:
                pattern[x] = pattern.get(x, 0) + 1
                free[x] -= 1
            gap += smallest - sum(pair)
        times = min(int(left[x]) // n for x, n in pattern.items())
        at = 0
        for length in sorted(pattern, reverse=True):
            per = pattern[length]
            plan.place(length, per * times, plan.bins, per, at)
            left[length] -= per * times
            at += per * length
        plan.bins += times
    return plan.rows


def _tightest_pair(free: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum of at most room."""
    lengths = np.flatnonzero(free[: room + 1])
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return None
    k = np.searchsorted(lengths, room - lengths, "right") - 1
    k = np.where((k >= 0) & (lengths[k] == lengths) & (free[lengths] < 2), k - 1, k)
    total = np.where(k >= 0, lengths + lengths[k], -1)
    i = int(total.argmax())
    return (int(lengths[i]), int(lengths[k[i]])) if total[i] > 0 else None


class CapacityTree:
    """A segment tree over the numbers of open bins of each remaining capacity."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.sum = [0] * (2 * self.base)

    def add(self, capacity: int, n: int) -> None:
        i = self.base + capacity
        while i:
            self.sum[i] += n
            i //= 2

    def smallest_at_least(self, capacity: int) -> int | None:
        """The least capacity >= the given one that an open bin has."""
        i = self.base + capacity
        if self.sum[i]:
            return capacity
        while i > 1:
            if i % 2 == 0 and self.sum[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.base:
            i = 2 * i if self.sum[2 * i] else 2 * i + 1
        return i - self.base


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple]:
    """Segments of best-fit-decreasing packing: pieces by falling length, each into the
    fullest open bin that still has room, found in a segment tree over capacities.
    Bins of equal room are handled in runs, so the work follows the number of lengths."""
    plan, tree = _Plan(), CapacityTree(capacity)
    runs: dict[int, list[tuple[int, int]]] = {}

    def open_bins(room: int, first: int, n: int) -> None:
        if room:
            runs.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = tree.smallest_at_least(length)
            if room is None:  # new bins, each with as many of this length as fit
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    plan.place(length, full * per, plan.bins, per, 0)
                    open_bins(capacity - per * length, plan.bins, full)
                    plan.bins += full
                if rest:
                    plan.place(length, rest, plan.bins, rest, 0)
                    open_bins(capacity - rest * length, plan.bins, 1)
                    plan.bins += 1
                break
            first, n = runs[room].pop()
            take = min(n, left)
            if n > take:
                runs[room].append((first + take, n - take))
            tree.add(room, -take)
            plan.place(length, take, first, 1, capacity - room)
            open_bins(room - length, first, take)
            left -= take
    return plan.rows


def pack(pieces: DataFrame, capacity: int, planner: Callable[[dict[int, int], int], list[tuple]]) -> DataFrame:
    """pieces with sequence_id and offset. pieces has length (1 to capacity) and ids_crc32, and
    is read several times: give a checkpointed one, whose rows stay in their partitions, as
    these take part in the salt. Rows with equal columns take any order. No pieces: no rows.

    The plan is bounded by capacity alone (a pattern uses up a length, or leaves less of it
    than one bin holds), so its segments are broadcast."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    segments = planner(histogram, capacity)
    total = sum(histogram.values())
    salts = min(1 << 16, max(64, 1 << (total // CELL).bit_length()))
    key = ["length", "salt"]
    # the text and the partition, so that rows with one doc_id, or none, or one text are dealt apart
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(salts)))
    cells = salted.groupBy(*key).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(*key, F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("within", within).join(cells, key).withColumn("rank", F.col("before") + F.col("within") - 1)
    return _placed(ranked, pieces.columns, segments)


def pack_in_place(pieces: DataFrame, capacity: int, planner: Callable[[dict[int, int], int], list[tuple]]) -> DataFrame:
    """As pack, but pieces with large columns are not dealt by length for their ranks: each
    partition numbers its own, from where the partitions before it end. pieces must be a
    checkpointed table, whose rows keep their partitions and their order. What the partitions
    begin with is a row per partition and length; beyond CELLS of them pack does the work."""
    cells = cut(pieces.groupBy(F.spark_partition_id().alias("part"), "length").agg(F.count("*").alias("n")))
    if cells.count() > CELLS:
        return pack(pieces, capacity, planner)
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    at = pieces.columns.index("length")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            length = batch.column(at).to_numpy()
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.searchsorted(ordered, ordered)
            within = np.empty(len(length), np.int64)
            within[order] = np.arange(len(length)) - first + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(within)], names=[*batch.schema.names, "within"])

    counted = pieces.mapInArrow(number, T.StructType([*pieces.schema.fields, T.StructField("within", T.LongType())])).withColumn("part", F.spark_partition_id())
    ranked = counted.join(F.broadcast(cells), ["part", "length"]).withColumn("rank", F.col("before") + F.col("within"))
    return _placed(ranked, pieces.columns, planner(histogram, capacity))


def _placed(ranked: DataFrame, columns: list[str], segments: list[tuple]) -> DataFrame:
    """ranked pieces (length, rank) with the places that the plan's segments give them."""
    spark = ranked.sparkSession
    table = F.broadcast(spark.createDataFrame(segments, SEGMENT).withColumnRenamed("length", "of"))
    placed = ranked.join(table, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    step = F.col("rank") - F.col("lo")
    return placed.select(
        *columns,
        (F.col("first") + F.floor(step / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + step % F.col("per") * F.col("length")).cast("long").alias("offset"),
    )


def best_fit_packing(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Documents packed by best-two-fit: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset; one row per piece. See split_tokens for null, empty and long
    texts and repeated rows; extra columns of docs are ignored."""
    return pack(cut(split_tokens(docs, path, capacity)), capacity, best_two_fit)
