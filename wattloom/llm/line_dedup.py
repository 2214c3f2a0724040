"""Exact line deduplication by a range-partitioned, sorted stream of line hashes.

Every line whose key is long enough becomes a row (128-bit hash, document, position). The
rows are dealt to ranges of (hash, document from the largest, position) and sorted in their
range, so that all holders of a key pass one after the other and the first is the one that
keeps it. A range is cut anywhere, also inside a key that a third of all documents hold: a
task decides what it sees whole, puts out the lines of its first key undecided, and a
summary of its first and last key (two rows a task); the summaries, joined by key, decide
the rest. The result is a compressed bitmap of kept lines per document, never its text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.llm import text as tx
from wattloom.session import cut, ship

#: Fewest code points of a key, and fewest documents that share it.
LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
WHITE = b" \t\n\x0b\x0c\r"
DROP, OPEN, SUMMARY = 0, 1, 2
#: Stands for a missing doc_id, which comes below all others.
NO_ID = -(1 << 63)


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """A row per line with a long enough key: h1, h2, doc, text_key, position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, 2):
            owner, position, digests = [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                for k, line in enumerate((text or b"").split(b"\n")):
                    if len(line) < least_chars:
                        continue
                    key = line.strip(WHITE).lower()  # of bytes: A-Z alone
                    if len(key) >= least_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= least_chars):
                        owner.append(i)
                        position.append(k)
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(at), batch.column(1).take(at), pa.array(position, pa.int32())], names=["h1", "h2", "doc", "text_key", "position"])

    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_key(F.col("text")).alias("text_key"), "text")
    return source.mapInArrow(run, "h1 long, h2 long, doc long, text_key long, position int")


class _Stream:
    """One range, in order. Documents of a key are numbered from 1; the first keeps its
    lines. Lines of documents 2 to least - 1 wait until the least-th comes; what follows is
    dropped at once."""

    def __init__(self, least: int):
        self.least = least
        self.key: tuple[int, int] | None = None
        self.leading = True  # still in the first key of the range
        self.count = self.first = self.last = 0
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.out: list[tuple[int, tuple[np.ndarray, ...]]] = []

    def summary(self) -> None:
        """Of the key that ends here: documents, the first and the last of them."""
        one = lambda *v: tuple(np.array([x], np.int64) for x in v)
        self.out.append((SUMMARY, one(*self.key, self.first, self.count, self.last)))

    def batch(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, text_key: np.ndarray, position: np.ndarray) -> None:
        new_key = np.ones(len(h1), bool)
        new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        same = self.key == (int(h1[0]), int(h2[0]))
        new_key[0] = not same
        new_doc = new_key.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        if same:
            new_doc[0] = doc[0] != self.last
        if not same and self.key is not None:
            self._close()
        running = np.cumsum(new_doc)
        group = np.cumsum(new_key)  # 0: the key that the batch before has begun
        heads = np.flatnonzero(new_key)
        before = np.concatenate(([-self.count if same else 0], running[heads] - 1))
        rank = running - before[group]
        ends = np.append(heads, len(h1))[0 if same else 1 :] - 1  # last row of each group here
        total = np.zeros(int(group[-1]) + 1, np.int64)
        total[group[ends]] = rank[ends]
        columns = (h1, h2, doc, text_key, position)
        take = lambda m: tuple(c[m] for c in columns)
        leading = (group == (0 if same else 1)) if self.leading and (same or self.key is None) else np.zeros(len(h1), bool)
        here = total[group] >= self.least
        if same and not self.leading and total[0] >= self.least:
            self._flush()
        tail = group == group[-1]
        drop = ~leading & here & (rank > 1)
        wait = ~leading & ~here & (rank > 1) & tail
        if leading.any():
            self.out.append((OPEN, take(leading)))
        if drop.any():
            self.out.append((DROP, take(drop)))
        if len(heads) and same:
            # the key of the batch before ends inside this one
            self.count, self.last = int(total[0]), int(doc[heads[0] - 1])
            self._close()
        if len(heads):
            if self.leading and group[-1] > 1 and self.key is None:  # the first key of the range ends here too
                a, b = int(heads[0]), int(heads[1]) - 1
                self.key, self.first, self.last, self.count = (int(h1[a]), int(h2[a])), int(doc[a]), int(doc[b]), int(total[1])
                self._close()
            head = int(heads[-1])
            self.key, self.first = (int(h1[head]), int(h2[head])), int(doc[head])
            self.waiting = []
        self.count, self.last = int(total[-1]), int(doc[-1])
        if wait.any():
            self.waiting.append(take(wait))

    def _flush(self) -> None:
        self.out += [(DROP, w) for w in self.waiting]
        self.waiting = []

    def _close(self) -> None:
        """The current key ends inside the range."""
        if self.leading:
            self.summary()
        self.leading = False
        self.waiting = []

    def end(self) -> None:
        if self.key is not None:
            self.summary()
            self.out += [(OPEN, w) for w in self.waiting]
            self.waiting = []

    def take(self) -> Iterator[pa.RecordBatch]:
        for kind, columns in self.out:
            n = len(columns[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(np.asarray(c, np.int64)) for c in columns)], names=["kind", "h1", "h2", "doc", "text_key", "position"])
        self.out = []


def _streamed(lines: DataFrame, least: int, ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(least)
        for batch in batches:
            if batch.num_rows:
                stream.batch(*(batch.column(k).to_numpy() for k in range(5)))
                yield from stream.take()
        stream.end()
        yield from stream.take()

    # the last column of the order lets a range end between equal rows
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("text_key"), F.col("position")]
    dealt = lines.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(ranges, *order, F.col("row"))
    kinds = "kind int, h1 long, h2 long, doc long, text_key long, position long"
    return dealt.sortWithinPartitions(*order).select("h1", "h2", "doc", "text_key", "position").mapInArrow(run, kinds).withColumn("range", F.spark_partition_id())


def _dropped(lines: DataFrame, least: int) -> DataFrame:
    """doc, text_key, position of every line that goes."""
    spark = lines.sparkSession
    # computed once, as both what is open and the summaries come from the same ranges
    seen = cut(_streamed(lines, least, _ranges(spark)))
    # summaries: in the columns doc (first document), text_key (documents), position (last document)
    s = seen.where(F.col("kind") == SUMMARY).select("h1", "h2", "range", F.col("doc").alias("first"), F.col("text_key").alias("n"), F.col("position").alias("last"))
    shared = F.coalesce((F.lag("last").over(Window.partitionBy("h1", "h2").orderBy("range", F.desc("first"))) == F.col("first")).cast("long"), F.lit(0))
    verdict = s.withColumn("n", F.col("n") - shared).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("first").alias("keeper")).where(F.col("n") >= least).drop("n")
    # at most two keys a range
    left = seen.where(F.col("kind") == OPEN).join(F.broadcast(verdict), ["h1", "h2"]).where("doc <> keeper")
    return seen.where(F.col("kind") == DROP).select("doc", "text_key", "position").unionByName(left.select("doc", "text_key", "position"))


def _ranges(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack_bitmap(n: int, dropped: list[int]) -> bytes:
    """A bit per line, 1 where it stays, deflated."""
    keep = np.ones(n, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack_bitmap(n: int, bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, text_key, n_lines, n_dropped, keep: the compressed bitmap of the lines that
    stay, of every distinct (doc_id, text) of docs.

    Lines are what stands between \\n (a null or empty text is one empty line). A line's key
    is the line without ASCII white space at both ends, A-Z lower-cased. Keys of least_chars
    code points or more that least_documents or more documents hold stay in the largest
    doc_id alone, there as often as they stand in it. Rows with one doc_id are one document;
    rows without a doc_id are together the smallest. Equal rows share one bitmap row.
    Extra columns are ignored, an empty table gives no rows."""
    spark = docs.sparkSession
    ship(spark)
    gone = _dropped(_lines(docs, least_chars), least_documents)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("long")
    heads = docs.select(doc, text_key(F.col("text")).alias("text_key"), n_lines.alias("n_lines"), F.lit(None).cast("long").alias("position"))
    each = heads.unionByName(gone.withColumn("n_lines", F.lit(None).cast("long"))).groupBy("doc", "text_key").agg(F.max("n_lines").alias("n_lines"), F.collect_set("position").alias("dropped"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dropped = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([len(d) for d in dropped], pa.int64()), pa.array([pack_bitmap(a, d) for a, d in zip(n, dropped)], pa.binary())], names=["doc_id", "text_key", "n_lines", "n_dropped", "keep"])

    out = each.mapInArrow(run, "doc_id long, text_key long, n_lines long, n_dropped long, keep binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def kept_digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of docs: its lines that the
    bitmap keeps, joined by \\n. Rows without dropped lines never meet a bitmap."""
    ship(docs.sparkSession)
    few = bitmaps.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.col("text_key").alias("key"), "n_lines", "n_dropped", F.when(F.col("n_dropped") > 0, F.col("keep")).alias("keep"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, 3):
            out = []
            for n, bitmap, text in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist()):
                if bitmap is not None:
                    lines = text.split(b"\n")
                    text = b"\n".join([x for x, k in zip(lines, unpack_bitmap(n, bitmap).tolist()) if k])
                out.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    joined = rows.join(few, ["doc", "key"]).select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_lines", "n_dropped", "text", "keep")
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE_SQL = """
with parts as (select doc_id, coalesce(text, '') t, string_split(coalesce(text, ''), chr(10)) ls from documents),
numbered as (select row_number() over () id, * from parts),
lines as (select id, doc_id, unnest(ls) line, unnest(range(len(ls))) pos from numbered),
keys as (
  select id, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
  from lines),
shared as (select k, max(doc_id) keeper from keys where length(k) >= 40 group by 1 having count(distinct doc_id) >= 5),
marked as (select a.*, s.k is not null and a.doc_id is distinct from s.keeper dropped from keys a left join shared s on a.k = s.k)
select doc_id, count(*) n_lines, count(*) filter (where dropped) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) kept_sha256
from marked group by id, doc_id
"""
