"""Ranked lexical search: term at a time, with limited accumulators.

The corpus is an index sharded by documents. A first map turns each document into its counts
of those terms that items ask for; from these come the sums that weights need (documents,
terms, documents per term). Then every task works through its shard in blocks: a block's
postings are sorted by term, and each item takes its terms rarest first. A document gets an
accumulator when a term first touches it; as soon as the most that the terms still to come
can add is below the k-th best partial score, no new accumulator can reach the result, so
later terms update only those that exist, each exactly. Blocks of a task hand on the k-th
best score, and each task puts out k rows an item at most.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm import text as tx
from wattloom.session import cut, scratch, ship

#: Characters of items that one pass answers; a larger benchmark takes several passes.
ITEMS = 1 << 23
#: Postings of a block of documents.
BLOCK = 1 << 21
#: Groups of tasks whose best rows are first compared among themselves.
GROUPS = 64

# ASCII but letters and digits parts terms, A-Z become a-z, other bytes stay
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return (text or b"").translate(_TABLE).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _indexed(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms), ids and tfs (asked-for terms and their counts) of each row that has terms."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of items of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in tx.slices(batches, 1):
            n, at, ids, tfs = [], [], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                if words := terms(text):
                    found = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
                    term, tf = np.unique(found[found >= 0], return_counts=True)
                    n.append(len(words))
                    at.append(i)
                    ids.append(term)
                    tfs.append(tf.astype(np.int32))
            offsets = pa.array(np.cumsum([0] + [len(x) for x in ids[1:]]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "ids", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<int>")


class Shard:
    """Postings of a block of documents: for each asked-for term its documents and what one
    occurrence of the term in an item adds to their scores."""

    def __init__(self, n: np.ndarray, term: np.ndarray, owner: np.ndarray, tf: np.ndarray, weights: np.ndarray, documents: int, length: int):
        m = 75 + (25 * n * documents) // max(length, 1)
        order = np.argsort(term, kind="stable")
        term, tf = term[order], tf[order].astype(np.int64)
        self.doc = owner[order]
        self.gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[self.doc]))
        self.start = np.searchsorted(term, np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        held = np.flatnonzero(np.diff(self.start))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.gain, self.start[held])
        self.scores = np.zeros(len(n), np.int64)
        self.open = np.zeros(len(n), bool)
        self.touched = 0  # accumulators made so far, over all items

    def search(self, item: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the block that may be among the k best, and their exact scores.
        item: (term, times), rarest first. Scores under floor are known not to matter."""
        item = [(t, times) for t, times in item if self.start[t + 1] > self.start[t]]
        rest = sum(self.most[t] * times for t, times in item)
        live = np.zeros(0, np.int64)
        limited = False
        for t, times in item:
            docs, gain = self.doc[self.start[t] : self.start[t + 1]], self.gain[self.start[t] : self.start[t + 1]]
            if not limited:
                bar = floor
                if len(live) >= k:
                    bar = max(bar, int(np.partition(self.scores[live], len(live) - k)[len(live) - k]))
                limited = rest < bar  # what only these terms would score
                if limited:
                    live = np.sort(live)
            if limited:  # survivors alone: a document stands once in a list, in rising order
                if not len(live):
                    break
                at = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
                hit = docs[at] == live
                self.scores[live[hit]] += gain[at[hit]] * times
            else:
                new = docs[~self.open[docs]]
                self.open[new] = True
                live = np.concatenate((live, new))
                self.scores[docs] += gain * times
            rest -= self.most[t] * times
        scores = self.scores[live]
        self.touched += len(live)
        self.scores[live] = 0
        self.open[live] = False
        good = (scores > 0) & (scores >= floor)
        return live[good], scores[good]


def _best(index: DataFrame, items: list[list[tuple[int, int]]], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """item, doc_id, score: of each task and item its k best documents."""
    sent = index.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        # smallest first: (score, -doc_id), a missing id below all others
        heaps: list[list[tuple[int, float]]] = [[] for _ in items]

        def answer(rows: list[pa.RecordBatch]) -> None:
            ids, n, terms_, tfs = [], [], [], []
            for b in rows:
                ids += b.column(0).to_pylist()
                n.append(b.column(1).to_numpy())
                terms_.append(b.column(2))
                tfs.append(b.column(3).flatten().to_numpy())
            count = np.concatenate([x.value_lengths().to_numpy() for x in terms_])
            shard = Shard(np.concatenate(n), np.concatenate([x.flatten().to_numpy() for x in terms_]), np.repeat(np.arange(len(count)), count), np.concatenate(tfs), weights, documents, length)
            for item, heap in zip(items, heaps):
                docs, scores = shard.search(item, k, heap[0][0] if len(heap) == k else 0)
                if len(docs) > k:
                    enough = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    docs, scores = docs[enough], scores[enough]
                for d, s in zip(docs.tolist(), scores.tolist()):
                    row = (s, -math.inf if ids[d] is None else -ids[d])
                    if len(heap) < k:
                        heapq.heappush(heap, row)
                    elif row > heap[0]:
                        heapq.heapreplace(heap, row)

        rows, size = [], 0
        for batch in batches:
            if batch.num_rows:
                rows.append(batch)
                size += len(batch.column(2).flatten()) + batch.num_rows
                if size >= BLOCK:
                    answer(rows)
                    rows, size = [], 0
        if rows:
            answer(rows)
        out = [(i, None if d == -math.inf else -d, s) for i, heap in enumerate(heaps) for s, d in heap]
        if out:
            item, doc, score = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def _top(best: DataFrame, k: int) -> DataFrame:
    """The k best of each item: first in groups of tasks, then of all groups."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = best.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("group")


def _answer(docs: DataFrame, items: list[tuple[int | None, str | None]], k: int) -> DataFrame:
    spark = docs.sparkSession
    words = [Counter(terms((t or "").encode("utf-8", "surrogatepass"))) for _, t in items]
    vocabulary = {w: i for i, w in enumerate(sorted({w for c in words for w in c}))}
    index = cut(_indexed(docs, vocabulary))
    documents, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for t, n in index.select(F.explode("ids").alias("t")).groupBy("t").count().collect():  # a row per term of the items
        df[t] = n
    weights = np.array([weight(documents, int(n)) for n in df], np.int64)
    asked = [sorted(((vocabulary[w], n) for w, n in c.items() if weights[vocabulary[w]]), key=lambda x: (df[x[0]], x[0])) for c in words]
    top = _top(_best(index, asked, weights, documents, length, k), k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "item int, item_id long")
    return top.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best rows of docs (doc_id, text) for every row of
    items (item_id, text), with a score above 0; fewer where fewer have one.

    Terms, weights and scores are whole numbers (see weight and Shard). Equal scores rank by
    ascending doc_id, rows without one last. Repeated rows of docs are each a document and
    each row of items is an item, so a repeated one is answered twice. Texts that are null or
    without terms match nothing and do not count as documents. Extra columns are ignored; an
    empty table gives no rows. Items go to tasks in passes of at most ITEMS characters each:
    with more than one, each pass is written to the shared folder before the next."""
    spark = docs.sparkSession
    ship(spark)
    block: list[tuple[int | None, str | None]] = []
    size, path = 0, ""
    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        if block and size + len(row[1] or "") > ITEMS:
            path = path or scratch(spark, "search")
            _answer(docs, block, k).write.mode("append").parquet(path)
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1] or "")
    last = _answer(docs, block, k)
    return spark.read.parquet(path).unionByName(last) if path else last


ORACLE_SQL = r"""
with docs as (
  select id, doc_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term
  from (select id, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from (select row_number() over () id, doc_id, text from documents))),
postings as (select id, doc_id, term, count(*)::bigint tf from docs group by all),
sizes as (select id, sum(tf)::bigint n from postings group by 1),
corpus as (select count(*)::bigint nd, sum(n)::bigint l from sizes),
norms as (select id, 100 - 25 + ((25 * n * nd) // l) m from sizes, corpus),
dfs as (select term, count(*)::bigint df from postings group by 1),
weights as (select term, floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1)::double))::bigint w from dfs, corpus),
asked as (
  select item, item_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term, count(*)::bigint times
  from (select item, item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from (select row_number() over () item, item_id, text from benchmark)) group by all),
scores as (
  select item, item_id, p.id, p.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint score
  from asked join postings p using (term) join weights using (term) join norms on norms.id = p.id group by all),
ranked as (select *, row_number() over (partition by item order by score desc, doc_id nulls last) "rank" from scores where score > 0)
select item_id, "rank"::int "rank", doc_id, score from ranked where "rank" <= 20
"""
