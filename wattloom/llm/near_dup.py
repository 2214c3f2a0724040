"""Near-duplicate classes by improved consistent weighted sampling (ICWS).

A text is a weighted set of its five-word shingles: weight = term frequency times
an inverse document frequency, the mean over the shingle's words of
1 + ln(N / df) / ln(1 / COMMON), taken in steps of 1/8. Words in fewer than a share
COMMON of the documents all have the top value 2, so the table of word frequencies
that tasks need has at most (mean distinct words of a document) / COMMON rows,
whatever the corpus size; frequencies are exact counts over all documents.

ICWS gives HASHES samples a text; two texts agree in each with probability equal to
their weighted Jaccard similarity. BANDS bands of ROWS samples are bucket keys. In a
bucket all others are compared with one leader; a bucket whose texts are then all in one
class is done. Buckets that stay divided go on with the text of most links as leader while
that pays. What is left is compared pair by pair: pairs of different classes, except those
whose samples agree so rarely that the pair cannot be similar (see AGREE). Buckets of more
than SMALL texts are compared by blocks inside tasks that put out links alone. Every link is an exact weighted
Jaccard similarity of whole texts.

A node is a distinct text, so rows without a doc_id, or several texts under one, are compared
like any other. Buckets, hubs and groups of copies that hold much of the table are hot keys
(see components).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm import text as tx
from wattloom.llm.components import components, hot_keys, hot_limit, join_hot, some, tidy
from wattloom.session import cut, few, ship

WORDS = 5
COMMON = 0.01
BANDS, ROWS = 16, 4
HASHES = BANDS * ROWS
STEP = 8
#: Of HASHES samples, two texts at the threshold 0.8 agree in fewer than this with a
#: probability below 1e-6 (binomial): such pairs of a divided bucket are not compared.
AGREE = 35
#: Leaders' rounds end when the pairs left are this many for each bucket entry, or fell by
#: less than a fifth.
PAIRS_PER_ENTRY = 4
SMALL = 32
#: Texts, and bytes of text, that a block holds on average.
BLOCK, BLOCK_BYTES = 512, 8_000_000
#: Pairs of texts, and texts, for a task at least where there are many tasks.
PAIRS, TEXTS = 500, 2_000
_POOL = 12
_U = np.uint64


def word_frequencies(docs: DataFrame) -> DataFrame:
    """(word, df) of the words, as hashes, that at least a share COMMON of the texts has."""
    ship(docs.sparkSession)

    def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
        w, c = (np.concatenate(x) for x in zip(*parts))
        w, at = np.unique(w, return_inverse=True)
        return w, np.bincount(at, c, len(w)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], names=["word", "n"])
        for batch in tx.slices(batches, 0):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for lo, hi in tx.chunks(texts):
                _, _, _, h, first = tx.words(texts[lo:hi])
                owner = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(first))
                _, once = np.unique(h * _U(0x9E3779B97F4A7C15) + tx.mix(owner), return_index=True)
                parts.append(np.unique(h[once], return_counts=True))
                if len(parts) >= 16:
                    parts = [merge(parts)]
                    if len(parts[0][0]) > 1_000_000:
                        w, c = parts.pop()
                        yield out()
        if parts:
            w, c = merge(parts)
            yield out()

    counted = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("df"))
    total = docs.count()
    return counted.where(F.col("df") >= COMMON * total)


def idf_table(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the common words, sorted, and their values: a bounded table (see above)."""
    total = docs.count()
    rows = word_frequencies(docs).collect()
    words = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    value = np.array([1 + math.log(total / r["df"]) / math.log(1 / COMMON) for r in rows])
    order = np.argsort(words)
    return words[order], value[order]


def weighted_shingles(texts: list[str], idf: tuple[np.ndarray, np.ndarray]):
    """Distinct shingles of each text: 40-bit hash, weight in steps of 1/STEP, and each
    text's first shingle (one more entry past the end). Sorted by hash in a text."""
    _, _, _, h, first = tx.words(texts)
    value = np.full(len(h) + WORDS, 2.0)
    if len(idf[0]) and len(h):
        at = np.minimum(np.searchsorted(idf[0], h), len(idf[0]) - 1)
        common = idf[0][at] == h
        value[: len(h)][common] = idf[1][at[common]]
    sh, at = tx.shingles(h, first, WORDS)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    count = np.diff(first)
    size = np.minimum(count[owner], WORDS)
    acc = np.concatenate((np.zeros(1), np.cumsum(value)))
    begin = first[owner] + np.arange(len(sh)) - at[owner]
    level = np.rint(STEP * (acc[begin + size] - acc[begin]) / np.maximum(size, 1)).astype(np.uint64)
    key = (owner.astype(np.uint64) << _U(45)) | ((sh >> _U(24)) << _U(5)) | level
    key.sort()
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    where = np.flatnonzero(new)
    tf = np.diff(np.append(where, len(key)))
    key = key[where]
    per = np.bincount((key >> _U(45)).astype(np.int64), minlength=len(texts))
    bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(per)))
    return (key >> _U(5)) & _U((1 << 40) - 1), (key & _U(31)).astype(np.int64) * tf, bounds


@lru_cache(1)
def _variates():
    """ICWS variates r, ln c, beta of each sample and pool entry; for single
    occurrences also the finished keys of each weight step."""
    rng = np.random.Generator(np.random.PCG64(7))
    shape = (HASHES, 1 << _POOL)
    r = rng.gamma(2.0, 1.0, shape)
    c = np.log(rng.gamma(2.0, 1.0, shape))
    beta = rng.random(shape)
    odd = rng.integers(1, 1 << 62, (2, HASHES), dtype=np.uint64) * _U(2) + _U(1)
    table = np.stack([_keys(r, c, beta, np.full(shape, math.log(w / STEP))) for w in range(STEP, 2 * STEP + 1)], 1)
    return r, c, beta, odd, table.reshape(HASHES, -1)


def _keys(r, c, beta, log_weight):
    """High half: ln a as an ordered integer; low half: a mark of t."""
    t = np.floor(log_weight / r + beta)
    a = (c - r * (t - beta) - r).astype(np.float32)
    bits = a.view(np.uint32)
    ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
    return (ordered << _U(32)) | (tx.mix(t.astype(np.int64).view(np.uint64)) >> _U(32))


def signatures(texts: list[str], idf) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys, one row per text, one column per band, and the samples; 0 where a text has no word."""
    r, c, beta, odd, table = _variates()
    h, weight, bounds = weighted_shingles(texts, idf)
    out = np.zeros((len(texts), BANDS), np.uint64)
    samples = np.zeros((len(texts), HASHES), np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return out.view(np.int64), samples.view(np.int32)
    at = bounds[some]
    h = tx.mix(h)
    plain = weight <= 2 * STEP
    shift = np.where(plain, weight - STEP, 0) << _POOL
    more = np.flatnonzero(~plain)
    log_more = np.log(weight[more] / STEP)
    band = np.zeros(len(some), np.uint64)
    for k in range(HASHES):
        entry = (h * odd[0, k]) >> _U(64 - _POOL)
        key = table[k][entry.view(np.int64) + shift]
        if len(more):
            e = entry[more].view(np.int64)
            key[more] = _keys(r[k, e], c[k, e], beta[k, e], log_more)
        key ^= (h * odd[1, k]) >> _U(32)
        sample = np.minimum.reduceat(key, at) % _U(1 << 32)
        samples[some, k] = sample
        band = tx.mix(band * _U(0xD1342543DE82EF95) + sample)
        if k % ROWS == ROWS - 1:
            out[some, k // ROWS] = tx.mix(band + _U(k))
            band = np.zeros(len(some), np.uint64)
    return out.view(np.int64), samples.view(np.int32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    low = int(np.minimum(a[1][both], b[1][at[both]]).sum())
    total = int(a[1].sum() + b[1].sum()) - low
    return low / total if total else 0.0


def _sketch(docs: DataFrame, idf) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in tx.chunks(texts):
                keys, samples = signatures(texts[lo:hi], idf)
                written = [t.encode() for t in texts[lo:hi]]
                digests = [hashlib.md5(t).digest() for t in written]
                rows = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
                marks = pa.FixedSizeListArray.from_arrays(pa.array(samples.ravel()), HASHES).cast(pa.list_(pa.int32()))
                sizes = pa.array(list(map(len, written)), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(digests, pa.binary()), sizes, rows, marks], names=["doc_id", "digest", "size", "keys", "samples"])

    return docs.where("text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, digest binary, size long, keys array<long>, samples array<int>")


def _verify(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts have at least that similarity. a may stand in very many
    pairs: its text is then copied to as many tasks as they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, 2, 3):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            # a leader stands in many rows: its text is weighed once a slice
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            own: dict[str, tuple] = {}
            todo = list(dict.fromkeys([*left, *right]))
            for lo, hi in tx.chunks(todo):
                h, w, at = weighted_shingles(todo[lo:hi], idf)
                for i in range(lo, hi):
                    own[todo[i]] = h[at[i - lo] : at[i - lo + 1]], w[at[i - lo] : at[i - lo + 1]]
            keep = [similarity(own[x], own[y]) >= threshold for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(a, keep) if k], pa.int64()), pa.array([x for x, k in zip(b, keep) if k], pa.int64())], names=["a", "b"])

    rows = pairs.count()
    hot = hot_keys(pairs, "a", rows)
    own = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    other = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    if hot is None:
        both = pairs.join(own, "b").join(other, "a")
    else:
        parts = F.coalesce(F.ceil(F.col("n") / hot_limit(rows)), F.lit(1)).cast("int")
        spread = pairs.join(F.broadcast(hot), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("salt"))
        copies = other.join(F.broadcast(hot), "a", "left").select("a", "text_a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
        both = spread.join(own, "b").join(copies, ["a", "salt"])
    return few(both.select("a", "b", "text_a", "text_b"), rows, PAIRS).mapInArrow(run, "a long, b long")


def _digest(text: str = "text"):
    return F.unhex(F.md5(text))


def _name(doc_id: str = "doc_id"):
    """doc_id as a join key without nulls."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def _classified(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of every row with a text, and of each distinct text: digest, doc_id
    (its least), n (its rows), class_id and class_key."""
    spark = docs.sparkSession
    ship(spark)
    idf = idf_table(docs)
    sketch = cut(_sketch(docs, idf))
    total = sketch.count()
    reps = sketch.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("samples").alias("samples"))
    reps = cut(few(reps, total).withColumn("node", F.monotonically_increasing_id()))
    # the first leader of a bucket is its text of least doc_id: copies tend to be near an original
    entries = reps.select("node", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("age"), F.posexplode("keys").alias("band", "key")).where("key <> 0").select("node", "age", "band", F.xxhash64("band", "key").alias("key"))
    shared = entries.groupBy("key").agg(F.min_by("node", "age").alias("low"), F.count("*").alias("n")).where("n > 1")
    entries = entries.drop("age")
    shared = cut(few(shared, BANDS * total))
    labels = spark.createDataFrame([], "node long, label long")
    if size := shared.agg(F.sum("n")).first()[0]:
        entries = cut(few(join_hot(entries, shared.select("key", "low"), "key", some(shared.where(F.col("n") > hot_limit(size)).select("key"))), size))
        labels = _classes(docs, reps, entries, size, idf, threshold)
    texts = reps.select("node", "digest", "doc_id", "n").join(labels, "node", "left").select("digest", "doc_id", "n", F.coalesce("label", "node").alias("label"))
    group = texts.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min(F.hex("digest")).alias("class_key"))
    classes = cut(few(join_hot(texts, group, "label", hot_keys(labels, "label", size or 0)).drop("label"), total))
    return sketch.select("doc_id", "digest"), classes


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least doc_id of its class), class_key
    (a name of the class that is never null for a text), kept.

    Texts are in one class if a chain of exact copies, or of texts with a weighted
    Jaccard similarity of at least threshold, joins them. kept marks the rows whose doc_id
    is the class_id, and all rows of a class without any. Rows without a doc_id are compared
    like others; their class_id is null if no member has one. Each row is in the class of its own text, so a doc_id with two
    texts may be in two classes. A null text is in a class of its own, without a class_key;
    empty texts are exact copies of each other; a text of fewer than five words is one
    shingle. Extra columns are ignored. No rows give no rows."""
    rows, classes = _classified(docs, threshold)
    total = classes.agg(F.sum("n")).first()[0] or 0
    named = classes.select(F.xxhash64("digest").alias("mark"), F.col("digest").alias("of"), "class_id", "class_key")
    hot = some(classes.where(F.col("n") > hot_limit(total)).select(F.xxhash64("digest").alias("mark")))
    out = join_hot(rows.withColumn("mark", F.xxhash64("digest")), named, "mark", hot).where((F.col("digest") <= F.col("of")) & (F.col("digest") >= F.col("of")))
    alone = docs.where("text is null").select(F.col("doc_id").cast("long"), F.col("doc_id").cast("long").alias("class_id"), F.lit(None).cast("string").alias("class_key"))
    return out.select(*alone.columns).unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def _hot_texts(counted: DataFrame) -> DataFrame | None:
    """The digests of counted (digest, n) that over 1 / HOT of the rows have; None if none has."""
    return some(counted.where(F.col("n") > hot_limit(counted.agg(F.sum("n")).first()[0] or 0)).select("digest"))


def _classes(docs: DataFrame, reps: DataFrame, entries: DataFrame, size: int, idf, threshold: float) -> DataFrame:
    """(node, label) of the nodes with links. entries, of so many rows: node, band, key, low
    (the key's leader)."""
    wanted = entries.select("node").distinct().join(reps.select("node", "digest", _name().alias("name")), "node")
    own = docs.where("text is not null").select(_digest().alias("digest"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("name"), "text")
    hot = _hot_texts(reps)
    if hot is None:
        one = own.join(wanted, ["digest", "name"])
    else:  # rows of a text that very many share become one in the tasks that read them
        same = own.join(F.broadcast(hot), "digest", "left_semi").groupBy("digest", "name").agg(F.first("text").alias("text"))
        one = own.join(F.broadcast(hot), "digest", "left_anti").unionByName(same).join(wanted, ["digest", "name"])
    texts = one.groupBy("digest", "name").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text")
    texts = cut(few(texts, size, TEXTS))
    pairs = entries.select(F.col("low").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    links = None
    before = math.inf
    while True:
        found = cut(_verify(cut(few(pairs, size)), texts, idf, threshold))
        links = found if links is None else links.union(found)
        labels = components(links)
        labelled = few(entries.select("key", "band", "node").join(labels, "node", "left").select("key", "band", "node", F.coalesce("label", "node").alias("label")), size)
        kinds = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
        divided = kinds.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("square"), F.count("*").alias("kinds"))
        divided = divided.where("kinds > 1").select("key", "n", ((F.col("n") * F.col("n") - F.col("square")) / 2).alias("pairs"))
        divided = cut(few(divided, size))
        rows, left = divided.agg(F.sum("n"), F.sum("pairs")).first()
        if not left:
            return labels
        hot = some(divided.where(F.col("n") > hot_limit(rows)).select("key"))
        entries = cut(few(join_hot(labelled, divided.select("key", "n"), "key", hot), rows))
        del found, pairs, labelled, kinds, divided
        tidy(entries)
        if left <= PAIRS_PER_ENTRY * rows or left > 0.8 * before:
            small = _verify(cut(few(_small_pairs(entries.where(F.col("n") <= SMALL), reps).distinct(), SMALL * rows)), texts, idf, threshold)
            large = _compare_blocks(entries.where(F.col("n") > SMALL), rows, reps, texts, idf, threshold)
            return components(links.union(cut(small.union(large))))
        before, size = left, rows
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        ranked = entries.join(degree, "node", "left").select("key", "node", "label", F.coalesce("degree", F.lit(0)).alias("degree"))
        lead = ranked.groupBy("key").agg(F.max(F.struct("degree", "node", "label")).alias("lead"))
        ahead = join_hot(entries, lead, "key", hot).where("label <> lead.label")
        pairs = ahead.select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct()


def _small_pairs(entries: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of different labels whose samples agree often enough; at most SMALL
    partners for an entry."""
    marked = entries.join(reps.select("node", "samples"), "node")
    x = marked.select("key", F.col("node").alias("a"), F.col("label").alias("la"), F.col("samples").alias("sa"))
    y = marked.select(F.col("key").alias("key_b"), F.col("node").alias("b"), F.col("label").alias("lb"), F.col("samples").alias("sb"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda p, q: (p == q).cast("int")), F.lit(0), lambda n, p: n + p)
    return x.join(y, (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (agree >= AGREE)).select("a", "b")


def _partners(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of two blocks (or of one) and the later rows that each may be similar to: those of
    another label whose samples agree, and whose first shared bucket is this one."""
    label, block = (np.array(table[c].to_pylist(), np.int64) for c in ("label", "block"))
    band = table["band"][0].as_py()
    marks = table["samples"].combine_chunks().flatten().to_numpy().reshape(-1, HASHES)
    alone = block.min() == block.max()
    for i in np.flatnonzero(block == block.min()).tolist():
        others = np.flatnonzero((np.arange(len(label)) > i) if alone else (block != block[i]))
        others = others[label[others] != label[i]]
        same = marks[others] == marks[i]
        yield i, others[(same.sum(1) >= AGREE) & ~same.reshape(-1, BANDS, ROWS).all(2)[:, :band].any(1)]


def _compare_blocks(entries: DataFrame, size: int, reps: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Links between texts of different labels in one bucket: entries (key, band, node,
    label, n), at most so many. Blocks of at most about BLOCK texts and BLOCK_BYTES bytes go against blocks, so
    a task holds two blocks and a text is sent once for every block of its bucket."""

    def run(table: pa.Table) -> pa.Table:
        node, label = (np.array(table[c].to_pylist(), np.int64) for c in ("node", "label"))
        written = table["text"].to_pylist()
        weighed = []
        for lo, hi in tx.chunks(written):
            h, w, at = weighted_shingles(written[lo:hi], idf)
            weighed += [(h[at[i] : at[i + 1]], w[at[i] : at[i + 1]]) for i in range(hi - lo)]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        a, b = [], []
        for i, others in _partners(table):
            for j in others.tolist():
                x, y = root(int(label[i])), root(int(label[j]))
                if x != y and similarity(weighed[i], weighed[j]) >= threshold:
                    parent[x] = y
                    a.append(int(node[i]))
                    b.append(int(node[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    marks = reps.select("node", "samples")
    sized = entries.join(reps.select("node", "size"), "node")
    most = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int")
    blocks = cut(few(sized.groupBy("key").agg(most.alias("blocks"), F.count("*").alias("n")), size))
    rows = blocks.agg(F.sum("n")).first()[0] or 0
    own = join_hot(entries.drop("n"), blocks.select("key", "blocks"), "key", some(blocks.where(F.col("n") > hot_limit(rows)).select("key")))
    own = own.withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    whole = few(own.join(marks, "node").join(texts, "node"), rows, TEXTS).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = whole.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "band", "node", "label", "block", "samples", "text")
    return groups.groupBy("key", "one", "two").applyInArrow(run, "a long, b long")


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each near-duplicate class: of the document of least doc_id (of
    repeated rows any one). A null text is a class of its own and stays."""
    _, classes = _classified(docs.select("doc_id", "text"), threshold)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("first")
    chosen = classes.groupBy("class_key").agg(first).select(F.col("first.digest").alias("__digest"), _name("first.doc_id").alias("__name"))
    texts = docs.where("text is not null").withColumns({"__digest": _digest(), "__name": F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))})
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    hot = _hot_texts(classes)
    if hot is not None:  # rows of a text that very many share become one in the tasks that read them
        keys = F.broadcast(hot.withColumnRenamed("digest", "__digest"))
        same = texts.join(keys, "__digest", "left_semi").groupBy("__digest", "__name").agg(F.first(F.struct("*")).alias("__all")).select("__all.*")
        texts = texts.join(keys, "__digest", "left_anti").unionByName(same)
    kept = texts.join(chosen, ["__digest", "__name"], "left_semi").groupBy("__digest", "__name").agg(F.first(row).alias("__row"))
    return kept.select("__row.*").unionByName(docs.where("text is null"))
