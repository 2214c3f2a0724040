"""Ranked search, periodic runs and line deduplication against brute force, with odd rows."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.llm import line_dedup, periodic, queries, ranked_search

LINE = "this line of more than forty characters stands in several documents"
#: Nulls, empty and very long texts, repeated rows, ties, no id.
ODD = [
    (1, None), (2, ""), (3, ""), (4, "   \n\t "), (5, "one two"), (None, "a text without a name"), (None, LINE), (6, "word " * 60_000),
    (7, "the same row twice of the day"), (7, "the same row twice of the day"), (8, "ünïcödé \U0001f600 İstanbul ΣΑΣ <|endoftext|>"),
    *((i, f"head {i}\n  {LINE.upper()}\t\n{LINE}\nfoot") for i in range(10, 17)), (16, f"head 16\n  {LINE.upper()}\t\n{LINE}\nfoot"), (16, LINE),
    (-3, "x" * 200_000 + "\n" + LINE + "\r"), (20, "Å" * 20 + "b" * 19), (21, "Å" * 20 + "b" * 20),
]


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, "doc_id long, text string")
    names = "label key doc kind rank score item range position start length h1 n_lines text_key keep row".split()
    return d.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# ---- periodic runs
def plain_runs(w, least_words=24, least_periods=3):
    """Every period tried over the whole text."""
    found = {}
    for q in range(1, len(w) // least_periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least_words, least_periods * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def random_words(rng):
    w = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 10])) for _ in range(rng.randint(0, rng.choice([5, 60, 300])))]
    for _ in range(rng.randint(0, 3)):
        if len(w) > 6:
            a, p = rng.randrange(len(w)), rng.randint(1, len(w) // 3)
            for i in range(a, min(len(w), a + rng.randint(1, 8) * p + rng.randrange(p))):
                w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize("limits", [(24, 3), (2, 2), (5, 3), (1, 4)])
def test_runs_equal_brute_force(limits):
    rng = random.Random(sum(limits))
    for _ in range(200):
        texts = [random_words(rng) for _ in range(rng.randint(1, 4))]
        assert list(periodic.runs_of(texts, *limits)) == [plain_runs(t, *limits) for t in texts]


def test_runs_of_famous_words():
    fib, thue = [b"a"], [b"0"]
    last = [b"a", b"b"]
    while len(last) < 700:
        fib, last = last, last + fib
    for _ in range(9):
        thue = thue + [b"1" if x == b"0" else b"0" for x in thue]
    cubes = [b"x"] * 100 + [b"y"] + [b"x"] * 100
    for w in (last, thue, cubes, cubes * 4):
        assert list(periodic.runs_of([w])) == [plain_runs(w)]
    assert not list(periodic.runs_of([thue]))[0]  # overlap-free


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(periodic.tx, "mix", lambda x: x & np.uint64(3) if len(x) < 200 else x)  # hashes of suffixes collide
    rng = random.Random(3)
    for _ in range(20):
        w = [b"%d" % rng.randrange(4) for _ in range(60)] + [b"p", b"q", b"r"] * 10
        got = periodic.catch(np.array([int(x) if x.isdigit() else 4 + x[0] for x in w], np.uint64), len(w))
        assert got == plain_runs(w)


def test_run_digests_equal_a_plain_reading(spark, sf, odd):
    docs = queries.table(spark, sf, "documents").select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = [(r[0], r[1] or "") for r in docs.collect() if len(r[1] or "") < 30_000]
    want = collections.Counter()
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        h = __import__("zlib").crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        runs = plain_runs(w)
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[(i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    got = collections.Counter(tuple(r) for r in periodic.run_digests(docs.where("coalesce(length(text), 0) < 30000")).collect())
    assert got == want and sum(r[1] > 0 for r in got) > 10


def test_runs_of_odd_rows(odd, empty):
    rows = {r["doc_id"]: r for r in periodic.periodic_runs(odd).collect()}
    assert periodic.periodic_runs(odd).count() == len(ODD) and periodic.run_digests(empty).collect() == []
    assert rows[1]["n_runs"] == 0 and rows[1]["start"] is None and rows[1]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (rows[6]["start"], rows[6]["length"], rows[6]["period"], rows[6]["exponent_milli"]) == (0, 60_000, 1, 60_000_000)


# ---- line deduplication
def test_ranges_may_end_anywhere():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 60)
        rows = sorted(((rng.randrange(rng.choice([1, 2, 5])), 0, rng.randrange(12), 0, rng.randrange(4)) for _ in range(n)), key=lambda r: (r[0], -r[2], r[4]))
        ends = [0, *sorted(rng.randrange(n + 1) for _ in range(rng.randint(0, 4))), n]
        holders, seen, parts = collections.defaultdict(set), [], collections.defaultdict(list)
        for r in rows:
            holders[r[0]].add(r[2])
        for a, b in zip(ends, ends[1:]):
            stream = line_dedup._Stream(5)
            while a < b:
                m = min(b, a + rng.randint(1, 9))
                stream.batch(*(np.array([r[c] for r in rows[a:m]], np.int64) for c in range(5)))
                a = m
            stream.end()
            seen += [(kind, *row) for kind, columns in stream.out for row in zip(*(c.tolist() for c in columns))]
        for kind, h, _, first, count, last in seen:
            if kind == line_dedup.SUMMARY:
                parts[h].append((first, count, last))
        verdict = {h: max(f for f, _, _ in p) for h, p in parts.items() if sum(c for _, c, _ in p) - sum(x[2] == y[0] for x, y in zip(p, p[1:])) >= 5}
        got = {(h, d, k) for kind, h, _, d, _, k in seen if kind == line_dedup.DROP or kind == line_dedup.OPEN and h in verdict and d != verdict[h]}
        assert got == {(r[0], r[2], r[4]) for r in rows if len(holders[r[0]]) >= 5 and r[2] != max(holders[r[0]])}


def plain_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(-(1 << 63) if i is None else i)
    out = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        out[(i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("partitions", [1, 3, 11])
def test_lines_equal_a_plain_reading(spark, odd, partitions):
    rng = random.Random(partitions)
    pool = [f"{k} a shared line that has rather more than forty characters {k}" for k in range(12)]
    rows = ODD + [(rng.randrange(60) if rng.random() > 0.05 else None, "\n".join(rng.choice(pool) if rng.random() > 0.2 else rng.choice(["", "short", f"own {k}"]) for _ in range(rng.randint(0, 9)))) for k in range(150)]
    rows += [rows[-1]] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions).withColumn("key", F.lit(1)).withColumn("doc", F.lit(2))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = collections.Counter(tuple(r) for r in line_dedup.kept_digests(docs, line_dedup.keep_bitmaps(docs)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain_lines(rows)


def test_lines_of_odd_rows(odd, empty):
    bitmaps = line_dedup.keep_bitmaps(odd)
    got = collections.Counter(tuple(r) for r in line_dedup.kept_digests(odd, bitmaps).collect())
    assert got == plain_lines(ODD)
    assert line_dedup.keep_bitmaps(empty).collect() == [] and line_dedup.kept_digests(empty, line_dedup.keep_bitmaps(empty)).collect() == []
    row = bitmaps.where("doc_id = 12").first()
    assert line_dedup.unpack_bitmap(row["n_lines"], row["keep"]).tolist() == [True, False, False, True] and row["n_dropped"] == 2


# ---- ranked search
def plain_search(rows, items, k=20):
    find = lambda t: [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(i, find(t)) for i, t in rows]
    docs = [(i, collections.Counter(w), len(w)) for i, w in docs if w]
    n, length = len(docs), sum(x[2] for x in docs)
    df = collections.Counter(w for _, c, _ in docs for w in c)
    out = collections.Counter()
    for item, t in items:
        scores = []
        for i, c, size in docs:
            m = 75 + 25 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in find(t) if w in c)
            if s > 0:
                scores.append((-s, math.inf if i is None else i))
        out.update((item, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1))
    return out


@pytest.mark.parametrize("block", [1, 40, ranked_search.BLOCK])
def test_search_equals_brute_force(spark, odd, monkeypatch, block):
    rng = random.Random(block)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)]
    rows = ODD + [(k if rng.random() > 0.1 else None, " ".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 40)))) for k in range(250)]
    items = [(k, ", ".join(rng.choice(words) for _ in range(rng.randint(1, 15)))) for k in range(12)] + [(50, None), (51, "-- !"), (52, "nowhere word"), (None, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("ids", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    got = collections.Counter(tuple(r) for r in ranked_search.ranked_search(docs, bench).collect())
    assert got == plain_search(rows, items)
    monkeypatch.setattr(ranked_search, "ITEMS", 60)  # several passes
    assert collections.Counter(tuple(r) for r in ranked_search.ranked_search(docs, bench, 3).collect()) == plain_search(rows, items, 3)


def test_accumulators_are_limited_and_scores_exact():
    rng = np.random.default_rng(5)
    n, v = 4000, 40
    share = 1 / (1 + np.arange(v))[::-1]
    pairs = [(d, t) for t in range(v) for d in np.flatnonzero(rng.random(n) < share[t] * 0.9)]
    owner, term = (np.array(x, np.int64) for x in zip(*sorted(pairs)))
    tf = rng.integers(1, 9, len(owner))
    df = np.bincount(term, minlength=v)
    weights = np.array([ranked_search.weight(n, int(x)) for x in df], np.int64)
    sizes = rng.integers(40, 400, n)
    shard = ranked_search.Shard(sizes, term, owner, tf, weights, n, int(sizes.sum()))
    item = sorted(((t, 1 + t % 2) for t in range(v)), key=lambda x: df[x[0]])
    docs, scores = shard.search(item, 20, 0)
    m = 75 + 25 * sizes * n // int(sizes.sum())
    want = np.zeros(n, np.int64)
    np.add.at(want, owner, (1 + term % 2) * weights[term] * (10**9 * tf // (1000 * tf + 12 * m[owner])))
    assert (scores == want[docs]).all() and sorted(scores)[-20:] == sorted(want)[-20:]
    assert 20 <= shard.touched < 0.8 * (want > 0).sum()


def test_search_of_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert ranked_search.ranked_search(odd, none).collect() == [] and ranked_search.ranked_search(empty, one).collect() == []


@pytest.mark.parametrize("name", ["op11_limited_accumulators", "op13_line_bitmaps"])
def test_twin(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    q = c.execute(queries.ORACLE[name])
    at = [[d[0] for d in q.description].index(x) for x in df.columns]
    assert collections.Counter(tuple(r) for r in df.collect()) == collections.Counter(tuple(r[k] for k in at) for r in q.fetchall())
