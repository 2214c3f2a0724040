"""Periodic runs of words: online dyadic square catching.

A square is a stretch of words that is followed at once by itself; squares of one root
length that touch are one run. As words are appended, every completed block of 2**k words
(aligned at multiples of 2**k) sets a catcher, which waits for the words that end 2 to 4
block lengths later: when the suffix of 2**k words equals the block, both are a distance q
apart with 2**(k+1) <= q < 2**(k+2), and a square of root q may hold them. So an appended
word meets two catchers a level, and log2(n) levels. Squares of root 1 come from catchers of
one word at distance 1. A square of root q covers at least one whole block at its distance,
so none is missed; neighbouring blocks that match at one distance are one catch, whose ends
move out by less than a block each until words differ.

The comparisons of all words appended in one batch of documents run as array operations
over hashes of dyadic suffixes (a hash of 2**(k+1) words mixes the two of its halves); what
they catch is compared word by word before it is reported. Time is O(n log n) for n words,
memory O(n), whatever the periods.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm import text as tx
from wattloom.session import ship

#: Fewest words of a run, and fewest of its periods in it.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words whose catchers advance together; a longer document goes alone.
BATCH = 1 << 17

_U = np.uint64
Run = tuple[int, int, int]  # start, length, period
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def catch(ids: np.ndarray, longest: int, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[Run]:
    """Runs (start, length, smallest period), by start and period, of the sequence of word
    ids; no run is longer than `longest` words.

    Runs have at least least_words words and least_periods (2 or more) periods."""
    n = len(ids)
    found: dict[tuple[int, int], int] = {}
    at = np.full(n, -1, np.int64)  # of each word, the longest run that holds it
    runs: list[Run] = []  # start, end, period
    suffix, block = ids, 1
    while True:
        distances = (1, 2, 3) if block == 1 else (2, 3)
        if (distances[0] * block) * least_periods > longest or n < 2 * block:
            break
        new: list[Run] = []
        rows = -(-len(suffix) // block)
        grid = np.concatenate((suffix, np.zeros(rows * block - len(suffix), np.uint64))).reshape(rows, block)
        for d in distances:
            if rows > d:
                new += _caught(ids, grid, d, least_words, least_periods, at, runs)
        for a, b, q in new:  # a level has no period that is a multiple of another one of it, but 1 of 2 and 3
            if found.get((a, b), q + 1) > q:
                found[(a, b)] = q
                runs.append((a, b, q))
                if b - a > (runs[at[a]][1] - runs[at[a]][0] if at[a] >= 0 else 0):
                    at[a:b] = len(runs) - 1
        if len(suffix) > block:
            left, right = suffix[:-block], suffix[block:]
            suffix = tx.mix(left * _U(0x9E3779B97F4A7C15) + (right ^ (right >> _U(29))) * _U(0xC2B2AE3D27D4EB4F) + _U(block))
        block *= 2
    return sorted((a, b - a, q) for (a, b), q in found.items())


def _caught(ids: np.ndarray, grid: np.ndarray, d: int, least_words: int, least_periods: int, at: np.ndarray, runs: list[Run]) -> list[Run]:
    """Maximal stretches (start, end, period) whose blocks a catcher of distance d * block to
    (d + 1) * block - 1 has met. A block's first suffix is column 0 of its row; the suffix at
    column r of a row d further stands d * block + r words after it."""
    block = grid.shape[1]
    met = grid[d:] == grid[:-d, :1]
    # matching words of a run number at least (least_periods - 1) * q, so whole blocks in it:
    q = d * block + np.arange(block)
    need = np.maximum((np.maximum(least_words - q, (least_periods - 1) * q) - 2 * (block - 1) + block - 1) // block, 1)
    least = int(need.min())
    for _ in range(min(least, 3) - 1):
        met = met[:-1] & met[1:]
    lost = min(least, 3) - 1
    if not len(met):
        return []
    column, row = np.nonzero(met.T)
    if not len(row):
        return []
    first = np.flatnonzero(np.concatenate(([True], (column[1:] != column[:-1]) | (row[1:] != row[:-1] + 1))))
    size = np.diff(np.append(first, len(row))) + lost
    column, row = column[first], row[first]
    enough = size >= need[column]
    out: list[Run] = []
    for a, m, p in zip((row[enough] * block).tolist(), size[enough].tolist(), q[column[enough]].tolist()):
        b = a + m * block  # words a to b equal those p further
        if (k := at[a + (b - a) // 2]) >= 0:
            start, end, period = runs[k]
            if p % period == 0 and start <= a and b + p <= end:
                continue  # several periods of a run that is known
        if not np.array_equal(ids[a:b], ids[a + p : b + p]):
            continue  # equal hashes of different blocks
        lo = max(0, a - block)
        differ = np.flatnonzero(ids[lo:a] != ids[lo + p : a + p])
        a = lo + int(differ[-1]) + 1 if len(differ) else lo
        hi = min(len(ids) - p, b + block)
        differ = np.flatnonzero(ids[b:hi] != ids[b + p : hi + p])
        b = b + int(differ[0]) if len(differ) else hi
        if b - a + p >= max(least_words, least_periods * p):
            out.append((a, b + p, p))
    return out


def runs_of(texts: list[list[bytes]], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> Iterator[list[Run]]:
    """Runs of each document's words, in order."""
    lo = 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + len(texts[hi]) <= BATCH):
            total += len(texts[hi]) + 1
            hi += 1
        yield from _runs_of(texts[lo:hi], least_words, least_periods)
        lo = hi


def _runs_of(texts: list[list[bytes]], least_words: int, least_periods: int) -> list[list[Run]]:
    """The documents stand one after the other, with a separator after each that equals no
    other word: no run reaches over it."""
    names: dict[bytes, int] = {}
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size + 1) - size - 1
    ids = np.empty(int(size.sum()) + len(texts), np.uint64)
    for a, n, words in zip(start.tolist(), size.tolist(), texts):
        ids[a : a + n] = np.fromiter((names.setdefault(w, len(names)) for w in words), np.uint64, n)
    ids[start + size] = np.arange(len(texts), dtype=np.uint64) + _U(1 << 63)
    out: list[list[Run]] = [[] for _ in texts]
    scrambled = tx.mix(ids + _U(0x9E3779B97F4A7C15))  # a bijection: equal where words are
    for a, length, q in catch(scrambled, int(size.max(initial=0)), least_words, least_periods):
        i = int(np.searchsorted(start, a, "right")) - 1
        out[i].append((a - int(start[i]), length, q))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for a, length, q in runs:
        keep[a + q : a + length] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


def split(text: str | bytes | None) -> list[bytes]:
    """Words: what stands between ASCII white space."""
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").split()


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a period put in for one document in ten, by the contract of the query.
    Words without a doc_id stay as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


_SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """Runs of every row of docs (doc_id, text): n_words, n_runs, the run of greatest
    length/period (ties: smallest start, then period), all runs, and digests of the runs and
    of the text without repeated periods.

    A null or empty text has no words and no runs (four nulls, digests of the empty string).
    rewrite, if given, gets each document's id and words first. Repeated rows give repeated
    results, extra columns are ignored, an empty table gives no rows. A map alone: nothing is
    shuffled; memory is bounded by the longest text."""
    ship(docs.sparkSession)
    types = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli")] + [("runs", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

    def sha(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, 1):
            ids, rows = batch.column(0).to_pylist(), []
            texts = [split(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            if rewrite:
                texts = [rewrite(i, t) for i, t in zip(ids, texts)]
            for i, words, runs in zip(ids, texts, runs_of(texts, least_words, least_periods)):
                best = min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
                lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
                rows.append((i, len(words), len(runs), *best, 1000 * best[1] // best[2] if runs else None, [dict(zip(("start", "length", "period"), r)) for r in runs], sha(lines.encode()), sha(b" ".join(collapsed(words, runs)))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types) if rows else pa.RecordBatch.from_pylist([], types)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCHEMA)


def run_digests(docs: DataFrame) -> DataFrame:
    """The columns that the query returns, over texts with planted periods."""
    return periodic_runs(docs, planted).drop("n_words", "runs")
