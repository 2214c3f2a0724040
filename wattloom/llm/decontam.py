"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

Words of items and documents are hashed. A CGK random walk writes a window of words as
a string three times as long, so that a small edit distance becomes a small Hamming
distance; sampled positions of it are an LSH key. Many walks and samples are repeated:
their number is set for each item length from items of that length, with edits up to the
limit, so that the target recall is reached at every length; a length for which MOST walks
would not do is compared exactly with every window that holds enough of an item's word
pairs. Every window of an item's length in every document takes part.
Before its walk a window must hold enough word pairs of the items: an edit breaks at most
two pairs, so the count of pairs (one for a run of equal ones, less one for a run cut by
the window's start) that an item within the limit must share loses nothing.
Candidates are verified by exact edit distance of the item to the best span there.

A document is worked on in one task and nothing is shuffled. The benchmark is sent to
tasks in blocks of at most BLOCK_CHARS characters, one pass over the documents each.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm import text as tx
from wattloom.session import ship

#: Edits allowed, as a share of the item's words.
MAX_EDITS = 0.2
#: Sampled positions of an LSH key, target recall at the edit limit, most repetitions.
SAMPLE, RECALL, MOST = 3, 0.98, 256
#: Walks and edited items of each length from which the repetitions are set.
TRIALS, EDITED = 48, 48
BLOCK_CHARS = 8_000_000
_BITS = 22
_U = np.uint64


@lru_cache(4096)
def _plan(length: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each walk over windows of this length: the salt of each step, and which steps are sampled."""
    steps = 3 * length
    salt = np.empty((repeats, steps), np.uint64)
    sampled = np.zeros((repeats, steps), bool)
    for r in range(repeats):
        rng = np.random.Generator(np.random.PCG64([r, length]))
        salt[r] = rng.integers(1, 1 << 63, steps, dtype=np.uint64)
        sampled[r, rng.choice(steps, min(SAMPLE, steps), replace=False)] = True
    return salt, sampled


def _walks(windows: np.ndarray, repeats: int) -> np.ndarray:
    """LSH keys, a row per walk, of windows (rows of word hashes, 0 past the end)."""
    n, length = windows.shape
    salt, sampled = _plan(length, repeats)
    padded = np.concatenate((windows, np.zeros((n, 1), np.uint64)), 1).ravel()
    base = np.arange(n) * (length + 1)
    at = np.zeros((repeats, n), np.int64)
    key = np.zeros((repeats, n), np.uint64)
    for j in range(3 * length):
        symbol = padded[base + at]
        mark = symbol ^ salt[:, j, None]
        if (now := np.flatnonzero(sampled[:, j])).size:
            key[now] = tx.mix(key[now] * _U(0xD1342543DE82EF95) + symbol[now] + salt[now, j, None])
        mark *= _U(0x9E3779B97F4A7C15)
        mark >>= _U(63)
        at += mark.view(np.int64)
        np.minimum(at, length, out=at)
    return key


def _distances(item: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of item to a part of each span, and where that part ends."""
    width = spans.shape[1]
    cost = np.zeros((len(spans), width + 1), np.int32)
    ramp = np.arange(width + 1, dtype=np.int32)
    for i, symbol in enumerate(item.tolist()):
        new = np.empty_like(cost)
        new[:, 0] = i + 1
        np.minimum(cost[:, :-1] + (spans != symbol), cost[:, 1:] + 1, out=new[:, 1:])
        cost = np.minimum.accumulate(new - ramp, axis=1) + ramp
    end = cost.argmin(1)
    return cost[np.arange(len(spans)), end], end


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tx.mix(a * _U(0xD1342543DE82EF95) + b)


def _hashed(items: list[tuple[int, str]]) -> list[tuple[int, np.ndarray]]:
    """The items that have words, as word hashes."""
    _, _, _, h, first = tx.words([t or "" for _, t in items])
    return [(k, h[a:b]) for (k, _), a, b in zip(items, first[:-1], first[1:]) if b > a]


def repetitions(items: list[tuple[int, str]]) -> dict[int, int]:
    """Walks for each item length, by EDITED edited copies of items of that length; 0 where
    MOST would not reach the recall."""
    by_length: dict[int, list[np.ndarray]] = {}
    for _, w in _hashed(items):
        by_length.setdefault(len(w), []).append(w)
    out = {}
    for length, own in by_length.items():
        rng = np.random.Generator(np.random.PCG64([11, length]))
        pairs = []
        for i in range(EDITED):
            w = own[i * len(own) // EDITED]
            words = w.tolist()
            for _ in range(int(MAX_EDITS * length)):
                at, kind = int(rng.integers(len(words))), int(rng.integers(3))
                new = int(rng.integers(1, 1 << 63))
                words[at : at + (kind != 1)] = [new] if kind != 2 else []
                words = words or [new]
            pairs.append((w, np.array((words + [0] * length)[:length], np.uint64)))
        one, other = (np.stack(x) for x in zip(*pairs))
        missed = (_walks(one, TRIALS) != _walks(other, TRIALS)).sum(0)
        rate = np.minimum((missed + 0.5) / (TRIALS + 1), 1 - 0.25 / TRIALS)
        out[length] = next((r for r in range(1, MOST + 1) if 1 - np.mean(rate**r) >= RECALL), 0)
    return out


class Matcher:
    """The items of one block, with their LSH tables by length."""

    def __init__(self, items: list[tuple[int, str]], repeats: dict[int, int]):
        self.items, self.repeats = _hashed(items), repeats
        self.lengths: dict[int, list[int]] = {}
        for i, (_, w) in enumerate(self.items):
            self.lengths.setdefault(len(w), []).append(i)
        self.known = np.zeros(1 << _BITS, bool)
        for _, w in self.items:
            self.known[_pair(w[:-1], w[1:]) >> _U(64 - _BITS)] = True
        runs = lambda w: int((_pair(w[1:-1], w[2:]) == _pair(w[:-2], w[1:-1])).sum()) if len(w) > 2 else 0
        self.need = {n: min(n - 1 - runs(self.items[i][1]) for i in ids) - 2 * int(MAX_EDITS * n) - 1 for n, ids in self.lengths.items()}
        self.pairs = {n: np.unique(np.concatenate([_pair(self.items[i][1][:-1], self.items[i][1][1:]) for i in ids])) for n, ids in self.lengths.items()}
        self.tables = {n: self._table(n, ids) for n, ids in self.lengths.items()}

    def _table(self, length: int, ids: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        if not self.repeats[length]:
            return []
        windows = np.stack([self.items[i][1] for i in ids])
        out = []
        for key in _walks(windows, self.repeats[length]):
            order = np.argsort(key, kind="stable")
            out.append((key[order], np.array(ids)[order]))
        return out

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, first word, words) of each text and item within the limit."""
        _, _, _, h, first = tx.words(texts)
        if not len(h) or not self.items:
            return []
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        pair = _pair(h[:-1], h[1:])
        hit = self.known[pair >> _U(64 - _BITS)] & (owner[:-1] == owner[1:])
        hit[1:] &= pair[1:] != pair[:-1]
        total = np.concatenate((np.zeros(1, np.int32), np.cumsum(hit, dtype=np.int32)))
        hits = np.flatnonzero(hit)
        stop = first[1:][owner]
        # the longest window holds every shorter one, so only starts where it holds enough go on
        end = np.minimum(np.arange(len(h)) + max(self.lengths), stop)
        here = np.flatnonzero(total[end - 1] - total[: len(end)] >= min(self.need.values()))
        stop_here = stop[here]
        h = np.concatenate((h, np.zeros(1, np.uint64)))
        best: dict[tuple[int, int], tuple] = {}
        for length, ids in self.lengths.items():
            edits = int(MAX_EDITS * length)
            end = np.minimum(here + length, stop_here)
            enough = (total[end - 1] - total[here] >= self.need[length]) & (end - here >= length - edits)
            at, end = here[enough], end[enough]
            if not len(at):
                continue
            own = np.zeros(len(total), np.int32)  # the same count with pairs of items of this length alone
            own[hits[np.isin(pair[hits], self.pairs[length])] + 1] = 1
            np.cumsum(own, out=own)
            at = at[own[end - 1] - own[at] >= self.need[length]]
            if not len(at):
                continue
            grid = at[:, None] + np.arange(length)
            windows = np.where(grid < stop[at][:, None], h[np.minimum(grid, len(h) - 1)], _U(0))
            # equal windows, as in texts that repeat themselves, are searched once
            mark = tx.mix(windows.copy() * np.arange(1, 2 * length, 2, dtype=np.uint64)).sum(1)
            _, once, same = np.unique(mark, return_index=True, return_inverse=True)
            found = set()
            if not self.repeats[length]:
                found.update((w, i) for w in range(len(once)) for i in ids)
            for key, (keys, which) in zip(_walks(windows[once], self.repeats[length]), self.tables[length]):
                lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                for w in np.flatnonzero(hi > lo):
                    found.update((int(w), int(i)) for i in which[lo[w] : hi[w]])
            by_item: dict[int, list[int]] = {}
            for w, i in found:
                by_item.setdefault(i, []).append(w)
            places = {w: np.flatnonzero(same == w) for ws in by_item.values() for w in ws}
            for i, ws in by_item.items():
                near = np.concatenate([at[places[w]] for w in ws])
                seen = {}
                for s in near.tolist():  # one span covers the windows that begin near it
                    seen.setdefault((int(owner[s]), s // (edits + 1)), s)
                start = np.array(list(seen.values()))
                begin = np.maximum(start - 2 * edits - 1, first[owner[start]])
                grid = begin[:, None] + np.arange(length + 4 * edits + 3)
                spans = np.where(grid < stop[start][:, None], h[np.minimum(grid, len(h) - 1)], _U(0))
                for lo in range(0, len(start), 4096):
                    d, e = _distances(self.items[i][1], spans[lo : lo + 4096])
                    for s, b, x, y in zip(start[lo:].tolist(), begin[lo:].tolist(), d.tolist(), e.tolist()):
                        if x <= edits:
                            place, text = (int(owner[s]), i), int(owner[s])
                            value = (x, b + max(0, y - length) - int(first[text]), length)
                            best[place] = min(best.get(place, value), value)
        return [(text, self.items[i][0], *v) for (text, i), v in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_words, edits, similarity, first_word) for each document and
    item where a passage is within MAX_EDITS of the item, counted in words.

    Words are lower-cased runs of letters and numbers. Null or empty texts and items
    match nothing; repeated rows give repeated results; equal items are each reported.
    Extra columns are ignored. An empty table on either side gives no rows."""
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, item_words int, edits int, similarity double, first_word long")
    for items in _blocks(benchmark):
        out = out.union(_block(docs, items))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_CHARS characters."""
    ship(benchmark.sparkSession)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    blocks = math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK_CHARS)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield sorted((r["item_id"], r["text"]) for r in rows)


_matchers: dict[int, Matcher] = {}


def _matcher(items: list[tuple[int, str]], repeats: dict[int, int]) -> Matcher:
    """One per worker process: that of the block in hand."""
    mark = zlib.crc32(repr(items).encode())
    if mark not in _matchers:
        _matchers.clear()
        _matchers[mark] = Matcher(items, repeats)
    return _matchers[mark]


def _block(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((items, repetitions(items)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _matcher(*sent.value)
        for batch in tx.slices(batches, 1):
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in tx.chunks(texts):
                rows = [(keys[lo + t], i, n, x, round(1 - x / n, 6), s) for t, i, x, s, n in match.find(texts[lo:hi])]
                cols = list(zip(*rows)) or [[]] * 6
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "item_words", "edits", "similarity", "first_word"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, item_words int, edits int, similarity double, first_word long")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark passage, each row judged by its own text, in one
    map for each block of the benchmark."""
    for items in _blocks(benchmark):
        docs = _without(docs, items)
    return docs


def _without(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((items, repetitions(items)))

    def clean(texts: list[str | None]) -> list[bool]:
        match, keep = _matcher(*sent.value), [True] * len(texts)
        whole = [t or "" for t in texts]
        for lo, hi in tx.chunks(whole):
            for t, *_ in match.find(whole[lo:hi]):
                keep[lo + t] = False
        return keep

    return tx.keep_rows(docs, clean)
